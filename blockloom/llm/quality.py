"""Quality rules by distribution divergence.

A document's histograms of character classes and of common words are compared to those of each language by
Jensen-Shannon distance (base 2, so 0 to 1). The languages' histograms are sums over all documents of that
language which pass the base rules. A document passes if it is near enough to one language in both histograms;
each comparison is made only for texts long enough to tell.

Everything is built-in DataFrame functions. A text is read once: its words become one array, and all counts
are taken from that array or by deleting characters; nothing but a few numbers a document is written for the
second step. Repeated word windows are found by sorting (64-bit hash of the window, place).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, saved

#: White space and symbols of the base counts (fixed values).
WHITE = "[ \\t-\\r]"
SYMBOLS = "[#*$%&|<>]"
BLANKS = " \t\n\x0b\x0c\r"
#: Sixteen common words of each language (fixed values).
COMMON = {
    "en": "the of and to in is that for it with as was on be by this".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par".split(),
    "es": "de la que el en y a los se del las un por con no una".split(),
}
WORDS = sorted({w for words in COMMON.values() for w in words})
#: One character for each common word.
MARKS = "".join(chr(0x41 + i) for i in range(len(WORDS)))
#: Character classes: each is what a pattern leaves out (white space is what the words leave). The rest is other
#: letters and marks.
CLASSES = {"lower": "[a-z]+", "upper": "[A-Z]+", "digit": "[0-9]+", "white": f"{WHITE}+", "stop": "[.,;:!?'\"()-]+", "symbol": f"{SYMBOLS}+"}

MIN_WORDS = 50
MAX_REPEATED = 50
#: Lengths from which the histograms are compared.
MIN_CHARACTERS = 200
MIN_WORDS_COMPARED = 50
#: Histograms agree up to a distance a + b / sqrt(n): a short text strays further from its language by chance.
MAX_CHARACTER_DISTANCE = (0.15, 2.5)
MAX_WORD_DISTANCE = (0.12, 1.55)


def words_of(text: Column) -> Column:
    """Array of the text's words."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{WHITE}+"))


def without(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def repeated_words(words: Column, n: int = 3) -> Column:
    """Number of words in windows of n words that are found twice or more. Places are only sorted by hash where some
    hash occurs twice."""
    windows = F.slice(words, 1, F.greatest(F.size(words) - (n - 1), F.lit(0)))
    hashed = F.transform(windows, lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, n))))

    def starts(pairs: Column) -> Column:
        at = lambda i: F.get(pairs, i)["h"]
        twice = F.filter(pairs, lambda p, k: F.coalesce(p["h"] == at(k - 1), F.lit(False)) | F.coalesce(p["h"] == at(k + 1), F.lit(False)))
        return F.sort_array(F.transform(twice, lambda p: p["i"]))

    def covered(hashes: Column) -> Column:
        places = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.aggregate(
            let(F.sort_array(places), starts),
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda acc, i: F.struct((acc["n"] + n - F.greatest(acc["end"] - i, F.lit(0))).alias("n"), (i + n).alias("end")),
        )["n"]

    return let(hashed, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier one."""
    return let(F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]")), lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long")


def common_marks(words: Column) -> Column:
    """A string with one character for each common word of the text."""
    shown = [*WORDS, *(w.capitalize() for w in WORDS), *(w.upper() for w in WORDS)]
    listed = F.array(*map(F.lit, WORDS))
    return F.array_join(F.transform(F.filter(words, lambda w: w.isin(shown)), lambda w: F.substring(F.lit(MARKS), F.array_position(listed, F.lower(w)).cast("int"), F.lit(1))), "")


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a struct `_m`: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), chars (counts
    of CLASSES and the rest) and common (a string, see common_marks)."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def counted(t: Column, w: Column, word_chars: Column) -> Column:
        classes = [F.length(t) - word_chars if name == "white" else without(t, p) for name, p in CLASSES.items()]
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            word_chars.cast("long").alias("word_chars"),
            duplicate_lines(t).alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
            F.array(*(c.cast("long") for c in classes)).alias("classes"),
            F.length(t).cast("long").alias("length"),
            common_marks(w).alias("common"),
        )

    def measure(t: Column) -> Column:
        return let(words_of(t), lambda w: let(F.length(F.array_join(w, "")), lambda c: counted(t, w, c)))

    m = F.col("_m")
    rest = m["length"] - F.aggregate(m["classes"], F.lit(0).cast("long"), lambda a, x: a + x)
    return docs.withColumn("_m", measure(text)).withColumn(
        "_m",
        F.struct(
            m["n_words"].alias("n_words"), m["word_chars"].alias("word_chars"), F.get(m["classes"], F.lit(list(CLASSES).index("symbol"))).alias("n_symbols"),
            m["n_dup_lines"].alias("n_dup_lines"), m["n_repeat_words"].alias("n_repeat_words"), F.concat(m["classes"], F.array(rest)).alias("chars"), m["common"].alias("common"),
        ),
    )


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEATED * m["n_words"])


def _counts(common: Column, words: list[str]) -> list[Column]:
    return [(F.length(common) - F.length(F.replace(common, F.lit(MARKS[WORDS.index(w)]), F.lit("")))).cast("long") for w in words]


def references(rows: DataFrame, lang_col: str = "lang") -> dict[str, tuple[list[int], list[int]]]:
    """Sums over all documents of each language: characters by class; common words and all other words. At most
    one row for each language of COMMON reaches the driver."""
    m = F.col("_m")
    n = len(CLASSES) + 1
    sums = [F.sum(F.get(m["chars"], F.lit(i))) for i in range(n)] + [F.sum(c) for c in _counts(m["common"], WORDS)] + [F.sum(m["n_words"])]
    found = {}
    for r in rows.where(F.col(lang_col).isin(*COMMON) & ~base_failed(m)).groupBy(lang_col).agg(*sums).collect():
        lang, chars, common, total = r[0], list(r[1 : n + 1]), dict(zip(WORDS, r[n + 1 : -1], strict=True)), r[-1]
        own = [common[w] for w in COMMON[lang]]
        found[lang] = (chars, [*own, total - sum(own)])
    return found


def distance(counts: Column, reference: list[int]) -> Column:
    """Jensen-Shannon distance of two histograms, 0 to 1; null if the first is empty."""
    total = sum(reference)
    q = F.array(*(F.lit(x / total) for x in reference))

    def of(size: Column) -> Column:
        # try_divide: a branch that isn't taken may still be evaluated
        part = lambda x, mean: F.when(x > 0, x * F.log2(F.try_divide(x, mean))).otherwise(F.lit(0.0))
        share = lambda c: F.try_divide(c, size)
        terms = F.zip_with(counts, q, lambda c, y: part(share(c), (share(c) + y) / 2) + part(y, (share(c) + y) / 2))
        return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))

    size = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(size > 0, let(size, of))


def limit(most: tuple[float, float], n: Column) -> Column:
    return most[0] + most[1] / F.sqrt(F.greatest(n, F.lit(1)))


def near_language(m: Column, lang: Column, found: dict[str, tuple[list[int], list[int]]]) -> Column:
    """Whether the document agrees with one language at least; true if there is none to compare with, or if its own
    language is known and has no reference."""
    verdict = lang.isNotNull() & ~lang.isin(*found) if found else F.lit(True)
    for lang, (chars, common) in sorted(found.items()):
        own = _counts(m["common"], COMMON[lang])
        rest = m["n_words"] - sum(own[1:], own[0])
        by_char = (m["word_chars"] < MIN_CHARACTERS) | (distance(m["chars"], chars) <= limit(MAX_CHARACTER_DISTANCE, m["word_chars"]))
        by_word = (m["n_words"] < MIN_WORDS_COMPARED) | (distance(F.array(*own, rest), common) <= limit(MAX_WORD_DISTANCE, m["n_words"]))
        verdict = verdict | (by_char & by_word)
    return F.coalesce(verdict, F.lit(True))


def judged(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (default: all but the text) with `_m`, `_base_failed` and `_kept`.

    A null or empty text has no words and fails. A null language keeps a document out of the references; one of a
    language without a word list is judged by the base rules alone, as is any without a reference (an empty table, no
    known language). Rows are independent but for the references, so repeated rows get equal verdicts. Texts of any
    length are read whole. Columns of docs may have any names but those added.
    """
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    rows = saved(measured(docs.select(*keep, F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")), "_text").drop("_text"))
    failed = base_failed(F.col("_m"))
    return rows.withColumn("_base_failed", failed).withColumn("_kept", ~failed & near_language(F.col("_m"), F.col("_lang"), references(rows, "_lang"))).drop("_lang")


def rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, the base counts, base_failed and kept of every document. Other columns are ignored."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged(rows, keep=["doc_id"]).select("doc_id", *(F.col("_m")[c].alias(c) for c in counts), F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))
