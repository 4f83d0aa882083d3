"""Language identification by rank-order n-gram profiles.

A profile is the list of the most frequent n-grams (one to three letters of a word, its ends marked) in order.
A document's own list is compared to each language's by out-of-place distance: for each n-gram the difference
of the two ranks, or the length of a profile where the language lacks it.

N-grams are counted by sorting packed numbers, many documents at a time. Profiles are broadcast, those of
LANGUAGES languages at a time: each further part is a further pass that keeps the better of two predictions.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, sliced

PROFILE = 400
#: Labelled documents of a language that the profiles are learned from, at most about so many.
LEARN_DOCUMENTS = 5_000
#: Languages whose profiles are held at once (a few MB).
LANGUAGES = 1_000
#: Rows of the table of languages up to which it is broadcast.
BROADCAST = 50_000
UNDETERMINED = "und"
SPACE = 32
#: Code points of a batch, or of a window of a longer text, counted at once.
PIECE = 1 << 18
CODE = 21


@functools.cache
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def merged(doc: np.ndarray, gram: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row for each (doc, gram), in order, with the sum of n."""
    order = np.lexsort((gram, doc))
    doc, gram, n = doc[order], gram[order], n[order]
    start = np.flatnonzero(np.concatenate([[len(doc) > 0], (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])])[: len(doc)])
    return doc[start], gram[start], np.add.reduceat(n, start) if len(start) else n


def _counted(low: list[str], lead: int = 0, tail: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, gram, n) in order for at most 65,535 texts in lower case, led and ended by a space; a gram is up to three
    code points, the first highest. Of a window of a longer text, `lead` and `tail` code points at its ends are
    neighbours only."""
    cp = code_points("".join(low))
    doc = np.repeat(np.arange(len(low), dtype=np.uint64), [len(t) for t in low])
    own = np.ones(len(cp), bool)
    own[:lead] = False
    own[len(own) - tail :] = False
    letter = letters()[cp]
    # other characters become spaces; a word keeps the space before and the one after it
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[:-1] |= letter[1:]
    cp, doc, own, letter = np.where(letter, cp, SPACE)[keep], doc[keep], own[keep], letter[keep]
    a, b = letter[:-1], letter[1:]
    ones, twos, threes = letter & own, (a | b) & own[:-1], (letter & own)[1:-1]
    two_doc = np.where(a, doc[:-1], doc[1:])[twos]
    present = np.flatnonzero(np.bincount(cp, minlength=1))
    if len(present) > 0xFFFF:  # too many kinds of letters to pack them beside the document
        wide = cp.astype(np.int64)
        gram = [(wide << 2 * CODE)[ones], (wide[:-1] << 2 * CODE | wide[1:] << CODE)[twos], (wide[:-2] << 2 * CODE | wide[1:-1] << CODE | wide[2:])[threes]]
        docs = np.concatenate([doc[ones], two_doc, doc[1:-1][threes]]).astype(np.int64)
        return merged(docs, np.concatenate(gram), np.ones(len(docs), np.int64))
    to_id = np.zeros(int(present.max(initial=0)) + 1, np.uint64)
    to_id[present] = np.arange(1, len(present) + 1)
    c = to_id[cp]
    one = (doc << np.uint64(48) | c << np.uint64(32))[ones]
    two = two_doc << np.uint64(48) | (c[:-1] << np.uint64(32) | c[1:] << np.uint64(16))[twos]
    three = (doc[1:-1] << np.uint64(48) | c[:-2] << np.uint64(32) | c[1:-1] << np.uint64(16) | c[2:])[threes]
    keys = np.sort(np.concatenate([one, two, three]))
    start = np.flatnonzero(np.concatenate([[len(keys) > 0], keys[1:] != keys[:-1]])[: len(keys)])
    n = np.diff(start, append=len(keys))
    keys = keys[start]
    of_id = np.concatenate([[0], present]).astype(np.int64)
    part = lambda shift: of_id[(keys >> np.uint64(shift) & np.uint64(0xFFFF)).astype(np.int64)]
    return (keys >> np.uint64(48)).astype(np.int64), part(32) << 2 * CODE | part(16) << CODE | part(0), n


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, gram, n) in order. Texts over PIECE code points are counted window by window."""
    low = [f" {t.lower()} " for t in texts]
    found, at = [], 0
    while at < len(low):
        to, size = at, 0
        while to < len(low) and to - at < 0xFFFF and (to == at or size + len(low[to]) <= PIECE):
            size += len(low[to])
            to += 1
        if size <= PIECE:
            d, g, n = _counted(low[at:to])
            found.append((d + at, g, n))
        else:
            for d, g, n in windows(low[at]):
                found.append((d + at, g, n))
        at = to
    if len(found) == 1:
        return found[0]
    return merged(*map(np.concatenate, zip(*found, strict=True))) if found else merged(*np.zeros((3, 0), np.int64))


def windows(low: str):
    """Counts of one long text. Every n-gram lies within one code point of its window's."""
    for at in range(0, len(low), PIECE):
        lead, tail = min(at, 1), min(max(len(low) - at - PIECE, 0), 1)
        yield _counted([low[at - lead : at + PIECE + tail]], lead, tail)


def top(doc: np.ndarray, n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, rank) of the `most` most frequent rows of each doc, equal counts in the order of rows. Counts are below
    2^40, docs below 2^23."""
    row = np.argsort(doc.astype(np.int64) << 40 | (1 << 40) - 1 - n, kind="stable")
    own = doc[row]
    start = np.searchsorted(own, own, "left")
    rank = np.arange(len(row)) - start
    return row[rank < most], rank[rank < most]


class Profiles:
    """Profiles of some languages, ready to be compared to documents. Of languages at equal distances the first by
    name is taken."""

    def __init__(self, ranked: dict[str, list[int]], most: int = PROFILE) -> None:
        self.languages, self.most = sorted(ranked), most
        self.tables = []
        for name in self.languages:
            grams = np.array(ranked[name], np.int64)
            order = np.argsort(grams)
            self.tables.append((grams[order], order))

    def judge(self, texts: list[str]) -> list[tuple[str, float]]:
        doc, gram, n = gram_counts(texts)
        row, rank = top(doc, n, self.most)
        doc, gram = doc[row], gram[row]
        size = np.bincount(doc, minlength=len(texts))
        far = np.empty((len(self.languages), len(texts)))
        for i, (grams, ranks) in enumerate(self.tables):
            at = np.minimum(np.searchsorted(grams, gram), max(len(grams) - 1, 0))
            out = np.where(grams[at] == gram, np.abs(ranks[at] - rank), self.most) if len(grams) else np.full(len(gram), self.most)
            far[i] = np.bincount(doc, weights=out, minlength=len(texts))
        if not self.languages:
            return [(UNDETERMINED, 0.0)] * len(texts)
        best = far.argmin(0)
        score = 1 - far.min(0) / np.maximum(size * self.most, 1)
        return [(self.languages[b], s) if k else (UNDETERMINED, 0.0) for b, s, k in zip(best.tolist(), score.tolist(), size.tolist(), strict=True)]


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def better(one: tuple[str, float], other: tuple[str, float]) -> tuple[str, float]:
    """The prediction with the higher score, of equal ones the first by name; any before none."""
    rank = lambda p: (p[0] != UNDETERMINED, p[1])
    if rank(one) == rank(other):
        return min(one, other)
    return max(one, other, key=rank)


@dataclass
class Learned:
    """Profiles of all languages as a table (part, lang, rank, gram), LANGUAGES or about so many in each of its parts."""

    table: DataFrame | None
    parts: int
    most: int = PROFILE

    def profiles(self, part: int) -> Profiles:
        """One part: about LANGUAGES times `most` numbers reach the driver."""
        ranked: dict[str, list] = {}
        for r in self.table.where(F.col("part") == part).orderBy("lang", "rank").collect():
            ranked.setdefault(r["lang"], []).append(r["gram"])
        return Profiles(ranked, self.most)

    def judge(self, texts: list[str]) -> list[tuple[str, float]]:
        """Predictions for a few texts on the driver."""
        found = [(UNDETERMINED, 0.0)] * len(texts)
        for part in range(self.parts):
            found = list(map(better, found, self.profiles(part).judge(texts)))
        return found


def learn(labelled: DataFrame, most: int = PROFILE, documents: int = LEARN_DOCUMENTS, languages: int = LANGUAGES) -> Learned:
    """Profiles from rows of (doc_id, text, lang), of about `documents` rows of each language, picked by a hash
    of id and text; all rows of languages with fewer. One number reaches the driver."""
    known = labelled.where("text IS NOT NULL AND lang IS NOT NULL")
    counts = saved(known.groupBy("lang").agg(F.count("*").alias("n")))
    n = counts.count()
    if not n:
        return Learned(None, 0, most)
    shares = counts.select("lang", F.least(F.ceil(F.lit(float(documents << 30)) / F.col("n")), F.lit(1 << 30)).alias("share"))
    if n <= BROADCAST:
        shares = F.broadcast(shares)
    picked = known.withColumn("at", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))).join(shares, "lang").where("at < share")

    def run(batches):
        for batch in sliced(batches):
            names = batch.column(0).dictionary_encode()
            doc, gram, n = gram_counts(batch.column(1).to_pylist())
            lang, gram, n = merged(names.indices.to_numpy()[doc].astype(np.int64), gram, n)
            yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(lang)), pa.array(gram), pa.array(n)], names=["lang", "gram", "n"])

    grams = picked.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    ranked = grams.withColumn("rank", rank).where(F.col("rank") <= most)
    parts = -(-n // languages)
    return Learned(saved(ranked.select(F.pmod(F.xxhash64("lang"), F.lit(parts)).cast("int").alias("part"), "lang", "rank", "gram")), parts, most)


def identify(docs: DataFrame, learned: Learned, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs with the predicted language and its score (1: same order of n-grams, 0: none in common).

    `und` and 0 where text is null or has no letter, or no language was learned. Rows are independent; texts of any
    length and with any number of different letters are read whole. pred_col and score_col must not be columns of
    docs; all columns of docs are kept.
    """
    spark, at = docs.sparkSession, docs.columns.index(text_col)
    names = [*docs.columns, pred_col, score_col]
    if not learned.parts:
        return docs.withColumns({pred_col: F.lit(UNDETERMINED), score_col: F.lit(0.0)})
    schema = docs.select("*", F.lit("").alias(pred_col), F.lit(0.0).alias(score_col)).schema
    for field in schema.fields:
        field.nullable = True

    def judged(rows: DataFrame, part: int) -> DataFrame:
        shared = spark.sparkContext.broadcast(learned.profiles(part))

        def run(batches):
            for batch in sliced(batches, at):
                found = shared.value.judge([t or "" for t in batch.column(at).to_pylist()])
                if part:
                    found = map(better, zip(*(c.to_pylist() for c in batch.columns[-2:]), strict=True), found)
                lang, score = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names) - 2], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=names)

        return rows.mapInArrow(run, schema)

    for part in range(learned.parts):
        docs = judged(saved(docs) if part else docs, part)
    return docs


def predicted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, by profiles of the documents that aren't held out.

    A null id is not held out. Repeated rows are judged each. Of languages at equal distances the first by name is
    predicted. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).withColumn("held_out", held_out())
    learned = learn(rows.where("NOT held_out"))
    return identify(rows.select("doc_id", "held_out", "text"), learned).select("doc_id", "held_out", "lang_pred", "score")
