"""URL filters: rules on host and path, and a character language-model ratio where no rule fits.

Two variable-order Markov models of characters, one of accepted and one of rejected URLs, are smoothed by
interpolation from the uniform distribution up to the longest context (Witten-Bell weights). A URL's score is
the difference of its log-likelihoods under the two, divided by its length; below a calibrated limit it is blocked.

The models read whole URLs from the host on, query and fragment included. Rejected are URLs that a rule blocks or
whose host has a part on a list of unwanted words (also where a rule allows them); accepted are all others. The
rules alone tell nothing about what is unwanted, only about top-level domains and languages, so the list says what
rejection is for; the rejected models read its words, too. It is a parameter, as the rules are.

Hosts are dealt to two folds, and a URL is judged by the models of the other fold, which have seen nothing of its
host. Else they would know every host by heart, and reject all pages of one that a rule blocks in part. So the
scores of all accepted URLs are held out, and the limit is set on them.

A model is a table of grams. For each gram (a context and a character) it holds by how much the score of a
character changes when that gram is known in place of its shorter suffix; for an unknown gram whose context is
known, what the longer context's weight takes away. So a URL's score is a plain sum over the grams it holds: no
window, no state, one look-up a gram, and partial sums before the shuffle. All numbers are whole millionths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, let, partitions, saved

#: Longest context in characters.
ORDER = 4
#: A gram is kept if it occurs as often as this, however large the input.
MIN_COUNT = 2
#: Rows up to which the models are broadcast (about 10 MB); they are joined by shuffle beyond.
BROADCAST = 200_000
#: Characters that a position of a URL may hold, for the uniform distribution.
ALPHABET = 64
#: How often the rejected models read each unwanted word.
WORD_COUNT = 5
#: Share of accepted URLs that the limit may reject.
MAX_FALSE_REJECTS = 0.01
#: Stands before the first character of a URL.
START = "\x02"
UNIT = 1_000_000

#: Words that mark a host as unwanted wherever one of its parts between dots and hyphens is one (fixed values).
UNWANTED = (
    "ads adserver adult banner bet bets betting bonus casino cheap clickbait free gambling jackpot loan loans lottery malware nude payday "
    "pharma phishing pills poker porn prize promo replica sex slots spam track tracker viagra warez win xxx"
).split()

#: The rules: action, host and path (fixed values).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path, and all from the host on; empty if there is no `://`."""
    has = F.coalesce(url.contains("://"), F.lit(False))
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    found = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    host = F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    whole = F.concat(host, F.substr(rest, F.length(found) + 1))
    return tuple(F.when(has, x).otherwise("") for x in (host, path, whole))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name (host and path) and action of the longest rule whose host is the URL's or a parent of it and whose
    path starts the URL's; null if none fits. A rule with path `/` fits any path that starts with it."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the last that fits wins
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, action = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, act).otherwise(action)
    return name, action


def grams(rows: DataFrame, text: str = "text", order: int = ORDER) -> DataFrame:
    """rows with one row for each position of the text and each length up to order + 1 of the gram that ends
    there: `gram`. The text is led by START."""
    led = F.concat(F.lit(START), F.col(text))

    def ending(t: Column) -> Column:
        # in positions from 2 on; grams of length 1 to order + 1
        at = F.sequence(F.lit(2), F.length(t))
        return F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), F.least(i, F.lit(order + 1))), lambda n: F.substr(t, i - n + 1, n))))

    return rows.withColumn("gram", F.explode(F.when(F.length(text) > 0, let(led, ending)).otherwise(F.array().cast("array<string>"))))


def fit(labelled: DataFrame) -> DataFrame:
    """The models (fold, gram, known, unknown: whole millionths) from rows of (fold, text, a, r): how often the text
    is accepted and rejected, one model for each fold.

    `known` is added for each occurrence of the gram; `unknown` for each gram that is not in the table but
    whose context is this one.
    """
    counted = grams(labelled).groupBy("fold", "gram").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    kept = saved(counted.where(F.col("a") + F.col("r") >= MIN_COUNT).withColumn("n", F.length("gram")))
    # of each context: how often it is followed, and by how many different characters
    context = kept.select("fold", F.expr("substr(gram, 1, n - 1)").alias("context"), "a", "r")
    sums = saved(
        context.groupBy("fold", "context").agg(*(f for c in "ar" for f in (F.sum(c).alias(f"{c}_n"), F.sum((F.col(c) > 0).cast("int")).alias(f"{c}_kinds"))))
    )
    # probabilities, from single characters to the longest grams
    steps = []
    for n in range(1, ORDER + 2):
        own = kept.where(F.col("n") == n).withColumn("context", F.expr("substr(gram, 1, n - 1)")).join(sums, ["fold", "context"])
        if not steps:
            own = own.withColumns({"low_a": F.lit(1.0 / ALPHABET), "low_r": F.lit(1.0 / ALPHABET)})
        else:
            low = steps[-1].select("fold", F.col("gram").alias("suffix"), F.col("p_a").alias("low_a"), F.col("p_r").alias("low_r"))
            own = own.withColumn("suffix", F.expr("substr(gram, 2)")).join(low, ["fold", "suffix"])
        p = {c: (F.col(c) + F.col(f"{c}_kinds") * F.col(f"low_{c}")) / F.nullif(F.col(f"{c}_n") + F.col(f"{c}_kinds"), F.lit(0)) for c in "ar"}
        own = own.withColumns({f"p_{c}": F.coalesce(v, F.col(f"low_{c}")) for c, v in p.items()})
        gain = F.log(F.col("p_a") / F.col("p_r")) - F.log(F.col("low_a") / F.col("low_r"))
        steps.append(saved(own.select("fold", "gram", "p_a", "p_r", F.round(gain * UNIT).cast("long").alias("known"))))
    known = steps[0].select("fold", "gram", "known")
    for step in steps[1:]:
        known = known.unionByName(step.select("fold", "gram", "known"))
    weight = lambda c: F.coalesce(F.col(f"{c}_kinds") / F.nullif(F.col(f"{c}_n") + F.col(f"{c}_kinds"), F.lit(0)), F.lit(1.0))
    # a class that never saw the context passes all weight on; kinds is at least 1 where it did
    lost = sums.select("fold", F.col("context").alias("gram"), F.round(F.log(weight("a") / weight("r")) * UNIT).cast("long").alias("unknown"))
    model = saved(known.join(lost, ["fold", "gram"], "full").select("fold", "gram", "known", F.coalesce("unknown", F.lit(0)).alias("unknown")))
    for df in (kept, sums, *steps):
        dropped(df)
    return model


def scored(texts: DataFrame, model: DataFrame) -> DataFrame:
    """(text, score) of distinct (text, fold), in millionths a character, rounded down, by the model of that fold."""
    own = grams(texts.select("text", "fold")).withColumn("context", F.expr("substr(gram, 1, length(gram) - 1)"))
    known, unknown = model.where("known IS NOT NULL").select("fold", "gram", "known"), model.select("fold", F.col("gram").alias("context"), "unknown")
    if model.count() <= BROADCAST:
        known, unknown = F.broadcast(known), F.broadcast(unknown)
    found = own.join(known, ["fold", "gram"], "left").join(unknown, ["fold", "context"], "left")
    sums = found.groupBy("text").agg(F.sum(F.coalesce("known", "unknown", F.lit(0))).alias("sum"))
    return sums.select("text", F.floor(F.col("sum") / F.length("text")).cast("long").alias("score"))


def calibrated(accepted: DataFrame) -> int | None:
    """The limit below which URLs are rejected, from rows of (score): the highest thousandth that rejects at
    most MAX_FALSE_REJECTS of them. None without any, then nothing is rejected. Scores lie within a
    few tens, so at most some ten thousand counts reach the driver."""
    found = accepted.groupBy(F.floor(F.col("score") / (UNIT // 1000)).alias("at")).agg(F.count("*").alias("n")).collect()
    counts = sorted((r["at"], r["n"]) for r in found)
    room = MAX_FALSE_REJECTS * sum(n for _, n in counts)
    for at, n in counts:
        room -= n
        if room < 0:
            return int(at) * (UNIT // 1000)
    return None


def has_word(host: Column, words: list[str]) -> Column:
    """Whether a part of the host between dots and hyphens is one of the words."""
    return host.rlike(rf"(^|[.-])({'|'.join(words)})([.-]|$)") if words else F.lit(False)


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, unwanted=UNWANTED) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    A null URL and one without `://` have empty host and path, fit no rule and are allowed, for they hold
    nothing to judge. Equal URLs count once for the models, however many rows they have, and get equal verdicts; a
    URL may have any length. Null ids are kept. An empty table gives an empty result. Other columns are ignored,
    whatever their names.
    """
    spark = pages.sparkSession
    host, path, whole = parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), whole.alias("text"))
    rule, action = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "action": action})
    rejected = has_word(F.col("host"), unwanted) | F.coalesce(F.col("action") == "block", F.lit(False))
    urls = rows.where("text <> ''").groupBy("text").agg(F.first("host").alias("host"), F.first("action").alias("action"))
    texts = urls.select("text", F.pmod(F.crc32("host"), F.lit(2)).cast("int").alias("fold"), rejected.cast("long").alias("r"))
    texts = saved(texts.withColumn("a", 1 - F.col("r")).repartition(partitions(spark)))  # a small file is one task else
    other = texts.select((1 - F.col("fold")).alias("fold"), "text", "a", "r")
    if unwanted:
        words = spark.range(2).select(F.col("id").cast("int").alias("fold"), F.explode(F.array(*map(F.lit, unwanted))).alias("text"))
        other = other.unionByName(words.withColumns({"a": F.lit(0).cast("long"), "r": F.lit(WORD_COUNT).cast("long")}))
    scores = saved(scored(texts, fit(other)).join(texts, "text"))
    limit = calibrated(scores.where("a > 0"))
    low = scores.where(F.col("score") < limit if limit is not None else F.lit(False)).select("text", F.lit("block").alias("low"))
    return rows.join(low, "text", "left").select("page_id", "host", "path", "rule", F.coalesce("action", "low", F.lit("allow")).alias("verdict"))
