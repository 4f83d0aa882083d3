"""Corpus pipeline: quality rules, language ID, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. Stages but the last
return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockloom.llm import jaccard, langid, packing, quality, secrets, simhash
from blockloom.llm.common import dropped, free, held, saved, settled, table

#: A document goes if it is less like its language than this (0 to 1); prose scores 0.5 to 0.9.
LEAST_LIKENESS = 0.3
#: Words that a worker of the packing stage keeps: fewer than by itself, as the workers of the stages before it are still there.
CACHE_WORDS = 100_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the quality rules keep. The measures are written beside the rows, so texts are measured once.

    Null and empty texts fail the base rules and go. A null or unknown language only keeps a row out of the
    references. Equal rows fare alike and all stay or go. An empty table stays empty. Columns may have any names.
    """
    rows = docs.select(F.struct("*").alias("row"), "text", "lang")
    return quality.judged(rows, keep=["row"]).where("_kept").select("row.*")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those unlike any language; all without a letter if no row has a language.

    A null text has no letter. `lang` and `source` may be null; a null id counts as not held out. Equal rows fare
    alike. An empty table stays empty. The prediction's columns take names that docs doesn't have.
    """
    learned = langid.learn(docs.select("doc_id", "text", "lang").where(~langid.held_out()))
    if not learned.parts:
        return docs.where(F.col("text").rlike("\\p{L}"))
    pred, score = free(docs, "lang_pred"), free(docs, "score")
    judged = langid.identify(docs, learned, pred_col=pred, score_col=score)
    return judged.where((F.col(pred) != langid.UNDETERMINED) & (F.col(score) >= LEAST_LIKENESS)).select(*docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: the one with the smallest id (a null id comes last),
    of several rows with that id the one with the smallest hash of its text, of equal ones any one. Documents link
    where their sets of five-word shingles have a Jaccard index of 0.8 or more: the SimHash operator with that rule
    in place of a number of bits (see `jaccard`).

    Null texts and those without a word are one group; a shorter text than a shingle is one shingle. An empty table
    stays empty. Columns may have any names.
    """
    none, number, mark, again = (free(docs, c) for c in ("none", "number", "mark", "again"))
    key = {none: F.col("doc_id").isNull(), number: F.coalesce("doc_id", F.lit(0)).cast("long"), mark: F.xxhash64("text")}
    fps = saved(jaccard.fingerprints(docs, [c.alias(k) for k, c in key.items()]))
    linked = jaccard.links(docs, fps, key)
    grouped = saved(simhash.least_of_groups(fps.select(*key, "fp"), F.struct(*key), "first", linked).select(*key, (F.struct(*key) == F.col("first")).alias("stays")))
    # few rows go, or have a key that others have, too: the rest needs no shuffle
    apart = saved(grouped.groupBy(*key).agg(F.first("stays").alias("stays"), F.count("*").alias("n")).where("NOT stays OR n > 1"))
    twice = saved(apart.where("stays").select(*key))
    rows = docs.withColumns(key)
    alone = rows.join(held(saved(apart.select(*key))), list(key), "left_anti")
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(mark))
    first = rows.join(held(twice), list(key), "left_semi").withColumn(again, nth).where(F.col(again) == 1)
    return alone.select(*docs.columns).unionByName(first.select(*docs.columns))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark; n_chars becomes the new length.

    Null texts stay null, with n_chars null; empty ones stay empty. Each row is handled by itself, so equal rows stay
    equal. An empty table stays empty. Columns may have any names.
    """
    redacted = secrets.redacted_texts(docs)
    return redacted.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 4096 tokens; columns as those of op8.

    A null text is empty, an empty one a document of the end mark alone; null ids stay null. Equal rows are packed each
    on its own. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), cache_words=CACHE_WORDS)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", dedup_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: SQL can't express n-gram profiles, XXH64 shingles or the tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
