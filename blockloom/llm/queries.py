"""The registered queries of the corpus operators and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, ctph, html_layout, langid, packing, quality, secrets, sharding, simhash, urlfilter
from .common import table
from .oracle import SQL


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predicted(table(spark, sf_dir, "documents"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judged(table(spark, sf_dir, "pages"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_layout.extracted(table(spark, sf_dir, "pages"))


def op6_ctph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.fingerprints(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.counted(secrets.scan(table(spark, sf_dir, "documents")))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_bpe": op2_bpe,
    "op3_langid": op3_langid,
    "op4_urls": op4_urls,
    "op5_html": op5_html,
    "op6_ctph": op6_ctph,
    "op7_simhash": op7_simhash,
    "op8_packing": op8_packing,
    "op9_secrets": op9_secrets,
    "op10_sharding": op10_sharding,
}

#: The others need hashes, tokenizers or models that SQL lacks; tests hold them against brute force.
ORACLE: dict[str, str] = SQL
