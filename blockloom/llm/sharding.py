"""Sharding by proportional stratified interleaving.

Rows are ranked in a seeded shuffle within their source, all rows are put in the order of their fractional
rank, and that order is cut into shards whose row counts differ by one at most. Every stretch of the order
holds each source in its share of the whole, and so does every shard.

Only identifiers, sizes and hashes are shuffled, never texts. A rank within a source is the rank within a
slice of the hash range plus what lies in lower slices, so a source that holds a third of all rows is spread
over all slices. Row numbers in the whole order are made the same way over slices of the fractional rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, saved

#: Rows that one slice of a hash or rank range is meant to hold.
SLICE_ROWS = 50_000


def shuffled_key(seed: str, *columns: str) -> Column:
    """A 60-bit hash of the seed and the columns (nulls are left out), uniform and the same on every engine that has MD5."""
    text = F.concat_ws(":", F.lit(seed), *(F.col(c).cast("string") for c in columns))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def interleaved(rows: DataFrame, n_shards: int) -> DataFrame:
    """Adds `position`, `shard` and `slot` to rows of (doc_id, size, text_crc32, stratum, h)."""
    total = rows.count()
    slices = max(partitions(rows.sparkSession), -(-total // SLICE_ROWS))
    ties = ("h", "doc_id", "text_crc32", "size")
    cut = rows.withColumn("slice", (F.col("h") / F.lit(float(1 << 60)) * slices).cast("int"))
    counts = cut.groupBy("stratum", "slice").agg(F.count("*").alias("n"))
    by_stratum = Window.partitionBy("stratum")
    before = counts.select(
        "stratum", "slice",
        (F.sum("n").over(by_stratum.orderBy("slice")) - F.col("n")).alias("before"),
        F.sum("n").over(by_stratum).alias("n_stratum"),
    )
    in_slice = F.row_number().over(Window.partitionBy("stratum", "slice").orderBy(*ties))
    ranked = saved(
        cut.withColumn("in_slice", in_slice)
        .join(before, ["stratum", "slice"])
        .withColumn("fraction", (2 * (F.col("before") + F.col("in_slice")) - 1) / (2 * F.col("n_stratum")))
        .select("doc_id", "size", "text_crc32", "h", "fraction", (F.col("fraction") * slices).cast("int").alias("part"))
    )
    # one row per slice: `slices` grows with the rows by 1 in SLICE_ROWS
    parts = ranked.groupBy("part").agg(F.count("*").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    in_part = F.row_number().over(Window.partitionBy("part").orderBy("fraction", *ties))
    position = F.col("before") + F.col("in_part") - 1
    return (
        ranked.withColumn("in_part", in_part)
        .join(parts, "part")
        .withColumn("position", position)
        .withColumn("shard", F.expr(f"position * {n_shards} div {max(total, 1)}").cast("int"))
        .withColumn("slot", F.expr(f"position - (shard * {total}L + {n_shards - 1}) div {n_shards}"))
    )


def shard(
    docs: DataFrame, n_shards: int = 24, seed: str = "interleave", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    The law is `rows`: shard counts differ by one at most, so `grown_shard` is null. A null text is empty for
    its checksum and has size 8; a null source is a source of its own. The shuffle goes by id and checksum, so rows with
    a null or repeated id are spread like others unless their texts are equal, too; ties go by id (null first), then
    checksum and size. Repeated rows are rows like any other. Of texts only size and checksum are used, whatever their
    length. An empty table gives an empty result. Other columns of docs are ignored, whatever their names.
    """
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce(text.cast("binary"), F.lit(b""))).alias("text_crc32"),
        F.when(F.col(source_col).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(source_col).cast("string"))).alias("stratum"),
    ).withColumn("h", shuffled_key(seed, "doc_id", "text_crc32"))
    return interleaved(saved(rows), n_shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
