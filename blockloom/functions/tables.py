"""Table functions of the codec over files that are rows (file_id, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import parallel
from ..sources.bz2 import materialized_singly


def bz2_candidates(files: DataFrame) -> DataFrame:
    """(file_id, start_bit, end_bit, kind, crc, good): every place that looks like a block or an end of stream; `good`
    if it decodes up to the next one (a block), or is whole (an end)."""
    found = parallel.candidates(files).where("start_bit >= 0")
    kind = F.when(F.col("head").isNull(), "block").otherwise("end")
    return materialized_singly(found.select("file_id", "start_bit", "end_bit", kind.alias("kind"), "crc", "good"))


def bz2_blocks(files: DataFrame) -> DataFrame:
    """(file_id, block_idx, start_bit, out, crc, error): the blocks of each file in order, and the error where one is
    invalid."""
    return parallel.decode(files).select("file_id", "block_idx", "start_bit", "out", "crc", "error")
