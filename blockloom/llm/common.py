"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches are cut so that one holds about this many bytes of text (a single longer text stays whole).
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none and all run on
    one machine."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="blockloom-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


#: Tables that saved() wrote and that were not dropped, oldest first.
_TABLES: list[DataFrame] = []


def saved(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back: later stages don't recompute it, and a lost
    executor costs no more than a reread."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/blockloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._blockloom_path = path
    _TABLES.append(out)
    return out


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """make() as a saved table; the tables that were saved on the way to it are dropped."""
    before = set(map(id, _TABLES))
    out = saved(make())
    for df in [t for t in _TABLES if id(t) not in before and t is not out]:
        dropped(df)
    return out


def dropped(df: DataFrame) -> None:
    """Delete the files of a saved() table that no later plan reads."""
    path = getattr(df, "_blockloom_path", None)
    if path:
        _TABLES[:] = [t for t in _TABLES if t is not df]
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Rows of keys up to which a table of them is broadcast (tens of MB).
BROADCAST_KEYS = 500_000


def held(df: DataFrame) -> DataFrame:
    """A saved table of keys, to be broadcast if it is small, else to be joined by shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def free(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, even where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sliced(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `limit` bytes of the text column, or of one row."""
    for batch in batches:
        column = batch.column(text)
        if column.nbytes <= limit:
            if batch.num_rows:
                yield batch
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
