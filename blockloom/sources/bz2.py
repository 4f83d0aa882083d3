"""A `bz2` data source: strict reading and writing of .bz2 files at any level.

Read: `spark.read.format("bz2").load(path)` gives (path, start_bit, data), or lines with option `lines`: (path,
start_bit of the block that a line begins in, its number there, value). A file is split in ranges of `rangeBytes`
(64 MB by default, 0 for none), a partition each; a partition holds no more than a block and its compressed bytes.
Write: `df.write.format("bz2").option("level", n).save(path)` writes a binary or string column `data` (or `value`),
one file for each partition; blocks go out as they fill, and files appear under their names when the job commits.

Paths may be local or of any store that pyarrow opens. `plans.parallel` decodes with a check of the whole chain, and
`spark.read.text` is Spark's own lenient codec.
"""

from __future__ import annotations

import glob
import os
import tempfile
import uuid
from contextlib import contextmanager
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..operators.encoder import compress
from ..operators.ranges import range_pieces, walked
from ..operators.walk import Walk

RANGE_BYTES = 64 << 20


def shared_path(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share; a temporary one only where all run on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="blockloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/blockloom-{uuid.uuid4().hex}"


def materialized(df: DataFrame) -> DataFrame:
    """df written once to the shared folder, and read back."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def records_at_once(spark: SparkSession, n: int):
    """Arrow batches of up to n rows in what is run here (a streaming query keeps the settings of its start)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialized_singly(df: DataFrame) -> DataFrame:
    """`materialized` for a kernel over whole files as rows: a worker is given one at a time, or a batch would hold all
    files of a task."""
    with records_at_once(df.sparkSession, 1):
        return materialized(df)


def resolve(name: str, base: str) -> str:
    """A path: URLs and absolute paths as they are, a key ending in .bz2 under `base`, and a bare table name as the
    .bz2 file of that name under `base`."""
    if "://" in name or name.startswith("/"):
        return name
    return f"{base.rstrip('/')}/{name}" if name.endswith(".bz2") else f"{base.rstrip('/')}/{name}.bz2"


def local(path: str) -> str | None:
    """A path of the local file system, None for one of another store."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    return None if "://" in path else path


def opened(path: str):
    own = local(path)
    if own is not None:
        return open(own, "rb")
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def listed(path: str) -> list[tuple[str, int]]:
    """(file, bytes) of a file, a folder's .bz2 files or a local pattern."""
    own = local(path)
    if own is not None:
        names = sorted(glob.glob(f"{own}/*.bz2")) if os.path.isdir(own) else sorted(glob.glob(own)) or [own]
        return [(n, os.path.getsize(n)) for n in names]
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    info = store.get_file_info(name)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    inside = [i for i in store.get_file_info(fs.FileSelector(name)) if i.path.endswith(".bz2")]
    return sorted((f"{path.rstrip('/')}/{i.base_name}", i.size) for i in inside)


def blocks_of(stream):
    """Plaintext blocks of an open file, as soon as each is complete; CodecError where it is invalid."""
    for piece in walked(stream, Walk()):
        if piece.kind == "block":
            yield piece.out


def lines_of(pieces, whole_file: bool):
    """(start_bit, lines) for each block: the lines that begin in the range, whole, with the block they begin in. A
    line that is begun there is followed into later blocks."""
    begun: list[bytes] | None = [] if whole_file else None  # parts of the open line, None if it isn't ours
    key, first = (0, 0), True  # where it began
    for piece, ours in pieces:
        if piece.kind == "before":
            begun = [] if whole_file or piece.out.endswith(b"\n") else None
            continue
        if piece.kind == "edge" and not (begun and any(begun)):
            return  # the next line begins in another range
        if piece.kind != "block":
            continue
        if first:
            key, first = (piece.start, 0), False
        elif begun == []:
            key = (piece.start, 0)
        head, *rest = piece.out.split(b"\n")
        if begun is not None:
            begun.append(head)
        if not rest:
            continue
        found = [] if begun is None else [(*key, b"".join(begun))]
        if not ours:
            yield found
            return
        *middle, last = rest
        n = int(bool(found) and found[0][0] == piece.start)
        found += [(piece.start, n + i, line) for i, line in enumerate(middle)]
        begun, key = [last] if last else [], (piece.start, n + len(middle))
        yield found
    if begun and any(begun):
        yield [(*key, b"".join(begun))]


@dataclass
class FileRange(InputPartition):
    path: str
    lo: int
    hi: int


class Bz2Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = [p for p in (options.get("path") or "").split(",") if p]
        self.lines = options.get("lines", "false").lower() == "true"
        self.step = int(options.get("rangebytes") or options.get("rangeBytes") or RANGE_BYTES)

    def partitions(self) -> list[FileRange]:
        found = []
        for path, size in (x for p in self.paths for x in listed(p)):
            step = self.step or max(size, 1)
            found += [FileRange(path, lo, min(lo + step, size)) for lo in range(0, max(size, 1), step)]
        return found

    def read(self, partition: FileRange):
        with opened(partition.path) as f:
            pieces = range_pieces(f, partition.lo, partition.hi)
            if self.lines:
                for rows in lines_of(pieces, partition.lo == 0):
                    if rows:
                        start, n, text = zip(*rows, strict=True)
                        values = pa.array([t.decode("utf-8", "replace") for t in text], pa.string())
                        yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(n)), pa.array(start, pa.int64()), pa.array(n, pa.int64()), values], names=["path", "start_bit", "line", "value"])
                return
            for piece, _ in pieces:
                if piece.kind == "edge":
                    return
                if piece.kind == "block":
                    yield pa.RecordBatch.from_arrays([pa.array([partition.path]), pa.array([piece.start], pa.int64()), pa.array([piece.out], pa.binary())], names=["path", "start_bit", "data"])


@dataclass
class Written(WriterCommitMessage):
    hidden: str
    path: str


class Bz2Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.folder = options["path"].removeprefix("file:")
        self.folder = "/" + self.folder.lstrip("/") if self.folder.startswith("/") else self.folder
        self.level = int(options.get("level", "9"))
        if not 1 <= self.level <= 9:
            raise ValueError("level must be 1 to 9")
        self.overwrite, self.job = overwrite, uuid.uuid4().hex
        os.makedirs(self.folder, exist_ok=True)

    def write(self, iterator) -> Written:
        import bz2

        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{self.job}.bz2"
        hidden = f"{self.folder}/.{name}-{context.taskAttemptId()}"
        packer, some = bz2.BZ2Compressor(self.level), False
        with open(hidden, "wb") as f:
            for batch in iterator:
                if "data" in batch.schema.names:
                    data = b"".join(x or b"" for x in batch.column("data").to_pylist())
                else:
                    data = b"".join(x for v in batch.column("value").cast(pa.binary()).to_pylist() for x in (v or b"", b"\n"))
                some |= bool(data)
                f.write(packer.compress(data))
            f.write(packer.flush() if some else compress(b"", self.level))
        return Written(hidden, f"{self.folder}/{name}")

    def commit(self, messages) -> None:
        if self.overwrite:
            for old in glob.glob(f"{self.folder}/*.bz2"):
                os.remove(old)
        for m in messages:
            if m:
                os.replace(m.hidden, m.path)

    def abort(self, messages) -> None:
        for m in messages:
            if m and os.path.exists(m.hidden):
                os.remove(m.hidden)


class Bz2DataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bz2"

    def schema(self) -> str:
        return "path string, start_bit long, line long, value string" if self.options.get("lines", "false").lower() == "true" else "path string, start_bit long, data binary"

    def reader(self, schema) -> Bz2Reader:
        return Bz2Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> Bz2Writer:
        return Bz2Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Bz2DataSource)
