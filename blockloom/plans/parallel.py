"""Block-parallel decoding: scan for magic numbers, decode every candidate, then chain.

Bytes are scanned once for block and end-of-stream magic numbers at any bit, whole files as rows or files in ranges of
bytes. The bits from one hit to the next are a candidate block, decoded by libbz2 as a stream of one block where it is
found. Only positions and checksums meet again: per file, a chain is followed from the header, each block beginning
where the one before ended. Where a chain breaks (a false hit, damage, odd levels), the strict walk goes on from the
last piece that held, which gives the same bytes or names the error.
"""

from __future__ import annotations

import io

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.format import BLOCK_MAGIC, END_MAGIC, MAGIC_BITS, WORD, CodecError, bits_at, first_magic, magic_positions
from ..operators.ranges import first_level, read_at, walked
from ..operators.walk import MAX_PACKED, Walk, decoded_block
from ..sources.bz2 import listed, materialized, materialized_singly, opened

#: Candidates that a range may have: one in so many bytes, and a few more (fixed values). Beyond that its file goes to
#: the strict walk at once, or hostile input could be decoded many times over.
BYTES_PER_CANDIDATE, FEW = 16, 64
#: Bytes of a range.
RANGE_BYTES = 8 << 20

_FIELDS = {
    "file_id": pa.string(), "start_bit": pa.int64(), "end_bit": pa.int64(), "level": pa.int32(), "head": pa.binary(), "crc": pa.int64(),
    "out": pa.binary(), "good": pa.bool_(),
}
_SCHEMA = "file_id string, start_bit long, end_bit long, level int, head binary, crc long, out binary, good boolean"


def scanned(f, lo: int, hi: int, size: int):
    """Candidates that begin in a byte range of an open file, as dicts of _FIELDS: the file itself (start_bit -1, its
    first bytes) from the range that begins it, each block hit cut at the next hit, decoded, with the least level
    tried that took it, and each end of stream with the bytes where the next header is due."""
    if lo == 0:
        yield {"start_bit": -1, "end_bit": 8 * size, "head": read_at(f, 0, 4), "good": True}
    data = read_at(f, lo, hi + 8)
    hits = [h for h in magic_positions(data, magics=(BLOCK_MAGIC, END_MAGIC)).tolist() if h < 8 * (hi - lo)]
    if len(hits) > (hi - lo) // BYTES_PER_CANDIDATE + FEW:
        return
    if not hits:
        return
    level = first_level(f)
    if hi < size:  # the last block ends at a hit beyond the range
        f.seek(lo + len(data))
        while len(data) < hi - lo + MAX_PACKED and first_magic(data, max(hits[-1] + MAGIC_BITS, 8 * (hi - lo))) is None:
            more = f.read(1 << 20)
            if not more:
                break
            data += more
    beyond = first_magic(data, max(hits[-1] + MAGIC_BITS, 8 * (hi - lo)))
    for at, after in zip(hits, [*hits[1:], 8 * len(data) if beyond is None else beyond], strict=True):
        row = {"start_bit": 8 * lo + at, "end_bit": 8 * lo + after, "good": False}
        if bits_at(data, at, MAGIC_BITS) == END_MAGIC:
            due = at + MAGIC_BITS + 32 + 7 >> 3
            head = read_at(f, lo + due, lo + due + 4)
            if at + MAGIC_BITS + 32 <= 8 * len(data):
                row |= {"head": head, "crc": bits_at(data, at + MAGIC_BITS, 32), "good": True}
            if head[:3] == b"BZh" and len(head) == 4 and 0x31 <= head[3] <= 0x39:
                level = head[3] - 0x30
        elif after - at > MAGIC_BITS + 33:
            for n in dict.fromkeys((level, 9)):
                out = decoded_block(data, at, after, n)
                if out is not None:
                    row |= {"level": n, "crc": bits_at(data, at + MAGIC_BITS, 32), "out": out, "good": True}
                    break
        yield row


def _rows(name: str, found):
    for row in found:
        yield pa.RecordBatch.from_arrays([pa.array([name if k == "file_id" else row.get(k)], t) for k, t in _FIELDS.items()], names=list(_FIELDS))


def one_by_one(batch: pa.RecordBatch):
    """A batch's rows as values, one at a time: a list of them would hold every file twice."""
    for i in range(batch.num_rows):
        yield tuple(c[i].as_py() for c in batch.columns)


def candidates(files: DataFrame) -> DataFrame:
    """Candidates (see `scanned`) of files that are rows (file_id, content), or of their ranges where they have `lo` and
    `hi`, too."""
    whole = "lo" not in files.columns

    def run(batches):
        for batch in batches:
            for name, data, lo, hi in one_by_one(batch):
                data = data or b""
                yield from _rows(name, scanned(io.BytesIO(data), lo, len(data) if hi is None else hi, len(data)))

    edges = [F.lit(0).cast("long").alias("lo"), F.lit(None).cast("long").alias("hi")] if whole else ["lo", "hi"]
    return files.select("file_id", "content", *edges).mapInArrow(run, _SCHEMA)


def shared_out(files: DataFrame, parallelism: int) -> DataFrame:
    """(file_id, content, lo, hi): each file in as many ranges of its bytes, dealt by file and range to the session's tasks."""
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = F.coalesce(F.octet_length("content"), F.lit(0)).cast("long")
    step = F.greatest(F.ceil(size / parallelism), F.lit(1).cast("long"))
    lo = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(size - 1, F.lit(0)), step)).alias("lo")
    parts = files.select("file_id", "content", size.alias("size"), step.alias("step"), lo)
    dealt = parts.select("file_id", "content", "lo", F.least(F.col("lo") + F.col("step"), "size").alias("hi"))
    return dealt.repartition(n, "file_id", "lo")


def ranges(spark: SparkSession, paths: list[str], step: int = RANGE_BYTES) -> DataFrame:
    """(file_id, size, lo, hi) of the files' ranges; a folder stands for its .bz2 files."""
    files = spark.createDataFrame([x for p in paths for x in listed(p)], "file_id string, size long")
    lo = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(step).cast("long")))
    return files.select("file_id", "size", lo.alias("lo")).withColumn("hi", F.least(F.col("lo") + step, F.col("size")))


def range_candidates(parts: DataFrame) -> DataFrame:
    """Candidates of `ranges`, each found where its range is read."""

    def run(batches):
        for batch in batches:
            for name, size, lo, hi in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with opened(name) as f:
                    yield from _rows(name, scanned(f, lo, hi, size))

    return parts.select("file_id", "size", "lo", "hi").mapInArrow(run, _SCHEMA)


def chain(rows: list[dict]) -> tuple[list[int], dict | None]:
    """Start bits of the blocks in order, as far as a file's candidates form whole streams end to end; and, if that is
    not to the end, where the strict walk goes on: bit, level, checksum."""
    at_start = {r["start_bit"]: r for r in rows if r["good"]}
    size, head = at_start[-1]["end_bit"], at_start[-1]["head"]
    bit, level, checksum, order = 0, 0, 0, []
    while bit < size or level:
        if not level:
            if len(head) < 4 or head[:3] != b"BZh" or not 0x31 <= head[3] <= 0x39:
                break
            bit, level, checksum = bit + 32, head[3] - 0x30, 0
        row = at_start.get(bit)
        if row is None:
            break
        if row["head"] is not None:
            if row["crc"] != checksum:
                break
            bit, head, level = bit + MAGIC_BITS + 32 + 7 & ~7, row["head"], 0
        elif row["level"] <= level:
            order.append(bit)
            checksum = ((checksum << 1 | checksum >> 31) ^ row["crc"]) & WORD
            bit = row["end_bit"]
        else:
            break
    else:
        return order, None
    return order, {"bit": bit, "level": level, "checksum": checksum}


def followed(metas: pa.Table) -> pa.Table:
    """(file_id, block_idx, start_bit, level, checksum) of a file's chain; a last row with a level, if it breaks there."""
    name = metas["file_id"][0].as_py()
    order, rest = chain(metas.to_pylist())
    rows = [(name, i, b, None, None) for i, b in enumerate(order)] + ([(name, len(order), rest["bit"], rest["level"], rest["checksum"])] if rest else [])
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
    columns = zip(*rows, strict=True) if rows else [[]] * 5
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file_id", "block_idx", "start_bit", "level", "checksum"])


_BLOCK = {"file_id": pa.string(), "block_idx": pa.int64(), "start_bit": pa.int64(), "out": pa.binary(), "crc": pa.int64(), "error": pa.string()}


def serial(breaks: DataFrame) -> DataFrame:
    """Blocks by the strict walk from where chains broke, and a row with the error's name where one is invalid. `breaks`
    has (file_id, content, block_idx, start_bit, level, checksum); content is null for a file that is to be opened."""

    def run(batches):
        for batch in batches:
            for name, data, n, start, level, checksum in one_by_one(batch):
                with opened(name) if data is None else io.BytesIO(data) as f:
                    f.seek(start >> 3)
                    pieces = walked(f, Walk(bit=start & 7, level=level, checksum=checksum, base=start >> 3))
                    row = ()
                    while row is not None:
                        try:
                            piece = next((p for p in pieces if p.kind == "block"), None)
                            row = piece and (name, n, piece.start, piece.out, piece.crc, None)
                        except CodecError as e:
                            row = (name, n, e.bit, None, None, e.kind)
                        if row:
                            n += 1
                            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, _BLOCK.values(), strict=True)], names=list(_BLOCK))
                            row = None if row[-1] else row

    columns = breaks.select("file_id", "content", "block_idx", "start_bit", "level", "checksum")
    return columns.mapInArrow(run, "file_id string, block_idx long, start_bit long, out binary, crc long, error string")


def assembled(found: DataFrame, contents: DataFrame | None) -> DataFrame:
    """(file_id, block_idx, start_bit, out, crc, fast, error) from candidates."""
    tried = materialized_singly(found)
    chained = materialized(tried.drop("out").groupBy("file_id").applyInArrow(followed, "file_id string, block_idx long, start_bit long, level int, checksum long"))
    blocks = tried.where("out IS NOT NULL").select("file_id", "start_bit", "out", "crc")
    fast = chained.where("level IS NULL").select("file_id", "block_idx", "start_bit").join(blocks, ["file_id", "start_bit"])
    breaks = chained.where("level IS NOT NULL")
    breaks = breaks.withColumn("content", F.lit(None).cast("binary")) if contents is None else breaks.join(contents.select("file_id", "content"), "file_id")
    rest = serial(breaks) if contents is None else materialized_singly(serial(breaks))
    names = ("file_id", "block_idx", "start_bit", "out", "crc")
    return fast.select(*names, F.lit(True).alias("fast"), F.lit(None).cast("string").alias("error")).unionByName(rest.select(*names, F.lit(False).alias("fast"), "error"))


def decode(files: DataFrame, parallelism: int | None = None) -> DataFrame:
    """(file_id, block_idx, start_bit, out, crc, fast, error) from (file_id, content), for files that fit in a row.

    The plaintext of a file is its `out` in the order of block_idx. `fast` tells whether a block came by the chain. A
    file that is invalid has, after its valid blocks, a row with null `out` and the error's name; an empty file has no
    row. `parallelism` is the number of tasks that share a file, each with a range of its bytes; with 1, the default, a
    file is decoded serially. Files are dealt to the session's tasks in any case: however few share a file, no task
    gets more than its share of them.
    """
    return assembled(candidates(shared_out(files, parallelism or 1)), files)


def decode_paths(spark: SparkSession, paths: list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The same for files by their paths, however large: each range of bytes is read and decoded by a task of its own."""
    parts = ranges(spark, paths, range_bytes)
    n = min(parts.count(), 100_000)  # a number of tasks; rows beyond share them
    return assembled(range_candidates(parts.repartition(max(n, 1), "file_id", "lo")), None)


def joined_text(blocks: DataFrame) -> DataFrame:
    """(file_id, out, error, n_blocks, fast) with the whole plaintext of each file; for files that fit in a row."""
    parts = F.array_sort(F.collect_list(F.struct("block_idx", "out", "error")))
    whole = blocks.groupBy("file_id").agg(parts.alias("p"), F.bool_and("fast").alias("fast"))
    return whole.select(
        "file_id",
        F.expr("unhex(array_join(transform(filter(p, x -> x.out is not null), x -> hex(x.out)), ''))").alias("out"),
        F.element_at("p", -1)["error"].alias("error"),
        F.expr("size(filter(p, x -> x.out is not null))").alias("n_blocks"),
        "fast",
    )
