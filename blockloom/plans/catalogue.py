"""Registry of the codec queries and of their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tables
from ..functions.checksum import bz2_combined_crc, crc32_bzip2
from ..functions.kernels import bz2_compress, bz2_decompress, bz2_encode, bz2_error, compress_bytes
from ..operators import stages
from ..operators.format import BLOCK_SLACK, CRC_TABLE, LEVEL_UNIT
from ..sources import bz2 as source
from ..streaming import push
from . import parallel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly before kernel work: a small file is one partition else."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def utf8(c: Column | str) -> Column:
    return F.encode(F.col(c) if isinstance(c, str) else c, "UTF-8")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws(",", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return table(spark, sf_dir, "orders").select("o_orderkey", line.alias("value"))


_LINE = "concat_ws(',', o_orderkey, o_custkey, o_orderstatus, o_orderpriority)"


# Sources and sinks


@query("SELECT doc_id, text FROM documents")
def roundtrip_documents(spark, sf_dir):
    packed = bz2_compress(utf8("text"), F.when(F.col("doc_id") % 2 == 0, 1).otherwise(9))
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.decode(bz2_decompress(packed), "UTF-8").alias("text"))


@query("SELECT doc_id, text FROM documents")
def encode_kernel_roundtrip(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.decode(bz2_decompress(bz2_encode(utf8("text"), F.lit(1))), "UTF-8").alias("text"))


def written_lines(spark, sf_dir, level: int = 1) -> str:
    source.register(spark)
    folder = source.shared_path(spark)
    order_lines(spark, sf_dir).select("value").write.format("bz2").option("level", level).mode("append").save(folder)
    return folder


@query(f"SELECT count(*) AS n_rows, CAST(sum(octet_length(encode({_LINE})) + 1) AS BIGINT) AS n_bytes FROM orders")
def csv_bz2_scan(spark, sf_dir):
    lines = spark.read.format("bz2").option("lines", "true").load(written_lines(spark, sf_dir))
    return lines.agg(F.count("*").alias("n_rows"), F.sum(F.octet_length("value") + 1).cast("long").alias("n_bytes"))


@query(f"SELECT {_LINE} AS line FROM orders")
def spark_text_scan(spark, sf_dir):
    """Spark's own codec: splittable, and lenient with damaged files."""
    return spark.read.text(written_lines(spark, sf_dir)).select(F.col("value").alias("line"))


@query(f"SELECT o_orderkey, substr({_LINE}, 1, 160) AS preview FROM orders ORDER BY o_orderkey LIMIT 3")
def preview_lines(spark, sf_dir):
    """A preview of three lines: the limit is the feature."""
    lines = spark.read.format("bz2").option("lines", "true").load(written_lines(spark, sf_dir, 9))
    key = F.split("value", ",")[0].cast("long")
    return lines.select(key.alias("o_orderkey"), F.substring("value", 1, 160).alias("preview")).orderBy("o_orderkey").limit(3)


@query(f"SELECT {_LINE} AS line FROM orders")
def ranges_scan(spark, sf_dir):
    """Files split in ranges of 16 kB: lines and blocks reach over their edges."""
    lines = spark.read.format("bz2").option("lines", "true").option("rangeBytes", 16 << 10).load(written_lines(spark, sf_dir))
    return lines.select(F.col("value").alias("line"))


@query("SELECT doc_id, text FROM documents")
def encode_drained(spark, sf_dir):
    """Texts pushed to the incremental encoder in chunks; what it drains on the way and at the end is one stream."""
    import bz2

    from ..operators.batch import finish_all
    from ..operators.encoder import Encoder

    def run(batches):
        for batch in batches:
            texts, encoders, drained = batch.column(1).cast(pa.binary()).to_pylist(), [], []
            for text in texts:
                e, parts = Encoder(1), []
                for i in range(0, len(text or b""), 10_000):
                    e.push(text[i : i + 10_000])
                    parts.append(e.drain())
                encoders.append(e)
                drained.append(b"".join(parts))
            ends = finish_all(encoders)
            out = [None if t is None else bz2.decompress(d + end) for t, d, end in zip(texts, drained, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()).cast(pa.string())], names=["doc_id", "text"])

    return spread(table(spark, sf_dir, "documents")).select("doc_id", "text").mapInArrow(run, "doc_id long, text string")


#: Documents that a file of `source_files` is made of, at most.
FILE_DOCUMENTS = 5_000


def source_files(spark, sf_dir, level: int = 1) -> DataFrame:
    """(file_id, content): the documents of each source and each FILE_DOCUMENTS ids in the order of doc_id, compressed, a file at a time."""

    def pack(docs: pa.Table) -> pa.Table:
        text = "".join(docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])["text"].drop_null().to_pylist())
        return pa.table({"file_id": docs["file_id"][:1], "content": pa.array([compress_bytes(text.encode(), level)], pa.binary())})

    file_id = F.concat_ws("/", "source", F.expr(f"doc_id div {FILE_DOCUMENTS}"))
    docs = table(spark, sf_dir, "documents").select(file_id.alias("file_id"), "doc_id", "text")
    return docs.groupBy("file_id").applyInArrow(pack, "file_id string, content binary")


_FILE = f"concat_ws('/', source, doc_id // {FILE_DOCUMENTS})"
_SOURCES = f"SELECT {_FILE} AS file_id, string_agg(text, '' ORDER BY doc_id) AS text FROM documents GROUP BY 1"


@query(_SOURCES)
def parallel_equals_serial(spark, sf_dir):
    whole = parallel.joined_text(parallel.decode(source.materialized(source_files(spark, sf_dir))))
    return whole.select("file_id", F.decode("out", "UTF-8").alias("text"))


@query(f"SELECT file_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, true AS fast FROM ({_SOURCES})")
def parallel_fast_path(spark, sf_dir):
    """Every file is decoded by its chain of speculative blocks."""
    blocks = parallel.decode(source.materialized(source_files(spark, sf_dir)))
    return blocks.groupBy("file_id").agg(F.sum(F.octet_length("out")).alias("n_bytes"), F.bool_and("fast").alias("fast"))


@query(f"SELECT tasks, file_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes FROM ({_SOURCES}), (VALUES (0), (1), (3)) AS p(tasks)")
def parallel_pools(spark, sf_dir):
    """Files shared out as by default (0), each file in one task, each in three: the same bytes."""
    files = source.materialized(source_files(spark, sf_dir))
    out = None
    for tasks in (0, 1, 3):
        sums = parallel.decode(files, tasks or None).groupBy("file_id").agg(F.sum(F.octet_length("out")).alias("n_bytes")).withColumn("tasks", F.lit(tasks))
        out = sums if out is None else out.unionByName(sums)
    return out


@query(f"SELECT file_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, true AS fast, 'InvalidMagic' AS error FROM ({_SOURCES})")
def parallel_fallback(spark, sf_dir):
    """Four bytes after the end break the chain: all blocks come by it, and the strict walk from there names the error."""
    files = source_files(spark, sf_dir).withColumn("content", F.concat("content", F.lit(b"zzzz")))
    blocks = parallel.decode(source.materialized(files))
    fast = F.bool_and(F.col("fast") | F.col("error").isNotNull()).alias("fast")
    return blocks.groupBy("file_id").agg(F.sum(F.octet_length("out")).alias("n_bytes"), fast, F.max("error").alias("error"))


@query(f"SELECT count(*) AS n_rows, CAST(sum(octet_length(encode({_LINE})) + 1) AS BIGINT) AS n_bytes, true AS fast, CAST(NULL AS VARCHAR) AS error FROM orders")
def parallel_ranges(spark, sf_dir):
    """Files by their paths, in ranges of 16 kB that tasks of their own read and decode."""
    blocks = parallel.decode_paths(spark, [written_lines(spark, sf_dir)], 16 << 10)
    lines = F.octet_length("out") - F.octet_length(F.replace(F.decode("out", "UTF-8"), F.lit("\n"), F.lit("")))
    return blocks.agg(F.sum(lines).cast("long").alias("n_rows"), F.sum(F.octet_length("out")).alias("n_bytes"), F.bool_and("fast").alias("fast"), F.max("error").alias("error"))


@query(f"SELECT file_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, true AS checked FROM ({_SOURCES})")
def blocks_checked(spark, sf_dir):
    """Each block's plaintext against the checksum in its header, by the native expression."""
    blocks = tables.bz2_blocks(source.materialized(source_files(spark, sf_dir)))
    return blocks.groupBy("file_id").agg(F.sum(F.octet_length("out")).alias("n_bytes"), F.bool_and(crc32_bzip2(F.col("out")) == F.col("crc")).alias("checked"))


@query(f"SELECT file_id, CAST(1 AS BIGINT) AS ends, true AS blocks, true AS whole FROM ({_SOURCES})")
def candidates_whole(spark, sf_dir):
    """One end in each file; every candidate decodes, and they lie end to end behind the header."""
    found = tables.bz2_candidates(source.materialized(source_files(spark, sf_dir)))
    by = Window.partitionBy("file_id").orderBy("start_bit")
    found = found.withColumn("tiled", F.coalesce(F.lag("end_bit").over(by), F.lit(32)) == F.col("start_bit"))
    ends = F.count_if(F.col("kind") == "end").alias("ends")
    return found.groupBy("file_id").agg(ends, (F.count_if(F.col("kind") == "block") > 0).alias("blocks"), F.bool_and(F.col("good") & F.col("tiled")).alias("whole"))


@query("SELECT doc_id // 50 AS part, string_agg(text, '' ORDER BY doc_id) AS text FROM documents GROUP BY 1")
def multi_stream(spark, sf_dir):
    """Streams of mixed levels, empty ones among them, read as one: fifty documents each."""
    one = bz2_compress(utf8("text"), F.col("doc_id") % 9 + 1)
    docs = spread(table(spark, sf_dir, "documents"))
    streams = docs.select(F.expr("doc_id div 50").alias("part"), "doc_id", one.alias("packed"), bz2_compress(F.lit(b""), F.lit(9)).alias("none"))
    parts = F.array_sort(F.collect_list(F.struct("doc_id", F.concat(F.hex("packed"), F.hex("none")).alias("h"))))
    joined = streams.groupBy("part").agg(F.unhex(F.array_join(F.transform(parts, lambda x: x["h"]), "")).alias("packed"))
    return joined.select("part", F.decode(bz2_decompress("packed"), "UTF-8").alias("text"))


_CHUNKS = "stream_id string, seq long, chunk binary, last boolean"


#: Chunks that a streaming worker takes and gives at once: a chunk of 4096 bytes may stand for a whole block of plaintext.
BATCH_CHUNKS = 256


def few_records(spark):
    """Arrow batches of BATCH_CHUNKS rows in streaming queries started here."""
    return source.records_at_once(spark, BATCH_CHUNKS)


def pushed(spark, files: DataFrame, size: int = 4096) -> DataFrame:
    """The output of a streaming query over files (file_id, content) cut into chunks."""

    def cut(batches):
        for batch in batches:
            for name, data in parallel.one_by_one(batch):
                n = max(-(-len(data) // size), 1)
                columns = [[name] * n, range(n), [data[size * i : size * i + size] for i in range(n)], [i == n - 1 for i in range(n)]]
                kinds = (pa.string(), pa.int64(), pa.binary(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["stream_id", "seq", "chunk", "last"])

    folder = source.shared_path(spark)
    with source.records_at_once(spark, 1):
        files.select("file_id", "content").mapInArrow(cut, _CHUNKS).write.parquet(f"{folder}/in")
    with few_records(spark):
        chunks = spark.readStream.schema(_CHUNKS).parquet(f"{folder}/in")
        stream = push.decoded(chunks).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
        stream.awaitTermination()
    return spark.read.schema(push.OUTPUT).parquet(f"{folder}/out")


@query(_SOURCES)
def push_stream_chunks(spark, sf_dir):
    """Files cut into chunks of 4096 bytes and decoded by a streaming query."""
    rows = pushed(spark, source.materialized(source_files(spark, sf_dir)))
    text = F.expr("decode(unhex(array_join(transform(array_sort(collect_list(struct(seq, hex(data) AS h))), x -> x.h), '')), 'UTF-8')")
    return rows.groupBy(F.col("stream_id").alias("file_id")).agg(text.alias("text"))


@query(f"SELECT file_id, CAST(octet_length(encode(text)) AS BIGINT) AS bytes_out, CAST(0 AS BIGINT) AS buffered, CAST(NULL AS VARCHAR) AS error, true AS all_in, true AS growing FROM ({_SOURCES})")
def push_progress(spark, sf_dir):
    """Counts of streams at their end: all bytes taken, all plaintext given, nothing held; on the way they only grow."""
    files = source.materialized(source_files(spark, sf_dir))
    rows = pushed(spark, files)
    sizes = files.select("file_id", F.octet_length("content").alias("size"))
    by = Window.partitionBy("stream_id").orderBy("seq")
    grows = F.coalesce((F.lag("bytes_in").over(by) < F.col("bytes_in")) & (F.lag("bytes_out").over(by) <= F.col("bytes_out")), F.lit(True))
    growing = rows.withColumn("grows", grows).groupBy("stream_id").agg(F.bool_and("grows").alias("growing"))
    ends = push.progress(rows).join(growing, "stream_id").join(sizes, F.col("stream_id") == F.col("file_id"))
    return ends.select("file_id", "bytes_out", "buffered", "error", (F.col("bytes_in") == F.col("size")).alias("all_in"), "growing")


@query("SELECT c_custkey, s.seq, CASE WHEN s.seq > 0 THEN 'InvalidMagic' END AS error FROM customer, (VALUES (0), (1), (2), (3)) AS s(seq)")
def push_poisoned(spark, sf_dir):
    """A stream, bytes that are none, and more: the error stays, and the chunks after it give nothing."""
    packed = bz2_compress(utf8("c_name"), F.lit(9))
    parts = F.array(packed, F.lit(b"nonsense"), packed, F.lit(b""))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("stream_id"), F.posexplode(parts).alias("seq", "chunk"))
    folder = source.shared_path(spark)
    rows.select("stream_id", F.col("seq").cast("long").alias("seq"), "chunk", (F.col("seq") == 3).alias("last")).write.parquet(f"{folder}/in")
    chunks = spark.readStream.schema(_CHUNKS).parquet(f"{folder}/in")
    push.decoded(chunks).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    out = spark.read.schema(push.OUTPUT).parquet(f"{folder}/out")
    return out.select(F.col("stream_id").cast("long").alias("c_custkey"), F.col("seq").cast("int").alias("seq"), "error")


# Errors and headers

_TABLE = "[" + ", ".join(map(str, CRC_TABLE)) + "]"
_BYTES = "list_transform(range(1, CAST(length({h}) / 2 AS BIGINT) + 1), lambda i: CAST('0x' || substr({h}, 2 * i - 1, 2) AS BIGINT))"
_CRC = (
    "xor(list_reduce(list_prepend(4294967295, "
    + _BYTES
    + "), lambda c, b: xor((c * 256) & 4294967295, list_extract("
    + _TABLE
    + ", CAST(xor(c >> 24, b) + 1 AS INTEGER)))), 4294967295)"
)
_CRC_OF_NAME = _CRC.format(h="hex(encode(c_name))")

_CASES = {
    "cut": "Truncated", "magic": "InvalidMagic", "level": "InvalidLevel", "randomized": "RandomizedBlock", "block_crc": "CrcMismatch",
    "stream_crc": "CrcMismatch", "three_more": "Truncated", "four_more": "InvalidMagic", "next_level": "InvalidLevel",
    "no_symbols": "InvalidBlock", "no_selectors": "InvalidBlock", "no_tables": "InvalidHuffman", "seven_tables": "InvalidHuffman",
}


@query("SELECT c_custkey, c.kind, c.error FROM customer, (VALUES " + ", ".join(f"('{k}', '{e}')" for k, e in _CASES.items()) + ", ('whole', NULL), ('none', NULL)) AS c(kind, error)")
def error_names(spark, sf_dir):
    """Each stream damaged in several ways. Texts are short, so the first bits of origPtr are free, and hold bytes of
    six groups of sixteen (that of a run's count among them), so the number of tables is at bit 249."""
    h = F.col("h")
    other = lambda c: F.translate(c, "0123456789ABCDEF", "1032547698BADCFE")
    put = lambda at, text: F.overlay(h, text, at)
    nibble = lambda at: F.substring(h, at + 1, 1)
    keep = lambda at, bits: F.translate(nibble(at), "0123456789ABCDEF", "".join(f"{i & bits:X}" for i in range(16)))
    # the stream's checksum is the 32 bits before at most 7 bits of padding: its top bits are 38 bits from the end
    damaged = {
        "cut": F.expr("substr(h, 1, length(h) - 10)"), "magic": put(F.lit(2), F.lit("3")), "level": put(F.lit(8), F.lit("0")),
        "randomized": put(F.lit(29), F.lit("8")), "block_crc": put(F.lit(21), other(F.substring(h, 21, 1))),
        "stream_crc": put(F.length(h) - 5, other(F.expr("substr(h, length(h) - 5, 1)"))), "three_more": F.concat(h, F.lit("7A7A7A")),
        "four_more": F.concat(h, F.lit("7A7A7A7A")), "next_level": F.concat(h, F.lit("425A6830")), "whole": h, "none": F.lit(""),
        "no_symbols": put(F.lit(35), F.concat(keep(34, 8), F.lit("000"), keep(38, 7))), "no_tables": put(F.lit(63), keep(62, 8)),
        "seven_tables": put(F.lit(63), F.translate(nibble(62), "0123456789ABCDEF", "77777777FFFFFFFF")),
        "no_selectors": put(F.lit(64), F.concat(F.lit("000"), keep(66, 1))),
    }
    rows = spread(table(spark, sf_dir, "customer")).select("c_custkey", F.hex(bz2_compress(utf8(F.concat(F.lit("0000"), "c_name")), F.lit(9))).alias("h"))
    cases = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("h")) for k, v in damaged.items())))
    return rows.select("c_custkey", cases.alias("c")).select("c_custkey", "c.kind", bz2_error(F.unhex("c.h")).alias("error"))


@query("SELECT n_nationkey, 'BlockOverflow' AS error FROM nation")
def error_relabelled(spark, sf_dir):
    """A block of a level 9 stream does not fit once its header says level 1."""
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(30_000)), lambda i: F.concat("n_name", i.cast("string"))), ",")
    h = F.hex(bz2_compress(F.encode(text, "UTF-8"), F.lit(9)))
    return table(spark, sf_dir, "nation").select("n_nationkey", bz2_error(F.unhex(F.overlay(h, F.lit("1"), F.lit(8), F.lit(1)))).alias("error"))


@query("SELECT p_partkey, p_size AS level, p_size BETWEEN 1 AND 9 AS packs FROM part")
def valid_levels(spark, sf_dir):
    """Which sizes are levels: the compressor gives null for all others."""
    return spread(table(spark, sf_dir, "part")).select("p_partkey", F.col("p_size").alias("level"), bz2_compress(utf8("p_name"), F.col("p_size")).isNotNull().alias("packs"))


def bits(h: Column, bit: int, n: int) -> Column:
    """n (up to 48) bits of hex text from a bit offset, most significant first."""
    first, last = bit // 8, (bit + n + 7) // 8
    word = F.conv(F.substring(h, 2 * first + 1, 2 * (last - first)), 16, 10).cast("long")
    return F.call_function("shiftright", word, F.lit(8 * last - bit - n)).bitwiseAND((1 << n) - 1)


@query(
    "SELECT c_custkey, 54156738319193 AS magic, CAST(0 AS BIGINT) AS randomized, 9 AS level, "
    f"CAST({_CRC_OF_NAME} AS BIGINT) AS crc FROM customer"
)
def block_headers(spark, sf_dir):
    """Fields of a stream's first block, read from its bits: level, magic number, checksum, randomized bit."""
    h = F.hex(bz2_compress(utf8("c_name"), F.lit(9)))
    rows = spread(table(spark, sf_dir, "customer")).select("c_custkey", h.alias("h"))
    level = (bits(F.col("h"), 24, 8) - 48).cast("int")
    return rows.select("c_custkey", bits(F.col("h"), 32, 48).alias("magic"), bits(F.col("h"), 112, 1).alias("randomized"), level.alias("level"), bits(F.col("h"), 80, 32).alias("crc"))


# Checksums


@query(f"SELECT c_custkey, CAST({_CRC.format(h='h')} AS BIGINT) AS crc FROM (SELECT c_custkey, hex(encode(c_name)) AS h FROM customer)")
def crc32_names(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", crc32_bzip2(utf8("c_name")).alias("crc"))


@query(
    f"WITH c AS (SELECT c_nationkey, CAST({_CRC.format(h='h')} AS BIGINT) AS crc, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i, "
    "count(*) OVER (PARTITION BY c_nationkey) AS n FROM (SELECT c_nationkey, c_custkey, hex(encode(c_name)) AS h FROM customer)) "
    "SELECT c_nationkey, CAST(bit_xor(((crc << ((n - i) % 32)) & 4294967295) | (crc >> (32 - (n - i) % 32))) AS BIGINT) AS crc FROM c GROUP BY c_nationkey"
)
def combined_crc(spark, sf_dir):
    by = Window.partitionBy("c_nationkey")
    rows = table(spark, sf_dir, "customer").select(
        "c_nationkey", crc32_bzip2(utf8("c_name")).alias("crc"), (F.row_number().over(by.orderBy("c_custkey")) - 1).alias("i"), F.count("*").over(by).alias("n")
    )
    return rows.groupBy("c_nationkey").agg(bz2_combined_crc(F.col("crc"), F.col("i"), F.col("n")).alias("crc"))


# Stages. Buffers are names: one of them is a block.


def name_bytes(spark, sf_dir, name: str = "customer", key: str = "c_custkey", text: str = "c_name") -> DataFrame:
    return stages.exploded_bytes(spread(table(spark, sf_dir, name)), [key], utf8(text))


def _bytes(name: str = "customer", key: str = "c_custkey", text: str = "c_name") -> str:
    h = f"hex(encode({text}))"
    return f"SELECT {key}, p AS pos, CAST('0x' || substr(h, 2 * p + 1, 2) AS INTEGER) AS b FROM (SELECT {key}, {h} AS h, unnest(range(0, CAST(length({h}) / 2 AS BIGINT))) AS p FROM {name})"


_CUSTOMER = ("customer", "c_custkey", "c_name")


@query(f"SELECT c_custkey, b, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY c_custkey ORDER BY b) - count(*) AS BIGINT) AS start FROM ({_bytes(*_CUSTOMER)}) GROUP BY c_custkey, b")
def byte_histogram(spark, sf_dir):
    return stages.byte_histogram(name_bytes(spark, sf_dir, *_CUSTOMER), ["c_custkey"])


@query("SELECT CAST('0x' || h AS INTEGER) AS b, count(*) AS n FROM (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS h FROM documents) GROUP BY h")
def corpus_histogram(spark, sf_dir):
    """Bytes of all texts: counted in the kernel batch by batch, summed by Spark."""
    import numpy as np

    def count(batches):
        for batch in batches:
            n = np.bincount(np.frombuffer(b"".join(x or b"" for x in batch.column(0).to_pylist()), np.uint8), minlength=256)
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype("i4")), pa.array(n[used])], names=["b", "n"])

    return table(spark, sf_dir, "documents").select(utf8("text")).mapInArrow(count, "b int, n long").groupBy("b").agg(F.sum("n").alias("n"))


@query(f"SELECT c_custkey, array_to_string(list_sort(list(DISTINCT b)), ',') AS in_use FROM ({_bytes()}) GROUP BY c_custkey")
def alphabets(spark, sf_dir):
    return stages.alphabet(name_bytes(spark, sf_dir), ["c_custkey"]).select("c_custkey", F.array_join(F.col("in_use").cast("array<string>"), ",").alias("in_use"))


_RLE1 = f"""WITH x AS ({_bytes(*_CUSTOMER)}),
y AS (SELECT *, CASE WHEN lag(b) OVER w = b THEN 0 ELSE 1 END AS new FROM x WINDOW w AS (PARTITION BY c_custkey ORDER BY pos)),
z AS (SELECT *, sum(new) OVER (PARTITION BY c_custkey ORDER BY pos) AS island FROM y),
p AS (SELECT *, (row_number() OVER (PARTITION BY c_custkey, island ORDER BY pos) - 1) // 259 AS part FROM z),
g AS (SELECT c_custkey, island, part, b, count(*) AS raw_len FROM p GROUP BY ALL)
SELECT c_custkey, row_number() OVER (PARTITION BY c_custkey ORDER BY island, part) - 1 AS grp, b, raw_len FROM g"""


@query(_RLE1)
def rle1_groups(spark, sf_dir):
    return stages.rle1_groups(name_bytes(spark, sf_dir, *_CUSTOMER), ["c_custkey"]).withColumn("grp", F.col("grp").cast("long"))


@query(f"SELECT c_custkey, CAST(sum(CASE WHEN raw_len >= 4 THEN 5 ELSE raw_len END) AS BIGINT) AS enc_len FROM ({_RLE1}) GROUP BY c_custkey")
def rle1_encoded_len(spark, sf_dir):
    groups = stages.rle1_groups(name_bytes(spark, sf_dir, *_CUSTOMER), ["c_custkey"])
    return groups.groupBy("c_custkey").agg(F.sum(stages.encoded_length(F.col("raw_len"))).cast("long").alias("enc_len"))


_DOCUMENT_RLE1 = _RLE1.replace(_bytes(*_CUSTOMER), _bytes("documents", "doc_id", "text")).replace("c_custkey", "doc_id")
_ROOM = LEVEL_UNIT - BLOCK_SLACK
_PACK = f"""SELECT {_FILE} AS stream, row_number() OVER (PARTITION BY {_FILE} ORDER BY doc_id, grp) - 1 AS grp, CASE WHEN raw_len >= 4 THEN 5 ELSE raw_len END AS enc_len
    FROM ({_DOCUMENT_RLE1}) AS r JOIN documents USING (doc_id)"""


@query(
    f"""WITH RECURSIVE g AS ({_PACK}), t AS (SELECT *, CAST(sum(enc_len) OVER (PARTITION BY stream ORDER BY grp) AS BIGINT) AS upto FROM g),
    s AS (SELECT stream, CAST(0 AS BIGINT) AS block, CAST(0 AS BIGINT) AS before FROM t GROUP BY stream
          UNION ALL SELECT s.stream, s.block + 1, max(t.upto) FROM s JOIN t ON t.stream = s.stream AND t.upto > s.before AND t.upto <= s.before + {_ROOM} GROUP BY ALL)
    SELECT t.stream, s.block, count(*) AS n_groups, CAST(sum(enc_len) AS BIGINT) AS n_bytes FROM t JOIN s ON s.stream = t.stream AND t.upto > s.before AND t.upto <= s.before + {_ROOM} GROUP BY ALL"""
)
def block_packing(spark, sf_dir):
    """The runs of all documents of a file, dealt to blocks of level 1."""
    stream = F.concat_ws("/", "source", F.expr(f"doc_id div {FILE_DOCUMENTS}")).alias("stream")
    runs = stages.run_sizes(spread(table(spark, sf_dir, "documents")), [stream, F.col("doc_id")], utf8("text"))
    return stages.block_packing(runs, "stream", "doc_id", _ROOM)


_BWT = f"""WITH t AS (SELECT c_custkey, hex(encode(c_name)) AS h FROM customer),
r AS (SELECT c_custkey, p, substr(h, 2 * p + 1) || substr(h, 1, 2 * p) AS rot FROM (SELECT *, unnest(range(0, CAST(length(h) / 2 AS BIGINT))) AS p FROM t))
SELECT c_custkey, row_number() OVER (PARTITION BY c_custkey ORDER BY rot, p DESC) - 1 AS row, CAST('0x' || right(rot, 2) AS INTEGER) AS b, p = 0 AS is_origin FROM r"""


def last_columns(spark, sf_dir) -> DataFrame:
    return stages.bwt(name_bytes(spark, sf_dir), ["c_custkey"]).withColumn("row", F.col("row").cast("long"))


@query(_BWT)
def bwt_last_column(spark, sf_dir):
    return last_columns(spark, sf_dir)


@query(f'SELECT c_custkey, "row", b, row_number() OVER (PARTITION BY c_custkey ORDER BY b, "row") - 1 AS next_row FROM ({_BWT})')
def lf_mapping(spark, sf_dir):
    return stages.lf_mapping(last_columns(spark, sf_dir), ["c_custkey"]).withColumn("next_row", F.col("next_row").cast("long"))


@query("SELECT c_custkey, c_name FROM customer")
def inverse_bwt_names(spark, sf_dir):
    """The kernel walks the last columns back to the names."""
    import numpy as np

    from ..operators.decoder import inverse_bwt

    def back(batch: pa.Table) -> pa.Table:
        batch = batch.sort_by("row")
        out = inverse_bwt(batch["b"].to_numpy().astype(np.uint8), int(np.flatnonzero(batch["is_origin"].to_numpy())[0]))
        return pa.table({"c_custkey": batch["c_custkey"][:1], "c_name": [out.tobytes().decode()]})

    return last_columns(spark, sf_dir).groupBy("c_custkey").applyInArrow(back, "c_custkey long, c_name string")


@query(
    f"""WITH x AS ({_bytes()}), l AS (SELECT *, lag(pos) OVER (PARTITION BY c_custkey, b ORDER BY pos) AS prev FROM x)
    SELECT l.c_custkey, l.pos, l.b, CAST((SELECT count(DISTINCT x.b) FROM x WHERE x.c_custkey = l.c_custkey AND x.pos < l.pos AND x.pos > coalesce(l.prev, -1))
    + CASE WHEN l.prev IS NULL THEN (SELECT count(DISTINCT x.b) FROM x WHERE x.c_custkey = l.c_custkey AND x.b < l.b
      AND NOT EXISTS (SELECT 1 FROM x AS y WHERE y.c_custkey = l.c_custkey AND y.pos < l.pos AND y.b = x.b)) ELSE 0 END AS BIGINT) AS place FROM l"""
)
def mtf_indices(spark, sf_dir):
    rows = stages.move_to_front(table(spark, sf_dir, "customer"), ["c_custkey"], utf8("c_name"))
    return rows.select("c_custkey", F.col("pos").cast("long").alias("pos"), "b", F.col("place").cast("long").alias("place"))


@query("SELECT p_partkey, reverse(substr(to_binary(p_partkey + 1), strpos(to_binary(p_partkey + 1), '1') + 1)) AS digits FROM part WHERE p_partkey > 0")
def rle2_digits(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_partkey > 0").select("p_partkey", stages.zero_run_digits(F.col("p_partkey")).alias("digits"))


@query("SELECT p_partkey, p_partkey AS run FROM part WHERE p_partkey > 0")
def rle2_runs(spark, sf_dir):
    rows = table(spark, sf_dir, "part").where("p_partkey > 0").select("p_partkey", stages.zero_run_digits(F.col("p_partkey")).alias("digits"))
    return rows.select("p_partkey", stages.zero_run_length(F.col("digits")).alias("run"))


@query("SELECT doc_id, CASE WHEN n_chars < 200 THEN 2 WHEN n_chars < 600 THEN 3 WHEN n_chars < 1200 THEN 4 WHEN n_chars < 2400 THEN 5 ELSE 6 END AS tables FROM documents")
def table_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", stages.table_count(F.col("n_chars")).alias("tables"))


#: Shannon's code lengths of a text's bytes: the least n for which 2^n times the count reaches the total.
_LENGTHS = f"SELECT doc_id, b AS sym, CAST(length(to_binary((sum(count(*)) OVER (PARTITION BY doc_id) - 1)::BIGINT // count(*))) AS INTEGER) AS len FROM ({_bytes('documents', 'doc_id', 'text')}) GROUP BY doc_id, b"


def shannon_lengths(spark, sf_dir) -> DataFrame:
    counts = stages.byte_histogram(name_bytes(spark, sf_dir, "documents", "doc_id", "text"), ["doc_id"])
    total = F.sum("n").over(Window.partitionBy("doc_id"))
    return counts.withColumn("total", total).select("doc_id", F.col("b").alias("sym"), F.length(F.bin(F.expr("(total - 1) div n"))).alias("len"))


@query(f"SELECT doc_id, sym, len, CAST(sum(1 << (20 - len)) OVER (PARTITION BY doc_id ORDER BY len, sym) - (1 << (20 - len)) AS BIGINT) >> (20 - len) AS code FROM ({_LENGTHS})")
def canonical_codes(spark, sf_dir):
    """Codes of the bytes of each document."""
    return stages.canonical_codes(shannon_lengths(spark, sf_dir), ["doc_id"])


@query(
    f"SELECT doc_id, sym, repeat(CASE WHEN d > 0 THEN '10' ELSE '11' END, abs(d)) || '0' AS bits FROM (SELECT *, len - coalesce(lag(len) OVER (PARTITION BY doc_id ORDER BY sym), len) AS d FROM ({_LENGTHS}))"
)
def length_deltas(spark, sf_dir):
    return stages.length_deltas(shannon_lengths(spark, sf_dir), ["doc_id"])


@query(f"SELECT doc_id, sym, len, CAST(sum(len) OVER (PARTITION BY doc_id ORDER BY sym) - len AS BIGINT) AS bit FROM ({_LENGTHS})")
def bit_offsets(spark, sf_dir):
    """Where each code would begin if those of a table were written one after the other."""
    return stages.bit_offsets(shannon_lengths(spark, sf_dir).withColumnRenamed("sym", "pos"), ["doc_id"]).withColumnRenamed("pos", "sym")


def own_and_flat(counts):
    """Code lengths of two tables from the counts of bytes: Shannon's (see _LENGTHS), and eight bits each."""
    import numpy as np

    ratio = (counts.sum() - 1) // np.maximum(counts, 1)
    return [np.maximum(np.frexp(ratio)[1], 1), np.full(256, 8)]


_CHOICES = f"""WITH k AS (SELECT x.doc_id, pos // 50 AS grp, CAST(sum(len) AS BIGINT) AS own, 8 * count(*) AS flat FROM ({_bytes("documents", "doc_id", "text")}) AS x JOIN ({_LENGTHS}) AS l ON l.doc_id = x.doc_id AND l.sym = x.b GROUP BY ALL)
    SELECT doc_id, grp, CASE WHEN own <= flat THEN 0 ELSE 1 END AS tbl, least(own, flat) AS cost FROM k"""


@query(_CHOICES)
def selector_argmin(spark, sf_dir):
    """For each fifty bytes of a document, the cheaper of two tables: 0 has the document's own lengths, 1 eight bits each."""
    return stages.cheapest_tables(table(spark, sf_dir, "documents"), ["doc_id"], utf8("text"), own_and_flat)


@query(
    f"""SELECT doc_id, string_agg(CASE WHEN tbl <> before THEN '10' ELSE '0' END, '' ORDER BY grp) AS bits
    FROM (SELECT *, coalesce(lag(tbl) OVER (PARTITION BY doc_id ORDER BY grp), 0) AS before FROM ({_CHOICES})) GROUP BY doc_id"""
)
def selector_bits(spark, sf_dir):
    """A document's selectors as they are written: moved to front, in unary."""
    return stages.selector_bits(table(spark, sf_dir, "documents"), ["doc_id"], utf8("text"), own_and_flat)


_MAP = f"SELECT c_custkey, b // 16 AS high, CAST(bit_or(1 << (15 - b % 16)) AS INTEGER) AS word FROM (SELECT DISTINCT c_custkey, b FROM ({_bytes()})) GROUP BY ALL"


@query(_MAP)
def symbol_map(spark, sf_dir):
    rows = stages.symbol_map(name_bytes(spark, sf_dir), ["c_custkey"])
    return rows.withColumn("high", F.col("high").cast("int"))


@query(f"SELECT DISTINCT c_custkey, b FROM ({_bytes()})")
def symbol_map_read(spark, sf_dir):
    rows = stages.symbols_in_map(stages.symbol_map(name_bytes(spark, sf_dir), ["c_custkey"]), ["c_custkey"])
    return rows.withColumn("b", F.col("b").cast("int"))
