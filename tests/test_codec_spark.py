"""Codec sources, sinks, plans and queries in Spark."""

import bz2
import io
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from blockloom.functions import tables
from blockloom.functions.checksum import bz2_combined_crc, crc32_bzip2
from blockloom.functions.kernels import bz2_compress, bz2_decompress, bz2_error
from blockloom.operators.format import combined, crc
from blockloom.plans import catalogue, parallel
from blockloom.sources import bz2 as source
from blockloom.streaming import push

SF = "/root/testdata/sf0.001"


def test_scalar_functions(spark):
    rows = spark.createDataFrame([(b"abc", 1), (b"", 9), (None, 5), (b"x", 10)], "data binary, level int")
    got = rows.select(bz2_decompress(bz2_compress("data", "level")).alias("d"), bz2_error("data").alias("e")).collect()
    assert [r.d if r.d is None else bytes(r.d) for r in got] == [b"abc", b"", None, None]
    assert [r.e for r in got] == ["Truncated", None, None, "Truncated"]


def test_checksums(spark):
    data = [b"", b"123456789", bytes(range(256)) * 5, b"\x80"]
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(data)], "i long, d binary").withColumn("crc", crc32_bzip2("d"))
    assert [r.crc for r in rows.orderBy("i").collect()] == [crc(d) for d in data]
    many = [random.Random(i).getrandbits(32) for i in range(70)]
    rows = spark.createDataFrame(list(enumerate(many)), "i long, crc long")
    assert rows.agg(bz2_combined_crc(F.col("crc"), F.col("i"), F.lit(len(many)))).first()[0] == combined(many)


def streams():
    r = random.Random(9)
    noise = r.randbytes(350_000)
    good = bz2.compress(noise, 1) + bz2.compress(b"") + bz2.compress(b"tail " * 50_000, 2)
    relabelled = bytearray(bz2.compress(noise, 9))
    relabelled[3] = ord("1")
    flipped = bytearray(good)
    flipped[len(flipped) // 4] ^= 16
    return {
        "good": (good, noise + b"tail " * 50_000, None), "empty": (b"", b"", None), "cut": (good[:-4], noise + b"tail " * 50_000, "Truncated"),
        "junk": (good + b"junk", noise + b"tail " * 50_000, "InvalidMagic"), "relabelled": (bytes(relabelled), b"", "BlockOverflow"), "flipped": (bytes(flipped), None, "?"),
    }


def test_parallel_equals_serial(spark):
    cases = streams()
    files = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "file_id string, content binary")
    for n in (1, 5):
        got = {r.file_id: r for r in parallel.joined_text(parallel.decode(files, n)).collect()}
        for name, (_, plain, error) in cases.items():
            if name == "empty":
                assert name not in got
            elif name == "flipped":
                assert got[name].error and not got[name].fast
            else:
                assert bytes(got[name].out or b"") == plain and got[name].error == error
        assert got["good"].fast and got["good"].n_blocks == 6


def test_paths_in_ranges_equal_rows(spark, tmp_path):
    cases = streams()
    for name, (data, *_) in cases.items():
        (tmp_path / f"{name}.bz2").write_bytes(data)
    for step in (30_000, 200_000, 1 << 20):
        blocks = parallel.decode_paths(spark, [str(tmp_path)], step)
        got = {r.file_id.split("/")[-1][:-4]: r for r in parallel.joined_text(blocks).collect()}
        for name, (_, plain, error) in cases.items():
            if name == "empty":
                assert name not in got
            elif name == "flipped":
                assert got[name].error and not got[name].fast
            else:
                assert bytes(got[name].out or b"") == plain and got[name].error == error
        assert got["good"].fast and got["good"].n_blocks == 6
    # what the chain gave before it broke is not decoded again
    by = {r.fast: r["count"] for r in blocks.where("file_id like '%/cut.bz2'").groupBy("fast").count().collect()}
    assert by == {True: 6, False: 1}


def test_flood_goes_to_the_strict_walk(spark, monkeypatch):
    """With more hits than the guard allows, no candidate is decoded."""
    monkeypatch.setattr(parallel, "FEW", 1)
    monkeypatch.setattr(parallel, "BYTES_PER_CANDIDATE", 1 << 30)
    data = streams()["good"][0]
    assert [r["start_bit"] for r in parallel.scanned(io.BytesIO(data), 0, len(data), len(data))] == [-1]
    row = {"start_bit": -1, "end_bit": 8 * len(data), "head": data[:4], "good": True}
    assert parallel.chain([row]) == ([], {"bit": 32, "level": 1, "checksum": 0})


def test_planted_magic_is_merged(spark):
    """A block whose bits hold a magic number is decoded by the fallback."""
    from blockloom.operators import decoder, encoder
    from blockloom.operators.format import BLOCK_MAGIC

    w = encoder.BitWriter()
    w.put(BLOCK_MAGIC, 48)
    w.put(crc(b"A"), 32)
    w.put(0, 25)
    w.put(0x0800, 16)
    w.put(0x4000, 16)
    w.put(2, 3)
    # selectors: all the first table but for what spells a magic number; 1 bits are moves by one
    bits = [0, 0, 0, *(BLOCK_MAGIC >> 47 - i & 1 for i in range(48)), 0]
    text = "".join(map(str, bits)).replace("11", "10")
    selectors = text.count("0")
    w.put(selectors, 15)
    for b in text:
        w.put(int(b), 1)
    for _ in range(2):
        w.put(2, 5)
        w.put(0, 3)
    w.put(0, 2)
    w.put(2, 2)
    data = encoder.stream([(crc(b"A"), w.bits())], 9)
    assert decoder.strict(data) == b"A"
    files = spark.createDataFrame([("f", data)], "file_id string, content binary")
    assert bytes(parallel.joined_text(parallel.decode(files)).first().out) == b"A"


@pytest.mark.parametrize("level", [1, 9])
def test_data_source(spark, tmp_path, level):
    source.register(spark)
    lines = [f"line {i}" for i in range(5000)]
    df = spark.createDataFrame([(x,) for x in lines], "value string").repartition(3)
    df.write.format("bz2").option("level", level).mode("overwrite").save(str(tmp_path))
    got = spark.read.format("bz2").option("lines", "true").load(str(tmp_path))
    assert sorted(r.value for r in got.collect()) == sorted(lines)
    assert sorted(r.value for r in spark.read.text(str(tmp_path)).collect()) == sorted(lines)
    df.limit(10).write.format("bz2").mode("overwrite").save(str(tmp_path))
    assert spark.read.format("bz2").load(str(tmp_path)).count() <= 3
    big = [f"{i}: {random.Random(i).random()}" for i in range(40_000)]
    spark.createDataFrame([(x,) for x in big], "value string").coalesce(1).write.format("bz2").option("level", level).mode("overwrite").save(str(tmp_path))
    split = spark.read.format("bz2").option("lines", "true").option("rangeBytes", 50_000).load(str(tmp_path))
    assert split.rdd.getNumPartitions() > 4
    assert [r.value for r in split.orderBy("start_bit", "line").collect()] == big
    blocks = spark.read.format("bz2").option("rangeBytes", 50_000).load(str(tmp_path)).orderBy("start_bit").collect()
    assert b"".join(bytes(r.data) for r in blocks) == "".join(f"{x}\n" for x in big).encode()
    with pytest.raises(Exception, match="level"):
        df.write.format("bz2").option("level", 10).mode("append").save(str(tmp_path))


def test_push_query_out_of_order(spark, tmp_path):
    packed = bz2.compress(b"streamed " * 30_000, 1)
    chunks = [packed[i : i + 500] for i in range(0, len(packed), 500)]
    rows = [("a", i, c, i == len(chunks) - 1) for i, c in enumerate(chunks)] + [("bad", 0, b"nonsense", True)]
    random.Random(1).shuffle(rows)
    schema = "stream_id string, seq long, chunk binary, last boolean"
    for k in range(3):  # three files, a batch each
        spark.createDataFrame(rows[k::3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = push.decoded(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    got = spark.read.schema(push.OUTPUT).parquet(str(tmp_path / "out")).orderBy("stream_id", "seq").collect()
    assert b"".join(bytes(r.data) for r in got if r.stream_id == "a") == b"streamed " * 30_000
    assert [r.error for r in got if r.stream_id == "bad"] == ["InvalidMagic"]
    last = [r for r in got if r.stream_id == "a"][-1]
    assert (last.bytes_in, last.bytes_out, last.buffered) == (len(packed), 270_000, 0)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_queries_match_duckdb(spark, name):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    for t in ("nation", "customer", "orders", "lineitem", "part", "documents", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")

    def rows(df):
        plain = lambda v: "null" if pd.isna(v) else v if isinstance(v, str) else str(int(v))
        return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))

    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), con.sql(catalogue.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_move_to_front_equals_sql_on_odd_keys(spark, tmp_path):
    """Repeated and null keys, null and empty names; no join, so nothing of the byte rows is broadcast."""
    import duckdb

    rows = [(1, "abacus"), (2, ""), (3, None), (4, "zzz"), (5, "banana"), (5, "bandana"), (5, "ban"), (6, "äpfel"), (None, "null"), (None, "none"), (7, "q" * 40 + "a")]
    spark.createDataFrame(rows, "c_custkey long, c_name string").repartition(3).write.parquet(str(tmp_path / "customer.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{tmp_path}/customer.parquet/*.parquet')")
    df = catalogue.QUERIES["mtf_indices"](spark, str(tmp_path))
    order = lambda found: sorted(map(tuple, found), key=str)
    assert order(df.select("c_custkey", "pos", "b", "place").collect()) == order(con.sql(f"SELECT c_custkey, pos, b, place FROM ({catalogue.ORACLE['mtf_indices']})").fetchall())
    assert "Join" not in df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["selector_argmin", "selector_bits"])
def test_selectors_equal_sql_on_odd_keys(spark, tmp_path, name):
    """Repeated and null keys, null and empty texts, one symbol alone; byte rows and tables meet in no join."""
    import duckdb

    r = random.Random(3)
    noise = ["".join(chr(r.choice((r.randrange(32, 127), 97, 98))) for _ in range(n)) for n in (49, 50, 51, 400, 3000)]
    rows = [*enumerate(noise), (9, ""), (10, None), (11, "a"), (12, "b" * 120), (13, noise[3]), (13, noise[4][:777]), (13, "c" * 60), (None, "null"), (14, "é" * 55)]
    docs = [(i, x, "s", len(x or "")) for i, x in rows]
    spark.createDataFrame(docs, "doc_id long, text string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    df = catalogue.QUERIES[name](spark, str(tmp_path))
    columns = ", ".join(df.columns)
    assert sorted(map(tuple, df.collect())) == sorted(con.sql(f"SELECT {columns} FROM ({catalogue.ORACLE[name]})").fetchall())
    assert "Join" not in df._jdf.queryExecution().toString()


def test_selectors_are_dealt_out_once(spark):
    """Texts are shuffled by their keys; selectors are made bits where they are found, with no rows of them to sort or gather."""
    plan = catalogue.QUERIES["selector_bits"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan and "Aggregate" not in plan


def test_tasks_that_share_a_file_do_not_take_all_files(spark):
    """However few tasks share a file, files are dealt to the session's; ranges tile each file."""
    files = spark.createDataFrame([(f"f{i}", bytes(10 + i)) for i in range(40)] + [("none", None), ("empty", b"")], "file_id string, content binary")
    for n in (1, 3):
        rows = parallel.shared_out(files, n).withColumn("task", F.spark_partition_id()).collect()
        assert len({r.task for r in rows}) == int(spark.conf.get("spark.sql.shuffle.partitions"))
        for i in range(40):
            own = sorted((r.lo, r.hi) for r in rows if r.file_id == f"f{i}")
            assert len(own) == n and own[0][0] == 0 and own[-1][1] == 10 + i and all(a[1] == b[0] for a, b in zip(own, own[1:]))
        assert {r.file_id for r in rows} >= {"none", "empty"}


def test_streaming_batches_are_small_and_settings_stay(spark):
    """Streaming workers take few chunks at a time; the session's own setting comes back, after an error, too."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with pytest.raises(KeyError), catalogue.few_records(spark):
        assert int(spark.conf.get(name)) == catalogue.BATCH_CHUNKS < int(before)
        raise KeyError
    assert spark.conf.get(name) == before


def test_files_are_packed_one_at_a_time(spark):
    """No row holds the documents of many files as one batch of texts: each group is packed by itself."""
    plan = catalogue.source_files(spark, SF)._jdf.queryExecution().toString()
    assert "FlatMapGroupsInArrow" in plan and "collect_list" not in plan and "ArrowEvalPython" not in plan


def test_workers_are_given_one_file_at_a_time(spark, monkeypatch):
    """Kernels over whole files run with batches of one row, however many files a task has; the setting comes back."""
    name, seen, write = "spark.sql.execution.arrow.maxRecordsPerBatch", [], source.materialized
    before = spark.conf.get(name)
    monkeypatch.setattr(source, "materialized", lambda df: seen.append(spark.conf.get(name)) or write(df))
    files = spark.createDataFrame([(f"f{i}", bz2.compress(b"text %d" % i) + b"zzzz" * (i % 2)) for i in range(40)], "file_id string, content binary")
    assert parallel.decode(files).where("error = 'InvalidMagic'").count() == 20
    assert tables.bz2_candidates(files).count() == 80
    assert seen == ["1", "1", "1"] and spark.conf.get(name) == before

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]}, pa.schema([("n", pa.int64())]))

    with source.records_at_once(spark, 1):
        assert {r.n for r in files.mapInArrow(sizes, "n long").collect()} == {1}
