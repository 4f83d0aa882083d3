"""The stages of the codec as relational operators.

Rows of bytes are (key, pos, b): `key` names a buffer (any number of columns), `pos` counts from 0. Most are
windows and aggregates over `key`; a buffer is a block, so no window holds more than a block. Where rows of bytes would
have to meet each other or their tables, the kernel takes whole buffers instead (`by_buffer`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .encoder import MAX_RUN, TABLE_STEPS

#: Rows that a kernel gathers before it gives them out as a batch, and bytes of a buffer that stand for one at least.
ROWS_OUT, BYTES_A_ROW = 50_000, 50


def exploded_bytes(df: DataFrame, key: list[str], data: Column) -> DataFrame:
    """(key, pos, b) of a binary column."""
    pairs = F.regexp_extract_all(F.hex(data), F.lit(".."), F.lit(0))
    return df.select(*key, F.posexplode(pairs).alias("pos", "h")).select(*key, "pos", F.conv("h", 16, 10).cast("int").alias("b"))


def byte_histogram(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, b, n, start): how often each byte occurs, and how many lower bytes there are."""
    counts = rows.groupBy(*key, "b").agg(F.count("*").alias("n"))
    return counts.withColumn("start", F.sum("n").over(Window.partitionBy(*key).orderBy("b")) - F.col("n"))


def alphabet(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, in_use): the bytes that occur, ascending."""
    return rows.groupBy(*key).agg(F.array_sort(F.collect_set("b")).alias("in_use"))


def rle1_groups(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, grp, b, raw_len): runs of equal bytes, none longer than MAX_RUN, numbered from 0."""
    by = Window.partitionBy(*key).orderBy("pos")
    begun = rows.withColumn("island", F.sum((F.coalesce(F.lag("b").over(by) != F.col("b"), F.lit(True))).cast("int")).over(by))
    within = F.row_number().over(Window.partitionBy(*key, "island").orderBy("pos")) - 1
    pieces = begun.withColumn("part", F.floor(within / MAX_RUN)).groupBy(*key, "island", "part", "b").agg(F.count("*").alias("raw_len"))
    number = F.row_number().over(Window.partitionBy(*key).orderBy("island", "part")) - 1
    return pieces.select(*key, number.alias("grp"), "b", "raw_len")


def encoded_length(raw_len: Column) -> Column:
    """Bytes that a run takes after the first run-length step."""
    return F.when(raw_len >= 4, 5).otherwise(raw_len)


def bwt(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, row, b, is_origin): the last column of the sorted rotations, of equal ones the later start first. For
    short buffers: rotations are written out."""
    text = rows.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "b"))), lambda x: F.lpad(F.hex(x["b"]), 2, "0")), "").alias("h"), F.count("*").alias("n"))
    turned = text.select(*key, "n", "h", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("pos"))
    turned = turned.withColumn("rotation", F.concat(F.expr("substr(h, 2 * pos + 1)"), F.expr("substr(h, 1, 2 * pos)")))
    row = F.row_number().over(Window.partitionBy(*key).orderBy("rotation", F.desc("pos"))) - 1
    return turned.select(*key, row.alias("row"), F.conv(F.expr("right(rotation, 2)"), 16, 10).cast("int").alias("b"), (F.col("pos") == 0).alias("is_origin"))


def lf_mapping(column: DataFrame, key: list[str], at: str = "row") -> DataFrame:
    """(key, row, b, next_row): the row that the inverse transform goes to after each row of the last column."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy("b", at)) - 1
    return column.select(*key, at, "b", place.alias("next_row"))


def by_buffer(docs: DataFrame, key: list[str], data: Column, fields: str, make) -> DataFrame:
    """(key, fields): the rows that `make` gives, as arrays of its columns, for each buffer: for the list of the binary
    values that share a key. Values with a null in the key share it with none. Buffers are dealt out by their keys whole,
    so a task holds a batch of values and one buffer, and bytes are no rows before `make` has them."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(*key, data.alias("_data")).where("octet_length(_data) > 0")
    absent = F.greatest(*(F.col(k).isNull() for k in key), F.lit(False))
    dealt = rows.repartition(n, *key, F.when(absent, F.monotonically_increasing_id())).sortWithinPartitions(*key)
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in key)
    schema = f"{kinds}, {fields}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def batch_of(keys, made):
        nth = np.repeat(np.arange(len(keys)), [len(m[0]) for m in made])
        columns = [pa.array(c, f.type).take(pa.array(nth)) for c, f in zip(zip(*keys, strict=True), arrow, strict=False)]
        values = [pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*made, strict=True), list(arrow)[len(key) :], strict=True)]
        return pa.RecordBatch.from_arrays([*columns, *values], names=arrow.names)

    def run(batches):
        last, parts, keys, made, held = None, [], [], [], 0
        for batch in batches:
            for *own, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if parts and (own != last or None in own):
                    keys.append(last)
                    made.append(make(last, parts))
                    held, parts = held + max(len(made[-1][0]), sum(map(len, parts)) // BYTES_A_ROW), []
                last = own
                parts.append(value)
                if held >= ROWS_OUT:
                    yield batch_of(keys, made)
                    keys, made, held = [], [], 0
        if parts:
            keys.append(last)
            made.append(make(last, parts))
            yield batch_of(keys, made)

    return dealt.mapInArrow(run, schema)


def move_to_front(docs: DataFrame, key: list[str], data: Column) -> DataFrame:
    """(key, pos, b, place) of the bytes of a binary column: how many different bytes came since the last one like it; at
    a first occurrence, how many came before at all, and how many lower ones have yet to come. By the kernel, which folds
    a buffer in its order. A null in the key makes no buffer: such bytes have no others before them, their place is 0."""
    from .encoder import places

    def make(own, parts):
        pos, b, place = places(parts)
        return pos, b, place * (None not in own)

    return by_buffer(docs, key, data, "pos int, b int, place int", make)


def zero_run_digits(n: Column) -> Column:
    """Digits of a run of n zeros, least first, RUNA as 0 and RUNB as 1: the bits of n + 1 below the highest."""
    return F.reverse(F.substring(F.bin(n + 1), 2, 64))


def zero_run_length(digits: Column) -> Column:
    """The run that a string of digits stands for."""
    return F.aggregate(
        F.sequence(F.lit(1), F.length(digits)), F.lit(0).cast("long"), lambda a, i: a + (F.substr(digits, i, F.lit(1)).cast("long") + 1) * F.call_function("shiftleft", F.lit(1).cast("long"), (i - 1).cast("int"))
    )


def table_count(n_symbols: Column) -> Column:
    """How many code tables a block of so many symbols gets, 2 to 6."""
    return F.lit(2) + sum(((n_symbols >= step).cast("int") for step in TABLE_STEPS[1:]), (n_symbols >= TABLE_STEPS[0]).cast("int"))


def canonical_codes(lengths: DataFrame, key: list[str], longest: int = 20) -> DataFrame:
    """(key, sym, len, code): codes in the order of (len, sym), from the running sum of the shares that shorter
    codes take of all numbers of `longest` bits."""
    share = F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(longest) - F.col("len")).cast("int"))
    before = F.sum(share).over(Window.partitionBy(*key).orderBy("len", "sym")) - share
    code = F.call_function("shiftright", before, (F.lit(longest) - F.col("len")).cast("int"))
    return lengths.select(*key, "sym", "len", code.alias("code"))


def choices(parts: list[bytes], tables, group: int):
    """(tbl, cost) of each group of a buffer's bytes: the table that codes it in the fewest bits, the first of equals."""
    import numpy as np

    values = [np.frombuffer(p, np.uint8) for p in parts]
    bits = np.asarray(tables(sum(np.bincount(x, minlength=256) for x in values)), np.int64)
    cost = np.zeros((len(bits), -(-max(map(len, values)) // group)), np.int64)
    for x in values:
        starts = np.arange(0, len(x), group)
        cost[:, : len(starts)] += [np.add.reduceat(row[x], starts) for row in bits]
    return cost.argmin(0), cost.min(0)


def cheapest_tables(docs: DataFrame, key: list[str], data: Column, tables, group: int = 50) -> DataFrame:
    """(key, grp, tbl, cost): for each group of a buffer's bytes the table that codes it in the fewest bits, the first of
    equals. `tables` gives the code lengths of all tables (a row of 256 each) from the buffer's counts of bytes. By the
    kernel: symbols and tables meet in memory, a buffer at a time. Values with a null in the key belong to no table."""
    import numpy as np

    def make(own, parts):
        tbl, cost = choices(parts, tables, group)
        return np.arange(len(tbl)), tbl, cost

    return by_buffer(docs.dropna(subset=key), key, data, "grp long, tbl int, cost long", make)


def selector_bits(docs: DataFrame, key: list[str], data: Column, tables, group: int = 50) -> DataFrame:
    """(key, bits): the cheapest tables of a buffer's groups (see `cheapest_tables`) as they are written: each one's place
    in the list of the most recent ones, in unary. By the kernel too: selectors are no rows, and are dealt out no more."""
    import numpy as np

    from .encoder import recency

    def make(own, parts):
        tbl, _ = choices(parts, tables, group)
        place = recency(tbl, int(tbl.max()) + 1)
        bits = np.full(int(place.sum()) + len(place), ord("1"), np.uint8)
        bits[np.cumsum(place + 1) - 1] = ord("0")
        return (np.array([bits.tobytes().decode()], object),)

    return by_buffer(docs.dropna(subset=key), key, data, "bits string", make)


def length_deltas(lengths: DataFrame, key: list[str]) -> DataFrame:
    """(key, sym, bits): steps from the length before (from itself, for the first), then a stop."""
    step = F.col("len") - F.coalesce(F.lag("len").over(Window.partitionBy(*key).orderBy("sym")), F.col("len"))
    return lengths.select(*key, "sym", F.concat(F.repeat(F.when(step > 0, "10").otherwise("11"), F.abs(step)), F.lit("0")).alias("bits"))


def symbol_map(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, high, word): for each group of sixteen byte values that occur, the word of those that do."""
    bit = F.call_function("shiftleft", F.lit(1), 15 - F.col("b") % 16)
    return rows.select(*key, "b").distinct().groupBy(*key, F.expr("b div 16").alias("high")).agg(F.bit_or(bit).alias("word"))


def symbols_in_map(words: DataFrame, key: list[str]) -> DataFrame:
    """(key, b): the byte values of a symbol map."""
    low = F.filter(F.sequence(F.lit(0), F.lit(15)), lambda i: F.col("word").bitwiseAND(F.call_function("shiftleft", F.lit(1), 15 - i)) > 0)
    return words.select(*key, "high", F.explode(low).alias("low")).select(*key, (16 * F.col("high") + F.col("low")).alias("b"))


def bit_offsets(codes: DataFrame, key: list[str]) -> DataFrame:
    """rows of (key, pos, len) with the bit at which each value begins when they are joined."""
    return codes.withColumn("bit", F.sum("len").over(Window.partitionBy(*key).orderBy("pos")) - F.col("len"))


def run_sizes(docs: DataFrame, keep: list[Column], data: Column) -> DataFrame:
    """The columns `keep` and `sizes`: the encoded lengths of the runs of a binary column, by the kernel."""
    import pyarrow as pa

    from .encoder import packed_size, runs

    n = len(keep)

    def run(batches):
        for batch in batches:
            sizes = [packed_size(runs(x or b"")[1]).astype("i1") for x in batch.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(sizes, pa.list_(pa.int8()))], names=[*batch.schema.names[:n], "sizes"])

    rows = docs.select(*keep, data.alias("_data"))
    return rows.mapInArrow(run, rows.select(*rows.columns[:n], F.lit(None).cast("array<tinyint>").alias("sizes")).schema)


def block_packing(rows: DataFrame, key: str, order: str, limit: int) -> DataFrame:
    """(key, block, n_groups, n_bytes): the runs of rows (key, order, sizes), in that order, dealt greedily to blocks of at
    most `limit` bytes, none split.

    What a block leaves over carries into the next, so a plain running sum won't do. Only run lengths are folded,
    one stream to a task, with a search for the end of each block.
    """
    import numpy as np
    import pyarrow as pa

    from .encoder import packing

    def fold(batch: pa.Table) -> pa.Table:
        sizes = batch.sort_by(order)["sizes"].combine_chunks().flatten().to_numpy().astype(np.int64)
        block = packing(sizes, limit)
        n = np.bincount(block)
        return pa.table({key: [batch[key][0].as_py()] * len(n), "block": np.arange(len(n)), "n_groups": n, "n_bytes": np.bincount(block, sizes).astype(np.int64)})

    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInArrow(fold, f"{key} {kind}, block long, n_groups long, n_bytes long")
