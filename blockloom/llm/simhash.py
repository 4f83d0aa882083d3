"""SimHash near-duplicates by multi-index hashing.

Fingerprints have 64 bits and link at three or fewer differing bits. Cut in two segments of 32 bits, two linked
fingerprints differ by one bit at most in one segment. So a fingerprint enters the table of each segment under
its own value, and looks up the Hamming ball of radius one: the values with one of its 0 bits set (the other
half of the ball is covered by the partner's look-up). Rows that meet under a key are verified over all 64 bits.

Only distinct fingerprints take part. Under a key, at most a spanning forest of the links is reported, so a
group of thousands of near copies gives as many links, not their square. A key under which many fingerprints meet,
be it their own value or one of their ball, is dealt out once more by the 16-bit quarters of the other segment, again
with balls of radius one; what then still meets has 48 bits in common but for two.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, partitions, raw_texts, saved, sliced
from .components import components

BITS = 3
SEED = 42
SEGMENT = 32
#: Rows under one key from which the key is dealt out once more.
HOT_KEY = 4_096
#: Groups up to this size are compared pair by pair at once.
SMALL = 16
SHINGLES_AT_ONCE = 1 << 16


def shingle_hashes(text: bytes, words: int = 3, seed: int = SEED) -> np.ndarray:
    """XXH64 of the space-joined shingles of the text's words, A-Z lower-cased; of the whole if it has fewer
    words than a shingle, and none if it has no word. bytes.split() cuts at space and \\t to \\r alone."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), seed)], np.uint64)
    joined = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))
    return np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in joined), np.uint64, len(found) - words + 1)


def simhash(hashes: np.ndarray) -> int:
    """64 bits as a signed number: 1 where over half of the hashes have 1."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), SHINGLES_AT_ONCE):
        part = hashes[i : i + SHINGLES_AT_ONCE]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, keep: list[Column], text_col: str = "text") -> DataFrame:
    """The columns `keep` and `fp` of every document."""
    n = len(keep)

    def run(batches):
        for batch in sliced(batches, n):
            fps = [simhash(shingle_hashes(t)) for t in raw_texts(batch.column(n))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(fps, pa.int64())], names=[*batch.schema.names[:n], "fp"])

    rows = docs.select(*keep, F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, rows.select(*rows.columns[:n], F.lit(0).cast("long").alias("fp")).schema)


def ball(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, value): each value itself, and with each of its 0 bits set."""
    masks = np.array([0, *(1 << b for b in range(bits))], np.int64)
    free = (values[:, None] & masks) == 0
    row, mask = np.nonzero(free)
    return row, values[row] | masks[mask]


def _keys(batches):
    """(key, fp) of each fingerprint: the segment's number above its 32 bits."""
    for batch in batches:
        fp = batch.column(0).to_numpy()
        for segment in (0, 1):
            for at in range(0, len(fp), 50_000):
                own = fp[at : at + 50_000]
                row, value = ball(own >> 32 * segment & 0xFFFFFFFF, SEGMENT)
                yield pa.RecordBatch.from_arrays([pa.array(value | segment << 32), pa.array(own[row]), pa.nulls(len(row), pa.int64())], names=["key", "fp", "sub"])


def _subkeys(batches):
    """Rows of hot keys, dealt out by the quarters of the other segment."""
    for batch in batches:
        keys, fps = (batch.column(i).to_numpy() for i in (0, 1))
        other = np.where(keys >> 32 == 0, fps >> 32, fps) & 0xFFFFFFFF
        for quarter in (0, 1):
            row, value = ball(other >> 16 * quarter & 0xFFFF, 16)
            yield pa.RecordBatch.from_arrays([pa.array(keys[row]), pa.array(fps[row]), pa.array(value | quarter << 16)], names=["key", "fp", "sub"])


def _ball_keys(batches):
    """Each key, and those that a fingerprint with that value in the key's segment enters besides."""
    for batch in batches:
        keys = batch.column(0).to_numpy()
        row, value = ball(keys & 0xFFFFFFFF, SEGMENT)
        yield pa.RecordBatch.from_arrays([pa.array(value | (keys[row] >> 32 << 32))], names=["key"])


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= BITS


def forest(fps: np.ndarray) -> list[np.ndarray]:
    """Links (2 rows) that join what is linked among distinct fingerprints, fewer than there are fingerprints."""
    rest, out = fps, []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            seed = queue.pop()
            hit = near(rest, seed)
            if hit.any():
                got, rest = rest[hit], rest[~hit]
                out.append(np.stack([got, np.full(len(got), seed)]))
                queue += got.tolist()
    return out


def links_of(keys: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """Links among the rows of each run of equal keys, as an array of two rows."""
    starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
    sizes = np.diff(starts, append=len(keys))
    out = []
    small = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
    group = np.repeat(np.arange(len(starts)), sizes)[small]
    own = fps[small]
    for d in range(1, SMALL):
        if len(own) <= d:
            break
        hit = (group[d:] == group[:-d]) & near(own[d:], own[:-d])
        out.append(np.stack([own[d:][hit], own[:-d][hit]]))
    for i in np.flatnonzero(sizes > SMALL):
        out += forest(np.unique(fps[starts[i] : starts[i] + sizes[i]]))
    return np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)


def _verified(batches):
    """Links among rows that are sorted by key and sub; a run may go on in the next batch."""

    def linked(keys, fps):
        u = links_of(keys, fps)
        u = np.unique(np.stack([u.max(0), u.min(0)]), axis=1)
        u = u[:, u[0] != u[1]]
        return pa.RecordBatch.from_arrays([pa.array(u[0]), pa.array(u[1])], names=["u", "v"])

    keys, fps, size = [], [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(0).to_numpy(), batch.column(2).fill_null(-1).to_numpy()], axis=1)
        f = batch.column(1).to_numpy()
        # up to the start of the last run, all runs are whole
        turn = np.flatnonzero((k[1:] != k[:-1]).any(1))
        cut = turn[-1] + 1 if len(turn) else 0
        if cut or keys and (keys[-1][-1] != k[0]).any():
            yield linked(np.concatenate([*keys, k[:cut]]), np.concatenate([*fps, f[:cut]]))
            keys, fps = [], []
        keys.append(k[cut:])
        fps.append(f[cut:])
    if keys:
        yield linked(np.concatenate(keys), np.concatenate(fps))


def dealt(distinct: DataFrame) -> DataFrame:
    """(key, fp, sub): all fingerprints under all their keys, those of hot keys by the other segment, too."""
    rows = distinct.select("fp").mapInArrow(_keys, "key long, fp long, sub long")
    own = distinct.select(F.explode(F.array(F.col("fp").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("fp", 32).bitwiseOR(1 << 32))).alias("key"))
    # of the values that enter a hot key, itself and those one bit short of it, one at least has its share
    heavy = saved(own.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT_KEY // (SEGMENT + 1)).select("key"))
    if not heavy.count():
        return rows
    near_heavy = saved(heavy.mapInArrow(_ball_keys, "key long").distinct())
    counts = rows.select("key").join(held(near_heavy), "key").groupBy("key").agg(F.count("*").alias("n"))
    hot = saved(counts.where(F.col("n") > HOT_KEY).select("key"))
    if not hot.count():
        return rows
    split = rows.join(held(hot), "key", "left_semi").select("key", "fp", "sub").mapInArrow(_subkeys, "key long, fp long, sub long")
    return rows.join(held(hot), "key", "left_anti").unionByName(split)


def links(distinct: DataFrame) -> DataFrame:
    """(u, v) with u > v: links that connect all distinct fingerprints `fp` that are to be connected."""
    met = dealt(distinct).repartition(partitions(distinct.sparkSession), "key", "sub").sortWithinPartitions("key", "sub")
    return met.mapInArrow(_verified, "u long, v long")


def groups(fps: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """(fp, root) of each distinct fingerprint of fps: the least fingerprint that it is connected with, by the
    links (u, v) in `linked`, or else those of SimHash."""
    distinct = saved(fps.select("fp").distinct())
    found = components(links(distinct) if linked is None else linked).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    return distinct.join(found, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def least_of_groups(fps: DataFrame, least: Column, name: str, linked: DataFrame | None = None) -> DataFrame:
    """fps (a saved table) with the least value of `least` in each row's group. Rows are first reduced to one for
    each fingerprint, so copies meet only in a join that adds a column, whose large keys Spark can split."""
    nodes = saved(fps.groupBy("fp").agg(F.min(least).alias(name)).join(groups(fps, linked), "fp"))
    of_root = nodes.groupBy("root").agg(F.min(name).alias(name))
    return fps.join(nodes.select("fp", "root").join(of_root, "root").select("fp", name), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest id that is reachable by links.

    Null texts and texts without a word have fingerprint zero, which links like any other. Null ids get a
    component_id, the smallest id that isn't null, or null if there is none. Repeated rows stay. Texts of any length
    are read whole. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    fps = saved(fingerprints(docs, [F.col(id_col).cast("long").alias("doc_id")], text_col))
    found = least_of_groups(fps, F.col("doc_id"), "component_id")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
