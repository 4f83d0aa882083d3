"""Near-duplicates by SimHash and by the similarity of shingle sets: texts link where the Jaccard index is 0.8 or more.

SimHash alone can't find all of these: at an index of 0.8 two fingerprints of 64 bits differ in 10 bits on average
and in 19 now and then, and Hamming balls that wide hold more values than there are texts. So multi-index hashing
(see `simhash`) finds what differs in few bits, and MinHash the rest. Every link is checked on whole shingle sets.

MinHash: texts meet under a key where all ROWS minima of one of BANDS bands are equal. A pair with an index of
exactly 0.8 is missed with odds of (1 - 0.8**5)**40, one in eight million, one with 0.9 with odds below 1e-15.

Texts with equal sets are one node. Each pass leaves fewer groups to the next:
1. each node is checked against the centre of its SimHash group;
2. under a key, each group is checked against the largest one, by the two nodes that share most keys;
3. under a key, all nodes of different groups are checked, but for those whose minima rule a link out (`CLEAR`) and
   those that met under an earlier key. Pairs are checked where they meet, most alike first, and only links that join
   two groups are given out. Nodes under a large key are dealt to blocks, and each pair of blocks is a task's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, held, partitions, raw_texts, saved, sliced
from .components import components
from .simhash import groups, shingle_hashes, simhash

WORDS = 5
#: The least Jaccard index of a link, as a fraction.
LEAST = (4, 5)
BANDS, ROWS = 40, 5
#: Pairs with fewer equal minima of all BANDS * ROWS are not checked: 0.8 of them would be 160, with a standard
#: deviation of 5.7, so this lies over five deviations below.
CLEAR = 130
_RANDOM = np.random.default_rng(42)
XORS = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
ODDS = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
#: Nodes of a key that are compared at once; a key with more is dealt to blocks of about so many.
BLOCK = 512
#: Bytes of texts whose shingle sets a task keeps.
KEPT_BYTES = 16 << 20
SHINGLES_AT_ONCE = 2_048
#: Pairs of signatures that are compared at once.
PAIRS_AT_ONCE = 1 << 16


def shingle_set(text: bytes) -> np.ndarray:
    return np.unique(shingle_hashes(text, WORDS))


class Sets:
    """Shingle sets of texts; those of the last ones are kept."""

    def __init__(self) -> None:
        self.kept: dict[bytes, np.ndarray] = {}
        self.size = 0

    def __call__(self, text: bytes) -> np.ndarray:
        found = self.kept.get(text)
        if found is None:
            found = shingle_set(text)
            if self.size + len(text) > KEPT_BYTES:
                self.kept, self.size = {}, 0
            self.kept[text] = found
            self.size += len(text)
        return found


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set that isn't empty."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for i in range(0, len(hashes), SHINGLES_AT_ONCE):
        part = hashes[i : i + SHINGLES_AT_ONCE, None]
        np.minimum(least, ((part ^ XORS) * ODDS).min(0), out=least)
    return least


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets (sorted, without repeats) have the least index of a link or more."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common * LEAST[1] >= (len(a) + len(b) - common) * LEAST[0]


def fingerprints(docs: DataFrame, keep: list[Column], text_col: str = "text") -> DataFrame:
    """The columns `keep`, `fp` (a hash of the shingle set), `sim` (the SimHash of all shingles), `bands` (a key for
    each band; none of an empty set) and `signature` (a byte of each minimum) of every document."""
    n = len(keep)

    def run(batches):
        for batch in sliced(batches, n):
            fps, sims, bands, signatures = [], [], [], []
            for text in raw_texts(batch.column(n)):
                hashes = shingle_hashes(text, WORDS)
                found = np.unique(hashes)
                fps.append(xxhash.xxh64_intdigest(found.tobytes()))
                sims.append(simhash(hashes))
                least = minima(found) if len(found) else np.zeros(0, np.uint64)
                bands.append([xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(least.reshape(-1, ROWS))])
                signatures.append((least >> np.uint64(32)).astype(np.uint8).tobytes())
            signed = [np.array(x, np.uint64).view(np.int64) for x in bands]
            columns = [pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sims, pa.int64()), pa.array(signed, pa.list_(pa.int64())), pa.array(signatures, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *columns], names=[*batch.schema.names[:n], "fp", "sim", "bands", "signature"])

    rows = docs.select(*keep, F.col(text_col).alias("_text"))
    none = F.lit(None)
    kinds = {"fp": "long", "sim": "long", "bands": "array<long>", "signature": "binary"}
    return rows.mapInArrow(run, rows.select(*rows.columns[:n], *(none.cast(t).alias(c) for c, t in kinds.items())).schema)


def _checked(batches):
    """The links among candidate pairs (u, v, text_u, text_v)."""
    sets = Sets()
    for batch in batches:
        for part in sliced([batch], 2):
            hit = [linked(sets(a), sets(b)) for a, b in zip(raw_texts(part.column(2)), raw_texts(part.column(3)), strict=True)]
            yield part.select(["u", "v"]).filter(pa.array(hit, pa.bool_()))


def links_among(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v) of the pairs that link. `texts` has one text of each fp."""
    both = pairs
    for side in "uv":
        both = both.join(texts.select(F.col("fp").alias(side), F.col("text").alias(f"text_{side}")), side)
    return saved(both.select("u", "v", "text_u", "text_v").mapInArrow(_checked, "u long, v long"))


def alike(apart: np.ndarray, signatures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i > j, of rows that `apart` tells apart and that have at least CLEAR equal bytes in their signatures,
    most alike first."""
    n, step = len(signatures), max(1, PAIRS_AT_ONCE // len(signatures))
    found = []
    for at in range(0, n, step):
        own = slice(at, at + step)
        same = (signatures[own, None] == signatures[None]).sum(2, dtype=np.int32)
        i, j = np.nonzero((same >= CLEAR) & apart[own] & (np.arange(at, min(at + step, n))[:, None] > np.arange(n)))
        found.append((i + at, j, same[i, j]))
    i, j, same = map(np.concatenate, zip(*found, strict=True))
    order = np.argsort(-same, kind="stable")
    return i[order], j[order]


def joining(rows: list[tuple], sets) -> list[tuple[int, int]]:
    """Links that join what is linked among rows (fp, root, bands, signature, part, text) of one key and pair of blocks."""
    fps, roots, parts = (np.array([r[k] for r in rows], np.int64) for k in (0, 1, 4))
    bands = np.array([r[2] for r in rows], np.int64)
    signatures = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), -1)
    apart = roots[:, None] != roots
    if parts.min() != parts.max():  # within a block, pairs are another task's
        apart &= parts[:, None] != parts
    if not apart.any():
        return []
    earlier = int(np.argmax((bands == bands[0]).all(0)))  # the first band that all share is this key's, or they meet there
    i, j = alike(apart, signatures)
    first = ~(bands[i, :earlier] == bands[j, :earlier]).any(1)
    group = {r: r for r in roots.tolist()}

    def find(r: int) -> int:
        while group[r] != r:
            group[r] = r = group[group[r]]
        return r

    out = []
    for a, b in zip(i[first].tolist(), j[first].tolist(), strict=True):
        x, y = find(int(roots[a])), find(int(roots[b]))
        if x != y and linked(sets(rows[a][5]), sets(rows[b][5])):
            group[x] = y
            u, v = sorted((int(fps[a]), int(fps[b])), reverse=True)
            out.append((u, v))
    return out


def _apart(batches):
    """Links among rows (key, low, high, fp, root, bands, signature, part, text) sorted by key and blocks."""
    sets = Sets()

    def given(rows):
        found = joining(rows, sets) if len(rows) > 1 else []
        u, v = zip(*found, strict=True) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    key, rows = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns[:-1]] + [raw_texts(batch.column(8))]
        for *k, fp, root, bands, signature, part, text in zip(*columns, strict=True):
            if k != key:
                yield given(rows)
                key, rows = k, []
            rows.append((fp, root, bands, signature, part, text))
    yield given(rows)


def rooted(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """nodes with the `root` of each: the least node that the links found so far connect it with."""
    joined = components(found).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    return nodes.join(joined, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def ordered(pairs: DataFrame) -> DataFrame:
    """Distinct (u, v) with u > v."""
    return pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def centred(nodes: DataFrame) -> DataFrame:
    """(u, v): each node and the least node of its SimHash group."""
    member = nodes.select("fp", "sim").join(groups(nodes.select(F.col("sim").alias("fp"))).select(F.col("fp").alias("sim"), F.col("root").alias("group")), "sim")
    centre = member.groupBy("group").agg(F.min("fp").alias("v"))
    return ordered(member.join(centre, "group").where("fp <> v").select(F.col("fp").alias("u"), "v"))


def meeting(nodes: DataFrame) -> DataFrame:
    """(key, fp): the nodes under each key that more than one has, which are few of all."""
    keys = nodes.select("fp", F.explode("bands").alias("key"))
    return keys.join(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "key")


def across(met: DataFrame, found: DataFrame) -> DataFrame:
    """(u, v): for each group that meets a larger one as the largest under a key, the two nodes of them that meet under
    most keys. Sizes tie by a hash, so that the keys of a group agree on one other."""
    own = saved(rooted(met.select("fp").distinct(), found))
    sizes = own.groupBy("root").agg(F.count("*").alias("n"))
    keys = saved(met.join(own.join(sizes, "root"), "fp"))
    most = F.max(F.struct("n", F.xxhash64("root").alias("h"), "root", F.xxhash64("fp").alias("i"), "fp")).alias("first")
    first = keys.groupBy("key").agg(most, F.min("root").alias("a"), F.max("root").alias("b")).where("a < b")
    pairs = keys.select("key", "fp", "root").join(first.select("key", F.col("first.root").alias("to"), F.col("first.fp").alias("v")), "key").where("root <> to")
    shared = pairs.groupBy("root", "to", "fp", "v").agg(F.count("*").alias("n"))
    return ordered(shared.groupBy("root", "to").agg(F.max_by(F.struct(F.col("fp").alias("u"), "v"), F.struct("n", "fp", "v")).alias("pair")).select("pair.*"))


def apart(nodes: DataFrame, met: DataFrame, found: DataFrame, texts_of) -> DataFrame:
    """(u, v): links among nodes that meet under a key and are in different groups."""
    keys = saved(met.join(rooted(met.select("fp").distinct(), found), "fp"))
    ends = keys.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("n")).where("a < b")
    split = ends.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    left = saved(keys.join(split, "key").select("key", "fp", "root", F.pmod(F.xxhash64("fp"), "blocks").cast("int").alias("part"), "blocks"))
    # a row goes to each pair that its block is in
    dealt = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "fp", "root", "part")
    texts = texts_of(left.select("fp").distinct())
    rows = dealt.join(texts.join(nodes.select("fp", "bands", "signature"), "fp"), "fp").select("key", "low", "high", "fp", "root", "bands", "signature", "part", "text")
    spread = rows.repartition(partitions(nodes.sparkSession), "key", "low", "high").sortWithinPartitions("key", "low", "high")
    links = saved(spread.mapInArrow(_apart, "u long, v long").distinct())
    for df in (keys, left, texts):
        dropped(df)
    return links


def links(docs: DataFrame, fps: DataFrame, key: dict[str, Column], text_col: str = "text") -> DataFrame:
    """(u, v) with u > v: links that connect all distinct `fp` that are to be connected. fps are saved
    fingerprints of docs with the columns of `key`, which name a document."""
    named = F.min(F.struct(*key)).alias("name")
    nodes = saved(fps.groupBy("fp").agg(named, F.min("sim").alias("sim"), F.first("bands").alias("bands"), F.first("signature").alias("signature")))
    names = docs.select(F.col(text_col).alias("text"), *(c.alias(k) for k, c in key.items()))

    def texts_of(wanted: DataFrame) -> DataFrame:
        """(fp, text): one text of each node, which are few, so that the documents' texts need not be shuffled."""
        wanted = saved(wanted.join(nodes.select("fp", "name.*"), "fp"))
        texts = saved(names.join(held(wanted), list(key)).groupBy("fp").agg(F.first("text").alias("text")))
        dropped(wanted)
        return texts

    def checked(pairs: DataFrame) -> DataFrame:
        pairs = saved(pairs)
        texts = texts_of(pairs.select(F.explode(F.array("u", "v")).alias("fp")).distinct())
        found = links_among(pairs, texts)
        for df in (pairs, texts):
            dropped(df)
        return found

    met = saved(meeting(nodes))
    found = checked(centred(nodes))
    found = saved(found.unionByName(checked(across(met, found))))
    rest = apart(nodes, met, found, texts_of)
    for df in (nodes, met):
        dropped(df)
    return found.unionByName(rest)
