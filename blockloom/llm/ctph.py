"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last seven bytes ends a chunk where it is one below a multiple of the block size; each
chunk gives one of 64 characters. Block sizes are 3 * 2^k; the block size of a text is the least that gives at
most 64 chunks, so the whole text always counts. A fingerprint holds the signatures of that block size and of
its double. Signatures of one block size are compared by edit distance (insertions and deletions), found as the
longest common subsequence of up to 64 characters with one machine word a pair, many pairs at a time.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, saved, sliced

WINDOW = 7
CHUNKS = 64
#: Characters of a signature (fixed value: the base64 alphabet).
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_CODES = np.full(256, CHUNKS, np.uint8)
_CODES[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(CHUNKS, dtype=np.uint8)
_FACTORS = [pow(0x01000193, j + 1, 1 << 32) for j in range(WINDOW)]
#: Signatures of at least SURE characters are alike only if they share RUN characters in a row.
SURE, RUN = 8, 4
#: From this length on, the signatures of the double block size count by themselves.
COARSE = 16
PIECE = 1 << 22


def triggers(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ends of chunks at block size 3, and for each the largest k for which it ends one at 3 * 2^k."""
    ends, levels = [], []
    for at in range(0, len(data), PIECE):
        lead = min(at, WINDOW - 1)
        raw = np.frombuffer(data, np.uint8, min(len(data), at + PIECE) - at + lead, at - lead)
        x = raw.astype(np.uint32) + np.uint32(1)
        h = x * np.uint32(_FACTORS[0])
        for j in range(1, min(WINDOW, len(x))):
            h[j:] += x[:-j] * np.uint32(_FACTORS[j])
        h = h[lead:]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        hit = np.flatnonzero(h % np.uint32(3) == 2)
        ones = h[hit]
        ends.append(hit + at + 1)
        levels.append(np.bitwise_count(ones & ~(ones + np.uint32(1))))  # trailing ones
    return (np.concatenate(ends), np.concatenate(levels)) if ends else (np.zeros(0, np.int64), np.zeros(0, np.uint8))


def signature(data: bytes, ends: np.ndarray) -> str:
    cuts = ends.tolist()
    if len(data) and (not cuts or cuts[-1] < len(data)):
        cuts.append(len(data))
    return "".join([ALPHABET[zlib.crc32(data[a:b]) & 63] for a, b in zip([0, *cuts], cuts, strict=False)])


def fingerprint(text: str) -> str:
    """block size:signature:signature of the double block size."""
    data = text.encode()
    ends, levels = triggers(data)
    at_least = np.cumsum(np.bincount(levels, minlength=34)[::-1])[::-1]
    k = int(np.argmax(at_least < CHUNKS))
    fine = levels >= k
    ends, levels = ends[fine], levels[fine]
    return f"{3 << k}:{signature(data, ends)}:{signature(data, ends[levels > k])}"


def common(pairs: list[tuple[str, str]]) -> np.ndarray:
    """2 * longest common subsequence / total length of each pair of signatures; 0 for pairs without a run in common."""
    n = len(pairs)
    codes = []
    for side, pad in ((0, CHUNKS), (1, CHUNKS + 1)):
        raw = np.frombuffer("".join(p[side].ljust(CHUNKS) for p in pairs).encode(), np.uint8).reshape(n, CHUNKS)
        c = _CODES[raw]
        codes.append(np.where(c == CHUNKS, np.uint8(pad), c))
    a, b = codes
    length = [np.array([len(p[side]) for p in pairs]) for side in (0, 1)]
    rows = np.arange(n)
    where = np.zeros((n, CHUNKS + 2), np.uint64)
    for i in range(CHUNKS):
        where[rows, a[:, i]] |= np.uint64(1 << i)
    where[:, CHUNKS:] = 0
    v = np.full(n, 2**64 - 1, np.uint64)
    for j in range(int(length[1].max(initial=0))):
        u = v & where[rows, b[:, j]]
        v = (v + u) | (v - u)
    lcs = np.bitwise_count(~v).astype(np.int64)
    like = 2 * lcs / np.maximum(length[0] + length[1], 1)
    # runs of RUN characters, as numbers
    grams = []
    for c, n_c in zip(codes, length, strict=True):
        g = sum(c[:, i : CHUNKS - RUN + 1 + i].astype(np.int64) << 6 * i for i in range(RUN))
        inside = np.arange(CHUNKS - RUN + 1) <= (n_c - RUN)[:, None]
        grams.append((rows[:, None] << 6 * RUN | g)[inside])
    shared = np.zeros(n, bool)
    shared[grams[0][np.isin(grams[0], grams[1])] >> 6 * RUN] = True
    return np.where(shared | (np.minimum(*length) < SURE), like, 0.0)


def likeness(pairs: list[tuple[str, str]]) -> list[float]:
    """0 to 1 for each pair of fingerprints; 1 for equal ones, 0 for block sizes that are not equal or double.

    Signatures of the same block size are compared (see `common`: from SURE characters on they must share a run of RUN
    characters, or the likeness is 0). With equal block sizes the signatures of the double size are compared, too, if
    both have COARSE characters or more, and the higher likeness counts."""
    out = [0.0] * len(pairs)
    todo: list[tuple[int, str, str]] = []
    for i, (p, q) in enumerate(pairs):
        if p == q:
            out[i] = 1.0
            continue
        (size_p, p1, p2), (size_q, q1, q2) = p.split(":"), q.split(":")
        size_p, size_q = int(size_p), int(size_q)
        if size_p == size_q:
            todo.append((i, p1, q1))
            if min(len(p2), len(q2)) >= COARSE:
                todo.append((i, p2, q2))
        elif size_p == 2 * size_q:
            todo.append((i, p1, q2))
        elif size_q == 2 * size_p:
            todo.append((i, p2, q1))
    for at in range(0, len(todo), 4096):
        part = todo[at : at + 4096]
        for (i, _, _), x in zip(part, common([(a, b) for _, a, b in part]).tolist(), strict=True):
            out[i] = max(out[i], x)
    return out


def edited(text: str, following: str) -> str:
    """text with its last third of code points replaced by the first as many of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def compared(ids: list, texts: list[str], following: list[str], prints: list[str], next_prints: list[str]) -> list[pa.Array]:
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    changed_prints = [fingerprint(t) for t in changed]
    columns = [
        ids, [len(t) for t in texts], [hashlib.sha256(t.encode()).hexdigest() for t in changed], prints, changed_prints,
        likeness(list(zip(prints, changed_prints, strict=True))), likeness(list(zip(prints, next_prints, strict=True))),
    ]
    return [pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)]


def _in_order(batches):
    """Rows of a partition in order, all but the last compared with the one that follows; the last is left,
    with the first text, for the row before the partition's first and for its own follower."""
    first = kept = None
    for batch in sliced(batches):
        rows = [(i, t or "") for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        rows = [(*r, fingerprint(r[1])) for r in rows]
        first = rows[0][1] if first is None else first
        rows, kept = ([kept] if kept else []) + rows, rows[-1]
        if len(rows) > 1:
            ids, texts, prints = zip(*rows, strict=True)
            done = compared(ids[:-1], texts[:-1], texts[1:], prints[:-1], prints[1:])
            n = len(rows) - 1
            yield pa.RecordBatch.from_arrays([*done, pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], names=[*_NAMES, "part", "first_text", "last_text"])
    if kept:
        edge = [kept[0], *[None] * 6]
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([v], t) for v, t in zip(edge, _TYPES, strict=True)), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([first], pa.string()), pa.array([kept[1]], pa.string())],
            names=[*_NAMES, "part", "first_text", "last_text"],
        )


def _at_edges(batches):
    for batch in sliced(batches):
        ids, texts, following = (c.to_pylist() for c in batch.columns)
        prints = [fingerprint(t) for t in texts]
        yield pa.RecordBatch.from_arrays(compared(ids, texts, following, prints, [fingerprint(t) for t in following]), names=_NAMES)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every document and of its text edited with the next document's, with both likenesses.

    The next document is the one with the next lower id (null ids come last, equal ids by a hash of the text), the
    first one after the last. Null texts count as empty; equal texts, empty ones included, have equal fingerprints and
    likeness 1. A lone document is its own next. Texts of any length are read whole. An empty table gives an empty
    result. Other columns are ignored, whatever their names. Texts are shuffled once, by range, in which null and
    repeated ids are told apart by the hash and by place; one row a partition is left over and joined to its neighbour.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumns({"hash": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    order = (F.col("doc_id").desc_nulls_last(), "hash", "place")
    ranged = rows.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order).select("doc_id", "text")
    done = saved(ranged.mapInArrow(_in_order, f"{ROW}, part int, first_text string, last_text string"))
    edges = done.where("part IS NOT NULL")  # one row a partition
    by_part = Window.orderBy("part")
    following = F.coalesce(F.lead("first_text").over(by_part), F.first("first_text").over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    last = edges.select("doc_id", F.col("last_text").alias("text"), following.alias("following")).mapInArrow(_at_edges, ROW)
    return done.where("part IS NULL").select(*_NAMES).unionByName(last)
