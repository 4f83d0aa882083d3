"""Best-fit packing of documents into token sequences after a dominance reduction.

All that decides a packing is how many pieces there are of each length, and lengths are whole numbers up to
the capacity. So the driver gets a histogram of at most `capacity` numbers, whatever the size of the corpus,
and makes a plan of patterns: a pattern is a set of lengths and the number of sequences filled that way.
Pieces then look up their place by (length, rank among pieces of that length).

The plan begins with Martello and Toth's reduction: sets of up to three pieces that dominate every other use of one
of them are fixed for good. What remains is packed by best fit, decreasing: each piece goes to the sequence with the
least room that takes it. Pieces of one length and sequences with one room are placed together, which gives what
placing them one by one would. A second packing of the remainder, which fills one sequence after the other, is
taken where it needs fewer sequences.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions, raw_texts, saved, sliced

#: A worker keeps the words of its last one or two times so many new ones.
CACHE_WORDS = 400_000
LONG_WORD = 256
#: How the vocabulary marks a word's last token (fixed value).
WORD_END = "</w>"
#: The pattern by which a tokenizer of this kind cuts words in parts (fixed value).
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same for ASCII in lower case.
ASCII_PARTS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
#: Signs that end a word as one part (no apostrophe, which may begin one).
TAIL = b".,;:!?)]}$%&*#"
#: Letters whose lower case has no mark of its own; words of these and ASCII are cut here, all others by the library.
PLAIN = re.compile("[\x21-\x7f\xa1-\u012f\u0131-\u024f]+")


class WordTokenizer:
    """Token ids of texts by a tokenizer whose tokens never reach across ASCII white space.

    Texts are cut at white space, and words in the parts that the tokenizer takes by themselves; the library encodes
    each distinct part once, and a document is the concatenation of its words' ids, held as little-endian 32-bit
    integers.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for token, i in vocab.items() if token.endswith(WORD_END)]] = True
        cuts = json.loads(self.tokenizer.to_str())["pre_tokenizer"]["pretokenizers"][0]
        self.known_parts = cuts.get("pattern") == {"Regex": PARTS} and cuts.get("behavior") == "Removed"
        self.parts = regex.compile(PARTS)
        self.cache_words = cache_words
        self.cache: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def look_up(self, words: list[bytes]) -> None:
        """Puts words in the cache by the library itself, many to a line; words of letters end in tokens that are told
        by the vocabulary's mark, all others are encoded one by one."""
        letters = [w for w in words if w.isalpha() or w.decode().isalpha()]
        lines = [letters[i : i + 500] for i in range(0, len(letters), 500)]
        rest = [w for w in words if not (w.isalpha() or w.decode().isalpha())] if len(letters) < len(words) else []
        for line, e in zip(lines, self.tokenizer.encode_batch_fast([b" ".join(x).decode() for x in lines], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1 if len(ids) else ids
            if len(ends) == len(line):
                raw, at = ids.tobytes(), [0, *(4 * ends).tolist()]
                self.cache.update(zip(line, map(raw.__getitem__, map(slice, at, at[1:]))))
            else:
                rest += line
        for i in range(0, len(rest), 5_000):
            part = rest[i : i + 5_000]
            found = self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            self.cache.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(part, found, strict=True))

    def cut(self, word: bytes) -> list[bytes] | tuple[bytes, ...]:
        """The parts of a word that the tokenizer takes by themselves; the word where the library has to cut it."""
        core = word.rstrip(TAIL)
        if core and (core.isalpha() or core.decode().isalpha()):
            return (core, word[len(core) :]) if len(core) < len(word) else (word,)
        if b"<|" in word:
            return (word,)
        if word.isascii():
            return ASCII_PARTS.findall(word)
        text = word.decode()
        return [x.encode() for x in self.parts.findall(text)] if PLAIN.fullmatch(text) else (word,)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        # the vocabulary is of lower case; marks of special tokens are told by case, so words with one stay as they are
        words = [[w if b"<|" in w else w.lower() for w in t.split()] if b"<|" in t else t.lower().split() for t in texts]
        if len(self.cache) > self.cache_words:
            self.old, self.cache = self.cache, {}
        cache, old = self.cache, self.old
        new = set().union(*words).difference(cache)
        seen = old.keys() & new
        cache.update(zip(seen, map(old.__getitem__, seen)))
        new -= seen
        mixed = {w: p for w in new if not w.isalpha() and len(p := self.cut(w)) > 1} if self.known_parts else {}
        wanted = new.difference(mixed).union(*mixed.values()).difference(cache)
        seen = old.keys() & wanted
        cache.update(zip(seen, map(old.__getitem__, seen)))
        self.look_up(list(wanted - seen))
        cache.update({w: b"".join([cache[x] for x in p]) for w, p in mixed.items()})
        out = [b"".join(map(cache.__getitem__, w)) for w in words]
        for w in [w for w in new | wanted if len(w) > LONG_WORD]:  # not worth keeping
            del cache[w]
        return out


# One tokenizer for all tasks of a worker.
@functools.cache
def tokenizer_of(path: str, cache_words: int) -> WordTokenizer:
    return WordTokenizer(path, cache_words)


PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
])
#: A number besides that is different in the rows of a task: it deals out rows that are alike in all else.
SALTED = T.StructType([*PIECES.fields, T.StructField("salt", T.LongType())])


def pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", cache_words: int = CACHE_WORDS
) -> DataFrame:
    """The token pieces of every document: (doc_id, piece, start, length, ids_crc32, salt), without the ids. Texts of
    any length are read whole. A worker keeps `cache_words` words or twice as many, at some 150 bytes each."""
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * capacity

    def run(batches):
        tokenizer, salt = tokenizer_of(tokenizer_path, cache_words), 0
        for batch in sliced(batches):
            out: list[list] = [[], [], [], [], []]
            for doc, ids in zip(batch.column(0).to_pylist(), tokenizer.encode(raw_texts(batch.column(1))), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), step)):
                    own = ids[at : at + step]
                    for column, v in zip(out, (doc, k, at // 4, len(own) // 4, zlib.crc32(own)), strict=True):
                        column.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            out.append(range(salt, salt := salt + len(out[0])))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=SALTED.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SALTED)


@dataclass
class Plan:
    """Slots: pieces of `size` with ranks from `first` on go, `each` to a sequence, to sequences from `base`
    on, from `offset` on."""

    size: np.ndarray
    first: np.ndarray
    each: np.ndarray
    base: np.ndarray
    offset: np.ndarray
    sequences: int
    reduced: int  # of them, fixed by the reduction


class _Stock:
    """How many pieces of each length are left, with bit sets for quick searches."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.capacity, self.left = capacity, {s: n for s, n in counts.items() if n > 0}
        self.mask = sum(1 << s for s in self.left)
        self.mirror = sum(1 << (capacity - s) for s in self.left)

    def take(self, lengths: Counter, times: int) -> None:
        for s, c in lengths.items():
            self.left[s] -= c * times
            if not self.left[s]:
                del self.left[s]
                self.mask ^= 1 << s
                self.mirror ^= 1 << (self.capacity - s)

    def spare(self, held: Counter) -> tuple[int, int]:
        """mask and mirror without lengths that `held` uses up."""
        mask, mirror = self.mask, self.mirror
        for s, c in held.items():
            if self.left[s] <= c:
                mask &= ~(1 << s)
                mirror &= ~(1 << (self.capacity - s))
        return mask, mirror

    def times(self, lengths: Counter) -> int:
        return min(self.left[s] // c for s, c in lengths.items())


def _largest(mask: int, most: int) -> int:
    return (mask & ((1 << (most + 1)) - 1)).bit_length() - 1


def _smallest(stock: _Stock, mask: int, held: Counter, n: int) -> list[int]:
    """The n smallest lengths that are left besides `held`, repeats included; fewer if there are fewer."""
    found: list[int] = []
    while mask and len(found) < n:
        s = (mask & -mask).bit_length() - 1
        found += [s] * min(n - len(found), stock.left[s] - held[s])
        mask &= mask - 1
    return found


def _best_pair(stock: _Stock, mask: int, held: Counter, room: int) -> int:
    """The largest sum of two spare lengths that fits in room, or 0."""
    sizes = np.array([s for s in sorted(stock.left) if mask >> s & 1 and s <= room])
    if not len(sizes):
        return 0
    at = np.searchsorted(sizes, room - sizes, "right") - 1
    lone = np.array([stock.left[s] - held[s] < 2 for s in sizes.tolist()])
    at = np.where((at == np.arange(len(sizes))) & lone, at - 1, at)
    return int((sizes + sizes[at])[at >= 0].max(initial=0))


def dominant(stock: _Stock, j: int) -> Counter | None:
    """A set with j that dominates all other sets with j, if one of at most three pieces is found to: each of the
    others can be parted so that each part fits in the place of a piece of this one.

    Sets of j and nothing (nothing else fits); of j and a piece that fills the sequence; of j and the largest piece
    that fits where only one fits, or where any two that fit are no longer together than that one; where at most two
    fit, of j, the largest piece that fits and the largest that fits beside it, if no two longer than the latter fit.
    """
    held = Counter([j])
    mask, _ = stock.spare(held)
    room = stock.capacity - j
    k = _largest(mask, room)
    if k < 1:
        return held
    if k == room:
        return Counter([j, k])
    low = _smallest(stock, mask, held, 3)
    if len(low) < 2 or low[0] + low[1] > room:
        return Counter([j, k])
    if len(low) == 3 and sum(low) <= room:
        return None
    if _best_pair(stock, mask, held, room) <= k:
        return Counter([j, k])
    held[k] += 1
    beside = _largest(stock.spare(held)[0], room - k)
    held[k] -= 1
    if beside < 1:
        return None
    longer = _smallest(stock, mask >> (beside + 1) << (beside + 1), held, 2)
    return Counter([j, k, beside]) if len(longer) < 2 or sum(longer) > room else None


def filled(stock: _Stock) -> list[int]:
    """The lengths of one sequence: the longest piece left, then the piece or two that fill the room, or else
    the longest that fits."""
    j = stock.mask.bit_length() - 1
    got, held, room = [j], Counter([j]), stock.capacity - j
    while room:
        mask, mirror = stock.spare(held)
        k = _largest(mask, room)
        if k < 1:
            break
        both = 0
        if k < room:
            both = mask & (mirror >> (stock.capacity - room)) & ((1 << (room + 1)) - 1)
            if not room % 2 and both >> (room // 2) & 1 and stock.left[room // 2] - held[room // 2] < 2:
                both &= ~(1 << (room // 2))
        for s in (b := both.bit_length() - 1, room - b) if both else (k,):
            got.append(s)
            held[s] += 1
            room -= s
    return got


#: A row of a plan: length, rank of the first piece, how many to a sequence, first sequence, offset there.
Row = tuple[int, int, int, int, int]


def fixed(stock: _Stock, lengths: list[int], used: Counter, base: int) -> tuple[list[Row], int]:
    """Rows for as many sequences of these lengths as the stock has, from sequence `base` on; and how many."""
    held, rows, offset = Counter(lengths), [], 0
    times = stock.times(held)
    for s, c in sorted(held.items(), reverse=True):
        rows.append((s, used[s], c, base, offset))
        used[s] += c * times
        offset += c * s
    stock.take(held, times)
    return rows, times


def best_fit(left: dict[int, int], capacity: int, used: Counter, base: int) -> tuple[list[Row], int]:
    """Rows for all pieces in `left` by best fit, decreasing, from sequence `base` on; and how many sequences.

    A sequence that takes one piece of a length has the least room for the next, as long as it has room for it. So
    it takes as many as fit, and so do the others with the same room. Each time, less than half the room is left.
    """
    rows: list[Row] = []
    rooms: list[int] = []
    open_at: dict[int, list[tuple[int, int]]] = {}  # for each room, (first sequence, how many)
    n_sequences = 0

    def leave(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in open_at:
                insort(rooms, room)
            open_at.setdefault(room, []).append((first, n))

    for s, n in sorted(left.items(), reverse=True):
        at = used[s]
        while n:
            i = bisect_left(rooms, s)
            if i < len(rooms):
                room = rooms[i]
                first, have = open_at[room].pop()
                if not open_at[room]:
                    del open_at[room], rooms[i]
            else:
                room, first, have = capacity, base + n_sequences, -(-n // (capacity // s))
                n_sequences += have
            each = room // s
            whole = min(have, n // each)
            some = n - whole * each if whole < have else 0  # the last ones, fewer than fit in a sequence
            if whole:
                rows.append((s, at, each, first, capacity - room))
            if some:
                rows.append((s, at + whole * each, some, first + whole, capacity - room))
            leave(room - each * s, first, whole)
            leave(room - some * s, first + whole, bool(some))
            leave(room, first + whole + bool(some), have - whole - bool(some))
            at, n = at + whole * each + some, n - whole * each - some
    return rows, n_sequences


def plan(counts: dict[int, int], capacity: int) -> Plan:
    """Patterns for all pieces. Each step uses up a length, so the work depends on `capacity` alone."""
    stock, used, rows, base = _Stock(counts, capacity), Counter(), [], 0
    found = True
    while found and stock.left:
        found = False
        for j in sorted(stock.left, reverse=True):
            while j in stock.left and (best := dominant(stock, j)):
                more, times = fixed(stock, list(best.elements()), used, base)
                rows, base, found = rows + more, base + times, True
    reduced = base
    rest, n_rest = best_fit(stock.left, capacity, used, base)
    other, at = [], base
    while stock.left:
        more, times = fixed(stock, filled(stock), used, at)
        other, at = other + more, at + times
    if at - base < n_rest:
        rest, n_rest = other, at - base
    columns = np.array(sorted(rows + rest), np.int64).reshape(-1, 5).T
    return Plan(*columns, sequences=base + n_rest, reduced=reduced)


def ranked(rows: DataFrame) -> DataFrame:
    """rows with `rank` from 0 among those of the same length: the rank within a slice of that length, plus
    what lies in lower slices, so that a length many pieces share is spread over all slices."""
    slices = partitions(rows.sparkSession)
    cut = rows.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece", "salt"), F.lit(slices)).cast("int"))
    counts = cut.groupBy("length", "slice").agg(F.count("*").alias("n"))
    before = counts.select("length", "slice", (F.sum("n").over(Window.partitionBy("length").orderBy("slice")) - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "start", "ids_crc32", "salt")
    return cut.withColumn("in_slice", F.row_number().over(order)).join(before, ["length", "slice"]).withColumn("rank", F.col("before") + F.col("in_slice") - 1)


PACKED = T.StructType([*PIECES.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])


def pack(rows: DataFrame, capacity: int = 4096) -> DataFrame:
    """rows of `pieces` with sequence_id and offset. Reads rows twice: give a saved table."""
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # at most `capacity` rows
    made = plan(counts, capacity)
    # ranks stay below 2^50 and lengths below 2^13: one sorted key for both
    shared = rows.sparkSession.sparkContext.broadcast((made.size << 50 | made.first, made))

    def run(batches):
        keys, p = shared.value
        for batch in batches:
            size, rank = (batch.column(i).to_numpy() for i in (3, 5))
            at = np.searchsorted(keys, size << 50 | rank, "right") - 1
            nth = rank - p.first[at]
            place = [p.base[at] + nth // p.each[at], p.offset[at] + nth % p.each[at] * size]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *map(pa.array, place)], names=PACKED.names)

    return ranked(rows).select(*PIECES.names, "rank").mapInArrow(run, PACKED)


def packed(
    docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", cache_words: int = CACHE_WORDS
) -> DataFrame:
    """Packs all documents into sequences of at most `capacity` tokens.

    A document is its token ids and `end_id`; longer ones are cut into full pieces and a last one. Null and
    empty texts are documents of `end_id` alone. Repeated rows are packed each on its own, equal ones in any
    order. Null ids are kept as they are. An empty table gives an empty result. Other columns are ignored, whatever
    their names.
    """
    return pack(saved(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, cache_words)), capacity)
