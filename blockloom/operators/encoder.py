"""An encoder of the bzip2 format built from stages on numpy arrays.

Rows of a stream are independent, blocks of a stream are too once the greedy packing has cut them. The rotation
sort doubles the length of sorted prefixes; code lengths come from coin packages; bits are placed by their
offsets. Bulk compression is libbz2's; this kernel gives the same format from open stages.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from operator import add

import numpy as np

from .format import BLOCK_MAGIC, BLOCK_SLACK, END_MAGIC, GROUP, LEVEL_UNIT, MAX_RUN, combined, crc

#: The longest code an encoder gives, and how often tables are fitted.
MAX_LENGTH = 17
PASSES = 4
#: Symbol counts from which one more table pays (fixed values).
TABLE_STEPS = (200, 600, 1200, 2400)
#: Bytes that the first ranks of the rotation sort take in, and numbers that `recency` holds at once.
FIRST_BYTES = 7
STRETCH = 1 << 18


def runs(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(byte, length) of the runs of equal bytes, none longer than MAX_RUN."""
    x = np.frombuffer(data, np.uint8)
    if not len(x):
        return x, np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    size = np.diff(start, append=len(x))
    pieces = -(-size // MAX_RUN)
    value = np.repeat(x[start], pieces)
    length = np.full(len(value), MAX_RUN, np.int64)
    last = np.cumsum(pieces) - 1
    length[last] = size - (pieces - 1) * MAX_RUN
    return value, length


def packed_size(length: np.ndarray) -> np.ndarray:
    return np.where(length < 4, length, 5)


def packing(sizes: np.ndarray, limit: int) -> np.ndarray:
    """Number of the block of each run: a run opens a block where it no longer fits in the last one. The end of
    each block is found by a search in the running sum."""
    total = np.cumsum(sizes)
    block = np.zeros(len(sizes), np.int64)
    at = n = 0
    while at < len(sizes):
        before = total[at - 1] if at else 0
        to = max(int(np.searchsorted(total, before + limit, "right")), at + 1)
        block[at:to] = n
        at, n = to, n + 1
    return block


def packed_runs(value: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Bytes of the first run-length step: up to four literals, then a count if there are four."""
    size = packed_size(length)
    out = np.repeat(value, size)
    counts = np.cumsum(size)[length >= 4] - 1
    out[counts] = (length[length >= 4] - 4).astype(np.uint8)
    return out


def bwt(block: np.ndarray) -> tuple[np.ndarray, int]:
    """(last column, row of the unrotated block) of the sorted rotations, of equal ones the later start first."""
    n = len(block)
    # ranks begin as the first bytes of the rotations, as many as a number holds
    width = min(FIRST_BYTES, n)
    rank, turned = np.zeros(n, np.int64), np.concatenate([block, block[:width]])
    for i in range(width):
        rank <<= 8
        rank |= turned[i : n + i]
    while True:
        order = np.argsort(rank)
        ranked = rank[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
        rank = new
        if rank[order[-1]] == n - 1:
            break
        if width >= n:
            order = np.lexsort((-np.arange(n), rank))
            break
        rank, width = rank * n + np.concatenate([rank[width:], rank[:width]]), 2 * width
    return block[order - 1], int(np.flatnonzero(order == 0)[0])


def recency(values: np.ndarray, k: int) -> np.ndarray:
    """The place of each of a row of numbers below k (up to 256) in the list of the most recent ones, which begins in
    their order: how many others came since its last one. A stretch at a time, with when each number came last before each
    row. The running maxima are taken in columns of neighbouring rows, all columns at once, then from column to column."""
    out = np.empty(len(values), np.int64)
    last, step = -1 - np.arange(k, dtype=np.int16), max(min(STRETCH // k, 1 << 14), 1)
    for lo in range(0, len(values), step):
        own = values[lo : lo + step]
        n = len(own)
        high = min(int(n**0.5) + 1, 32)
        wide = n // high + 1
        row, column = np.arange(n + 1) % high, np.arange(n + 1) // high
        seen = np.full((high, k, wide), np.iinfo(np.int16).min, np.int16)
        seen[0, :, 0] = last
        seen[row[1:], own, column[1:]] = np.arange(n)
        for i in range(1, high):
            np.maximum(seen[i], seen[i - 1], out=seen[i])
        np.maximum(seen[:, :, 1:], np.maximum.accumulate(seen[-1], axis=1)[:, :-1], out=seen[:, :, 1:])
        before = np.full((high, wide), np.iinfo(np.int16).max, np.int16)
        before[row[:n], column[:n]] = seen[row[:n], own, column[:n]]
        place = np.add.reduce((seen > before[:, None]).view(np.uint8), axis=1, dtype=np.uint8)
        out[lo : lo + n] = place.T.ravel()[:n]
        last[np.argsort(-seen[row[n], :, column[n]])] = -1 - np.arange(k)
    return out


def move_to_front(column: np.ndarray) -> tuple[list[int], np.ndarray]:
    """(alphabet, symbols): recency ranks with runs of rank 0 as two-digit numerals (see `zero_run`), and the end mark."""
    alphabet = np.flatnonzero(np.bincount(column, minlength=256))
    number = np.zeros(256, np.int64)
    number[alphabet] = np.arange(len(alphabet))
    start = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]]))
    place = recency(number[column[start]], len(alphabet))
    # a run is the place of its first byte, and zeros for the rest of it; only the first run can be all zeros
    moved = place > 0
    rest = np.diff(start, append=len(column)) - moved + 1
    digits = np.frexp(rest)[1] - 1
    size = digits + moved
    end = np.cumsum(size)
    out = np.empty(int(end[-1]) + 1, np.int64)
    out[(end - size)[moved]] = place[moved] + 1
    nth = np.arange(int(digits.sum())) - np.repeat(np.cumsum(digits) - digits, digits)
    out[np.repeat(end - digits, digits) + nth] = np.repeat(rest, digits) >> nth & 1
    out[-1] = len(alphabet) + 1
    return alphabet.tolist(), out


def places(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pos, byte, place) of a buffer's bytes: each byte's place in the list of the most recent ones, which begins as the
    alphabet. Of several values under one key the bytes of a place come at once: none is before another of its place, and
    a further one of a kind there has place 0."""
    if len(parts) == 1:
        recent, out = bytearray(sorted(set(parts[0]))), []
        for value in parts[0]:
            place = recent.index(value)
            if place:
                del recent[place]
                recent.insert(0, value)
            out.append(place)
        return np.arange(len(out)), np.frombuffer(parts[0], np.uint8), np.array(out)
    size = np.array([len(p) for p in parts])
    pos = np.concatenate([np.arange(n) for n in size])
    value = np.frombuffer(b"".join(parts), np.uint8)
    order = np.lexsort((value, pos))
    pos, value = pos[order], value[order]
    first = np.flatnonzero(np.concatenate([[True], (pos[1:] != pos[:-1]) | (value[1:] != value[:-1])]))
    alphabet = np.zeros(256, bool)
    alphabet[value] = True
    seen, place = np.full(256, -1), np.zeros(len(pos), np.int64)
    for at in np.split(first, np.flatnonzero(np.diff(pos[first])) + 1):
        for i in at.tolist():
            b = value[i]
            lower = np.count_nonzero(alphabet[:b] & (seen[:b] < 0)) if seen[b] < 0 else 0
            place[i] = np.count_nonzero(seen > seen[b]) + lower
        seen[value[at]] = pos[at[0]]
    return pos, value, place


def zero_run(n: int) -> list[int]:
    """A run of n zeros in bijective base two, least digit first: the bits of n + 1 below its highest."""
    return [n + 1 >> i & 1 for i in range((n + 1).bit_length() - 1)]


def code_lengths(weights: list[int], most: int = MAX_LENGTH) -> list[int]:
    """Lengths of an optimal prefix code no longer than `most`: those of the tree that joins the two lightest, coins
    before pairs of their weight, if it is no deeper; else by packages of coins. Both give the same where both may."""
    n = len(weights)
    if n == 1:
        return [1]
    order = sorted(range(n), key=weights.__getitem__)
    coins = [weights[s] for s in order]
    sizes = tree_depths(coins)
    lengths = [0] * n
    for s, depth in zip(order, sizes if sizes[0] <= most else packages(coins, most), strict=True):
        lengths[s] = depth
    return lengths


def tree_depths(coins: list[int]) -> list[int]:
    """Depths of ascending weights in the tree of two queues, deepest first."""
    n = len(coins)
    total, parent = [0] * (2 * n - 1), [0] * (2 * n - 1)
    coins = [*coins, sum(coins) + 1]
    leaf, node = 0, n
    for new in range(n, 2 * n - 1):
        if node == new or coins[leaf] <= total[node]:
            a, leaf = leaf, leaf + 1
        else:
            a, node = node, node + 1
        if node == new or coins[leaf] <= total[node]:
            b, leaf = leaf, leaf + 1
        else:
            b, node = node, node + 1
        total[new] = (total[a] if a >= n else coins[a]) + (total[b] if b >= n else coins[b])
        parent[a] = parent[b] = new
    depth = [0] * (2 * n - 1)
    for i in range(2 * n - 3, -1, -1):
        depth[i] = depth[parent[i]] + 1
    return sorted(depth[:n], reverse=True)


def packages(coins: list[int], most: int) -> list[int]:
    """Code lengths of ascending weights: of each level's coins and the pairs of the level below, the 2n - 2 cheapest are
    bought; a length is how many coins were.

    Of each level only the weights are kept. What is bought of it are its cheapest, so some of the cheapest coins and some
    of the first pairs, and those pairs are the cheapest of the level below: going down the levels, a count of coins
    tells which symbols have one."""
    n = len(coins)
    pairs: list[int] = []
    levels = []
    for _ in range(most):
        level = sorted(coins + pairs)[: 2 * n - 2]
        levels.append((level, pairs))
        pairs = list(map(add, level[::2], level[1::2]))
    lengths = [0] * n
    bought = 2 * n - 2
    for level, pairs in reversed(levels):
        if not bought:
            break
        # of equal weights coins come first: all coins up to the last weight bought, as far as there is room
        dearest = level[bought - 1]
        own = min(bisect_right(coins, dearest), bought - bisect_left(pairs, dearest))
        for i in range(own):
            lengths[i] += 1
        bought = 2 * (bought - own)
    return lengths


def canonical(lengths: list[int]) -> list[int]:
    """Codes in the order of (length, symbol)."""
    codes, code, last = [0] * len(lengths), 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths)):
        code <<= n - last
        codes[s], code, last = code, code + 1, n
    return codes


def table_count(n_symbols: int) -> int:
    return 2 + sum(n_symbols >= step for step in TABLE_STEPS)


def first_tables(counts: np.ndarray, n: int) -> np.ndarray:
    """Costs to begin with: each table favours a stretch of the alphabet. A stretch ends where it has its share of the
    symbols that are left, every second one between the first and the last a symbol earlier; the last table gets the
    first stretch."""
    upto = np.concatenate([[0], np.cumsum(counts)])
    cost, at = np.full((n, len(counts)), 15), 0
    for k in range(n):
        share = (upto[-1] - upto[at]) // (n - k)
        to = int(np.searchsorted(upto, upto[at] + share)) if share else at
        to -= k % 2 == 1 and k < n - 1 and to - at > 1
        cost[n - 1 - k, at:to] = 1
        at = to
    return cost


def chosen(groups: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """For each group (counts of symbols) the cheapest table, the first of equals."""
    return np.argmin(groups @ cost.T.astype(groups.dtype), axis=1)


def coding(x: np.ndarray, size: int) -> tuple[np.ndarray, list[list[int]]]:
    """(selectors, code lengths by table)."""
    n = table_count(len(x))
    group = np.arange(len(x)) // GROUP
    # counts and costs are whole numbers far below 2^53, so the products of floats are exact
    groups = np.bincount(group * size + x, minlength=(int(group[-1]) + 1) * size).reshape(-1, size).astype(float)
    cost = first_tables(np.bincount(x, minlength=size), n)
    for _ in range(PASSES):
        pick = chosen(groups, cost)
        counts = (np.arange(n)[:, None] == pick).astype(float) @ groups
        lengths = [code_lengths(own) for own in np.maximum(counts, 1).astype(np.int64).tolist()]
        cost = np.array(lengths)
    return chosen(groups, cost), lengths


class BitWriter:
    """Values and widths, joined most significant bit first."""

    def __init__(self) -> None:
        self.values: list[np.ndarray] = []
        self.widths: list[np.ndarray] = []
        self.few: list[tuple[int, int]] = []

    def put(self, value: int, width: int) -> None:
        while width > 24:
            part = (width - 1) // 24 * 24
            self.few.append((value >> part & 0xFFFFFF, width - part))
            width = part
        self.few.append((value & 0xFFFFFF, width))

    def many(self, values: np.ndarray, widths: np.ndarray) -> None:
        self.gather()
        self.values.append(values.astype(np.int64))
        self.widths.append(widths.astype(np.int64))

    def gather(self) -> None:
        """What was put one by one goes behind the arrays."""
        if self.few:
            values, widths = np.array(self.few, np.int64).T
            self.values.append(values)
            self.widths.append(widths)
            self.few = []

    def bits(self) -> np.ndarray:
        """All bits, one to an element."""
        self.gather()
        values, widths = np.concatenate(self.values), np.concatenate(self.widths)
        nth = np.arange(int(widths.sum())) - np.repeat(np.cumsum(widths) - widths, widths)
        return (np.repeat(values, widths) >> np.repeat(widths, widths) - 1 - nth & 1).astype(np.uint8)


def block_bits(plain_crc: int, packed: np.ndarray) -> np.ndarray:
    """The bits of one block."""
    column, origin = bwt(packed)
    alphabet, symbols = move_to_front(column)
    selectors, lengths = coding(symbols, len(alphabet) + 2)
    w = BitWriter()
    w.put(BLOCK_MAGIC, 48)
    w.put(plain_crc, 32)
    w.put(0, 1)
    w.put(origin, 24)
    used = np.zeros(256, np.int64)
    used[alphabet] = 1
    words = used.reshape(16, 16) @ (1 << np.arange(15, -1, -1))
    w.put(sum(1 << 15 - g for g in np.flatnonzero(words).tolist()), 16)
    w.many(words[words > 0], np.full(np.count_nonzero(words), 16))
    w.put(len(lengths), 3)
    w.put(len(selectors), 15)
    place = recency(selectors, len(lengths))
    w.many((2 << place) - 2, place + 1)
    # a step up is 10, a step down 11, and a 0 ends a length's steps; a table begins with its first length
    sizes = np.array(lengths)
    step = np.diff(sizes, axis=1, prepend=sizes[:, :1])
    up_or_down = ((1 << 2 * np.abs(step)) - 1) // 3 * np.where(step > 0, 2, 3)
    w.many(np.hstack([sizes[:, :1], 2 * up_or_down]).ravel(), np.hstack([np.full((len(sizes), 1), 5), 2 * np.abs(step) + 1]).ravel())
    table = np.repeat(selectors, GROUP)[: len(symbols)]
    w.many(np.array([canonical(n) for n in lengths])[table, symbols], sizes[table, symbols])
    return w.bits()


def end_bits(crcs: list[int]) -> np.ndarray:
    """The bits of the end of a stream."""
    w = BitWriter()
    w.put(END_MAGIC, 48)
    w.put(combined(crcs), 32)
    return w.bits()


def stream(blocks: list[tuple[int, np.ndarray]], level: int) -> bytes:
    """A stream of (checksum, bits) of its blocks."""
    return b"BZh%d" % level + np.packbits(np.concatenate([*(b for _, b in blocks), end_bits([c for c, _ in blocks])])).tobytes()


def cut(data: bytes, level: int) -> list[tuple[bytes, np.ndarray]]:
    """(plaintext, packed bytes) of each block."""
    value, length = runs(data)
    block = packing(packed_size(length), level * LEVEL_UNIT - BLOCK_SLACK)
    out, at = [], 0
    for n in range(int(block[-1]) + 1 if len(block) else 0):
        own = block == n
        size = int(length[own].sum())
        out.append((data[at : at + size], packed_runs(value[own], length[own])))
        at += size
    return out


def compress(data: bytes, level: int = 9) -> bytes:
    if not 1 <= level <= 9:
        raise ValueError("level must be 1 to 9")
    return stream([(c := crc(plain), block_bits(c, packed)) for plain, packed in cut(data, level)], level)


class Encoder:
    """Takes plaintext in chunks; whole blocks are coded as soon as a later run shows that they are full. How the
    input is cut into chunks does not show in the output. Coded bytes can be drained at any time; what is held is the
    plaintext of a block or two, the bits of an unfinished byte, and what has not been drained."""

    def __init__(self, level: int = 9) -> None:
        if not 1 <= level <= 9:
            raise ValueError("level must be 1 to 9")
        self.level, self.kept, self.checksum = level, bytearray(), 0
        self.ready, self.loose = bytearray(b"BZh%d" % level), np.zeros(0, np.uint8)

    def push(self, chunk: bytes) -> None:
        self.kept += chunk
        if len(self.kept) > 2 * self.level * LEVEL_UNIT:
            self.code(cut(bytes(self.kept), self.level)[:-1])

    def code(self, blocks: list[tuple[bytes, np.ndarray]]) -> None:
        for plain, packed in blocks:
            self.take(plain, block_bits(crc(plain), packed))

    def take(self, plain: bytes, bits: np.ndarray) -> None:
        """The bits of the block that begins what is held."""
        self.put(bits)
        self.checksum = combined([self.checksum, crc(plain)])
        del self.kept[: len(plain)]

    def put(self, bits: np.ndarray) -> None:
        bits = np.concatenate([self.loose, bits])
        whole = len(bits) & ~7
        self.ready += np.packbits(bits[:whole]).tobytes()
        self.loose = bits[whole:]

    def drain(self) -> bytes:
        """The whole bytes that are coded and were not drained before."""
        out, self.ready = bytes(self.ready), bytearray()
        return out

    def finish(self) -> bytes:
        """The last block and the end of the stream, with all that was not drained."""
        self.code(cut(bytes(self.kept), self.level))
        self.put(end_bits([self.checksum]))
        self.put(np.zeros(-len(self.loose) % 8, np.uint8))
        return self.drain()
