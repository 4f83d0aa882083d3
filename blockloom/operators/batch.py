"""The encoder over many short texts at once: the same stages and bytes as `encoder.compress`, whose array calls each
take in the blocks of many streams. Blocks lie end to end in flat arrays; what a stage needs of a block is its bounds.
"""

from __future__ import annotations

import numpy as np

from .encoder import FIRST_BYTES, MAX_LENGTH, PASSES, Encoder, compress, cut, first_tables, packages, packed_runs, packed_size, recency, table_count
from .format import BLOCK_MAGIC, BLOCK_SLACK, END_MAGIC, GROUP, LEVEL_UNIT, MAX_RUN, combined, crc

#: Bytes of texts that are coded at once, whose arrays stay in a core's cache; a longer text is coded alone.
BATCH_BYTES = 1 << 17
#: Symbols of the largest alphabet, and a weight above all sums.
WIDTH, HUGE = 258, 1 << 40


def firsts(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where runs of equal bytes begin; a run ends with its block."""
    new = np.concatenate([[True], x[1:] != x[:-1]])
    new[bounds[:-1]] = True
    return np.flatnonzero(new)


def whole(datas: list[bytes], limit: int) -> list[bytes | np.ndarray | None]:
    """The packed bytes of each text that fits in one block, None for one that doesn't. No text is empty."""
    bounds = np.cumsum([0, *map(len, datas)])
    x = np.frombuffer(b"".join(datas), np.uint8)
    start = firsts(x, bounds)
    size = np.diff(start, append=len(x))
    if size.max() > MAX_RUN:
        pieces = -(-size // MAX_RUN)
        length = np.full(int(pieces.sum()), MAX_RUN, np.int64)
        length[np.cumsum(pieces) - 1] = size - (pieces - 1) * MAX_RUN
        nth = np.concatenate([[0], np.cumsum(pieces)])[np.searchsorted(start, bounds)]
        value = np.repeat(x[start], pieces)
    else:
        length, nth, value = size, np.searchsorted(start, bounds), x[start]
    ends = np.concatenate([[0], np.cumsum(packed_size(length))])[nth]
    packed = packed_runs(value, length)
    return [packed[a:b] if b - a <= limit else None for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def bwts(x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(last columns, row of each unrotated block) of the sorted rotations, of equal ones the later start first. First
    bytes are sorted a block at a time; of the rows that they leave equal, and of these alone, prefixes are doubled."""
    n = np.diff(bounds)
    size, low = np.repeat(n, n), np.repeat(bounds[:-1], n)
    at = np.arange(len(x))
    # the first bytes of a rotation, those near a block's end go on at its beginning
    longer = np.concatenate([x, np.zeros(FIRST_BYTES, np.uint8)])
    key = longer[: len(x)].astype(np.int64)
    for i in range(1, FIRST_BYTES):
        key <<= 8
        key |= longer[i : len(x) + i]
    turned = np.unique(np.maximum((bounds[1:, None] - np.arange(1, FIRST_BYTES)).ravel(), np.repeat(bounds[:-1], FIRST_BYTES - 1)))
    key[turned] = 0
    for i in range(FIRST_BYTES):
        key[turned] = key[turned] << 8 | x[low[turned] + (turned - low[turned] + i) % size[turned]]
    edges = bounds.tolist()
    order = np.concatenate([np.argsort(key[a:b]) + a for a, b in zip(edges[:-1], edges[1:], strict=True)])
    ranked = key[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    new[bounds[:-1]] = True
    rank = np.empty(len(x), np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, at, 0))
    left, width = np.flatnonzero(~(new & np.append(new[1:], True))), FIRST_BYTES
    while len(left):
        p = order[left]
        own, base = size[p], low[p]
        # equal over a whole turn: the later start first
        turn = p + width
        turn = np.where(turn >= base + own, turn - own, turn)
        second = np.where(width >= own, own - 1 - (p - base), rank[np.minimum(turn, len(x) - 1)])
        both = rank[p] * len(x) + second
        by = np.argsort(both)
        p, both = p[by], both[by]
        order[left] = p
        new = np.concatenate([[True], both[1:] != both[:-1]])
        rank[p] = np.maximum.accumulate(np.where(new, left, 0))
        left, width = left[~(new & np.append(new[1:], True))], 2 * width
    before = at - 1
    before[bounds[:-1]] = bounds[1:] - 1
    row = np.empty(len(x), np.int64)
    row[order] = at
    return x[before[order]], row[bounds[:-1]] - bounds[:-1]


def moved(column: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes in use by block, symbols, bounds of each block's symbols), see `encoder.move_to_front`."""
    n_blocks = len(bounds) - 1
    of = np.repeat(np.arange(n_blocks), np.diff(bounds))
    used = np.bincount(of * 256 + column, minlength=n_blocks * 256).reshape(-1, 256) > 0
    number, k = np.cumsum(used, axis=1) - 1, used.sum(axis=1)
    start = firsts(column, bounds)
    edges = np.searchsorted(start, bounds)
    value = number[of[start], column[start]]
    place = np.concatenate([recency(value[a:b], m) for a, b, m in zip(edges[:-1].tolist(), edges[1:].tolist(), k.tolist(), strict=True)])
    some = place > 0
    rest = np.diff(start, append=len(column)) - some + 1
    digits = np.zeros(len(rest), np.int64)
    many = rest > 1
    digits[many] = np.frexp(rest[many])[1] - 1
    size = digits + some
    size[edges[1:] - 1] += 1
    end = np.cumsum(size)
    begin = end - size
    out = np.empty(int(end[-1]), np.int64)
    out[begin[some]] = place[some] + 1
    first, rest, digits = (begin + some)[many], rest[many], digits[many]
    nth = np.arange(int(digits.sum())) - np.repeat(np.cumsum(digits) - digits, digits)
    out[np.repeat(first, digits) + nth] = np.repeat(rest, digits) >> nth & 1
    upto = np.concatenate([[0], end[edges[1:] - 1]])
    out[upto[1:] - 1] = k + 1
    return used, out, upto


def code_lengths(weights: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The code lengths of many tables, a row of weights each of which the first n count: `encoder.code_lengths` with
    the trees of all rows grown at once, a pair in each at a time."""
    rows = np.argsort(-n, kind="stable")
    n = n[rows]
    t, most = len(n), int(n[0])
    inside = np.arange(most) < n[:, None]
    key = np.sort(np.where(inside, weights[rows, :most] << 9 | np.arange(most), HUGE << 9), axis=1)
    coins = np.concatenate([key >> 9, np.full((t, 1), HUGE)], axis=1)
    total = np.full((t, most), 2 * HUGE)
    parent = np.zeros((t, 2 * most), np.int64)  # of coins, then of pairs
    flat_coins, flat_total, flat_parent = coins.ravel(), total.ravel(), parent.ravel()
    coin, pair = np.arange(t) * (most + 1), np.arange(t) * most
    coin_shift, pair_shift = np.arange(t) * (most - 1), np.arange(t) * most + most
    active = np.searchsorted(-n, -np.arange(1, most), "left").tolist()  # rows with more than so many coins
    for new, a in enumerate(active):
        weight = 0
        for _ in range(2):
            c, p = flat_coins[coin[:a]], flat_total[pair[:a]]
            light = c <= p
            weight = weight + np.where(light, c, p)
            flat_parent[np.where(light, coin[:a] + coin_shift[:a], pair[:a] + pair_shift[:a])] = new
            coin[:a] += light
            pair[:a] += ~light
        total[:a, new] = weight
    depth = np.zeros((t, most), np.int64)
    flat_depth, base = depth.ravel(), np.arange(t) * most
    for i in range(most - 3, -1, -1):
        a = active[i + 1]
        depth[:a, i] = flat_depth[base[:a] + parent[:a, most + i]] + 1
    sizes = np.where(inside, np.take_along_axis(depth, parent[:, :most], 1) + 1, 0)
    sizes = -np.sort(-sizes, axis=1)
    for r in np.flatnonzero(sizes[:, 0] > MAX_LENGTH).tolist():
        sizes[r, : n[r]] = packages(coins[r, : n[r]].tolist(), MAX_LENGTH)
    out = np.zeros((t, WIDTH), np.int64)
    r, c = np.nonzero(inside)
    out[rows[r], key[r, c] & 511] = sizes[r, c]
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes of tables, a row each, in the order of (length, symbol): from the running sum of the shares that shorter
    codes take of all numbers of MAX_LENGTH bits. Lengths of 0 have none."""
    key = np.sort(np.where(lengths > 0, lengths, 99) << 9 | np.arange(lengths.shape[1]), axis=1)
    size, symbol = np.minimum(key >> 9, MAX_LENGTH), key & 511
    share = 1 << MAX_LENGTH - size
    out = np.empty_like(lengths)
    np.put_along_axis(out, symbol, np.cumsum(share, axis=1) - share >> MAX_LENGTH - size, 1)
    return out


def codings(x: np.ndarray, bounds: np.ndarray, k: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(selectors of each block, code lengths of all tables, bounds of each block's tables), see `encoder.coding`."""
    groups, costs = [], []
    for a, b, size in zip(bounds[:-1].tolist(), bounds[1:].tolist(), (k + 2).tolist(), strict=True):
        n = -(-(b - a) // GROUP)
        # counts and costs are whole numbers, their sums far below 2^24, so floats are exact
        own = np.bincount(np.arange(b - a) // GROUP * size + x[a:b], minlength=n * size).reshape(n, size)
        groups.append(own.astype(np.float32))
        costs.append(first_tables(own.sum(axis=0), table_count(b - a)))
    tables = np.cumsum([0, *map(len, costs)])
    spans = list(zip(tables[:-1].tolist(), tables[1:].tolist(), (k + 2).tolist(), strict=True))
    weights, sizes = np.ones((int(tables[-1]), WIDTH), np.int64), np.repeat(k + 2, np.diff(tables))
    lengths, last = None, [None] * len(groups)
    for _ in range(PASSES):
        changed = np.zeros(len(weights), bool)
        for i, (own, cost, (a, b, size)) in enumerate(zip(groups, costs, spans, strict=True)):
            pick = cheapest(own, cost)
            if last[i] is None or not np.array_equal(pick, last[i]):
                counts = (np.arange(b - a)[:, None] == pick).astype(np.float32) @ own
                weights[a:b, :size] = np.maximum(counts, 1)
                changed[a:b], last[i] = True, pick
        # the same choices give the same tables
        if lengths is None:
            lengths = code_lengths(weights, sizes)
        elif changed.any():
            lengths[changed] = code_lengths(weights[changed], sizes[changed])
        costs = [lengths[a:b, :size] for a, b, size in spans]
    return [cheapest(own, cost) for own, cost in zip(groups, costs, strict=True)], lengths, tables


def cheapest(groups: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """For each group the cheapest table, the first of equals."""
    return (cost.astype(np.float32) @ groups.T).argmin(axis=0)


def coded(blocks: list[tuple[int, np.ndarray]]) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """For each block (checksum, packed bytes) its bits, as (values, widths) of up to 24 bits, see `encoder.block_bits`."""
    bounds = np.cumsum([0, *(len(p) for _, p in blocks)])
    column, origin = bwts(np.concatenate([p for _, p in blocks]), bounds)
    used, symbols, upto = moved(column, bounds)
    k = used.sum(axis=1)
    picks, lengths, tables = codings(symbols, upto, k)
    words = used.reshape(-1, 16, 16) @ (1 << np.arange(15, -1, -1))
    high = (words > 0) @ (1 << np.arange(15, -1, -1))
    table = np.repeat(np.repeat(tables[:-1], [len(p) for p in picks]) + np.concatenate(picks), group_sizes(upto))
    code, width = canonical(lengths)[table, symbols], lengths[table, symbols]
    # a table's first length, and from each length to the next 10 for a step up, 11 for one down, then a 0
    step = np.diff(lengths, axis=1, prepend=lengths[:, :1])
    up_or_down = ((1 << 2 * np.abs(step)) - 1) // 3 * np.where(step > 0, 2, 3)
    steps, step_widths = np.hstack([lengths[:, :1], 2 * up_or_down]), np.hstack([np.full((len(lengths), 1), 5), 2 * np.abs(step) + 1])
    out = []
    for i, (checksum, _) in enumerate(blocks):
        a, b, size = int(tables[i]), int(tables[i + 1]), int(k[i]) + 3
        place = recency(picks[i], b - a)
        own = words[i][words[i] > 0]
        fixed = [BLOCK_MAGIC >> 24, BLOCK_MAGIC & 0xFFFFFF, checksum >> 16, checksum & 0xFFFF, 0, int(origin[i]), int(high[i]), *own.tolist(), b - a, len(picks[i])]
        out.append([
            (np.array(fixed), np.array([24, 24, 16, 16, 1, 24, 16, *[16] * len(own), 3, 15])),
            ((2 << place) - 2, place + 1),
            (steps[a:b, :size].ravel(), step_widths[a:b, :size].ravel()),
            (code[upto[i] : upto[i + 1]], width[upto[i] : upto[i + 1]]),
        ])
    return out


def group_sizes(upto: np.ndarray) -> np.ndarray:
    """How many symbols each group of each block has: GROUP, the last of a block what is left."""
    n = np.diff(upto)
    groups = -(-n // GROUP)
    out = np.full(int(groups.sum()), GROUP)
    out[np.cumsum(groups) - 1] = n - (groups - 1) * GROUP
    return out


def joined(values: np.ndarray, widths: np.ndarray) -> bytes:
    """Values of up to 33 bits, joined most significant bit first. A value touches two words of 32 bits at most; the bits
    in a word are disjoint, so that its sum of floats is exact."""
    end = np.cumsum(widths)
    word, n = end - widths >> 5, int(end[-1] + 31 >> 5)
    shifted = values.astype(np.uint64) << (64 - (end - widths & 31) - widths).astype(np.uint64)
    sums = np.bincount(word, (shifted >> np.uint64(32)).astype(float), n + 1)[:n]
    sums[1:] += np.bincount(word + 1, (shifted & np.uint64(0xFFFFFFFF)).astype(float), n + 1)[1:n]
    return sums.astype(">u4").tobytes()[: int(end[-1]) + 7 >> 3]


def compress_together(datas: list[bytes], level: int) -> list[bytes]:
    """Streams of texts, none empty, all at once."""
    blocks, n_blocks = [], []
    for data, packed in zip(datas, whole(datas, level * LEVEL_UNIT - BLOCK_SLACK), strict=True):
        own = [(crc(data), packed)] if packed is not None else [(crc(plain), p) for plain, p in cut(data, level)]
        blocks += own
        n_blocks.append(len(own))
    bits = iter(coded(blocks))
    pieces, ends, at, nth = [], [0], 0, 0
    for n in n_blocks:
        checksum = combined([c for c, _ in blocks[nth : nth + n]])
        nth += n
        own = [(np.array([0x425A, 0x6830 + level]), np.array([16, 16]))]
        own += [part for _ in range(n) for part in next(bits)]
        own.append((np.array([END_MAGIC >> 24, END_MAGIC & 0xFFFFFF, checksum >> 16, checksum & 0xFFFF]), np.array([24, 24, 16, 16])))
        size = sum(int(w.sum()) for _, w in own)
        own.append((np.zeros(1, np.int64), np.array([-size % 8])))
        at += size + 7 >> 3
        ends.append(at)
        pieces += own
    out = joined(np.concatenate([v for v, _ in pieces]), np.concatenate([w for _, w in pieces]))
    return [out[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def finish_all(encoders: list[Encoder]) -> list[bytes]:
    """`Encoder.finish` of each, the blocks of those that hold BATCH_BYTES together at once."""
    out: list[bytes] = []
    some, held = [], 0
    for e in [*encoders, None]:
        if some and (e is None or held + len(e.kept) > BATCH_BYTES):
            cuts = [cut(bytes(own.kept), own.level) for own in some]
            blocks = [(crc(plain), packed) for own in cuts for plain, packed in own]
            bits = iter(coded(blocks) if blocks else [])
            for own, cuts_of in zip(some, cuts, strict=True):
                for plain, _ in cuts_of:
                    parts = next(bits)
                    values, widths = (np.concatenate(x) for x in zip(*parts, strict=True))
                    own.take(plain, np.unpackbits(np.frombuffer(joined(values, widths), np.uint8), count=int(widths.sum())))
                out.append(own.finish())
            some, held = [], 0
        if e is not None:
            some.append(e)
            held += len(e.kept)
    return out


def compress_all(datas: list[bytes], level: int) -> list[bytes]:
    """`encoder.compress` of each text, those of BATCH_BYTES together at once."""
    out: list[bytes | None] = [None if d else compress(d, level) for d in datas]
    some, held = [], 0
    for i in [*(i for i, d in enumerate(datas) if d), None]:
        if some and (i is None or held + len(datas[i]) > BATCH_BYTES):
            for j, packed in zip(some, compress_together([datas[j] for j in some], level), strict=True):
                out[j] = packed
            some, held = [], 0
        if i is not None:
            some.append(i)
            held += len(datas[i])
    return out
