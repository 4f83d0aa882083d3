"""A strict decoder of the bzip2 format that names what is wrong.

Streams are walked block by block. Bulk decoding is libbz2's (see `plans.parallel` and `functions.kernels`);
this decoder is for streams that libbz2 refuses or is lenient with, and for looking at the stages of a block.
Symbols come from one table look-up on as many bits as the longest code has; the inverse transform is a stable argsort and a walk.
"""

from __future__ import annotations

import bz2
from dataclasses import dataclass, field

import numpy as np

from .format import BLOCK_MAGIC, END_MAGIC, GROUP, LEVEL_UNIT, MAGIC_BITS, MAX_CODE, WORD, CodecError, bits_at, crc, magic_positions


class Bits:
    """A cursor over the bits of a buffer, most significant first."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def read(self, n: int) -> int:
        value = bits_at(self.data, self.at, n)
        self.at += n
        return value

    def ones(self, most: int) -> int | None:
        """How many 1 bits come before the next 0; None if `most` are passed."""
        n = 0
        while self.read(1):
            n += 1
            if n >= most:
                return None
        return n


@dataclass
class Block:
    """A decoded block and, on the way to it, what the stages gave."""

    start: int
    crc: int = 0
    origin: int = 0
    alphabet: list[int] = field(default_factory=list)
    selectors: list[int] = field(default_factory=list)
    lengths: list[list[int]] = field(default_factory=list)
    symbols: list[int] = field(default_factory=list)
    last_column: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint8))
    packed: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint8))
    out: bytes = b""
    end: int = 0


def code_table(lengths: list[int]) -> tuple[np.ndarray, np.ndarray, int]:
    """For each value of as many bits as the longest code has, the symbol and its length (0: no code), for canonical
    codes; and that number of bits. Codes beyond what so many bits can tell, of an overfull set, are left out."""
    most = max(lengths)
    symbol, length = np.zeros(1 << most, np.int32), np.zeros(1 << most, np.int8)
    at = 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths)):
        width = 1 << most - n
        symbol[at : at + width], length[at : at + width] = s, n
        at += width
        if at >= 1 << most:
            break
    return symbol, length, most


def tables_of(bits: Bits, block: Block) -> None:
    """Reads the symbol map, selectors and code lengths of a block."""
    groups = bits.read(16)
    for high in range(16):
        if groups >> 15 - high & 1:
            own = bits.read(16)
            block.alphabet += [16 * high + low for low in range(16) if own >> 15 - low & 1]
    if not block.alphabet:
        raise CodecError("InvalidBlock")
    n_tables = bits.read(3)
    if not 2 <= n_tables <= 6:
        raise CodecError("InvalidHuffman")
    n_selectors = bits.read(15)
    if not n_selectors:
        raise CodecError("InvalidBlock")
    recent = list(range(n_tables))
    for _ in range(n_selectors):
        place = bits.ones(n_tables)
        if place is None:
            raise CodecError("InvalidBlock")
        recent.insert(0, recent.pop(place))
        block.selectors.append(recent[0])
    for _ in range(n_tables):
        n, own = bits.read(5), []
        for _ in range(len(block.alphabet) + 2):
            while True:
                if not 1 <= n <= MAX_CODE:
                    raise CodecError("InvalidHuffman")
                if not bits.read(1):
                    break
                n += 1 - 2 * bits.read(1)
            own.append(n)
        block.lengths.append(own)


def symbols_of(bits: Bits, block: Block, limit: int) -> list[int]:
    """Reads the coded symbols and undoes zero runs and move-to-front: the last column, as byte values."""
    data, total, at = bits.data, 8 * len(bits.data), bits.at
    tables = [code_table(n) for n in block.lengths]
    end = len(block.alphabet) + 1
    recent, column, run, weight, digits = list(block.alphabet), [], 0, 1, 0
    selectors = iter(block.selectors)
    left = 0
    while True:
        if not left:
            chosen = next(selectors, None)
            if chosen is None:
                raise CodecError("InvalidBlock")
            symbol_at, length_at, most = tables[chosen]
            left = GROUP
        left -= 1
        byte = at >> 3
        peek = int.from_bytes(data[byte : byte + 4].ljust(4, b"\0"), "big") >> 12 - (at & 7) & (1 << MAX_CODE) - 1
        peek >>= MAX_CODE - most
        n = int(length_at[peek])
        if not n:
            # a decoder that reads bit by bit finds out one bit after the longest code
            raise CodecError("Truncated" if at + most + 1 > total else "InvalidHuffman")
        at += n
        if at > total:
            raise CodecError("Truncated")
        symbol = int(symbol_at[peek])
        block.symbols.append(symbol)
        if symbol < 2:
            digits += 1
            if digits > 31:
                raise CodecError("BlockOverflow")
            run += (symbol + 1) * weight
            weight *= 2
            if run > limit:
                raise CodecError("BlockOverflow")
            continue
        if digits:
            if len(column) + run > limit:
                raise CodecError("BlockOverflow")
            column += [recent[0]] * run
            run, weight, digits = 0, 1, 0
        if symbol == end:
            bits.at = at
            return column
        if len(column) >= limit:
            raise CodecError("BlockOverflow")
        recent.insert(0, recent.pop(symbol - 1))
        column.append(recent[0])


def inverse_bwt(column: np.ndarray, origin: int) -> np.ndarray:
    """The block whose sorted rotations have this last column, from the row of the unrotated block."""
    follow = np.argsort(column, kind="stable")
    # rows in the order of the walk, by doubling: after k rounds, 2^k steps are known
    n = len(column)
    order = np.empty(n, np.int64)
    order[0] = follow[origin]
    jump, known = follow, 1
    while known < n:
        more = min(known, n - known)
        order[known : known + more] = jump[order[:more]]
        known += more
        if known < n:
            jump = jump[jump]
    return column[order]


def expanded(packed: np.ndarray) -> bytes:
    """Undoes the first run-length step: the byte after four equal ones tells how many more there are."""
    raw = packed.tobytes()
    out, at, n = bytearray(), 0, len(raw)
    if n >= 4:
        same = packed[1:] == packed[:-1]
        four = np.flatnonzero(same[:-2] & same[1:-1] & same[2:])
        for i in four.tolist():
            if i < at:
                continue
            out += raw[at : i + 4]
            if i + 4 < n:
                out += raw[i : i + 1] * raw[i + 4]
            at = i + 5
    out += raw[at:]
    return bytes(out)


def read_block(data: bytes, start: int, limit: int) -> Block:
    """Decodes the block whose magic number begins at bit `start`."""
    bits = Bits(data, start + MAGIC_BITS)
    block = Block(start)
    block.crc = bits.read(32)
    if bits.read(1):
        raise CodecError("RandomizedBlock")
    block.origin = bits.read(24)
    tables_of(bits, block)
    column = symbols_of(bits, block, limit)
    if not column or block.origin >= len(column):
        raise CodecError("InvalidBlock")
    block.last_column = np.array(column, np.uint8)
    block.packed = inverse_bwt(block.last_column, block.origin)
    block.out = expanded(block.packed)
    if crc(block.out) != block.crc:
        raise CodecError("CrcMismatch")
    block.end = bits.at
    return block


@dataclass
class State:
    """Where a walk stands between pieces; enough to go on with more input."""

    bit: int = 0
    level: int = 0  # 0: a header is due
    checksum: int = 0


def step(data: bytes, state: State) -> Block | None | bool:
    """Reads one header, block or end of stream. A block is returned, True stands for the others, None for the end
    of input. `state` moves on only if all went well."""
    if not state.level:
        at = state.bit + 7 & ~7
        rest = len(data) - (at >> 3)
        if rest <= 0:
            return None
        if rest < 4:
            raise CodecError("Truncated")
        head = data[at >> 3 : (at >> 3) + 4]
        if head[:3] != b"BZh":
            raise CodecError("InvalidMagic")
        if not 0x31 <= head[3] <= 0x39:
            raise CodecError("InvalidLevel")
        state.bit, state.level, state.checksum = at + 32, head[3] - 0x30, 0
        return True
    magic = bits_at(data, state.bit, MAGIC_BITS)
    if magic == BLOCK_MAGIC:
        block = read_block(data, state.bit, state.level * LEVEL_UNIT)
        state.bit = block.end
        state.checksum = ((state.checksum << 1 | state.checksum >> 31) ^ block.crc) & WORD
        return block
    if magic != END_MAGIC:
        raise CodecError("InvalidMagic")
    if bits_at(data, state.bit + MAGIC_BITS, 32) != state.checksum:
        raise CodecError("CrcMismatch")
    state.bit, state.level = state.bit + MAGIC_BITS + 32, 0
    return True


def blocks(data: bytes, state: State | None = None):
    """Blocks of the concatenated streams, in order; CodecError where they are invalid."""
    state = state or State()
    done = []
    while True:
        try:
            found = step(data, state)
        except CodecError as e:
            raise CodecError(e.kind, state.bit, b"".join(done)) from None
        if found is None:
            return
        if found is not True:
            done.append(found.out)
            yield found


def strict(data: bytes) -> bytes:
    """Plaintext of the concatenated streams by this decoder alone."""
    return b"".join(b.out for b in blocks(data))


def trusted(data: bytes) -> bytes | None:
    """Plaintext by libbz2, or None where it refuses or would let something pass that is not allowed: anything
    but whole streams end to end, or a block with the randomized bit."""
    out, rest = [], data
    while rest:
        if rest[:3] != b"BZh":
            return None
        one = bz2.BZ2Decompressor()
        try:
            out.append(one.decompress(rest))
        except (OSError, ValueError):
            return None
        if not one.eof:
            return None
        rest = one.unused_data
    for at in magic_positions(data).tolist():
        if at + 81 <= 8 * len(data) and bits_at(data, at + 80, 1):
            return None
    return b"".join(out)


def decompress(data: bytes) -> bytes:
    """Plaintext of the concatenated streams, or CodecError. Empty input is empty output."""
    out = trusted(data)
    if out is None:
        from .walk import Walk  # goes on at libbz2's speed up to what is wrong

        out = b"".join([p.out for p in Walk(bytearray(data)).pieces(True)])
    return out


def error_of(data: bytes) -> str | None:
    try:
        decompress(data)
    except CodecError as e:
        return e.kind
    return None
