"""A strict walk over streams that come in pieces, at libbz2's speed.

After a block comes a magic number, that of the next block or of the end. So a block ends at the next magic number
after its own: the bits up to there are given to libbz2 as a stream of one block. Only where libbz2 refuses (damage, or
bits that look like a magic number) does the strict decoder look, which finds the true end or names the error. Input
is searched once, and a block is decoded once, when its end is in sight.
"""

from __future__ import annotations

import bz2
from dataclasses import dataclass, field

from .decoder import read_block
from .format import BLOCK_MAGIC, END_MAGIC, LEVEL_UNIT, MAGIC_BITS, MAX_BLOCK, MAX_CODE, WORD, CodecError, bits_at, first_magic, rehomed

#: No block takes more bytes: its symbols with the longest codes, and its tables.
MAX_PACKED = MAX_BLOCK * MAX_CODE // 8 + (1 << 17)
#: Decoded bytes are cut off when there are so many.
TRIM = 1 << 16


def decoded_block(data: bytes, start: int, end: int, level: int) -> bytes | None:
    """Plaintext of the block at bits start to end by libbz2, None if it refuses or the randomized bit is set."""
    if end - start < MAGIC_BITS + 33 or bits_at(data, start + MAGIC_BITS + 32, 1):
        return None
    one = bz2.BZ2Decompressor()
    try:
        out = one.decompress(rehomed(data, start, end, level))
    except (OSError, ValueError):
        return None
    return out if one.eof and not one.unused_data else None


@dataclass
class Piece:
    """A header (`level`), a block (`out` and its checksum) or an end of stream (the stored checksum), by absolute bits."""

    kind: str
    start: int
    end: int
    level: int = 0
    crc: int = 0
    out: bytes = b""


@dataclass
class Walk:
    """Where a walk stands: `data` holds the bytes from `base` on, the next piece begins `bit` bits into them. With
    level 0 a header is due. A checksum of None belongs to a stream whose beginning was not seen; it is not checked."""

    data: bytearray = field(default_factory=bytearray)
    bit: int = 0
    level: int = 0
    checksum: int | None = 0
    base: int = 0
    searched: int = 0  # bit up to which there is no magic number after the block's own
    wanted: int = 0  # bytes to wait for before the strict decoder looks again

    def add(self, chunk: bytes) -> None:
        self.data += chunk

    @property
    def at(self) -> int:
        return 8 * self.base + self.bit

    def pieces(self, ended: bool):
        """What is complete, in order; CodecError where the streams are invalid. `ended`: no more input comes."""
        while piece := self.piece(ended):
            yield piece

    def piece(self, ended: bool) -> Piece | None:
        found = self.block_or_end(ended) if self.level else self.header(ended)
        if found:
            self.bit, self.searched, self.wanted = found.end - 8 * self.base, 0, 0
            if self.bit >> 3 >= TRIM:
                self.trim()
        return found

    def trim(self) -> None:
        whole = self.bit >> 3
        del self.data[:whole]
        self.base, self.bit, self.searched = self.base + whole, self.bit & 7, max(0, self.searched - 8 * whole)

    def header(self, ended: bool) -> Piece | None:
        at = self.bit + 7 >> 3
        head = bytes(self.data[at : at + 4])
        if len(head) < 4:
            if head and ended:
                raise CodecError("Truncated", self.at)
            return None
        if head[:3] != b"BZh":
            raise CodecError("InvalidMagic", self.at)
        if not 0x31 <= head[3] <= 0x39:
            raise CodecError("InvalidLevel", self.at)
        self.level, self.checksum = head[3] - 0x30, 0
        return Piece("head", self.at, 8 * (self.base + at + 4), self.level)

    def block_or_end(self, ended: bool) -> Piece | None:
        have = 8 * len(self.data) - self.bit
        if have < MAGIC_BITS + 32:
            known = bits_at(self.data, self.bit, MAGIC_BITS) if have >= MAGIC_BITS else None
            if known not in (None, BLOCK_MAGIC, END_MAGIC):
                raise CodecError("InvalidMagic", self.at)
            if ended:
                raise CodecError("Truncated", self.at)
            return None
        magic, stored = bits_at(self.data, self.bit, MAGIC_BITS), bits_at(self.data, self.bit + MAGIC_BITS, 32)
        if magic == BLOCK_MAGIC:
            return self.block(ended, stored)
        if magic != END_MAGIC:
            raise CodecError("InvalidMagic", self.at)
        if self.checksum not in (None, stored):
            raise CodecError("CrcMismatch", self.at)
        self.level = 0
        return Piece("end", self.at, self.at + MAGIC_BITS + 32, crc=stored)

    def block(self, ended: bool, stored: int) -> Piece | None:
        start = max(self.bit + MAGIC_BITS, self.searched)
        hit = first_magic(self.data, start)
        end, out = hit, None
        if hit is not None:
            out = decoded_block(self.data, self.bit, hit, self.level)
        else:
            self.searched = max(start, 8 * len(self.data) - MAGIC_BITS - 7)
        if out is None:
            if not ended and (len(self.data) < self.wanted or hit is None and 8 * len(self.data) - self.bit < 8 * MAX_PACKED):
                return None
            try:
                found = read_block(bytes(self.data), self.bit, self.level * LEVEL_UNIT)
            except CodecError as e:
                if e.kind != "Truncated" or ended:
                    raise CodecError(e.kind, self.at) from None
                self.wanted = 2 * len(self.data)
                return None
            end, out = found.end, found.out
        if self.checksum is not None:
            self.checksum = ((self.checksum << 1 | self.checksum >> 31) ^ stored) & WORD
        return Piece("block", self.at, 8 * self.base + end, self.level, stored, out)
