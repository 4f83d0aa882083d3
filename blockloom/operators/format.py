"""The bzip2 stream format: fixed values, error names and the checksum."""

from __future__ import annotations

import numpy as np

#: Fixed values of the format.
BLOCK_MAGIC = 0x314159265359
END_MAGIC = 0x177245385090
MAGIC_BITS = 48
LEVEL_UNIT = 100_000
#: Bytes of a block that an encoder leaves unused.
BLOCK_SLACK = 19
MAX_BLOCK = 9 * LEVEL_UNIT
GROUP = 50
MAX_CODE = 20
MAX_RUN = 259
CRC_POLYNOMIAL = 0x04C11DB7
WORD = 0xFFFFFFFF

ERRORS = ("Truncated", "InvalidMagic", "InvalidLevel", "RandomizedBlock", "InvalidBlock", "InvalidHuffman", "BlockOverflow", "CrcMismatch")


class CodecError(ValueError):
    """An invalid stream. `kind` is one of ERRORS; `bit` is where the last whole piece (header, block or end of
    stream) ended, and `done` the plaintext up to there."""

    def __init__(self, kind: str, bit: int = 0, done: bytes = b"") -> None:
        super().__init__(kind)
        self.kind, self.bit, self.done = kind, bit, done


def crc_table() -> list[int]:
    """Remainders of all bytes, most significant bit first."""
    out = []
    for byte in range(256):
        r = byte << 24
        for _ in range(8):
            r = (r << 1 ^ (CRC_POLYNOMIAL if r >> 31 else 0)) & WORD
        out.append(r)
    return out


CRC_TABLE = crc_table()
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def crc(data: bytes) -> int:
    """CRC-32 with the most significant bit first: zlib's, on bytes and result with their bits reversed."""
    import zlib

    return int(f"{zlib.crc32(data.translate(_REVERSED)):032b}"[::-1], 2)


def combined(crcs: list[int]) -> int:
    """Checksum of a stream from those of its blocks."""
    c = 0
    for x in crcs:
        c = ((c << 1 | c >> 31) ^ x) & WORD
    return c


def bits_at(data: bytes, bit: int, n: int) -> int:
    """n bits from a bit offset, most significant first; Truncated past the end."""
    if bit + n > 8 * len(data):
        raise CodecError("Truncated")
    first, last = bit >> 3, bit + n + 7 >> 3
    return int.from_bytes(data[first:last], "big") >> 8 * last - bit - n & (1 << n) - 1


def shifted(data: bytes, start: int, end: int) -> tuple[int, int]:
    """The bits from start to end as a number, and how many."""
    return bits_at(data, start, end - start), end - start


def rehomed(data: bytes, start: int, end: int, level: int) -> bytes:
    """The block at bits start to end as a stream of its own of the given level."""
    body, n = shifted(data, start, end)
    body = body << 48 | END_MAGIC
    body = body << 32 | bits_at(data, start + MAGIC_BITS, 32)
    n += 80
    pad = -n % 8
    return b"BZh%d" % level + (body << pad).to_bytes((n + pad) // 8, "big")


def _needles(magic: int) -> list[tuple[bytes, int]]:
    """For each place within a byte that a magic number may begin at: the five or six whole bytes that it covers, and
    how many of its bits come before them."""
    found = []
    for s in range(8):
        # begins s bits into a byte: 8 - s bits in that byte if s, then whole bytes, then s bits
        whole = (magic >> s & (1 << 40) - 1).to_bytes(5, "big") if s else magic.to_bytes(6, "big")
        found.append((whole, 8 - s if s else 0))
    return found


NEEDLES = {m: _needles(m) for m in (BLOCK_MAGIC, END_MAGIC)}


def magic_positions(data: bytes, start: int = 0, stop: int | None = None, magics=(BLOCK_MAGIC,)) -> np.ndarray:
    """Bit offsets in [start, stop) at which a magic number stands, in order: a bytes search for the whole bytes that
    it covers, for each place within a byte."""
    stop = 8 * len(data) if stop is None else stop
    found = []
    for magic in magics:
        for whole, lead in NEEDLES[magic]:
            at = data.find(whole, start + lead >> 3)
            while at >= 0:
                bit = 8 * at - lead
                if bit >= stop:
                    break
                if bit >= start and bit + MAGIC_BITS <= 8 * len(data) and bits_at(data, bit, MAGIC_BITS) == magic:
                    found.append(bit)
                at = data.find(whole, at + 1)
    return np.array(sorted(found), np.int64)


def first_magic(data: bytes, start: int) -> int | None:
    """The first bit offset from `start` on at which a magic number stands, or None."""
    best, last = None, len(data)
    for magic, needles in NEEDLES.items():
        for whole, lead in needles:
            at = data.find(whole, start + lead >> 3, last)
            while at >= 0:
                bit = 8 * at - lead
                if bit >= start and bit + MAGIC_BITS <= 8 * len(data) and bits_at(data, bit, MAGIC_BITS) == magic:
                    if best is None or bit < best:
                        best, last = bit, min(len(data), (bit >> 3) + 8)
                    break
                at = data.find(whole, at + 1, last)
    return best
