"""Checksums of the format as column expressions.

The format's CRC takes bits from the top, the JVM's built-in CRC-32 from the bottom: with the bits of each byte
and of the result reversed they are the same. So the built-in runs over the bytes; no per-byte expression does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NIBBLES = "0123456789ABCDEF"
_MIRRORED = "".join(f"{int(f'{int(c, 16):04b}'[::-1], 2):X}" for c in _NIBBLES)


def crc32_bzip2(data: Column) -> Column:
    """CRC-32 of a binary column, 0 to 2^32 - 1; null for null."""
    mirrored = F.unhex(F.regexp_replace(F.translate(F.hex(data), _NIBBLES, _MIRRORED), "(.)(.)", "$2$1"))
    bits = F.reverse(F.lpad(F.bin(F.crc32(mirrored)), 32, "0"))
    return F.conv(bits, 2, 10).cast("long")


def rotated(crc: Column, by: Column) -> Column:
    """A 32-bit number rotated left by `by` bits."""
    n = F.pmod(by, F.lit(32)).cast("int")
    high, low = F.call_function("shiftleft", crc, n), F.call_function("shiftright", crc, 32 - n)
    return (high.bitwiseAND(0xFFFFFFFF)).bitwiseOR(F.when(n == 0, 0).otherwise(low))


def bz2_combined_crc(crc: Column, ordinal: Column, total: Column) -> Column:
    """Aggregate: the stream's checksum from its blocks'. A later block rotates all earlier ones by one bit, so the
    fold is an exclusive or of rotated values, partial sums included."""
    return F.bit_xor(rotated(crc, total - 1 - ordinal))
