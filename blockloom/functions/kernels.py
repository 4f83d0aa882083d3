"""Scalar codec functions over binary columns, Arrow batch by Arrow batch."""

from __future__ import annotations

import bz2

import pyarrow as pa
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType, StringType

from ..operators import batch, decoder, encoder
from ..operators.format import CodecError


def compress_bytes(data: bytes, level: int) -> bytes:
    return bz2.compress(data, level) if data else encoder.compress(b"", level)


def _tried(data: bytes | None) -> bytes | None:
    try:
        return None if data is None else decoder.decompress(data)
    except CodecError:
        return None


@arrow_udf(BinaryType())
def bz2_compress(data: pa.Array, level: pa.Array) -> pa.Array:
    """One stream of the given level (1 to 9); null for null data and for any other level."""
    rows = zip(data.to_pylist(), level.to_pylist(), strict=True)
    return pa.array([compress_bytes(d, n) if d is not None and n and 1 <= n <= 9 else None for d, n in rows], pa.binary())


@arrow_udf(BinaryType())
def bz2_encode(data: pa.Array, level: pa.Array) -> pa.Array:
    """As bz2_compress, by this package's own encoder, which takes the texts of a level together."""
    texts, levels = data.to_pylist(), level.to_pylist()
    out: list[bytes | None] = [None] * len(texts)
    for n in {n for n in levels if n and 1 <= n <= 9}:
        own = [i for i, (d, m) in enumerate(zip(texts, levels, strict=True)) if d is not None and m == n]
        for i, packed in zip(own, batch.compress_all([texts[i] for i in own], n), strict=True):
            out[i] = packed
    return pa.array(out, pa.binary())


@arrow_udf(BinaryType())
def bz2_decompress(data: pa.Array) -> pa.Array:
    """Plaintext of one or more streams; null where they are invalid (see bz2_error)."""
    return pa.array([_tried(d) for d in data.to_pylist()], pa.binary())


@arrow_udf(StringType())
def bz2_error(data: pa.Array) -> pa.Array:
    """Name of what is wrong with the streams, or null."""
    return pa.array([None if d is None else decoder.error_of(d) for d in data.to_pylist()], pa.string())
