"""Reading a part of a file: the blocks that begin in a byte range, whoever reads the rest.

A range that doesn't start the file finds its first block by the one before it, which is decoded for its end: bits
that merely look like a magic number don't decode. From there on the walk is strict. The checksum of a stream that
began in an earlier range is checked by the range that holds its end, from the blocks' checksums, which stand in the
clear behind their magic numbers.
"""

from __future__ import annotations

from .format import BLOCK_MAGIC, END_MAGIC, MAGIC_BITS, CodecError, bits_at, combined, magic_positions
from .walk import MAX_PACKED, Piece, Walk

READ_BYTES = 1 << 20
#: A stream's checksum is checked across ranges up to so many bytes; `plans.parallel` has no such limit.
MAX_STREAM = 1 << 30


def read_at(f, start: int, end: int) -> bytes:
    f.seek(start)
    return f.read(max(end - start, 0))


def walked(f, walk: Walk, edge: int | None = None):
    """Pieces of an open file from where the walk's data end, as soon as each is complete. Where the walk comes to bit
    `edge`, a piece of that kind is given before it goes on."""
    ended = False
    while True:
        if edge is not None and walk.at >= edge:
            yield Piece("edge", walk.at, walk.at)
            edge = None
        if piece := walk.piece(ended):
            yield piece
        elif ended:
            return
        else:
            more = f.read(READ_BYTES)
            ended = not more
            walk.add(more)


def first_level(f) -> int:
    head = read_at(f, 0, 4)
    return head[3] - 0x30 if len(head) == 4 and head[:3] == b"BZh" and 0x31 <= head[3] <= 0x39 else 9


def synced(f, lo: int) -> tuple[Walk, bytes]:
    """A walk at the first piece that begins at or after byte `lo`, and the plaintext of the block before it."""
    back = max(0, lo - MAX_PACKED)
    data = read_at(f, back, lo + 8)
    hits = [h for h in magic_positions(data).tolist() if h < 8 * (lo - back)]
    for hit in reversed(hits):
        for level in dict.fromkeys((first_level(f), 9)):
            walk = Walk(bytearray(data[hit >> 3 :]), hit & 7, level, None, back + (hit >> 3))
            f.seek(back + len(data))
            last = b""
            try:
                for piece in walked(f, walk):
                    last = piece.out or last
                    if piece.end >= 8 * lo:
                        return walk, last
            except CodecError:
                continue
    # no whole block before: whoever reads there names the error; go on at what looks like one
    at = lo
    while data := read_at(f, at, at + READ_BYTES + 8):
        found = magic_positions(data, magics=(BLOCK_MAGIC, END_MAGIC)).tolist()
        if found:
            f.seek(at + len(data))
            return Walk(bytearray(data[found[0] >> 3 :]), found[0] & 7, first_level(f), None, at + (found[0] >> 3)), b""
        at += READ_BYTES
    raise CodecError("InvalidMagic", 8 * lo)


def check_stream(f, end: Piece, assumed: int) -> None:
    """Checks the stream that ends with this piece; CodecError if it is invalid. Its blocks have been decoded as of
    the `assumed` level, so one of another level is walked again."""
    crcs: list[int] = []
    to, start = end.start, None
    while start is None and end.start - to < 8 * MAX_STREAM:
        lo = max(0, (to >> 3) - READ_BYTES)
        data = read_at(f, lo, (to >> 3) + 16)
        for hit in reversed(magic_positions(data, magics=(BLOCK_MAGIC, END_MAGIC)).tolist()):
            if 8 * lo + hit >= to:
                continue
            if bits_at(data, hit, MAGIC_BITS) == END_MAGIC:
                start = lo + (hit + MAGIC_BITS + 32 + 7 >> 3)
                break
            crcs.append(bits_at(data, hit + MAGIC_BITS, 32))
        else:
            to = 8 * lo
            start = 0 if lo == 0 else None
    if start is None:
        return
    head = read_at(f, start, start + 4)
    if combined(crcs[::-1]) == end.crc and head == b"BZh%d" % assumed:
        return
    f.seek(start)
    for piece in walked(f, Walk(base=start)):
        if piece.kind == "end":
            return


def range_pieces(f, lo: int, hi: int):
    """(piece, whether it begins in the range) of all pieces that do, then, behind one of kind `edge`, of those after
    it as long as they are asked for; first a piece of kind `before` with the plaintext of the block before the range."""
    if lo:
        walk, before = synced(f, lo)
    else:
        f.seek(0)
        walk, before = Walk(), b""
    yield Piece("before", walk.at, walk.at, out=before), True
    level = first_level(f) if lo else 0
    f.seek(walk.base + len(walk.data))
    unseen = walk.checksum is None
    for piece in walked(f, walk, 8 * hi):
        ours = piece.start < 8 * hi
        if piece.kind == "end" and unseen and ours:
            place = f.tell()
            check_stream(f, piece, level)
            f.seek(place)
        unseen &= piece.kind != "end"
        yield piece, ours
