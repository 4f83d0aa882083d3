"""Push decoding of .bz2 streams that arrive in chunks.

A `Session` takes the chunks of one stream in order and gives the plaintext of the blocks whose end they bring into
sight. `decoded` runs one for each stream id in a streaming query over rows (stream_id, seq, chunk, last); its state is
the place of the walk with the bytes of the block at hand, and chunks that came ahead of their turn.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..operators.format import CodecError
from ..operators.walk import Walk

#: What an open session has for a verdict; a closed one has an empty one, a failed one the error's name.
OPEN = "open"


class Session:
    """One stream's decoding. An error is final and comes again with every later chunk; the blocks that the failing
    chunk completed are lost with it. After the end any chunk is an error, and a further end gives nothing."""

    def __init__(self, walk: Walk | None = None, taken: int = 0, given: int = 0, verdict: str = OPEN) -> None:
        self.walk = Walk() if walk is None else walk
        self.taken, self.given, self.verdict = taken, given, verdict

    def take(self, chunk: bytes = b"", last: bool = False) -> bytes:
        """Plaintext that the chunk completes; with `last`, all that is left, and an error unless the input ends there."""
        if self.verdict == "" and last and not chunk:
            return b""
        if self.verdict != OPEN:
            raise CodecError(self.verdict or "InvalidMagic")
        self.taken += len(chunk)
        self.walk.add(chunk)
        try:
            out = b"".join([p.out for p in self.walk.pieces(last)])
        except CodecError as e:
            self.verdict, self.walk = e.kind, Walk()
            raise
        self.walk.trim()
        self.given += len(out)
        if last:
            self.verdict, self.walk = "", Walk()
        return out

    @property
    def held(self) -> int:
        """Bytes that wait for the rest of their block."""
        return len(self.walk.data)


STATE = (
    "data binary, bit long, level int, checksum long, searched long, wanted long, taken long, given long, verdict string, "
    "next_seq long, ahead array<struct<seq:long,chunk:binary,last:boolean>>"
)
OUTPUT = "stream_id string, seq long, data binary, error string, bytes_in long, bytes_out long, buffered long"


def _advance(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    session, turn, ahead = Session(), 0, {}
    if state.exists:
        data, bit, level, checksum, searched, wanted, taken, given, verdict, turn, waiting = state.get
        session = Session(Walk(bytearray(data), bit, level, checksum, searched=searched, wanted=wanted), taken, given, verdict)
        ahead = {w[0]: (bytes(w[1]), w[2]) for w in waiting or []}
    for batch in batches:
        for seq, chunk, last in zip(batch["seq"], batch["chunk"], batch["last"], strict=True):
            if seq >= turn:
                ahead.setdefault(int(seq), (bytes(chunk if chunk is not None else b""), bool(last)))
    rows = []
    while turn in ahead:
        data, error = None, None
        try:
            data = session.take(*ahead.pop(turn))
        except CodecError as e:
            error = e.kind
        rows.append((key[0], turn, data, error, session.taken, session.given, session.held))
        turn += 1
    if session.verdict != OPEN:  # nothing more can come of this stream: what waits has no use
        ahead = {s: (b"", last) for s, (_, last) in ahead.items()}
    walk = session.walk
    waiting = [(s, c, e) for s, (c, e) in sorted(ahead.items())]
    state.update((bytes(walk.data), walk.bit, walk.level, walk.checksum, walk.searched, walk.wanted, session.taken, session.given, session.verdict, turn, waiting))
    yield pd.DataFrame(rows, columns=["stream_id", "seq", "data", "error", "bytes_in", "bytes_out", "buffered"])


def decoded(chunks: DataFrame) -> DataFrame:
    """For each chunk of a streaming table (stream_id, seq from 0, chunk, last) the plaintext it completes, the
    error if it fails, and the counts so far. Chunks may come out of order; those ahead wait, repeats are ignored.

    A stream's state holds at most one block's bytes besides the chunks that are ahead. A chunk that never comes leaves
    those in the state; nothing is given up for it, as any time limit would drop data.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    return chunks.groupBy("stream_id").applyInPandasWithState(_advance, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def progress(rows: DataFrame) -> DataFrame:
    """How far each stream of `decoded`'s output has come: bytes in and out, their ratio, bytes held, chunks, error."""
    from pyspark.sql import functions as F

    last = F.max_by("buffered", "seq").alias("buffered")
    ends = rows.groupBy("stream_id").agg(F.max("bytes_in").alias("bytes_in"), F.max("bytes_out").alias("bytes_out"), last, F.count("*").alias("chunks"), F.max("error").alias("error"))
    return ends.withColumn("ratio", F.try_divide("bytes_out", "bytes_in"))
