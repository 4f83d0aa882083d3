"""The codec's kernels against vectors, libbz2 and naive versions."""

import bz2
import io
import random

import numpy as np
import pytest

from blockloom.operators import batch, decoder, encoder
from blockloom.operators.format import BLOCK_MAGIC, CodecError, combined, crc, magic_positions, rehomed
from blockloom.operators.ranges import range_pieces, walked
from blockloom.operators.walk import Walk
from blockloom.sources.bz2 import blocks_of, lines_of, listed, opened, resolve
from blockloom.streaming.push import Session

HELLO = bytes.fromhex("425a6839314159265359abddae79000002d180001040001a4c8800200031003020069ea0542bd47431e2ee48a70a12157bb5cf20")
EMPTY = bytes.fromhex("425a683917724538509000000000")
TEXT = b"hello blocks\n"


def samples():
    r = random.Random(7)
    yield from (b"", b"a", b"aaaa", b"aaaaa", b"z" * 300, bytes(range(256)) * 3, b"hello world " * 3000)
    for n in (3, 4, 5, 254, 255, 258, 259, 260, 263, 517, 518, 519, 1000):
        yield b"x" + b"q" * n + b"yy"
    for alphabet in (2, 3, 5, 17, 256):
        yield bytes(r.randrange(alphabet) for _ in range(5000))


def test_vectors():
    assert crc(b"123456789") == 0xFC891918 and crc(b"") == 0
    assert HELLO[10:14] == crc(TEXT).to_bytes(4, "big") == HELLO[-4:] or combined([crc(TEXT)]) == crc(TEXT)
    assert combined([0x80000000, 0]) == 1
    assert decoder.strict(HELLO) == decoder.decompress(HELLO) == TEXT
    assert decoder.strict(EMPTY) == b"" and encoder.compress(b"", 9) == EMPTY
    assert decoder.decompress(b"") == b""
    assert decoder.decompress(HELLO + EMPTY + HELLO) == 2 * TEXT


def test_stage_vectors():
    column, origin = encoder.bwt(np.frombuffer(b"banana", np.uint8))
    assert (column.tobytes(), origin) == (b"nnbaaa", 3)
    assert encoder.packed_runs(*encoder.runs(b"q" * 262)).tobytes() == b"qqqq\xffqqq"
    assert encoder.packed_runs(*encoder.runs(b"aaaa")).tobytes() == b"aaaa\x00"
    assert [encoder.zero_run(n) for n in range(1, 7)] == [[0], [1], [0, 0], [1, 0], [0, 1], [1, 1]]
    assert [encoder.table_count(n) for n in (199, 200, 599, 600, 1199, 1200, 2399, 2400)] == [2, 3, 3, 4, 4, 5, 5, 6]
    assert encoder.code_lengths([5, 1, 1])[0] == 1 and encoder.code_lengths([1] * 8) == [3] * 8
    limited = encoder.code_lengths([1, 1, 2, 3, 5, 8, 13, 21, 34, 55], 6)
    assert max(limited) <= 6 and sum(2**-n for n in limited) == 1


def test_bwt_against_sorted_rotations():
    r = random.Random(3)
    for i in range(200):
        unit = bytes(r.choice(b"abc") for _ in range(r.randrange(1, 6)))
        block = (unit * 20)[: r.randrange(1, 60)] if i % 2 else bytes(r.choice(b"ab") for _ in range(r.randrange(1, 40)))
        order = sorted(range(len(block)), key=lambda k: (block[k:] + block[:k], -k))
        column, origin = encoder.bwt(np.frombuffer(block, np.uint8))
        assert column.tobytes() == bytes(block[k - 1] for k in order) and origin == order.index(0)
        assert decoder.inverse_bwt(column, origin).tobytes() == block


@pytest.mark.parametrize("level", [1, 9])
def test_round_trips(level):
    for data in samples():
        packed = encoder.compress(data, level)
        assert bz2.decompress(packed) == decoder.strict(packed) == data
        assert decoder.strict(bz2.compress(data, level)) == data


def test_sizes_near_libbz2():
    text = b" ".join(random.Random(1).choice([b"court", b"opinion", b"of", b"the", b"docket", b"filed"]) + b"%d" % (i % 89) for i in range(30_000))
    assert len(encoder.compress(text)) <= 1.15 * len(bz2.compress(text))


@pytest.mark.parametrize("extra", [-20, -19, -18, 0, 1])
def test_block_boundary(extra):
    data = random.Random(extra).randbytes(100_000 + extra)
    packed = encoder.compress(data, 1)
    assert bz2.decompress(packed) == data
    assert len(list(decoder.blocks(packed))) == (1 if extra <= -19 else 2)


def test_chunks_do_not_show():
    data = random.Random(5).randbytes(150_000) + b"r" * 90_000
    whole = encoder.compress(data, 1)
    for size in (7_777, 65_536):
        e = encoder.Encoder(1)
        for i in range(0, len(data), size):
            e.push(data[i : i + size])
        assert e.finish() == whole


def test_truncation_and_flips():
    for i in range(1, len(HELLO)):
        assert decoder.error_of(HELLO[:i]) == "Truncated"
    for i in range(8 * len(HELLO)):
        damaged = bytearray(HELLO)
        damaged[i // 8] ^= 128 >> i % 8
        assert decoder.error_of(bytes(damaged)) or decoder.decompress(bytes(damaged)) == TEXT


def test_error_names():
    names = {
        b"X": "Truncated", b"XZh9" + HELLO[4:]: "InvalidMagic", b"BZh0" + HELLO[4:]: "InvalidLevel", HELLO + b"z": "Truncated", HELLO + b"zzz": "Truncated",
        HELLO + b"zzzz": "InvalidMagic", HELLO + b"BZh9": "Truncated", HELLO[:14] + b"\x80" + HELLO[15:]: "RandomizedBlock",
        HELLO[:10] + b"\0" + HELLO[11:]: "CrcMismatch", HELLO[:-2] + bytes([HELLO[-2] ^ 4, HELLO[-1]]): "CrcMismatch",
    }
    for data, name in names.items():
        assert decoder.error_of(data) == name, data
    big = bytearray(bz2.compress(random.Random(2).randbytes(400_000), 9))
    big[3] = ord("1")
    assert decoder.error_of(bytes(big)) == "BlockOverflow"


@pytest.mark.parametrize("digits", [40, 64, 65, 128, 400])
def test_run_flood(digits):
    w = encoder.BitWriter()
    w.put(BLOCK_MAGIC, 48)
    w.put(0, 32)
    w.put(0, 25)
    w.put(0x0200, 16)  # one group of byte values, `a` alone
    w.put(0x4000, 16)
    w.put(2, 3)
    w.put(9, 15)
    for _ in range(9):
        w.put(0, 1)
    for _ in range(2):  # three symbols of two bits
        w.put(2, 5)
        w.put(0, 3)
    for _ in range(digits):
        w.put(0, 2)
    w.put(2, 2)
    stream = b"BZh9" + np.packbits(w.bits()).tobytes() + bytes(20)
    assert decoder.error_of(stream) == "BlockOverflow"


def test_magic_scan_at_every_bit():
    for shift in range(64):
        n = shift + 48 + 13
        value = BLOCK_MAGIC << 13
        assert magic_positions((value << -n % 8).to_bytes((n + 7) // 8, "big")).tolist() == [shift]


def test_rehomed_blocks():
    data = random.Random(4).randbytes(250_000)
    packed = bz2.compress(data, 1)
    found = list(decoder.blocks(packed))
    assert len(found) == 3
    assert b"".join(bz2.decompress(rehomed(packed, b.start, b.end, 1)) for b in found) == data


@pytest.mark.parametrize("size", [1, 7, 4096])
def test_push(size):
    packed = bz2.compress(TEXT * 9000, 1) + EMPTY + HELLO
    d = Session()
    out = b"".join(d.take(packed[i : i + size]) for i in range(0, len(packed), size)) + d.take(last=True)
    assert out == TEXT * 9001 and d.take(last=True) == b""
    assert (d.taken, d.given, d.held) == (len(packed), len(out), 0)
    with pytest.raises(CodecError):
        d.take(b"more")


def test_push_failure_sticks():
    d = Session()
    for chunk in (b"XXXX", b"", HELLO):
        with pytest.raises(CodecError, match="InvalidMagic"):
            d.take(chunk)
    cut = Session()
    cut.take(HELLO[:-3])
    with pytest.raises(CodecError, match="Truncated"):
        cut.take(last=True)


def test_push_gives_blocks_as_soon_as_they_end(monkeypatch):
    """Each block is decoded once, when its end comes into sight, however small the chunks; little is held."""
    from blockloom.operators import walk

    tries = []
    monkeypatch.setattr(walk, "decoded_block", lambda *a, f=walk.decoded_block: tries.append(1) or f(*a))
    monkeypatch.setattr(walk, "read_block", lambda *a: pytest.fail("no strict decoding of valid blocks"))
    data = random.Random(8).randbytes(1_000_000)
    packed, d, given, most = bz2.compress(data, 1), Session(), [], 0
    for i in range(0, len(packed), 1000):
        given.append(d.take(packed[i : i + 1000]))
        most = max(most, d.held)
    assert b"".join([*given, d.take(last=True)]) == data
    assert len(tries) == 11 == sum(map(bool, given)) and most < 120_000


def test_walk_against_the_strict_decoder():
    """Same plaintext, same error at any cut and any flipped bit, in one piece or in many."""
    r = random.Random(9)
    good = bz2.compress(r.randbytes(230_000), 1) + EMPTY + bz2.compress(b"tail " * 40_000, 2)
    cases = [good, good + b"z", good + b"zzzz", good + b"BZh0", b""]
    for _ in range(60):
        damaged = bytearray(good[: r.randrange(len(good))] if r.random() < 0.4 else good)
        if damaged and r.random() < 0.8:
            damaged[r.randrange(len(damaged))] ^= 1 << r.randrange(8)
        cases.append(bytes(damaged))
    for data in cases:
        want, error = b"", None
        try:
            want = decoder.strict(data)
        except CodecError as e:
            want, error = e.done, e.kind
        for size in (len(data) + 1, 30_011):
            w, out, got = Walk(), [], None
            try:
                for i in range(0, max(len(data), 1), size):
                    w.add(data[i : i + size])
                    for piece in w.pieces(i + size >= len(data)):
                        out.append(piece.out)
            except CodecError as e:
                got = e.kind
            assert (b"".join(out) == want, got) == (True, error)


@pytest.mark.parametrize("step", [12_000, 40_000, 100_000, 10**9])
def test_ranges_tile_a_file(step):
    r = random.Random(10)
    lines = [b"%d:" % i + r.randbytes(r.randrange(90)).hex().encode() for i in range(9000)] + [b"", b"", b"x" * 300_000, b"end"]
    data = b"\n".join(lines)
    packed = bz2.compress(data[:500_000], 1) + EMPTY + bz2.compress(data[500_000:900_000], 2) + bz2.compress(data[900_000:], 1)
    f = io.BytesIO(packed)
    blocks, found = [], []
    for lo in range(0, len(packed), step):
        hi = min(lo + step, len(packed))
        for piece, _ in range_pieces(f, lo, hi):
            if piece.kind == "edge":
                break
            if piece.kind == "block":
                blocks.append((piece.start, piece.out))
        found += [x for rows in lines_of(range_pieces(f, lo, hi), lo == 0) for x in rows]
    assert b"".join(x for _, x in blocks) == data and blocks == sorted(blocks)
    assert [x for _, _, x in found] == lines and [x[:2] for x in found] == sorted({x[:2] for x in found})


def test_ranges_name_what_is_wrong():
    r = random.Random(11)
    good = bz2.compress(r.randbytes(900_000), 1)
    last = bytearray(good)
    last[-3] ^= 8  # the stream's checksum, whose blocks lie in other ranges
    middle = bytearray(good)
    middle[len(good) // 2] ^= 8
    for data, error in ((good + b"junk", "InvalidMagic"), (good[:-2], "Truncated"), (bytes(last), "CrcMismatch"), (bytes(middle), None)):
        kinds = set()
        for lo in range(0, len(data), 200_000):
            try:
                for piece, _ in range_pieces(io.BytesIO(data), lo, min(lo + 200_000, len(data))):
                    if piece.kind == "edge":
                        break
            except CodecError as e:
                kinds.add(e.kind)
        assert kinds if error is None else error in kinds, error


def test_drained_bytes_make_the_stream():
    data = random.Random(12).randbytes(450_000)
    e, parts = encoder.Encoder(1), []
    for i in range(0, len(data), 50_000):
        e.push(data[i : i + 50_000])
        parts.append(e.drain())
    assert sum(map(bool, parts)) > 2 and len(e.kept) < 300_000
    assert b"".join(parts) + e.finish() == encoder.compress(data, 1)


def damaged_block(**fields):
    """A block of `a` with some fields of its tables replaced."""
    f = {"crc": 0, "origin": 0, "map": (0x0200, 0x4000), "tables": 2, "selectors": (9, "0" * 9), "lengths": (2, "000"), "symbols": "0010"} | fields
    w = encoder.BitWriter()
    w.put(BLOCK_MAGIC, 48)
    w.put(f["crc"], 32)
    w.put(0, 1)
    w.put(f["origin"], 24)
    for word in f["map"]:
        w.put(word, 16)
    w.put(f["tables"], 3)
    w.put(f["selectors"][0], 15)
    for b in f["selectors"][1]:
        w.put(int(b), 1)
    for _ in range(2):
        w.put(f["lengths"][0], 5)
        for b in f["lengths"][1]:
            w.put(int(b), 1)
    for b in f["symbols"]:
        w.put(int(b), 1)
    return b"BZh9" + np.packbits(w.bits()).tobytes() + bytes(40)


@pytest.mark.parametrize(
    ("fields", "error"),
    [
        ({"map": (0,)}, "InvalidBlock"), ({"selectors": (0, "")}, "InvalidBlock"), ({"selectors": (9, "11" + "0" * 9)}, "InvalidBlock"),
        ({"selectors": (1, "0"), "symbols": "00" * 60}, "BlockOverflow"), ({"selectors": (1, "0"), "symbols": "0001" * 26}, "BlockOverflow"),
        ({"origin": 9}, "InvalidBlock"), ({"symbols": "10"}, "InvalidBlock"), ({"tables": 1}, "InvalidHuffman"), ({"tables": 7}, "InvalidHuffman"),
        ({"lengths": (0, "000")}, "InvalidHuffman"), ({"lengths": (21, "000")}, "InvalidHuffman"), ({"lengths": (20, "10000")}, "InvalidHuffman"),
        ({"symbols": "11" * 9}, "InvalidHuffman"), ({"symbols": "0010"}, "CrcMismatch"),
    ],
)
def test_invalid_blocks(fields, error):
    data = damaged_block(**fields)
    assert decoder.error_of(data) == error
    w = Walk(bytearray(data))
    with pytest.raises(CodecError, match=error):
        list(w.pieces(True))


def test_file_blocks_keep_little():
    data = random.Random(6).randbytes(3_000_000)
    assert b"".join(blocks_of(io.BytesIO(bz2.compress(data, 1) + HELLO))) == data + TEXT
    with pytest.raises(CodecError, match="Truncated"):
        list(blocks_of(io.BytesIO(HELLO[:-1])))


def test_paths(tmp_path):
    (tmp_path / "a.bz2").write_bytes(HELLO)
    for path in (str(tmp_path), f"file:{tmp_path}", f"{tmp_path}/*.bz2", str(tmp_path / "a.bz2")):
        assert listed(path) == [(str(tmp_path / "a.bz2"), len(HELLO))]
    with opened(f"file://{tmp_path}/a.bz2") as f:
        assert [p.out for p in walked(f, Walk()) if p.kind == "block"] == [TEXT]


def test_resolve():
    assert resolve("opinions", "/data") == "/data/opinions.bz2"
    assert resolve("x/y.bz2", "/data/") == "/data/x/y.bz2"
    assert resolve("/abs/z.bz2", "/data") == "/abs/z.bz2"


def test_tree_and_packages_agree():
    """The quick tree of two queues gives the lengths that packages of coins do, wherever it is shallow enough."""
    r = random.Random(8)
    for k in range(400):
        coins = sorted(max(1, int(r.random() ** (1, 4, 12)[k % 3] * 300)) for _ in range(r.randrange(2, 80)))
        depths = encoder.tree_depths(coins)
        assert depths[0] > 17 or depths == encoder.packages(coins, 17)
    deep = [1, 1]
    while len(deep) < 30:
        deep.append(sum(deep[-2:]))
    lengths = encoder.code_lengths(deep)
    assert max(lengths) == 17 and sum(2.0**-n for n in lengths) <= 1


def test_recency_across_stretches(monkeypatch):
    values = np.array([random.Random(i).randrange(7) for i in range(500)])
    recent, want = list(range(7)), []
    for v in values.tolist():
        want.append(recent.index(v))
        recent.insert(0, recent.pop(want[-1]))
    for stretch in (1, 70, 1 << 18):
        monkeypatch.setattr(encoder, "STRETCH", stretch)
        assert encoder.recency(values, 7).tolist() == want


@pytest.mark.parametrize("size", [1, 3000, 1 << 17])
def test_texts_together_give_the_streams_of_each(monkeypatch, size):
    """Many texts at once, of any number of blocks: the bytes that each gives alone."""
    monkeypatch.setattr(batch, "BATCH_BYTES", size)
    r = random.Random(6)
    texts = [*samples(), *((b"abcab" * 30)[:n] for n in range(1, 60)), bytes(r.randrange(256) for _ in range(210_000)), b"ab" * 120_000]
    texts += [bytes(r.choice(b"aab\n" * (i % 2 + 1) + b"cdefgh") for _ in range(r.randrange(900))) for i in range(80)]
    r.shuffle(texts)
    assert batch.compress_all(texts, 1) == [encoder.compress(x, 1) for x in texts]


def test_texts_together_take_few_array_calls(monkeypatch):
    """Tables of all texts are fitted at once: one call in each pass at most, not one for each table."""
    calls = []
    one = batch.code_lengths
    monkeypatch.setattr(batch, "code_lengths", lambda *a: calls.append(1) or one(*a))
    texts = [b"text %d of many, " % i * 20 for i in range(100)]
    assert [bz2.decompress(x) for x in batch.compress_all(texts, 9)] == texts and len(calls) <= encoder.PASSES


def test_codes_of_many_tables_at_once():
    """Deep trees and any numbers of symbols: the lengths that each table gets alone."""
    r = random.Random(4)
    rows = [[max(1, int(r.random() ** (1, 4, 30)[i % 3] * 900_000)) for _ in range(r.randrange(3, 259))] for i in range(60)]
    rows.append([1, 1, *(x := [2, 3]), *(x.append(x[-1] + x[-2]) or x[-1] for _ in range(24))])
    weights = np.ones((len(rows), batch.WIDTH), np.int64)
    for i, own in enumerate(rows):
        weights[i, : len(own)] = own
    got = batch.code_lengths(weights, np.array([len(own) for own in rows]))
    assert [g[: len(own)].tolist() for g, own in zip(got, rows, strict=True)] == [encoder.code_lengths(own) for own in rows]


def test_encoders_finish_together(monkeypatch):
    """Encoders that have drained blocks, hold a block or two, or nothing: the streams that each ends alone."""
    monkeypatch.setattr(batch, "BATCH_BYTES", 150_000)
    r = random.Random(9)
    texts = [b"", b"a", bytes(r.randrange(256) for _ in range(330_000)), *(b"some text %d " % i * i for i in range(30)), b"", b"z" * 120_000]
    encoders, drained = [encoder.Encoder(1) for _ in texts], []
    for e, x in zip(encoders, texts, strict=True):
        parts = []
        for i in range(0, len(x), 10_000):
            e.push(x[i : i + 10_000])
            parts.append(e.drain())
        drained.append(b"".join(parts))
    got = [d + end for d, end in zip(drained, batch.finish_all(encoders), strict=True)]
    assert got == [encoder.compress(x, 1) for x in texts]
