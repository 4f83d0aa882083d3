"""Secret scans with structural confirmation.

Patterns give candidates. Base kinds are reported as matched. Two more kinds are reported only after decoding:
`key` if base64, hex or an armoured block holds a private key whose tags and nested lengths add up, `jwt` if
the first two parts of a dotted token are JSON objects and the header names an algorithm.

A key may begin anywhere in a run of digits and go on over lines; its own lengths tell where it ends. Lengths are
read in place, a few digits at a time, so a text full of false starts costs no more than a look at each.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sliced

#: The base patterns (fixed values): letters of the words in either case, ASCII only.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "key", "jwt")
BASE_KINDS = KINDS[:3]

ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]*)PRIVATE KEY-----((?:[^-]|-(?!----))*)-----END \1PRIVATE KEY-----")
#: Where a key may start in base64 (0x30 and a length, or the first bytes of the OpenSSH format) and in hex.
BASE64_START = re.compile("M(?=[A-P])|b(?=3Blbn)")
HEX_START = re.compile("3(?=0)|6(?=[Ff]70656[Ee])")
BASE64_DIGITS = re.compile(r"[A-Za-z0-9+/_-]+")
HEX_DIGITS = re.compile(r"[0-9A-Fa-f]+")
#: Goes on in the next line; a line may be indented, and a break may be written as an escape.
LINE_BREAK = re.compile(r"[\x20\t]*(?:\r\n|\r|\n|\\r\\n|\\n)[\x20\t]*")
PADDING = re.compile("={0,2}")
TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
#: Headers of an encrypted key of the older kind: the mark, then cipher and initial vector.
HEADER = re.compile(r"([A-Za-z0-9-]+):[\x20\t]*(.*)")
#: No private key has fewer bytes.
LEAST_KEY = 24
OPENSSH = b"openssh-key-v1\0"
#: DER tags, and the object identifiers (beginnings) of encryption by password (fixed values).
INTEGER, OCTETS, OBJECT_ID, SEQUENCE = 0x02, 0x04, 0x06, 0x30
PASSWORD_SCHEMES = bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01")


def decoded(text: str) -> bytes:
    """Bytes of standard or URL-safe base64, padded or not; empty if it is none."""
    body = text.rstrip("=").translate({ord("-"): "+", ord("_"): "/"})
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return b""


def element(read, start: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the contents of the DER element at `start`, if it ends by `end`. `read` gives the n bytes
    from an offset, fewer at the end of the data."""
    head = read(start, 6)
    if len(head) < 2:
        return None
    tag, n, start = head[0], head[1], start + 2
    if n >= 0x80:
        width = n & 0x7F
        if not 1 <= width <= 4 or len(head) < 2 + width:
            return None
        n = int.from_bytes(head[2 : 2 + width], "big")
        if n < 0x80 or n >> 8 * (width - 1) == 0:  # not the shortest form
            return None
        start += width
    return (tag, start, start + n) if start + n <= end else None


def elements(read, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """The DER elements that fill the bytes from start to end exactly, or None."""
    found = []
    while start < end:
        one = element(read, start, end)
        if one is None:
            return None
        found.append(one)
        start = one[2]
    return found


def nested(read, parts: list[tuple[int, int, int]]) -> bool:
    """Whether all constructed elements down to the leaves fill their lengths, however deep."""
    todo = [x for x in parts if x[0] & 0x20]
    while todo:
        inner = elements(read, *todo.pop()[1:])
        if inner is None:
            return False
        todo += [x for x in inner if x[0] & 0x20]
    return True


def der_size(read, available: int) -> int:
    """Bytes of the private key at the start: version and numbers (PKCS#1, DSA), version and octets (SEC 1), version,
    algorithm and octets (PKCS#8), or a password scheme and octets (encrypted PKCS#8). 0 if it is none."""
    outer = element(read, 0, available)
    if not outer or outer[0] != SEQUENCE:
        return 0
    first = element(read, *outer[1:])
    if not first or first[0] not in (INTEGER, SEQUENCE) or first[0] == INTEGER and first[2] - first[1] != 1:
        return 0
    parts = elements(read, *outer[1:])
    if not parts or not nested(read, parts):
        return 0
    tags = [t for t, _, _ in parts]

    def algorithm(part: tuple[int, int, int]) -> bytes:
        inner = elements(read, *part[1:])
        return read(inner[0][1], inner[0][2] - inner[0][1]) if inner and inner[0][0] == OBJECT_ID else b""

    if first[0] == SEQUENCE:
        good = tags == [SEQUENCE, OCTETS] and algorithm(first).startswith(PASSWORD_SCHEMES)
    else:
        version = read(first[1], 1)[0]
        numbers = {*tags} == {INTEGER}
        good = (
            tags[1:3] == [SEQUENCE, OCTETS] and version <= 1 and bool(algorithm(parts[1]))
            or tags[1:2] == [OCTETS] and version == 1
            or version <= 1 and (numbers and len(tags) == 6 or len(tags) >= 9 and {*tags[1:9]} == {INTEGER})
        )
    return outer[2] if good else 0


def ssh_size(read, available: int) -> int:
    """Bytes of the private key in OpenSSH's format at the start: length-prefixed cipher, KDF and options, then the
    public keys, as many as a number says, and the private ones. 0 if it is none."""
    if read(0, len(OPENSSH)) != OPENSSH:
        return 0
    at = len(OPENSSH)

    def number(at: int) -> int:
        found = read(at, 4)
        return int.from_bytes(found, "big") if len(found) == 4 else available

    for _ in range(3):
        at += 4 + number(at)
    n = number(at)
    at, left = at + 4, n + 1
    while left and at < available:
        at += 4 + number(at)
        left -= 1
    return at if n and not left and at <= available else 0


def key_size(read, available: int) -> int:
    """Bytes of the private key at the start, 0 if there is none."""
    size = ssh_size(read, available) or der_size(read, available)
    return size if size >= LEAST_KEY else 0


def is_key(data: bytes) -> bool:
    """Whether the bytes are one private key and no more."""
    return bool(data) and key_size(lambda at, n: data[at : at + n], len(data)) == len(data)


def encrypted_key(headers: dict[str, str], body: bytes) -> bool:
    """An encrypted key of the older kind: its headers name a cipher and an initial vector, and the body is whole
    cipher blocks, as long as the vector."""
    kind, _, vector = headers.get("DEK-Info", "").partition(",")
    try:
        size = len(bytes.fromhex(vector.strip()))
    except ValueError:
        return False
    return headers.get("Proc-Type", "").replace(" ", "") == "4,ENCRYPTED" and bool(kind) and size in (8, 16) and len(body) >= LEAST_KEY and len(body) % size == 0


def armoured(block: str) -> bool:
    """Whether what stands between the lines of an armoured block decodes to a private key."""
    headers, body = {}, []
    for line in LINE_BREAK.split(block):
        m = HEADER.fullmatch(line)
        if m:
            headers[m[1]] = m[2]
        else:
            body.append(line.strip())
    data = decoded("".join(body))
    return encrypted_key(headers, data) if headers else is_key(data)


def base64_reader(digits: str, start: int):
    """Reads bytes from the base64 digits from `start` on; and how many there are."""

    def read(at: int, n: int) -> bytes:
        first, last = at // 3, -(-(at + n) // 3)
        part = digits[start + 4 * first : start + 4 * last]
        part = part[:-1] if len(part) % 4 == 1 else part
        return decoded(part)[at - 3 * first : at - 3 * first + n]

    return read, (len(digits) - start) * 3 // 4


def hex_reader(digits: str, start: int):
    def read(at: int, n: int) -> bytes:
        part = digits[start + 2 * at : start + 2 * (at + n)]
        return bytes.fromhex(part if len(part) % 2 == 0 else part[:-1])

    return read, (len(digits) - start) // 2


def run_keys(text: str, start: re.Pattern, digits: re.Pattern, reader, count) -> list[tuple[int, int]]:
    """Spans of keys that are written as digits on one or several lines. `count` gives the digits of n bytes."""
    found, behind = [], 0
    run, places, run_end = "", [], 0  # a run over lines, and (place in it, place in the text) of its lines
    for at in (m.start() for m in start.finditer(text)):
        if at < behind:
            continue
        if at >= run_end:
            parts, places, size, own = [], [], 0, digits.match(text, at)
            while own:
                places.append((size, own.start()))
                parts.append(own[0])
                size, run_end = size + len(own[0]), own.end()
                line = LINE_BREAK.match(text, run_end)
                own = line and digits.match(text, line.end())
            run = "".join(parts)
        line = places[bisect.bisect_right(places, at, key=lambda p: p[1]) - 1]
        first = line[0] + at - line[1]
        size = key_size(*reader(run, first))
        if size:
            last = first + count(size) - 1
            line = places[bisect.bisect_right(places, last, key=lambda p: p[0]) - 1]
            behind = line[1] + last - line[0] + 1
            found.append((at, behind))
    return found


def signed_token(header: str, payload: str, signature: str) -> bool:
    try:
        head, body = (json.loads(decoded(x)) for x in (header, payload))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(body, dict) and isinstance(head.get("alg"), str) and (bool(signature) or head["alg"].lower() == "none")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    low = text.lower()
    found = []
    if any(w in low for w in ASSIGN_WORDS):
        found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    if "PRIVATE KEY-----" in text:
        found = [("key", *m.span()) for m in ARMOUR.finditer(text) if armoured(m[2])]
    inside = [(a, b) for _, a, b in found]
    if "eyJ" in text:
        found += [("jwt", *m.span()) for m in TOKEN.finditer(text) if signed_token(*m.groups())]
    runs = [(a, PADDING.match(text, b).end()) for a, b in run_keys(text, BASE64_START, BASE64_DIGITS, base64_reader, lambda n: -(-4 * n // 3))]
    runs += run_keys(text, HEX_START, HEX_DIGITS, hex_reader, lambda n: 2 * n)
    return found + [("key", a, b) for a, b in runs if not any(c <= a and b <= d for c, d in inside)]


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as listed in KINDS, then end."""
    found = base_spans(text) + confirmed_spans(text)
    return sorted(set(found), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redacted(text: str, found: list[tuple[str, int, int]], mark: str = "[secret]") -> str:
    """text with each span, or run of overlapping spans, replaced by a mark."""
    out, at = [], 0
    for a, b in sorted((a, b) for _, a, b in found):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


SPANS = "array<struct<kind:string,start:int,end:int>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans of every document, in the order of start, then kind, then end, so that ties have one order.

    Null texts count as empty. Texts of any length are read whole, one at a time beyond a batch's size. Rows are
    independent: repeated rows, null ids and empty tables give what each row alone gives. Other columns are
    ignored, whatever their names.
    """

    def run(batches):
        for batch in sliced(batches):
            found = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans(t or "")] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, SPAN_TYPE)], names=["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id long, spans {SPANS}")


def redacted_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs, all columns, with a mark in place of each secret; null texts stay null."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in sliced(batches, at):
            texts = [t and redacted(t, spans(t)) for t in batch.column(at).to_pylist()]
            columns = batch.columns
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def listed(found: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def counted(scanned: DataFrame) -> DataFrame:
    """The digest columns of `scan`'s result."""
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return scanned.select(
        "doc_id",
        *(F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS),
        F.sha2(listed(of(*BASE_KINDS)), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
