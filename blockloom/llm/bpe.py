"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The symbols of many words lie in one flat array. A round finds the rank of every pair of neighbours by binary
search over the sorted pair keys of the merge list, takes the lowest rank in each word and merges its
occurrences from left to right; words without a pair left are put aside. Ranks are looked up anew only beside
merged symbols.

A match of the tokenizer's pattern never goes on into white space after other characters, so a text is cut
there and each distinct chunk (white space, then the rest) is encoded once per worker. Texts that hold white
space outside ASCII are matched as a whole instead.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw_texts, sliced

#: The pattern that byte-level BPE vocabularies of this kind are trained with (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: UTF-8 prefixes of white space outside ASCII.
WIDE_SPACES = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
CHUNK = re.compile(rb"\s*\S+|\s+")
#: Signs that end a chunk as one word (no apostrophe, which may begin one), and letters that are told without a pattern.
TAIL = b".,;:!?)]}$%&*#"
LATIN = re.compile("[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f]+")
#: A worker keeps the chunks and words of its last one or two times so many new ones.
CACHE_CHUNKS = 300_000
LONG_CHUNK = 256
#: Words of one merge batch hold about this many bytes together.
MERGE_BYTES = 1 << 20


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class BytePairs:
    """A vocabulary and merge list read from a tokenizers JSON file."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        letters = byte_letters()
        of_letter = {c: b for b, c in enumerate(letters)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.width = max([*vocab.values(), *added.values()]) + 1
        left, right, made = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in merges), strict=True))
        keys = left * self.width + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order, made
        self.first = np.array([vocab[c] for c in letters], np.int64)
        self.bytes_of = [b""] * self.width
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(of_letter[c] for c in token)
        for token, i in added.items():
            self.bytes_of[i] = token.encode()
        self.text_of = [str(i).encode() for i in range(self.width)]
        self.added = {k.encode(): v for k, v in added.items()}
        self.split_added = re.compile(b"(%s)" % b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if added else None
        self.pattern = regex.compile(PATTERN)
        self.cache: dict[bytes, bytes] = {}  # ids as little-endian 32-bit integers
        self.old: dict[bytes, bytes] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in the merge list, or the length of the list."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], len(self.keys))

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each word, none of them empty."""
        none = len(self.keys)
        symbols = self.first[np.frombuffer(b"".join(words), np.uint8)]
        lengths = np.array([len(w) for w in words], np.int64)
        which = np.arange(len(words))
        out: list = [None] * len(words)

        def ranks_at(at: np.ndarray, symbols: np.ndarray, last: np.ndarray) -> np.ndarray:
            r = np.full(len(at), none, np.int64)
            inner = ~last[at]
            r[inner] = self.rank(symbols[at[inner]], symbols[at[inner] + 1])
            return r

        starts = np.cumsum(lengths) - lengths
        last = np.zeros(len(symbols), bool)
        last[starts + lengths - 1] = True
        ranks = ranks_at(np.arange(len(symbols)), symbols, last)
        while len(which):
            low = np.minimum.reduceat(ranks, starts)
            done = low == none
            if done.any():
                for i in np.flatnonzero(done):
                    out[which[i]] = symbols[starts[i] : starts[i] + lengths[i]]
                stay = np.repeat(~done, lengths)
                symbols, ranks, last = symbols[stay], ranks[stay], last[stay]
                which, lengths, low = which[~done], lengths[~done], low[~done]
                starts = np.cumsum(lengths) - lengths
                if not len(which):
                    break
            hit = ranks == np.repeat(low, lengths)
            at = np.flatnonzero(hit)
            # pairs that overlap (a run of one symbol): from the start of the run, every other one
            run = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            nth = np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))
            at = at[nth % 2 == 0]
            symbols[at] = self.made[ranks[at]]
            last[at] = last[at + 1]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            owner = np.repeat(np.arange(len(which)), lengths)
            lengths = lengths - np.bincount(owner[at], minlength=len(which))
            starts = np.cumsum(lengths) - lengths
            symbols, last, ranks = symbols[keep], last[keep], ranks[keep]
            at = moved[at]
            beside = np.zeros(len(symbols), bool)
            beside[at] = True
            beside[at[at > 0] - 1] = True
            near = np.flatnonzero(beside)
            ranks[near] = ranks_at(near, symbols, last)
        return out

    def look_up(self, words: list[bytes]) -> None:
        """Puts the ids of words, and of added tokens, in the cache."""
        start = size = 0
        for i, w in enumerate([*words, b""]):
            if i == len(words) or size + len(w) > MERGE_BYTES and i > start:
                if i > start:
                    self.cache.update((k, v.astype("<i4").tobytes()) for k, v in zip(words[start:i], self.merge(words[start:i]), strict=True))
                start, size = i, 0
            size += len(w)
        self.cache.update((w, np.array([self.added[w]], "<i4").tobytes()) for w in words if w in self.added)

    def parts(self, chunk: bytes) -> list[bytes]:
        """Words of a chunk by the pattern, and added tokens. A space, letters and signs are told without it."""
        core = chunk.rstrip(TAIL)
        letters = core[1:] if core[:1] == b" " else core
        if letters.isalpha() or letters and LATIN.fullmatch(letters.decode()):
            return [core, chunk[len(core) :]] if len(core) < len(chunk) else [chunk]
        out: list[bytes] = []
        for part in self.split_added.split(chunk) if self.split_added else [chunk]:
            if part in self.added:
                out.append(part)
            elif part:
                out += [w.encode() for w in self.pattern.findall(part.decode())]
        return out

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.cache) > CACHE_CHUNKS:
            self.old, self.cache = self.cache, {}
        cache, old = self.cache, self.old
        chunks = [[t] if any(s in t for s in WIDE_SPACES) else CHUNK.findall(t) for t in texts]
        new = set().union(*chunks).difference(cache)
        seen = old.keys() & new
        cache.update(zip(seen, map(old.__getitem__, seen)))
        new -= seen
        mixed = {c: p for c in new if len(p := self.parts(c)) != 1}
        wanted = new.difference(mixed).union(*mixed.values()).difference(cache)
        seen = old.keys() & wanted
        cache.update(zip(seen, map(old.__getitem__, seen)))
        self.look_up(list(wanted - seen))
        cache.update({c: b"".join([cache[x] for x in p]) for c, p in mixed.items()})
        found = [np.frombuffer(b"".join(map(cache.__getitem__, own)), "<i4") for own in chunks]
        for c in [c for c in new | wanted if len(c) > LONG_CHUNK]:  # not worth keeping
            del cache[c]
        return found

    def decode(self, ids: list[int]) -> str:
        """Text of the ids; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")



# One vocabulary for all tasks of a worker.
@functools.cache
def pairs_of(path: str) -> BytePairs:
    return BytePairs(path)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) and decoded text of every document.

    Null texts count as empty; empty texts have no ids. Texts of any length are read whole. Of pairs with the lowest rank
    that overlap the first is merged. Rows are independent: repeated rows, null ids and empty tables give what each row
    alone gives. Other columns are ignored, whatever their names.
    """

    def run(batches):
        pairs = pairs_of(path)
        for batch in sliced(batches):
            ids = [x.tolist() for x in pairs.encode(raw_texts(batch.column(1)))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(pairs.decode, ids), pa.string())], names=["doc_id", "ids", "decoded"]
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As `encoded`, with the number of ids and SHA-256 digests in place of ids and text."""

    def run(batches):
        pairs = pairs_of(path)
        for batch in sliced(batches):
            n, of_ids, of_text = [], [], []
            for ids in map(np.ndarray.tolist, pairs.encode(raw_texts(batch.column(1)))):
                n.append(len(ids))
                of_ids.append(hashlib.sha256(b",".join(map(pairs.text_of.__getitem__, ids))).hexdigest())
                of_text.append(hashlib.sha256(pairs.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
