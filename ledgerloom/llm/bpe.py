"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves a whole pre-token with one
probe and one comparison.  Tier two: what misses is merged with a heap over linked bytes,
lowest rank first and leftmost among equals, in O(n log n) for a pre-token of n bytes.

Defined results: null and empty texts have no ids; very long texts and pre-tokens are encoded
whole; repeated rows give repeated rows; an empty table gives an empty result; columns of the
input other than the id and the text column are neither read nor returned.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

#: pre-tokens that a worker remembers; only speed and memory depend on it
MEMO = 500_000


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file by id; ids must be 0, 1, 2, ... without gaps."""
    pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, open(path, "rb")))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must be consecutive from 0")
    return [t for _, t in pairs]


def _slot(h: int, d: int, n: int) -> int:
    """Place of a key with hash h under displacement d; as good as random in both."""
    x = (h + d * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    return ((x ^ x >> 31) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF) % n


class PerfectHash:
    """Minimal perfect hash by displacement: bucket -> displacement -> the key's own slot."""

    def __init__(self, keys: list[bytes]):
        if len(set(keys)) < len(keys):
            raise ValueError("keys must be distinct")
        n = self.n = len(keys)
        self.buckets = max(1, n // 3)
        groups: list[list[tuple[int, int]]] = [[] for _ in range(self.buckets)]
        for i, k in enumerate(keys):
            h = xxhash.xxh3_64_intdigest(k)
            groups[h % self.buckets].append((h, i))
        self.shift, self.slot_id = [0] * self.buckets, [-1] * n
        order = sorted(range(self.buckets), key=lambda b: -len(groups[b]))
        single = [b for b in order if len(groups[b]) == 1]
        for b in order[: sum(len(g) > 1 for g in groups)]:
            group, d = groups[b], 0
            while True:
                slots = [_slot(h, d, n) for h, _ in group]
                if all(self.slot_id[s] < 0 for s in slots) and len(set(slots)) == len(slots):
                    break
                d += 1
            self.shift[b] = d
            for s, (_, i) in zip(slots, group, strict=True):
                self.slot_id[s] = i
        free = (s for s, i in enumerate(self.slot_id) if i < 0)
        for b in single:  # alone in its bucket: any free slot, stored as such
            slot = next(free)
            self.slot_id[slot], self.shift[b] = groups[b][0][1], -slot - 1

    def find(self, key: bytes) -> int:
        """The id in the slot of a key; the caller compares the key found there."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        return self.slot_id[-d - 1] if d < 0 else self.slot_id[_slot(h, d, self.n)]


class Codec:
    """Encodes and decodes whole texts; keeps what recent pre-tokens and pieces became."""

    def __init__(self, tokens: list[bytes], pattern: str, table: PerfectHash | None = None):
        self.tokens, self.table = tokens, table or PerfectHash(tokens)
        self.rank = {t: i for i, t in enumerate(tokens)}
        #: those of two bytes apart, which stay in the processor's cache
        self.rank_of_two = {t: i for t, i in self.rank.items() if len(t) == 2}
        self.split = regex.compile(pattern)
        self.text_of = [str(i) for i in range(len(tokens))]
        #: what recent pre-tokens became, and those before them
        self.words: dict[str, tuple] = {}
        self.earlier: dict[str, tuple] = {}

    def merge(self, b: bytes) -> list[int]:
        """Heap over linked bytes: start[i] begins a part that ends where the next one begins."""
        n, rank, get, of_two = len(b), self.rank, self.rank.get, self.rank_of_two.get
        of_pair = [of_two(b[i : i + 2], -1) for i in range(n - 1)] + [-1]
        bits = n.bit_length()  # entries are rank << bits | place
        place = (1 << bits) - 1
        heap = [r << bits | i for i, r in enumerate(of_pair) if r >= 0]
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            least = heappop(heap)
            i = least & place
            if of_pair[i] != least >> bits:
                continue
            gone = after[i]
            of_pair[gone] = -1
            end = after[i] = after[gone]
            if end < n:
                before[end] = i
                of_pair[i] = s = get(b[i : after[end]], -1)
                if s >= 0:
                    heappush(heap, s << bits | i)
            else:
                of_pair[i] = -1
            if (p := before[i]) >= 0:
                of_pair[p] = s = get(b[p:end], -1)
                if s >= 0:
                    heappush(heap, s << bits | p)
        out, i = [], 0
        while i < n:
            out.append(rank[b[i : after[i]]])
            i = after[i]
        return out

    def resolved(self, w: str) -> tuple:
        """Ids of a pre-token: one probe of the perfect hash, else merges."""
        b = w.encode()
        i = self.table.find(b)
        return (i,) if self.tokens[i] == b else tuple(self.merge(b))

    def word(self, w: str) -> tuple:
        """Ids of a pre-token that isn't among the recent ones."""
        ids = self.earlier.get(w) or self.resolved(w)
        if len(self.words) >= MEMO // 2:
            self.earlier, self.words = self.words, {}
        if len(w) < 64:
            self.words[w] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of a text: its pre-tokens are looked up together, and those not found one by one."""
        words = self.split.findall(text)
        found = list(map(self.words.get, words))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    found[i] = self.words.get(words[i]) or self.word(words[i])
        return list(chain.from_iterable(found))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_codecs: dict[tuple, Codec] = {}


def codec(tokens: list[bytes], pattern: str, table: PerfectHash | None = None) -> Codec:
    """One codec for each vocabulary in a Python worker."""
    key = (hashlib.sha256(b"\0".join(tokens)).digest(), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(tokens, pattern, table)
    return _codecs[key]


def _shipped(df: DataFrame, tokens: list[bytes]):
    """The vocabulary and its perfect hash, built once; refused above 64 MB, so the broadcast is bounded."""
    if sum(map(len, tokens)) > 64 << 20:
        raise ValueError("a vocabulary of over 64 MB isn't broadcast")
    return df.sparkSession.sparkContext.broadcast((tokens, PerfectHash(tokens)))


def encode(df: DataFrame, tokens: list[bytes], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id column and `ids` array<int>."""
    sent = _shipped(df, tokens)
    rows = df.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, table = sent.value
        c = codec(tokens, pattern, table)
        for b in batches:
            ids = [c.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    return rows.mapInArrow(run, f"{id_col} {dict(rows.dtypes)[id_col]}, ids array<int>")


def decode(df: DataFrame, tokens: list[bytes], id_col: str = "doc_id") -> DataFrame:
    """The bytes of each row of `ids`, as `decoded` binary; null ids decode to nothing."""
    sent = _shipped(df, tokens)
    rows = df.select(id_col, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value[0]
        for b in batches:
            out = [b"".join(map(table.__getitem__, x or ())) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], [id_col, "decoded"])

    return rows.mapInArrow(run, f"{id_col} {dict(rows.dtypes)[id_col]}, decoded binary")


def digests(df: DataFrame, tokens: list[bytes], pattern: str) -> DataFrame:
    """Encode and decode every text in one pass and return counts and digests of both results."""
    sent = _shipped(df, tokens)
    rows = df.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, table = sent.value
        c = codec(tokens, pattern, table)
        text_of = c.text_of.__getitem__
        for b in batches:
            n, id_sums, sums = [], [], []
            for t in b.column(1):
                ids = c.encode(t.as_py() or "")
                n.append(len(ids))
                id_sums.append(hashlib.sha256(" ".join(map(text_of, ids)).encode()).hexdigest())
                sums.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(id_sums, pa.string()), pa.array(sums, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
