"""Byte-level BPE encoding and decoding.

Two tiers. A minimal perfect hash over the vocabulary resolves a pre-token that
is a token itself; every other pre-token is merged with a heap of ranked pairs
over linked bytes. Both run inside Spark tasks, batch by batch; a bounded memo
per Python worker keeps pre-tokens that were already resolved there.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fedtab.llm.common import pieces

#: Pre-tokens a worker remembers before it starts afresh (memory only, never results).
MEMO = 250_000
_MASK = (1 << 64) - 1
_MIX = 0x9E3779B97F4A7C15


class PerfectHash:
    """Minimal perfect hash of byte strings: n keys in n slots, one displacement per bucket.

    Keys of a bucket (about four) share a displacement found so that all fall in
    free slots; a bucket of one key stores its slot itself, as ``-slot - 1``.
    """

    def __init__(self, keys: list[bytes]):
        import xxhash
        self.n = max(1, len(keys))
        self.n_buckets = self.n // 4 + 1
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))
        order = np.argsort(hashes % np.uint64(self.n_buckets), kind="stable")
        bucket_of = (hashes % np.uint64(self.n_buckets))[order]
        starts = np.flatnonzero(np.r_[True, bucket_of[1:] != bucket_of[:-1]]) if len(keys) else np.array([], int)
        groups = sorted(np.split(order, starts[1:]) if len(keys) else [], key=len, reverse=True)
        shift = np.zeros(self.n_buckets, np.int64)
        slots = np.full(self.n, -1, np.int64)
        for g in groups:
            bucket = int(hashes[g[0]] % np.uint64(self.n_buckets))
            if len(g) == 1:
                continue
            d = 0
            while True:
                tries = np.arange(d, d + 128, dtype=np.uint64)
                at = self._slots(hashes[g][:, None], tries[None, :])
                free = (slots[at] < 0).all(axis=0)
                apart = (np.diff(np.sort(at, axis=0), axis=0) > 0).all(axis=0)
                good = np.flatnonzero(free & apart)
                if len(good):
                    shift[bucket] = d + good[0]
                    slots[at[:, good[0]]] = g
                    break
                d += 128
        rest = iter(np.flatnonzero(slots < 0).tolist())
        for g in groups:
            if len(g) == 1:
                slot = next(rest)
                slots[slot] = g[0]
                shift[int(hashes[g[0]] % np.uint64(self.n_buckets))] = -slot - 1
        self.shift = shift.tolist()
        self.keys = [keys[i] if i >= 0 else b"" for i in slots.tolist()]
        self.values = slots.tolist()
        self._hash = xxhash.xxh3_64_intdigest

    def _slots(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (h ^ (d * np.uint64(_MIX))) * np.uint64(_MIX)
        return ((x >> np.uint64(20)) % np.uint64(self.n)).astype(np.int64)

    def find(self, key: bytes) -> int:
        """Index of the key, or -1."""
        h = self._hash(key)
        d = self.shift[h % self.n_buckets]
        slot = -d - 1 if d < 0 else ((((h ^ (d * _MIX & _MASK)) * _MIX) & _MASK) >> 20) % self.n
        return self.values[slot] if self.keys[slot] == key else -1


class Vocabulary:
    """Ranks of a byte-level BPE: token bytes by id, a perfect hash of them and the merge table."""

    def __init__(self, tokens: dict[bytes, int]):
        self.token = [b""] * (max(tokens.values()) + 1)
        for t, i in tokens.items():
            self.token[i] = t
        named = sorted(tokens, key=tokens.get)
        self.ids = [tokens[t] for t in named]
        self.hash = PerfectHash(named)
        self.byte = [tokens[bytes([b])] for b in range(256)]
        #: (left id, right id) -> id of the joined token, for every way to split a token in two tokens.
        self.merge = {}
        for t, i in tokens.items():
            for cut in range(1, len(t)):
                left, right = tokens.get(t[:cut]), tokens.get(t[cut:])
                if left is not None and right is not None:
                    self.merge[left << 32 | right] = i

    def find(self, piece: bytes) -> int:
        """Token id of a whole pre-token, or -1."""
        at = self.hash.find(piece)
        return self.ids[at] if at >= 0 else -1

    def merged(self, piece: bytes) -> list[int]:
        """Ids of a pre-token: always the lowest-ranked pair first, the leftmost of equals."""
        byte, merge = self.byte, self.merge
        ids = [byte[b] for b in piece]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            rank = merge.get(ids[i] << 32 | ids[i + 1])
            if rank is not None:
                heap.append((rank, i))
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            left = ids[i]
            j = after[i] if left >= 0 else n
            if j >= n or merge.get(left << 32 | ids[j]) != rank:
                continue  # one of the two has been merged away meanwhile
            ids[i], ids[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = merge.get(rank << 32 | ids[k])
                if r is not None:
                    heappush(heap, (r, i))
            h = before[i]
            if h >= 0:
                r = merge.get(ids[h] << 32 | rank)
                if r is not None:
                    heappush(heap, (r, h))
        return [x for x in ids if x >= 0]


class Memo(dict):
    """Pre-token (str) -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        whole = self.vocabulary.find(raw)
        ids = array("I", (whole,) if whole >= 0 else self.vocabulary.merged(raw)).tobytes()
        if len(piece) < 64:
            self[piece] = ids
        return ids


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a rank file (base64 token, space, rank per line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_VOCABULARIES: dict[str, Memo] = {}


def _memo(path: str, version: str) -> Memo:
    """The worker's memo of one rank file; the vocabulary is built once per worker."""
    if version not in _VOCABULARIES:
        _VOCABULARIES[version] = Memo(Vocabulary(read_ranks(path)))
    return _VOCABULARIES[version]


def _version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_tokens, ids)``: every whole text's token ids, little-endian unsigned 32-bit.

    ``path`` is a rank file that every executor can read; each match of
    ``pattern`` is encoded by itself, special strings are ordinary text. A null
    text counts as empty (0 tokens); rows with equal or null keys are all kept.
    """
    version = _version(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        split, memo = regex.compile(pattern).findall, _memo(path, version)
        for batch in pieces(batches):
            ids = []
            for value in batch.column(1):  # one text at a time as a Python object
                t = value.as_py()
                if len(memo) > MEMO:
                    memo.clear()
                ids.append(b"".join(map(memo.__getitem__, split(t))) if t else b"")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                ["key", "n_tokens", "ids"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return (rows.mapInArrow(run, f"key {kind}, n_tokens long, ids binary")
            .withColumnRenamed("key", key))


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Replace the column ``ids`` by ``out``: the bytes that its ids stand for (null ids give null)."""
    version = _version(path)
    names = [c for c in encoded.columns if c != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = _memo(path, version).vocabulary.token
        for batch in pieces(batches):
            raw = [None if not x.is_valid else b"".join(map(token.__getitem__, array("I", x.as_py())))
                   for x in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(raw, pa.binary())], [*names, out])

    rows = encoded.select(*names, ids)
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(run, f"{kinds}, `{out}` binary")
