"""Byte-level BPE encoding and decoding with a two-tier lookup.

A pattern splits a text into pre-tokens. The first tier is a minimal perfect hash over the vocabulary: a pre-token that is
in it is one id. The second takes those that are not: their bytes form a linked list, and a heap of neighbouring pairs
by rank merges the lowest, leftmost first, until no pair is in the vocabulary.

Defined cases: null counts as empty, and gives no ids; any text is encoded, as every single byte is in the vocabulary;
special tokens aren't known, their strings are ordinary text; repeated rows give equal rows; an empty table gives no
rows. Texts are encoded whole; beside the row, a task holds one block of pre-tokens at a time. Only id and text are read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache, partial
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import DataFrame

from tidewright.llm.common import map_arrow

#: Pre-tokens whose ids a task remembers; it starts afresh when full.
MOST_CACHED = 400_000
#: Pre-tokens that are encoded at a time.
BLOCK = 1 << 17
#: Odd constants that spread displacements over the slots.
MASK, SPREAD, MIX = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


class PerfectHash:
    """A minimal perfect hash: n keys to n slots, one displacement for each small group of keys.

    The keys are stored by slot, so a lookup is one hash, one slot and one comparison, also for strangers.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.size = len(ranks)
        self.groups = max(1, self.size // 4)
        grouped: dict[int, list[tuple[int, bytes]]] = {}
        for key in ranks:
            h = xxhash.xxh3_128_intdigest(key)
            grouped.setdefault((h >> 96) % self.groups, []).append((h, key))
        self.shift = [0] * self.groups
        self.keys: list[bytes | None] = [None] * self.size
        self.ranks = [0] * self.size
        taken, free = np.zeros(self.size, dtype=bool), self.size - 1
        for g, members in sorted(grouped.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(members) == 1:  # the last groups take the free slots as they come; noted below zero
                while taken[free]:
                    free -= 1
                slots, d = [free], -free - 1
            else:
                d = self._displace([h for h, _ in members], taken)
                slots = [self._slot(h, d) for h, _ in members]
            self.shift[g] = d
            for s, (_, key) in zip(slots, members, strict=True):
                self.keys[s], self.ranks[s], taken[s] = key, ranks[key], True

    def _displace(self, hashes: list[int], taken: np.ndarray) -> int:
        """The least displacement that sends these to different free slots."""
        start = np.array([[h & MASK] for h in hashes], dtype=np.uint64)
        first, width = 0, 64
        while True:
            x = (start ^ np.arange(first, first + width, dtype=np.uint64) * np.uint64(SPREAD)) * np.uint64(MIX)
            x = (x ^ x >> np.uint64(32)) * np.uint64(MIX)
            slots = (x >> np.uint64(32)) % np.uint64(self.size)
            fits = ~taken[slots].any(axis=0)
            ordered = np.sort(slots[:, fits], axis=0)
            found = np.flatnonzero(fits)[(np.diff(ordered, axis=0) > 0).all(axis=0)]
            if len(found):
                return first + int(found[0])
            first, width = first + width, min(2 * width, 1 << 13)

    def _slot(self, h: int, d: int) -> int:
        x = ((h ^ d * SPREAD) & MASK) * MIX & MASK
        return ((x ^ x >> 32) * MIX & MASK) // (1 << 32) % self.size

    def get(self, key: bytes) -> int:
        """The key's rank, or -1."""
        h = xxhash.xxh3_128_intdigest(key)
        d = self.shift[(h >> 96) % self.groups]
        slot = -d - 1 if d < 0 else self._slot(h, d)
        return self.ranks[slot] if self.keys[slot] == key else -1


class Codec(dict):
    """Pre-tokens to ids (little-endian 32-bit), by the two tiers on first sight."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.hash = PerfectHash(ranks)
        self.pairs = ranks  # what two neighbouring pieces merge to, for the second tier
        self.vocabulary = {r: t for t, r in ranks.items()}

    def __missing__(self, token: str) -> bytes:
        if len(self) >= MOST_CACHED:
            self.clear()
        data = token.encode()
        rank = self.hash.get(data)
        merged = [rank] if rank >= 0 else self.merge(data)
        ids = struct.pack(f"<{len(merged)}I", *merged)
        if len(token) <= 64:
            self[token] = ids
        return ids

    def merge(self, data: bytes) -> list[int]:
        """Ids of a pre-token that isn't in the vocabulary."""
        n, rank = len(data), self.pairs.get
        stop = list(range(1, n + 1))  # where the piece that begins here ends; 0: no piece begins here
        before = list(range(-1, n - 1))  # where the piece before begins
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(data[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, end = heappop(heap)
            middle = stop[i]
            if not middle or middle >= n or stop[middle] != end:
                continue  # one of the two has changed since
            stop[i], stop[middle] = end, 0
            if end < n:
                before[end] = i
                after = stop[end]
                if (r := rank(data[i:after])) is not None:
                    heappush(heap, (r, i, after))
            b = before[i]
            if b >= 0 and (r := rank(data[b:end])) is not None:
                heappush(heap, (r, b, end))
        ids, i = [], 0
        while i < n:
            ids.append(rank(data[i : stop[i]]))
            i = stop[i]
        return ids

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids of a text, in blocks."""
        if len(text) < BLOCK:
            yield b"".join(map(self.__getitem__, self.pattern.findall(text)))
            return
        tokens = (m.group() for m in self.pattern.finditer(text))
        while block := list(islice(tokens, BLOCK)):
            yield b"".join(map(self.__getitem__, block))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _encode_batches(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """``id, ids``: the ids of each text as little-endian 32-bit integers."""
    c = codec(path, pattern)
    for batch in batches:
        ids = [b"".join(c.encode(t.as_py() or "")) for t in batch.column(1)]
        yield pa.record_batch([batch.column(0), pa.array(ids, pa.binary())], names=["id", "ids"])


def _decode_batches(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    c = codec(path, pattern)
    for batch in batches:
        data = [c.decode(x.as_py()) for x in batch.column(1)]
        yield pa.record_batch([batch.column(0), pa.array(data, pa.binary())], names=["id", "data"])


def _digest_batches(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    c = codec(path, pattern)
    for batch in batches:
        counts, encoded, decoded = [], [], []
        for text in batch.column(1):
            n, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
            for ids in c.encode(text.as_py() or ""):
                n += len(ids) // 4
                of_ids.update(ids)
                of_bytes.update(c.decode(ids))
            counts.append(n)
            encoded.append(of_ids.hexdigest())
            decoded.append(of_bytes.hexdigest())
        yield pa.record_batch(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(encoded), pa.array(decoded)],
            names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids``: token ids of every text as little-endian 32-bit integers."""
    chosen = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    return map_arrow(chosen, partial(_encode_batches, path=path, pattern=pattern), "id bigint, ids binary").withColumnRenamed("id", key)


def decode(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """``key, data``: the bytes behind the ``ids`` of ``encode``."""
    chosen = encoded.select(F.col(key).alias("id"), F.coalesce("ids", F.lit(b"")).alias("ids"))
    return map_arrow(chosen, partial(_decode_batches, path=path, pattern=pattern), "id bigint, data binary").withColumnRenamed("id", key)


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes every text, decodes the ids: ``key, n_tokens, ids_sha256, decoded_sha256``; no shuffle."""
    chosen = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    schema = "id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_arrow(chosen, partial(_digest_batches, path=path, pattern=pattern), schema).withColumnRenamed("id", key)
