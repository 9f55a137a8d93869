"""Best-fit packing of tokenised documents into sequences of bounded length.

Documents become token ids (by a tokenizer file) and a closing id. Only a document that is longer than a sequence is cut;
its pieces are whole sequences but for the last. Pieces are dealt to partitions and each partition packs the stream of
its pieces online into a fixed number of open bins: a piece goes to the open bin with the least free space that holds
it, found in a bitset keyed by free space; where none does and all bins are open, the fullest closes. What is still open
at a partition's end is packed once more, so that many partitions don't each leave bins half empty.

Defined cases: null and empty texts give the closing id alone; pieces arrive in the order of a hash, so results don't
depend on input order; repeated rows are packed each on its own; an empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidewright.llm.common import map_arrow, materialize
from tidewright.llm.token_counts import DIGIT, LETTER, SPACE, byte_signs, char_classes, normalise

#: Bins that a partition holds open.
OPEN_BINS = 512
#: Bins filled to this share at a partition's end are left as they are; the others' pieces are packed again.
FULL_SHARE = 0.98
#: Words whose ids a task remembers; it starts afresh when full.
MOST_CACHED = 400_000
#: Characters of a text whose words are listed at a time.
BLOCK = 1 << 18
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PLACED = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, bin bigint, offset bigint, closed boolean"


class WordIds(dict):
    """Ids of a normalised word, as little-endian 32-bit integers, from the tokenizer's model on first sight."""

    def __init__(self, tokenizer) -> None:
        self.model = tokenizer.model
        self.signs = {b: s for s, b in byte_signs().items()}

    def __missing__(self, word: str) -> bytes:
        text = word if word.isascii() and word.isprintable() else "".join(map(self.signs.__getitem__, word.encode()))
        ids = pack_ids([t.id for t in self.model.tokenize(text)])
        if len(self) >= MOST_CACHED:
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def latin_ranges(kind: int) -> str:
    """The Latin-1 signs of a class as ranges, to be put between brackets."""
    inside = np.append(char_classes()[:256] == kind, False)
    edges = np.flatnonzero(np.diff(inside, prepend=False)).reshape(-1, 2)
    return "".join(f"\\x{a:02x}-\\x{b - 1:02x}" for a, b in edges.tolist())


class TextIds:
    """Ids of texts, put together from those of their words.

    This holds for a tokenizer that lower-cases and splits texts into words before it merges, such as
    ``word_bpe_49k.json``: the ids of a text are those of its words one after another. For any other file, and for
    texts that may hold a special token, the tokenizer gets the whole text. A long text is taken in blocks, cut at spaces, which
    no word holds.
    """

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        self.by_words = steps == ["NFC", "Replace", "Lowercase"] and splits.get("behavior") == "Removed" and splits.get("invert", False)
        if self.by_words:
            pattern = splits["pattern"]["Regex"]
            self.pattern = regex.compile(pattern)
            # With the classes written out for Latin-1, the standard library's engine does the same there and is the faster one.
            for name, kind in ((r"\p{L}", LETTER), (r"\p{N}", DIGIT), (r"\s", SPACE)):
                pattern = pattern.replace(name, latin_ranges(kind))
            self.latin = re.compile(pattern)
        self.tokenizer = Tokenizer.from_file(path)
        self.words = WordIds(self.tokenizer)

    def _block(self, text: str) -> bytes:
        text = normalise(text)
        try:
            text.encode("latin-1")
            found = self.latin.findall(text)
        except UnicodeEncodeError:
            found = self.pattern.findall(text)
        return b"".join(map(self.words.__getitem__, found))

    def encode(self, text: str) -> bytes:
        if not self.by_words or "<|" in text:
            return pack_ids(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if len(text) <= BLOCK:
            return self._block(text)
        parts, at = [], 0
        while at < len(text):
            end = text.find(" ", at + BLOCK)
            end = len(text) if end < 0 else end
            parts.append(self._block(text[at:end]))
            at = end
        return b"".join(parts)


@lru_cache(maxsize=2)
def text_ids(path: str) -> TextIds:
    return TextIds(path)


def _piece_batches(batches: Iterator[pa.RecordBatch], path: str, most: int, closing: int) -> Iterator[pa.RecordBatch]:
    ids_of = text_ids(path)
    end = pack_ids([closing])
    for batch in batches:
        rows: list[tuple] = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = ids_of.encode(text.as_py() or "") + end
            for piece, at in enumerate(range(0, len(ids), 4 * most)):
                part = ids[at : at + 4 * most]
                rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
        yield _batch(rows, PIECES)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.record_batch([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


def tokenise(docs: DataFrame, path: str, most: int = 2048, key: str = "doc_id", text: str = "text", closing: int = 0) -> DataFrame:
    """Pieces of at most ``most`` tokens: ``doc_id, piece, start, length, ids_crc32``."""
    chosen = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(chosen, partial(_piece_batches, path=path, most=most, closing=closing), PIECES)


class BestFit:
    """Online best-fit with a bounded number of open bins."""

    def __init__(self, most: int, bins: int) -> None:
        self.most, self.bins = most, bins
        self.mask = 0  # bit f: some open bin has f free places
        self.by_free: dict[int, list[int]] = {}
        self.held: dict[int, list[tuple]] = {}
        self.made = 0

    def _free(self, at_least: int) -> int:
        """Least free space that is at least so much, or -1."""
        above = self.mask >> at_least
        return at_least + (above & -above).bit_length() - 1 if above else -1

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        number = bins.pop()
        if not bins:
            del self.by_free[free]
            self.mask &= ~(1 << free)
        return number

    def add(self, item: tuple, length: int) -> list[tuple[int, list[tuple]]]:
        """Places an item; returns the bins that close: those that are full, or the fullest, to make room."""
        closed = []
        free = self._free(length)
        if free < 0:
            if len(self.held) >= self.bins:
                number = self._take(self._free(0))
                closed.append((number, self.held.pop(number)))
            number, free = self.made, self.most
            self.made += 1
            self.held[number] = []
        else:
            number = self._take(free)
        self.held[number].append((item, self.most - free))
        left = free - length
        if left:
            self.by_free.setdefault(left, []).append(number)
            self.mask |= 1 << left
        else:
            closed.append((number, self.held.pop(number)))
        return closed


def _place(batches: Iterator[pa.RecordBatch], most: int, bins: int, base: int, last: bool) -> Iterator[pa.RecordBatch]:
    packer = BestFit(most, bins)
    first = base + (TaskContext.get().partitionId() << 32)
    out: list[tuple] = []

    def put(closed: list[tuple[int, list[tuple]]], done: bool) -> None:
        for number, items in closed:
            out.extend((*item, first + number, offset, done) for item, offset in items)

    for batch in batches:
        for item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            put(packer.add(item, item[3]), True)
            if len(out) >= 10_000:
                yield _batch(out, PLACED)
                out.clear()
    for number, items in packer.held.items():
        item, offset = items[-1]
        put([(number, items)], last or offset + item[3] >= FULL_SHARE * most)
    yield _batch(out, PLACED)


def _in_hash_order(pieces: DataFrame, *partitions: int) -> DataFrame:
    """Dealt evenly, whatever repeats: the hash covers all that tells pieces apart."""
    names = ["doc_id", "piece", "length", "ids_crc32"]
    mixed = pieces.withColumn("mixed", F.xxhash64(*names))
    return mixed.repartition(*partitions, "mixed").sortWithinPartitions("mixed", *names).drop("mixed")


def pack(pieces: DataFrame, most: int = 2048, bins: int = OPEN_BINS) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset`` (gapless from 0 in each sequence).

    The first pass runs on partitions by hash; open bins at its end that aren't nearly full, at most ``bins`` for each
    partition, are packed again on a sixteenth as many partitions. Its result is written to the shared folder, so both
    uses of it see the same bins, also after a lost executor.
    """
    spark = pieces.sparkSession
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    first = map_arrow(_in_hash_order(pieces), partial(_place, most=most, bins=bins, base=0, last=False), PLACED)
    first = materialize(first, "packed")
    again = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // 16)
    rest = _in_hash_order(first.where("not closed").select(*names), again)
    second = map_arrow(rest, partial(_place, most=most, bins=bins, base=1 << 62, last=True), PLACED)
    placed = first.where("closed").unionByName(second)
    return placed.select(*names, F.col("bin").alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, path: str, most: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    packed = pack(tokenise(docs, path, most, key, text), most)
    return packed.withColumnRenamed("doc_id", key) if key != "doc_id" else packed
