"""Importance resampling of documents towards a target distribution.

Features are runs of words, hashed into buckets. The documents' counts by bucket are a sparse matrix, persisted as CSR blocks in
the shared folder: a block has the ids and lengths of its documents, the row pointers, and the buckets and counts of all its
entries. Its column sums and those of the target's matrix are the two distributions; their log ratio is a bucket's gain; the
product of the matrix and the gains, over a document's number of features, is its weight. Documents are then drawn without
replacement by their weight plus a Gumbel number that a hash of the id gives, which is the same in every run.

Only a vector of bucket size is broadcast or collected, whatever the corpus's size. Ranks come from a global order in range
partitions (two passes), not from one task.

Defined cases: a null or empty text has no words, no features, weight 0 and is never drawn; a null id counts as an empty one;
repeated rows are documents of their own, and where ids are equal too the greater weight and then the smaller number of features
goes first; an empty target or table of documents has a distribution of zeros (plus one); other columns aren't read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from tidewright.llm.common import map_arrow, materialize, scratch_path
from tidewright.operators.numbering import numbered

#: Buckets of the features, and the longest run of words.
BUCKETS, LONGEST_RUN = 10_000, 2
#: Documents with fewer words aren't drawn; of the others, this many in a hundred are.
LEAST_WORDS, PERCENT = 20, 25
SEED = 7
#: Entries of a block (a longer document is a block of its own) and blocks of a row group: a reader decodes a row group at once, some 16 MB.
BLOCK_ENTRIES, GROUP_BLOCKS = 1 << 16, 32

#: Everything but digits, lower-case letters and what lies beyond ASCII parts words; capitals become small first.
_PLAIN = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def bucket_runs(text: str | None, buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> tuple[int, np.ndarray]:
    """The number of words of a whole text, and the bucket of each run of 1 to ``longest`` words: CRC-32 of its bytes."""
    words = (text or "").encode().translate(_PLAIN).split()
    ends = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    found = [ends]
    for n in range(2, longest + 1):
        # A run's checksum goes on from that of the run one word shorter.
        so_far = map(zlib.crc32, repeat(b" "), found[-1][: max(0, len(words) - n + 1)].tolist())
        found.append(np.fromiter(map(zlib.crc32, words[n - 1 :], so_far), np.uint32, max(0, len(words) - n + 1)))
    return len(words), np.concatenate(found) % np.uint32(buckets)


def _csr(batches: Iterator[pa.RecordBatch], buckets: int, longest: int) -> Iterator[pa.RecordBatch]:
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    for batch in batches:
        found = [bucket_runs(t.as_py(), buckets, longest) for t in batch.column("text")]
        entries = [np.unique(runs, return_counts=True) for _, runs in found]
        ends, first = np.cumsum([len(at) for at, _ in entries]), 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + BLOCK_ENTRIES, side="right")))
            words, n_features = zip(*((n, len(runs)) for n, runs in found[first:last]), strict=True)
            start = np.concatenate([[0], ends[first:last] - before]).astype(np.int32)
            flat = [np.concatenate([e[k] for e in entries[first:last]]).astype(np.int32) for k in (0, 1)]
            yield pa.record_batch(
                [one(batch.column("id")[first:last]), one(pa.array(words, pa.int32())), one(pa.array(n_features, pa.int64())), one(pa.array(start)), one(pa.array(flat[0])), one(pa.array(flat[1]))],
                names=["ids", "n_words", "n_features", "row_start", "buckets", "counts"],
            )
            first = last


def count_matrix(docs: DataFrame, key: str, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> DataFrame:
    """The sparse document-by-bucket matrix of counts, in CSR blocks of some documents each, written to the shared folder.

    Blocks and row groups are bounded by their entries, so that a task's memory doesn't hang on how much it reads.
    """
    chosen = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    ints, longs = ArrayType(IntegerType()), ArrayType(LongType())
    fields = {"ids": ArrayType(chosen.schema["id"].dataType), "n_words": ints, "n_features": longs, "row_start": ints, "buckets": ints, "counts": ints}
    schema = StructType([StructField(n, t) for n, t in fields.items()])
    path = scratch_path(docs.sparkSession, "csr")
    map_arrow(chosen, partial(_csr, buckets=buckets, longest=longest), schema).write.option("parquet.block.row.count.limit", GROUP_BLOCKS).parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def _add_columns(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(buckets, dtype=np.int64)
    for batch in batches:
        at, n = (batch.column(c).flatten().to_numpy() for c in ("buckets", "counts"))
        total += np.bincount(at, weights=n, minlength=buckets).astype(np.int64)  # a block's counts are far below 2 ** 53
    used = np.flatnonzero(total)
    yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all documents lie in each bucket; tasks add up their blocks, one sum a bucket is collected."""
    parts = map_arrow(matrix.select("buckets", "counts"), partial(_add_columns, buckets=buckets), "bucket int, n bigint")
    total = np.zeros(buckets, dtype=np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[r["bucket"]] = r["n"]
    return total


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket the floored 1000-fold log of the smoothed ratio of its shares in the target and in the corpus."""
    width, s_all, t_all = len(raw), float(raw.sum()), float(target.sum())
    ratio = ((t + 1.0) * (s_all + width) / ((s + 1.0) * (t_all + width)) for s, t in zip(raw.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], dtype=np.int64)


def _times(batches: Iterator[pa.RecordBatch], vector: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            ids, n_words, n_features, start, at, n = (batch.column(c)[k].values for c in ("ids", "n_words", "n_features", "row_start", "buckets", "counts"))
            so_far = np.concatenate([[0], np.cumsum(vector[at.to_numpy()] * n.to_numpy())])
            start, features = start.to_numpy(), n_features.to_numpy()
            total = so_far[start[1:]] - so_far[start[:-1]]
            weight = np.where(features > 0, total // np.maximum(features, 1), 0)
            yield pa.record_batch([ids, n_words, n_features, pa.array(weight)], names=["id", "n_words", "n_features", "weight"])


def weights(matrix: DataFrame, gain: np.ndarray) -> DataFrame:
    """``id, n_words, n_features, weight``: the matrix times the gains, over each document's features (floored)."""
    kind = matrix.schema["ids"].dataType.elementType
    schema = StructType([StructField("id", kind), StructField("n_words", IntegerType()), StructField("n_features", LongType()), StructField("weight", LongType())])
    return map_arrow(matrix, partial(_times, vector=gain), schema)


def gumbel(key: Column, seed: int = SEED) -> Column:
    """The floored 1000-fold Gumbel number that the id's hash stands for."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(share)))


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_key: str = "item_id", target_text: str = "text",
    buckets: int = BUCKETS, longest: int = LONGEST_RUN, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """``key, n_features, weight, score, rank`` of every document; rank 1, 2, ... by falling score for those drawn, null for the others.

    Of the documents with ``least_words`` words or more, ``percent`` in a hundred are drawn (the feature, rounded down).
    """
    matrix = count_matrix(docs, key, text, buckets, longest)
    aim = count_matrix(target, target_key, target_text, buckets, longest)
    gain = gains(column_sums(matrix, buckets), column_sums(aim, buckets))
    scored = weights(matrix, gain).withColumn("score", F.col("weight") + gumbel(F.col("id"), seed))
    scored = materialize(scored, "resampling-scores")
    able = F.col("n_words") >= least_words
    drawn = percent * scored.where(able).count() // 100
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("weight").desc(), F.col("n_features")]
    ranked = numbered(scored.where(able), order, "rank", start=1).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(~able).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.unionByName(rest).select(F.col("id").alias(key), "n_features", "weight", "score", "rank")
