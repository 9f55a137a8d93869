"""Exact dedup over an extendible-hash index in the shared folder.

Keys are 64-bit hashes of whole texts. The directory starts with one bucket; while a bucket holds more keys than its
capacity, it splits on the next hash bit and the directory doubles where needed, until every bucket fits. Splits are worked out
from the counts of all keys by prefix, which gives the same leaves as inserting key by key; where that would make more than
``MOST_BUCKETS`` buckets, their capacity grows instead.

Repeated texts are folded in the tasks that read them, so that a text that a third of all rows hold is one row for each task, and go to
the owner of their bucket; an owner has a range of buckets, which is a range of keys. There entries of a bucket are grouped by key and
compared by their bytes; texts whose hashes collide stay apart as a chain, numbered in order of their bytes. The index is a Parquet table with a
file for each owner. Rows are looked up by the bucket that the directory gives their key, then by key, then along the chain by the
text's SHA-256, which stands for the bytes there, so that copies don't move whole.

Everything here is DataFrame functions: no Python runs on the executors.

Defined cases: null counts as the empty text; a group's row with the largest id stays; rows that repeat both id and
text are one document and share its verdict; null ids order before all others; an empty table gives an empty index and
no rows. Only the id and the text are read, so other columns, whatever their names, do no harm.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from tidewright.llm.common import materialize, scratch_path

#: Hashes that occur again are broadcast (8 bytes each) up to this many; beyond, the semi join shuffles.
BROADCAST_KEYS = 1_000_000
#: Rows that go are broadcast (some 100 bytes each) up to this many.
BROADCAST_GONE = 200_000
#: Keys that a bucket holds before it splits.
BUCKET_KEYS = 1 << 4
#: Most bits that the directory uses; keys are distinct hashes, so they spread evenly long before.
MOST_DEPTH = 30
#: Buckets are made larger, not more, beyond this many.
MOST_BUCKETS = 1 << 13


#: The key of a text; tests put a function in its place that collides.
KEY = F.xxhash64


def _prefix(key: Column, depth: int) -> Column:
    """The first ``depth`` bits of a key."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def directory_of(keys: DataFrame, capacity: int, total: int | None = None) -> list[tuple[int, int]]:
    """Leaves (depth, prefix) of the directory for the distinct ``key`` values of ``keys``.

    Key counts by prefix come from one aggregation at a depth fine enough for the number of keys; buckets over capacity
    then split, and the directory doubles, on these counts: at most a few times ``MOST_BUCKETS`` numbers.
    """
    total = keys.count() if total is None else total
    capacity = max(capacity, total // MOST_BUCKETS)
    depth = min(MOST_DEPTH, max(0, (2 * total // capacity).bit_length() + 1))
    fine = {r["p"]: r["n"] for r in keys.groupBy(_prefix(F.col("key"), depth).alias("p")).agg(F.count("*").alias("n")).collect()}
    counts = {depth: fine}
    for d in range(depth - 1, -1, -1):
        counts[d] = {}
        for p, n in counts[d + 1].items():
            counts[d][p >> 1] = counts[d].get(p >> 1, 0) + n
    leaves, open_buckets = [], [(0, 0)]
    while open_buckets:
        d, p = open_buckets.pop()
        if counts[d].get(p, 0) > capacity and d < depth:
            open_buckets += [(d + 1, 2 * p), (d + 1, 2 * p + 1)]
        else:
            leaves.append((d, p))
    return sorted(leaves, key=lambda x: (x[1] << (MOST_DEPTH + 1 - x[0]), x[0]))


def _bucket(key: Column, leaves: list[tuple[int, int]]) -> Column:
    """Number of the leaf that owns a key: a lookup in the doubled directory, an array of 2**depth pointers."""
    depth = max(d for d, _ in leaves)
    pointers = [0] * (1 << depth)
    for number, (d, p) in enumerate(leaves):
        for slot in range(p << (depth - d), (p + 1) << (depth - d)):
            pointers[slot] = number
    if len(leaves) == 1:
        return F.lit(0)
    directory = F.split(F.lit(" ".join(map(str, pointers))), " ").cast("array<int>")
    return F.get(directory, _prefix(key, depth).cast("int"))


def build_index(
    docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = BUCKET_KEYS
) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Index every text that occurs more than once: ``bucket, key, chain, text_sha256, keep_id, group_size``; and the directory's leaves.

    The first pass moves 8-byte hashes only, combined on the map side. Only texts under a hash that occurs again are moved whole: folded
    within each task first, then sent to their bucket's owner, which groups and compares what the tasks sent.
    """
    spark = docs.sparkSession
    hashed = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body")).withColumn("key", KEY(F.col("body")))
    again = hashed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("key")
    keys_path = scratch_path(spark, "exact-keys")
    again.write.parquet(keys_path)
    keys = spark.read.schema(again.schema).parquet(keys_path)
    total = keys.count()
    leaves = directory_of(keys, capacity, total)
    side = F.broadcast(keys) if total <= BROADCAST_KEYS else keys
    fold = (F.max("id").alias("id"), F.sum("n").alias("n"))
    # The reading task is part of the first grouping, so its rows are folded before they move.
    sent = hashed.join(side, "key", "left_semi").select("key", "body", "id", F.lit(1).cast("long").alias("n"), F.spark_partition_id().alias("task"))
    sent = sent.groupBy("key", "body", "task").agg(*fold).select(_bucket(F.col("key"), leaves).alias("bucket"), "key", "body", "id", "n")
    owned = sent.repartitionByRange("bucket").groupBy("bucket", "key", "body").agg(*fold)
    chain = F.row_number().over(Window.partitionBy("bucket", "key").orderBy("body")) - 1
    entries = owned.select("bucket", "key", chain.alias("chain"), F.sha2("body", 256).alias("text_sha256"), F.col("id").alias("keep_id"), F.col("n").alias("group_size"))
    path = scratch_path(spark, "exact-index")
    entries.write.parquet(path)
    return spark.read.schema(entries.schema).parquet(path), leaves


def _probes(docs: DataFrame, key: str, text: str, leaves: list[tuple[int, int]]) -> DataFrame:
    """``id, bucket, key, text_sha256`` of each row: where the directory sends it, and what it is compared by there."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("id"), KEY(body).alias("key"), F.sha2(body, 256).alias("text_sha256"))
    return rows.select("id", _bucket(F.col("key"), leaves).alias("bucket"), "key", "text_sha256")


def find_exact(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = BUCKET_KEYS) -> DataFrame:
    """One row for each document: ``key, keep_id, group_size, kept, text_sha256``."""
    index, leaves = build_index(docs, key, text, capacity)
    joined = _probes(docs, key, text, leaves).join(index, ["bucket", "key", "text_sha256"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return joined.select(
        F.col("id").alias(key),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def drop_exact(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = BUCKET_KEYS) -> DataFrame:
    """``docs`` without the rows that another row of equal text stands for; all its columns stay as they are.

    What goes is known by id and digest: a table that is broadcast within ``BROADCAST_GONE`` rows, so that texts don't
    move; beyond, the join shuffles.
    """
    index, leaves = build_index(docs, key, text, capacity)
    gone = _probes(docs, key, text, leaves).join(index, ["bucket", "key", "text_sha256"]).where(~F.col("id").eqNullSafe(F.col("keep_id")))
    gone = materialize(gone.select(F.col("id").alias("__id"), F.col("text_sha256").alias("__sha")).distinct(), "exact-gone")
    side = F.broadcast(gone) if gone.count() <= BROADCAST_GONE else gone
    same = docs[key].eqNullSafe(side["__id"]) & (F.sha2(F.coalesce(docs[text], F.lit("")), 256) == side["__sha"])
    return docs.join(side, same, "left_anti")
