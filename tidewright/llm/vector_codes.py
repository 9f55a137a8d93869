"""Product quantisation of vectors: whole-number Lloyd rounds for each part, with Elkan's bounds.

Vectors become whole numbers and are cut into parts; each part position has a codebook of its own. Between rounds a table in the
shared folder holds each vector's parts, its codes, for each part an upper bound on the distance to its entry and for each entry
a lower bound on the distance to that. When entries move, bounds shift by the movement, and the triangle inequality then rules
out most entries without looking at them: an entry is passed over only where a bound says strictly that it is further away, so no
tie is decided by a bound. What is left is compared by squared distances in whole numbers, ties to the lower index. Bounds are
whole numbers too, rounded to the safe side, so codes are those of plain Lloyd rounds.

A round reads that table, writes the next, and each task adds a row with the sums of its parts by entry; of those, added up over the
tasks, one number for each entry and component is collected. Codebooks (``PARTS`` times ``ENTRIES`` entries) are all that the driver or a closure ever holds. Rounds
end early once no entry moves, as all further ones would repeat the last.

Defined cases: a null vector, or one with a null or non-finite component, is dropped, and so is one whose length isn't that of
the first kept vector or can't be cut; null ids come last among the smallest; rows that repeat an id are vectors of their own;
with fewer than ``ENTRIES`` rows the codebooks are smaller; entries may be equal, the lower one is used then; an empty table gives no rows;
components beyond +-65,536 raise an error, as their squares need more than 64 bits. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tidewright.llm.common import drop_table, map_arrow, materialize, scratch_path

#: A component x becomes floor(SCALE * x); parts of a vector; entries of a codebook; rounds.
SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Largest component as a whole number: squared distances of parts of up to 32 components stay within 64 bits.
MOST = 1 << 28
#: Distances by label are broadcast up to so many labels.
BROADCAST_LABELS = 200_000


def root_down(squares: np.ndarray) -> np.ndarray:
    """Whole roots, rounded down, of whole numbers."""
    r = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    r -= r * r > squares
    return r + ((r + 1) * (r + 1) <= squares)


def root_up(squares: np.ndarray) -> np.ndarray:
    r = root_down(squares)
    return r + (r * r < squares)


def squared(parts: np.ndarray, entries: np.ndarray, at: tuple[np.ndarray, ...]) -> np.ndarray:
    """Squared distances of the (vector, part, entry) triples ``at``."""
    v, p, e = at
    d = parts[v, p] - entries[p, e]
    return (d * d).sum(axis=1)


def first_assignment(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, upper bounds and lower bounds, from all distances."""
    n, k = len(parts), entries.shape[1]
    d2 = np.empty((n, PARTS, k), dtype=np.int64)
    for e in range(k):
        d = parts - entries[None, :, e]
        d2[:, :, e] = (d * d).sum(axis=2)
    codes = d2.argmin(axis=2)  # the first of equal ones
    return codes, root_up(np.take_along_axis(d2, codes[:, :, None], 2)[:, :, 0]), root_down(d2)


def reassign(parts: np.ndarray, entries: np.ndarray, moved: np.ndarray, codes: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Codes and bounds after entries have moved (``moved``: how far, rounded up), and how many distances were worked out."""
    k = entries.shape[1]
    place = np.arange(PARTS)
    upper = upper + moved[place, codes]
    lower = np.maximum(lower - moved[None], 0)
    between = ((entries[:, :, None] - entries[:, None]) ** 2).sum(axis=3)  # part, entry, entry
    apart = root_down(between)
    own = np.arange(k)[None, None, :] == codes[:, :, None]
    # Strictly: the bound itself may be reached, so an equally near entry is never passed over.
    open_ = lambda u: ~own & (u[:, :, None] >= lower) & (2 * u[:, :, None] >= apart[place[None, :], codes])
    v, p = np.nonzero(open_(upper).any(axis=2))
    mine = codes[v, p]
    best = squared(parts, entries, (v, p, mine))
    upper[v, p] = root_up(best)
    lower[v, p, mine] = root_down(best)
    left = open_(upper)
    known = np.zeros(codes.shape, dtype=bool)
    known[v, p] = True
    left &= known[:, :, None]
    lv, lp, le = np.nonzero(left)
    d2 = squared(parts, entries, (lv, lp, le))
    lower[lv, lp, le] = root_down(d2)
    nearest = np.full(codes.shape, np.iinfo(np.int64).max)
    nearest[v, p] = best
    np.minimum.at(nearest, (lv, lp), d2)
    code = np.where(known, k, codes)
    own_wins = nearest[v, p] == best
    np.minimum.at(code, (v[own_wins], p[own_wins]), mine[own_wins])
    tie = d2 == nearest[lv, lp]
    np.minimum.at(code, (lv[tie], lp[tie]), le[tie])
    upper[v, p] = root_up(nearest[v, p])
    return code, upper, lower, len(v) + len(d2)


def _numbers(column: pa.ListArray, rows: int, *shape: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows, *shape)


def _lists(values: np.ndarray) -> pa.ListArray:
    flat = values.reshape(len(values), -1)
    width = flat.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * width), pa.array(flat.astype(np.int32).ravel()))


STATE = ("parts", "codes", "upper", "lower")


class Sums:
    """A task's sums of parts by entry, and how many there are: one row of the state table, with nothing else in it."""

    def __init__(self, k: int, width: int) -> None:
        self.k, self.total, self.used = k, np.zeros((PARTS * k, width), dtype=np.int64), np.zeros(PARTS * k, dtype=np.int64)

    def add(self, parts: np.ndarray, codes: np.ndarray) -> None:
        slot = (codes + np.arange(PARTS) * self.k).ravel()
        np.add.at(self.total, slot, parts.reshape(-1, parts.shape[2]))
        self.used += np.bincount(slot, minlength=len(self.used))

    def row(self, kinds: list[pa.DataType]) -> pa.RecordBatch:
        nothing = [pa.nulls(1, t) for t in kinds] + [pa.nulls(1, pa.list_(pa.int32()))] * len(STATE)
        flat = np.concatenate([self.total.ravel(), self.used])
        return pa.record_batch([*nothing, pa.array([flat.tolist()], pa.list_(pa.int64()))], names=["id", "label", *STATE, "sums"])


def _rows(batch: pa.RecordBatch, parts: pa.Array, *state: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(batch.num_rows, pa.list_(pa.int64()))
    return pa.record_batch([batch.column("id"), batch.column("label"), parts, *map(_lists, state), none], names=["id", "label", *STATE, "sums"])


def _begin(batches: Iterator[pa.RecordBatch], entries: np.ndarray) -> Iterator[pa.RecordBatch]:
    sums, kinds = Sums(*entries.shape[1:]), None
    for batch in batches:
        parts = _numbers(batch.column("parts"), batch.num_rows, PARTS, entries.shape[2])
        codes, upper, lower = first_assignment(parts, entries)
        sums.add(parts, codes)
        kinds = [batch.column(c).type for c in ("id", "label")]
        yield _rows(batch, _lists(parts), codes, upper, lower)
    if kinds:
        yield sums.row(kinds)


def _go_on(batches: Iterator[pa.RecordBatch], entries: np.ndarray, moved: np.ndarray) -> Iterator[pa.RecordBatch]:
    k, width = entries.shape[1:]
    sums, kinds = Sums(k, width), None
    for batch in batches:
        n = batch.num_rows
        parts, codes, upper, lower = (_numbers(batch.column(c), n, *s) for c, s in zip(STATE, ((PARTS, width), (PARTS,), (PARTS,), (PARTS, k)), strict=True))
        codes, upper, lower, _ = reassign(parts, entries, moved, codes, upper, lower)
        sums.add(parts, codes)
        kinds = [batch.column(c).type for c in ("id", "label")]
        yield _rows(batch, batch.column("parts"), codes, upper, lower)
    if kinds:
        yield sums.row(kinds)


def moved_entries(state: DataFrame, entries: np.ndarray) -> np.ndarray:
    """Each entry becomes the floored mean of its parts; unused ones stay. One row a task is read, and one number a component collected."""
    added = state.where("sums IS NOT NULL").select(F.posexplode("sums").alias("at", "n")).groupBy("at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
    sums = {r["at"]: int(r["n"]) for r in added.collect()}
    out = entries.copy().reshape(-1)
    width = entries.shape[2]
    for at in range(len(out)):
        if used := sums.get(len(out) + at // width, 0):
            out[at] = sums[at] // used
    return out.reshape(entries.shape)


def whole_vectors(rows: DataFrame, key: str, vector: str, label: str) -> tuple[DataFrame, np.ndarray | None]:
    """``id, label, parts`` of the vectors that are kept, as whole numbers; and the codebooks (part, entry, component) to begin with."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    chosen = rows.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    fit = chosen.where(F.coalesce((F.size("v") > 0) & (F.size("v") % PARTS == 0) & finite, F.lit(False)))
    order = [F.col("id").asc_nulls_last(), "v"]
    first = fit.orderBy(*order).select(F.size("v").alias("n")).first()
    if first is None:
        return fit.selectExpr("id", "label", "CAST(v AS array<int>) AS parts"), None
    big = F.exists("v", lambda x: F.abs(x) >= MOST / SCALE)
    checked = F.when(big, F.raise_error(F.lit("a component lies beyond 65,536")).cast("array<int>")).otherwise(F.transform("v", lambda x: F.floor(x * SCALE).cast("int")))
    kept = fit.where(F.size("v") == first["n"])
    begin = kept.orderBy(*order).limit(ENTRIES).select(checked.alias("parts")).collect()
    entries = np.array([r["parts"] for r in begin], dtype=np.int64).reshape(len(begin), PARTS, -1).transpose(1, 0, 2)
    return kept.select("id", "label", checked.alias("parts")), entries


def learn(parts: DataFrame, entries: np.ndarray, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """The state table after the last assignment, and the entries it was made with. Tables of earlier rounds are removed."""
    spark = parts.sparkSession
    ints = ArrayType(IntegerType())
    schema = StructType([parts.schema["id"], parts.schema["label"], *(StructField(c, ints) for c in STATE), StructField("sums", ArrayType(LongType()))])
    rows = lambda state: state.where("sums IS NULL")

    def kept(state: DataFrame) -> tuple[DataFrame, str]:
        path = scratch_path(spark, "vector-codes")
        state.write.parquet(path)
        return spark.read.schema(schema).parquet(path), path

    state, path = kept(map_arrow(parts, partial(_begin, entries=entries), schema))
    for _ in range(rounds):
        new = moved_entries(state, entries)
        if (new == entries).all():
            break
        moved = root_up(((new - entries) ** 2).sum(axis=2))
        entries, old = new, path
        state, path = kept(map_arrow(rows(state).drop("sums"), partial(_go_on, entries=entries, moved=moved), schema))
        drop_table(spark, old)
    return rows(state), entries


def _report(batches: Iterator[pa.RecordBatch], entries: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        parts, codes = _numbers(batch.column("parts"), n, PARTS, entries.shape[2]), _numbers(batch.column("codes"), n, PARTS)
        d = parts - entries[np.arange(PARTS), codes]
        text = ["".join(f"{c:02x}" for c in row) for row in codes.tolist()]
        yield pa.record_batch([batch.column("id"), batch.column("label"), pa.array(text, pa.string()), pa.array((d * d).sum(axis=(1, 2)))], names=["id", "label", "code", "error"])


def compress(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """``key, code, error, label_error, codebooks_sha256`` of every vector that is kept.

    ``code``: two hex digits a part. ``error``: squared distances to the entries, added up over the parts; ``label_error`` adds that up over
    the rows of a label (nulls are one). ``codebooks_sha256`` is of all final components in decimal, with commas between.
    """
    parts, entries = whole_vectors(rows, key, vector, label)
    if entries is None:
        none = [F.lit(None).cast(t).alias(c) for c, t in (("code", "string"), ("error", "bigint"), ("label_error", "bigint"), ("codebooks_sha256", "string"))]
        return parts.select(F.col("id").alias(key), *none)
    state, entries = learn(parts, entries, rounds)
    schema = StructType([parts.schema["id"], parts.schema["label"], StructField("code", StringType()), StructField("error", LongType())])
    coded = materialize(map_arrow(state.select("id", "label", "parts", "codes"), partial(_report, entries=entries), schema), "vector-errors")
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "__label")
    by_label = materialize(by_label, "label-errors")
    side = F.broadcast(by_label) if by_label.count() <= BROADCAST_LABELS else by_label
    digest = hashlib.sha256(",".join(map(str, entries.ravel().tolist())).encode()).hexdigest()
    joined = coded.join(side, F.col("label").eqNullSafe(F.col("__label")))
    return joined.select(F.col("id").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
