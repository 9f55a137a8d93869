"""Windows over trajectory samples: unwrapping, deltas, decimation, ends, streaks."""

from __future__ import annotations

from math import pi

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from tidewright.functions.geo import wrap_lon


def _by(key: str, order: str):
    return Window.partitionBy(key).orderBy(order)


def unwrap(samples: DataFrame, key: str = "seed_id", order: str = "idx") -> DataFrame:
    """``lon_unwrapped``: without jumps over the dateline, from the wrapped first longitude on."""
    w = _by(key, order)
    here = wrap_lon(F.col("lon"))
    jump = here - F.lag(here).over(w)
    turns = F.sum(F.when(jump > pi, -2 * pi).when(jump < -pi, 2 * pi).otherwise(0.0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return samples.withColumn("lon_unwrapped", here + turns)


def delta_encode(samples: DataFrame, columns: list[str], key: str = "seed_id", order: str = "idx") -> DataFrame:
    """``d_*``: the difference from the sample before; the first stays null."""
    w = _by(key, order)
    return samples.withColumns({f"d_{c}": F.col(c) - F.lag(c).over(w) for c in columns})


def delta_decode(deltas: DataFrame, columns: list[str], key: str = "seed_id", order: str = "idx") -> DataFrame:
    """Running sums from the first value (``c``, on the first row) over ``d_c``."""
    w = _by(key, order)
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    return deltas.withColumns({c: F.first(c).over(running) + F.coalesce(F.sum(f"d_{c}").over(running), F.lit(0)) for c in columns})


def decimate(samples: DataFrame, stride: int, key: str = "seed_id", order: str = "idx") -> DataFrame:
    return samples.withColumn("__n", F.row_number().over(_by(key, order)) - 1).where(F.col("__n") % stride == 0).drop("__n")


def ends(samples: DataFrame, columns: list[str], key: str = "seed_id", order: str = "idx") -> DataFrame:
    """First and last sample of each trajectory, in one aggregation: ``first_*, last_*, first_idx, n_points``."""
    both = [f(c, order).alias(f"{name}_{c}") for c in columns for name, f in (("first", F.min_by), ("last", F.max_by))]
    return samples.groupBy(key).agg(F.min(order).alias("first_idx"), F.count("*").alias("n_points"), *both)


def streaks(samples: DataFrame, flag: str, key: str = "seed_id", order: str = "idx") -> DataFrame:
    """``streak``: how many samples in a row, up to this one, have the flag (gaps and islands)."""
    w = _by(key, order)
    island = F.row_number().over(w) - F.sum(F.col(flag).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    numbered = samples.withColumn("__island", island)
    inside = Window.partitionBy(key, "__island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return numbered.withColumn("streak", F.when(F.col(flag), F.sum(F.col(flag).cast("bigint")).over(inside)).otherwise(0)).drop("__island")
