"""Time series by node: regular axes, gap filling, splines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window


def time_axis(samples: DataFrame, dt: int, time: str = "t_s") -> DataFrame:
    """Every ``dt`` from the earliest to the latest time."""
    ends = samples.agg(F.min(time).alias("a"), F.max(time).alias("b"))
    return ends.where("a is not null").select(F.explode(F.sequence("a", "b", F.lit(dt).cast("bigint"))).alias(time))


def latest_file_wins(samples: DataFrame, order: str, keys: list[str], values: list[str]) -> DataFrame:
    """Of samples with equal keys, those of the last file."""
    return samples.groupBy(*keys).agg(*[F.max_by(v, order).alias(v) for v in values])


def on_axis(samples: DataFrame, nodes: DataFrame, axis: DataFrame, node: str, time: str = "t_s") -> DataFrame:
    """A row for every node and time of the axis; samples at other times drop out. The axis is a column of times, broadcast."""
    return nodes.select(node).distinct().crossJoin(F.broadcast(axis)).join(samples, [node, time], "left")


def fill_gaps(samples: DataFrame, node: str, time: str, values: list[str]) -> DataFrame:
    """Gaps inside a series by a straight line in time, those at its ends by the nearest value, empty series by zero.

    All variables share one window by node, so the series are shuffled and sorted once.
    """
    before = Window.partitionBy(node).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(node).orderBy(time).rowsBetween(0, Window.unboundedFollowing)
    out = samples
    for v in values:
        known = F.when(F.col(v).isNotNull(), F.col(time))
        out = out.withColumns({
            f"__v0_{v}": F.last(v, True).over(before), f"__t0_{v}": F.last(known, True).over(before),
            f"__v1_{v}": F.first(v, True).over(after), f"__t1_{v}": F.first(known, True).over(after),
        })
    filled = []
    for v in values:
        v0, t0, v1, t1 = (F.col(f"__{c}_{v}") for c in ("v0", "t0", "v1", "t1"))
        line = v0 + (v1 - v0) * (F.col(time) - t0) / (t1 - t0)
        filled.append(F.coalesce(F.col(v), line, v0, v1, F.lit(0.0)).alias(v))
    return out.select(node, time, *filled)


# --- Splines ---------------------------------------------------------------------------------------------------------

#: The one-sided difference that estimates a series' slope at its ends.
END_SLOPE = np.array([-25.0, 48.0, -36.0, 16.0, -3.0]) / 12.0


def second_derivatives(y: np.ndarray, h: float) -> np.ndarray:
    """Knots' second derivatives of the cubic through the rows of ``y``, clamped to one-sided end slopes (5 points or more)."""
    n = y.shape[1]
    if n < 5:
        raise ValueError("a spline needs five points or more")
    right = np.empty_like(y)
    right[:, 1:-1] = 6 * (y[:, 2:] - 2 * y[:, 1:-1] + y[:, :-2]) / h**2
    first, last = y[:, :5] @ END_SLOPE / h, -(y[:, :-6:-1] @ END_SLOPE) / h
    right[:, 0] = 6 * ((y[:, 1] - y[:, 0]) / h - first) / h
    right[:, -1] = 6 * (last - (y[:, -1] - y[:, -2]) / h) / h
    above, m = np.zeros(n), np.zeros_like(y)  # one elimination for all rows: their axis is the same
    diag = np.full(n, 4.0)
    diag[0] = diag[-1] = 2.0
    above[0], m[:, 0] = 1 / diag[0], right[:, 0] / diag[0]
    for k in range(1, n):
        pivot = diag[k] - above[k - 1]
        above[k], m[:, k] = 1 / pivot, (right[:, k] - m[:, k - 1]) / pivot
    for k in range(n - 2, -1, -1):
        m[:, k] -= above[k] * m[:, k + 1]
    return m


def _segments(frames: Iterator[pd.DataFrame], h: float, node: str, names: list[str]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for _, part in frame.groupby(frame[names[0]].map(len)):
            n = len(part[names[0]].iloc[0]) - 1
            out = {
                node: np.repeat(part[node].to_numpy(), n), "k": np.tile(np.arange(n), len(part)),
                "t0": np.repeat(part["t0"].to_numpy(), n) + np.tile(np.arange(n) * h, len(part)),
            }
            for name in names:
                y = np.stack(part[name].to_numpy())
                m = second_derivatives(y, h)
                out |= {f"{name}_f0": y[:, :-1].ravel(), f"{name}_f1": y[:, 1:].ravel(), f"{name}_m0": m[:, :-1].ravel(), f"{name}_m1": m[:, 1:].ravel()}
            yield pd.DataFrame(out)


def segments_of(series: DataFrame, node: str, time: str, values: list[str], dt: float) -> DataFrame:
    """``node, k, t0`` and for each value ``*_f0, *_f1, *_m0, *_m1``: each interval of gap-free, regular series.

    A node's series (bounded by the months that are loaded) become one array each, in one shuffle for all values; tasks solve whole
    batches of nodes at once.
    """
    row = F.struct(F.col(time).alias("t"), *[F.col(v).cast("double").alias(v) for v in values])
    lists = series.groupBy(node).agg(F.min(time).cast("double").alias("t0"), F.sort_array(F.collect_list(row)).alias("rows"))
    arrays = lists.select(node, "t0", *[F.col("rows")[v].alias(v) for v in values])
    kind = dict(series.dtypes)[node]
    parts = "".join(f", {v}_{c} double" for v in values for c in ("f0", "f1", "m0", "m1"))
    return arrays.mapInPandas(lambda it: _segments(it, float(dt), node, values), f"{node} {kind}, k bigint, t0 double{parts}")


def spline_segments(series: DataFrame, node: str, time: str, value: str, dt: float) -> DataFrame:
    """``node, k, t0, f0, f1, m0, m1`` for each interval of one value's series."""
    return segments_of(series, node, time, [value], dt).withColumnsRenamed({f"{value}_{c}": c for c in ("f0", "f1", "m0", "m1")})


def spline_value(t: Column, h: float, name: str = "") -> Column:
    """The cubic of a segment's columns at ``t``; ``name`` stands before those of one variable."""
    f0, f1, m0, m1 = (F.col(f"{name}{c}") for c in ("f0", "f1", "m0", "m1"))
    a, b = (F.col("t0") + h - t) / h, (t - F.col("t0")) / h
    return a * f0 + b * f1 + ((a * a * a - a) * m0 + (b * b * b - b) * m1) * (h * h / 6)


def spline_slope(t: Column, h: float) -> Column:
    a, b = (F.col("t0") + h - t) / h, (t - F.col("t0")) / h
    return (F.col("f1") - F.col("f0")) / h + ((3 * b * b - 1) * F.col("m1") - (3 * a * a - 1) * F.col("m0")) * (h / 6)


def evaluate(segments: DataFrame, times: DataFrame, start: float, h: float, last: int) -> DataFrame:
    """``value, slope`` of all series at the ``t`` of ``times``: an equi-join on the interval's number, ends included."""
    k = F.least(F.lit(last), F.greatest(F.lit(0), F.floor((F.col("t") - start) / h))).cast("bigint")
    return times.withColumn("k", k).join(segments, "k").withColumns({"value": spline_value(F.col("t"), h), "slope": spline_slope(F.col("t"), h)})
