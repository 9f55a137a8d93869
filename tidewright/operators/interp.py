"""Gaussian-weighted interpolation at points, and derivatives from two levels of neighbours."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from tidewright.functions.geo import central_angle, gaussian, kernel_gradient
from tidewright.operators.spatial import bin_nodes, radius_join

#: The least sums of weights that are divided by.
LEAST_WEIGHT, LEAST_DERIVATIVE_WEIGHT = 1e-8, 1e-16


def neighbours(points: DataFrame, entries: DataFrame, radius: float, shape: float, how: str = "inner") -> DataFrame:
    """The radius join with distance ``d`` and weight ``w``."""
    joined = radius_join(points, entries, radius, how)
    d = central_angle(F.col("lon"), F.col("lat"), F.col("n_lon"), F.col("n_lat"))
    return joined.withColumn("d", d).withColumn("w", gaussian(F.col("d"), shape))


def reweighted(points: DataFrame, known: DataFrame, nodes: DataFrame, shape: float, key: str = "pid", node: str = "node_id") -> DataFrame:
    """Weights anew for neighbours that are known already (``key, node``): no search."""
    places = nodes.select(node, F.col("lon").alias("n_lon"), F.col("lat").alias("n_lat"))
    d = central_angle(F.col("lon"), F.col("lat"), F.col("n_lon"), F.col("n_lat"))
    joined = points.select(key, "lon", "lat").join(known.select(key, node), key).join(places, node)
    return joined.withColumn("d", d).withColumn("w", gaussian(F.col("d"), shape))


def weighted_mean(near: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Weighted means of ``values`` by ``keys``, 0 where the weights are next to nothing; and ``n_nb``, the neighbours."""
    total = F.sum("w")
    means = [F.when(total > LEAST_WEIGHT, F.sum(F.col("w") * F.col(v)) / total).otherwise(0.0).alias(v) for v in values]
    return near.groupBy(*keys).agg(*means, F.count("w").alias("n_nb"))


def interpolate(points: DataFrame, field: DataFrame, radius: float, shape: float, key: str = "pid", values: tuple[str, ...] = ("u", "v"), small: bool | None = None) -> DataFrame:
    """All columns of ``points``, the ``values`` of ``field`` (nodes with values at one time) there, and ``n_nb``; 0 without neighbours.

    Points that are partitioned by ``key`` stay so: with a field of broadcast size, nothing is shuffled.
    """
    entries = bin_nodes(field.select("lon", "lat", *values), radius, small)
    near = neighbours(points, entries, radius, shape, "left")
    return weighted_mean(near, points.columns, list(values))


def derivatives(near: DataFrame, pairs: DataFrame, field: DataFrame, shape: float, key: str = "pid", node: str = "node_id", values: tuple[str, ...] = ("u", "v")) -> DataFrame:
    """For each value of ``field`` its mean and its slopes to the east and north (``_x``, ``_y``) at every point.

    ``near``: points with neighbours and weights. ``pairs``: nodes with their own neighbours. A node's gradient doesn't
    depend on the point, so it is aggregated once for each node and then joined.
    """
    here = field.select(node, *[F.col(v).alias(f"__{v}") for v in values])
    there = field.select(F.col(node).alias("other"), *values)
    g = kernel_gradient(F.col("lon"), F.col("lat"), F.col("n_lon"), F.col("n_lat"))
    inner = pairs.where(F.col(node) != F.col("other")).withColumn("g", g).withColumn("w", gaussian(F.col("g.d"), shape))
    inner = inner.join(here, node).join(there, "other")
    total = F.sum("w")
    sums = [
        F.when(total > LEAST_DERIVATIVE_WEIGHT, F.sum(F.col("w") * F.col(f"g.{side}") * (F.col(v) - F.col(f"__{v}"))) / total).otherwise(0.0).alias(f"{v}_{axis}")
        for v in values for side, axis in (("east", "x"), ("north", "y"))
    ]
    slopes = inner.groupBy(node).agg(*sums)
    outer = near.select(key, node, "w").join(slopes, node).join(field.select(node, *values), node)
    den = F.sum("w")
    means = [F.when(den > LEAST_DERIVATIVE_WEIGHT, F.sum(F.col("w") * F.col(v)) / den).otherwise(0.0).alias(v) for v in values]
    scaled = [
        F.when(den > LEAST_DERIVATIVE_WEIGHT, F.sum(F.col("w") * F.col(f"{v}_{axis}")) / den * (2 / shape)).otherwise(0.0).alias(f"{v}_{axis}")
        for v in values for axis in "xy"
    ]
    return outer.groupBy(key).agg(*means, *scaled)
