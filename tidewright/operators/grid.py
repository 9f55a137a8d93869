"""Grids: nodes from axes, masks, sub-domains, unpacking of stored values."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from tidewright.operators.numbering import numbered

#: Fixed value: stands for missing where a variable names no other.
MISSING = -30000.0


def build_nodes(lons: DataFrame, lats: DataFrame) -> DataFrame:
    """Every ``lat`` row (``j, lat_deg``) with every ``lon`` column (``i, lon_deg``): ``cell_idx, lon, lat``, in radians.

    Axes are short (thousands), so the shorter one is broadcast and the product is the grid itself.
    """
    n = F.lit(lons.count())
    return lats.crossJoin(F.broadcast(lons)).select(
        (F.col("j") * n + F.col("i")).cast("bigint").alias("cell_idx"), F.radians("lon_deg").alias("lon"), F.radians("lat_deg").alias("lat")
    )


def unpack(raw: Column, scale: Column | float = 1.0, offset: Column | float = 0.0, fill: Column | None = None, missing: Column | None = None, sentinel: bool = True) -> Column:
    """``raw * scale + offset``; null where the raw value is ``_FillValue``, else ``missing_value``, else the sentinel."""
    marks = [c for c in (fill, missing) if c is not None] + ([F.lit(MISSING)] if sentinel else [])
    value = raw.cast("double") * scale + offset
    return F.when(raw.cast("double") == F.coalesce(*marks).cast("double"), None).otherwise(F.nanvl(value, F.lit(None).cast("double"))) if marks else value


def time_unit_seconds(units: Column) -> Column:
    """Seconds in a unit of time: by the first of hour, day, sec that its name holds; else 1."""
    u = F.lower(units)
    return F.when(u.contains("hour"), 3600).when(u.contains("day"), 86400).otherwise(1)


def sea_mask(samples: DataFrame, node: str = "cell_idx", time: str = "t_s", value: str = "value") -> DataFrame:
    """A cell is sea where its value at the earliest time of all is not missing."""
    first = samples.agg(F.min(time).alias("first"))
    return samples.join(F.broadcast(first), F.col(time) == F.col("first")).groupBy(node).agg(F.max(F.col(value).isNotNull()).alias("sea"))


def number_sea(nodes: DataFrame) -> DataFrame:
    """``sea_idx``: dense numbers of the sea nodes in order of ``cell_idx`` within a domain, which may be of any size."""
    return numbered(nodes.where("sea"), ["cell_idx"], "sea_idx", within=["domain"])


def sea_and_land(domains: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Sea nodes of all domains and, as their complement, land nodes; an error where either is empty."""
    nodes = domains[0].withColumn("domain", F.lit(1))
    for k, d in enumerate(domains[1:], 2):
        nodes = nodes.unionByName(d.withColumn("domain", F.lit(k)))
    sea, land = nodes.where("sea"), nodes.where("not sea")
    for name, part in (("sea", sea), ("land", land)):
        if part.isEmpty():
            raise ValueError(f"no {name} nodes")
    return sea, land


def masked(samples: DataFrame, nodes: DataFrame) -> DataFrame:
    """Samples with land forced to null."""
    return samples.join(nodes.select("cell_idx", "sea"), "cell_idx").withColumn("value", F.when(F.col("sea"), F.col("value"))).drop("sea")


def at_time(samples: DataFrame, t: float, time: str = "t_s") -> DataFrame:
    """The slice at a time, rounded to whole seconds; an error where there is none."""
    found = samples.where(F.col(time) == F.round(F.lit(t)).cast("bigint"))
    if found.isEmpty():
        raise KeyError(f"no slice at {t}")
    return found


def at_index(samples: DataFrame, index: int, time: str = "t_s") -> DataFrame:
    """The n-th slice in order of time, from 0."""
    times = samples.select(time).distinct().orderBy(time).limit(index + 1).tail(1) if index >= 0 else []
    if not times or samples.select(time).distinct().count() <= index:
        raise IndexError(f"no slice {index}")
    return samples.where(F.col(time) == times[0][0])


def coast_rows(land: DataFrame, stride: int = 8) -> DataFrame:
    """Every ``stride``-th land point of a domain, in degrees with a label."""
    return numbered(land, ["cell_idx"], "n", within=["domain"]).where(F.col("n") % stride == 0).select(
        F.degrees("lon").alias("lon_deg"), F.degrees("lat").alias("lat_deg"), F.lit("land").alias("label")
    )
