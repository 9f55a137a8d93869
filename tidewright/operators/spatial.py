"""Radius joins, nearest nodes and their semi and anti forms, as equi-joins on cells.

Rows of cells are one radius high. Around a parallel a row has as many cells as fit in when each is at least as wide as the
radius can reach there, down to one at the poles. A node is entered in its cell and the neighbours of that, over the dateline
too, so every point looks into one cell and finds each node once. Nodes don't move, so they are entered once and points stay
single rows; the exact metric then decides. Only a node table of a checked size is broadcast.
"""

from __future__ import annotations

from math import pi

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from tidewright.functions.geo import metric2, wrap_lon
from tidewright.operators.storage import cut_lineage

#: Cell entries (some 60 bytes each) that are broadcast; beyond, joins shuffle by cell.
BROADCAST_ENTRIES = 500_000


def _row(lat: Column, radius: float) -> Column:
    return F.floor(lat / radius).cast("int")


def _cells(row: Column, radius: float) -> Column:
    """Cells in a row: pairs within the radius have a mean latitude of at most two rows further from the equator."""
    edge = F.least((F.abs(row) + 2) * F.lit(radius), F.lit(pi / 2))
    return F.greatest(F.lit(1), F.floor(F.lit(2 * pi / radius) * F.cos(edge))).cast("int")


def _cell(lon: Column, cells: Column) -> Column:
    return F.least(cells - 1, F.floor((F.lit(pi) - wrap_lon(-lon)) / (2 * pi) * cells)).cast("int")


def bin_nodes(nodes: DataFrame, radius: float, small: bool | None = None) -> DataFrame:
    """Cell entries of nodes (``lon, lat`` and others): ``cx, cy`` and the columns, longitude and latitude as ``n_lon, n_lat``."""
    rows = nodes.withColumn("cy", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: _row(F.col("lat"), radius) + d)))
    cells = _cells(F.col("cy"), radius)
    rows = rows.withColumn("__n", cells).withColumn("__c", _cell(F.col("lon"), F.col("__n")))
    near = F.array_distinct(F.array(*[F.pmod(F.col("__c") + d, F.col("__n")) for d in (-1, 0, 1)]))
    entries = rows.withColumn("cx", F.explode(near)).drop("__n", "__c").withColumnsRenamed({"lon": "n_lon", "lat": "n_lat"})
    small = entries.count() <= BROADCAST_ENTRIES if small is None else small
    return F.broadcast(entries) if small else entries


def n_entries(nodes: DataFrame, radius: float) -> int:
    """How many cell entries these nodes have."""
    return bin_nodes(nodes.select("lon", "lat"), radius, small=False).count()


def fits_broadcast(nodes: DataFrame, radius: float) -> bool:
    """Whether these nodes' entries are few enough to broadcast; the same for any values at the same nodes."""
    return n_entries(nodes, radius) <= BROADCAST_ENTRIES


def cell_of(radius: float) -> dict[str, Column]:
    """A point's cell, ``p_cx, p_cy``."""
    row = _row(F.col("lat"), radius)
    return {"p_cy": row, "p_cx": _cell(F.col("lon"), _cells(row, radius))}


def binned(points: DataFrame, radius: float) -> DataFrame:
    """Points with their cell, ``p_cx, p_cy``."""
    return points.withColumns(cell_of(radius))


def distance2() -> Column:
    return metric2(F.col("lon"), F.col("lat"), F.col("n_lon"), F.col("n_lat"))


def same_cell() -> Column:
    return (F.col("p_cx") == F.col("cx")) & (F.col("p_cy") == F.col("cy"))


def radius_join(points: DataFrame, entries: DataFrame, radius: float, how: str = "inner") -> DataFrame:
    """Points with the nodes nearer than ``radius``: all columns of both, and ``d2``. Their names must differ."""
    joined = binned(points, radius).join(entries, same_cell() & (distance2() < radius * radius), how)
    if how in ("left_semi", "left_anti"):
        return joined.select(*points.columns)
    return joined.withColumn("d2", distance2()).drop("p_cx", "p_cy", "cx", "cy")


def _within(points: DataFrame, entries: DataFrame, radius: float, limit: float, how: str) -> DataFrame:
    return binned(points, radius).join(entries, same_cell() & (distance2() <= limit * limit), how).select(*points.columns)


def near(points: DataFrame, nodes: DataFrame, limit: float) -> DataFrame:
    """Points with some node at ``limit`` or nearer: a semi join."""
    radius = limit * (1 + 1e-9)
    return _within(points, bin_nodes(nodes.select("lon", "lat"), radius), radius, limit, "left_semi")


def not_nearer(points: DataFrame, nodes: DataFrame, limit: float) -> DataFrame:
    """Points without a node nearer than ``limit``: an anti join."""
    return radius_join(points, bin_nodes(nodes.select("lon", "lat"), limit), limit, "left_anti")


def coast_band(points: DataFrame, sea: DataFrame, land: DataFrame, sea_tolerance: float, land_least: float, land_most: float) -> DataFrame:
    """Points by the coast: sea within the tolerance, the nearest land in [land_least, land_most]."""
    return near(not_nearer(near(points, sea, sea_tolerance), land, land_least), land, land_most)


def _leveled(nodes: DataFrame, radii: list[float], levels: list[int]) -> DataFrame:
    """Cell entries of nodes at several radii, ``level`` being a radius' number."""
    out = None
    for n in levels:
        one = bin_nodes(nodes, radii[n], small=False).withColumn("level", F.lit(n))
        out = one if out is None else out.unionByName(one)
    return out


def _best(points: DataFrame, nodes: DataFrame, radii: list[float], key: str, node: str) -> DataFrame:
    """For points (``key, lon, lat, level``) the nearest of the nodes that are entered in their cell at their level."""
    levels = sorted(r["level"] for r in points.select("level").distinct().collect())  # a dozen numbers at most
    if not levels:
        return points.select(key, "lon", "lat", "level", F.lit(None).cast("double").alias("d2"), F.lit(None).cast(nodes.schema[node].dataType).alias(node))
    cell = F.coalesce(*[F.when(F.col("level") == n, _place(radii[n])) for n in levels])
    asked = points.withColumn("p", cell).select(key, "lon", "lat", "level", "p.*")
    hits = asked.join(_leveled(nodes, radii, levels), ["level", "cx", "cy"])
    best = hits.groupBy(key, "lon", "lat", "level").agg(F.min(F.struct(distance2().alias("d2"), node)).alias("best"))
    return best.select(key, "lon", "lat", "level", "best.d2", f"best.{node}")


def _place(radius: float) -> Column:
    row = _row(F.col("lat"), radius)
    return F.struct(_cell(F.col("lon"), _cells(row, radius)).alias("cx"), row.alias("cy"))


def nearest(points: DataFrame, nodes: DataFrame, radius: float, key: str, node: str = "node_id") -> DataFrame:
    """``key, node, d2`` of the nearest node (the smallest number of equally near ones).

    Radii from ``radius`` on double up to the whole sphere; each has its own cells. One pass finds for each point the finest of them at which
    nodes are entered in its cell, and the nearest of those bounds the distance: if it lies within the radius, it is the nearest of all. The
    other points look once more, at the first radius beyond their bound. So there are three joins, however far points lie.
    """
    if nodes.isEmpty():
        raise ValueError("no nodes")
    radii = [radius]
    while radii[-1] <= 2 * pi:
        radii.append(2 * radii[-1])
    places, asked = nodes.select(node, "lon", "lat"), points.select(key, "lon", "lat")
    occupied = _leveled(places.select("lon", "lat"), radii, list(range(len(radii)))).select("level", "cx", "cy").distinct()
    cells = F.array(*[F.struct(F.lit(n).alias("level"), _place(r).alias("p")) for n, r in enumerate(radii)])
    looked = asked.withColumn("c", F.explode(cells)).select(key, "lon", "lat", "c.level", "c.p.cx", "c.p.cy")
    finest = looked.join(occupied, ["level", "cx", "cy"], "left_semi").groupBy(key, "lon", "lat").agg(F.min("level").alias("level"))
    bound = cut_lineage(_best(cut_lineage(finest), places, radii, key, node))
    squares = F.array(*[F.lit(r * r) for r in radii])
    within = F.col("d2") < F.get(squares, F.col("level"))
    again = bound.where(~within).withColumn("level", F.size(F.filter(squares, lambda x: x <= F.col("d2")))).drop("d2", node)
    return bound.where(within).unionByName(_best(cut_lineage(again), places, radii, key, node)).select(key, node, "d2")


def node_pairs(nodes: DataFrame, radius: float, node: str = "node_id") -> DataFrame:
    """Each node with the others within ``radius``: ``node, other`` and both places. Computed once, as nodes don't move."""
    others = nodes.select(F.col(node).alias("other"), "lon", "lat")
    return radius_join(nodes.select(node, "lon", "lat"), bin_nodes(others, radius), radius).where(F.col(node) != F.col("other"))
