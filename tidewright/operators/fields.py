"""Velocity fields as tables of nodes and time intervals, and how moving particles meet them.

Nodes don't move, so they are entered in cells once; what changes is the table of values, ``node_id, k`` and the columns that ``u``
and ``v`` are worked out from, each particle at its own time. A step asks for the one or two intervals that its times lie in.

A field whose entries are few (counted) is broadcast. A larger one is cut into tiles, and for a number of steps particles stay with
the tile they are in: its nodes and those of a *halo* around it come along, as wide as the search radius and the furthest that the
field's greatest speed can carry a particle in these steps. So every node that a particle can meet on its way is in its
partition, and no step shuffles. Tiles with many particles are split by a hash of the key, and their nodes repeated for each share;
tiles without particles take no nodes at all. Nodes and particles beyond a pole (latitudes of more than a right angle) are dealt out by the
place on the sphere that they stand for, as a particle's first move takes it there.

With tiles each step is a job of its own: an operator takes a page of memory at least (megabytes), however few its rows, so a task of many steps
needs memory for all their joins at once. Rows stay in their partitions, on disk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from math import pi

import pyspark.sql.functions as F
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession

from tidewright.functions.geo import EARTH_RADIUS_M, central_angle, gaussian, on_sphere, wrap_lon
from tidewright.operators import spatial
from tidewright.operators.interp import LEAST_WEIGHT
from tidewright.operators.series import spline_value
from tidewright.operators.storage import settings

#: Particles of a share of a tile; tiles are this many times as high as their halo is wide.
SHARE_ROWS, TILE_HALOS = 1_000_000, 4
#: Nodes' cell entries of a partition, about; a step's joins hold them in memory.
PART_ENTRIES = 250_000
#: Greatest part of h ** 2 that a knot's second derivative adds to a cubic within its interval: max of (a - a ** 3) / 6.
BULGE = 0.0642


@dataclass(frozen=True)
class Field:
    """``nodes``: ``node_id, lon, lat``. ``values``: a row for each node and interval ``k``. ``k_of``: the interval of a time.

    ``u`` and ``v`` are made of the values' columns and the column ``t``; ``fastest`` bounds the speed within a row's interval.
    """

    nodes: DataFrame
    values: DataFrame
    k_of: Callable[[Column], Column]
    u: Column
    v: Column
    fastest: Column

    def between(self, low: int, high: int) -> DataFrame:
        """Values of all intervals from that of ``low`` to that of ``high``."""
        return self.values.where(F.col("k").between(self.k_of(F.lit(low)), self.k_of(F.lit(high))))


def slots(nodes: DataFrame, samples: DataFrame, time: str = "t_idx") -> Field:
    """A field that is known at whole numbers of ``time`` (``node_id, time, u, v``) and isn't interpolated between them."""
    values = samples.select("node_id", F.col(time).cast("bigint").alias("k"), F.col("u").alias("f_u"), F.col("v").alias("f_v"))
    return Field(nodes.select("node_id", "lon", "lat"), values, lambda t: t.cast("bigint"), F.col("f_u"), F.col("f_v"), F.hypot("f_u", "f_v"))


def splines(nodes: DataFrame, segments: DataFrame, start: float, h: float, last: int) -> Field:
    """A field of cubics: ``segments`` (``node_id, k, t0`` and ``u_*, v_*``) of intervals 0 to ``last`` from ``start`` on."""
    k_of = lambda t: F.least(F.lit(last), F.greatest(F.lit(0), F.floor((t - F.lit(start)) / F.lit(h)))).cast("bigint")
    most = lambda c: F.greatest(F.abs(f"{c}_f0"), F.abs(f"{c}_f1")) + BULGE * h * h * (F.abs(f"{c}_m0") + F.abs(f"{c}_m1"))
    return Field(nodes.select("node_id", "lon", "lat"), segments, k_of, spline_value(F.col("t"), h, "u_"), spline_value(F.col("t"), h, "v_"), F.hypot(most("u"), most("v")))


def in_tiles(nodes: DataFrame, tile: float, halo: float) -> DataFrame:
    """Nodes with every tile (``ty, tx``) that they or its halo lie in. ``tile`` is at least as high as the halo is wide."""
    lon, lat = on_sphere(F.col("lon"), F.col("lat"))
    rows = nodes.withColumns({"__lon": lon, "__lat": lat})
    lon, lat = F.col("__lon"), F.col("__lat")
    rows = rows.withColumn("ty", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: spatial._row(lat, tile) + d)))
    count = spatial._cells(F.col("ty"), tile)
    here = spatial._cell(lon, count)
    rows = rows.withColumn("__n", count).withColumn("__near", F.array_distinct(F.array(*[F.pmod(here + d, count) for d in (-1, 0, 1)])))
    rows = rows.withColumn("tx", F.explode("__near"))
    up = F.greatest(F.col("ty") * F.lit(tile) - lat, lat - (F.col("ty") + 1) * F.lit(tile))
    # The gap to the tile in longitude, over the dateline too, at the latitude where it is shortest.
    half = F.lit(pi) / F.col("__n")
    middle = F.lit(-pi) + (2 * F.col("tx") + 1) * half
    side = F.greatest(F.abs(wrap_lon(lon - middle)) - half, F.lit(0.0))
    shrink = F.cos(F.least(F.abs(lat) + 2 * halo, F.lit(pi / 2)))
    return rows.where((up <= halo) & (side * shrink <= halo)).drop("__n", "__near", "__lon", "__lat")


def tile_of(points: DataFrame, tile: float) -> DataFrame:
    lon, lat = on_sphere(F.col("lon"), F.col("lat"))
    return points.withColumn("ty", spatial._row(lat, tile)).withColumn("tx", spatial._cell(lon, spatial._cells(F.col("ty"), tile)))


class Meeting:
    """Particles with a field and land, over some steps at a time: ``deal`` first, then ``velocity`` and ``near_land`` for each step.

    ``small`` says whether the field is broadcast; it is found by a count of the entries where it isn't given. What the steps work out is
    the same in each, so its columns are built once: each call to the JVM costs about a millisecond of the driver.
    """

    def __init__(self, field: Field, land: DataFrame | None, radius: float, shape: float, land_limit: float, dt: float, key: str, small: bool | None = None) -> None:
        self.field, self.radius, self.shape, self.limit, self.dt, self.key = field, radius, shape, land_limit, dt, key
        self.land = land.select("lon", "lat") if land is not None else None
        self.land_radius = land_limit * (1 + 1e-9)
        self.size = spatial.n_entries(field.nodes, radius) if small is None or not small else 0
        self.small = self.size <= spatial.BROADCAST_ENTRIES and (land is None or spatial.fits_broadcast(self.land, self.land_radius)) if small is None else small
        self.kept: list[DataFrame] = []
        self.k, self.cell = field.k_of(F.col("t")), spatial.cell_of(radius)
        self.within = spatial.same_cell() & (spatial.distance2() < radius * radius)
        w = F.when(F.col("k").isNotNull(), gaussian(central_angle(F.col("lon"), F.col("lat"), F.col("n_lon"), F.col("n_lat")), shape))
        self.weighted = [w.alias("w"), field.u.alias("u"), field.v.alias("v")]
        total = F.sum("w")
        means = [F.when(total > LEAST_WEIGHT, F.sum(F.col("w") * F.col(c)) / total).otherwise(0.0).alias(c) for c in ("u", "v")]
        self.means = [*means, F.count("w").alias("n_nb")]
        if land is not None:
            self.land_cell = spatial.cell_of(self.land_radius)
            self.touches = spatial.same_cell() & (spatial.distance2() <= land_limit * land_limit)
            self.touched = (F.count("n_lat") > 0).alias("near_land")

    @contextmanager
    def deal(self, rows: DataFrame, low: int, high: int, steps: int) -> Iterator[DataFrame]:
        """Deals particles out for ``steps`` steps within the times ``low`` to ``high``; what is done with them is done inside."""
        self.columns = [] if self.small else ["slot"]
        if self.small:
            self.entries = spatial.bin_nodes(self.field.nodes, self.radius, small=False)
            self.on_land = spatial.bin_nodes(self.land, self.land_radius, small=True) if self.land is not None else None
            yield rows.repartition(self.key)
            return
        # All exchanges inside are asked for by number; joins on a tile and more are content with rows dealt out by tile.
        with settings(rows.sparkSession, {"spark.sql.adaptive.enabled": "false", "spark.sql.requireAllClusterKeysForCoPartition": "false"}):
            yield self._tiles(rows, low, high, steps)
        for df in self.kept:
            df.unpersist()
        self.kept = []

    def _stay(self, df: DataFrame) -> DataFrame:
        df = df.persist(StorageLevel.DISK_ONLY)
        self.kept.append(df)
        return df

    def settle(self, state: DataFrame) -> DataFrame:
        """``state``, with tiles worked out now, in the partitions that it is in; the next step begins from there."""
        if self.small:
            return state
        state = self._stay(state)
        state.count()
        return state

    def _tiles(self, rows: DataFrame, low: int, high: int, steps: int) -> DataFrame:
        spark, values = rows.sparkSession, self.field.between(low, high)
        speed = values.agg(F.max(self.field.fastest)).first()[0] or 0.0
        halo = speed * self.dt * steps / EARTH_RADIUS_M * (1 + 1e-9) + max(self.radius, self.land_radius)
        tile = min(TILE_HALOS * halo, pi)
        placed = tile_of(rows, tile)
        # One number for each tile of the sphere that holds particles: some (pi / tile) ** 2 at most.
        many = placed.groupBy("ty", "tx").agg(F.count("*").alias("n")).orderBy("ty", "tx").collect()
        shares, slot = [], 0
        for r in many:
            n = -(-r["n"] // SHARE_ROWS)
            shares.append((r["ty"], r["tx"], slot, n))
            slot += n
        tiles = F.broadcast(spark.createDataFrame(shares, "ty int, tx int, first_slot int, n_slots int"))
        # A node is in some (1 + 2 / TILE_HALOS) ** 2 tiles.
        enough = int(self.size * (1 + 2 / TILE_HALOS) ** 2) // PART_ENTRIES
        parts = max(1, min(slot, max(enough, int(spark.conf.get("spark.sql.shuffle.partitions")))))

        def spread(nodes: DataFrame, columns: list[str]) -> DataFrame:
            copies = in_tiles(nodes, tile, halo).join(tiles, ["ty", "tx"])
            shared = copies.withColumn("slot", F.explode(F.sequence(F.col("first_slot"), F.col("first_slot") + F.col("n_slots") - 1)))
            return shared.select("slot", *columns)

        # Nodes are shuffled before they are entered in cells, of which each has some nine.
        nodes = self.field.nodes
        self.entries = self._stay(spatial.bin_nodes(spread(nodes, ["node_id", "lon", "lat"]).repartition(parts, "slot"), self.radius, small=False))
        own = values.columns
        self.values = self._stay(values.join(spread(nodes, ["node_id"]), "node_id").select("slot", *own).repartition(parts, "slot").sortWithinPartitions("k"))
        self.on_land = self._stay(spatial.bin_nodes(spread(self.land, ["lon", "lat"]).repartition(parts, "slot"), self.land_radius, small=False)) if self.land is not None else None
        share = F.col("first_slot") + F.pmod(F.xxhash64(self.key), F.col("n_slots")).cast("int")
        return placed.join(tiles, ["ty", "tx"]).withColumn("slot", share).select(*rows.columns, "slot").repartition(parts, "slot")

    def velocity(self, rows: DataFrame, live: Column, low: int, high: int) -> DataFrame:
        """``rows`` with ``u, v`` (0 without neighbours) and ``n_nb``; rows that aren't ``live`` meet no node. Times: ``low`` to ``high``."""
        columns = rows.columns
        points = rows.withColumns(self.cell | {"p_k": F.when(live, self.k), "p_cx": F.when(live, self.cell["p_cx"])})
        if self.small:
            side = F.broadcast(self.field.between(low, high).join(F.broadcast(self.entries), "node_id"))
            near = points.join(side, self.within & (F.col("p_k") == F.col("k")), "left")
        else:
            side = self.entries.withColumnRenamed("slot", "e_slot").hint("shuffle_hash")
            near = points.join(side, (F.col("slot") == F.col("e_slot")) & self.within, "left")
            at = self.values.where(F.col("k").between(self.field.k_of(F.lit(low)), self.field.k_of(F.lit(high))))
            at = at.withColumnsRenamed({"slot": "v_slot", "node_id": "v_node"}).hint("shuffle_hash")
            near = near.join(at, (F.col("slot") == F.col("v_slot")) & (F.col("node_id") == F.col("v_node")) & (F.col("p_k") == F.col("k")), "left")
        return near.select(*columns, *self.weighted).groupBy(*columns).agg(*self.means)

    def near_land(self, rows: DataFrame, asked: Column) -> DataFrame:
        """``rows`` with ``near_land``: some land node at the limit or nearer; false where it isn't ``asked``."""
        points = rows.withColumns(self.land_cell | {"p_cx": F.when(asked, self.land_cell["p_cx"])})
        if self.small:
            hit = points.join(self.on_land, self.touches, "left")
        else:
            hit = points.join(self.on_land.withColumnRenamed("slot", "e_slot").hint("shuffle_hash"), self.touches & (F.col("slot") == F.col("e_slot")), "left")
        return hit.groupBy(*rows.columns).agg(self.touched)
