"""Seeds: regular grids, random positions by the coast, releases, pairing, thinning, windows."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from tidewright.functions.dates import days_between, month_of, parse_day
from tidewright.functions.geo import clamp_lat, in_box, wrap_lon
from tidewright.operators.numbering import numbered
from tidewright.operators.spatial import coast_band


def regular_grid(spark: SparkSession, west: float, east: float, south: float, north: float, step: float) -> DataFrame:
    """``lon_idx, lat_idx, lon, lat`` (radians) of a box in degrees; over the dateline where west > east; a full circle once."""
    full = abs(east - west) >= 360.0 - 1e-12
    parts = [(-180.0 + step, 180.0)] if full else [(west, east)] if west <= east else [(west, 180.0), (-180.0 + step, east)]
    lons: list[float] = []
    for low, high in parts:
        for i in range(int((high - low) // step) + 1 if high >= low else 0):
            x = 180.0 - (180.0 - (low + i * step)) % 360.0
            if not lons or abs(lons[-1] - x) >= 1e-10:
                lons.append(x)
    n_lat = int((north - south) // step) + 1
    lon = spark.createDataFrame(list(enumerate(lons)), "lon_idx int, lon_deg double")
    lat = spark.range(n_lat).select(F.col("id").cast("int").alias("lat_idx"), (F.lit(south) + F.col("id") * step).alias("lat_deg"))
    grid = lat.crossJoin(F.broadcast(lon)).select("lon_idx", "lat_idx", F.radians("lon_deg").alias("lon"), F.radians("lat_deg").alias("lat"))
    return grid.where(in_box(F.col("lon"), F.col("lat"), west, east, south, north))


def spawn(positions: DataFrame, first: str, last: str) -> DataFrame:
    """The same positions released on every day of the range; the days are one broadcast column."""
    days = positions.sparkSession.range(1).select(F.explode(days_between(F.lit(parse_day(first)), F.lit(parse_day(last)))).alias("release_day"))
    return positions.crossJoin(F.broadcast(days))


def random_by_coast(sea: DataFrame, land: DataFrame, n: int, seed: int, jitter: float, sea_tolerance: float, land_least: float, land_most: float, tries: int = 20) -> DataFrame:
    """``n`` positions by the coast: jittered nodes of the band that lie in the band themselves; at most ``tries`` times ``n`` attempts."""
    band = coast_band(sea.select("node_id", "lon", "lat"), sea, land, sea_tolerance, land_least, land_most)
    nodes = band.count()
    if not nodes:
        raise ValueError("no sea node lies in the coastal band")
    each = -(-n * tries // nodes)
    drawn = band.select(F.explode(F.sequence(F.lit(1), F.lit(each))).alias("attempt"), "node_id", "lon", "lat")
    rng = lambda k: F.pmod(F.xxhash64("node_id", "attempt", F.lit(seed), F.lit(k)), F.lit(1 << 30)) / float(1 << 30) * 2 - 1
    moved = drawn.select(
        "attempt", "node_id", wrap_lon(F.col("lon") + rng(1) * jitter).alias("lon"), clamp_lat(F.col("lat") + rng(2) * jitter).alias("lat"), F.xxhash64("node_id", "attempt", F.lit(seed)).alias("__order")
    )
    found = coast_band(moved, sea, land, sea_tolerance, land_least, land_most)
    return numbered(found, ["attempt", "__order", "node_id"], "__number").where(F.col("__number") < n).select("lon", "lat")


def thin(seeds: DataFrame, keep: float, cap: int | None, seed: int, key: str = "seed_id", draw: Column | None = None) -> DataFrame:
    """Keeps each seed with a chance of ``keep``, the same ones in every run; then at most ``cap`` of them, the feature asked for.

    Each seed draws a number in [0, 1) from a hash of its id and ``seed``; another ``draw`` may be given.
    """
    draw = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 53)) / float(1 << 53) if draw is None else draw
    kept = seeds.where(draw < keep)
    return kept if cap is None else numbered(kept, [key], "__number").where(F.col("__number") < cap).drop("__number")


def pair(starts: DataFrame, stops: DataFrame) -> DataFrame:
    """Start and stop of each seed; an error where an id has only one of the two."""
    a = starts.select("seed_id", F.struct("lon", "lat", "t_s").alias("start"))
    b = stops.select("seed_id", F.struct("lon", "lat", "t_s").alias("stop"))
    joined = a.join(b, "seed_id", "full")
    whole = F.col("start").isNotNull() & F.col("stop").isNotNull()
    return joined.where(F.when(whole, True).otherwise(F.raise_error(F.lit("a seed has no start or no stop")).cast("boolean")))


def check_order(seeds: DataFrame, start: str = "t_start", stop: str = "t_stop") -> DataFrame:
    """Passes rows through; an error where a stop is later than its start."""
    late = F.coalesce(F.col(stop) > F.col(start), F.lit(False))
    return seeds.where(F.when(~late, True).otherwise(F.raise_error(F.lit("a stop is later than its start")).cast("boolean")))


def month_buckets(seeds: DataFrame, t: str = "t_s") -> DataFrame:
    return seeds.withColumn("month", month_of(F.col(t)))


def in_window(seeds: DataFrame, low: int, high: int, t: str = "t_s") -> DataFrame:
    """Half open, within the months it touches."""
    month = month_of(F.col(t))
    return seeds.where(month.between(month_of(F.lit(low)), month_of(F.lit(high))) & (F.col(t) >= low) & (F.col(t) < high))


def released(seeds: DataFrame, first: str, last: str, day: str = "day") -> DataFrame:
    return seeds.where(F.col(day).between(F.lit(parse_day(first)), F.lit(parse_day(last))))

