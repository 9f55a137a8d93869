"""Seeds from CSV or packed trajectories, and the files of results."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from tidewright.functions.geo import wrap_lon
from tidewright.operators.trajectory import ends
from tidewright.sources.packed import read_trajectories

#: The columns of a seed table.
COLUMNS = {"seed_id": "bigint", "lon_rad": "double", "lat_rad": "double", "t_start_s": "bigint"}


def seeds_from_csv(spark: SparkSession, path: str) -> DataFrame:
    """``seed_id, lon, lat, t_s, stop``: columns are found by the header, trimmed, in any order; blank lines are skipped; no stop."""
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    if missing := [c for c in COLUMNS if c not in raw.columns]:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    typed = raw.select(*[F.trim(c).cast(t).alias(c) for c, t in COLUMNS.items()]).where("seed_id is not null")
    return typed.select("seed_id", wrap_lon(F.col("lon_rad")).alias("lon"), F.col("lat_rad").alias("lat"), F.col("t_start_s").alias("t_s"), F.lit(None).cast("struct<lon:double,lat:double,t_s:bigint>").alias("stop"))


def seeds_from_trajectories(spark: SparkSession, path: str, point: str = "last") -> DataFrame:
    """The first or last sample of each packed trajectory, with the other end as its stop; longitudes wrapped."""
    if point not in ("first", "last"):
        raise ValueError("point must be first or last")
    other = "first" if point == "last" else "last"
    e = ends(read_trajectories(spark, path), ["lon", "lat", "t_s"])
    at = lambda p: (wrap_lon(F.col(f"{p}_lon")).alias("lon"), F.col(f"{p}_lat").alias("lat"), F.col(f"{p}_t_s").alias("t_s"))
    return e.select("seed_id", *at(point), F.struct(*at(other)).alias("stop"))


def seeds(spark: SparkSession, path: str, point: str = "last") -> DataFrame:
    """By the file name's ending: ``.pkd2`` or ``.csv``."""
    if path.lower().endswith(".pkd2"):
        return seeds_from_trajectories(spark, path, point)
    if path.lower().endswith(".csv"):
        return seeds_from_csv(spark, path)
    raise ValueError(f"no seeds can be read from {path}: neither .pkd2 nor .csv")


def result_name(kind: str, day_tag: str, level: int, suffix: str = "pkd.gz") -> str:
    return f"{kind}_{day_tag}_{level}m.{suffix}"


def write_coast(land: DataFrame, folder: str, stride: int = 8) -> None:
    from tidewright.operators.grid import coast_rows

    coast_rows(land, stride).write.option("header", True).csv(folder)
