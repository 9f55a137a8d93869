"""Fixed-point coordinates and whole seconds, as the packed formats hold them."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column

from tidewright.functions.geo import wrap_lon

#: Ticks for a radian; the range of a 32-bit integer; seconds from 1970 to 2000.
TICKS = 1_000_000
INT_MIN, INT_MAX = -(1 << 31), (1 << 31) - 1
UNIX_2000 = 946_684_800


def quantise(angle: Column) -> Column:
    ticks = F.round(angle * float(TICKS))
    return F.greatest(F.lit(float(INT_MIN)), F.least(ticks, F.lit(float(INT_MAX)))).cast("int")


def dequantise(ticks: Column) -> Column:
    return ticks / float(TICKS)


def whole_seconds(t: Column) -> Column:
    return F.round(t).cast("bigint")


def snap(t: Column, dt: int) -> Column:
    """The nearest multiple of ``dt``."""
    return (F.round(t / float(dt)) * dt).cast("bigint")


def time_index(t: Column, dt: int) -> Column:
    if dt <= 0:
        raise ValueError("dt must be positive")
    return F.round(t / float(dt)).cast("bigint")


def from_unix(t: Column) -> Column:
    return t - UNIX_2000


def packed_record(lon0: Column, lat0: Column, lon1: Column, lat1: Column, t0: Column, t1: Column, flags: Column) -> Column:
    """The struct of a packed record: longitudes wrapped, latitudes not clamped."""
    return F.struct(
        quantise(wrap_lon(lon0)).alias("lon0_q"), quantise(lat0).alias("lat0_q"),
        quantise(wrap_lon(lon1)).alias("lon1_q"), quantise(lat1).alias("lat1_q"),
        whole_seconds(t0).alias("t0_s"), whole_seconds(t1).alias("t1_s"), flags.cast("smallint").alias("flags"),
    )


def unpacked_record(r: Column) -> Column:
    names = ("lon0", "lat0", "lon1", "lat1")
    return F.struct(*[dequantise(r[f"{n}_q"]).alias(n) for n in names], r["t0_s"].alias("t0_s"), r["t1_s"].alias("t1_s"), r["flags"].alias("flags"))
