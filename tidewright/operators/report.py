"""Counters of what became of the particles."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from tidewright.functions.geo import is_west
from tidewright.operators.integrate import ALIVE, LANDED, LIFETIME, NEVER_LEFT, START_LAND, START_NO_SEA

STATUS_NAMES = {1: "ok", 2: "landed", 3: "no_sea", 4: "start_land", 5: "start_no_sea"}


def _n(condition: Column) -> Column:
    return F.count_if(condition)


def by_day(ended: DataFrame, day: str | Column = "release_day", lon: str = "lon0") -> DataFrame:
    """For each release day: released, landed, landed from east and west, lifetime over (boring), never left, still under way."""
    r, west = F.col("reason"), is_west(F.col(lon))
    return ended.groupBy(day).agg(
        F.count("*").alias("released"), _n(r == LANDED).alias("landed"), _n((r == LANDED) & ~west).alias("east"), _n((r == LANDED) & west).alias("west"),
        _n(r == LIFETIME).alias("boring"), _n(r == NEVER_LEFT).alias("never_left"), _n(r == ALIVE).alias("neverland"),
    )


def monthly(daily: DataFrame, day: str = "release_day") -> DataFrame:
    """The daily counters summed by month, and by day below it (day null: the month)."""
    counters = [c for c in daily.columns if c != day]
    return daily.withColumn("month", F.trunc(day, "month").cast("date")).rollup("month", day).agg(*[F.sum(c).alias(c) for c in counters]).where("month is not null")


def status_pivot(results: DataFrame, day: str = "release_day") -> DataFrame:
    return results.groupBy(day).agg(*[_n(F.col("status") == k).alias(name) for k, name in STATUS_NAMES.items()])


def stop_causes(ends: DataFrame) -> DataFrame:
    return ends.groupBy("stop_cause").agg(F.count("*").alias("n"))


def without_start_failures(results: DataFrame) -> DataFrame:
    return results.where(~F.col("status").isin(START_LAND, START_NO_SEA))


def step_counters(steps: DataFrame, grace: int, age: str = "age_s", near_land: str = "near_land") -> DataFrame:
    """Over a table of steps: particles past the grace time, steps where land counts, and particles that it stopped."""
    past = F.col(age) >= grace
    return steps.agg(F.count_distinct(F.when(past, F.col("pid"))).alias("past_grace"), _n(past).alias("beach_steps"), _n(past & F.col(near_land)).alias("beached"))
