"""Months of gridded files as tables of splines, and runs that read one month at a time.

``write_month`` reads the daily files of all domains from the day before a month to the second day of the next one, finds sea and land,
fills gaps and solves the splines; nodes and segments go to tables partitioned by month, segments sorted by interval within each
file. ``month_field`` gives one month of them as a field: a run then meets each particle with the interval of its own time, by an
equi-join on cell and interval, and reads no other month.
"""

from __future__ import annotations

import datetime as dt

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from tidewright.functions.dates import file_paths
from tidewright.operators.fields import Field, splines
from tidewright.operators.series import segments_of
from tidewright.operators.storage import settings

EPOCH = dt.date(2000, 1, 1)


def seconds(day: dt.date) -> int:
    return (day - EPOCH).days * 86400


def next_month(month: dt.date) -> dt.date:
    return (month.replace(day=28) + dt.timedelta(days=4)).replace(day=1)


def day_files(spark: SparkSession, patterns: list[str], month: dt.date, level: int) -> list[str]:
    """For each domain its files of the days from the one before the month to the second of the next, with commas between."""
    first, last = month - dt.timedelta(days=1), next_month(month) + dt.timedelta(days=1)
    listed = file_paths(spark, patterns, first.isoformat(), last.isoformat(), level)
    by_domain = listed.groupBy("domain").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("day", "path"))), lambda x: x["path"]), ",").alias("paths"))
    return [r["paths"] for r in by_domain.orderBy("domain").collect()]  # some 33 names a domain


def write_month(spark: SparkSession, month: dt.date, patterns: list[str], level: int, u: str, v: str, step: int, folder: str) -> None:
    """Appends a month (its first day) to the tables ``nodes`` and ``segments`` of ``folder``; an error where it has no sea or no land."""
    from tidewright.sources.gridded import BY_NODE, load_domains

    span = (seconds(month), seconds(next_month(month)))
    solve = lambda samples: segments_of(samples, "node_id", "t_s", ["u", "v"], step)
    nodes, segments = load_domains(spark, day_files(spark, patterns, month, level), u, v, step, span, solve)
    at = f"month={month.isoformat()}"
    nodes.withColumn("step", F.lit(step)).write.parquet(f"{folder}/nodes/{at}")
    kinds = {r["sea"] for r in spark.read.parquet(f"{folder}/nodes/{at}").groupBy("sea").count().collect()}
    for sea, name in ((True, "sea"), (False, "land")):
        if sea not in kinds:
            raise ValueError(f"no {name} points in {month.isoformat()}: look at masks, variables and region")
    with settings(spark, BY_NODE):
        segments.sortWithinPartitions("k", "node_id").write.option("compression", "zstd").parquet(f"{folder}/segments/{at}")


def write_months(spark: SparkSession, months: list[dt.date], patterns: list[str], level: int, u: str, v: str, step: int, folder: str) -> str:
    for month in months:
        write_month(spark, month, patterns, level, u, v, step, folder)
    return folder


def nodes_of(spark: SparkSession, folder: str, month: dt.date) -> DataFrame:
    return spark.read.parquet(f"{folder}/nodes").where(F.col("month") == F.lit(month))


def month_field(spark: SparkSession, folder: str, month: dt.date) -> tuple[Field, DataFrame]:
    """The field of a month, and its land nodes. All series of a month start at the same time and have as many intervals."""
    nodes = nodes_of(spark, folder, month)
    segments = spark.read.parquet(f"{folder}/segments").where(F.col("month") == F.lit(month)).drop("month")
    edge = segments.agg(F.min("t0").alias("start"), F.max("k").alias("last")).first()
    step = nodes.select("step").first()["step"]
    sea = nodes.where("sea").select("node_id", "lon", "lat")
    return splines(sea, segments, edge["start"], float(step), edge["last"]), nodes.where("NOT sea").select("node_id", "lon", "lat")
