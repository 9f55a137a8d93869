"""Days, months and seconds since 2000-01-01, and the text forms of dates and path patterns."""

from __future__ import annotations

import datetime as dt
import re

import pyspark.sql.functions as F
from pyspark.sql import Column

EPOCH = "2000-01-01"


def _epoch() -> Column:
    return F.to_date(F.lit(EPOCH))


def seconds_2000(day: Column) -> Column:
    return F.datediff(day, _epoch()).cast("bigint") * 86400


def day_of(seconds: Column) -> Column:
    """The day of an instant; also before 2000."""
    return F.date_add(_epoch(), F.floor(seconds / 86400.0).cast("int"))


def month_of(seconds: Column) -> Column:
    return F.trunc(day_of(seconds), "month").cast("date")


def add_months(day: Column, n: Column | int) -> Column:
    return F.add_months(day, n)


def days_between(first: Column, last: Column) -> Column:
    """Every day from ``first`` to ``last``, both included; an error where they are in the wrong order."""
    ordered = F.when(first <= last, F.sequence(first, last, F.expr("interval 1 day")))
    return F.coalesce(ordered, F.raise_error(F.lit("the last day is before the first")).cast("array<date>"))


def tag(day: Column) -> Column:
    return F.date_format(day, "yyyy_MM_dd")


def parse_day(text: str) -> dt.date:
    """``YYYY-MM-DD``, or with underscores; ValueError for anything else."""
    if not re.fullmatch(r"\d{4}[-_]\d{2}[-_]\d{2}", text):
        raise ValueError(f"not a date: {text!r}")
    return dt.date.fromisoformat(text.replace("_", "-"))


def parse_day_column(text: Column) -> Column:
    return F.to_date(F.regexp_replace(text, "_", "-"), "yyyy-MM-dd")


def split_list(text: str) -> list[str]:
    return [x for x in text.split(",") if x]


def split_list_column(text: Column) -> Column:
    return F.filter(F.split(text, ","), lambda x: x != "")


def expand_pattern(pattern: Column | str, day: Column, level: Column) -> Column:
    """``{YYYY} {MM} {DD} {LEV}`` in a path; the level in four digits."""
    out = F.lit(pattern) if isinstance(pattern, str) else pattern
    for mark, value in (
        ("YYYY", F.date_format(day, "yyyy")), ("MM", F.date_format(day, "MM")), ("DD", F.date_format(day, "dd")),
        ("LEV", F.lpad(level.cast("string"), 4, "0")),
    ):
        out = F.replace(out, F.lit("{" + mark + "}"), value)
    return out


def file_paths(spark, patterns: list[str], first: str, last: str, level: int):
    """``domain, day, path`` for each day and each domain's pattern."""
    days = spark.range(1).select(F.explode(days_between(F.lit(parse_day(first)), F.lit(parse_day(last)))).alias("day"))
    domains = F.explode(F.array(*[F.struct(F.lit(k).alias("domain"), F.lit(p).alias("pattern")) for k, p in enumerate(patterns, 1)]))
    return days.select("day", domains.alias("p")).select(
        "p.domain", "day", expand_pattern(F.col("p.pattern"), F.col("day"), F.lit(level)).alias("path")
    )
