"""From month files to trajectories: files of two domains and two months, splines, and a run over the month border."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator
from math import radians

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from tidewright.operators import integrate, months, storage
from tidewright.plans import fixtures as fx
from tidewright.plans.fixtures import RADIUS, SHAPE, sql_angle, sql_metric2, sql_moved, sql_wrap
from tidewright.plans.queries import _fill_sql, _FILLED_RAW, _spline_sql, q6, r6
from tidewright.sources.files import make_folder

#: Days of the files, from the day before February to the second of April, and the first days of the two months' series.
DAY0, DAYS = dt.date(2001, 1, 31), 62
MONTHS = [dt.date(2001, 3, 1), dt.date(2001, 2, 1)]
SPANS = [(28, 61), (0, 30)]
LEVEL, COLUMNS = 15, 50
#: A step, lifetime and grace in seconds; windows of each month, the latest first.
TICK, LIFE, GRACE = 43200, 3 * 86400, 86400
LAND_LIMIT = radians(5e-2)
_at = lambda day, month: months.seconds(dt.date(2001, month, day))
WINDOWS = [(_at(3, 3), _at(1, 3)), (_at(28, 2) + TICK, _at(27, 2))]

#: Velocities by node and day; each sea node is known on the first day of either span, which gives the masks.
SERIES = "l_partkey AS cell, CAST({days} % 62 AS INT) AS d, avg(l_discount - 5e-2) * 1e1 AS u, avg(l_tax - 4e-2) * 1e1 AS v"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell of the grid, ``cell, i, j, sea, domain``: the lower half of the rows is the first domain."""
    part = fx.table(spark, sf_dir, "part")
    rows = part.selectExpr(f"CAST(floor(max(p_partkey) / {COLUMNS}e0) AS INT) AS r").first()["r"]
    cells = spark.range(COLUMNS * (rows + 1)).select(F.col("id").alias("cell"))
    sea = part.selectExpr("p_partkey AS cell", "p_size > 5 AS sea")
    return cells.join(sea, "cell", "left").select(
        "cell", (F.col("cell") % COLUMNS).cast("int").alias("i"), F.floor(F.col("cell") / COLUMNS).cast("int").alias("j"), F.coalesce("sea", F.lit(False)).alias("sea"),
        F.when(F.floor(F.col("cell") / COLUMNS) <= rows // 2, 1).otherwise(2).alias("domain"),
    )


def _write_days(frames: Iterator[pd.DataFrame], folder: str) -> Iterator[pd.DataFrame]:
    """Rows of a file follow each other: a mask for each latitude (``u`` null), and known velocities."""
    some: list[pd.DataFrame] = []
    for frame in frames:
        for _, rows in frame.groupby(["domain", "d"], sort=False):
            if some and (some[-1]["domain"].iloc[0], some[-1]["d"].iloc[0]) != (rows["domain"].iloc[0], rows["d"].iloc[0]):
                yield _write_day(pd.concat(some), folder)
                some = []
            some.append(rows)
    if some:
        yield _write_day(pd.concat(some), folder)


def _write_day(rows: pd.DataFrame, folder: str) -> pd.DataFrame:
    from tidewright.operators.grid import MISSING
    from tidewright.sources.gridded import write_classic

    d, masks, known = int(rows["d"].iloc[0]), rows[rows["mask"].notna()].sort_values("j"), rows[rows["mask"].isna()]
    lon, lat = np.arange(COLUMNS), masks["j"].to_numpy(dtype=np.int64)
    sea = (masks["mask"].to_numpy(dtype=np.int64)[:, None] >> lon & 1) > 0
    at = np.searchsorted(lat, known["j"]), known["i"].to_numpy(dtype=np.int64)

    def grid(c: str) -> np.ndarray:
        out = np.full(sea.shape, 0.0 if d in [low for low, _ in SPANS] else MISSING)
        out[at] = np.nan_to_num(known[c].to_numpy(dtype=float), nan=MISSING)
        return np.where(sea, out, MISSING).reshape(1, *sea.shape)

    day = DAY0 + dt.timedelta(days=d)
    path = f"{folder}/d{rows['domain'].iloc[0]}_{day:%Y%m%d}_{LEVEL:04d}.nc"
    write_classic(path, {"time": 1, "lat": len(lat), "lon": len(lon)}, {
        "time": (["time"], np.array([months.seconds(day)], dtype=np.float64), {"units": "seconds since 2000-01-01"}),
        "lon": (["lon"], 100.0 + 0.08 * lon, {}), "lat": (["lat"], -16.0 + 0.08 * lat, {}),
        "water_u": (["time", "lat", "lon"], grid("u"), {"_FillValue": np.float64(MISSING)}),
        "water_v": (["time", "lat", "lon"], grid("v"), {"_FillValue": np.float64(MISSING)}),
    })
    return pd.DataFrame({"path": [path]})


def write_files(spark: SparkSession, sf_dir: str, folder: str) -> list[str]:
    """A classic file for each domain and day; returns the domains' path patterns. A task has all rows of a file.

    Only known velocities are shuffled, once, by file; the cells of a latitude are one row for each day, their mask a number.
    """
    make_folder(folder)
    cells = _cells(spark, sf_dir)
    rows = cells.groupBy("domain", "j").agg(F.bit_or(F.when(F.col("sea"), F.expr("shiftleft(1L, i)")).otherwise(F.lit(0).cast("bigint"))).alias("mask"))
    last = rows.agg(F.max("j")).first()[0]
    days = spark.range(DAYS).select(F.col("id").cast("int").alias("d"))
    masks = rows.crossJoin(F.broadcast(days)).select("domain", "d", "j", "mask", F.lit(None).cast("int").alias("i"), *[F.lit(None).cast("double").alias(c) for c in "xy"])
    line = fx.table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS cell", "CAST(datediff(CAST(l_shipdate AS DATE), DATE'1992-01-01') % 62 AS INT) AS d", "l_discount - 5e-2 AS x", "l_tax - 4e-2 AS y")
    row = F.floor(F.col("cell") / COLUMNS)
    known = line.where((F.col("cell") >= 0) & (row <= last) & (F.col("d") >= 0)).select(
        F.when(row <= last // 2, 1).otherwise(2).alias("domain"), "d", row.cast("int").alias("j"), F.lit(None).cast("bigint").alias("mask"), F.pmod("cell", F.lit(COLUMNS)).cast("int").alias("i"), "x", "y"
    )
    first = F.when(F.col("d").isin([low for low, _ in SPANS]), 0.0)
    value = lambda c, name: F.coalesce(F.avg(c) * 10.0, first).alias(name)
    # By file, then by cell within it, where the rows are.
    files = known.unionByName(masks).repartition("domain", "d").groupBy("domain", "d", "j", "i", "mask").agg(value("x", "u"), value("y", "v"))
    with storage.settings(spark, {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m"}):  # a task groups and sorts its rows in memory
        files.sortWithinPartitions("domain", "d").mapInPandas(lambda it: _write_days(it, folder), "path string").count()
    return [f"{folder}/d{k}_{{YYYY}}{{MM}}{{DD}}_{{LEV}}.nc" for k in (1, 2)]


def month_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two domains' files of two months, read by month, splined and run backward from March into February; each particle at its own time."""
    folder = storage.new_folder(spark, "months")
    patterns = write_files(spark, sf_dir, f"{folder}/files".removeprefix("file://"))
    months.write_months(spark, MONTHS, patterns, LEVEL, "water_u", "water_v", 86400, folder)
    p = fx.particles(spark, sf_dir).withColumn("init_t", F.lit(WINDOWS[0][0]) - F.col("pid") % 2 * 86400 + F.col("pid") % 3 * 7200)
    end = integrate.backward_by_month(p, WINDOWS, lambda n: months.month_field(spark, folder, MONTHS[n]), TICK, RADIUS, SHAPE, LAND_LIMIT, LIFE, GRACE, tick=TICK)
    return end.select("pid", r6(F.col("lon")).alias("lon"), r6(F.col("lat")).alias("lat"), "t", "reason")


def _month_run_sql() -> str:
    d2, angle = sql_metric2("p.lon", "p.lat", "n.lon", "n.lat"), sql_angle("p.lon", "p.lat", "n.lon", "n.lat")
    cubic = lambda k: f"((1 - p.b) * {k}.f + p.b * {k}.f1 + (((1 - p.b) * (1 - p.b) * (1 - p.b) - (1 - p.b)) * {k}.m + (p.b * p.b * p.b - p.b) * {k}.m1) / 6)"
    mean = lambda c: f"CASE WHEN coalesce(sum(w), 0) > 1e-8 THEN sum(w * {c}) / sum(w) ELSE 0e0 END"
    ctes = [
        f"""cells AS MATERIALIZED (SELECT c.c AS node_id, radians(100e0 + 8e-2 * (c.c % {COLUMNS})) AS lon, radians(-16e0 + 8e-2 * (c.c // {COLUMNS})) AS lat, coalesce(p_size > 5, false) AS sea
  FROM (SELECT unnest(range({COLUMNS} * CAST(floor((SELECT max(p_partkey) FROM part) / {COLUMNS}e0) + 1 AS BIGINT))) AS c) c LEFT JOIN part ON p_partkey = c.c)""",
        f"known AS MATERIALIZED (SELECT {SERIES.format(days='''datediff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE))''')} FROM lineitem GROUP BY 1, 2)",
        f"particles AS ({fx.CTES['particles']})",
    ]
    for n, (low, high) in enumerate(SPANS):
        first = "CASE WHEN d.d IN (0, 28) THEN 0e0 END"
        ctes.append(
            f"""slots{n} AS (SELECT c.node_id, d.d AS t_idx, coalesce(k.u, {first}) AS u, coalesce(k.v, {first}) AS v FROM cells c CROSS JOIN (SELECT unnest(range({low}, {high + 1})) AS d) d
  LEFT JOIN known k ON k.cell = c.node_id AND k.d = d.d WHERE c.sea)"""
        )
        ctes.append(f"around{n} AS MATERIALIZED (SELECT node_id, t_idx, u, v, {_fill_sql('u')}, {_fill_sql('v')} FROM slots{n})")
        ctes += [_spline_sql(c, f"{c}{n}", low, high, f"around{n}", value=_FILLED_RAW(c)) for c in "uv"]
    ctes.append(f"s0 AS MATERIALIZED (SELECT pid, lon, lat, CAST({WINDOWS[0][0]} - pid % 2 * 86400 + pid % 3 * 7200 AS BIGINT) AS init_t, CAST({WINDOWS[0][0]} - pid % 2 * 86400 + pid % 3 * 7200 AS BIGINT) AS t, 0 AS reason FROM particles)")
    moved = sql_moved(f"(-u * {TICK})", f"(-v * {TICK})", "lon", "lat")
    zero, k = months.seconds(DAY0), 0
    for n, (top, bottom) in enumerate(WINDOWS):
        for window in range(top, bottom - 1, -TICK):
            live = f"reason = 0 AND t >= {window} AND t < {window + TICK}"
            start = zero + SPANS[n][0] * 86400
            on_land = f"EXISTS (SELECT 1 FROM cells n WHERE NOT n.sea AND abs(p.lat - n.lat) <= {LAND_LIMIT!r} AND {d2} <= {LAND_LIMIT * LAND_LIMIT!r})"
            ctes.append(
                f"""j{k} AS MATERIALIZED (SELECT pid, lon, lat, init_t, t, CASE WHEN {live} AND init_t - t >= {LIFE} THEN 3 WHEN {live} AND init_t - t >= {GRACE} AND {on_land} THEN 1 ELSE reason END AS reason,
  (t - {start}) // 86400 AS i, (t - {start}) % 86400 / 86400e0 AS b FROM s{k} p)"""
            )
            ctes.append(
                f"""w{k} AS (SELECT p.pid, exp(-{angle} * {angle} / {SHAPE!r}) AS w, {cubic('ku')} AS u, {cubic('kv')} AS v FROM j{k} p JOIN cells n ON n.sea AND abs(p.lat - n.lat) < {RADIUS!r} AND {d2} < {RADIUS * RADIUS!r}
  JOIN knots_u{n} ku ON ku.node_id = n.node_id AND ku.i = p.i JOIN knots_v{n} kv ON kv.node_id = n.node_id AND kv.i = p.i WHERE {live})"""
            )
            ctes.append(
                f"""s{k + 1} AS MATERIALIZED (SELECT pid, CASE WHEN {live} THEN {sql_wrap(moved[0])} ELSE lon END AS lon, CASE WHEN {live} THEN {moved[1]} ELSE lat END AS lat, init_t, CASE WHEN {live} THEN t - {TICK} ELSE t END AS t, reason
  FROM (SELECT p.*, {mean('u')} AS u, {mean('v')} AS v FROM j{k} p LEFT JOIN w{k} USING (pid) GROUP BY ALL))"""
            )
            k += 1
    return "WITH RECURSIVE " + ",\n".join(ctes) + f"\nSELECT pid, {q6('lon')} AS lon, {q6('lat')} AS lat, t, reason FROM s{k}"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"month_run": month_run}


def oracle_sql() -> dict[str, str]:
    return {"month_run": _month_run_sql()}
