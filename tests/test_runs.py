"""Runs of many steps: large fields in tiles against small ones and a plain version, live rows, months, streams, numbers, headers."""

import datetime as dt
import re

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
import pytest

from tidewright.operators import fields, grid, integrate, months, seeding
from tidewright.operators.numbering import numbered
from tidewright.plans import month_queries
from tidewright.sources import gridded
from tidewright.streaming import releases

R, S, LIMIT, DT, EARTH = np.radians(1.7), np.radians(1.0) ** 2, 0.002, 20000.0, 6371000.0
FIRST, LAST = 19, 12


def wrap(x):
    return np.pi - np.mod(np.pi - x, 2 * np.pi)


@pytest.fixture(scope="module")
def world():
    """Nodes around the pole and over the dateline, with velocities at each slot; land; particles among them."""
    rng = np.random.default_rng(0)
    deg = [(lon, lat) for lat in range(72, 90, 1) for lon in range(-180, 180, 5)] + [(lon, lat) for lat in range(-4, 5) for lon in (*range(171, 180), *range(-180, -171))]
    nodes = np.radians(np.array(deg, dtype=float))
    n = np.arange(len(nodes))[:, None]
    slots = np.arange(LAST - 1, FIRST + 1)[None]
    u, v = 2 * np.sin(n * 1.3 + slots), 2 * np.cos(n * 0.7 - slots)
    land = nodes[3::41] + [0.001, 0.0]
    at = np.concatenate([np.c_[rng.uniform(-np.pi, np.pi, 120), np.radians(rng.uniform(74, 89.9, 120))], np.c_[wrap(np.radians(rng.uniform(176, 184, 120))), np.radians(rng.uniform(-3, 3, 120))]])
    at[:4] = [[0.1, np.pi / 2 - 1e-4], [3.0, np.pi / 2 - 2e-3], [np.pi, 0.01], [-np.pi + 1e-9, -0.02]]
    return nodes, u, v, land, at, FIRST - np.arange(len(at)) % 3


def tables(spark, world):
    nodes, u, v, land, at, init = world
    node = spark.createDataFrame(pd.DataFrame({"node_id": range(len(nodes)), "lon": nodes[:, 0], "lat": nodes[:, 1]}))
    k = np.arange(LAST - 1, FIRST + 1)
    sample = spark.createDataFrame(pd.DataFrame({"node_id": np.repeat(np.arange(len(nodes)), len(k)), "t_idx": np.tile(k, len(nodes)), "u": u.ravel(), "v": v.ravel()}))
    ground = spark.createDataFrame(pd.DataFrame({"lon": land[:, 0], "lat": land[:, 1]}))
    parts = spark.createDataFrame(pd.DataFrame({"pid": range(len(at)), "lon": at[:, 0], "lat": at[:, 1], "init_t": init}))
    return fields.slots(node, sample), ground, parts


def metric2(a, b):
    east = wrap(a[:, None, 0] - b[None, :, 0]) * np.cos((a[:, None, 1] + b[None, :, 1]) / 2)
    return east**2 + (a[:, None, 1] - b[None, :, 1]) ** 2


def plain_backward(world, lifetime, grace):
    nodes, u, v, land, at, init = world
    at, t, reason, taken = at.copy(), init.copy(), np.zeros(len(at), dtype=int), []
    for k in range(FIRST, LAST - 1, -1):
        live = (reason == 0) & (t == k)
        age = (init - t) * DT
        reason[live & (age >= lifetime)] = 3
        on_land = (metric2(at, land) <= LIMIT * LIMIT).any(axis=1)
        reason[live & (age >= grace) & on_land & (reason == 0)] = 1
        live &= reason == 0
        taken.append(int(live.sum()))
        near = metric2(at, nodes) < R * R
        c = np.sin(at[:, None, 1]) * np.sin(nodes[None, :, 1]) + np.cos(at[:, None, 1]) * np.cos(nodes[None, :, 1]) * np.cos(at[:, None, 0] - nodes[None, :, 0])
        d = np.arctan2(np.sqrt(1 - np.clip(c, -1, 1) ** 2), np.clip(c, -1, 1))
        w = np.where(near, np.exp(-d * d / S), 0)
        total = w.sum(axis=1)
        safe = np.where(total > 1e-8, total, 1)
        x, y = (-(w * f[:, k - LAST + 1]).sum(axis=1) / safe * (total > 1e-8) * DT for f in (u, v))
        length = np.hypot(x, y)
        a, one = length / EARTH, np.where(length < 1e-10, 1, length)
        lat = np.arcsin(np.clip(np.sin(at[:, 1]) * np.cos(a) + y / one * np.cos(at[:, 1]) * np.sin(a), -1, 1))
        lon = at[:, 0] + np.arctan2(x * np.sin(a), one * np.cos(at[:, 1]) * np.cos(a) - y * np.sin(at[:, 1]) * np.sin(a))
        go = live & (length >= 1e-10)
        at[go] = np.c_[wrap(lon), np.clip(lat, -np.pi / 2, np.pi / 2)][go]
        t[live] -= 1
    return at, t, reason, taken


@pytest.mark.parametrize("small", [True, False])
def test_backward_equals_the_plain_version(spark, world, small, monkeypatch):
    monkeypatch.setattr(fields, "SHARE_ROWS", 7)  # so that tiles are shared out
    field, land, parts = tables(spark, world)
    at, t, reason, _ = plain_backward(world, 6 * DT, 2 * DT)
    got = integrate.backward(parts, field, land, FIRST, LAST, DT, R, S, LIMIT, 6 * DT, 2 * DT, 3, "pid", 1, small).orderBy("pid").toPandas()
    assert got["reason"].tolist() == reason.tolist() and got["t"].tolist() == t.tolist() and {0, 1, 3} == set(reason)
    assert np.abs(wrap(got["lon"].to_numpy() - at[:, 0])).max() < 1e-9 and np.abs(got["lat"].to_numpy() - at[:, 1]).max() < 1e-9


def exchanges(df):
    """Exchanges of a plan, without those by which tables that are kept came about."""
    found, below = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(re.match(r"[ :+\-]*", line)[0])
        if below is not None and depth > below:
            continue
        below = depth if "InMemoryTableScan" in line else None
        if "Exchange" in line and "BroadcastExchange" not in line:
            found.append(line)
    return found


@pytest.mark.parametrize("small", [True, False])
def test_steps_between_cuts_do_not_shuffle(spark, world, small):
    field, land, parts = tables(spark, world)
    meet = fields.Meeting(field, land, R, S, LIMIT, DT, "pid", small)
    step = integrate._backward_step(meet, 1, DT, 5 * DT, 2 * DT)
    with meet.deal(integrate._releases(parts, "pid"), LAST, FIRST, 3) as state:
        for window in (19, 18, 17):
            state = step(state, window)
        assert len(found := exchanges(state)) == 1 and "hashpartitioning(" + ("pid" if small else "slot") in found[0]


def test_tiles_hold_every_node_within_their_halo(spark):
    rng = np.random.default_rng(2)
    deg = np.c_[rng.uniform(-180, 180, 1500), np.degrees(np.arcsin(rng.uniform(-1, 1, 1500)))]
    nodes = np.concatenate([np.radians(deg), [[np.pi, 0.0], [-np.pi + 1e-12, 0.3], [0.0, np.pi / 2], [1.0, -np.pi / 2]]])
    frame = spark.createDataFrame(pd.DataFrame({"node_id": range(len(nodes)), "lon": nodes[:, 0], "lat": nodes[:, 1]}))
    for tile, halo in ((0.2, 0.05), (0.6, 0.15), (np.pi, 1.0)):
        copies = fields.in_tiles(frame, tile, halo).toPandas()
        home = fields.tile_of(frame, tile).orderBy("node_id").toPandas()
        have = set(zip(copies.node_id, copies.ty, copies.tx, strict=True))
        assert len(have) == len(copies)
        near = np.argwhere(metric2(nodes, nodes) < halo * halo)  # a point at one node's place finds the other in its own tile
        assert all((b, home.ty[a], home.tx[a]) in have for a, b in near)
        assert len(copies) < 9 * len(nodes)


def test_only_live_rows_take_part(spark, world, monkeypatch):
    field, land, parts = tables(spark, world)
    _, _, _, taken = plain_backward(world, 3 * DT, 2 * DT)
    met, deal = [], fields.Meeting.deal

    def counted(self, rows, low, high, steps):
        met.append(rows.count())
        return deal(self, rows, low, high, steps)

    monkeypatch.setattr(fields.Meeting, "deal", counted)
    got = integrate.backward(parts, field, land, FIRST, LAST, DT, R, S, LIMIT, 3 * DT, 2 * DT, 1)
    # A cut at every step: what a step is given is what it moves and what ends in it, never what has ended or waits.
    ended = got.where("reason <> 0").groupBy("t").count().toPandas().set_index("t")["count"].to_dict()
    assert met == [n + ended.get(FIRST - k, 0) for k, n in enumerate(taken)]
    assert met[0] < parts.count() and met[-1] == 0 and got.count() == parts.count()


def same(a, b):
    a, b = (sorted((tuple(r) for r in df.collect()), key=lambda r: tuple(x for x in r if isinstance(x, int))) for df in (a, b))
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == pytest.approx(y, rel=1e-9, abs=1e-9)
    return a


def test_forward_and_reconstruction_in_tiles(spark, world):
    field, land, parts = tables(spark, world)
    run = lambda small: integrate.forward(parts.drop("init_t"), field, land, LAST, 5, DT, R, S, 0.01, 2, "pid", small)
    ends = same(run(True), run(False))
    assert len(ends) == parts.count() and len({r[5] for r in ends}) >= 2
    seeds = parts.selectExpr("pid AS seed_id", "lon", "lat", "init_t AS init_idx", "lon AS stop_lon", "lat AS stop_lat", "CASE WHEN pid % 3 = 0 THEN init_t - 2 END AS stop_idx")
    run = lambda small, cut: integrate.reconstruct(seeds, field, FIRST, LAST, DT, R, S, 4 * DT, cut, small=small)
    one, two, three = run(True, 3), run(False, 3), run(True, 16)
    for other in (two, three):  # however often it is cut, the records are the same
        same(one[0].fillna(-9.0), other[0].fillna(-9.0))
        assert sorted(map(tuple, one[1].fillna("-").collect())) == sorted(map(tuple, other[1].fillna("-").collect()))


# --- months ---


def test_month_plan_reads_one_month(spark, tmp_path):
    folder = str(tmp_path)
    patterns = month_queries.write_files(spark, "/root/testdata/sf0.001", f"{folder}/files")
    months.write_months(spark, month_queries.MONTHS, patterns, month_queries.LEVEL, "water_u", "water_v", 86400, folder)
    field, land = months.month_field(spark, folder, dt.date(2001, 2, 1))
    plan = field.between(months.seconds(dt.date(2001, 2, 3)), months.seconds(dt.date(2001, 2, 4)))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*month[^\]]*2001-02-01", plan) and re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(k,3\)", plan)
    assert {r["month"].isoformat() for r in spark.read.parquet(f"{folder}/segments").select("month").distinct().collect()} == {"2001-02-01", "2001-03-01"}
    # From the day before the month to the second day of the next one: 31 knots in February, 34 in March.
    last = {r["month"].isoformat(): r["k"] for r in spark.read.parquet(f"{folder}/segments").groupBy("month").agg(F.max("k").alias("k")).collect()}
    assert last == {"2001-02-01": 29, "2001-03-01": 32}
    # Both domains are there, their numbers apart.
    assert {r["d"] for r in field.nodes.select(F.floor(F.col("node_id") / gridded.DOMAIN_NODES).alias("d")).distinct().collect()} == {0, 1}
    assert land.count() > 0 and field.values.select("node_id").distinct().count() == field.nodes.count()


def test_splines_bound_their_speed(spark):
    rng = np.random.default_rng(3)
    rows = [(n, t, float(rng.normal()), float(rng.normal())) for n in range(20) for t in range(0, 90, 10)]
    from tidewright.operators.series import segments_of, spline_value

    segments = segments_of(spark.createDataFrame(rows, "node_id bigint, t bigint, u double, v double"), "node_id", "t", ["u", "v"], 10)
    field = fields.splines(spark.createDataFrame([(0, 0.0, 0.0)], "node_id bigint, lon double, lat double"), segments, 0.0, 10.0, 7)
    at = segments.withColumn("t", F.explode(F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.col("t0") + i / 2)))
    speed = F.hypot(spline_value(F.col("t"), 10.0, "u_"), spline_value(F.col("t"), 10.0, "v_"))
    assert at.where(speed > field.fastest + 1e-12).count() == 0


# --- headers ---


def test_headers_are_read_by_tasks(spark, tmp_path):
    good = {"time": (["time"], np.array([0.0, 1.0]), {"units": "days"}), "u": (["time", "x"], np.zeros((2, 3)), {})}
    gridded.write_classic(f"{tmp_path}/a.nc", {"time": 2, "x": 3}, good)
    gridded.write_classic(f"{tmp_path}/b.nc", {"time": 2, "x": 3, "none": 0}, good | {"u": (["x", "time"], np.zeros((3, 2)), {})})
    gridded.write_classic(f"{tmp_path}/c.nc", {"x": 3}, {"u": (["x"], np.zeros(3), {})})
    (tmp_path / "d.nc").write_bytes(b"\x89HDF rest")
    rows = [(r["file"][-4:], r["error"]) for r in gridded.header_report(spark, str(tmp_path), ["u"], 2).collect()]
    assert [e for f, e in rows if f == "a.nc"] == [] and ("b.nc", "u begins with the dimension x, not time") in rows
    assert ("c.nc", "no variable time") in rows and any(f == "d.nc" and "HDF5" in e for f, e in rows)


def test_files_are_planned_by_size(spark, tmp_path, monkeypatch):
    assert [p.parts for p in gridded.plan_parts([("a", 10), ("b", 10), ("c", 95), ("d", 20), ("e", 25)], 40)] == [[("c", 0, 3)], [("c", 1, 3)], [("c", 2, 3)], [("a", 0, 1), ("b", 0, 1), ("d", 0, 1)], [("e", 0, 1)]]
    values = np.arange(7 * 4.0).reshape(7, 4)
    gridded.write_classic(f"{tmp_path}/one.nc", {"time": 7, "x": 4}, {"time": (["time"], np.arange(7.0), {"units": "days"}), "u": (["time", "x"], values, {})})
    gridded.register(spark)
    read = lambda split: sorted((r["t_s"], r["cell_idx"], r["value"]) for r in spark.read.format("gridnc").option("splitBytes", split).option("variables", "u").load(str(tmp_path)).collect())
    assert read("100") == read("100000") == [(86400 * t, c, values[t, c]) for t in range(7) for c in range(4)]
    monkeypatch.setattr(gridded, "open_input", None)  # planning opens no file
    assert len(gridded.GridReader({"path": str(tmp_path), "splitBytes": "100"}).partitions()) > 3


# --- numbers ---


def test_numbers_equal_row_numbers_in_groups_of_any_size(spark):
    rows = spark.range(3000).selectExpr("id", "CASE WHEN id % 7 < 4 THEN 1 WHEN id % 7 < 6 THEN 2 ELSE 3 END AS domain", "(id * 7919) % 3001 AS cell_idx", "id % 3 > 0 AS sea")
    from pyspark.sql import Window

    got = {r["id"]: r["sea_idx"] for r in grid.number_sea(rows).collect()}
    want = rows.where("sea").withColumn("n", F.row_number().over(Window.partitionBy("domain").orderBy("cell_idx")) - 1)
    assert got == {r["id"]: r["n"] for r in want.collect()}
    assert [r["n"] for r in numbered(rows, [F.col("cell_idx").desc()], "n", start=1).orderBy(F.desc("cell_idx")).collect()] == list(range(1, 3001))
    assert numbered(rows.limit(0), ["id"], "n").count() == 0
    assert sorted(r["id"] for r in seeding.thin(rows, 1.0, 10, 1, key="id").collect()) == list(range(10))


# --- streams ---


def test_daily_counters_close_days_and_leave_late_rows_out(spark, tmp_path):
    schema = "ended_at timestamp, reason int, lon0 double"
    day = dt.datetime(2001, 3, 1, 12)

    def add(n, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        query = releases.daily_counters(spark, str(tmp_path / "in"), schema, "1 hour").writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        query.awaitTermination()
        return query.lastProgress["stateOperators"][0]["numRowsTotal"]

    out = lambda: {str(r["release_day"]): (r["released"], r["landed"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    add(1, [(day + dt.timedelta(days=k), 1, 1.0) for k in (0, 0, 1, 2)])
    assert run() == 1 and out() == {"2001-03-01": (2, 2), "2001-03-02": (1, 1)}  # closed by the third day's row
    add(2, [(day, 1, 1.0), (day + dt.timedelta(days=2), 3, 1.0), (day + dt.timedelta(days=4), 1, 1.0)])  # the first is too late
    assert run() == 1 and out() == {"2001-03-01": (2, 2), "2001-03-02": (1, 1), "2001-03-03": (2, 1)}
