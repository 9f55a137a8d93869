import datetime as dt
from math import cos, radians

import numpy as np
import pyspark.sql.functions as F
import pytest

from tidewright.functions import geo
from tidewright.operators import fields, grid, integrate, interp, seeding, series, spatial, trajectory

H = 1e-3
CROSS = [(1, H, 0.0), (2, -H, 0.0), (3, 0.0, H), (4, 0.0, -H)]


def nodes_of(spark, rows, value=lambda lon, lat: 0.0):
    return spark.createDataFrame([(n, lon, lat, value(lon, lat), 0.0) for n, lon, lat in rows], "node_id bigint, lon double, lat double, u double, v double")


@pytest.mark.parametrize(("value", "want"), [(lambda a, b: 7.25, 7.25), (lambda a, b: 4 + 2 * a - 3 * b, 4.0)])
def test_interpolation(spark, value, want):
    p = spark.createDataFrame([(1, 0.0, 0.0)], "pid bigint, lon double, lat double")
    got = interp.interpolate(p, nodes_of(spark, CROSS, value), 1.1**0.5 * H, H * H).first()
    assert got["u"] == pytest.approx(want, abs=1e-12) and got["n_nb"] == 4


def test_gradient(spark):
    field = nodes_of(spark, [(0, 0.0, 0.0), *CROSS], lambda a, b: 4 + 2 * a - 3 * b)
    near = spark.createDataFrame([(1, 0, 1.0)], "pid bigint, node_id bigint, w double")
    pairs = spatial.node_pairs(field, 1.1 * H).where("node_id = 0")
    got = interp.derivatives(near, pairs, field, H * H).first()
    assert got["u_x"] == pytest.approx(2, abs=1e-4) and got["u_y"] == pytest.approx(-3, abs=1e-4) and got["v_x"] == 0


def test_radius_join_by_the_dateline_and_the_pole(spark):
    rng = np.random.default_rng(1)
    r = radians(1.0)
    places = [*zip(rng.uniform(178, 182, 60), rng.uniform(-3, 3, 60)), *zip(rng.uniform(-180, 180, 200), rng.uniform(84, 90, 200)), *zip(rng.uniform(-180, 180, 60), rng.uniform(-90, -88, 60))]
    wrap = lambda x: (x + 180) % 360 - 180
    rows = [(i, radians(wrap(a)), radians(b)) for i, (a, b) in enumerate(places)]
    nodes = spark.createDataFrame(rows, "node_id bigint, lon double, lat double")
    points = nodes.withColumnRenamed("node_id", "pid")
    got = {(x["pid"], x["node_id"]) for x in spatial.radius_join(points, spatial.bin_nodes(nodes, r), r).collect()}

    def d2(a, b):
        e = (a[1] - b[1] + np.pi) % (2 * np.pi) - np.pi
        return (e * cos((a[2] + b[2]) / 2)) ** 2 + (a[2] - b[2]) ** 2

    assert got == {(a[0], b[0]) for a in rows for b in rows if d2(a, b) < r * r}


def test_nearest_looks_farther(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.5)], "node_id bigint, lon double, lat double")
    points = spark.createDataFrame([(7, 0.9, 0.5), (8, -1.0, 0.0)], "pid bigint, lon double, lat double")
    assert {(x["pid"], x["node_id"]) for x in spatial.nearest(points, nodes, 0.05, "pid").collect()} == {(7, 2), (8, 1)}


def test_gap_fill_ends_and_empty(spark):
    rows = [(1, t, v) for t, v in enumerate((None, 1.0, None, None, 4.0, None))] + [(2, t, None) for t in range(3)]
    got = series.fill_gaps(spark.createDataFrame(rows, "n bigint, t bigint, v double"), "n", "t", ["v"]).orderBy("n", "t").collect()
    assert [x["v"] for x in got] == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0, 0.0, 0.0, 0.0]


def test_spline_is_exact_on_a_cubic(spark):
    f = lambda t: 2 - t + 0.5 * t**2 + 0.1 * t**3
    rows = [(1, t, f(t)) for t in range(9)]
    segments = series.spline_segments(spark.createDataFrame(rows, "n bigint, t bigint, v double"), "n", "t", "v", 1.0)
    got = series.evaluate(segments, spark.createDataFrame([(x / 8,) for x in range(65)], "t double"), 0.0, 1.0, 7).collect()
    assert len(got) == 65
    for x in got:
        assert x["value"] == pytest.approx(f(x["t"]), abs=1e-12) and x["slope"] == pytest.approx(-1 + x["t"] + 0.3 * x["t"] ** 2, abs=1e-11)
    with pytest.raises(ValueError):
        series.second_derivatives(np.zeros((1, 4)), 1.0)


def test_lookups_and_masks(spark):
    s = spark.createDataFrame([(1, 10, 1.0), (2, 10, None), (1, 20, None)], "cell_idx bigint, t_s bigint, value double")
    assert {(x["cell_idx"], x["sea"]) for x in grid.sea_mask(s).collect()} == {(1, True), (2, False)}
    assert grid.at_time(s, 9.6).count() == 2 and grid.at_index(s, 1).count() == 1
    with pytest.raises(KeyError):
        grid.at_time(s, 11)
    with pytest.raises(IndexError):
        grid.at_index(s, 2)
    with pytest.raises(ValueError):
        grid.sea_and_land([s.withColumn("sea", F.lit(True))])


def test_reconstruction_stops_and_guards(spark):
    schema = "seed_id bigint, lon double, lat double, init_idx bigint, stop_lon double, stop_lat double, stop_idx bigint"
    seeds = spark.createDataFrame([(1, 0.0, 0.0, 20, 0.5, 0.5, 18), (2, 0.0, 0.0, 20, None, None, None), (3, 1.0, 1.0, 20, None, None, None)], schema)
    field = nodes_of(spark, CROSS, lambda a, b: 4.0)  # always too fast
    samples, ends = integrate.reconstruct(seeds, at_all_times(field, 8, 20), 20, 8, 10, 1.1**0.5 * H, H * H, cut_every=5)
    causes = {x["seed_id"]: x["stop_cause"] for x in ends.collect()}
    assert causes == {1: "seed0", 2: "fast", 3: "no_nb"}
    rows = samples.orderBy("seed_id", F.desc("idx")).collect()
    assert [x["idx"] for x in rows if x["seed_id"] == 1] == [20, 19, 18]
    assert [x for x in rows if x["seed_id"] == 1][-1]["u"] is None and len([x for x in rows if x["seed_id"] == 2]) == 5
    assert len([x for x in rows if x["seed_id"] == 3]) == 11


def at_all_times(nodes, first, last):
    times = nodes.sparkSession.range(first, last + 1).withColumnRenamed("id", "t_idx")
    return fields.slots(nodes, nodes.crossJoin(times))


def test_dateline_trajectory(spark):
    rows = [(42, i, lon, 0.2) for i, lon in enumerate((3.10, 3.13, -3.13, -3.10))]
    got = trajectory.unwrap(spark.createDataFrame(rows, "seed_id bigint, idx bigint, lon double, lat double")).orderBy("idx").collect()
    assert [x["lon_unwrapped"] for x in got] == pytest.approx([3.10, 3.13, 2 * np.pi - 3.13, 2 * np.pi - 3.10])


def test_random_seeds_lie_by_the_coast_and_repeat(spark):
    sea = spark.createDataFrame([(i, 0.001 * i, 0.0) for i in range(50)], "node_id bigint, lon double, lat double")
    land = spark.createDataFrame([(100, 0.06, 0.0)], "node_id bigint, lon double, lat double")
    draw = lambda: sorted(map(tuple, seeding.random_by_coast(sea, land, 20, 3, 5e-4, 2e-3, 0.015, 0.03).collect()))
    got = draw()
    assert len(got) == 20 and got == draw() and all(0.0299 <= x[0] <= 0.0451 for x in got)


def test_seed_errors(spark):
    s = spark.createDataFrame([(1, 0.0, 0.0, 5)], "seed_id bigint, lon double, lat double, t_s bigint")
    with pytest.raises(Exception, match="no start or no stop"):
        seeding.pair(s, s.withColumn("seed_id", F.lit(2).cast("bigint"))).collect()
    late = spark.createDataFrame([(1, 5, 6)], "seed_id bigint, t_start bigint, t_stop bigint")
    with pytest.raises(Exception, match="later than its start"):
        seeding.check_order(late).collect()
    assert seeding.spawn(s, "2000-02-28", "2000-03-01").select("release_day").distinct().count() == 3
    assert dt.date(2000, 2, 29) in [x["release_day"] for x in seeding.spawn(s, "2000-02-28", "2000-03-01").collect()]
    assert seeding.regular_grid(spark, -180.0, 180.0, 0.0, 1.0, 90.0).count() == 4
    assert geo.EARTH_RADIUS_M == 6371000.0


def test_nearest_equals_brute_force_far_and_near(spark):
    rng = np.random.default_rng(4)
    place = lambda n: np.c_[rng.uniform(-np.pi, np.pi, n), np.arcsin(rng.uniform(-1, 1, n))]
    nodes = np.concatenate([[0.3, 0.2] + rng.uniform(-0.02, 0.02, (80, 2)), [[np.pi - 1e-3, 0.0], [2.0, np.pi / 2 - 1e-3], [-2.0, -1.5]]])
    nodes = np.concatenate([nodes, nodes[:5]])  # equally near ones: the smallest number counts
    points = np.concatenate([place(120), [0.3, 0.2] + rng.uniform(-0.05, 0.05, (60, 2)), [[-np.pi + 1e-4, 0.01], [0.0, np.pi / 2], [0.0, -np.pi / 2]]])
    east = np.pi - np.mod(np.pi - (points[:, None, 0] - nodes[None, :, 0]), 2 * np.pi)
    d2 = (east * np.cos((points[:, None, 1] + nodes[None, :, 1]) / 2)) ** 2 + (points[:, None, 1] - nodes[None, :, 1]) ** 2
    frame = lambda a, name: spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(a)], f"{name} bigint, lon double, lat double")
    got = {r["pid"]: (r["node_id"], r["d2"]) for r in spatial.nearest(frame(points, "pid"), frame(nodes, "node_id"), 0.005, "pid").collect()}
    assert len(got) == len(points)
    for k, row in enumerate(d2):
        assert got[k][1] == pytest.approx(row.min(), rel=1e-9, abs=1e-15) and row[got[k][0]] == pytest.approx(row.min(), rel=1e-9, abs=1e-15) and got[k][0] < 83


def test_nearest_over_many_doublings_and_thinning(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0)], "node_id bigint, lon double, lat double")
    points = spark.createDataFrame([(7, 0.9, 0.5), (8, 0.001, 0.0)], "pid bigint, lon double, lat double")
    assert {(x["pid"], x["node_id"]) for x in spatial.nearest(points, nodes, 0.005, "pid").collect()} == {(7, 1), (8, 1)}
    ids = spark.range(200_000).selectExpr("id + 1152921504606846976 AS seed_id")
    assert 50 < seeding.thin(ids, 0.0005, None, 1).count() < 160 and seeding.thin(ids, 0.0, None, 1).count() == 0 and seeding.thin(ids, 1.0, 7, 1).count() == 7
