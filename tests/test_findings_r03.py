"""What the review of round 3 found: boxes and tiles beyond a pole, means by any order of rows, packed records by particle, what months shuffle."""

import datetime as dt
import itertools

import numpy as np
import pandas as pd
import pyspark.sql.functions as F

from tidewright.functions import geo
from tidewright.operators import fields, integrate, months
from tidewright.plans import month_queries
from tidewright.plans import queries as q
from tidewright.sources import gridded

SF = "/root/testdata/sf0.001"


def test_a_box_that_reaches_a_pole_has_no_bound_there(spark):
    at = spark.createDataFrame([(100.0, 95.0), (100.0, -95.0), (100.0, 5.0), (102.0, 5.0), (104.0, 170.0)], "lon double, lat double")
    lon, lat = F.radians("lon"), F.radians("lat")
    got = at.select(geo.in_box(lon, lat, 103.0, 101.0, -90.0, 90.0), geo.in_box(lon, lat, -180.0, 180.0, -90.0, -15.0), geo.in_box(lon, lat, 99.0, 105.0, -80.0, 80.0)).collect()
    assert [r[0] for r in got] == [True, True, True, False, True]
    assert [r[1] for r in got] == [False, True, False, False, False]
    assert [r[2] for r in got] == [False, False, True, True, False]


def test_a_sea_mask_does_not_hang_on_the_order_of_rows(spark, tmp_path):
    # Summed from the left some orders give 0, others a little more; the exact sum is positive.
    discounts = [0.07, 0.10, 0.01, 0.02, 0.05]
    orders = list(itertools.permutations(discounts))
    rows = [(n, x, 0.04, dt.datetime(1998, 4, 1)) for n, some in enumerate(orders) for x in some]
    pd.DataFrame(rows, columns=["l_partkey", "l_discount", "l_tax", "l_shipdate"]).astype({"l_shipdate": "datetime64[us]"}).to_parquet(tmp_path / "lineitem.parquet")
    assert {r["sea"] for r in q.sea_mask(spark, str(tmp_path)).collect()} == {True}


def test_packed_records_come_back_with_their_particle(spark):
    want = q.quantize_record(spark, SF)
    got = q.pkd1_roundtrip(spark, SF)
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())


def _around_twice(spark):
    """A grid, the same 360 degrees further north with other velocities, particles in both; in radians."""
    lon, lat = (x.ravel() for x in np.meshgrid(np.arange(100.0, 108.0), np.r_[0.0:8.0, 360.0:368.0]))
    n = np.arange(len(lon))
    node = spark.createDataFrame(pd.DataFrame({"node_id": n, "lon": np.radians(lon), "lat": np.radians(lat)}))
    k = np.arange(6)
    sample = spark.createDataFrame(pd.DataFrame({"node_id": np.repeat(n, 6), "t_idx": np.tile(k, len(n)), "u": np.sin(n[:, None] * 1.3 + k).ravel(), "v": np.cos(n[:, None] * 0.7 - k).ravel()}))
    at = np.r_[np.linspace(0.5, 6.5, 20), np.linspace(360.5, 366.5, 20)]
    parts = spark.createDataFrame(pd.DataFrame({"pid": np.arange(40), "lon": np.radians(np.linspace(101, 106, 40)), "lat": np.radians(at), "init_t": 5}))
    return fields.slots(node, sample), spark.createDataFrame([(0.0, 0.0)], "lon double, lat double"), parts


def _run(spark, small):
    field, land, parts = _around_twice(spark)
    return integrate.backward(parts, field, land, 5, 2, 5000.0, np.radians(1.7), np.radians(1.0) ** 2, 1e-3, 1e9, 0.0, 4, "pid", 1, small).orderBy("pid").toPandas()


def test_particles_beyond_a_pole_meet_the_nodes_that_their_first_move_takes_them_to(spark):
    tiles, plain = _run(spark, False), _run(spark, True)
    assert np.abs(tiles[["lon", "lat"]].to_numpy() - plain[["lon", "lat"]].to_numpy()).max() < 1e-12 and tiles["lat"].max() < 1


def test_a_step_with_tiles_begins_where_no_join_of_the_steps_before_runs_again(spark, monkeypatch):
    found, velocity = [], fields.Meeting.velocity

    def counted(self, rows, *rest):
        found.append(rows._jdf.queryExecution().withCachedData().collectLeaves().size())
        return velocity(self, rows, *rest)

    monkeypatch.setattr(fields.Meeting, "velocity", counted)
    _run(spark, False)
    assert len(found) == 4 and max(found[1:]) == 2  # the rows and the land; the kept tables of the step before are not read again


def test_a_particle_beyond_a_pole_that_stands_still_keeps_its_latitude(spark):
    at = spark.createDataFrame([(1.0, 2.0, 0.0)], "lon double, lat double, u double")
    assert at.select(integrate._step(F.col("u"), F.col("u"))[1]).first()[0] == 2.0


def _shuffled(spark, work):
    """Records that the stages of ``work`` write to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        found = store.stageList(None, False, False, none, None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = set(stages())
    work()
    return sum(n for k, n in stages().items() if k not in before)


def test_month_files_and_splines_shuffle_each_cell_and_day_once(spark, tmp_path):
    folder, lines = str(tmp_path), spark.read.parquet(f"{SF}/lineitem.parquet").count()
    cells = month_queries._cells(spark, SF).count()
    patterns = []
    # Known velocities and a number for each latitude and day; there may be a little more.
    assert _shuffled(spark, lambda: patterns.extend(month_queries.write_files(spark, SF, f"{folder}/files"))) < 1.1 * lines + 62 * cells / 50 + 2 * cells
    # From the day before the months to the second day of the next ones, 31 and 34 days; nodes by themselves some times.
    assert _shuffled(spark, lambda: months.write_months(spark, month_queries.MONTHS, patterns, month_queries.LEVEL, "water_u", "water_v", 86400, folder)) < (31 + 34 + 12) * cells


def test_cells_of_nodes_are_not_shuffled_with_tiles(spark, monkeypatch):
    found, tiles = [], fields.Meeting._tiles

    def counted(self, *rest):
        out = tiles(self, *rest)
        found.append((_shuffled(spark, self.entries.count), self.entries.count()))
        return out

    monkeypatch.setattr(fields.Meeting, "_tiles", counted)
    _run(spark, False)
    assert len(found) == 1 and found[0][0] < found[0][1] / 2


def test_wide_rows_of_files_hold_what_long_ones_do(spark, tmp_path):
    gridded.register(spark)
    shape, axes = ["time", "lat", "lon"], {"lon": (["lon"], np.array([1.0, 2.0]), {}), "lat": (["lat"], np.array([3.0, 4.0]), {})}
    for name, at, values in (("a", [0.0, 60.0], {"u": 1.0, "v": 2.0}), ("b", [60.0, 120.0], {"u": 5.0}), ("c", [120.0], {"u": 7.0, "v": 8.0})):
        arrays = {c: (shape, x + np.arange(4.0 * len(at)).reshape(len(at), 2, 2), {"_FillValue": np.float64(x + 3)}) for c, x in values.items()}
        gridded.write_classic(f"{tmp_path}/{name}.nc", {"time": len(at), "lat": 2, "lon": 2}, {"time": (["time"], np.array(at), {}), **axes, **arrays})
    read = spark.read.format("gridnc").option("path", str(tmp_path)).option("variables", "u,v")
    long = sorted((ord(r["file"][-4]) - ord("a"), r["variable"], r["t_s"], r["cell_idx"], repr(r["value"])) for r in read.load().collect())
    wide = read.option("wide", "true").load().collect()
    assert long == sorted((r["file_no"], c, r["t_s"], r["cell_idx"], repr(r[c])) for r in wide for k, c in enumerate("uv") if r["known"] >> k & 1)
    # At 60 the last file has u alone, so v comes from the one before; the third cell at 120 is not missing in the last one.
    nodes, filled = gridded.load_month(spark, str(tmp_path), "u", "v", 60)
    got = {(r["node_id"], r["t_s"]): (r["u"], r["v"]) for r in filled.collect()}
    assert nodes.where("sea").count() == 3 and len(got) == 9 and got[0, 60] == (5.0, 6.0) and got[0, 120] == (7.0, 8.0) and got[2, 60] == (7.0, 8.0)
