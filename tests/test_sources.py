import datetime as dt
import time

import numpy as np
import pyspark.sql.functions as F
import pytest

from tidewright.operators import grid, months
from tidewright.sources import daily, gridded, packed, seeds
from tidewright.sources.files import list_files, open_input


def records(n):
    r = np.zeros(n, dtype=packed.RECORD)
    r["lon0_q"], r["t0_s"], r["flags"] = np.arange(n), np.arange(n) * 10, 165
    return r


def test_plain_and_gzip_records(spark, tmp_path):
    packed.register(spark)
    packed.write_plain(str(tmp_path / "a.pkd"), records(5))
    packed.write_gzip(str(tmp_path / "b.pkd.gz"), records(2), released=9)
    packed.write_gzip(str(tmp_path / "b.pkd.gz"), records(1), append=True)
    packed.write_gzip(str(tmp_path / "b.pkd.gz"), records(0), append=True)
    assert packed.gzip_header((tmp_path / "b.pkd.gz").read_bytes()[:64]) == (9, 3)
    assert np.array_equal(np.concatenate(list(packed.read_gzip(str(tmp_path / "b.pkd.gz")))), np.concatenate([records(2), records(1)]))
    assert spark.read.format("pkd1").load(str(tmp_path)).agg(F.sum("t0_s")).first()[0] == 100 + 10
    assert packed.RECORD.itemsize == 33 and packed.HEADER_1.size == 40 and packed.HEADER_2.size == 52 and packed.BLOCK_2.size == 28 and packed.ENTRY_2.size == 36


def test_cut_files_are_errors(tmp_path):
    path = tmp_path / "c.pkd.gz"
    packed.write_gzip(str(path), records(100))
    path.write_bytes(path.read_bytes()[:-20])
    with pytest.raises(ValueError):
        list(packed.read_gzip(str(path)))
    with pytest.raises(ValueError):
        packed.check_header_1(b"PKD2" + bytes(36))


def test_trajectories(spark, tmp_path):
    packed.register(spark)
    lons, lats = (3.10, 3.13, -3.13, -3.10), (0.20, 0.21, 0.22, 0.23)
    rows = [(42, 7 + i, lons[i], lats[i]) for i in range(4)] + [(5, 1, 0.5, 0.1)]
    samples = spark.createDataFrame(rows, "seed_id bigint, idx bigint, lon double, lat double")
    packed.write_trajectories(samples, str(tmp_path / "t"), 10800, 946684800)
    out = list_files(str(tmp_path / "t"))
    back = spark.read.format("pkd2").load(",".join(out))
    got = back.where("seed_id = 42").orderBy("idx").collect()
    assert [x["lon"] for x in got] == pytest.approx([3.10, 3.13, 2 * np.pi - 3.13, 2 * np.pi - 3.10], abs=2.1e-6)
    assert [x["t_s"] for x in got] == [946684800 + (7 + i) * 10800 for i in range(4)]
    assert back.where("seed_id = 1").count() == 0
    only = next(p for p in out if any(e[0] == 42 for e in packed.read_toc(p)[2]))
    s = {x["seed_id"]: x for x in seeds.seeds(spark, only).collect()}[42]
    assert s["lon"] == pytest.approx(-3.10, abs=2.1e-6) and s["stop"]["lon"] == pytest.approx(3.10, abs=2.1e-6)
    with pytest.raises(ValueError):
        seeds.seeds(spark, "x.txt")


def test_csv_seeds(spark, tmp_path):
    (tmp_path / "s.csv").write_text("t_start_s, lon_rad ,lat_rad,seed_id\n10, 3.5, 0.1, 7\n\n 20,0,0,8\n")
    got = {x["seed_id"]: x for x in seeds.seeds(spark, str(tmp_path / "s.csv")).collect()}
    assert len(got) == 2 and got[7]["lon"] == pytest.approx(3.5 - 2 * np.pi) and got[8]["t_s"] == 20 and got[7]["stop"] is None


def test_classic_files(spark, tmp_path):
    raw = np.array([[[1, -30000], [3, 4]], [[5, 6], [-99, 8]], [[1, 2], [3, 4]]], dtype=np.int16)
    other = raw.astype(np.float32)
    path = str(tmp_path / "f.nc")
    gridded.write_classic(path, {"time": 3, "lat": 2, "lon": 2}, {
        "time": (["time"], np.array([0.0, 1.0, 2.0]), {"units": "Hours since 2000-01-01"}), "lon": (["lon"], np.array([10.0, 11.0]), {}), "lat": (["lat"], np.array([-30000.0, 1.0]), {}),
        "u": (["time", "lat", "lon"], raw, {"scale_factor": 0.5, "add_offset": 1.0}), "v": (["time", "lat", "lon"], other, {"missing_value": np.float32(-99)}),
    })
    gridded.register(spark)
    got = {(x["variable"], x["t_s"], x["cell_idx"]): x["value"] for x in spark.read.format("gridnc").option("path", path).option("stepsPerSplit", "2").load().collect()}
    assert got["u", 0, 0] == 1.5 and got["u", 0, 1] is None and got["u", 3600, 2] == -48.5 and got["v", 3600, 2] is None and got["v", 0, 1] == -30000.0
    assert got["lat", 0, 0] == -30000.0 and len(got) == 2 + 2 + 12 + 12
    assert gridded.header_errors(path, ["u"], 3) == [] and len(gridded.header_errors(path, ["w"], 4)) == 2
    meta = {x["variable"]: x for x in gridded.grid_meta(spark, path).collect()}
    assert meta["u"]["shape"] == [3, 2, 2] and meta["time"]["times"] == [0, 3600, 7200]
    nodes, filled = gridded.load_month(spark, path, "u", "v", 1800)
    assert nodes.where("sea").count() == 3 and filled.count() == 3 * 5
    assert filled.where("node_id = 2 and t_s = 1800").first()["u"] == pytest.approx((2.5 - 48.5) / 2)
    (tmp_path / "bad.nc").write_bytes(b"\x89HDF\r\n")
    assert gridded.header_errors(str(tmp_path / "bad.nc"), [])


def test_stream_of_releases(spark, tmp_path):
    from tidewright.streaming.releases import trace_releases

    src = str(tmp_path / "in")
    spark.range(10).withColumnRenamed("id", "seed_id").write.parquet(src)
    trace_releases(spark.readStream.schema("seed_id bigint").parquet(src), lambda b: b.withColumn("n", F.col("seed_id") * 2), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("n")).first()[0] == 90


def test_writes_commit_whole_or_leave_nothing(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = spark.range(0, 50_000, 1, 4).selectExpr("int(id) lon0_q", "int(-id) lat0_q", "int(id) lon1_q", "int(id) lat1_q", "id * 3 AS t0_s", "-id AS t1_s", "smallint(id % 200) flags")
    packed.write_packed(rows, folder)
    first = list_files(folder)
    packed.write_packed(rows.limit(7), folder)
    back = spark.read.format("pkd1").load(folder)
    assert len(first) == 4 and set(first) < set(list_files(folder)) and back.count() == 50_007 and back.exceptAll(rows).count() == 7
    assert sum(packed.gzip_header(open(p, "rb").read(64))[1] for p in list_files(folder)) == 50_007
    broken = rows.withColumn("t0_s", F.when(F.col("t0_s") == 149_997, F.raise_error(F.lit("torn")).cast("bigint")).otherwise(F.col("t0_s")))
    with pytest.raises(Exception, match="torn"):
        packed.write_packed(broken, folder)
    for _ in range(50):  # a task that is killed may still be at its last write
        if (left := len(list((tmp_path / "out").iterdir()))) == 5:
            break
        time.sleep(0.1)
    assert left == 5 and spark.read.format("pkd1").load(folder).count() == 50_007
    packed.write_packed(rows.limit(3), folder, gzip=False, mode="overwrite")
    assert len(list((tmp_path / "out").iterdir())) == 1 and spark.read.format("pkd1").load(folder).count() == 3


def test_repeated_ids_and_filters_of_trajectories(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packed, "SPLIT_BLOCKS", 4)
    blocks = [(seed, np.array([seed / 10, seed / 10 + n / 100]), np.array([0.0, 0.1])) for n, seed in enumerate([1, 2, 3, 1, 4, 5, 6, 7, 8, 2, 9])]
    body, toc, at = b"", b"", packed.HEADER_2.size
    for seed, lon, lat in blocks:
        raw = packed.encode_block(seed, 0, 1, lon, lat)
        data = packed.zlib.compress(raw)
        toc += packed.ENTRY_2.pack(seed, at + len(body), len(data), len(raw), 2, 0, 1, 0)
        body += data
    (tmp_path / "x.pkd2").write_bytes(packed.HEADER_2.pack(packed.MAGIC_2, packed.VERSION_2, 1, packed.SCALE, 0, 10, 0, len(blocks), at + len(body)) + body + toc)
    got = packed.read_trajectories(spark, str(tmp_path))
    assert {(r["seed_id"], round(r["lon"] * 100)) for r in got.where("idx = 1").collect()} == {(1, 13), (2, 29), (3, 32), (4, 44), (5, 55), (6, 66), (7, 77), (8, 88), (9, 100)}
    for test, want in (("seed_id = 2", {2}), ("seed_id IN (1, 9, 77)", {1, 9}), ("seed_id > 7", {8, 9}), ("seed_id <= 1", {1}), ("seed_id >= 3 AND seed_id < 5", {3, 4})):
        assert {r["seed_id"] for r in got.where(test).collect()} == want and got.where(test).count() == 2 * len(want)
    reader = packed.TrajectoryReader({"path": str(tmp_path)})
    assert [(p.first, p.last) for p in reader.partitions()] == [(0, 4), (4, 8), (8, 11)]
    read = []

    class Watched:  # a task's reads: its header, its entries and its blocks, however long the table of contents
        def __init__(self, path):
            self.f = open(path, "rb")

        def __enter__(self):
            return self

        def __exit__(self, *a):
            self.f.close()

        def seek(self, at):
            self.f.seek(at)

        def read(self, n):
            read.append(n)
            return self.f.read(n)

    part = reader.partitions()[2]
    monkeypatch.setattr(packed, "open_input", Watched)
    list(reader.read(part))
    assert read[:2] == [packed.HEADER_2.size, 3 * packed.ENTRY_2.size] and len(read) == 5


def test_daily_files_hold_twelve_columns(spark, tmp_path):
    rows = [(k, 0.1 * k, 0.2, -0.1, 0.3, 1 + k % 5, 3, 0.5, 10.0, 9.0, k % 2, k, f"2001-03-0{1 + k % 2}") for k in range(20)]
    run = spark.createDataFrame(rows, "pid bigint, lon0 double, lat0 double, lon double, lat double, status int, valid_steps bigint, mean_speed double, path_length double, displacement double, lon_idx int, lat_idx int, release_day string")
    daily.write_daily(run, str(tmp_path), 15, 3.0, 0.375, 0.08)
    names = sorted(p.name for p in tmp_path.iterdir())
    assert names == ["regular_grid_transport_2001_03_01_15m.nc", "regular_grid_transport_2001_03_02_15m.nc"]
    with open_input(str(tmp_path / names[0])) as f:
        file = gridded.ClassicFile(f)
        assert list(file.variables) == list(daily.COLUMNS) and file.version == 5 and file.dims == [("particle", 6)]
        assert file.attributes["title"] == daily.TITLE and file.attributes["release_time_seconds_since_2000"][0] == months.seconds(dt.date(2001, 3, 1)) and file.attributes["dt_hours"][0] == 3.0
        assert file.variables["status"].attributes["flag_values"] == "1, 2, 3, 4, 5" and file.variables["path_length_m"].attributes["units"] == "m"
        ids = file.slice(file.variables["particle_id"])
        assert ids.tolist() == [k for k in range(0, 20, 2) if 1 + k % 5 < 4]
    back = {r["particle_id"]: r for r in daily.read_daily(spark, str(tmp_path)).collect()}
    assert set(back) == {k for k in range(20) if 1 + k % 5 < 4} and back[7]["lon_init_deg"] == pytest.approx(np.degrees(0.7), rel=1e-6) and back[7]["status"] == 3 and back[7]["lat_idx"] == 7
    daily.write_daily(run, str(tmp_path / "shared"), 15, 3.0, 0.375, 0.08, omit_start_failures=False, shares=3)
    assert daily.read_daily(spark, str(tmp_path / "shared")).count() == 20 and len(list((tmp_path / "shared").iterdir())) > 2


def test_coast_rows_and_names(spark, tmp_path):
    land = spark.range(20).selectExpr("CASE WHEN id < 12 THEN 1 ELSE 2 END AS domain", "19 - id AS cell_idx", "radians(id) AS lon", "radians(-id) AS lat")
    seeds.write_coast(land, str(tmp_path / "coast"), 8)
    got = spark.read.option("header", True).csv(str(tmp_path / "coast"))
    assert got.columns == ["lon_deg", "lat_deg", "label"] and sorted(round(float(r["lon_deg"])) for r in got.collect()) == [3, 11, 19]
    assert seeds.result_name("landed", "2001_03_01", 15) == "landed_2001_03_01_15m.pkd.gz"
    s = spark.createDataFrame([(1, 2.0), (2, 3.0)], "cell_idx bigint, value double")
    n = spark.createDataFrame([(1, True), (2, False)], "cell_idx bigint, sea boolean")
    assert {(r["cell_idx"], r["value"]) for r in grid.masked(s, n).collect()} == {(1, 2.0), (2, None)}
