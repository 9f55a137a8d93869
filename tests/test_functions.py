import datetime as dt
from math import pi

import pyspark.sql.functions as F
import pytest

from tidewright.functions import dates, fixed, geo


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


L = F.lit


@pytest.mark.parametrize(("lon", "angle"), [(0.0, 0.0), (pi / 2, pi / 2), (pi, pi)])
def test_central_angle(spark, lon, angle):
    assert one(spark, geo.central_angle(L(0.0), L(0.0), L(lon), L(0.0))) == pytest.approx(angle, abs=1e-15)


@pytest.mark.parametrize(("lon", "lat", "x", "y"), [(0.2, 0.5, 1500.0, -2600.0), (pi - 1e-4, 0.7, 4000.0, 1500.0), (-2.4, 1.1, -1200.0, 800.0)])
def test_moved_lies_at_its_offset(spark, lon, lat, x, y):
    to = one(spark, geo.moved(L(x), L(y), L(lon), L(lat)))
    g = one(spark, geo.kernel_gradient(L(lon), L(lat), L(to["lon"]), L(to["lat"])))
    assert g["east"] * geo.EARTH_RADIUS_M == pytest.approx(x, abs=1e-3)
    assert g["north"] * geo.EARTH_RADIUS_M == pytest.approx(y, abs=1e-3)


def test_no_offset_no_move_and_null_stays_null(spark):
    assert tuple(one(spark, geo.moved(L(0.0), L(0.0), L(-1.2), L(0.4)))) == (-1.2, 0.4)
    assert one(spark, geo.central_angle(L(0.0), L(0.0), L(None).cast("double"), L(0.0))) is None


def test_gradient_against_differences(spark):
    lon, lat, lon2, lat2, h = 0.4, 0.6, 0.43, 0.58, 1e-5
    f = lambda a, b: -one(spark, geo.central_angle(L(a), L(b), L(lon2), L(lat2))) ** 2 / 2
    g = one(spark, geo.kernel_gradient(L(lon), L(lat), L(lon2), L(lat2)))
    import math

    assert g["east"] == pytest.approx((f(lon + h, lat) - f(lon - h, lat)) / (2 * h * math.cos(lat)), abs=2e-9)
    assert g["north"] == pytest.approx((f(lon, lat + h) - f(lon, lat - h)) / (2 * h), abs=2e-9)


def test_wrap_and_boxes(spark):
    assert one(spark, geo.wrap_lon(L(-pi))) == pytest.approx(pi)
    box = lambda lon, *b: one(spark, geo.in_box(F.radians(L(lon)), L(0.0), *b, -10.0, 10.0))
    assert box(179.5, 179.0, -179.0) and box(-179.5, 179.0, -179.0) and not box(0.0, 179.0, -179.0)
    assert box(0.0, -180.0, 180.0)


def test_packed_record(spark):
    r = fixed.packed_record(L(3.5), L(0.45), L(1.0), L(-0.72), L(1234.4), L(9876.6), L(0xA5))
    back = one(spark, fixed.unpacked_record(r))
    assert back["lon0"] == pytest.approx(3.5 - 2 * pi, abs=0.5e-6 + 1e-15) and back["lat1"] == pytest.approx(-0.72)
    assert (back["t0_s"], back["t1_s"], back["flags"]) == (1234, 9877, 0xA5)
    with pytest.raises(ValueError):
        fixed.time_index(L(1.0), 0)


def test_dates_round_trip(spark):
    months = spark.sql("SELECT explode(sequence(date'1992-01-01', date'2030-12-01', interval 1 month)) AS d").withColumn("e", F.last_day("d"))
    for c in "de":
        rows = months.select(dates.day_of(dates.seconds_2000(F.col(c))).alias("back"), c, dates.parse_day_column(dates.tag(F.col(c))).alias("parsed"), dates.month_of(dates.seconds_2000(F.col(c)) + 86399).alias("m"), "d")
        assert rows.where((F.col("back") != F.col(c)) | (F.col("parsed") != F.col(c)) | (F.col("m") != F.col("d"))).count() == 0
    assert one(spark, F.date_add(L(dt.date(2000, 1, 1)), 3653)) == dt.date(2010, 1, 1)


def test_lists_patterns_and_bad_dates(spark):
    assert [len(dates.split_list(x)) for x in ("lon,lat,water_u", "", ",,", "lon,,lat", "lon,lat,")] == [3, 0, 0, 2, 2]
    with pytest.raises(ValueError):
        dates.parse_day("2000-1-1")
    paths = dates.file_paths(spark, ["a/{YYYY}/{MM}{DD}_{LEV}.nc", "b{DD}"], "2000-02-28", "2000-03-01", 5).orderBy("domain", "day").collect()
    assert len(paths) == 6 and paths[1]["path"] == "a/2000/0229_0005.nc"
