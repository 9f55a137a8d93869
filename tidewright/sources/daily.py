"""Daily results of forward runs as NetCDF files: one for each release day and level, with twelve columns of particles.

``df.write.format("transport")`` takes rows sorted by release day within their tasks. A task streams each column of a day to a spool of its own
and then puts them together behind the header, so it holds a batch, however many particles a day has; all files appear at the
commit. Files are CDF-5, the classic format with 64-bit numbers, and are read back by ``gridnc``.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource

from tidewright.functions.geo import wrap_lon
from tidewright.sources.gridded import classic_header
from tidewright.sources.seeds import result_name
from tidewright.sources.spool import Spool, SpoolWriter, finish

# The columns with their types and units, and the files' texts.
COLUMNS = {
    "particle_id": ("i8", None), "lon_idx": ("i4", None), "lat_idx": ("i4", None), "lon_init_deg": ("f4", "degrees_east"), "lat_init_deg": ("f4", "degrees_north"),
    "lon_final_deg": ("f4", "degrees_east"), "lat_final_deg": ("f4", "degrees_north"), "mean_speed_m_per_s": ("f4", "m s-1"), "path_length_m": ("f4", "m"),
    "displacement_m": ("f4", "m"), "valid_steps": ("i4", None), "status": ("i1", None),
}
STATUS_TEXTS = {"flag_values": "1, 2, 3, 4, 5", "flag_meanings": "ok landed no_sea start_land start_no_sea"}
TITLE = "Daily regular-grid forward particle transport diagnostics"
STATUS_MAPPING = "1=ok, 2=landed, 3=no_sea, 4=start_land, 5=start_no_sea"
NOTE = "straightness is not stored; calculate displacement_m/path_length_m"
EPOCH = dt.date(2000, 1, 1)
OPTIONS = ("dt_hours", "integration_days", "seed_step_deg")


def daily_rows(results: DataFrame, day: str = "release_day", key: str = "pid") -> DataFrame:
    """Rows of ``integrate.forward`` (with ``lon_idx, lat_idx`` and the release day) as the columns of a file."""
    exact = {
        "particle_id": F.col(key), "lon_idx": F.col("lon_idx"), "lat_idx": F.col("lat_idx"), "lon_init_deg": F.degrees("lon0"), "lat_init_deg": F.degrees("lat0"),
        "lon_final_deg": F.degrees(wrap_lon(F.col("lon"))), "lat_final_deg": F.degrees("lat"), "mean_speed_m_per_s": F.col("mean_speed"), "path_length_m": F.col("path_length"),
        "displacement_m": F.col("displacement"), "valid_steps": F.col("valid_steps"), "status": F.col("status"),
    }
    kinds = {"i8": "bigint", "i4": "int", "f4": "float", "i1": "tinyint"}
    return results.select(F.col(day).cast("date").alias("release_day"), *[exact[c].cast(kinds[k]).alias(c) for c, (k, _) in COLUMNS.items()])


class DailyWriter(SpoolWriter):
    def __init__(self, options, overwrite: bool) -> None:
        super().__init__(options["path"], overwrite)
        self.level, self.shared = int(options.get("level", "0")), options.get("shared", "false") == "true"
        self.numbers = {c: float(options.get(c, "0")) for c in OPTIONS}

    def _file(self, day: dt.date, n: int, spools: list[Spool]) -> str:
        texts = {
            "title": TITLE, "release_date": f"{day:%Y_%m_%d}", "release_time_seconds_since_2000": np.int64((day - EPOCH).days * 86400), "level_m": np.int32(self.level),
            **{c: np.float64(x) for c, x in self.numbers.items()}, "status_mapping": STATUS_MAPPING, "note": NOTE,
        }
        variables = {c: (["particle"], np.dtype(kind), ({"units": units} if units else {}) | (STATUS_TEXTS if c == "status" else {})) for c, (kind, units) in COLUMNS.items()}
        head, paddings = classic_header({"particle": n}, variables, texts)
        parts = [x for spool, pad in zip(spools, paddings, strict=True) for x in (spool, bytes(pad))]
        name = result_name("regular_grid_transport", f"{day:%Y_%m_%d}", self.level, f"{uuid.uuid4().hex}.nc" if self.shared else "nc")
        return finish(self.folder, self.mark, name, head, *parts)

    def files(self, batches: Iterator[pa.RecordBatch], spools: list[Spool]) -> Iterator[str]:
        now, n = None, 0
        for batch in batches:
            days = batch.column("release_day").to_pylist()
            at = 0
            while at < len(days):
                end = next((k for k in range(at, len(days)) if days[k] != days[at]), len(days))
                if now is not None and days[at] != now:
                    yield self._file(now, n, spools)
                    spools.clear()
                    n = 0
                now = days[at]
                if not spools:
                    spools.extend(Spool(self.folder, self.mark) for _ in COLUMNS)
                part = batch.slice(at, end - at)
                for spool, (c, (kind, _)) in zip(spools, COLUMNS.items(), strict=True):
                    spool.add(part.column(c).to_numpy(zero_copy_only=False).astype(f">{kind}").tobytes())
                n, at = n + end - at, end
        if n:
            yield self._file(now, n, spools)
            spools.clear()


class DailySource(DataSource):
    """``format("transport")``: writes only; ``gridnc`` reads the files."""

    @classmethod
    def name(cls) -> str:
        return "transport"

    def schema(self) -> str:
        return "release_day date"

    def writer(self, schema, overwrite: bool) -> DailyWriter:
        return DailyWriter(self.options, overwrite)


def write_daily(results: DataFrame, folder: str, level: int, dt_hours: float, integration_days: float, seed_step_deg: float, omit_start_failures: bool = True, key: str = "pid", shares: int = 1, mode: str = "append") -> None:
    """A file for each release day of ``results``, in order of the key, without rows that failed to start if so asked.

    A day is one task's work. With ``shares``, a day's particles are dealt out to so many tasks and files instead, whose names differ.
    """
    from tidewright.operators.report import without_start_failures

    spark = results.sparkSession
    spark.dataSource.register(DailySource)
    rows = daily_rows(without_start_failures(results) if omit_start_failures else results, key=key)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # by number, so that shares of a day aren't put together again
    rows = rows.withColumn("share", F.pmod(F.xxhash64("particle_id"), F.lit(shares))).repartition(parts, "release_day", "share").sortWithinPartitions("release_day", "share", "particle_id").drop("share")
    options = {"level": level, "dt_hours": dt_hours, "integration_days": integration_days, "seed_step_deg": seed_step_deg, "shared": "true" if shares > 1 else "false"}
    rows.write.format("transport").mode(mode).options(**options).save(folder)


def read_daily(spark: SparkSession, path: str) -> DataFrame:
    """The columns of daily files, a row for each particle: ``file``, then ``COLUMNS``."""
    from tidewright.sources.gridded import register

    register(spark)
    cells = spark.read.format("gridnc").option("variables", ",".join(COLUMNS)).load(path)
    kinds = {"i8": "bigint", "i4": "int", "f4": "float", "i1": "tinyint"}
    wide = cells.groupBy("file", "cell_idx").agg(*[F.max(F.when(F.col("variable") == c, F.col("value"))).cast(kinds[k]).alias(c) for c, (k, _) in COLUMNS.items()])
    return wide.select("file", *COLUMNS)
