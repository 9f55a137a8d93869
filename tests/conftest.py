import os
import sys
import tempfile
from pathlib import Path

import pandas as pd
import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def same_rows():
    def check(got, want):
        assert sorted(got.columns) == sorted(want.columns)
        def plain(v):
            if v is None or pd.isna(v):
                return None
            return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

        def rows(d):
            return sorted((tuple(map(plain, r)) for r in d[sorted(d.columns)].astype(object).itertuples(index=False)), key=repr)

        assert rows(got) == rows(want)

    return check


@pytest.fixture(scope="session")
def duck():
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con
