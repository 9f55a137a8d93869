"""Tables of nodes, samples, particles and seeds derived from the relational test data, in Spark and as SQL text.

Numbers are written with exponents: both engines then take them for doubles.
"""

from __future__ import annotations

from math import pi, radians

from pyspark.sql import DataFrame, SparkSession

RADIUS, SHAPE = radians(88e-3), radians(8e-2) ** 2
NODES = ["p_partkey AS node_id", "radians(100e0 + 8e-2 * (p_partkey % 50)) AS lon", "radians(-16e0 + 8e-2 * floor(p_partkey / 50e0)) AS lat", "p_size > 5 AS sea"]
T_IDX = "CAST((year(l_shipdate) - 1992) * 4 + quarter(l_shipdate) - 1 AS BIGINT)"
SAMPLES = f"l_partkey AS node_id, {T_IDX} AS t_idx, avg(l_discount - 5e-2) * 1e1 AS u, avg(l_tax - 4e-2) * 1e1 AS v"
ROWS = "(SELECT floor(max(p_partkey) / 50e0) FROM part)"
PARTICLES = ["c_custkey AS pid", "radians(100e0 + 8e-2 * 49 * ((c_custkey * 7919) % 1000) / 1e3) AS lon", "radians(-16e0 + 8e-2 * {rows} * ((c_custkey * 104729) % 997) / 997e0) AS lat"]
DAYS_2000 = {"spark": "datediff(CAST(o_orderdate AS DATE), DATE'2000-01-01')", "duck": "datediff('day', DATE '2000-01-01', CAST(o_orderdate AS DATE))"}

#: Common table expressions for the oracle.
CTES = {
    "nodes": f"SELECT {', '.join(NODES)} FROM part",
    "samples": f"SELECT {SAMPLES} FROM lineitem GROUP BY 1, 2",
    "particles": f"SELECT {', '.join(PARTICLES).format(rows=ROWS)} FROM customer",
    "seeds": f"SELECT o_orderkey AS seed_id, o_custkey AS pid, CAST(o_orderdate AS DATE) AS day, CAST({DAYS_2000['duck']} AS BIGINT) * 86400 AS t_s FROM orders",
    "irregular": "SELECT user_id AS series_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) - 946684800 AS t_s, value FROM events",
}


def with_tables(*names: str) -> str:
    """``WITH`` and these tables, to be continued by a comma or a query."""
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*NODES)


def samples(spark: SparkSession, sf_dir: str, exact: bool = False) -> DataFrame:
    """``exact``: means that don't hang on the order of rows, for those who ask for the sign of a mean that is next to zero."""
    u, v = (x.rpartition(" AS ")[0] for x in SAMPLES.split(", ")[2:4])
    if exact:
        u, v = (exact_mean(x[len("avg(") : x.rindex(")")]) + x[x.rindex(")") + 1 :] for x in (u, v))
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey", _expr(T_IDX).alias("t_idx")).agg(_expr(u).alias("u"), _expr(v).alias("v")).withColumnRenamed("l_partkey", "node_id")


def exact_mean(x: str) -> str:
    """The mean of doubles by the sum of their whole multiples of 2 ** -60, rounded once; the plain mean where some are 8 or more.

    Sums of doubles differ in their last digits by the order of rows, which tasks don't keep. Multiples are summed in two halves of 30 bits.
    """
    n = f"CASE WHEN abs({x}) < 8 THEN CAST(({x}) * {2.0**60!r} AS BIGINT) END"
    total = f"(sum(shiftright({n}, 30)) * {2.0**30!r} + sum({n} & {(1 << 30) - 1})) / {2.0**60!r}"
    return f"CASE WHEN count({n}) = count({x}) THEN {total} / count({x}) ELSE avg({x}) END"


def _expr(text: str):
    import pyspark.sql.functions as F

    return F.expr(text)


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("floor(max(p_partkey) / 50e0) AS r").first()["r"]
    return table(spark, sf_dir, "customer").selectExpr(*[x.format(rows=rows) for x in PARTICLES])


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS seed_id", "o_custkey AS pid", "CAST(o_orderdate AS DATE) AS day", f"CAST({DAYS_2000['spark']} AS BIGINT) * 86400 AS t_s"
    )


def irregular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("user_id AS series_id", "CAST(unix_seconds(CAST(ts AS TIMESTAMP)) AS BIGINT) - 946684800 AS t_s", "value")


# --- SQL forms of the functions, for the oracle ------------------------------------------------------------------------


def sql_wrap(x: str) -> str:
    return f"({pi!r} - (({pi!r} - ({x})) - 2 * {pi!r} * floor(({pi!r} - ({x})) / (2 * {pi!r}))))"


def sql_cosine(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return f"greatest(-1e0, least(1e0, sin({lat1}) * sin({lat2}) + cos({lat1}) * cos({lat2}) * cos({lon1} - {lon2})))"


def sql_angle(*a: str) -> str:
    c = sql_cosine(*a)
    return f"atan2(sqrt(1 - {c} * {c}), {c})"


def sql_metric2(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    east = f"{sql_wrap(f'{lon1} - {lon2}')} * cos(({lat1} + {lat2}) / 2)"
    return f"({east} * {east} + ({lat1} - {lat2}) * ({lat1} - {lat2}))"


def sql_moved(x: str, y: str, lon: str, lat: str) -> tuple[str, str]:
    length = f"sqrt({x} * {x} + {y} * {y})"
    a = f"({length} / 6371000e0)"
    to_lat = f"asin(greatest(-1e0, least(1e0, sin({lat}) * cos{a} + {y} / {length} * cos({lat}) * sin{a})))"
    to_lon = f"({lon} + atan2({x} * sin{a}, {length} * cos({lat}) * cos{a} - {y} * sin({lat}) * sin{a}))"
    return f"CASE WHEN {length} < 1e-10 THEN {lon} ELSE {to_lon} END", f"CASE WHEN {length} < 1e-10 THEN {lat} ELSE {to_lat} END"
