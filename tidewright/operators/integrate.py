"""Euler steps of large ensembles, forward, backward and for reconstruction.

Steps are taken some at a time, between *cuts*. Only live particles take part: those released within a cut's times come in at its
beginning, and at its end the state goes to a table in the folder of ``spark.checkpoint.dir``, those that have ended to a part of
it that is only appended to and read again with the result. That also cuts the lineage and survives a lost executor. Between
cuts no step shuffles, with fields of broadcast size as with larger ones (``fields.Meeting``).

A particle has its own time ``t``, in any unit; a step looks at a window ``[T, T + tick)`` of times, in which each live particle takes one step.
"""

from __future__ import annotations

from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from tidewright.functions.geo import EARTH_RADIUS_M, central_angle, moved, wrap_lon
from tidewright.operators.fields import Field, Meeting
from tidewright.operators.storage import new_folder, remove

#: Why a particle ended, and the status of a forward run.
ALIVE, LANDED, NEVER_LEFT, LIFETIME = 0, 1, 2, 3
OK, STATUS_LANDED, NO_SEA, START_LAND, START_NO_SEA = 1, 2, 3, 4, 5
#: Lifetime and grace in seconds; guards of a reconstruction.
LIFETIME_S, GRACE_S = 730 * 86400, 7 * 86400
MOST_EMPTY, MOST_SPEED, MOST_FAST, STEP_SLACK = 10, 3.0, 4, 1.5
#: Steps between cuts.
CUT_EVERY = 8


class Run:
    """The live rows of a run, and the table of those that have ended, over any number of stretches."""

    def __init__(self, releases: DataFrame, over: Column) -> None:
        """``releases``: all rows to come, with their time ``t``. ``over``: whether a row has ended."""
        self.spark, self.releases, self.over = releases.sparkSession, releases, over
        self.folder, self.live, self.cuts, self.schema, self.ranges = new_folder(self.spark, "run"), None, 0, None, []
        self.keep = False  # whether the tables of rows that went on stay

    def stretch(self, windows: list[int], tick: int, meet: Meeting, step: Callable[[DataFrame, int], DataFrame], cut_every: int = CUT_EVERY, begin: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Takes ``step`` (rows and a window's T) for each window in turn. ``begin`` is applied to rows as they come in."""
        for at in range(0, len(windows), cut_every):
            some = windows[at : at + cut_every]
            low, high = min(some), max(some) + tick
            come = self.releases.where((F.col("t") >= low) & (F.col("t") < high))
            self.ranges.append((low, high))
            rows = come if self.live is None else self.live.unionByName(come.withColumn("fresh", F.lit(True)), allowMissingColumns=True)
            if self.live is None:
                rows = rows.withColumn("fresh", F.lit(True))
            columns = rows.columns
            with meet.deal(rows, low, high - 1, len(some)) as state:
                if begin is not None:
                    state = begin(state)
                state = state.drop("fresh")
                for n, window in enumerate(some):
                    state = step(state, window)
                    if n + 1 < len(some):
                        state = meet.settle(state)
                state = state.select(*[c for c in columns if c != "fresh"])
                path = f"{self.folder}/cut={self.cuts}"
                state.withColumn("over", self.over).write.partitionBy("over").parquet(path)
            self.schema = state.schema.add("over", "boolean")
            read = self.spark.read.schema(self.schema).parquet(path)
            self.live, done, self.cuts = read.where("NOT over").drop("over"), self.cuts, self.cuts + 1
            if done and not self.keep:  # the rows that went on are in the new table now
                remove(self.spark, f"{self.folder}/cut={done - 1}/over=false")

    def ended(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.folder).where("over").drop("over", "cut")

    def waiting(self) -> DataFrame:
        """Rows whose time never came."""
        seen = F.lit(False)
        for low, high in self.ranges:
            seen = seen | ((F.col("t") >= low) & (F.col("t") < high))
        return self.releases.where(~F.coalesce(seen, F.lit(False)))

    def result(self) -> DataFrame:
        """All rows: ended, still alive, not released."""
        if self.schema is None:
            return self.releases
        return self.ended().unionByName(self.live).unionByName(self.waiting())


def _step(x: Column, y: Column) -> tuple[Column, Column]:
    to = moved(x, y, F.col("lon"), F.col("lat"))
    return wrap_lon(to["lon"]), to["lat"]  # a move ends at a latitude of a right angle at most; one that stands still keeps its own


def _put(columns: list[str], new: dict[str, Column]) -> list[Column | str]:
    """The columns, some of them with new values."""
    return [new[c].alias(c) if c in new else c for c in columns]


def _backward_step(meet: Meeting, tick: int, dt: float, lifetime: float, grace: float) -> Callable[[DataFrame, int], DataFrame]:
    age = (F.col("init_t") - F.col("t")) / tick * dt
    young, old = (age >= grace) & (age < lifetime), age >= lifetime
    lon, lat = _step(-F.col("u") * dt, -F.col("v") * dt)

    def step(state: DataFrame, window: int) -> DataFrame:
        columns = state.columns
        live = (F.col("reason") == ALIVE) & (F.col("t") >= window) & (F.col("t") < window + tick)
        state = meet.near_land(state, live & young)
        reason = F.when(live & old, LIFETIME).when(live & F.col("near_land"), LANDED).otherwise(F.col("reason"))
        state = meet.velocity(state.select(*_put(columns, {"reason": reason})), live, window, window + tick - 1)
        new = {"lon": lon, "lat": lat, "t": F.col("t") - tick}
        return state.select(*_put(columns, {c: F.when(live, x).otherwise(F.col(c)) for c, x in new.items()}))

    return step


def _releases(particles: DataFrame, key: str) -> DataFrame:
    t = F.col("init_t").cast("bigint")
    return particles.select(key, "lon", "lat", t.alias("init_t"), t.alias("t"), F.lit(ALIVE).alias("reason"))


def backward_by_month(particles: DataFrame, months: list[tuple[int, int]], month_of: Callable[[int], tuple[Field, DataFrame]], dt: float, radius: float, shape: float, land_limit: float, lifetime: float = LIFETIME_S, grace: float = GRACE_S, cut_every: int = CUT_EVERY, key: str = "pid", tick: int = 1, small: bool | None = None) -> DataFrame:
    """Particles (``pid, lon, lat, init_t``) backward, month after month, the latest first: ``reason``, the place and ``t`` at the end.

    ``months`` has the first (latest) and the last window of each; windows lie ``tick`` apart, and a step is ``dt`` seconds. ``month_of(n)`` loads
    the field and land of month ``n`` when its turn comes, so one month is in a plan at a time. In a step: end of life, then land
    after the grace time, then sample and move. Without neighbours a particle stays and ages. Those released later wait.
    """
    run = Run(_releases(particles, key), F.col("reason") != ALIVE)
    for n, (first, last) in enumerate(months):
        field, land = month_of(n)
        meet = Meeting(field, land, radius, shape, land_limit, dt, key, small)
        run.stretch(list(range(first, last - 1, -tick)), tick, meet, _backward_step(meet, tick, dt, lifetime, grace), cut_every)
    return run.result()


def backward(particles: DataFrame, field: Field, land: DataFrame, first: int, last: int, dt: float, *rest, **options) -> DataFrame:
    """``backward_by_month`` over one stretch."""
    return backward_by_month(particles, [(first, last)], lambda n: (field, land), dt, *rest, **options)


def forward(seeds: DataFrame, field: Field, land: DataFrame, first: int, steps: int, dt: float, radius: float, shape: float, land_limit: float, cut_every: int = CUT_EVERY, key: str = "pid", small: bool | None = None) -> DataFrame:
    """Seeds (``pid, lon, lat``) over ``steps`` steps: status, place, steps, mean speed, path length and displacement (metres)."""
    meet = Meeting(field, land, radius, shape, land_limit, dt, key, small)
    zero = F.lit(0.0)
    start = seeds.select(
        key, "lon", "lat", F.col("lon").alias("lon0"), F.col("lat").alias("lat0"), F.lit(first).cast("bigint").alias("t"), F.lit(OK).alias("status"),
        F.lit(0).cast("bigint").alias("valid_steps"), zero.alias("speed_sum"), zero.alias("path_length"),
    )

    def begin(state: DataFrame) -> DataFrame:
        columns = state.columns
        state = meet.near_land(state, F.col("fresh"))
        return state.withColumn("status", F.when(F.col("fresh") & F.col("near_land"), START_LAND).otherwise(F.col("status"))).select(*columns)

    on = F.col("status") == OK
    lost, go = on & (F.col("n_nb") == 0), on & (F.col("n_nb") > 0)
    lon, lat = _step(F.col("u") * dt, F.col("v") * dt)
    speed = F.hypot("u", "v")
    pick = lambda a, c: F.when(go, a).otherwise(F.col(c))
    taken = {
        "lon": pick(lon, "lon"), "lat": pick(lat, "lat"), "t": F.col("t") + 1,
        "status": F.when(lost & (F.col("valid_steps") == 0), START_NO_SEA).when(lost, NO_SEA).otherwise(F.col("status")),
        "valid_steps": pick(F.col("valid_steps") + 1, "valid_steps"), "speed_sum": pick(F.col("speed_sum") + speed, "speed_sum"),
        "path_length": pick(F.col("path_length") + speed * dt, "path_length"),
    }
    landed = {"status": F.when(on & F.col("near_land"), STATUS_LANDED).otherwise(F.col("status"))}

    def step(state: DataFrame, window: int) -> DataFrame:
        columns = state.columns
        state = meet.velocity(state, on, window, window).select(*_put(columns, taken))
        return meet.near_land(state, on).select(*_put(columns, landed))

    run = Run(start, F.col("status") != OK)
    run.stretch(list(range(first, first + steps)), 1, meet, step, cut_every, begin)
    state = run.result()
    return state.select(
        key, "lon0", "lat0", "lon", "lat", "status", "valid_steps",
        F.when(F.col("valid_steps") > 0, F.col("speed_sum") / F.col("valid_steps")).otherwise(0.0).alias("mean_speed"), "path_length",
        (central_angle(F.col("lon0"), F.col("lat0"), F.col("lon"), F.col("lat")) * EARTH_RADIUS_M).alias("displacement"),
    )


RECORD = "array<struct<idx:bigint,lon:double,lat:double,u:double,v:double>>"


def reconstruct(seeds: DataFrame, field: Field, first: int, last: int, dt: float, radius: float, shape: float, lifetime: float = LIFETIME_S, cut_every: int = CUT_EVERY, key: str = "seed_id", small: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """Trajectories of seeds (``seed_id, lon, lat, init_idx, stop_lon, stop_lat, stop_idx``; no stop: nulls), backward.

    Returns samples (``seed_id, idx, lon, lat, u, v``; velocity null where it isn't known) and ends (``seed_id, stop_cause``:
    seed0, life, no_nb, fast, step; null while under way). In a step: the stop, the lifetime, neighbours, the record, the speed
    guard, the step guard, the move. Records since the last cut travel with their seed, so they are as many as its steps, and are
    written with it.
    """
    b = F.col("init_idx").cast("bigint")
    start = seeds.select(
        key, "lon", "lat", b.alias("init_t"), b.alias("t"), "stop_lon", "stop_lat", F.col("stop_idx").cast("bigint").alias("stop_t"), F.lit(0).alias("empty"), F.lit(0).alias("fast"),
        F.lit(None).cast("string").alias("stop_cause"), F.array().cast(RECORD).alias("records"),
    )
    meet = Meeting(field, None, radius, shape, 0.0, dt, key, small)

    def begin(state: DataFrame) -> DataFrame:
        return state.withColumn("records", F.array().cast(RECORD))  # those of the cut before are in its table

    lon, lat = _step(-F.col("u") * dt, -F.col("v") * dt)
    awaited = F.col("stop_cause").isNull() & F.coalesce(F.col("t") >= F.col("stop_t"), F.lit(True))

    def step(state: DataFrame, window: int) -> DataFrame:
        columns = state.columns
        # A seed at or past its stop doesn't ask for neighbours; nor does one that waits or has ended.
        live = awaited & (F.col("t") == window)
        state = meet.velocity(state, live, window, window)
        stop = live & F.coalesce(F.col("t") == F.col("stop_t"), F.lit(False))
        old = live & ~stop & ((F.col("init_t") - F.col("t")) * dt >= lifetime)
        going = live & ~stop & ~old
        none, moving = going & (F.col("n_nb") == 0), going & (F.col("n_nb") > 0)
        speed = F.hypot("u", "v")
        fast = F.when(moving, F.when(speed > MOST_SPEED, F.col("fast") + 1).otherwise(0)).otherwise(F.col("fast"))
        empty = F.when(none, F.col("empty") + 1).when(moving, 0).otherwise(F.col("empty"))
        cause = (
            F.when(stop, "seed0").when(old, "life").when(none & (empty > MOST_EMPTY), "no_nb").when(moving & (fast > MOST_FAST), "fast")
            .when(moving & (speed * dt > MOST_SPEED * dt * STEP_SLACK), "step").otherwise(F.col("stop_cause"))
        )
        record = F.struct(
            F.col("t").alias("idx"), F.when(stop, F.col("stop_lon")).otherwise(F.col("lon")).alias("lon"), F.when(stop, F.col("stop_lat")).otherwise(F.col("lat")).alias("lat"),
            F.when(moving, F.col("u")).alias("u"), F.when(moving, F.col("v")).alias("v"),
        )
        goes, ages = moving & cause.isNull(), going & cause.isNull()
        return state.select(*_put(columns, {
            "lon": F.when(goes, lon).otherwise(F.col("lon")), "lat": F.when(goes, lat).otherwise(F.col("lat")), "t": F.when(ages, F.col("t") - 1).otherwise(F.col("t")), "empty": empty, "fast": fast,
            "stop_cause": cause, "records": F.when(stop | going, F.array_append("records", record)).otherwise(F.col("records")),
        }))

    run = Run(start, F.col("stop_cause").isNotNull())
    # Tables of all cuts are kept here, as each holds the records of its own steps.
    run.keep = True
    run.stretch(list(range(first, last - 1, -1)), 1, meet, step, cut_every, begin)
    whole = seeds.sparkSession.read.schema(run.schema).parquet(run.folder)
    samples = whole.select(key, F.explode("records").alias("r")).select(key, "r.*")
    return samples, run.result().select(key, "stop_cause")
