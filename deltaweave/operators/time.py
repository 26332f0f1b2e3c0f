"""An explicit clock: ticks are rows (tick). Nothing reads the wall clock."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from deltaweave.operators.ordered import fold


class Clock:
    """A clock that moves when it is told to, and never back."""

    def __init__(self, start: datetime):
        self.start = self.now = start

    def advance(self, to: datetime) -> datetime:
        self.now = max(self.now, to)
        return self.now

    def cell(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.now,)], "tick timestamp_ntz")


def monotone(ticks: DataFrame, keys: list[str], order: str, tick: str = "tick") -> DataFrame:
    """The clock after each advance: the greatest tick so far, per clock."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ticks.withColumn("now", F.max(tick).over(w))


def at(tick: Column, when: Column) -> Column:
    """True from ``when`` on."""
    return tick >= when


def micros(tick: Column) -> Column:
    return F.unix_micros(tick.cast("timestamp"))


def at_intervals(tick: Column, start: Column, every_seconds: int) -> Column:
    """Whole intervals since the start; skipped ones count."""
    if every_seconds <= 0:
        raise ValueError("the interval has to be positive")
    past, every = micros(tick) - micros(start), every_seconds * 1_000_000
    return ((past - F.pmod(past, F.lit(every))) / every).cast("long")


def snapshot(passes: DataFrame, keys: list[str], when: Column, before: object, order: str = "version", tick: str = "tick", value: str = "v") -> DataFrame:
    """Per pass: ``before`` until the first pass at or after ``when``, then that pass's value for good."""
    taken = F.min_by(F.when(F.col(tick) >= when, F.struct(value)), F.when(F.col(tick) >= when, F.col(order)))
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = taken.over(w)
    return passes.withColumn("taken", held.isNotNull()).withColumn("snapshot", F.coalesce(held[value], F.lit(before)))


def step_function(ticks: DataFrame, steps: list[tuple[datetime, int]], initial: object, tick: str = "tick") -> DataFrame:
    """The value of the last step at or before each tick; of steps at one time the later in the list. Steps are few,
    so they are one literal array and the ticks need no join."""
    ordered = sorted(((a, i, v) for i, (a, v) in enumerate(steps)), key=lambda x: x[:2])
    if not ordered:
        return ticks.withColumn("step", F.lit(initial))
    out = F.lit(initial)
    for when, _, v in ordered:
        out = F.when(F.col(tick) >= F.lit(when).cast("timestamp_ntz"), F.lit(v)).otherwise(out)
    return ticks.withColumn("step", out)


def step_table(ticks: DataFrame, steps: DataFrame, initial: object, tick: str = "tick") -> DataFrame:
    """As ``step_function`` for schedules of any length (at, ord, value): both sides are put in one order by key
    ``k`` and the last step so far is carried forward. One shuffle."""
    a = ticks.select("k", F.col(tick).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("ord"), F.struct(*ticks.columns).alias("_row"), F.lit(None).cast(steps.schema["value"].dataType).alias("value"))
    b = steps.select("k", F.col("at").alias("_t"), F.lit(0).alias("_side"), "ord", F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), "value")
    w = Window.partitionBy("k").orderBy("_t", "_side", "ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = F.last(F.when(F.col("_side") == 0, F.struct("value")), ignorenulls=True).over(w)
    return a.unionByName(b).withColumn("_held", held).where("_side = 1").select("_row.*", F.coalesce(F.col("_held.value"), F.lit(initial)).alias("step"))


def throttle(log: DataFrame, keys: list[str], every_seconds: int, order: str = "seq", tick: str = "ts") -> DataFrame:
    """Which rows a timer lets through: the first, then each at least the interval after the last let through. The
    timer drifts with its fires, so it is a fold in order and no grid of windows."""
    every = every_seconds * 1_000_000

    def step(last: int | None, values: tuple) -> tuple[int | None, tuple]:
        t = values[0]
        fires = t is not None and (last is None or t - last >= every)
        return (t if fires else last), (fires,)

    rows = log.select(*keys, order, micros(F.col(tick)).alias("_t"))
    return fold(rows, keys, order, ["_t"], step, "fired boolean").drop("_t")


def staleness(beats: DataFrame, ticks: DataFrame, key: str, most_seconds: int, beat: str = "ts", tick: str = "tick", most_ticks: int = 1_000_000) -> DataFrame:
    """Per feed and tick: is the last beat less than ``most_seconds`` old? The result has a row for each of both. The
    ticks, at most ``most_ticks``, go to every feed, and both are put in one order per feed; no range join."""
    feeds = beats.select(key).distinct()
    grid = ticks.select(tick).distinct()
    if len(grid.limit(most_ticks + 1).select(F.lit(1)).offset(most_ticks).take(1)):
        raise ValueError(f"more than {most_ticks} ticks")
    grid = feeds.crossJoin(F.broadcast(grid))  # the result itself, from a grid of checked size
    a = beats.select(key, F.col(beat).alias("_t"), F.lit(0).alias("_side"))
    b = grid.select(key, F.col(tick).alias("_t"), F.lit(1).alias("_side"))
    w = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.max(F.when(F.col("_side") == 0, F.col("_t"))).over(w)
    rows = a.union(b).withColumn("_last", last).where("_side = 1")
    age = micros(F.col("_t")) - micros(F.col("_last"))
    return rows.select(key, F.col("_t").alias(tick), F.coalesce(age < most_seconds * 1_000_000, F.lit(False)).alias("healthy"))
