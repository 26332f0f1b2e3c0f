"""Input cells as append-only logs (k, version, seq, v): a pass is a version, writes in a pass have a place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

Equal = Callable[[Column, Column], Column]


def latest_per_pass(log: DataFrame, keys: list[str], version: str = "version", seq: str = "seq", value: str = "v") -> DataFrame:
    """Several writes in one pass leave the last one. One partial aggregation, no sort."""
    return log.groupBy(*keys, version).agg(F.max_by(value, seq).alias(value))


def as_of(log: DataFrame, version: int, keys: list[str], value: str = "v") -> DataFrame:
    """The cells' values at the end of a pass; the filter reaches the scan."""
    return log.where(F.col("version") <= version).groupBy(*keys).agg(F.max_by(value, F.struct("version", "seq")).alias(value))


def states_over_passes(log: DataFrame, versions: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """Each cell's value at every pass of ``versions`` (version) since its first write, carried forward.

    Runs are built from the writes (each holds until the next), so the join is one row per cell and pass and never
    all earlier writes.
    """
    last = versions.agg(F.max("version").alias("_end"))
    runs = latest_per_pass(log, keys, value=value)
    following = F.lead("version").over(Window.partitionBy(*keys).orderBy("version"))
    runs = runs.withColumn("_next", following).crossJoin(F.broadcast(last)).withColumn("_until", F.coalesce(F.col("_next") - 1, F.col("_end")))
    spread = runs.where("_until >= version").select(*keys, value, F.explode(F.sequence("version", "_until")).alias("version"))
    return spread.join(versions.select("version").distinct(), "version", "left_semi")


def totals_over_passes(log: DataFrame, keys: list[str], value: str = "v", total: str = "total", count: str = "n") -> DataFrame:
    """The sum over all cells of their values at every pass of the log, and the number of cells that have one.

    Every write changes the sum by its difference to the cell's value before, so passes are summed by themselves and
    the sums run on: rows are cells' writes and then passes, never cells times passes.
    """
    last = latest_per_pass(log, keys, value=value)
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy("version"))
    moved = last.withColumn("_before", before).groupBy("version")
    per = moved.agg(F.sum(F.col(value) - F.coalesce("_before", F.lit(0))).alias("_moved"), F.count_if(F.col("_before").isNull()).alias("_new"))
    running = Window.orderBy("version").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row a pass
    return per.select("version", F.sum("_moved").over(running).alias(total), F.sum("_new").over(running).alias(count))


def read_as_of(states: DataFrame, pointers: DataFrame, key: str, target: str, value: str = "v") -> DataFrame:
    """For each pointer (version, ``target``) the value that the cell it points to has at that pass; pointers to cells
    without one are left out. Writes and pointers are put in one order per cell; no join."""
    kind = states.schema[value].dataType
    writes = states.select(F.col(key).alias(target), "version", F.lit(0).alias("_side"), F.struct(value).alias("_w"))
    asks = pointers.select(F.col(target).cast(states.schema[key].dataType).alias(target), "version", F.lit(1).alias("_side"), F.lit(None).cast(f"struct<{value}:{kind.simpleString()}>").alias("_w"))
    w = Window.partitionBy(target).orderBy("version", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = writes.union(asks).withColumn("_held", F.last("_w", ignorenulls=True).over(w))
    return held.where("_side = 1 and _held is not null").select("version", target, F.col(f"_held.{value}").alias(value))


def drop_unchanged(log: DataFrame, keys: list[str], order: str = "seq", value: str = "v", equal: Equal | None = None) -> DataFrame:
    """Writes of the value a cell already holds are no writes. ``equal`` has to be an equivalence; see
    ``operators.cutoff`` for tests that aren't."""
    before = F.lag(F.struct(value)).over(Window.partitionBy(*keys).orderBy(order))
    same = (lambda a, b: a.eqNullSafe(b)) if equal is None else equal
    marked = log.withColumn("_before", before)
    return marked.where(F.col("_before").isNull() | ~F.coalesce(same(F.col(f"_before.{value}"), F.col(value)), F.lit(False))).drop("_before")


def compose_updates(log: DataFrame, keys: list[str], initial: Column, step: Callable[[Column, Column], Column], order: str = "seq", value: str = "v") -> DataFrame:
    """Updates that depend on the value before them, applied in order; a key's log is one array."""
    writes = F.array_sort(F.collect_list(F.struct(order, value)))
    return log.groupBy(*keys).agg(writes.alias("_w")).select(*keys, F.aggregate("_w", initial, lambda acc, w: step(acc, w[value])).alias(value))


def constant(spark: SparkSession, value: object, name: str = "v") -> DataFrame:
    """A cell that never changes."""
    return spark.range(1).select(F.lit(value).alias(name))


class Func:
    """A cell filled by calling a driver function once; called again only after ``set_stale``."""

    def __init__(self, call: Callable[[], DataFrame]):
        self.call, self.calls, self._held = call, 0, None

    def value(self) -> DataFrame:
        if self._held is None:
            self._held = self.call().persist()
            self.calls += 1
        return self._held

    def set_stale(self) -> None:
        if self._held is not None:
            self._held.unpersist()
            self._held = None
