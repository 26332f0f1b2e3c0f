"""Derived cells: one-row frames, or columns over passes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def map_cells(fn: Callable[..., Column], *cells: tuple[DataFrame, str], name: str = "v") -> DataFrame:
    """A value from any number of one-row cells (frame, column); one row. A cell of several rows is an error when it is
    read: each is folded to its one row, so nothing is multiplied."""
    one = lambda c, v: F.when(F.count("*") > 1, F.raise_error(F.lit("a cell has one row"))).otherwise(F.first(v))
    renamed = [c.agg(F.count("*").alias("_n"), one(c, v).alias(f"_c{i}")).where("_n = 1").drop("_n") for i, (c, v) in enumerate(cells)]
    joined = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), renamed)  # at most one row each, by their aggregates
    return joined.select(fn(*(F.col(f"_c{i}") for i in range(len(renamed)))).alias(name))


def map_keyed(fn: Callable[..., Column], key: str, *tables: tuple[DataFrame, str], name: str = "v") -> DataFrame:
    """A value per key from several keyed tables, for keys that all have."""
    renamed = [t.select(key, F.col(v).alias(f"_c{i}")) for i, (t, v) in enumerate(tables)]
    joined = reduce(lambda a, b: a.join(b, key), renamed)
    return joined.select(key, fn(*(F.col(f"_c{i}") for i in range(len(renamed)))).alias(name))


class MapN:
    """A value from a list of cells in order, to which cells can be added and from which they can go."""

    def __init__(self, fn: Callable[[Column], Column], *inputs: tuple[str, DataFrame, str]):
        self.fn, self.inputs = fn, list(inputs)

    def add_input(self, name: str, cell: DataFrame, column: str) -> None:
        self.inputs.append((name, cell, column))

    def remove_input(self, name: str) -> None:
        """An unknown name changes nothing."""
        self.inputs = [x for x in self.inputs if x[0] != name]

    def values(self) -> DataFrame:
        """All values in order of input, as one array; an empty one without inputs."""
        if not self.inputs:
            return SparkSession.active().range(1).select(F.array().alias("vs"))
        parts = [cell.select(F.lit(i).alias("_i"), F.col(c).alias("_v")) for i, (_, cell, c) in enumerate(self.inputs)]
        united = reduce(lambda a, b: a.union(b), parts)
        return united.agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda x: x["_v"]).alias("vs"))

    def value(self, name: str = "v") -> DataFrame:
        return self.values().select(self.fn(F.col("vs")).alias(name))


def map_if(test: Column, a: Column, b: Column) -> Column:
    return F.when(test, a).otherwise(b)


def depend_on(cell: DataFrame, dependency: DataFrame) -> DataFrame:
    """The cell's value, made again when the dependency changes; the dependency's columns don't show."""
    return cell.join(F.broadcast(dependency.select(F.lit(True).alias("_there")).limit(1)), F.col("_there"), "left").drop("_there")


def freeze(log: DataFrame, keys: list[str], order: str = "seq", value: str = "v") -> DataFrame:
    """Each key's first value."""
    return log.groupBy(*keys).agg(F.min_by(value, order).alias(value))


def with_last(log: DataFrame, keys: list[str], zero: object, order: str = "seq", value: str = "v") -> DataFrame:
    """Each value with the one before; the first has the zero value before it."""
    return log.withColumn("prev", F.lag(value, 1, zero).over(Window.partitionBy(*keys).orderBy(order)))


def history(log: DataFrame, keys: list[str], order: str = "seq", value: str = "v", after: int | None = None) -> DataFrame:
    """All values a watcher has seen, in order; since a reset, if one is given."""
    rows = log if after is None else log.where(F.col(order) > after)
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("vs"))
