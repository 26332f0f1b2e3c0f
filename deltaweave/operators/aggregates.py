"""Folds over keyed tables: with an inverse, kept up from signed changes; without, from partial results per bucket."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from deltaweave.operators.delta import ADDED, REMOVED
from deltaweave.operators.keyed import Row, RowFunction, accessor


@dataclass(frozen=True)
class UnorderedFold:
    """A fold with an inverse: ``amount`` of a row is added with it and taken off with it (sums, counts)."""

    key: str
    amount: RowFunction
    name: str = "total"

    def full(self, table: DataFrame) -> DataFrame:
        return table.agg(F.coalesce(F.sum(self.amount(accessor(None, self.key))), F.lit(0)).cast("long").alias(self.name))

    def delta(self, changes: DataFrame) -> DataFrame:
        """What a change set adds to the fold; work follows the changes alone."""
        side = lambda s: F.when(F.col(s).isNotNull(), self.amount(accessor(s, self.key))).otherwise(0)
        return changes.agg(F.coalesce(F.sum(side("new") - side("old")), F.lit(0)).cast("long").alias(self.name))


def total(key: str, column: str = "v", name: str = "total") -> UnorderedFold:
    """Sum of a column; 0 for an empty table."""
    return UnorderedFold(key, lambda r: r(column), name)


def cardinality(key: str, name: str = "n") -> UnorderedFold:
    """Number of entries; rows rebound under their key don't matter."""
    return UnorderedFold(key, lambda r: F.lit(1), name)


def count_where(key: str, test: RowFunction, name: str = "n") -> UnorderedFold:
    """Number of entries for which a test holds."""
    return UnorderedFold(key, lambda r: F.coalesce(test(r), F.lit(False)).cast("long"), name)


@dataclass(frozen=True)
class Reduce:
    """A fold without inverse (greatest, least, joined in key order), kept as one partial result per key bucket.

    ``partial`` makes a bucket's value from its rows, ``combine`` the whole from (bucket, part) rows. A pass makes
    the partials of dirty buckets again and leaves the others.
    """

    key: str
    partial: Callable[[Row], Column]
    combine: Callable[[Column, Column], Column]
    buckets: int = 64
    name: str = "v"

    def bucket(self) -> Column:
        return F.pmod(F.hash(self.key), F.lit(self.buckets))

    def partials(self, table: DataFrame) -> DataFrame:
        return table.groupBy(self.bucket().alias("bucket")).agg(self.partial(accessor(None, self.key)).alias("part"))

    def refreshed(self, partials: DataFrame, table: DataFrame, changes: DataFrame) -> DataFrame:
        dirty = changes.select(self.bucket().alias("bucket")).distinct()
        fresh = self.partials(table.withColumn("bucket", self.bucket()).join(dirty, "bucket", "left_semi").drop("bucket"))
        return partials.join(dirty, "bucket", "left_anti").unionByName(fresh)

    def full(self, partials: DataFrame) -> DataFrame:
        return partials.agg(self.combine(F.col("bucket"), F.col("part")).alias(self.name))


def extremes(table: DataFrame, column: str = "v") -> DataFrame:
    """Greatest and least value; nulls for an empty table."""
    return table.agg(F.max(column).alias("max_v"), F.min(column).alias("min_v"))


def ordered_concat(table: DataFrame, order: str, column: str, separator: str = "") -> DataFrame:
    """An associative, order-preserving reduction: strings joined in key order."""
    parts = F.array_sort(F.collect_list(F.struct(order, column)))
    return table.agg(F.array_join(F.transform(parts, lambda x: x[column]), separator).alias("joined"))


def array_fold(df: DataFrame, keys: list[str], order: str, value: str, initial: Column, step: Callable[[Column, Column], Column], name: str = "v") -> DataFrame:
    """Left fold in order; each group's values are one array."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value])
    return df.groupBy(*keys).agg(items.alias("_a")).select(*keys, F.aggregate("_a", initial, step).alias(name))


def reduce_balanced(array: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Associative reduction of an array; null for an empty one, the element itself for one of one."""
    head = F.try_element_at(array, F.lit(1))
    return F.when(F.size(array) > 0, F.aggregate(F.slice(array, 2, F.greatest(F.size(array) - 1, F.lit(0))), head, step))


def for_all(test: Column) -> Column:
    """True for no rows."""
    return F.coalesce(F.bool_and(test), F.lit(True))


def exists(test: Column) -> Column:
    """False for no rows."""
    return F.coalesce(F.bool_or(test), F.lit(False))


def grouped_counts(changes: DataFrame, group: RowFunction, key: str, name: str = "g") -> DataFrame:
    """Per group, entries that a change set brings less those that it takes."""
    new = changes.where(F.col("kind") != REMOVED).select(group(accessor("new", key)).alias(name), F.lit(1).alias("_d"))
    old = changes.where(F.col("kind") != ADDED).select(group(accessor("old", key)).alias(name), F.lit(-1).alias("_d"))
    return new.union(old).groupBy(name).agg(F.sum("_d").alias("n")).where("n <> 0")
