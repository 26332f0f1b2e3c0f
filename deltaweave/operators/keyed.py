"""Operators on keyed tables. ``full`` makes the result from tables; ``delta`` makes its changes from changes.

Functions on rows get an accessor: ``lambda row: row("v") * 2``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Literal

from pyspark.sql import Column, DataFrame, functions as F

from deltaweave.operators.delta import ADDED, REMOVED, UPDATED, diff, row as row_of

Row = Callable[[str], Column]
RowFunction = Callable[[Row], Column]


def accessor(prefix: str | None, key: str) -> Row:
    return lambda name: F.col(name) if prefix is None or name == key else F.col(f"{prefix}.{name}")


@dataclass(frozen=True)
class MapValues:
    """One output value per key. With ``equal=None`` a key keeps its first value for as long as it is there."""

    key: str
    fn: RowFunction
    name: str = "v"
    equal: Literal["values"] | None = "values"

    def full(self, table: DataFrame) -> DataFrame:
        return table.select(self.key, self.fn(accessor(None, self.key)).alias(self.name))

    def delta(self, changes: DataFrame) -> DataFrame:
        side = lambda s: F.when(F.col(s).isNotNull(), F.struct(self.fn(accessor(s, self.key)).alias(self.name)))
        rows = changes if self.equal else changes.where(F.col("kind") != UPDATED)
        out = rows.select(self.key, "kind", side("old").alias("old"), side("new").alias("new"))
        return out.where((F.col("kind") != UPDATED) | ~F.col("old").eqNullSafe(F.col("new")))


@dataclass(frozen=True)
class FilterMapValues:
    """Map and filter in one: a key is there while ``keep`` holds, and flips in and out with it."""

    key: str
    fn: RowFunction
    keep: RowFunction
    name: str = "v"

    def full(self, table: DataFrame) -> DataFrame:
        r = accessor(None, self.key)
        return table.where(self.keep(r)).select(self.key, self.fn(r).alias(self.name))

    def delta(self, changes: DataFrame) -> DataFrame:
        def side(s: str) -> Column:
            r = accessor(s, self.key)
            return F.when(F.col(s).isNotNull() & F.coalesce(self.keep(r), F.lit(False)), F.struct(self.fn(r).alias(self.name)))

        out = changes.select(self.key, side("old").alias("old"), side("new").alias("new"))
        kind = F.when(F.col("old").isNull() & F.col("new").isNotNull(), ADDED).when(F.col("new").isNull() & F.col("old").isNotNull(), REMOVED)
        kind = kind.when(~F.col("old").eqNullSafe(F.col("new")), UPDATED)
        return out.withColumn("kind", kind).where("kind is not null").select(self.key, "kind", "old", "new")


@dataclass(frozen=True)
class Partition:
    """Two halves by one evaluation of the test: a column ``matching``."""

    key: str
    test: RowFunction

    def full(self, table: DataFrame) -> DataFrame:
        return table.withColumn("matching", F.coalesce(self.test(accessor(None, self.key)), F.lit(False)))

    def halves(self, table: DataFrame) -> tuple[DataFrame, DataFrame]:
        both = self.full(table)
        return both.where("matching").drop("matching"), both.where("not matching").drop("matching")


@dataclass(frozen=True)
class Merge:
    """Full outer merge by key. ``fn`` and ``include`` get (left row, right row, has left, has right)."""

    key: str
    fn: Callable[[Row, Row, Column, Column], Column]
    include: Callable[[Row, Row, Column, Column], Column] = lambda left, right, has_left, has_right: F.lit(True)
    name: str = "v"

    def full(self, left: DataFrame, right: DataFrame) -> DataFrame:
        a = left.select(self.key, row_of(left, self.key).alias("l"))
        b = right.select(self.key, row_of(right, self.key).alias("r"))
        both = a.unionByName(b, allowMissingColumns=True).groupBy(self.key)
        both = both.agg(F.first("l", ignorenulls=True).alias("l"), F.first("r", ignorenulls=True).alias("r"))
        args = accessor("l", self.key), accessor("r", self.key), F.col("l").isNotNull(), F.col("r").isNotNull()
        return both.where(self.include(*args)).select(self.key, self.fn(*args).alias(self.name))

    def delta(self, left: DataFrame, right: DataFrame, left_changes: DataFrame, right_changes: DataFrame, before: DataFrame) -> DataFrame:
        """The result's changes: only keys that changed on either side are merged again. ``before``: the result so far."""
        keys = left_changes.select(self.key).union(right_changes.select(self.key)).distinct()
        now = self.full(left.join(keys, self.key, "left_semi"), right.join(keys, self.key, "left_semi"))
        return diff(before.join(keys, self.key, "left_semi"), now, self.key)


def join_cells(pointers: DataFrame, cells: DataFrame, target: str) -> DataFrame:
    """A map of cells becomes the map of their values: each pointer's target is looked up."""
    return pointers.join(cells, target).drop(target)


def subrange(table: DataFrame, key: str, low: object, high: object) -> DataFrame:
    """Keys from ``low`` to ``high``, both included; bounds are literals, so the scan skips what lies outside."""
    return table.where(F.col(key).between(F.lit(low), F.lit(high)))


def subrange_by_cell(table: DataFrame, key: str, bounds: DataFrame) -> DataFrame:
    """Bounds from a one-row cell (low, high). The cell is read first, so they reach the scan as literals."""
    found = bounds.select("low", "high").head(1)
    return subrange(table, key, *found[0]) if found else table.limit(0)


def subrange_delta(table: DataFrame, changes: DataFrame, key: str, before: tuple[object, object], now: tuple[object, object]) -> DataFrame:
    """Changes of the window: those inside it while its bounds stay; what entered and left when they move."""
    if before == now:
        return subrange(changes, key, *now)
    # the table is the new one: its old window is undone from the changes
    from deltaweave.operators.delta import apply_changes

    back = changes.select(key, F.when(F.col("kind") == ADDED, REMOVED).when(F.col("kind") == REMOVED, ADDED).otherwise(UPDATED).alias("kind"), F.col("new").alias("old"), F.col("old").alias("new"))
    lo, hi = min(before[0], now[0]), max(before[1], now[1])
    near = subrange(table, key, lo, hi)
    old = apply_changes(near, subrange(back, key, lo, hi), key)
    return diff(subrange(old, key, *before), subrange(near, key, *now), key)


def selected_changes(changes: DataFrame, watched: DataFrame, key: str) -> DataFrame:
    """The changes that watchers of single keys have to hear of."""
    return changes.join(watched.select(key).distinct(), key, "left_semi")


def select_keys(table: DataFrame, watched: DataFrame, key: str, zeros: dict[str, object]) -> DataFrame:
    """The watched keys' rows; keys that aren't there show the zero values."""
    joined = watched.select(key).distinct().join(table, key, "left")
    return joined.select(key, *(F.coalesce(F.col(c), F.lit(z)).alias(c) for c, z in zeros.items()))
