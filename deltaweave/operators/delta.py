"""Change sets between two versions of a keyed table, and their application.

A change row is (key, kind, old, new): ``old`` and ``new`` are structs of the other columns, so a null value
and an absent row differ. Both tables are tagged, united and grouped by key: one shuffle, and a filter on the
key reaches both scans, which it would not through a full outer join.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Literal

from pyspark.sql import Column, DataFrame, functions as F

ADDED, REMOVED, UPDATED = "added", "removed", "updated"
Equal = Callable[[Column, Column], Column] | Literal["values"] | None


def row(df: DataFrame, key: str) -> Column:
    return F.struct(*(F.col(f"`{c}`") for c in df.columns if c != key))


def sides(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, old, new): both versions' rows of each key."""
    a = old.select(key, row(old, key).alias("_row"), F.lit(0).alias("_side"))
    b = new.select(key, row(new, key).alias("_row"), F.lit(1).alias("_side"))
    pick = lambda s: F.first(F.when(F.col("_side") == s, F.col("_row")), ignorenulls=True)
    return a.union(b).groupBy(key).agg(pick(0).alias("old"), pick(1).alias("new"))


def diff(old: DataFrame, new: DataFrame, key: str, equal: Equal = "values") -> DataFrame:
    """The changes from ``old`` to ``new``. ``equal``: "values" compares rows; a function of the two structs decides
    otherwise; None sees keys alone, so rows rebound under their key are no change."""
    both = sides(old, new, key)
    kind = F.when(F.col("old").isNull(), ADDED).when(F.col("new").isNull(), REMOVED)
    if equal is not None:
        same = F.col("old").eqNullSafe(F.col("new")) if equal == "values" else F.coalesce(equal(F.col("old"), F.col("new")), F.lit(False))
        kind = kind.when(~same, UPDATED)
    return both.withColumn("kind", kind).where("kind is not null").select(key, "kind", "old", "new")


def apply_changes(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table after the changes; one shuffle of both."""
    names = [c for c in table.columns if c != key]
    a = table.select(key, row(table, key).alias("_row"), F.lit(None).cast("string").alias("_kind"))
    b = changes.select(key, F.col("new").alias("_row"), F.col("kind").alias("_kind"))
    b = b.select(key, F.struct(*(F.col(f"_row.{c}").cast(table.schema[c].dataType).alias(c) for c in names)).alias("_row"), "_kind")
    kind = F.max("_kind")
    fresh = F.first(F.when(F.col("_kind").isNotNull(), F.col("_row")), ignorenulls=True)
    held = F.first(F.when(F.col("_kind").isNull(), F.col("_row")), ignorenulls=True)
    merged = a.union(b).groupBy(key).agg(kind.alias("_k"), fresh.alias("_f"), held.alias("_h"))
    merged = merged.where(F.col("_k").isNull() | (F.col("_k") != REMOVED)).withColumn("_r", F.when(F.col("_k").isNull(), F.col("_h")).otherwise(F.col("_f")))
    return merged.select(*(F.col(key) if c == key else F.col(f"_r.{c}").alias(c) for c in table.columns))


def added(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new keys."""
    return new.join(old.select(key), key, "left_anti")


def removed(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of keys that are gone, with their old values."""
    return old.join(new.select(key), key, "left_anti")


def by_kind(changes: DataFrame) -> DataFrame:
    """How many changes of each kind."""
    return changes.groupBy("kind").agg(F.count("*").alias("n"))
