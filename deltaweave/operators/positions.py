"""Places in key order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def nth(table: DataFrame, key: str, i: int, parts: int = 1024) -> DataFrame:
    """The i-th entry in key order, from 0; none if there is none. For a small i, tasks keep i + 1 rows. Beyond ``parts``
    the keys are counted in ranges between approximate quantiles, and only the one range that holds the entry is
    sorted."""
    if i < parts:
        return table.orderBy(key).offset(i).limit(1)
    edges = sorted(set(table.agg(F.percentile_approx(key, [k / parts for k in range(1, parts)], 10 * parts)).first()[0] or []))
    if not edges:
        return table.limit(0)
    kind = table.schema[key].dataType
    part = F.aggregate(F.lit(edges).cast(f"array<{kind.simpleString()}>"), F.lit(0), lambda n, edge: n + (F.col(key) >= edge).cast("int"))
    before = 0
    for n, count in sorted(tuple(x) for x in table.groupBy(part.alias("_p")).count().collect()):  # one row a range
        if i < before + count:
            inside = table
            if n > 0:
                inside = inside.where(F.col(key) >= F.lit(edges[n - 1]))
            if n < len(edges):
                inside = inside.where(F.col(key) < F.lit(edges[n]))
            return inside.orderBy(key).offset(i - before).limit(1)
        before += count
    return table.limit(0)


def rank(table: DataFrame, key: str, value: object) -> DataFrame:
    """How many keys are less, and whether the key is there; no sort."""
    return table.agg(F.count_if(F.col(key) < F.lit(value)).alias("rank"), F.coalesce(F.max(F.col(key) == F.lit(value)), F.lit(False)).alias("present"))


def ends(table: DataFrame, key: str, value: str = "v") -> DataFrame:
    """Least and greatest key with their values."""
    return table.agg(F.min(key).alias("min_k"), F.min_by(value, key).alias("min_v"), F.max(key).alias("max_k"), F.max_by(value, key).alias("max_v"))


def top(table: DataFrame, order: list, n: int) -> DataFrame:
    """The first n rows; tasks send n rows each."""
    return table.orderBy(*order).limit(n)


def in_range(table: DataFrame, key: str, low: object, high: object) -> DataFrame:
    """Ordered scan of an inclusive key range."""
    return table.where(F.col(key).between(F.lit(low), F.lit(high))).orderBy(key)


def keys(table: DataFrame, key: str) -> DataFrame:
    """All keys as one sorted array."""
    return table.agg(F.array_sort(F.collect_list(key)).alias("ks"))
