"""Slices as array columns: filters, sorts, ends, prefixes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

Test = Callable[[Column], Column]


def keep(array: Column, test: Test) -> Column:
    return F.filter(array, test)


def ascending(a: Column, b: Column) -> Column:
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def descending(a: Column, b: Column) -> Column:
    return ascending(b, a)


def sort(array: Column, order: Callable[[Column, Column], Column] = ascending) -> Column:
    return F.array_sort(array, order)


def first(array: Column, zero: object) -> Column:
    return F.coalesce(F.try_element_at(array, F.lit(1)), F.lit(zero))


def last(array: Column, zero: object) -> Column:
    return F.coalesce(F.try_element_at(array, F.lit(-1)), F.lit(zero))


def take_first(array: Column, n: int) -> Column:
    return F.slice(array, 1, n)


def take_last(array: Column, n: int) -> Column:
    """The last n; a shorter array whole."""
    return F.slice(array, F.greatest(F.size(array) - n + 1, F.lit(1)), n)


def before_first(array: Column, test: Test) -> Column:
    """The part before the first element that passes; elements are sorted so that all later ones pass too."""
    return F.filter(array, lambda x: ~test(x))


def from_first(array: Column, test: Test) -> Column:
    return F.filter(array, test)


def accumulated(df: DataFrame, keys: list[str], order: str, value: str, name: str = "vs") -> DataFrame:
    """Every row with all values of its key so far, in order."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select(*keys, order, F.collect_list(value).over(w).alias(name))


def accumulated_sorted(df: DataFrame, keys: list[str], order: str, value: str, name: str = "vs") -> DataFrame:
    """A key's values sorted, a later one before equal earlier ones."""
    held = F.array_sort(F.collect_list(F.struct(F.col(value).alias("v"), (-F.col(order)).alias("o"))))
    return df.groupBy(*keys).agg(held.alias("_h")).select(*keys, F.transform("_h", lambda x: x["v"]).alias(name), F.transform("_h", lambda x: -x["o"]).alias(f"{name}_order"))


def rolling(df: DataFrame, keys: list[str], order: str, value: str, n: int, name: str = "vs") -> DataFrame:
    """The last n values in order of arrival, once there are n."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(n - 1), Window.currentRow)
    return df.select(*keys, order, F.collect_list(value).over(w).alias(name)).where(F.size(name) == n)
