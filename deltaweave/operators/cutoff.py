"""Cutoffs: a value goes on only if it differs enough from the last one that went on.

The comparison is with the last value that went on, so for a tolerance it is a fold in order, not a look at the
row before (``operators.ordered``); ``streaming.stateful`` keeps the value as state between batches. Before
the first pass the last value is the zero value. Null values never stop.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Window, functions as F

from deltaweave.operators.ordered import fold

#: (last that went on, new value[, tolerance]) -> true to stop; values are Python's.
Stop = Callable[..., bool]


def _fold(log: DataFrame, keys: list[str], order: str, value: str, uses: list[str], zero: object, stop: Callable[..., bool]) -> DataFrame:
    kind = log.schema[value].dataType.simpleString()

    def step(state: tuple | None, values: tuple) -> tuple[tuple, tuple]:
        held = zero if state is None else state[0]
        goes = held is None or any(v is None for v in values) or not stop(held, *values)
        held = values[0] if goes else held
        return (held,), (held, goes)

    out = fold(log.select(*keys, order, *uses), keys, order, uses, step, f"held {kind}, went_on boolean")
    return out.select(*keys, order, "held", "went_on")


def cutoff(log: DataFrame, keys: list[str], stop: Stop, zero: object = 0, order: str = "seq", value: str = "v") -> DataFrame:
    """Per write: ``held`` (the value downstream sees) and ``went_on``."""
    return _fold(log, keys, order, value, [value], zero, stop)


def cutoff_by_cell(log: DataFrame, keys: list[str], tolerance: str, stop: Stop, zero: object = 0, order: str = "seq", value: str = "v") -> DataFrame:
    """As ``cutoff``, with a tolerance that is a column of the log (a cell joined to it)."""
    return _fold(log, keys, order, value, [value, tolerance], zero, lambda old, new, by: stop(by, old, new))


def within(epsilon: Any) -> Stop:
    """Stops values less than ``epsilon`` from the last."""
    return lambda old, new: abs(new - old) < epsilon


def always(log: DataFrame, zero: object = 0, value: str = "v") -> DataFrame:
    """Nothing goes on: the value stays the zero value."""
    return log.withColumns({"held": F.lit(zero).cast(log.schema[value].dataType), "went_on": F.lit(False)}).drop(value)


def never(log: DataFrame, value: str = "v") -> DataFrame:
    """Everything goes on."""
    return log.withColumns({"held": F.col(value), "went_on": F.lit(True)}).drop(value)


def unchanged(log: DataFrame, keys: list[str], zero: object = 0, order: str = "seq", value: str = "v") -> DataFrame:
    """Equal values stop. Equality is transitive, so the row before is enough; NaN never equals."""
    last = F.lag(value, 1, zero).over(Window.partitionBy(*keys).orderBy(order))
    same = F.col(value).eqNullSafe(last)
    if log.schema[value].dataType.simpleString() in ("double", "float"):
        same = same & ~F.isnan(value)
    return log.withColumns({"held": F.col(value), "went_on": ~same}).drop(value)


class Sentinel:
    """A test on the driver, asked every pass; while it holds, the watched cell is made again."""

    def __init__(self, test: Callable[[], bool], refresh: Callable[[], object]):
        self.test, self.refresh, self.watching = test, refresh, True

    def check(self) -> bool:
        if self.watching and self.test():
            self.refresh()
            return True
        return False

    def unwatch(self) -> None:
        self.watching = False
