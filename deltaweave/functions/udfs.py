"""Python functions as columns, aggregates and table functions, for what built-in functions can't say.

Values cross to Python in Arrow batches. An error names the function and the value that it failed on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.udtf import UserDefinedTableFunction


class FunctionError(RuntimeError):
    """A user's function failed on a value."""


def scalar(fn: Callable[..., Any], kind: str) -> Callable[..., Column]:
    """A function of values; a null argument is handed on as None."""
    name = getattr(fn, "__name__", "function")

    def run(*args: pd.Series) -> pd.Series:
        out = []
        for row in zip(*(a.astype(object).where(a.notna(), None) for a in args)):
            try:
                out.append(fn(*row))
            except Exception as e:
                raise FunctionError(f"{name}{row!r}: {e}") from e
        return pd.Series(out, index=args[0].index, dtype=object)

    return F.pandas_udf(_series(run, fn.__code__.co_argcount), kind)


def _series(run: Callable[..., pd.Series], n: int) -> Callable[..., pd.Series]:
    """``run`` with as many annotated arguments as ``pandas_udf`` has to see."""
    if n == 1:

        def one(a: pd.Series) -> pd.Series:
            return run(a)

        return one
    if n == 2:

        def two(a: pd.Series, b: pd.Series) -> pd.Series:
            return run(a, b)

        return two

    def more(*args: pd.Series) -> pd.Series:
        return run(*args)

    return more


def aggregate(project: Callable[[Any], Any], combine: Callable[[Any, Any], Any], kind: str) -> Callable[[Column], Column]:
    """A fold without inverse over a group: ``combine`` never sees an empty group, whose result is null. A group's
    values meet in one task; use ``operators.aggregates.Reduce`` where partial results can be kept."""

    def fold(values: pd.Series) -> float:
        out = None
        for k, v in enumerate(values):
            out = project(v) if k == 0 else combine(out, project(v))
        return out

    return F.pandas_udf(fold, kind)


def table(fn: Callable[..., Iterable[tuple]], schema: str) -> UserDefinedTableFunction:
    """A function that makes rows from a row's values; use it in a lateral join."""

    class Rows:
        def eval(self, *args: Any):  # noqa: ANN202
            yield from fn(*args)

    return F.udtf(Rows, returnType=schema)
