"""Operators with state per key, on arbitrary-state streaming.

State is a few values per key; rows of a key within a batch are handled in their order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Handler = Callable[[tuple, pd.DataFrame, GroupState], Iterator[pd.DataFrame]]


def _run(stream: DataFrame, keys: list[str], handler: Handler, output: str, state: str) -> DataFrame:
    return stream.groupBy(*keys).applyInPandasWithState(handler, output, state, "append", GroupStateTimeout.NoTimeout)


def cutoff(stream: DataFrame, keys: list[tuple[str, str]], stop: Callable[[Any, Any], bool], zero: int = 0, order: str = "seq", value: str = "v") -> DataFrame:
    """Rows (keys, order, held) that go on: ``stop`` compares with the last value that went on."""

    def handle(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else zero
        rows = pd.concat(frames).sort_values(order)
        out = []
        for o, v in zip(rows[order].tolist(), rows[value].tolist()):
            if not stop(held, v):
                held = v
                out.append((*key, o, v))
        state.update((held,))
        yield pd.DataFrame(out, columns=[*(k for k, _ in keys), order, "held"])

    names = [k for k, _ in keys]
    schema = ", ".join(f"{k} {t}" for k, t in keys) + f", {order} long, held long"
    return _run(stream, names, handle, schema, "held long")


def freeze(stream: DataFrame, keys: list[tuple[str, str]], order: str = "seq", value: str = "v") -> DataFrame:
    """Each key's first value, once."""

    def handle(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(frames).sort_values(order)
        if not state.exists:
            first = rows.iloc[0]
            state.update((int(first[value]),))
            yield pd.DataFrame([(*key, int(first[order]), int(first[value]))], columns=[*(k for k, _ in keys), order, value])

    schema = ", ".join(f"{k} {t}" for k, t in keys) + f", {order} long, {value} long"
    return _run(stream, [k for k, _ in keys], handle, schema, "held long")


def throttle(stream: DataFrame, keys: list[tuple[str, str]], every_micros: int, order: str = "seq", micros: str = "t") -> DataFrame:
    """Rows that a timer per key lets through; ``micros``: the row's time."""

    def handle(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(frames).sort_values(order)
        out = []
        for o, t in zip(rows[order].tolist(), rows[micros].tolist()):
            if last is None or t - last >= every_micros:
                last = t
                out.append((*key, o))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=[*(k for k, _ in keys), order])

    schema = ", ".join(f"{k} {t}" for k, t in keys) + f", {order} long"
    return _run(stream, [k for k, _ in keys], handle, schema, "last long")
