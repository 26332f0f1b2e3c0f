"""Dynamic plans: a small input is read on the driver and decides which plan is built.

Between two passes this is ordinary planning; inside a running job it is impossible. Frames that a binding made
and no longer uses are released when it switches.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable

from pyspark.sql import DataFrame


class Scope:
    """Frames that belong to one binding; releasing it unpersists them and tells its listeners once."""

    def __init__(self) -> None:
        self.frames: list[DataFrame] = []
        self.valid = True
        self.on_invalidated: list[Callable[[], None]] = []

    def own(self, df: DataFrame) -> DataFrame:
        self.frames.append(df.persist())
        return df

    def release(self) -> None:
        if self.valid:
            self.valid = False
            for df in self.frames:
                df.unpersist()
            for call in self.on_invalidated:
                call()


def read_cell(cell: DataFrame) -> tuple | None:
    """The one row of a cell, or None. More rows are an error."""
    rows = cell.head(2)
    if len(rows) > 1:
        raise ValueError("a cell has one row")
    return tuple(rows[0]) if rows else None


class Bind:
    """A plan built from the values of one or more cells, built again when they change. With several cells the
    builder gets the outer scope, so what it makes outlives a switch."""

    def __init__(self, build: Callable[..., DataFrame | None], *cells: Callable[[], DataFrame], zero: DataFrame | None = None):
        self.build, self.cells, self.zero = build, cells, zero
        self.outer = Scope()
        self.scope: Scope | None = None
        self.key: tuple | None = None
        self.builds = 0
        self.current: DataFrame | None = None

    def value(self) -> DataFrame | None:
        key = tuple(read_cell(c()) for c in self.cells)
        if self.builds == 0 or key != self.key:
            old, self.scope = self.scope, Scope()
            values = [k[0] if k and len(k) == 1 else k for k in key]
            self.current = self.build(self.scope if len(values) == 1 else self.outer, *values)
            self.key, self.builds = key, self.builds + 1
            if old is not None:
                old.release()
        return self.zero if self.current is None else self.current


def bind_if(test: Callable[[], DataFrame], then: Callable[[Scope], DataFrame], otherwise: Callable[[Scope], DataFrame]) -> Bind:
    """Only the chosen branch is planned."""
    return Bind(lambda scope, yes: then(scope) if yes else otherwise(scope), test)


class Cache:
    """Plans by key, to be shared by bindings; purged plans are unpersisted."""

    def __init__(self) -> None:
        self.plans: dict[Hashable, DataFrame] = {}

    def get(self, key: Hashable) -> DataFrame | None:
        return self.plans.get(key)

    def put(self, key: Hashable, plan: DataFrame) -> None:
        self.plans[key] = plan

    def purge(self, key: Hashable) -> None:
        plan = self.plans.pop(key, None)
        if plan is not None:
            plan.unpersist()

    def clear(self) -> None:
        for key in list(self.plans):
            self.purge(key)


def bind_memoized(build: Callable[[object], DataFrame], cell: Callable[[], DataFrame], cache: Cache | None = None) -> Callable[[], DataFrame]:
    """Builds a plan once per value of the cell. A builder that fails is not remembered."""
    cache = Cache() if cache is None else cache

    def value() -> DataFrame:
        key = read_cell(cell())
        plan = cache.get(key)
        if plan is None:
            plan = build(key[0] if key and len(key) == 1 else key)
            cache.put(key, plan)
        return plan

    value.cache = cache
    return value


def join_pointer(pointer: DataFrame, cells: DataFrame, target: str) -> DataFrame:
    """A cell that says which cell to read, read."""
    return pointer.join(cells, target)
