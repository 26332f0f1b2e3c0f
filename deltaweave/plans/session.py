"""A session owns named operators, runs passes over those that are demanded, and reports on them."""

from __future__ import annotations

import logging
import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from deltaweave.operators.aggregates import UnorderedFold
from deltaweave.plans.dependencies import find_cycle
from deltaweave.sources.keyed import Store
from deltaweave.sources.shared import shared_dir

log = logging.getLogger("deltaweave")


class AlreadyRunning(RuntimeError):
    """A pass was started inside a pass."""


class TooDeep(ValueError):
    """The plan is deeper than the session allows."""


class CycleError(ValueError):
    """An operator would need itself."""


class OperatorError(RuntimeError):
    """User code failed; names the operator and keeps the cause."""

    def __init__(self, operator: str, cause: BaseException):
        super().__init__(f"{operator}: {cause}")
        self.operator, self.__cause__ = operator, cause


@dataclass
class Operator:
    """A named plan: ``plan`` gets its inputs' frames and returns a frame. Subclass or construct.

    ``cutoff`` gets the last value that went on and the new one; where it is true, nothing above is made again and
    the last value stays. ``rule`` has ``full`` and ``delta`` (a keyed operator or a fold); with a ``store`` its result
    is kept up from its input's change set, and an empty change set stops the pass as a cutoff does.
    """

    name: str
    plan: Callable[..., DataFrame]
    inputs: list[str] = field(default_factory=list)
    kind: str = "map"
    always: bool = False
    label: str = ""
    metadata: dict = field(default_factory=dict)
    on_update: list[Callable[[DataFrame], None]] = field(default_factory=list)
    on_error: list[Callable[[BaseException], None]] = field(default_factory=list)
    on_aborted: list[Callable[[BaseException], None]] = field(default_factory=list)
    on_necessary: list[Callable[[], None]] = field(default_factory=list)
    on_unnecessary: list[Callable[[], None]] = field(default_factory=list)
    on_invalidated: list[Callable[[], None]] = field(default_factory=list)
    on_input_changed: list[Callable[[str], None]] = field(default_factory=list)
    cutoff: Callable[[DataFrame, DataFrame], bool] | None = None
    rule: object | None = None
    store: Store | None = None
    pending: list[DataFrame] = field(default_factory=list)
    changes: DataFrame | None = None
    stale: bool = True
    value: DataFrame | None = None
    recomputes: int = 0
    total: int = 0
    kept_up: int = 0
    changed: int = 0
    session: Session | None = field(default=None, repr=False, compare=False)


def same_rows(old: DataFrame, new: DataFrame) -> bool:
    """A cutoff for values that are equal as bags of rows: no more than one differing row is looked for."""
    return old.exceptAll(new).isEmpty() and new.exceptAll(old).isEmpty()


class Observer:
    """Demand for an operator and all it needs. ``value`` is that of the last pass; none after ``unobserve``."""

    def __init__(self, session: Session, name: str):
        self.session, self.name, self.handlers, self.live = session, name, [], True

    def on_update(self, call: Callable[[DataFrame], None]) -> None:
        """Called after a pass in which the operator was made again, even to the same value."""
        self.handlers.append(call)

    def value(self) -> DataFrame | None:
        return self.session.operators[self.name].value if self.live else None

    def unobserve(self) -> None:
        self.live = False
        self.session._unobserve(self)


class Session:
    """Registry and pass runner. Passes exclude each other; a write during a pass counts from the next one."""

    def __init__(self, spark: SparkSession, max_height: int = 256, clear_on_error: bool = False, deterministic: bool = False):
        self.spark, self.max_height, self.clear_on_error, self.deterministic = spark, max_height, clear_on_error, deterministic
        self.operators: dict[str, Operator] = {}
        self.observers: list[Observer] = []
        self.on_start: list[Callable[[int], None]] = []
        self.on_end: list[Callable[[int, BaseException | None], None]] = []
        self.version = 0
        self.sentinels: list = []
        self.counters = {"recomputed": 0, "changed": 0}
        self._lock = threading.Lock()
        self._later: list[Callable[[], None]] = []
        self._needed: set[str] = set()
        self.changed_now: list[str] = []
        self._reached: dict[str, int] = {}
        self.id, self.label, self.metadata = uuid.uuid4().hex, "", {}

    # building

    def add(self, op: Operator) -> Operator:
        missing = [i for i in op.inputs if i not in self.operators and i != op.name]
        if missing:
            raise KeyError(f"{op.name} needs {missing}")
        edges = {n: o.inputs for n, o in self.operators.items()} | {op.name: op.inputs}
        if find_cycle(edges):
            raise CycleError(op.name)
        self.operators[op.name] = op
        try:
            if self.height(op.name) > self.max_height:
                raise TooDeep(f"{op.name} has height {self.height(op.name)}, the limit is {self.max_height}")
        except TooDeep:
            del self.operators[op.name]
            raise
        op.session = self
        return op

    def source(self, name: str, make: Callable[[], DataFrame], cutoff: Callable[[DataFrame, DataFrame], bool] | None = None) -> Operator:
        """An input; with ``same_rows`` as cutoff, a write of the value it has is no write."""
        return self.add(Operator(name, lambda: make(), kind="input", cutoff=cutoff))

    def derive(self, name: str, plan: Callable[..., DataFrame], *inputs: str, kind: str = "map", always: bool = False, cutoff: Callable[[DataFrame, DataFrame], bool] | None = None) -> Operator:
        return self.add(Operator(name, plan, list(inputs), kind, always, cutoff=cutoff))

    def keyed(self, name: str, table: DataFrame, key: str, buckets: int | None = None) -> Operator:
        """An input that is a keyed table and takes change sets (``change``)."""
        store = Store(self.spark, f"{shared_dir(self.spark)}/session-{uuid.uuid4().hex}", key, buckets).create(table)
        return self.add(Operator(name, store.table, kind="keyed input", store=store))

    def keep(self, name: str, rule: object, source: str) -> Operator:
        """What ``rule`` makes of a keyed input or result, kept up from its changes: a keyed operator (``full`` of a table
        and ``delta`` of a change set) or a fold (``delta`` is what is to be added)."""
        return self.add(Operator(name, rule.full, [source], kind="fold" if isinstance(rule, UnorderedFold) else "keyed", rule=rule))

    def change(self, name: str, changes: DataFrame) -> None:
        """Give a keyed input a change set (key, kind, old, new); it counts from the next pass on."""
        if self._lock.locked():
            self._later.append(lambda: self.operators[name].pending.append(changes))
        else:
            self.operators[name].pending.append(changes)

    def set(self, name: str, make: Callable[[], DataFrame]) -> None:
        """Replace an input; what needs it is stale. The last write before a pass counts."""

        def write() -> None:
            self.operators[name].plan = lambda: make()
            self.set_stale(name)

        if self._lock.locked():
            self._later.append(write)
        else:
            write()

    def set_stale(self, name: str) -> None:
        self.operators[name].stale = True

    def height(self, name: str) -> int:
        known: dict[str, int] = {}
        for n in self.order([name]):
            known[n] = 1 + max((known[i] for i in self.operators[n].inputs), default=-1)
        return known[name]

    def order(self, names: list[str]) -> list[str]:
        """The operators and all they need, inputs first."""
        out, seen = [], set()
        stack = [(n, False) for n in reversed(names)]
        while stack:
            n, done = stack.pop()
            if done:
                out.append(n)
            elif n not in seen:
                seen.add(n)
                stack.append((n, True))
                stack += [(i, False) for i in reversed(self.operators[n].inputs) if i not in seen]
        return out

    def would_cycle(self, child: str, parent: str) -> bool:
        """Would it make a cycle if ``child`` needed ``parent``?"""
        return child == parent or child in self.order([parent])

    def link(self, child: str, parent: str) -> None:
        """``child`` needs ``parent`` too, as its last input, from the next pass on."""
        if self._lock.locked():
            raise AlreadyRunning("the plan stays as it is during a pass")
        if self.would_cycle(child, parent):
            raise CycleError(f"{child} -> {parent}")
        op = self.operators[child]
        op.inputs.append(parent)
        deep = [n for n in self.operators if child in self.order([n]) and self.height(n) > self.max_height]
        if deep:
            op.inputs.pop()
            raise TooDeep(f"{deep[0]} would be higher than {self.max_height}")
        op.stale = True
        self._demand()

    def unlink(self, child: str, parent: str) -> None:
        """``child`` no longer needs ``parent``."""
        if self._lock.locked():
            raise AlreadyRunning("the plan stays as it is during a pass")
        self.operators[child].inputs.remove(parent)
        self.operators[child].stale = True
        self._demand()

    # demand

    def observe(self, name: str) -> Observer:
        if name not in self.operators:
            raise KeyError(name)
        found = Observer(self, name)
        self.observers.append(found)
        self._demand()
        return found

    def _unobserve(self, observer: Observer) -> None:
        self.observers = [o for o in self.observers if o is not observer]
        self._demand()

    def _demand(self) -> None:
        now = set(self.order([o.name for o in self.observers]))
        for n in now - self._needed:
            for call in self.operators[n].on_necessary:
                call()
        for n in self._needed - now:
            op = self.operators[n]
            if op.value is not None:
                op.value.unpersist()
            op.value, op.stale = None, True
            for call in op.on_unnecessary:
                call()
        self._needed = now

    def invalidate(self, name: str) -> None:
        """Drop an operator and all that need it; the listeners of each hear of it once."""
        gone = {name}
        while more := {n for n, o in self.operators.items() if n not in gone and gone & set(o.inputs)}:
            gone |= more
        self.observers = [o for o in self.observers if o.name not in gone]
        for n in gone:
            op = self.operators.pop(n)
            op.session = None
            self._needed.discard(n)
            for call in op.on_invalidated:
                call()
        self._demand()

    # passes

    def run(self) -> int:
        """One pass: makes every demanded operator that is stale or has an input that changed, inputs first. Where the
        value stays, what is above rests. An error leaves the failed operator and those above it stale, so the next
        pass tries again."""
        self._enter()
        error: BaseException | None = None
        try:
            self._begin()
            for n in self.order([o.name for o in self.observers]):
                self._step(self.operators[n])
        except BaseException as e:
            error = e
            if isinstance(e, OperatorError) and self.clear_on_error:
                for n in self._needed:
                    if self.operators[n].stale:
                        for call in self.operators[n].on_aborted:
                            call(e)
            raise
        finally:
            self._leave(error)
        self._tell()
        return self.version

    def start_pass(self) -> list[str]:
        """Begin a pass that is driven by hand: ``recompute`` what is wanted, then ``end_pass``. The demanded operators,
        inputs first."""
        self._enter()
        try:
            self._begin()
        except BaseException as e:
            self._leave(e)
            raise
        return self.order([o.name for o in self.observers])

    def recompute(self, name: str) -> bool:
        """Make one operator in a pass driven by hand, if it has to be made; whether its value went on."""
        if not self._lock.locked():
            raise RuntimeError("no pass is running")
        op = self.operators[name]
        missing = [i for i in op.inputs if self.operators[i].value is None]
        if missing:
            raise ValueError(f"{name} needs {missing}, which were not made")
        self._step(op)
        return name in self.changed_now

    def end_pass(self, error: BaseException | None = None) -> int:
        """End a pass driven by hand. What was not made again above a changed value is stale; with an error the pass is undone
        as ``run`` does it."""
        if not self._lock.locked():
            raise RuntimeError("no pass is running")
        self._leave(error)
        if error is None:
            self._tell()
        return self.version

    def _enter(self) -> None:
        if not self._lock.acquire(blocking=False):
            raise AlreadyRunning(f"pass {self.version} is running")
        self.changed_now, self._reached = [], {}

    def _begin(self) -> None:
        for call in self.on_start:
            call(self.version)
        for s in self.sentinels:
            s.check()

    def _leave(self, error: BaseException | None) -> None:
        for n in self.changed_now:  # what is above a changed value and was not reached after it is to be made from all of it
            for m, o in self.operators.items():
                if n in o.inputs and self._reached.get(m, -1) < self._reached[n]:
                    o.stale = True
        try:
            for call in self.on_end:
                call(self.version, error)
        finally:
            if error is None:
                self.version += 1
            self._lock.release()
            later, self._later = self._later, []
            for write in later:
                write()

    def _tell(self) -> None:
        for n in sorted(self.changed_now) if self.deterministic else self.changed_now:
            for call in self.operators[n].on_update:
                call(self.operators[n].value)
            for o in self.observers:
                if o.name == n:
                    for call in o.handlers:
                        call(self.operators[n].value)

    def _step(self, op: Operator) -> None:
        """Make one operator, if it has to be made."""
        moved = [i for i in op.inputs if i in self.changed_now]
        op.changes = None
        if not (op.stale or op.always or op.value is None or moved or op.pending):
            self._reached[op.name] = max(self._reached.values(), default=-1) + 1
            return
        for i in moved:
            for call in op.on_input_changed:
                call(i)
        by_changes = op.value is not None and not op.stale and (op.pending if op.kind == "keyed input" else op.rule is not None and all(self.operators[i].changes is not None for i in moved))
        op.stale = True
        try:
            value, changed = self._kept_up(op) if by_changes else self._made(op)
        except Exception as e:
            for call in op.on_error:
                call(e)
            raise OperatorError(op.name, e) from e
        op.stale = False
        self._reached.pop(op.name, None)
        self._reached[op.name] = max(self._reached.values(), default=-1) + 1
        op.recomputes += 1
        op.kept_up += bool(by_changes)
        self.counters["recomputed"] += 1
        log.debug("pass %d made %s", self.version, op.name)
        if changed:
            if op.value is not None and op.value is not value:
                op.value.unpersist()
            op.value = value
            op.changed += 1
            self.counters["changed"] += 1
            if op.name not in self.changed_now:
                self.changed_now.append(op.name)

    def _made(self, op: Operator) -> tuple[DataFrame, bool]:
        """The value from whole inputs, and whether it goes on."""
        for changes in op.pending:
            op.store.apply(changes)
        op.pending = []
        value = op.plan(*(self.operators[i].value for i in op.inputs))
        if op.kind == "keyed":
            op.store = Store(self.spark, f"{shared_dir(self.spark)}/session-{uuid.uuid4().hex}", op.rule.key).create(value)
            value = op.store.table()
        elif op.kind == "fold":
            op.total = value.first()[0]
            value = self._cell(op)
        elif self._consumers(op.name) > 1 and not op.always or op.cutoff is not None:
            value = value.persist()
        if op.cutoff is not None and op.value is not None and op.cutoff(op.value, value):
            value.unpersist()
            return op.value, False
        return value, True

    def _kept_up(self, op: Operator) -> tuple[DataFrame, bool]:
        """The value from change sets alone, and whether anything changed."""
        if op.kind == "keyed input":
            for changes in op.pending:
                op.store.apply(changes)
            op.changes = op.pending[0] if len(op.pending) == 1 else None  # of several the whole table tells
            op.pending = []
            return op.store.table(), True
        changes = op.rule.delta(self.operators[op.inputs[0]].changes)
        if op.kind == "fold":
            more = changes.first()[0]
            op.total += more
            return (self._cell(op), True) if more else (op.value, False)
        changes = changes.persist()
        if changes.isEmpty():
            return op.value, False
        op.store.apply(changes)
        op.changes = changes
        return op.store.table(), True

    def _cell(self, op: Operator) -> DataFrame:
        return self.spark.createDataFrame([(op.total,)], f"{op.rule.name} long")

    def act(self, actions: dict[str, Callable[[DataFrame], object]], parallel: int = 4) -> dict[str, object]:
        """Run an action on each of several observed operators, some at a time, as jobs of their own."""
        with ThreadPoolExecutor(max_workers=parallel) as pool:
            jobs = {n: pool.submit(f, self.operators[n].value) for n, f in actions.items()}
        return {n: j.result() for n, j in jobs.items()}

    def trace(self, write: Callable[[str], None]) -> None:
        """Tell ``write`` of passes and of what they make."""
        self.on_start.append(lambda v: write(f"pass {v} starts"))
        self.on_end.append(lambda v, e: write(f"pass {v} failed: {e}" if e else f"pass {v} ends"))
        for op in self.operators.values():
            op.on_update.append(lambda df, n=op.name: write(f"made {n}"))

    def _consumers(self, name: str) -> int:
        return sum(name in self.operators[n].inputs for n in self._needed)

    # reports

    def status(self) -> dict[str, int]:
        """Counts of operators, observers and passes, and over all passes what was made and what went on."""
        return {"operators": len(self.operators), "needed": len(self._needed), "observers": len(self.observers), "passes": self.version, **self.counters}

    def view(self, name: str) -> dict[str, object]:
        """What the session knows of an operator."""
        op = self.operators[name]
        return {
            "kind": op.kind, "height": self.height(name), "inputs": list(op.inputs), "above": [n for n, o in self.operators.items() if name in o.inputs],
            "needed": name in self._needed, "observers": sum(o.name == name for o in self.observers), "stale": op.stale, "recomputes": op.recomputes, "changed": op.changed, "kept_up": op.kept_up, "value": op.value,
        }

    def check(self) -> list[str]:
        """Problems of the registry; none if all is well."""
        found = [f"{n} needs {i}, which is not there" for n, o in self.operators.items() for i in o.inputs if i not in self.operators]
        cycle = find_cycle({n: o.inputs for n, o in self.operators.items()})
        if cycle:
            found.append("cycle: " + " -> ".join(cycle))
        found += [f"{n} has a value that nothing needs" for n, o in self.operators.items() if o.value is not None and n not in self._needed]
        found += [f"{n} is needed and not there" for n in self._needed if n not in self.operators]
        found += [f"{n} is at height {self.height(n)}, over {self.max_height}" for n, o in self.operators.items() if all(i in self.operators for i in o.inputs) and not cycle and self.height(n) > self.max_height]
        found += [f"{n} went on {o.changed} times and was made {o.recomputes} times" for n, o in self.operators.items() if o.changed > o.recomputes]
        found += [f"{o.name} is observed and not there" for o in self.observers if o.name not in self.operators]
        return found

    def dot(self) -> str:
        """The graph for Graphviz."""
        lines = ["digraph {"]
        for n, o in self.operators.items():
            lines.append(f'  "{n}" [label="{o.label or n}\\n{o.kind}", style={"filled" if n in self._needed else "solid"}];')
            lines += [f'  "{i}" -> "{n}";' for i in o.inputs]
        return "\n".join([*lines, "}"]) + "\n"

    def explain(self, name: str) -> str:
        df = self.operators[name].value
        return "" if df is None else df._jdf.queryExecution().toString()

    def cancel(self) -> None:
        self.spark.sparkContext.cancelAllJobs()
