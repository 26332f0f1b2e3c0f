"""Named dependencies: validation, levels and build order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from deltaweave.sources.shared import written


class BadDependencies(ValueError):
    """Names that repeat, names that nothing defines, or a cycle."""


def edges(deps: DataFrame) -> DataFrame:
    """(name, needs) from (name, depends_on array)."""
    return deps.select("name", F.explode("depends_on").alias("needs"))


def validate(deps: DataFrame) -> DataFrame:
    twice = [r[0] for r in deps.groupBy("name").count().where("count > 1").limit(5).collect()]
    unknown = [r[0] for r in edges(deps).join(deps.select(F.col("name").alias("needs")), "needs", "left_anti").limit(5).collect()]
    if twice or unknown:
        raise BadDependencies(f"repeated: {twice}, unknown: {unknown}")
    return deps


def levels(deps: DataFrame) -> DataFrame:
    """(name, level): 0 for what needs nothing, else one more than the highest need. One join per level."""
    e = edges(deps).persist()
    done = deps.where(F.size("depends_on") == 0).select("name", F.lit(0).cast("long").alias("level"))
    count, level = done.count(), 0
    total = deps.count()
    while count < total:
        level += 1
        ready = e.join(done.select(F.col("name").alias("needs"), F.lit(1).alias("_ok")), "needs", "left")
        ready = ready.groupBy("name").agg(F.count_if(F.col("_ok").isNull()).alias("_open")).where("_open = 0").select("name", F.lit(level).cast("long").alias("level"))
        done = done.unionByName(ready.join(done.select("name"), "name", "left_anti"))
        if level % 8 == 0:
            done = written(done, "levels")
        now = done.count()
        if now == count:
            e.unpersist()
            raise BadDependencies("a cycle")
        count = now
    e.unpersist()
    return done


def find_cycle(edges_of: dict[str, list[str]]) -> list[str] | None:
    """A cycle in a driver-side graph, or None."""
    state: dict[str, int] = {}
    path: list[str] = []
    for root in edges_of:
        stack = [(root, iter(edges_of.get(root, ())))]
        if state.get(root):
            continue
        state[root] = 1
        path.append(root)
        while stack:
            node, rest = stack[-1]
            for child in rest:
                if state.get(child) == 1:
                    return path[path.index(child) :] + [child]
                if not state.get(child):
                    state[child] = 1
                    path.append(child)
                    stack.append((child, iter(edges_of.get(child, ()))))
                    break
            else:
                stack.pop()
                state[path.pop()] = 2
    return None
