"""Change sets: kept-up results equal results made from scratch, and work follows the changes."""

import random

import pytest
from pyspark.sql import functions as F

from deltaweave.operators import aggregates as agg, delta, keyed
from deltaweave.sources import keyed as store

SCHEMA = "k long, v long"


def frame(spark, table):
    return spark.createDataFrame(sorted(table.items()), SCHEMA)


def rows(df):
    return sorted(map(tuple, df.collect()))


def edit(table, r):
    new = dict(table)
    for _ in range(r.randint(1, 12)):
        k = r.randrange(40)
        if r.random() < 0.3:
            new.pop(k, None)
        else:
            new[k] = r.randrange(100)
    return new


@pytest.mark.parametrize("seed", range(4))
def test_maintained_equals_recomputed(spark, seed):
    r = random.Random(seed)
    table = {k: r.randrange(100) for k in range(0, 40, 2)}
    double = keyed.MapValues("k", lambda x: x("v") * 2)
    even = keyed.FilterMapValues("k", lambda x: x("v") + 1, lambda x: x("v") % 2 == 0)
    total = agg.total("k")
    top = agg.Reduce("k", lambda x: F.max(x("v")), lambda b, p: F.max(p), buckets=4)
    doubled, evens = double.full(frame(spark, table)), even.full(frame(spark, table))
    summed = total.full(frame(spark, table)).first()[0]
    partials = top.partials(frame(spark, table))
    for _ in range(3):
        new = edit(table, r)
        old_df, new_df = frame(spark, table), frame(spark, new)
        changes = delta.diff(old_df, new_df, "k").persist()
        expected = {k: v for k, v in new.items() if table.get(k) != v} | {k: None for k in table if k not in new}
        assert {x.k for x in changes.collect()} == set(expected)
        assert rows(delta.apply_changes(old_df, changes, "k")) == sorted(new.items())
        doubled = delta.apply_changes(doubled, double.delta(changes), "k").persist()
        evens = delta.apply_changes(evens, even.delta(changes), "k").persist()
        summed += total.delta(changes).first()[0]
        partials = top.refreshed(partials, new_df, changes).persist()
        assert rows(doubled) == rows(double.full(new_df))
        assert rows(evens) == rows(even.full(new_df))
        assert summed == sum(new.values())
        assert top.full(partials).first()[0] == max(new.values(), default=None)
        table = new


def test_diff_policies(spark):
    a = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "k string, v int")
    b = spark.createDataFrame([("a", 99), ("c", None), ("d", None)], "k string, v int")
    kinds = {r.k: r.kind for r in delta.diff(a, b, "k").collect()}
    assert kinds == {"a": "updated", "b": "removed", "d": "added"}
    assert {r.k for r in delta.diff(a, b, "k", equal=None).collect()} == {"b", "d"}
    assert {r.k for r in delta.diff(a, b, "k", lambda x, y: F.lit(True)).collect()} == {"b", "d"}


def test_filter_on_the_key_reaches_both_scans(spark, data):
    from deltaweave.sources import tables

    changes = delta.diff(tables.book(spark, data, 0), tables.book(spark, data, 0), "k").where("k between 5 and 9")
    plan = changes._jdf.queryExecution().executedPlan().toString()
    assert plan.count("GreaterThanOrEqual(o_orderkey,5)") == 2


def test_merge_follows_either_side(spark):
    op = keyed.Merge("k", lambda l, r, a, b: F.coalesce(l("v"), F.lit(0)) + F.coalesce(r("v"), F.lit(0)), lambda l, r, a, b: a & b)
    left, right = {1: 1, 2: 10}, {3: 2, 2: 20}
    assert rows(op.full(frame(spark, left), frame(spark, right))) == [(2, 30)]
    new = {1: 1, 2: 100}
    changes = delta.diff(frame(spark, left), frame(spark, new), "k")
    none = delta.diff(frame(spark, right), frame(spark, right), "k")
    before = op.full(frame(spark, left), frame(spark, right))
    moved = op.delta(frame(spark, new), frame(spark, right), changes, none, before)
    assert [(r.k, r.kind, r.new.v) for r in moved.collect()] == [(2, "updated", 120)]


def test_store_takes_changes_and_rewrites_touched_buckets_alone(spark, tmp_path):
    table = {k: k for k in range(200)}
    at = f"file://{tmp_path}/s"
    s = store.Store(spark, at, "k", 16).create(frame(spark, table))
    before = dict(s.places)
    new = table | {7: 70}
    s.apply(delta.diff(frame(spark, table), frame(spark, new), "k"))
    assert s.places == before and len(s.pending) == 1
    assert rows(s.table()) == sorted(new.items()) and rows(s.get(7)) == [(7, 70)] and rows(s.get(8)) == [(8, 8)]
    last = {k: v + 1 for k, v in new.items() if k not in (8, 9)} | {500: 5}
    s.apply(delta.diff(frame(spark, new), frame(spark, {k: v for k, v in new.items() if k != 8}), "k"))
    assert rows(s.get(8)) == [] and rows(store.Store.open(spark, at, 1).table()) == sorted(new.items())
    assert len(s.compact()) == 2 and not s.pending
    assert sum(before[b] != s.places[b] for b in before) == 2
    s.apply(delta.diff(s.table(), frame(spark, last), "k"))
    again = store.Store.open(spark, at)
    assert rows(again.table()) == sorted(last.items()) and again.schema == s.schema and again.version == s.version
    s.apply(delta.diff(frame(spark, last), frame(spark, last), "k"))
    assert len(s.pending) == 1 and s.compact() and s.compact() == []
    assert rows(s.table()) == sorted(last.items())


def test_store_merges_when_changes_pile_up(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s", "k", 2, pending=3).create(frame(spark, {1: 1}))
    for k in range(2, 9):
        s.apply(delta.diff(frame(spark, {}), frame(spark, {k: k}), "k"))
        assert len(s.pending) < 3
    assert rows(s.table()) == [(k, k) for k in range(1, 9)]


def test_keys_are_checked(spark):
    with pytest.raises(store.DuplicateKey):
        store.checked(spark.createDataFrame([(1, 1), (1, 2)], SCHEMA), "k")
    assert rows(store.delete(frame(spark, {1: 1}), spark.createDataFrame([(9,)], "k long"), "k")) == [(1, 1)]


def test_selector_and_zero(spark):
    table = frame(spark, {1: 10, 2: 20})
    watched = spark.createDataFrame([(1,), (9,)], "k long")
    assert rows(keyed.select_keys(table, watched, "k", {"v": 0})) == [(1, 10), (9, 0)]


def test_subrange_moves(spark):
    old, new = {k: k for k in range(20)}, {k: k + (k == 6) for k in range(20)}
    changes = delta.diff(frame(spark, old), frame(spark, new), "k")
    still = keyed.subrange_delta(frame(spark, new), changes, "k", (5, 9), (5, 9))
    assert [(r.k, r.kind) for r in still.collect()] == [(6, "updated")]
    moved = keyed.subrange_delta(frame(spark, new), changes, "k", (5, 7), (6, 9))
    assert sorted((r.k, r.kind) for r in moved.collect()) == [(5, "removed"), (6, "updated"), (8, "added"), (9, "added")]
