"""Scenarios over passes, with exact values."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from deltaweave.operators import aggregates as agg, arrays, cells as cell, cutoff, time
from deltaweave.plans import bind, dependencies
from deltaweave.plans.session import AlreadyRunning, CycleError, Operator, OperatorError, Session, TooDeep, same_rows
from deltaweave.sources import cells

LOG = "k long, seq long, v double"


def log(spark, *values):
    return spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], LOG)


def held(df):
    return [r.held for r in df.orderBy("seq").collect()]


def test_cutoff_compares_with_what_went_on(spark):
    stop = lambda old, new: abs(new - old) < 0.1
    assert held(cutoff.cutoff(log(spark, 3.14, 3.15, 3.26), ["k"], stop, 0.0)) == [3.14, 3.14, 3.26]
    assert held(cutoff.cutoff(log(spark, 3.14, 3.20, 3.26), ["k"], stop, 0.0)) == [3.14, 3.14, 3.26]


def test_named_cutoffs(spark):
    values = log(spark, 1, 2, 2)
    assert held(cutoff.always(values, 0)) == [0, 0, 0]
    assert held(cutoff.never(values)) == [1, 2, 2]
    assert [r.went_on for r in cutoff.unchanged(values, ["k"], 0.0).orderBy("seq").collect()] == [True, True, False]
    nan = log(spark, float("nan"), float("nan"))
    assert [r.went_on for r in cutoff.unchanged(nan, ["k"], 0.0).orderBy("seq").collect()] == [True, True]


def test_input_cells(spark):
    writes = spark.createDataFrame([(1, 0, 0, 5), (1, 0, 1, 6), (1, 2, 2, 6), (2, 1, 3, 1)], "k long, version long, seq long, v long")
    assert sorted(map(tuple, cells.latest_per_pass(writes, ["k"]).collect())) == [(1, 0, 6), (1, 2, 6), (2, 1, 1)]
    states = cells.states_over_passes(writes, spark.range(4).withColumnRenamed("id", "version"), ["k"])
    assert sorted((r.version, r.k, r.v) for r in states.collect()) == [(0, 1, 6), (1, 1, 6), (1, 2, 1), (2, 1, 6), (2, 2, 1), (3, 1, 6), (3, 2, 1)]
    assert cells.drop_unchanged(writes, ["k"]).count() == 3
    doubled = cells.compose_updates(writes, ["k"], F.lit(0).cast("long"), lambda a, x: a * 2 + x)
    assert sorted(map(tuple, doubled.collect())) == [(1, (5 * 2 + 6) * 2 + 6), (2, 1)]


def test_arrays(spark):
    a = F.array(*map(F.lit, range(10)))
    none = F.array().cast("array<int>")
    row = spark.range(1).select(
        arrays.take_first(a, 5), arrays.take_last(F.array(F.lit(8), F.lit(9)), 3), arrays.from_first(a, lambda x: x > 5), arrays.before_first(a, lambda x: x > 5),
        arrays.first(none, 0), arrays.last(none, 0), arrays.take_last(none, 3), arrays.sort(a, arrays.descending), agg.reduce_balanced(none, lambda x, y: x + y), agg.reduce_balanced(a, lambda x, y: x + y),
    ).first()
    assert list(row) == [[0, 1, 2, 3, 4], [8, 9], [6, 7, 8, 9], [0, 1, 2, 3, 4, 5], 0, 0, [], list(range(9, -1, -1)), None, 45]


def test_accumulate_sorted_puts_later_equals_first(spark):
    got = arrays.accumulated_sorted(spark.createDataFrame([(1, 0, 5), (1, 1, 3), (1, 2, 5)], "k long, seq long, v long"), ["k"], "seq", "v").first()
    assert (got.vs, got.vs_order) == ([3, 5, 5], [1, 2, 0])


def test_last_value_and_freeze(spark):
    values = log(spark, 1, 2, 4, 3, 2, 5)
    assert [r.prev < r.v for r in cell.with_last(values, ["k"], 0.0).orderBy("seq").collect()] == [True, True, True, False, False, True]
    assert cell.freeze(values, ["k"]).first().v == 1


T0 = datetime(2026, 1, 1)


def ticks(spark, *seconds):
    return spark.createDataFrame([(1, i, T0 + timedelta(seconds=s), i) for i, s in enumerate(seconds)], "k long, version long, tick timestamp_ntz, v long")


def test_clock(spark):
    t = ticks(spark, 0, 30, 60, 3600)
    when = F.lit(T0 + timedelta(seconds=60)).cast("timestamp_ntz")
    assert [r[0] for r in t.orderBy("version").select(time.at(F.col("tick"), when)).collect()] == [False, False, True, True]
    start = F.lit(T0).cast("timestamp_ntz")
    n = ticks(spark, 0, 59, 60, 360).orderBy("version").select(time.at_intervals(F.col("tick"), start, 60))
    assert [r[0] for r in n.collect()] == [0, 0, 1, 6]
    with pytest.raises(ValueError):
        time.at_intervals(F.col("tick"), start, 0)
    shot = time.snapshot(ticks(spark, 0, 30, 60, 90), ["k"], when, -1).orderBy("version").collect()
    assert [r.snapshot for r in shot] == [-1, -1, 2, 2]
    back = time.monotone(ticks(spark, 0, 90, 30), ["k"], "version").orderBy("version").collect()
    assert [(r.now - T0).seconds for r in back] == [0, 90, 90]
    clock = time.Clock(T0)
    clock.advance(T0 + timedelta(seconds=5))
    assert clock.advance(T0) == T0 + timedelta(seconds=5)


def test_timer_drifts_with_its_fires(spark):
    t = ticks(spark, 0, 0, 4, 6, 9, 11, 16)
    fired = time.throttle(t, ["k"], 5, order="version", tick="tick").orderBy("version").collect()
    assert [r.fired for r in fired] == [True, False, False, True, False, True, True]


def test_bind_switches_and_releases(spark):
    n = {"v": 1}
    released = []

    def build(scope, v):
        scope.on_invalidated.append(lambda: released.append(v))
        return scope.own(spark.range(v)) if v else None

    b = bind.Bind(build, lambda: spark.createDataFrame([(n["v"],)], "v int"), zero=spark.range(0))
    assert b.value().count() == 1 and b.value().count() == 1 and b.builds == 1
    n["v"] = 3
    assert b.value().count() == 3 and released == [1]
    n["v"] = 0
    assert b.value().count() == 0 and released == [1, 3]


def test_memoized_bind_counts_builds(spark):
    made, key = [], {"v": "a"}

    def build(v):
        made.append(v)
        return spark.range(len(made))

    value = bind.bind_memoized(build, lambda: spark.createDataFrame([(key["v"],)], "v string"))
    counts = []
    for k in "aba":
        key["v"] = k
        value()
        counts.append(len(made))
    value.cache.purge(("a",))
    value()
    assert counts == [1, 2, 2] and len(made) == 3


def test_dependencies(spark):
    schema = "name string, depends_on array<string>"
    with pytest.raises(dependencies.BadDependencies):
        dependencies.validate(spark.createDataFrame([("a", []), ("a", [])], schema))
    with pytest.raises(dependencies.BadDependencies):
        dependencies.validate(spark.createDataFrame([("a", ["b"])], schema))
    with pytest.raises(dependencies.BadDependencies):
        dependencies.levels(spark.createDataFrame([("a", ["b"]), ("b", ["a"]), ("c", [])], schema))


def test_session_runs_what_is_needed(spark):
    s, seen = Session(spark), []
    s.source("a", lambda: spark.range(3))
    s.derive("b", lambda a: (seen.append("b"), a.select(F.sum("id").alias("t")))[1], "a")
    s.derive("idle", lambda a: seen.append("idle"), "a")
    o = s.observe("b")
    o.on_update(lambda df: seen.append("updated"))
    s.run()
    s.run()
    assert seen == ["b", "updated"] and o.value().first().t == 3
    s.set("a", lambda: spark.range(5))
    s.run()
    assert seen == ["b", "updated", "b", "updated"] and o.value().first().t == 10
    o.unobserve()
    assert o.value() is None and s.check() == []
    assert '"a" -> "b"' in s.dot()


def test_session_errors(spark):
    s = Session(spark, max_height=2)
    s.source("a", lambda: spark.range(1))
    fail = {"on": True}

    def plan(a):
        if fail["on"]:
            raise ValueError("no")
        return a

    s.derive("b", plan, "a")
    o = s.observe("b")
    with pytest.raises(OperatorError, match="b: no"):
        s.run()
    fail["on"] = False
    s.run()
    assert o.value().count() == 1
    s.derive("c", lambda b: b, "b")
    with pytest.raises(TooDeep):
        s.derive("d", lambda c: c, "c")
    assert s.would_cycle("a", "c")
    with pytest.raises(CycleError):
        s.add(Operator("e", lambda e: e, ["e"]))
    s.operators["b"].plan = lambda a: s.run()
    s.set_stale("b")
    with pytest.raises(OperatorError) as e:
        s.run()
    assert isinstance(e.value.__cause__, AlreadyRunning)


def test_session_actions_and_trace(spark):
    s, said = Session(spark), []
    for n in "ab":
        s.source(n, lambda n=n: spark.range(ord(n)))
        s.observe(n)
    s.trace(said.append)
    s.run()
    assert s.act({"a": lambda df: df.count(), "b": lambda df: df.count()}) == {"a": 97, "b": 98}
    assert said == ["pass 0 starts", "pass 0 ends", "made a", "made b"]


def test_python_functions(spark):
    from deltaweave.functions import udfs

    df = spark.createDataFrame([(1, "ab"), (2, None)], "k int, s string")

    def twice(s, k):
        return None if s is None else s * k

    assert [r[0] for r in df.orderBy("k").select(udfs.scalar(twice, "string")("s", "k")).collect()] == ["ab", None]

    def bad(s):
        raise ValueError("no")

    with pytest.raises(Exception, match="bad"):
        df.select(udfs.scalar(bad, "string")("s")).collect()
    most = udfs.aggregate(lambda v: v, max, "long")
    assert spark.range(5).agg(most("id")).first()[0] == 4


def test_identifiers(spark):
    from deltaweave.functions import identifiers as ids

    row = spark.range(1).select(ids.text(ids.parse(F.lit(""))), ids.parse(F.lit("xyz")), ids.is_zero(ids.parse(F.lit("0" * 32))), ids.short(ids.parse(F.lit("0" * 24 + "DEADBEEF")))).first()
    assert list(row) == [ids.ZERO, None, True, "deadbeef"]


def test_streams_forget_nothing_between_passes(spark):
    from deltaweave.streaming import runner, stateful

    rows = spark.createDataFrame([(1, v, v, x) for v, x in enumerate([0, 10, 12, 30, 29, 50])], "k long, version long, seq long, v long")
    for groups in (1, 3, 6):
        s = runner.stream(spark, *runner.passes(rows, "version", groups))
        out = runner.Passes(stateful.cutoff(s, [("k", "long")], lambda old, new: abs(new - old) < 5)).run()
        assert sorted((r.seq, r.held) for r in out.collect()) == [(1, 10), (3, 30), (5, 50)]


def test_a_fold_taken_twice_counts_once():
    from deltaweave.streaming.runner import Maintained

    fold = Maintained()
    for n, d in ((0, 5), (1, 7), (1, 7), (2, 1)):
        fold.take(n, d)
    assert fold.total == 13


def test_a_fold_goes_on_from_its_start():
    from deltaweave.streaming.runner import Maintained

    fold = Maintained(100)
    assert fold.total == 100
    fold.take(0, 5)
    fold.take(1, 7)
    fold.take(0, 6)
    assert fold.total == 106


def test_a_stream_goes_on_where_a_run_ended(spark, tmp_path):
    from deltaweave.streaming import runner, stateful

    schema = "k long, version long, seq long, v long"
    part = lambda *v: spark.createDataFrame([(1, s, s, x) for s, x in v], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    passes = lambda: runner.Passes(stateful.cutoff(runner.stream(spark, f"file://{tmp_path}/in", spark.createDataFrame([], schema).schema), [("k", "long")], lambda old, new: abs(new - old) < 5), at=f"file://{tmp_path}/out")
    part((0, 10), (1, 12))
    assert [(r.seq, r.held) for r in passes().run().collect()] == [(0, 10)]
    part((2, 13), (3, 15))
    assert [(r.seq, r.held) for r in passes().run().collect()] == [(3, 15)]


def test_cells_of_several_rows_are_an_error(spark):
    with pytest.raises(Exception, match="one row"):
        cell.map_cells(lambda a: a, (spark.range(2), "id")).collect()
    assert cell.map_cells(lambda a, b: a + b, (spark.range(1), "id"), (spark.range(0), "id")).count() == 0
    assert cell.MapN(lambda a: a).values().first().vs == []


def test_cutoffs_stop_a_pass(spark):
    s = Session(spark)
    value = {"v": 1}
    one = lambda v: spark.createDataFrame([(v,)], "v int")
    s.source("a", lambda: one(value["v"]), cutoff=same_rows)
    s.derive("b", lambda a: a.select(F.floor(F.col("v") / 10).alias("v")), "a", cutoff=same_rows)
    c = s.derive("c", lambda b: b, "b")
    o, seen = s.observe("c"), []
    o.on_update(lambda df: seen.append(df.first().v))
    for v, made in ((1, 1), (1, 1), (2, 1), (12, 2), (13, 2)):
        value["v"] = v
        s.set_stale("a")
        s.run()
        assert c.recomputes == made
    assert seen == [0, 1] and o.value().first().v == 1
    assert s.counters["changed"] == c.changed + s.operators["b"].changed + s.operators["a"].changed == 2 + 2 + 4


def test_keyed_results_follow_changes_alone(spark):
    from deltaweave.operators import delta, keyed

    frame = lambda t: spark.createDataFrame(sorted(t.items()), "k long, v long")
    s, tables = Session(spark), [{k: k for k in range(20)}]
    s.keyed("t", frame(tables[0]), "k", 4)
    even = s.keep("even", keyed.FilterMapValues("k", lambda r: r("v") * 10, lambda r: r("v") % 2 == 0), "t")
    total = s.keep("total", agg.total("k"), "even")
    o = s.observe("total")
    s.run()
    assert o.value().first().total == 900
    for new in ({**tables[-1], 3: 4}, {**tables[-1], 3: 4, 5: 7}, {k: v for k, v in tables[-1].items() if k != 2}):
        s.change("t", delta.diff(frame(tables[-1]), frame(new), "k"))
        tables.append(new)
        s.run()
        assert o.value().first().total == sum(10 * v for v in new.values() if v % 2 == 0)
        assert sorted(map(tuple, even.value.collect())) == sorted((k, 10 * v) for k, v in new.items() if v % 2 == 0)
    assert (even.recomputes, even.kept_up, even.changed) == (4, 3, 3) and (total.recomputes, total.kept_up) == (3, 2)
    s.change("t", delta.diff(frame(tables[-1]), frame({1: 2}), "k"))
    s.change("t", delta.diff(frame({1: 2}), frame({1: 2, 4: 8}), "k"))
    s.run()
    assert o.value().first().total == 100 and s.check() == []


def test_any_error_leaves_the_pass_undone(spark):
    s, said = Session(spark), []
    s.source("a", lambda: spark.range(1))
    s.derive("b", lambda a: a, "a")
    s.observe("b")
    s.trace(said.append)
    fail = {"on": True}

    def start(version):
        if fail["on"]:
            raise KeyboardInterrupt

    s.on_start.append(start)
    with pytest.raises(KeyboardInterrupt):
        s.run()
    assert s.version == 0 and said[-1].startswith("pass 0 failed")
    fail["on"] = False
    assert s.run() == 1 and s.operators["b"].value.count() == 1


def test_aborted_and_invalidated_operators_hear_of_it(spark):
    s, heard = Session(spark, clear_on_error=True, deterministic=True), []

    def no(a):
        raise ValueError("no")

    s.source("a", lambda: spark.range(1))
    s.derive("b", no, "a")
    s.derive("c", lambda b: b, "b")
    for n in "abc":
        s.operators[n].on_aborted.append(lambda e, n=n: heard.append(f"aborted {n}"))
        s.operators[n].on_invalidated.append(lambda n=n: heard.append(f"gone {n}"))
        s.operators[n].on_error.append(lambda e, n=n: heard.append(f"failed {n}"))
    s.observe("c")
    with pytest.raises(OperatorError, match="b: no"):
        s.run()
    assert heard == ["failed b", "aborted b", "aborted c"] or sorted(heard) == ["aborted b", "aborted c", "failed b"]
    heard.clear()
    s.invalidate("b")
    assert sorted(heard) == ["gone b", "gone c"] and list(s.operators) == ["a"] and s.observers == [] and s.run() == 1


def test_folds_in_order_keep_other_columns_and_take_long_logs(spark):
    from deltaweave.operators import ordered

    rows = spark.range(50_000).select((F.col("id") % 3).alias("k"), F.col("id").alias("seq"), (F.col("id") % 7).alias("v"), F.lit("x").alias("note")).repartition(5)
    run = lambda n, values: ((n or 0) + values[0], ((n or 0) + values[0],))
    got = ordered.fold(rows, ["k"], "seq", ["v"], run, "so_far long")
    assert got.columns == ["k", "seq", "v", "note", "so_far"] and got.count() == 50_000
    last = {r.k: r.so_far for r in got.groupBy("k").agg(F.max_by("so_far", "seq").alias("so_far")).collect()}
    assert last == {k: sum(i % 7 for i in range(k, 50_000, 3)) for k in range(3)}
    nulls = spark.createDataFrame([(None, 0, 5.0), (None, 1, None), (None, 2, 5.01)], LOG)
    assert held(cutoff.cutoff(nulls, ["k"], lambda old, new: abs(new - old) < 1, 0.0)) == [5.0, None, 5.01]
    assert ordered.fold(rows.limit(0), ["k"], "seq", ["v"], run, "so_far long").count() == 0


def test_nth_by_ranges(spark):
    from deltaweave.operators import positions

    df = spark.range(5000).select((F.col("id") * 3).alias("k"), F.col("id").alias("v")).repartition(7)
    for i in (0, 15, 16, 777, 4999):
        assert [r.v for r in positions.nth(df, "k", i, parts=16).collect()] == [i]
    assert positions.nth(df, "k", 5000, parts=16).count() == 0 and positions.nth(df.limit(0), "k", 50, parts=16).count() == 0


def test_passes_by_hand(spark):
    s, said = Session(spark, max_height=2), []
    s.source("a", lambda: spark.range(3))
    b = s.derive("b", lambda *t: t[0].select(F.sum("id").alias("t")), "a")
    o = s.observe("b")
    o.on_update(lambda df: said.append(df.first().t))
    with pytest.raises(RuntimeError):
        s.recompute("a")
    with pytest.raises(RuntimeError):
        s.end_pass()
    assert s.start_pass() == ["a", "b"]
    with pytest.raises(ValueError):
        s.recompute("b")  # its input has no value
    with pytest.raises(AlreadyRunning):
        s.run()
    with pytest.raises(AlreadyRunning):
        s.link("b", "a")
    assert s.recompute("a") and s.end_pass() == 1 and said == [] and b.stale
    assert s.run() == 2 and said == [3] and not b.stale
    s.set("a", lambda: spark.range(5))
    s.start_pass()
    assert not s.recompute("b") and s.recompute("a")  # in the wrong order: b is stale afterwards
    assert s.end_pass() == 3 and b.stale and s.run() == 4 and said == [3, 10]
    s.set_stale("a")
    s.start_pass()
    s.recompute("a")
    assert s.end_pass(ValueError("no")) == 4 and b.stale and s.run() == 5
    assert s.view("b")["height"] == 1 and s.view("a")["above"] == ["b"] and s.view("b")["needed"]
    assert s.status()["passes"] == 5 and s.status()["observers"] == 1 and s.check() == []
    s.source("c", lambda: spark.range(1))
    s.derive("d", lambda c: c, "c")
    with pytest.raises(CycleError):
        s.link("a", "b")
    s.derive("e", lambda d: d, "d")
    with pytest.raises(TooDeep):
        s.link("a", "e")
    assert s.operators["a"].inputs == []
    s.link("b", "c")
    assert b.session is s and s.view("c")["needed"]
    s.unlink("b", "c")
    assert not s.view("c")["needed"]
    s.invalidate("b")
    assert b.session is None


def test_sessions_have_names(spark):
    s = Session(spark)
    assert s.id != Session(spark).id
    s.label, s.metadata["owner"] = "daily", "x"
    op = s.source("a", lambda: spark.range(1))
    op.label = "input"
    assert (s.label, s.metadata) == ("daily", {"owner": "x"}) and "input" in s.dot()
