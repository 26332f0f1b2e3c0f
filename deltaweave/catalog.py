"""The queries, each with SQL that says the same: (spark, folder of tables) -> DataFrame."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from deltaweave.functions import identifiers, udfs
from deltaweave.operators import aggregates as agg, arrays, cells as cell, cutoff, delta, keyed, positions, time
from deltaweave.plans import bind, dependencies
from deltaweave.plans.session import Session, same_rows
from deltaweave.sources import cells, keyed as store, tables
from deltaweave.sources.shared import shared_dir
from deltaweave.streaming import runner, stateful

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

V0 = "v0 AS (SELECT o_orderkey AS k, CAST(ROUND(o_totalprice * 100) AS BIGINT) AS v FROM orders)"
V1 = f"{V0}, v1 AS (SELECT k, v + CASE WHEN k % 7 = 0 THEN 100 ELSE 0 END AS v FROM v0 WHERE k % 10 <> 0 UNION ALL SELECT k + 1000000000, v FROM v0 WHERE k % 11 = 0)"
EV = "ev AS (SELECT user_id AS k, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS version, event_id AS seq, CAST(ROUND(value * 100) AS BIGINT) AS v, event_type, ts FROM events)"


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def changes_of(spark: SparkSession, d: str) -> DataFrame:
    return delta.diff(tables.book(spark, d, 0), tables.book(spark, d, 1), "k")


# inputs


@query(f"WITH {EV} SELECT k, version, arg_max(v, seq) AS v FROM ev GROUP BY k, version")
def var_latest_per_day(spark, d):
    return cells.latest_per_pass(tables.events(spark, d), ["k"])


@query(f"""WITH {EV}, last AS (SELECT k, version, arg_max(v, seq) AS v FROM ev GROUP BY k, version), days AS (SELECT DISTINCT version FROM ev),
state AS (SELECT d.version, l.k, arg_max(l.v, l.version) AS v FROM days d JOIN last l ON l.version <= d.version GROUP BY d.version, l.k)
SELECT version, CAST(sum(v) AS BIGINT) AS total_cents, count(*) AS users FROM state GROUP BY version""")
def latest_total_per_day(spark, d):
    return cells.totals_over_passes(tables.events(spark, d), ["k"], total="total_cents", count="users")


@query(f"WITH {EV} SELECT k, seq, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY k ORDER BY seq) AS p FROM ev) WHERE p IS DISTINCT FROM event_type")
def var_equal_dedup(spark, d):
    return cells.drop_unchanged(tables.events(spark, d).select("k", "seq", "event_type"), ["k"], value="event_type")


@query(f"WITH {EV} SELECT k, seq, v FROM (SELECT *, lag(v) OVER (PARTITION BY k ORDER BY seq) AS p FROM ev) WHERE p IS NULL OR p // 1000 <> v // 1000")
def var_equal_func(spark, d):
    return cells.drop_unchanged(tables.events(spark, d).select("k", "seq", "v"), ["k"], equal=lambda a, b: F.floor(a / 1000) == F.floor(b / 1000))


@query(f"WITH {EV} SELECT k, CAST(list_reduce(list_prepend(0::BIGINT, list(v ORDER BY seq)), lambda a, x: (a * 3 + x) % 1000003) AS BIGINT) AS v FROM ev GROUP BY k")
def var_update_compose(spark, d):
    return cells.compose_updates(tables.events(spark, d), ["k"], F.lit(0).cast("long"), lambda acc, x: (acc * 3 + x) % 1000003)


@query(f"WITH {EV} SELECT k, arg_max(v, seq) AS v FROM ev WHERE version <= 14 GROUP BY k")
def var_as_of_pass(spark, d):
    return cells.as_of(tables.events(spark, d), 14, ["k"])


@query("SELECT 42 AS v")
def return_constant(spark, d):
    return cells.constant(spark, 42)


@query("SELECT count(*) AS n, CAST(1 AS BIGINT) AS calls FROM nation")
def func_called_once(spark, d):
    f = cells.Func(lambda: tables.load(spark, d, "nation").agg(F.count("*").alias("n")))
    f.value()
    return f.value().select("n", F.lit(f.calls).cast("long").alias("calls"))


@query("SELECT CAST(NULL AS BIGINT) AS k, CAST(NULL AS BIGINT) AS v WHERE false")
def keyed_empty(spark, d):
    return store.empty(spark, "k long, v long")


@query("SELECT c_custkey AS k, c_name AS v FROM customer")
def keyed_load(spark, d):
    return store.checked(tables.load(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v")), "k")


@query(f"WITH {V1}, up AS (SELECT k, v FROM v1 WHERE k % 3 = 0), gone AS (SELECT k FROM v0 WHERE k % 5 = 0) SELECT coalesce(u.k, a.k) AS k, coalesce(u.v, a.v) AS v FROM v0 a FULL JOIN up u ON a.k = u.k WHERE coalesce(u.k, a.k) NOT IN (SELECT k FROM gone)")
def upsert_delete(spark, d):
    old, new = tables.book(spark, d, 0), tables.book(spark, d, 1)
    return store.delete(store.upsert(old, new.where("k % 3 = 0"), "k"), old.where("k % 5 = 0"), "k")


@query(f"WITH {V1} SELECT k, v FROM v1")
def store_after_pass(spark, d):
    s = store.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", "k", 16).create(tables.book(spark, d, 0))
    s.apply(changes_of(spark, d))
    return s.table()


@query(f"WITH {V1} SELECT k, v FROM v1")
def store_restored(spark, d):
    at = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    s = store.Store(spark, at, "k", 16).create(tables.book(spark, d, 0))
    s.apply(changes_of(spark, d))
    s.compact()
    return store.Store.open(spark, at).table()


@query(f"WITH {V0} SELECT k, v FROM v0")
def store_old_version(spark, d):
    at = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    store.Store(spark, at, "k", 16).create(tables.book(spark, d, 0)).apply(changes_of(spark, d))
    return store.Store.open(spark, at, 0).table()


@query("SELECT * FROM (VALUES ('app', CAST(3 AS BIGINT)), ('lib', 1), ('net', 1), ('base', 0), ('web', 2)) AS t(name, level)")
def dependency_levels(spark, d):
    deps = spark.createDataFrame([("app", ["web", "lib"]), ("lib", ["base"]), ("net", ["base"]), ("base", []), ("web", ["net", "base"])], "name string, depends_on array<string>")
    return dependencies.levels(dependencies.validate(deps))


# change sets


@query(f"WITH {V1} SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'updated' END AS kind, a.v AS old_v, b.v AS new_v FROM v0 a FULL JOIN v1 b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v IS DISTINCT FROM b.v")
def sym_diff(spark, d):
    return changes_of(spark, d).select("k", "kind", F.col("old.v").alias("old_v"), F.col("new.v").alias("new_v"))


@query(f"WITH {V1} SELECT CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'updated' END AS kind, count(*) AS n FROM v0 a FULL JOIN v1 b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v IS DISTINCT FROM b.v GROUP BY 1")
def changes_by_kind(spark, d):
    return delta.by_kind(changes_of(spark, d))


@query(f"WITH {V1} SELECT k, v FROM v1 WHERE k NOT IN (SELECT k FROM v0)")
def added_keys(spark, d):
    return delta.added(tables.book(spark, d, 0), tables.book(spark, d, 1), "k")


@query(f"WITH {V1} SELECT k, v FROM v0 WHERE k NOT IN (SELECT k FROM v1)")
def removed_keys(spark, d):
    return delta.removed(tables.book(spark, d, 0), tables.book(spark, d, 1), "k")


@query(f"WITH {V1} SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' ELSE 'removed' END AS kind FROM v0 a FULL JOIN v1 b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def diff_nil_equal(spark, d):
    return delta.diff(tables.book(spark, d, 0), tables.book(spark, d, 1), "k", equal=None).select("k", "kind")


@query(f"WITH {V1} SELECT count(*) AS n FROM v0 a FULL JOIN v1 b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v // 10000 <> b.v // 10000")
def diff_custom_equal(spark, d):
    near = lambda a, b: F.floor(a["v"] / 10000) == F.floor(b["v"] / 10000)
    return delta.diff(tables.book(spark, d, 0), tables.book(spark, d, 1), "k", near).agg(F.count("*").alias("n"))


@query(f"WITH {V1} SELECT k, v FROM v1")
def apply_changes(spark, d):
    return delta.apply_changes(tables.book(spark, d, 0), changes_of(spark, d), "k")


@query(f"WITH {V1} SELECT (SELECT count(*) FROM (SELECT k FROM v0 UNION SELECT k FROM v1)) AS all_keys, (SELECT count(*) FROM (SELECT k FROM v0 INTERSECT SELECT k FROM v1)) AS both_keys, (SELECT count(*) FROM (SELECT k FROM v0 EXCEPT SELECT k FROM v1)) AS old_keys")
def key_sets(spark, d):
    both = delta.sides(tables.book(spark, d, 0), tables.book(spark, d, 1), "k")
    has_old, has_new = F.col("old").isNotNull(), F.col("new").isNotNull()
    return both.agg(F.count("*").alias("all_keys"), F.count_if(has_old & has_new).alias("both_keys"), F.count_if(has_old & ~has_new).alias("old_keys"))


# keyed projections and filters


def _line():
    return keyed.MapValues("k", lambda r: F.format_string("%d: %d", r("k"), r("v")), "line")


@query(f"WITH {V1} SELECT k, printf('%d: %d', k, v) AS line FROM v1")
def map_values_line(spark, d):
    return _line().full(tables.book(spark, d, 1))


@query(f"WITH {V1} SELECT k, printf('%d: %d', k, v) AS line FROM v1")
def map_values_delta(spark, d):
    old = _line().full(tables.book(spark, d, 0))
    return delta.apply_changes(old, _line().delta(changes_of(spark, d)), "k")


@query(f"WITH {V1} SELECT b.k, printf('%d: %d', b.k, coalesce(a.v, b.v)) AS line FROM v1 b LEFT JOIN v0 a ON a.k = b.k")
def map_values_nil_equal(spark, d):
    op = keyed.MapValues("k", _line().fn, "line", equal=None)
    return delta.apply_changes(op.full(tables.book(spark, d, 0)), op.delta(changes_of(spark, d)), "k")


def _doubled():
    return keyed.FilterMapValues("k", lambda r: r("v") * 2, lambda r: r("v") % 2 == 0)


@query(f"WITH {V1} SELECT k, v * 2 AS v FROM v1 WHERE v % 2 = 0")
def filter_map_values(spark, d):
    return _doubled().full(tables.book(spark, d, 1))


@query(f"WITH {V1} SELECT k, v * 2 AS v FROM v1 WHERE v % 2 = 0")
def filter_map_values_delta(spark, d):
    return delta.apply_changes(_doubled().full(tables.book(spark, d, 0)), _doubled().delta(changes_of(spark, d)), "k")


@query(f"WITH {V1} SELECT k, v, v >= 10000000 AS matching FROM v1")
def partition_flags(spark, d):
    return keyed.Partition("k", lambda r: r("v") >= 10000000).full(tables.book(spark, d, 1))


@query(f"WITH {V1} SELECT (SELECT count(*) FROM v1 WHERE v >= 10000000) AS yes, (SELECT count(*) FROM v1 WHERE v < 10000000) AS no")
def partition_halves(spark, d):
    yes, no = keyed.Partition("k", lambda r: r("v") >= 10000000).halves(tables.book(spark, d, 1))
    return yes.agg(F.count("*").alias("yes")).crossJoin(no.agg(F.count("*").alias("no")))


@query(f"WITH {V0} SELECT k, v FROM v0 WHERE k BETWEEN 100 AND 500")
def subrange_fixed(spark, d):
    return keyed.subrange(tables.book(spark, d, 0), "k", 100, 500)


@query(f"WITH {V0}, b AS (SELECT min(c_custkey) * 10 AS low, max(c_custkey) AS high FROM customer) SELECT k, v FROM v0, b WHERE k BETWEEN low AND high")
def subrange_moving_bounds(spark, d):
    bounds = tables.load(spark, d, "customer").agg((F.min("c_custkey") * 10).alias("low"), F.max("c_custkey").alias("high"))
    return keyed.subrange_by_cell(tables.book(spark, d, 0), "k", bounds)


@query(f"WITH {V1}, o AS (SELECT * FROM v0 WHERE k BETWEEN 100 AND 500), n AS (SELECT * FROM v1 WHERE k BETWEEN 300 AND 700) SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' ELSE 'updated' END AS kind, o.v AS old_v, n.v AS new_v FROM o FULL JOIN n ON o.k = n.k WHERE o.k IS NULL OR n.k IS NULL OR o.v <> n.v")
def subrange_delta(spark, d):
    moved = keyed.subrange_delta(tables.book(spark, d, 1), changes_of(spark, d), "k", (100, 500), (300, 700))
    return moved.select("k", "kind", F.col("old.v").alias("old_v"), F.col("new.v").alias("new_v"))


@query(f"WITH {V0} SELECT k, v FROM v0 WHERE k BETWEEN 7 AND 77")
def range_scan(spark, d):
    return positions.in_range(tables.book(spark, d, 0), "k", 7, 77)


@query(f"WITH {V0} SELECT k, v FROM v0 WHERE k = 77")
def point_get(spark, d):
    return tables.book(spark, d, 0).where(F.col("k") == 77)


# merges and pointers

_LINES = "li AS (SELECT l_orderkey AS k, CAST(sum(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS v FROM lineitem GROUP BY 1)"


def _lines(spark, d):
    rows = tables.load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k"))
    return rows.agg(F.sum(tables.cents("l_extendedprice")).alias("v"))


def _sum_merge(include=None):
    fn = lambda l, r, a, b: F.coalesce(l("v"), F.lit(0)) * 3 + F.coalesce(r("v"), F.lit(0))  # noqa: E731, E741
    return keyed.Merge("k", fn, include) if include else keyed.Merge("k", fn)


@query(f"WITH {V1}, {_LINES} SELECT coalesce(a.k, b.k) AS k, coalesce(a.v, 0) * 3 + coalesce(b.v, 0) AS v FROM v1 a FULL JOIN li b ON a.k = b.k")
def merge_full(spark, d):
    return _sum_merge().full(tables.book(spark, d, 1), _lines(spark, d))


@query(f"WITH {V1}, {_LINES} SELECT a.k, coalesce(a.v, 0) * 3 + coalesce(b.v, 0) AS v FROM v1 a LEFT JOIN li b ON a.k = b.k")
def merge_left_only(spark, d):
    return _sum_merge(lambda l, r, a, b: a).full(tables.book(spark, d, 1), _lines(spark, d))  # noqa: E741


@query(f"WITH {V1}, {_LINES} SELECT a.k, a.v * 3 + b.v AS v FROM v1 a JOIN li b ON a.k = b.k")
def merge_inner(spark, d):
    return _sum_merge(lambda l, r, a, b: a & b).full(tables.book(spark, d, 1), _lines(spark, d))  # noqa: E741


@query(f"WITH {V1}, {_LINES} SELECT coalesce(a.k, b.k) AS k, coalesce(a.v, 0) * 3 + coalesce(b.v, 0) AS v FROM v1 a FULL JOIN li b ON a.k = b.k")
def merge_delta(spark, d):
    op, old, new, right = _sum_merge(), tables.book(spark, d, 0), tables.book(spark, d, 1), _lines(spark, d)
    before = op.full(old, right)
    none = delta.diff(right, right, "k").limit(0)
    return delta.apply_changes(before, op.delta(new, right, changes_of(spark, d), none, before), "k")


@query(f"WITH {V1} SELECT k FROM v0 EXCEPT SELECT k FROM v1")
def key_except(spark, d):
    only = keyed.Merge("k", lambda l, r, a, b: F.lit(1), lambda l, r, a, b: a & ~b)  # noqa: E741
    return only.full(tables.book(spark, d, 0), tables.book(spark, d, 1)).select("k")


@query("SELECT o_orderkey AS k, CAST(ROUND(c_acctbal * 100) AS BIGINT) AS v FROM orders JOIN customer ON o_custkey = c_custkey")
def pointer_join(spark, d):
    pointers = tables.load(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("target"))
    values = tables.load(spark, d, "customer").select(F.col("c_custkey").alias("target"), tables.cents("c_acctbal").alias("v"))
    return keyed.join_cells(pointers, values, "target")


@query(f"WITH {EV}, u AS (SELECT min(k) AS low, max(k) - min(k) + 1 AS n FROM ev), p AS (SELECT version, low + (version * 37) % n AS target FROM (SELECT DISTINCT version FROM ev), u), l AS (SELECT k, version, arg_max(v, seq) AS v FROM ev GROUP BY k, version) SELECT p.version, p.target, arg_max(l.v, l.version) AS v FROM p JOIN l ON l.k = p.target AND l.version <= p.version GROUP BY p.version, p.target")
def cell_join_asof(spark, d):
    log = tables.events(spark, d)
    low, n = log.agg(F.min("k"), F.max("k") - F.min("k") + 1).first()
    pointers = log.select("version").distinct().select("version", (low + (F.col("version") * 37) % n).alias("target"))
    return cells.read_as_of(cells.latest_per_pass(log, ["k"]), pointers, "k", "target")


@query(f"WITH {V1}, c AS (SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'updated' END AS kind FROM v0 a FULL JOIN v1 b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v <> b.v) SELECT k, kind FROM c WHERE k IN (SELECT c_custkey FROM customer)")
def selector_changed_watchers(spark, d):
    watched = tables.load(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return keyed.selected_changes(changes_of(spark, d), watched, "k").select("k", "kind")


@query(f"WITH {V1}, w AS (SELECT * FROM (VALUES (1), (10), (70), (-1)) AS t(k)) SELECT CAST(w.k AS BIGINT) AS k, coalesce(v1.v, 0) AS v FROM w LEFT JOIN v1 ON v1.k = w.k")
def select_keys(spark, d):
    watched = spark.createDataFrame([(1,), (10,), (70,), (-1,)], "k long")
    return keyed.select_keys(tables.book(spark, d, 1), watched, "k", {"v": 0})


# aggregates


@query(f"WITH {V1} SELECT CAST(sum(v) AS BIGINT) AS total FROM v1")
def fold_sum_delta(spark, d):
    op = agg.total("k")
    return op.full(tables.book(spark, d, 0)).union(op.delta(changes_of(spark, d))).agg(F.sum("total").alias("total"))


@query(f"WITH {V1} SELECT CAST(coalesce(sum(v), 0) AS BIGINT) AS total FROM v1")
def sum_total(spark, d):
    return agg.total("k").full(tables.book(spark, d, 1))


@query(f"WITH {V0} SELECT CAST(coalesce(sum(v), 0) AS BIGINT) AS total FROM v0 WHERE k < 0")
def sum_of_nothing(spark, d):
    return agg.total("k").full(tables.book(spark, d, 0).where("k < 0"))


@query(f"WITH {V1} SELECT count(*) AS n FROM v1")
def cardinality(spark, d):
    op = agg.cardinality("k")
    return op.full(tables.book(spark, d, 0)).union(op.delta(changes_of(spark, d))).agg(F.sum("n").alias("n"))


@query(f"WITH {V1} SELECT count(*) FILTER (v > 15000000) AS n FROM v1")
def counti_pred(spark, d):
    op = agg.count_where("k", lambda r: r("v") > 15000000)
    return op.full(tables.book(spark, d, 0)).union(op.delta(changes_of(spark, d))).agg(F.sum("n").alias("n"))


@query(f"WITH {V1} SELECT max(v) AS max_v, min(v) AS min_v FROM v1")
def max_min_value(spark, d):
    return agg.extremes(tables.book(spark, d, 1))


@query(f"WITH {V0} SELECT max(v) AS max_v, min(v) AS min_v FROM v0 WHERE k < 0")
def max_of_nothing(spark, d):
    return agg.extremes(tables.book(spark, d, 0).where("k < 0"))


@query(f"WITH {V1} SELECT max(v) AS v FROM v1")
def max_after_delete(spark, d):
    op = agg.Reduce("k", lambda r: F.max(r("v")), lambda bucket, part: F.max(part))
    return op.full(op.refreshed(op.partials(tables.book(spark, d, 0)), tables.book(spark, d, 1), changes_of(spark, d)))


@query("SELECT CAST(64 AS BIGINT) AS n")
def reduce_memo_len(spark, d):
    op = agg.Reduce("k", lambda r: F.max(r("v")), lambda bucket, part: F.max(part))
    return op.partials(tables.book(spark, d, 0)).agg(F.count("*").alias("n"))


@query("SELECT string_agg(n_name, ',' ORDER BY n_nationkey) AS joined FROM nation")
def reduce_concat_ordered(spark, d):
    return agg.ordered_concat(tables.load(spark, d, "nation"), "n_nationkey", "n_name", ",")


@query(f"WITH {EV} SELECT k, CAST(list_reduce(list_prepend(7::BIGINT, list(v ORDER BY seq)), lambda a, x: (a * 31 + x) % 999983) AS BIGINT) AS v FROM ev GROUP BY k")
def array_fold_ordered(spark, d):
    return agg.array_fold(tables.events(spark, d), ["k"], "seq", "v", F.lit(7).cast("long"), lambda a, x: (a * 31 + x) % 999983)


@query(f"WITH {EV} SELECT k, max(v) AS most, CAST(NULL AS BIGINT) AS nothing FROM ev GROUP BY k")
def reduce_balanced(spark, d):
    items = tables.events(spark, d).groupBy("k").agg(F.collect_list("v").alias("a"))
    return items.select("k", agg.reduce_balanced(F.col("a"), lambda x, y: F.greatest(x, y)).alias("most"), agg.reduce_balanced(F.filter("a", lambda x: x < -1), lambda x, y: F.greatest(x, y)).alias("nothing"))


@query(f"WITH {EV}, l AS (SELECT k, version, arg_max(v, seq) AS v FROM ev GROUP BY k, version), c AS (SELECT version, sum(v - coalesce(p, 0)) AS dv FROM (SELECT *, lag(v) OVER (PARTITION BY k ORDER BY version) AS p FROM l) GROUP BY version) SELECT version, CAST(sum(dv) OVER (ORDER BY version) AS BIGINT) AS total FROM c")
def unordered_array_fold(spark, d):
    last = cell.with_last(cells.latest_per_pass(tables.events(spark, d), ["k"]), ["k"], 0, order="version")
    per_pass = last.groupBy("version").agg(F.sum(F.col("v") - F.col("prev")).alias("dv"))
    return per_pass.select("version", F.sum("dv").over(Window.orderBy("version")).alias("total"))  # one row a pass


@query(f"WITH {EV} SELECT k, bool_and(v >= 0) AS all_ok, bool_or(v > 49000) AS any_big FROM ev GROUP BY k")
def for_all_exists(spark, d):
    return tables.events(spark, d).groupBy("k").agg(agg.for_all(F.col("v") >= 0).alias("all_ok"), agg.exists(F.col("v") > 49000).alias("any_big"))


@query("SELECT true AS all_ok, false AS any_big")
def for_all_empty(spark, d):
    return tables.events(spark, d).where("k < 0").agg(agg.for_all(F.col("v") >= 0).alias("all_ok"), agg.exists(F.col("v") > 0).alias("any_big"))


@query("SELECT o_orderpriority AS g, count(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1996-01-01' GROUP BY 1")
def orders_by_group_delta(spark, d):
    orders = tables.load(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_orderpriority", "o_orderdate")
    is_new = F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")
    changes = delta.diff(orders.where(~is_new), orders, "k")
    return agg.grouped_counts(changes, lambda r: r("o_orderpriority"), "k")


# cells


@query(f"WITH {V0} SELECT CAST((SELECT sum(v) FROM v0) // (SELECT count(*) FROM customer) AS BIGINT) AS v")
def map2_cells(spark, d):
    total = agg.total("k").full(tables.book(spark, d, 0))
    n = tables.load(spark, d, "customer").agg(F.count("*").alias("n"))
    return cell.map_cells(lambda a, b: F.floor(a.cast("decimal(38,0)") / b).cast("long"), (total, "total"), (n, "n"))


_COUNTS = "region nation customer supplier part orders lineitem events".split()


@query("SELECT " + " + ".join(f"{i + 1} * (SELECT count(*) FROM {t})" for i, t in enumerate(_COUNTS)) + " AS v")
def map8_cells(spark, d):
    counts = [(tables.load(spark, d, t).agg(F.count("*").alias("n")), "n") for t in _COUNTS]
    return cell.map_cells(lambda *n: sum(((i + 1) * x for i, x in enumerate(n)), F.lit(0)).cast("long"), *counts)


@query(f"WITH {V1} SELECT a.k, a.v - b.v AS v FROM v1 a JOIN v0 b ON a.k = b.k")
def map2_keyed(spark, d):
    return cell.map_keyed(lambda a, b: a - b, "k", (tables.book(spark, d, 1), "v"), (tables.book(spark, d, 0), "v"))


@query("SELECT [(SELECT count(*) FROM region), (SELECT count(*) FROM part), (SELECT count(*) FROM nation)] AS vs")
def map_n_ordered(spark, d):
    n = lambda t: tables.load(spark, d, t).agg(F.count("*").alias("n"))
    op = cell.MapN(lambda a: a, ("region", n("region"), "n"), ("supplier", n("supplier"), "n"), ("part", n("part"), "n"))
    op.add_input("nation", n("nation"), "n")
    op.remove_input("supplier")
    op.remove_input("no such input")
    return op.values()


@query("SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN o_custkey ELSE -o_custkey END AS v FROM orders")
def map_if(spark, d):
    orders = tables.load(spark, d, "orders")
    return orders.select(F.col("o_orderkey").alias("k"), cell.map_if(F.col("o_orderstatus") == "F", F.col("o_custkey"), -F.col("o_custkey")).alias("v"))


@query("SELECT list(r_name ORDER BY r_regionkey) AS vs FROM region")
def all_values(spark, d):
    return cell.history(tables.load(spark, d, "region").withColumn("g", F.lit(1)), ["g"], "r_regionkey", "r_name").select("vs")


@query("SELECT count(*) AS n FROM nation")
def depend_on(spark, d):
    return cell.depend_on(tables.load(spark, d, "nation").agg(F.count("*").alias("n")), tables.load(spark, d, "region"))


@query(f"WITH {EV} SELECT k, arg_min(v, seq) AS v FROM ev GROUP BY k")
def freeze_first(spark, d):
    return cell.freeze(tables.events(spark, d), ["k"])


@query(f"WITH {EV} SELECT k, seq, coalesce(lag(v) OVER (PARTITION BY k ORDER BY seq), 0) < v AS rose FROM ev")
def map_last_delta(spark, d):
    return cell.with_last(tables.events(spark, d).select("k", "seq", "v"), ["k"], 0).select("k", "seq", (F.col("prev") < F.col("v")).alias("rose"))


@query(f"WITH {EV} SELECT k, list(v ORDER BY seq) AS vs FROM ev WHERE seq > 500 GROUP BY k")
def watch_history(spark, d):
    return cell.history(tables.events(spark, d), ["k"], after=500)


# positions, arrays


@query(f"WITH {V1} SELECT k, v FROM v1 ORDER BY k LIMIT 1 OFFSET 100")
def nth_entry(spark, d):
    return positions.nth(tables.book(spark, d, 1), "k", 100)


@query(f"WITH {V1} SELECT count(*) FILTER (k < 770) AS rank, bool_or(k = 770) AS present FROM v1")
def rank_key(spark, d):
    return positions.rank(tables.book(spark, d, 1), "k", 770)


@query(f"WITH {V1} SELECT min(k) AS min_k, arg_min(v, k) AS min_v, max(k) AS max_k, arg_max(v, k) AS max_v FROM v1")
def min_max_key(spark, d):
    return positions.ends(tables.book(spark, d, 1), "k")


@query("SELECT list(n_nationkey ORDER BY n_nationkey) AS ks FROM nation")
def sorted_keys(spark, d):
    return positions.keys(tables.load(spark, d, "nation"), "n_nationkey")


@query("SELECT o_orderkey, CAST(ROUND(o_totalprice * 100) AS BIGINT) AS v FROM orders ORDER BY v DESC, o_orderkey LIMIT 20")
def topk_orders(spark, d):
    rows = tables.load(spark, d, "orders").select("o_orderkey", tables.cents("o_totalprice").alias("v"))
    return positions.top(rows, [F.desc("v"), F.asc("o_orderkey")], 20)


_ARR = f"{EV}, a AS (SELECT k, list(v ORDER BY seq) AS arr FROM ev GROUP BY k)"


def _arrays(spark, d):
    return cell.history(tables.events(spark, d), ["k"]).withColumnRenamed("vs", "arr")


@query(f"WITH {_ARR} SELECT k, list_filter(arr, lambda x: x > 10000) AS vs FROM a")
def array_filter(spark, d):
    return _arrays(spark, d).select("k", arrays.keep(F.col("arr"), lambda x: x > 10000).alias("vs"))


@query(f"WITH {_ARR} SELECT k, list_sort(arr, 'DESC') AS down, list_sort(arr) AS up FROM a")
def array_sort_desc(spark, d):
    return _arrays(spark, d).select("k", arrays.sort(F.col("arr"), arrays.descending).alias("down"), arrays.sort(F.col("arr")).alias("up"))


@query(f"WITH {_ARR} SELECT k, arr[1] AS head, arr[-1] AS tail, CAST(0 AS BIGINT) AS none FROM a")
def first_last(spark, d):
    return _arrays(spark, d).select("k", arrays.first(F.col("arr"), 0).alias("head"), arrays.last(F.col("arr"), 0).alias("tail"), arrays.first(F.filter("arr", lambda x: x < -1), 0).alias("none"))


@query(f"WITH {_ARR} SELECT k, arr[1:5] AS firsts, arr[greatest(len(arr) - 2, 1):len(arr)] AS lasts, arr AS all_of_it FROM a")
def take_first_last(spark, d):
    a = F.col("arr")
    return _arrays(spark, d).select("k", arrays.take_first(a, 5).alias("firsts"), arrays.take_last(a, 3).alias("lasts"), arrays.take_last(a, 1000000).alias("all_of_it"))


@query(f"WITH {_ARR}, s AS (SELECT k, list_sort(arr) AS arr FROM a) SELECT k, list_filter(arr, lambda x: x <= 9000) AS low, list_filter(arr, lambda x: x > 9000) AS high FROM s")
def take_search(spark, d):
    a = arrays.sort(F.col("arr"))
    return _arrays(spark, d).select("k", arrays.before_first(a, lambda x: x > 9000).alias("low"), arrays.from_first(a, lambda x: x > 9000).alias("high"))


@query(f"WITH {EV} SELECT k, version, list(v) OVER (PARTITION BY k ORDER BY version ROWS UNBOUNDED PRECEDING) AS vs FROM (SELECT k, version, arg_max(v, seq) AS v FROM ev GROUP BY k, version)")
def accumulate_running(spark, d):
    return arrays.accumulated(cells.latest_per_pass(tables.events(spark, d), ["k"]), ["k"], "version", "v")


@query(f"WITH {EV} SELECT k, list(v // 5000 ORDER BY v // 5000, seq DESC) AS vs, list(seq ORDER BY v // 5000, seq DESC) AS vs_order FROM ev GROUP BY k")
def accumulate_sorted(spark, d):
    return arrays.accumulated_sorted(tables.events(spark, d).withColumn("v", F.floor(F.col("v") / 5000)), ["k"], "seq", "v")


@query(f"WITH {EV} SELECT * FROM (SELECT k, seq, list(v) OVER (PARTITION BY k ORDER BY seq ROWS 2 PRECEDING) AS vs FROM ev) WHERE len(vs) = 3")
def rolling_last_n(spark, d):
    return arrays.rolling(tables.events(spark, d), ["k"], "seq", "v", 3)


@query(f"WITH {EV} SELECT k, seq, greatest(max(v) OVER w, 0) AS top, row_number() OVER w AS updates FROM ev WINDOW w AS (PARTITION BY k ORDER BY seq ROWS UNBOUNDED PRECEDING)")
def running_max_and_rate(spark, d):
    w = Window.partitionBy("k").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return tables.events(spark, d).select("k", "seq", F.greatest(F.max("v").over(w), F.lit(0)).alias("top"), F.row_number().over(w).cast("long").alias("updates"))


# cutoffs

_STEP = """, n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq) AS i FROM {src})
, r AS (SELECT k, seq, i, CASE WHEN {first} THEN 0 ELSE v END AS held, NOT ({first}) AS went_on FROM n WHERE i = 1
  UNION ALL SELECT n.k, n.seq, n.i, CASE WHEN {later} THEN r.held ELSE n.v END, NOT ({later}) FROM r JOIN n ON n.k = r.k AND n.i = r.i + 1)
SELECT k, seq, held, went_on FROM r"""


@query(f"WITH RECURSIVE {EV}" + _STEP.format(src="ev", first="abs(v - 0) < 5000", later="abs(n.v - r.held) < 5000"))
def cutoff_epsilon(spark, d):
    return cutoff.cutoff(tables.events(spark, d), ["k"], cutoff.within(5000))


@query(f"WITH RECURSIVE {EV}, e AS (SELECT *, 1000 + 200 * version AS eps FROM ev)" + _STEP.format(src="e", first="abs(v - 0) < eps", later="abs(n.v - r.held) < n.eps"))
def cutoff2_epsilon_cell(spark, d):
    log = tables.events(spark, d).withColumn("eps", 1000 + 200 * F.col("version"))
    return cutoff.cutoff_by_cell(log, ["k"], "eps", lambda eps, old, new: abs(new - old) < eps)


@query(f"WITH {EV} SELECT k, seq, CAST(0 AS BIGINT) AS held, false AS went_on FROM ev")
def cutoff_always(spark, d):
    return cutoff.always(tables.events(spark, d).select("k", "seq", "v"))


@query(f"WITH {EV} SELECT k, seq, v AS held, true AS went_on FROM ev")
def cutoff_never(spark, d):
    return cutoff.never(tables.events(spark, d).select("k", "seq", "v"))


@query(f"WITH {EV} SELECT k, seq, v AS held, v <> coalesce(lag(v) OVER (PARTITION BY k ORDER BY seq), 0) AS went_on FROM (SELECT k, seq, v // 10000 AS v FROM ev)")
def cutoff_equal(spark, d):
    log = tables.events(spark, d).select("k", "seq", F.floor(F.col("v") / 10000).alias("v"))
    return cutoff.unchanged(log, ["k"])


@query("SELECT CAST(2 AS BIGINT) AS refreshes, count(*) AS n FROM nation")
def sentinel_refresh(spark, d):
    source = cells.Func(lambda: tables.load(spark, d, "nation").agg(F.count("*").alias("n")))
    answers = iter([False, True, False])
    guard = cutoff.Sentinel(lambda: next(answers), source.set_stale)
    for _ in range(3):
        guard.check()
        source.value()
    guard.unwatch()
    guard.check()
    return source.value().select(F.lit(source.calls).cast("long").alias("refreshes"), "n")


# time


@query("SELECT event_id, ts >= TIMESTAMP '2024-01-15 12:00:00' AS due FROM events")
def at_flag(spark, d):
    when = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    return tables.load(spark, d, "events").select("event_id", time.at(F.col("ts"), when).alias("due"))


@query("SELECT event_id, CAST((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // 21600000000 AS BIGINT) AS n FROM events")
def at_intervals(spark, d):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return tables.load(spark, d, "events").select("event_id", time.at_intervals(F.col("ts"), start, 21600).alias("n"))


@query("SELECT user_id AS k, event_id AS seq, max(ts + INTERVAL 1 HOUR * (event_id % 5)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::VARCHAR AS now FROM events")
def clock_monotone(spark, d):
    ticks = tables.load(spark, d, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("seq"), (F.col("ts") + F.make_dt_interval(hours=F.col("event_id") % 5)).alias("tick"))
    return time.monotone(ticks, ["k"], "seq").select("k", "seq", F.col("now").cast("string").alias("now"))


@query(f"WITH {EV}, p AS (SELECT k, version, arg_max(v, seq) AS v FROM ev GROUP BY k, version), t AS (SELECT k, arg_min(v, version) FILTER (version >= 10) AS s, min(version) FILTER (version >= 10) AS at_v FROM p GROUP BY k) SELECT p.k, p.version, CASE WHEN p.version >= t.at_v THEN t.s ELSE -1 END AS snapshot, coalesce(p.version >= t.at_v, false) AS taken FROM p JOIN t ON p.k = t.k")
def snapshot_at(spark, d):
    passes = cells.latest_per_pass(tables.events(spark, d), ["k"])
    return time.snapshot(passes, ["k"], F.lit(10), -1, tick="version").select("k", "version", "snapshot", "taken")


_STEPS = [(datetime(2024, 1, 20), 30), (datetime(2024, 1, 5), 10), (datetime(2024, 1, 12, 6), 20), (datetime(2024, 1, 12, 6), 21)]


@query("SELECT event_id, CASE WHEN ts >= TIMESTAMP '2024-01-20' THEN 30 WHEN ts >= TIMESTAMP '2024-01-12 06:00:00' THEN 21 WHEN ts >= TIMESTAMP '2024-01-05' THEN 10 ELSE 0 END AS step FROM events")
def step_function_ties(spark, d):
    ticks = tables.load(spark, d, "events").select("event_id", F.col("ts").alias("tick"))
    return time.step_function(ticks, _STEPS, 0).select("event_id", "step")


@query("WITH s AS (SELECT user_id AS k, ts AS t, event_id AS o, CAST(event_id AS BIGINT) AS value FROM events WHERE event_type = 'purchase') SELECT e.user_id AS k, e.event_id, coalesce(s.value, 0) AS step FROM events e ASOF LEFT JOIN s ON e.user_id = s.k AND e.ts >= s.t")
def step_table_asof(spark, d):
    e = tables.load(spark, d, "events")
    ticks = e.select(F.col("user_id").alias("k"), "event_id", F.col("ts").alias("tick"))
    steps = e.where("event_type = 'purchase'").select(F.col("user_id").alias("k"), F.col("ts").alias("at"), F.col("event_id").alias("ord"), F.col("event_id").alias("value"))
    return time.step_table(ticks, steps, 0).select("k", "event_id", "step")


@query("""WITH RECURSIVE n AS (SELECT user_id AS k, event_id AS seq, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
r AS (SELECT k, seq, i, t AS last, true AS fired FROM n WHERE i = 1 UNION ALL SELECT n.k, n.seq, n.i, CASE WHEN n.t - r.last >= 21600000000 THEN n.t ELSE r.last END, n.t - r.last >= 21600000000 FROM r JOIN n ON n.k = r.k AND n.i = r.i + 1)
SELECT k, seq, fired FROM r""")
def timer_throttle(spark, d):
    return time.throttle(tables.events(spark, d), ["k"], 21600)


@query("""WITH t AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-30 00:00:00', INTERVAL 1 HOUR)) AS tick), f AS (SELECT DISTINCT event_type FROM events),
g AS (SELECT event_type, tick FROM f, t), b AS (SELECT event_type AS et, ts FROM events)
SELECT g.event_type, CAST(g.tick AS VARCHAR) AS tick, coalesce(epoch_us(g.tick) - epoch_us(b.ts) < 3600000000, false) AS healthy FROM g ASOF LEFT JOIN b ON g.event_type = b.et AND g.tick >= b.ts""")
def staleness_monitor(spark, d):
    grid = spark.sql("SELECT explode(sequence(TIMESTAMP_NTZ '2024-01-01 00:00:00', TIMESTAMP_NTZ '2024-01-30 00:00:00', INTERVAL 1 HOUR)) AS tick")
    beats = tables.load(spark, d, "events").select("event_type", "ts")
    return time.staleness(beats, grid, "event_type", 3600).select("event_type", F.col("tick").cast("string").alias("tick"), "healthy")


# plans that depend on data


@query("SELECT CASE WHEN (SELECT count(*) FROM nation) > 20 THEN (SELECT max(c_custkey) FROM customer) ELSE (SELECT max(s_suppkey) FROM supplier) END AS v")
def bind_branch(spark, d):
    many = tables.load(spark, d, "nation").agg(F.count("*").alias("n"))
    pick = lambda scope, n: tables.load(spark, d, "customer").agg(F.max("c_custkey").alias("v")) if n > 20 else tables.load(spark, d, "supplier").agg(F.max("s_suppkey").alias("v"))
    return bind.Bind(pick, lambda: many).value()


@query("SELECT max(p_partkey) AS v FROM part")
def bind_if(spark, d):
    test = lambda: tables.load(spark, d, "region").agg((F.count("*") > 100).alias("b"))
    no_such = lambda scope: tables.load(spark, d, "no_such_table")
    return bind.bind_if(test, no_such, lambda scope: tables.load(spark, d, "part").agg(F.max("p_partkey").alias("v"))).value()


@query("SELECT count(*) AS n FROM orders WHERE o_orderkey BETWEEN (SELECT count(*) FROM region) AND (SELECT count(*) FROM region) * (SELECT count(*) FROM nation)")
def bind2_range(spark, d):
    n = lambda t: lambda: tables.load(spark, d, t).agg(F.count("*").alias("n"))
    build = lambda scope, a, b: keyed.subrange(tables.load(spark, d, "orders"), "o_orderkey", a, a * b).agg(F.count("*").alias("n"))
    return bind.Bind(build, n("region"), n("nation")).value()


@query("SELECT o_orderpriority AS p, count(*) AS n, CAST(2 AS BIGINT) AS builds FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1")
def bind_memoized(spark, d):
    builds, wanted = [], iter(["1-URGENT", "5-LOW", "1-URGENT"])

    def build(p):
        builds.append(p)
        return tables.load(spark, d, "orders").where(F.col("o_orderpriority") == p).groupBy(F.col("o_orderpriority").alias("p")).agg(F.count("*").alias("n"))

    value = bind.bind_memoized(build, lambda: spark.createDataFrame([(next(wanted),)], "p string"))
    for _ in range(2):
        value()
    return value().withColumn("builds", F.lit(len(builds)).cast("long"))


@query("SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_nationkey = 7")
def join_flatten(spark, d):
    pointer = spark.createDataFrame([(7,)], "k int")
    return bind.join_pointer(pointer, tables.load(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v")), "k")


# scalars


@query("SELECT c_custkey, md5(c_name) AS txt, right(md5(c_name), 8) AS short, false AS zero, '\"' || md5(c_name) || '\"' AS js, true AS same, true AS bad FROM customer")
def identifiers_round_trip(spark, d):
    ident = identifiers.parse(F.md5(F.col("c_name").cast("binary")))
    back = identifiers.from_json(identifiers.to_json(ident))
    return tables.load(spark, d, "customer").select("c_custkey", identifiers.text(ident).alias("txt"), identifiers.short(ident).alias("short"), identifiers.is_zero(ident).alias("zero"), identifiers.to_json(ident).alias("js"), (back == ident).alias("same"), identifiers.parse(F.col("c_name")).isNull().alias("bad"))


@query("SELECT * FROM (VALUES (0, 'added'), (1, 'removed'), (2, 'updated'), (3, 'unknown')) AS t(kind, name)")
def change_kind_names(spark, d):
    return spark.createDataFrame([(0,), (1,), (2,), (3,)], "kind int").select("kind", identifiers.kind_name(F.col("kind")).alias("name"))


@query("SELECT n_nationkey, 1 AS ok FROM nation")
def identifiers_unique(spark, d):
    both = identifiers.sequential(tables.load(spark, d, "nation").select("n_nationkey").withColumn("r", identifiers.new()))
    return both.select("n_nationkey", ((F.octet_length("id") == 16) & (F.octet_length("r") == 16)).cast("int").alias("ok"))


# streams: the same results from passes


def _passes(spark, d, groups=3):
    log = tables.events(spark, d).select("k", "version", "seq", "v", "ts")
    return log, runner.stream(spark, *runner.passes(log, "version", groups))


@query(f"WITH RECURSIVE {EV}" + _STEP.format(src="ev", first="abs(v - 0) < 5000", later="abs(n.v - r.held) < 5000").replace("SELECT k, seq, held, went_on FROM r", "SELECT k, seq, held FROM r WHERE went_on"))
def stream_cutoff_epsilon(spark, d):
    _, s = _passes(spark, d)
    out = stateful.cutoff(s, [("k", "long")], lambda old, new: abs(new - old) < 5000)
    return runner.Passes(out).run().select("k", "seq", "held")


@query(f"WITH {EV} SELECT CAST(sum(v) AS BIGINT) AS total, CAST(3 AS BIGINT) AS passes FROM ev")
def stream_fold_sum(spark, d):
    _, s = _passes(spark, d)
    fold = runner.Maintained()
    runner.Passes(s, lambda batch, n: fold.take(n, batch.agg(F.coalesce(F.sum("v"), F.lit(0))).first()[0])).run()
    return spark.createDataFrame([(fold.total, len(fold.history))], "total long, passes long")


@query(f"WITH {EV} SELECT k, arg_min(seq, seq) AS seq, arg_min(v, seq) AS v FROM ev GROUP BY k")
def stream_freeze(spark, d):
    _, s = _passes(spark, d)
    return runner.Passes(stateful.freeze(s, [("k", "long")])).run().select("k", "seq", "v")


@query(SQL["timer_throttle"].replace("SELECT k, seq, fired FROM r", "SELECT k, seq FROM r WHERE fired"))
def stream_timer(spark, d):
    _, s = _passes(spark, d)
    timed = s.withColumn("t", time.micros(F.col("ts")))
    return runner.Passes(stateful.throttle(timed, [("k", "long")], 21_600_000_000)).run().select("k", "seq")


@query(f"WITH {EV} SELECT k, list(v ORDER BY seq) AS vs FROM ev GROUP BY k")
def stream_watch(spark, d):
    _, s = _passes(spark, d)
    return cell.history(runner.Passes(s.select("k", "seq", "v")).run(), ["k"])


# Python functions


@query("SELECT c_custkey, reverse(c_name) AS back FROM customer")
def udf_scalar(spark, d):
    def back(s):
        return None if s is None else s[::-1]

    return tables.load(spark, d, "customer").select("c_custkey", udfs.scalar(back, "string")("c_name").alias("back"))


@query(f"WITH {EV} SELECT event_type, CAST(max(v % 1000) AS BIGINT) AS most FROM ev GROUP BY event_type")
def udaf_fold(spark, d):
    most = udfs.aggregate(lambda v: int(v) % 1000, max, "long")
    return tables.events(spark, d).groupBy("event_type").agg(most("v").alias("most"))


@query("SELECT n_nationkey, CAST(unnest(generate_series(0, n_nationkey % 3)) AS INT) AS i FROM nation")
def udtf_expand(spark, d):
    spark.udtf.register("count_up", udfs.table(lambda n: ((i,) for i in range(n % 3 + 1)), "i int"))
    tables.load(spark, d, "nation").createOrReplaceTempView("deltaweave_nation")
    return spark.sql("SELECT n_nationkey, i FROM deltaweave_nation, LATERAL count_up(n_nationkey)")


@query("SELECT CAST(2 AS BIGINT) AS made, (SELECT count(*) FROM nation) AS nations, (SELECT count(*) FROM region) AS regions")
def session_pass(spark, d):
    s = Session(spark)
    s.source("nation", lambda: tables.load(spark, d, "nation"))
    s.source("region", lambda: tables.load(spark, d, "region"))
    n = s.derive("n", lambda a, b: a.agg(F.count("*").alias("nations")).crossJoin(b.agg(F.count("*").alias("regions"))), "nation", "region")
    found = s.observe("n")
    s.run()
    s.set("region", lambda: tables.load(spark, d, "region"))
    s.run()
    return found.value().select(F.lit(n.recomputes).cast("long").alias("made"), "nations", "regions")


@query(f"WITH {V1} SELECT CAST(sum(v * 2) AS BIGINT) AS total, CAST(1 AS BIGINT) AS from_changes, CAST(2 AS BIGINT) AS made FROM v1 WHERE v % 2 = 0")
def session_delta_pass(spark, d):
    s = Session(spark)
    s.keyed("book", tables.book(spark, d, 0), "k", 16)
    s.keep("doubled", _doubled(), "book")
    total = s.keep("total", agg.total("k"), "doubled")
    found = s.observe("total")
    s.run()
    s.change("book", changes_of(spark, d))
    s.run()
    s.run()
    return found.value().select("total", F.lit(total.kept_up).cast("long").alias("from_changes"), F.lit(total.recomputes).cast("long").alias("made"))


@query("SELECT CAST(1 AS BIGINT) AS above, CAST(2 AS BIGINT) AS parity_made, CAST(1 AS BIGINT) AS parity_changed, count(*) % 2 AS parity FROM nation")
def session_cutoff_stops(spark, d):
    s = Session(spark)
    s.source("n", lambda: tables.load(spark, d, "nation").agg(F.count("*").alias("n")))
    parity = s.derive("parity", lambda n: n.select((F.col("n") % 2).alias("parity")), "n", cutoff=same_rows)
    above = s.derive("above", lambda p: p.select("parity"), "parity")
    found = s.observe("above")
    s.run()
    s.set("n", lambda: tables.load(spark, d, "nation").agg((F.count("*") + 2).alias("n")))
    s.run()
    made = [F.lit(x).cast("long").alias(c) for c, x in (("above", above.recomputes), ("parity_made", parity.recomputes), ("parity_changed", parity.changed))]
    return found.value().select(*made, "parity")


@query("SELECT CAST(6 AS BIGINT) AS recomputed, CAST(5 AS BIGINT) AS changed, CAST(0 AS BIGINT) AS idle, 'region' AS heard FROM region LIMIT 1")
def session_recompute_counts(spark, d):
    s, heard = Session(spark), []
    s.source("nation", lambda: tables.load(spark, d, "nation"), cutoff=same_rows)
    s.source("region", lambda: tables.load(spark, d, "region"))
    n = s.derive("n", lambda a, b: a.agg(F.count("*").alias("n")), "nation", "region")
    n.on_input_changed.append(heard.append)
    s.derive("idle", lambda a: a, "nation")
    s.observe("n")
    s.run()
    heard.clear()
    s.set("nation", lambda: tables.load(spark, d, "nation"))
    s.run()
    s.set("region", lambda: tables.load(spark, d, "region"))
    s.run()
    counts = [F.lit(x).cast("long").alias(c) for c, x in (("recomputed", s.counters["recomputed"]), ("changed", s.counters["changed"]), ("idle", s.operators["idle"].recomputes))]
    return spark.range(1).select(*counts, F.lit(",".join(heard)).alias("heard"))


@query("SELECT CAST(2 AS BIGINT) AS always, CAST(1 AS BIGINT) AS once, count(*) AS n FROM region")
def session_always(spark, d):
    s = Session(spark)
    s.source("region", lambda: tables.load(spark, d, "region"))
    s.derive("n", lambda a: a.agg(F.count("*").alias("n")), "region", always=True)
    found = s.observe("n")
    s.run()
    s.run()
    made = [F.lit(s.operators[x].recomputes).cast("long").alias(c) for c, x in (("always", "n"), ("once", "region"))]
    return found.value().select(*made, "n")


@query("SELECT count(*) * 2 AS n, CAST(1 AS BIGINT) AS early, CAST(3 AS BIGINT) AS passes, CAST(4 AS BIGINT) AS recomputed, CAST(1 AS BIGINT) AS height FROM nation")
def session_by_hand(spark, d):
    s = Session(spark)
    nation = lambda: tables.load(spark, d, "nation")
    s.source("nation", nation)
    n = s.derive("n", lambda a: a.agg(F.count("*").alias("n")), "nation")
    s.observe("n")
    for name in s.start_pass():
        s.recompute(name)
    s.end_pass()
    s.set("nation", lambda: nation().union(nation()))
    s.start_pass()
    s.recompute("nation")  # and not what is above
    s.end_pass()
    early = n.recomputes
    for name in s.start_pass():
        s.recompute(name)
    s.recompute("n")  # made again only if an input changed in this pass
    s.end_pass()
    status, view = s.status(), s.view("n")
    said = (("early", early), ("passes", status["passes"]), ("recomputed", status["recomputed"]), ("height", view["height"]))
    return view["value"].select("n", *(F.lit(x).cast("long").alias(c) for c, x in said))


@query("SELECT count(*) + (SELECT count(*) FROM region) AS n, CAST(3 AS BIGINT) AS made, 'region' AS freed FROM nation")
def session_links(spark, d):
    s, freed = Session(spark), []
    for name in ("nation", "region", "supplier"):
        s.source(name, lambda name=name: tables.load(spark, d, name).select(F.lit(1).alias("x")))
    s.operators["region"].on_unnecessary.append(lambda: freed.append("region"))
    n = s.derive("n", lambda *t: functools.reduce(DataFrame.union, t).agg(F.count("*").alias("n")), "nation")
    found = s.observe("n")
    s.run()
    s.link("n", "region")
    s.run()
    both = found.value().first()[0]
    s.unlink("n", "region")
    s.run()
    return found.value().select(F.lit(both).alias("n"), F.lit(n.recomputes).cast("long").alias("made"), F.lit(",".join(freed)).alias("freed"))


def entry(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: total of the latest values per pass."""
    return QUERIES["latest_total_per_day"](spark, d)
