"""Sharding by sampled splitters.

The key is (hash of the text, id, number of the row), so equal texts lie side by side. Rows are drawn with a chance in
proportion to their size, the sample's quantiles become boundaries of ranges, and rows are dealt to ranges by
them. Ranges that turn out overfull, in bytes or in rows, are divided by boundaries drawn again inside them. Sums
over the ranges place each range in the whole order, and an order within the range places each row.

Equal texts form a group. Boundaries of ranges fall between groups, but for groups that hold more than 1 part in
``PARTS`` of a shard's bytes or rows, which have ranges of their own. These are dealt to shards first, largest
first, each to the shard with the most room; one that fits in none is divided. The other groups follow in their
order: a shard ends where its share of all bytes does, and a group goes where its middle lies. So shards differ
from equal shares by about one ``PARTS``-th, and equal texts share a shard unless no shard has room for them.

To the driver go a sample of bounded size (``PER_RANGE`` keys a range, at most ``MOST_RANGES`` ranges) and at most
2 * ``PARTS`` groups a shard. Tasks hold one range at a time.

Nulls: a null text has no bytes (size is the overhead alone) and crc 0; a null id sorts first. Repeated
rows are kept, each in a slot of its own. No documents: no rows. Own columns are not read and never clash.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from deltaweave.llm.staging import stage

OVERHEAD = 16
RANGES = 1024
MOST_RANGES = 16_384
ROWS_PER_RANGE = 1_000_000
PER_RANGE = 24
OVERFULL = 3.0
ROUNDS = 4
PARTS = 64
LEAST = -(2**63)

#: (hash, id, row)
Key = tuple[int, int, int]


def _draw(seed: int) -> Column:
    return (F.xxhash64(F.lit(seed), "_h", "_i", "_u") / F.lit(2.0**64)) + 0.5


def _ranged(rows: DataFrame, bounds: list[Key]) -> DataFrame:
    """Add ``_range``: how many boundaries are at or below the row's key."""
    edges = np.array(bounds, np.int64).reshape(-1, 3)

    def place(h: pd.Series, i: pd.Series, u: pd.Series) -> pd.Series:
        keys = [np.concatenate([edges[:, k], x.to_numpy(np.int64)]) for k, x in enumerate((h, i, u))]
        is_row = np.arange(len(keys[0])) >= len(edges)
        order = np.lexsort((is_row, *reversed(keys)))  # a boundary comes before a row of the same key
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(~is_row[order])
        return pd.Series(out[len(edges) :])

    return rows.withColumn("_range", F.pandas_udf(place, "long")("_h", "_i", "_u"))


def _boundaries(sample: list[Key], pieces: int, parted: set[int]) -> set[Key]:
    """Quantiles of a size-weighted sample; before the group they fall in, unless it is one of ``parted``."""
    sample = sorted(sample)
    picked = {sample[len(sample) * k // pieces] for k in range(1, pieces)} if sample else set()
    return {x if x[0] in parted else (x[0], LEAST, LEAST) for x in picked}


def splitters(rows: DataFrame, parted: set[int] = frozenset(), ranges: int = RANGES, per_range: int = PER_RANGE, overfull: float = OVERFULL, rounds: int = ROUNDS, seed: int = 10) -> tuple[list[Key], list[tuple[int, int, int]]]:
    """Boundaries over (_h, _i, _u) of rows with ``size``, and (range, bytes, rows) of every range that has rows. The
    groups ``parted`` have ranges of their own; the others are never divided."""
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if not n:
        return [], []
    ranges = max(ranges, min(n // ROWS_PER_RANGE, MOST_RANGES))
    wanted = ranges * per_range
    chance = F.col("size") * (wanted / max(total, 1)) / 2 + F.lit(wanted / n / 2)
    drawn = rows.where(_draw(seed) < chance).select("_h", "_i", "_u")
    found = {(h, LEAST, LEAST) for h in parted} | {(h + 1, LEAST, LEAST) for h in parted if h < 2**63 - 1}
    bounds = sorted(found | _boundaries([tuple(x) for x in drawn.collect()], ranges, parted))
    for k in range(1, rounds + 1):
        placed = _ranged(rows, bounds)
        filled = [tuple(x) for x in placed.groupBy("_range").agg(F.sum("size"), F.count("*")).collect()]
        heavy = {r: (size, count) for r, size, count in filled if (size > overfull * total / ranges and count > 1) or count > max(overfull * n / ranges, 64)}
        if not heavy or k == rounds:
            break
        drawn = placed.where(F.col("_range").isin(list(heavy)) & (_draw(seed + k) < chance * 4)).select("_range", "_h", "_i", "_u")
        by: dict[int, list[Key]] = {}
        for r, *key in drawn.collect():
            by.setdefault(r, []).append(tuple(key))
        more = set(bounds)
        for r, (size, count) in heavy.items():
            more |= _boundaries(by.get(r, []), 2 * int(max(size * ranges / max(total, 1), count * ranges / n) + 1), parted)
        if len(more) == len(bounds):
            break
        bounds = sorted(more)
    return bounds, sorted(filled)


def _deal(groups: list[tuple[int, int, int]], shards: int, share: float) -> tuple[dict[int, tuple[int, int]], list[float]]:
    """({hash: (shard, rows before it in the shard)} of the groups (hash, bytes, rows) that fit, room left in each shard)."""
    room = [(-share, s) for s in range(shards)]
    heapq.heapify(room)
    rows, dealt = [0] * shards, {}
    for h, size, count in sorted(groups, key=lambda g: (-g[1], g[0])):
        left, s = room[0]
        if size <= -left:
            heapq.heapreplace(room, (left + size, s))
            dealt[h] = (s, rows[s])
            rows[s] += count
    return dealt, [-left for left, _ in sorted(room, key=lambda x: x[1])]


def _placed(docs: DataFrame, keep: list[Column], shards: int, doc_id: str, text: str, overhead: int, ranges: int, seed: int) -> DataFrame:
    """``keep``, ``size``, ``text_crc32``, ``shard`` and ``slot`` of every row."""
    body = F.col(f"`{text}`")
    rows = docs.select(
        F.struct(*keep).alias("_keep"),
        (F.coalesce(F.octet_length(body), F.lit(0)) + overhead).cast("long").alias("size"),
        F.coalesce(F.crc32(body.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(body).alias("_h"),
        F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LEAST)).alias("_i"),
        F.monotonically_increasing_id().alias("_u"),
    )
    rows = stage(rows, "shard-rows")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    share = total / shards
    groups = rows.groupBy("_h").agg(F.sum("size").alias("b"), F.count("*").alias("c")).where((F.col("c") > 1) & ((F.col("b") > share / PARTS) | (F.col("c") > n / shards / PARTS)))
    groups = [tuple(x) for x in groups.collect()]  # at most 2 * PARTS a shard
    dealt, room = _deal(groups, shards, share)
    bounds, filled = splitters(rows, {g[0] for g in groups}, ranges, seed=seed)

    parted = {g[0] for g in groups}
    starts, at, row, inside = [], 0, 0, {}
    for r, size, count in filled:
        h = bounds[r - 1][0] if r else None
        if h in dealt:  # a group that stays whole
            s, before = dealt[h]
            starts.append((r, "whole", s, 0, before + inside.get(h, 0)))
            inside[h] = inside.get(h, 0) + count
        else:
            starts.append((r, "parted" if h in parted else "many", 0, at, row))
            at, row = at + size, row + count
    starts = docs.sparkSession.createDataFrame(starts, "_r long, _kind string, _shard int, _at long, _row long")
    ends = np.cumsum(room)[:-1]

    def shard_of(middle: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(ends, middle.to_numpy(), side="right").astype(np.int32))

    w = Window.partitionBy("_range").orderBy("_h", "_i", "_u").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    group = Window.partitionBy("_range", "_h")
    placed = _ranged(rows, bounds).withColumns({"_upto": F.sum("size").over(w), "_nth": F.count("*").over(w)})
    placed = placed.withColumns({"_first": F.min(F.col("_upto") - F.col("size")).over(group), "_end": F.max("_upto").over(group)})
    placed = placed.join(F.broadcast(starts), F.col("_range") == F.col("_r"))  # one row a range
    middle = F.when(F.col("_kind") == "many", (F.col("_first") + F.col("_end")) / 2).otherwise(F.col("_upto") - F.col("size") / 2) + F.col("_at")
    whole = F.col("_kind") == "whole"
    placed = placed.withColumn("shard", F.when(whole, F.col("_shard")).otherwise(F.pandas_udf(shard_of, "int")(middle)))
    placed = stage(placed.select("_keep", "size", "text_crc32", "shard", whole.alias("_whole"), (F.col("_row") + F.col("_nth") - 1).alias("_place")), "shard-placed")
    first = placed.where("not _whole").groupBy("shard").agg(F.min("_place").alias("_first"), F.count("*").alias("_n")).withColumnRenamed("shard", "_sh")
    out = placed.join(F.broadcast(first), F.col("shard") == F.col("_sh"), "left")  # one row per shard
    slot = F.col("_place") + F.when(F.col("_whole"), F.coalesce("_n", F.lit(0))).otherwise(-F.col("_first"))
    return out.select("_keep.*", "size", "text_crc32", "shard", slot.cast("long").alias("slot"))


def shard(docs: DataFrame, shards: int = 40, *, doc_id: str = "doc_id", text: str = "text", overhead: int = OVERHEAD, ranges: int = RANGES, seed: int = 10) -> DataFrame:
    """The documents' ids with ``size``, ``text_crc32``, ``shard``, ``slot`` (from 0 without gaps in the shard); shards
    have about equal bytes."""
    return _placed(docs, [F.col(f"`{doc_id}`").alias(doc_id)], shards, doc_id, text, overhead, ranges, seed)


def write_shards(docs: DataFrame, path: str, shards: int = 40, *, rows_per_file: int = 1_000_000, doc_id: str = "doc_id", text: str = "text", overhead: int = OVERHEAD, ranges: int = RANGES, seed: int = 10) -> None:
    """Write the documents, every row once, as one folder per shard, whose files hold ``rows_per_file`` consecutive
    slots each, in their order. Own columns named ``shard`` and ``slot`` give way to the shards'."""
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    own = "_row" + "_" * max((len(c) for c in names), default=0)  # no column has this name
    numbered = stage(docs.select(*(F.col(f"`{c}`") for c in names), F.monotonically_increasing_id().alias(own)), "shard-docs")
    placed = _placed(numbered, [F.col(own)], shards, doc_id, text, overhead, ranges, seed)
    joined = numbered.join(placed.select(own, "shard", "slot"), own).select(*(F.col(f"`{c}`") for c in names), "shard", "slot")
    joined.repartition("shard", F.floor(F.col("slot") / rows_per_file)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
