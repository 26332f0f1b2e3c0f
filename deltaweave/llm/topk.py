"""Exact top-k inner products by block-at-a-time pruning.

Vectors are ordered so that alike ones lie together (by their strongest term and its sign), and consecutive
ranges become blocks with a forward index (the rows themselves) and the greatest and least value of each
term. For a query, the sum over terms of the query's weight times the block's extreme bounds every score in
the block. Blocks are scored in order of falling bound until the bound is below the k-th best score so far;
a block whose bound equals it is still scored, for ties go to the smaller id.

The k-th score starts from a bounded sample of vectors (``SEEDS`` about, ``SEED_BYTES`` at most), scored against all
queries, so pruning holds across tasks. Queries travel in batches of ``BATCH``. A batch meets the bounds of whole
groups of blocks first, ``TOGETHER`` groups a row, and a group gets those queries alone whose floor its bound
reaches; tasks hold one group and one batch's queries. Only the best of a task leave it. How much is passed over
depends on the vectors: in clusters most blocks are, of vectors drawn evenly from a sphere of many dimensions none.

Scores are whole numbers; products of doubles are exact below 2**53, and larger ones use Python integers,
held within 64 bits at the ends.

Nulls: vectors that are null or hold a null or non-finite component, and rows without an id, take no part. Vectors
of other lengths, and empty ones, are compared among themselves. Rows that repeat an id are rows of their own: each
asks, and is a candidate of the others. No vectors: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from deltaweave.llm.staging import stage

BLOCK, GROUP, BATCH, TOGETHER = 64, 2048, 1024, 4096
SEEDS, SEED_BYTES = 1024, 16_000_000
EXACT = 2.0**53


def valid(vector: Column) -> Column:
    """True for a vector of finite components; an empty one has no others."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.forall(vector, fine), F.lit(False))


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whole inner products, one row a query."""
    if np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * queries.shape[1] < EXACT:
        return (queries @ rows.T).astype(np.int64)
    exact = np.array([[int(x) for x in q] for q in queries], object) @ np.array([[int(x) for x in r] for r in rows], object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def best_of(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, by falling score and then id."""
    if len(score) > 4 * k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= cut)
        return near[np.lexsort((ids[near], -score[near]))[:k]]
    return np.lexsort((ids, -score))[:k]


def bounds(queries: np.ndarray, top: np.ndarray, low: np.ndarray) -> np.ndarray:
    """No score of a query with a row between ``low`` and ``top`` is greater; one row a query."""
    bound = np.maximum(queries, 0) @ top.T + np.minimum(queries, 0) @ low.T
    slack = 1e-9 * (np.abs(queries) @ np.maximum(np.abs(top), np.abs(low)).T)  # for sums past 2**53 alone
    return np.where(slack * 1e9 < EXACT, bound, bound + slack)


def search_group(queries: np.ndarray, floor: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(place of the query, id, score) of the k best of one group for each query that can pass its floor, and blocks
    scored. Blocks are scored in runs of 1, 2, 4 and so on, without those whose bound is below the k-th score."""
    edges = np.arange(0, len(rows), block)
    bound = bounds(queries, np.maximum.reduceat(rows, edges), np.minimum.reduceat(rows, edges))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    scored = 0
    for n in range(len(queries)):
        order = np.argsort(-bound[n], kind="stable")
        falling = bound[n, order]
        kth = floor[n]
        score, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, run = 0, 1
        while at < len(order) and falling[at] >= kth:
            stop = min(at + run, int(np.count_nonzero(falling >= kth)))
            part = (edges[order[at:stop], None] + np.arange(block)).ravel()
            part = part[part < len(rows)]
            s, i = _scores(queries[n : n + 1], rows[part])[0], ids[part]
            scored += stop - at
            at, run = stop, 2 * run
            keep = s >= kth
            score, found = np.concatenate([score, s[keep]]), np.concatenate([found, i[keep]])
            if len(score) >= k:
                best = best_of(score, found, k)
                score, found = score[best], found[best]
                kth = max(kth, score[-1])
        if len(score):
            best = best_of(score, found, k)
            out.append((np.full(len(best), n), found[best], score[best]))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, scored
    q, i, s = (np.concatenate(x) for x in zip(*out))
    return q, i, s, scored


def _numbers(raw: bytes, kind: type = np.float64, dim: int | None = None) -> np.ndarray:
    out = np.frombuffer(raw, kind) if raw else np.zeros(0, kind)
    return out if dim is None else out.reshape(-1, dim)


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Rows (id, v, dim) in runs of ``size`` of one dim within a partition, ids and values packed, with the greatest and
    least value of each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray, np.ndarray]] = []

        def flush(dim: int) -> pa.RecordBatch:
            ids = np.concatenate([x[1] for x in held])
            values = np.concatenate([x[2] for x in held])
            wide = values.reshape(len(ids), dim)
            held.clear()
            packed = {"ids": ids, "data": values, "top": wide.max(axis=0), "low": wide.min(axis=0)}
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), **{n: pa.array([x.tobytes()], pa.binary()) for n, x in packed.items()}})

        count = 0
        for batch in batches:
            dims = batch.column(2).to_numpy()
            ids = batch.column(0).to_numpy()
            flat = batch.column(1).flatten().to_numpy().astype(np.float64)
            at = np.concatenate([[0], np.cumsum(dims)])
            n = 0
            while n < len(dims):
                if held and (count == size or held[0][0] != dims[n]):
                    yield flush(held[0][0])
                    count = 0
                same = np.flatnonzero(dims[n:] != dims[n])
                stop = min(n + (int(same[0]) if len(same) else len(dims) - n), n + size - count)
                held.append((int(dims[n]), ids[n:stop], flat[at[n] : at[stop]]))
                count += stop - n
                n = stop
        if held:
            yield flush(held[0][0])

    return rows.select("id", "v", "dim").mapInArrow(run, "dim int, ids binary, data binary, top binary, low binary")


def top_k(vectors: DataFrame, queries: Column, k: int = 10, *, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 1024) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of the k best of all other rows for each row for
    which ``queries`` holds. Components count as floor(scale * x).

    A query is looked for among all rows, itself included, and k + 1 are kept; then one row of its id and of its
    score with itself is left out. It is itself or cannot be told from it.
    """
    whole = F.transform(F.col(embedding), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    rows = vectors.where(valid(F.col(embedding)) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), whole.alias("v"), queries.alias("_query"))
    rows = rows.withColumn("dim", F.size("v"))
    most = F.array_max(F.transform("v", F.abs))
    lead = F.array_position(F.transform("v", F.abs), most)
    rows = rows.withColumn("_lead", lead * 2 + (F.try_element_at("v", lead.cast("int")) > 0).cast("int"))
    n, widest = rows.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(0))).first()
    groups = max(1, -(-n // GROUP))
    ordered = rows.repartitionByRange(groups, "dim", "_lead", "id").sortWithinPartitions("dim", "_lead", "id")
    index = stage(_packed(ordered, GROUP).withColumn("group", F.monotonically_increasing_id()), "topk-index")

    few = max(k + 1, min(SEEDS, SEED_BYTES // (32 * max(widest, 1))))
    seeds = rows.where(F.xxhash64(F.lit(1), "id") / F.lit(2.0**64) + 0.5 <= min(1.0, few / max(n, 1))).orderBy("id").limit(4 * few)
    seeds = [(r.dim, np.array(r.v)) for r in seeds.select("dim", "v").collect()]  # at most 4 ``few`` rows, ``SEED_BYTES``
    samples = {dim: np.array([v for d, v in seeds if d == dim]).reshape(-1, dim) for dim in {d for d, _ in seeds} if dim}
    batches = max(1, -(-n // (100 * BATCH)))
    asked = rows.where("_query").repartition(batches, "id").sortWithinPartitions("dim", "id")

    def floors(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for r in range(part.num_rows):
                dim, ids, data = (part.column(c)[r].as_py() for c in range(3))
                floor = np.full(len(ids) // 8, -(2**63), np.int64)
                sample = samples.get(dim, ())
                if len(sample) > k:  # the k + 1 best of the sample are candidates
                    floor = np.partition(_scores(_numbers(data, dim=dim), sample), len(sample) - k - 1, axis=1)[:, len(sample) - k - 1]
                yield pa.RecordBatch.from_arrays([part.column(c).slice(r, 1) for c in range(3)] + [pa.array([floor.tobytes()], pa.binary())], ["dim", "ids", "data", "floors"])

    asked = _packed(asked, BATCH).mapInArrow(floors, "dim int, ids binary, data binary, floors binary")
    asked = stage(asked.withColumn("batch", F.monotonically_increasing_id()), "topk-queries")
    shares = max(1, -(-groups // TOGETHER))
    kept = index.select("dim", F.pmod(F.xxhash64("group"), F.lit(shares)).alias("_share"), F.struct("group", "top", "low").alias("_g"))
    kept = kept.groupBy("dim", "_share").agg(F.collect_list("_g").alias("_groups"))  # the bounds of about ``TOGETHER`` groups
    sent = asked.withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long")))).join(kept, ["dim", "_share"])

    def choose(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["group", "batch", "places", "qids", "qdata", "floors"]
        for part in parts:
            for r in range(part.num_rows):
                dim, batch, ids, data, floor, near = (part.column(c)[r].as_py() for c in range(6))
                q, ids, floor = _numbers(data).reshape(len(floor) // 8, dim), _numbers(ids, np.int64), _numbers(floor, np.int64)
                top, low = (np.stack([_numbers(g[n]) for g in near]).reshape(len(near), dim) for n in ("top", "low"))
                reached = bounds(q, top, low) >= floor[:, None]
                out, held = [], 0
                for g in np.flatnonzero(reached.any(axis=0)).tolist():
                    at = np.flatnonzero(reached[:, g])
                    out.append((near[g]["group"], batch, *(x.tobytes() for x in (at, ids[at], q[at], floor[at]))))
                    held += len(out[-1][4]) + 24 * len(at)
                    if held > 1 << 24:
                        yield pa.RecordBatch.from_pydict(dict(zip(names, map(pa.array, zip(*out)))))
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, map(pa.array, zip(*out)))))

    sent = sent.select("dim", "batch", "ids", "data", "floors", "_groups").mapInArrow(choose, "_g long, batch long, places binary, qids binary, qdata binary, floors binary")
    both = sent.join(index, F.col("_g") == F.col("group")).select("dim", "batch", "places", "qids", "qdata", "floors", "ids", "data")

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for r in range(part.num_rows):
                dim, batch, places, qid, q, floor, ids, data = (part.column(c)[r].as_py() for c in range(8))
                ids, places, qid = (_numbers(x, np.int64) for x in (ids, places, qid))
                q = _numbers(q).reshape(len(places), dim)
                n, found, score, _ = search_group(q, _numbers(floor, np.int64), ids, _numbers(data).reshape(len(ids), dim), k + 1)
                itself = np.array([_scores(x[None], x[None])[0, 0] for x in q], np.int64)
                own = (found == qid[n]) & (score == itself[n])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (batch * BATCH + places[n], qid[n], found, score, own)], ["asked", "query_id", "vec_id", "score", "own"])

    hits = both.mapInArrow(search, "asked long, query_id long, vec_id long, score long, own boolean")
    w = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    best = hits.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k + 1)
    best = best.withColumn("_own", F.min(F.when(F.col("own"), F.col("_n"))).over(Window.partitionBy("asked")))
    best = best.withColumn("rank", F.col("_n") - F.coalesce((F.col("_own") <= F.col("_n")).cast("int"), F.lit(0)))
    return best.where((F.col("rank") <= k) & ~F.coalesce(F.col("_n") == F.col("_own"), F.lit(False))).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
