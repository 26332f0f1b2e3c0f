"""Removal of repeated byte strings by threshold-bounded expansion of suffix intervals.

A byte goes if it lies in a string of ``length`` bytes that also starts earlier: in a document before, or
earlier in the same one. Strings never reach over documents, and are judged on the input.

1. Anchors bring equal strings together. Of the k-byte grams in each window of ``length`` bytes the one of
   least hash is an anchor, so equal strings hold equal anchors at equal places. Anchors whose gram
   occurs once are done with; they are nearly all outside repeated text. Others go on with no more of what
   precedes and follows them than the windows reach in which they are least.
2. The occurrences of one gram are rows of a Burrows-Wheeler matrix: sorted by what follows, they carry what
   precedes. Backward extension, one byte a level, sorts the rows stably by the byte before them (the
   last-to-first step) and splits each interval by it, breadth first over all intervals of all grams. Common
   prefixes are the level plus the least common prefix of what follows (range minima of neighbours). At
   level l, rows with l bytes before and length - k - l behind in common share a string; the earliest
   start of each such set stays and the others are marked. Intervals of one row are dropped, and expansion
   ends at level length - k, the minimum length.
3. Marked strings are merged per document and cut out.

Equal contexts of one slice of texts are sent once, as their earliest occurrence; the others are marked at
once. A task takes whole grams, about ``most_rows`` rows at a time, 200 bytes a row. A gram with more occurrences than
that is expanded in ranges of ``HOT_LEVELS`` levels, each dealt by the bytes that all of its levels hold (the gram,
and what precedes and follows it nearest); what else a row carries is one byte at each end, so a task meets 65,536
contexts at most of each salted group, in which equal ones are first put together. The names of such grams are sent to all tasks: with
more occurrences than ``hot_rows`` and than a share of 1 / ``MOST_HOT`` of all, they are fewer than ``MOST_HOT``.

Nulls: a null text is empty. A null id sorts before all others. Rows that repeat an id and its text are one
document, and each gets its result. No documents: no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from deltaweave.llm.staging import drop_staged, release, stage
from deltaweave.llm.text import SLICE_BYTES, gram_hash, mix, slices

LENGTH, GRAM = 100, 16
MOST_ROWS = 200_000
ENTRIES_PER_BUCKET = 300_000
FINE = 8  # buckets a task: Spark hashes bucket numbers, and single ones would fall on few tasks in heaps
MOST_HOT = 1_000_000
HOT_LEVELS = 2
_U = np.uint64
_ROW = {"value": "<u8", "doc": "<i8", "dk": "<i8", "place": "<i4", "before": "u1", "behind": "u1", "high": "i1", "low": "i1"}
_SENT = {**_ROW, "left": "u1", "right": "u1"}


def _slide(x: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over x[i : i + width]; len(x) - width + 1 values."""
    out, have = x, 1
    while 2 * have <= width:
        out = op(out[:-have], out[have:])
        have *= 2
    return op(out[: len(x) - width + 1], out[width - have : width - have + len(x) - width + 1]) if have < width else out


def minima(data: np.ndarray, offsets: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the gram at each place, least of them in the window of ``length`` bytes from each place; 0 where the
    window reaches over texts)."""
    g = gram_hash(data, k)
    least = _slide(g, length - k + 1, np.minimum)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    least[text[: len(least)] != text[length - 1 :]] = 0
    return g, least


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the grams that are least in some window of ``length`` bytes of a text."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    g, least = minima(data, offsets, length, k)
    width = length - k + 1
    padded = np.concatenate([np.zeros(width - 1, _U), least, np.zeros(width - 1, _U)])
    at = np.flatnonzero((_slide(padded, width, np.maximum) == g) & (g > 0))
    return at, g[at]


def _pack(bucket: np.ndarray, **arrays: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    bounds = np.append(first, len(bucket))
    out = {"bucket": pa.array(bucket[first].astype(np.int64))}
    for name, x in arrays.items():
        raw = np.ascontiguousarray(x[order])
        size = raw.itemsize * (raw.shape[1] if raw.ndim > 1 else 1)
        at = (bounds * size).astype(np.int64)
        out[name] = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(at), pa.py_buffer(raw.tobytes())]).cast(pa.binary())
    return pa.RecordBatch.from_pydict(out)


def _gather(batches: Iterator[pa.RecordBatch], kinds: dict[str, str]) -> dict[str, np.ndarray] | None:
    parts: dict[str, list[bytes]] = {n: [] for n in kinds}
    for b in batches:
        for n in kinds:
            parts[n] += b.column(b.schema.get_field_index(n)).to_pylist()
    if not parts[next(iter(kinds))]:
        return None
    out = {}
    for n, kind in kinds.items():
        out[n] = np.frombuffer(b"".join(parts.pop(n)), kind)
    return out


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new run of equal sorted keys begins."""
    new = np.zeros(len(keys[0]), bool)
    if len(new):
        new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def shared_places(docs: DataFrame, buckets: int, length: int, k: int, hot_rows: int = MOST_ROWS) -> DataFrame:
    """(dk, places): per document the anchors whose gram occurs elsewhere, as packed 32-bit places. Besides, without dk,
    (value, n) of each gram with more than ``hot_rows`` occurrences, and n without value: occurrences of all grams."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_numpy()
            for first, _, data, offsets in slices(batch.column(1)):
                at, value = anchors(data, offsets, length, k)
                if not len(at):
                    continue
                text = np.searchsorted(offsets, at, side="right") - 1
                place, dk = (at - offsets[text]).astype(np.int64), names[first + text]
                order = np.argsort(value, kind="stable")
                value, place, dk = value[order], place[order], dk[order]
                new = _runs(value)
                start = np.flatnonzero(new)
                sent = np.arange(len(value)) - start[np.cumsum(new) - 1] < 2
                n = np.zeros(len(value), np.int32)
                n[start] = np.diff(np.append(start, len(value)))
                twin = np.append(False, (dk[1:] == dk[:-1]) & (place[1:] == place[:-1]) & ~new[1:])
                sent &= ~twin
                for which, bucket in ((sent, value), (~sent, dk.view(_U))):  # two of a slice stand for all of its occurrences
                    if which.any():
                        part = _pack((bucket[which] % _U(FINE * buckets)).astype(np.int64), value=value[which], dk=dk[which], place=place[which].astype(np.int32), n=n[which])
                        yield part.add_column(1, "known", pa.array(np.full(part.num_rows, which is not sent)))

    def counted(part: pa.RecordBatch, value: pa.Array | None = None, n: pa.Array | None = None) -> pa.RecordBatch:
        none = pa.nulls(part.num_rows, pa.int64())
        return part.append_column("value", none if value is None else value).append_column("n", none if n is None else n)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = []
        for b in batches:
            known = b.column(1)
            told = b.filter(known)
            if told.num_rows:
                yield counted(told.select(["bucket", "dk", "place"]))
            rest = b.filter(pc.invert(known))
            if rest.num_rows:
                fresh.append(rest)
        x = _gather(iter(fresh), {"value": "<u8", "dk": "<i8", "place": "<i4", "n": "<i4"})
        if x is None:
            return
        order = np.lexsort((x["place"], x["dk"], x["value"]))
        value, dk, place, n = (x[c][order] for c in ("value", "dk", "place", "n"))
        start = np.flatnonzero(_runs(value))
        times = np.add.reduceat(n.astype(np.int64), start)
        hot = np.flatnonzero(times > hot_rows)
        names = pa.concat_arrays([pa.array(value[start[hot]].view(np.int64)), pa.nulls(1, pa.int64())])
        times = np.append(times[hot], times.sum())
        nothing = pa.array([b""] * len(times), pa.binary())
        yield counted(pa.RecordBatch.from_pydict({"bucket": pa.array(np.arange(len(times), dtype=np.int64)), "dk": nothing, "place": nothing}), names, pa.array(times))
        whole = _runs(value, dk, place)  # an identical row sent by another slice is the same document
        value, dk, place = value[whole], dk[whole], place[whole]
        new = _runs(value)
        count = np.diff(np.append(np.flatnonzero(new), len(value)))[np.cumsum(new) - 1]
        keep = count > 1
        if keep.any():
            yield counted(_pack((dk[keep].view(_U) % _U(FINE * buckets)).astype(np.int64), dk=dk[keep], place=place[keep]))

    def per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_documents = []
        for b in batches:
            of_grams = b.filter(pc.is_valid(b.column(4)))
            if of_grams.num_rows:
                nothing = pa.nulls(of_grams.num_rows)
                yield pa.RecordBatch.from_arrays([nothing.cast(pa.int64()), nothing.cast(pa.binary()), of_grams.column(3), of_grams.column(4)], ["dk", "places", "value", "n"])
            of_documents.append(b.filter(pc.is_null(b.column(4))))
        x = _gather(iter(of_documents), {"dk": "<i8", "place": "<i4"})
        if x is None:
            return
        order = np.lexsort((x["place"], x["dk"]))
        dk, place = x["dk"][order], x["place"][order]
        whole = _runs(dk, place)
        dk, place = dk[whole], place[whole]
        first = np.append(np.flatnonzero(_runs(dk)), len(dk))
        raw = place.tobytes()
        for a in range(0, len(first) - 1, 4096):
            cut = first[a : a + 4097]
            yield counted(pa.RecordBatch.from_pydict({"dk": pa.array(dk[cut[:-1]]), "places": pa.array([raw[4 * s : 4 * e] for s, e in zip(cut[:-1], cut[1:])], pa.binary())}))

    sent = docs.select("dk", "text").mapInArrow(send, "bucket long, known boolean, value binary, dk binary, place binary, n binary")
    met = sent.repartition(buckets, "bucket").mapInArrow(meet, "bucket long, dk binary, place binary, value long, n long")
    return met.repartition(buckets, "bucket").mapInArrow(per_document, "dk long, places binary, value long, n long")


def hot_grams(places: DataFrame, hot_rows: int = MOST_ROWS) -> tuple[np.ndarray, int, int]:
    """(names of the hot grams in order, occurrences of the hottest, of all of them)."""
    said = places.where("n is not null")
    least = max(hot_rows, (said.where("value is null").agg(F.sum("n")).first()[0] or 0) // MOST_HOT)
    found = said.where(F.col("value").isNotNull() & (F.col("n") > least)).select("value", "n").toArrow()
    n = found.column(1).to_numpy()
    return np.sort(found.column(0).to_numpy().view(_U)), int(n.max(initial=0)), int(n.sum())


def contexts(docs: DataFrame, places: DataFrame, buckets: int, length: int, k: int, hot: np.ndarray | None = None, salts: int = 0) -> DataFrame:
    """The occurrences of shared grams with what precedes (nearest byte first) and follows them, packed per bucket of grams.
    Without ``salts`` those of other grams than ``hot``; with it those of ``hot`` alone, a row for each range of levels,
    named by the bytes that all levels of the range hold, and each name in so many buckets."""
    reach = length - k
    hot = np.zeros(0, _U) if hot is None else hot
    ranges = [(lo, min(lo + HOT_LEVELS - 1, reach)) for lo in range(0, reach + 1, HOT_LEVELS)] if salts else [(0, reach)]
    joined = docs.join(places.withColumnRenamed("dk", "_d"), F.col("dk") == F.col("_d")).select("order", "dk", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(2), SLICE_BYTES if salts else 500_000):
                found = batch.column(3).slice(first, end - first).to_pylist()
                count = np.array([len(x) // 4 for x in found])
                text = np.repeat(np.arange(end - first), count)
                place = np.frombuffer(b"".join(found), "<i4").astype(np.int64)
                if not len(text):
                    continue
                g, least = minima(data, offsets, length, k)
                whole = offsets[text] + place
                value = g[whole]
                own = np.isin(value, hot) == (salts > 0)
                text, place, whole, value = text[own], place[own], whole[own], value[own]
                windows = np.concatenate([np.zeros(reach, _U), least, np.zeros(length, _U)])
                wide = np.concatenate([np.zeros(reach, np.uint8), data, np.zeros(reach + k, np.uint8)])
                steps = np.arange(reach)
                for a in range(0, len(text), 20_000):
                    cut = slice(a, a + 20_000)
                    # only strings in which this gram is the least have it as their anchor; they start at these places
                    own = windows[whole[cut][:, None] + np.arange(reach + 1)] == value[cut][:, None]
                    before = reach - own.argmax(axis=1)
                    behind = reach - own[:, ::-1].argmax(axis=1)
                    at = whole[cut][:, None] + reach
                    wide_left, wide_right = wide[at - 1 - steps], wide[at + k + steps]
                    doc = batch.column(0).slice(first, end - first).to_numpy()[text[cut]]
                    dk = batch.column(1).slice(first, end - first).to_numpy()[text[cut]]
                    for lo, hi in ranges:
                        upto, beyond = np.minimum(before, hi), np.minimum(behind, reach - lo)
                        on = np.flatnonzero((upto >= lo) & (beyond >= reach - hi) & (upto + beyond >= reach))
                        if not len(on):
                            continue
                        upto, beyond = upto[on], beyond[on]
                        left = np.where(steps < upto[:, None], wide_left[on], 0).astype(np.uint8)
                        right = np.where(steps < beyond[:, None], wide_right[on], 0).astype(np.uint8)
                        part = {"value": value[cut][on], "doc": doc[on], "dk": dk[on], "place": place[cut][on].astype(np.int32), "before": upto.astype(np.uint8), "behind": beyond.astype(np.uint8), "left": left, "right": right}
                        if salts:
                            part["value"] = _mixed(_mixed(part["value"] + _U(lo), left[:, :lo]), right[:, : reach - hi])
                        yield from _send(part, reach, buckets, salts)

    return joined.mapInArrow(run, "bucket long, " + ", ".join(f"{n} binary" for n in _SENT))


def _mixed(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """``h`` mixed with the bytes of each row."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    for column in wide.view("<u8").T if wide.shape[1] else ():
        h = mix(h * _U(0x9E3779B97F4A7C15) + column)
    return h


def _send(x: dict[str, np.ndarray], reach: int, buckets: int, salts: int = 0) -> Iterator[pa.RecordBatch]:
    """Rows without repeats of contexts by gram, and what is marked by document."""
    sent, marks = _once(x, reach)
    sent["high"] = sent["low"] = np.full(len(sent["dk"]), -1, np.int8)
    name = sent["value"]
    if salts:
        name = mix(name + mix(sent["dk"].view(_U) + sent["place"].astype(_U)) % _U(salts))
    yield _pack((name % _U(FINE * buckets)).astype(np.int64), **{n: sent[n] for n in _SENT})
    if len(marks["dk"]):  # they need no comparison, but travel the same way
        marks["left"] = marks["right"] = np.zeros((len(marks["dk"]), 0), np.uint8)
        yield _pack((marks["dk"].view(_U) % _U(FINE * buckets)).astype(np.int64), **{n: marks[n] for n in _SENT})


def _received(batches: Iterator[pa.RecordBatch], reach: int) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]] | None:
    """(rows to compare, rows that are marked)."""
    x = _gather(batches, _SENT)
    if x is None:
        return None
    fresh = x["high"] < 0
    told = {n: v[~fresh] for n, v in x.items() if n not in ("left", "right")}
    return {n: v.reshape(-1, reach) if n in ("left", "right") else v[fresh] for n, v in x.items()}, told


def gathered(packed: DataFrame, buckets: int, length: int, k: int) -> DataFrame:
    """Rows of salted groups, equal contexts once, dealt by name alone."""
    reach = length - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _received(batches, reach)
        if got is None:
            return
        x, told = got
        if len(told["dk"]):
            told["left"] = told["right"] = np.zeros((len(told["dk"]), 0), np.uint8)
            yield _pack((told["dk"].view(_U) % _U(FINE * buckets)).astype(np.int64), **{n: told[n] for n in _SENT})
        if len(x["dk"]):
            yield from _send(x, reach, buckets)

    return packed.repartition(buckets, "bucket").mapInArrow(run, packed.schema)


def _once(x: dict[str, np.ndarray], reach: int) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Of rows with equal contexts the earliest; and the others, with the levels at which all they hold is repeated."""
    whole = _mixed(_mixed(np.zeros(len(x["dk"]), _U), x["left"]), x["right"])
    whole = mix(whole ^ (x["value"] + (x["before"].astype(_U) << _U(8)) + x["behind"].astype(_U)))
    order = np.lexsort((x["place"], x["dk"], x["doc"], whole))
    new = _runs(whole[order])
    twin = np.append(False, (x["dk"][order[1:]] == x["dk"][order[:-1]]) & (x["place"][order[1:]] == x["place"][order[:-1]])) & ~new
    first, rest = order[new], order[~new & ~twin]
    marks = {n: v[rest] for n, v in x.items() if n not in ("left", "right")}
    marks["high"] = marks["before"].astype(np.int8)
    marks["low"] = (reach - marks["behind"].astype(np.int64)).astype(np.int8)
    return {n: v[first] for n, v in x.items()}, marks


def _range_min(x: np.ndarray) -> list[np.ndarray]:
    """Sparse table: level j has the minima of 2**j values."""
    table = [x]
    while 2 << (len(table) - 1) <= len(x):
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    return table


def expand(value: np.ndarray, order: np.ndarray, before: np.ndarray, behind: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows (occurrences of grams) the greatest and least level at which the row shares a whole string with an
    earlier one (-1 if none). ``order``: the rank of the row's (document, place); rows of a gram may repeat contexts."""
    rows, reach = left.shape
    high, low = np.full(rows, -1), np.full(rows, -1)
    words = np.zeros((rows, -(-reach // 8) * 8), np.uint8)
    words[:, :reach] = right
    keys = words.view(">u8").astype(_U)
    first = np.lexsort((behind, *(keys[:, c] for c in range(keys.shape[1] - 1, -1, -1)), value))
    # common prefix of what follows, of neighbours in order of (gram, what follows)
    a, b = first[:-1], first[1:]
    same = np.zeros(max(rows - 1, 0), np.uint8)
    for s in range(0, rows - 1, 65536):
        x, y = a[s : s + 65536], b[s : s + 65536]
        differ = right[x] != right[y]
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), reach)
        same[s : s + 65536] = np.where(value[x] == value[y], np.minimum(common, np.minimum(behind[x], behind[y])), 0)
    table = _range_min(same)
    rank = np.arange(rows)  # place of a row in the first order, by its place in the current order
    row = first
    klass = np.cumsum(_runs(value[first])) if rows else np.zeros(0, np.int64)
    for level in range(reach + 1):
        if not len(row):
            break
        new = _runs(klass)
        # neighbours within an interval: the common prefix of what follows is a range minimum
        p, q = rank[:-1], rank[1:]
        gap = np.maximum(q - p, 1)
        j = np.log2(gap).astype(np.int64)
        near = np.zeros(len(p), np.int64)
        for jj in np.unique(j[~new[1:]]) if len(p) else ():
            at = np.flatnonzero((j == jj) & ~new[1:])
            near[at] = np.minimum(table[jj][p[at]], table[jj][q[at] - (1 << jj)])
        split = new.copy()
        split[1:] |= near < reach - level
        start = np.flatnonzero(split)
        size = np.diff(np.append(start, len(row)))
        wide = size > 1
        if wide.any():
            earliest = np.minimum.reduceat(order[row], start)
            inside = np.repeat(wide, size)
            later = inside & (order[row] != np.repeat(earliest, size))
            hit = row[later]
            high[hit] = level
            low[hit[low[hit] < 0]] = level
        if level == reach:
            break
        # the next level: extend every interval by each byte that precedes it
        size = np.diff(np.append(np.flatnonzero(new), len(row)))
        alive = np.repeat(size > 1, size) & (before[row] > level)
        row, rank, klass = row[alive], rank[alive], klass[alive]
        byte = left[row, level]
        step = np.argsort(byte, kind="stable")
        row, rank, byte, klass = row[step], rank[step], byte[step], klass[step]
        klass = np.cumsum(_runs(klass, byte)) if len(row) else klass
    return high, low


def marked(packed: DataFrame, buckets: int, length: int, k: int, most_rows: int = MOST_ROWS) -> DataFrame:
    """(bucket, dk, start, end) packed: the strings that start earlier elsewhere, per bucket of documents."""
    reach = length - k

    def strings(dk: np.ndarray, place: np.ndarray, high: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
        return _pack((dk.view(_U) % _U(FINE * buckets)).astype(np.int64), dk=dk, start=(place - high).astype(np.int32), end=(place - low + length).astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _received(batches, reach)
        if got is None:
            return
        x, told = got
        if len(told["dk"]):
            yield strings(told["dk"], told["place"].astype(np.int64), told["high"], told["low"])
        by_value = np.lexsort((x["place"], x["dk"], x["value"]))
        by_value = by_value[_runs(x["value"][by_value], x["dk"][by_value], x["place"][by_value])]  # repeated rows are one document
        bounds = np.append(np.flatnonzero(_runs(x["value"][by_value])), len(by_value))
        at = 0
        while at < len(bounds) - 1:  # whole grams, about ``most_rows`` rows at a time
            stop = max(int(np.searchsorted(bounds, bounds[at] + most_rows, side="right")) - 1, at + 1)
            part = by_value[bounds[at] : bounds[stop]]
            at = stop
            y = {n: v[part] for n, v in x.items()}
            rank = np.empty(len(part), np.int64)
            rank[np.lexsort((y["place"], y["dk"], y["doc"]))] = np.arange(len(part))
            high, low = expand(y["value"], rank, y["before"], y["behind"], y["left"], y["right"])
            hit = np.flatnonzero(high >= 0)
            if len(hit):
                yield strings(y["dk"][hit], y["place"][hit].astype(np.int64), high[hit], low[hit])

    return packed.repartition(buckets, "bucket").mapInArrow(run, "bucket long, dk binary, start binary, end binary")


def merged(found: DataFrame, buckets: int) -> DataFrame:
    """(dk, spans): per document the maximal runs of marked bytes, as packed pairs of 32-bit places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = _gather(batches, {"dk": "<i8", "start": "<i4", "end": "<i4"})
        if x is None:
            return
        order = np.lexsort((x["start"], x["dk"]))
        dk, start, end = x["dk"][order], x["start"][order].astype(np.int64), x["end"][order].astype(np.int64)
        new = _runs(dk)
        # ends so far within a document: lifted by the document's number, so one running maximum does
        lift = np.cumsum(new) * (1 << 33)
        sofar = np.maximum.accumulate(end + lift)
        begins = new.copy()
        begins[1:] |= start[1:] + lift[1:] > sofar[:-1]
        first = np.flatnonzero(begins)
        last = np.append(first[1:], len(dk)) - 1
        spans = np.stack([start[first], sofar[last] - lift[last]], axis=1).astype("<i4")
        name = dk[first]
        bounds = np.append(np.flatnonzero(_runs(name)), len(name))
        raw = spans.tobytes()
        for a in range(0, len(bounds) - 1, 4096):
            cut = bounds[a : a + 4097]
            yield pa.RecordBatch.from_pydict({"dk": pa.array(name[cut[:-1]]), "spans": pa.array([raw[8 * s : 8 * e] for s, e in zip(cut[:-1], cut[1:])], pa.binary())})

    return found.repartition(buckets, "bucket").mapInArrow(run, "dk long, spans binary")


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, hot_rows: int = MOST_ROWS) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``spans`` (array of (start, end) of removed runs, in bytes) and ``kept`` (the other
    bytes; a character can be cut, so not a string) of every document. Texts stay below 2 GB each."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("order"), F.xxhash64(F.col(doc_id), body).alias("dk"), body.alias("text"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(16, total * 2 // (length - gram + 2) // ENTRIES_PER_BUCKET + 1)
    places = stage(shared_places(docs, buckets, length, gram, hot_rows), "places")
    release(spark)
    hot, hottest, times = hot_grams(places, hot_rows)
    found = [stage(marked(contexts(docs, places, buckets, length, gram, hot), buckets, length, gram), "marked")]
    release(spark)
    if len(hot):
        parts, salts = max(16, times * 10 // ENTRIES_PER_BUCKET + 1), hottest // hot_rows + 1
        named = gathered(contexts(docs, places, parts, length, gram, hot, salts), parts, length, gram)
        found.append(stage(marked(named, parts, length, gram), "marked-hot"))
        release(spark)
    drop_staged(places)
    spans = stage(merged(functools.reduce(DataFrame.union, found), buckets), "spans")
    release(spark)
    for part in found:
        drop_staged(part)
    joined = docs.join(spans.withColumnRenamed("dk", "_d"), F.col("dk") == F.col("_d"), "left").select("doc_id", "text", "spans")
    schema = joined.select("doc_id", F.lit(0).cast("long").alias("n_bytes"), F.lit(None).cast("array<struct<start:long,end:long>>").alias("spans"), F.lit(b"").alias("kept")).schema
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                size, spans, kept = [], [], []
                for value, packed in zip(part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist()):
                    pairs = np.frombuffer(packed, "<i4").reshape(-1, 2).tolist() if packed else []
                    size.append(len(value))
                    spans.append([{"start": s, "end": e} for s, e in pairs])
                    edges = [0, *(x for p in pairs for x in p), len(value)]
                    kept.append(b"".join(value[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(cut, schema).withColumnRenamed("doc_id", doc_id)
