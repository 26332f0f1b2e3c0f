"""N-gram Jaccard join by parity sketches.

A document's set of word shingles is hashed into a sketch, of which every shingle flips one bit. The Hamming
distance of two sketches is at most the size of the symmetric difference of the sets, and sets that reach
the threshold t differ in at most (1 - t) / (1 + t) times the sum of their sizes. The sketch of a size band
has many more pieces than that, so two linked sets agree on some of any D + 1 pieces (pigeonhole). Long
sketches are sparse: a piece is kept as the XOR of random words of its set bits. Sizes below 64 use the limit
in which each bit is a piece. A set is compared in its own band and, if a partner can be smaller, in the
band before.

1. Equal sets become one node, named by 127 bits. All pieces are dealt by their value, and each node learns how
   many of its pieces occur in another set. A node with D + 1 pieces of its own has no partner and is done; this
   settles almost all documents without a candidate pair.
2. The others, whose texts are written once, are joined on their pieces: pieces are ordered by how many sets share
   them, and each set keeps its rarest D + 1. Of two linked sets neither has more than D pieces that the other
   lacks, so the first piece that they share is among the D + 1 of both.
3. Pairs that meet are verified on whole texts, shingle by shingle and word by word, in rounds: each set against
   one leader of the buckets that still hold several components, then a forest of the pairs whose 2048-bit sketches
   are near enough, then all such pairs that are left between components. Only what could join two components is
   compared: in a bucket the sets outside its largest component meet all others, in blocks of at most ``BLOCK``
   against ``BLOCK``, so no bucket is gathered whole and a group of thousands of copies costs about a comparison a
   copy and round.

Values travel as packed arrays, one row per slice of texts and bucket; in a slice a value is sent at most
twice while pieces are counted. Nothing is dropped or capped. Shingles are told apart by 64-bit hashes, which decide
``n_shingles``; links are decided on the words.

Nulls: a document without text or words is linked with nothing. A null id takes part as a text but cannot
name a component; its own component is null if it holds null ids alone. Rows that repeat an id, with the same text
or another, are rows of their own; repeated rows are copies. No documents: no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from deltaweave.llm.staging import components, drop_staged, release, stage
from deltaweave.llm.text import LOWER, codes, distinct, mix, shingle_rows, shingles, slices

NUM, DEN, WIDTH = 75, 100, 5
SMALL = 64
SKETCH_BITS = 2048
BLOCK = 1024
SALTS = 16
LEADER_ROUNDS = 2
ENTRIES_PER_BUCKET = 400_000
_U = np.uint64


def most_apart(a: np.ndarray, b: np.ndarray, num: int = NUM, den: int = DEN) -> np.ndarray:
    """The largest symmetric difference that linked sets of sizes a and b can have."""
    return (den - num) * (a + b) // (den + num)


def band(n: np.ndarray) -> np.ndarray:
    """0 below ``SMALL``, then one for each doubling."""
    return np.where(n < SMALL, 0, np.log2(np.maximum(n, 1) / SMALL).astype(np.int64) + 1)


def piece_count(k: int) -> int:
    """Pieces of the sketch of band k; enough above D + 1 that empty pieces leave D + 1 others."""
    high = SMALL << k
    return int(high * {1: 0.8, 2: 0.6, 3: 0.5}.get(k, 0.45))


def pieces(owner: np.ndarray, h: np.ndarray, n: np.ndarray, salt: int, num: int = NUM, den: int = DEN) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(0 for the own band or 1 for the one before, set of each piece, value of each piece, D + 1 of all sets)."""
    own = band(n)
    largest = n * den // num
    below = SMALL << np.maximum(own - 1, 0)  # the first size of the own band
    for view in (0, 1):
        if view:
            apart = most_apart(n, np.minimum(n, below - 1), num, den)
            takes = (own > 0) & ((below - 1) * den >= num * n)
        else:
            apart, takes = most_apart(n, largest, num, den), n > 0
        k = own - view
        mine = takes[owner]
        o, x = owner[mine], h[mine]
        value = mix(x + _U(salt * 2 + 1) * _U(0x9E3779B97F4A7C15))
        kk = k[o]
        values, sets = [], []
        token = kk == 0
        values.append(value[token])
        sets.append(o[token])
        for b in np.unique(kk[~token]).tolist():
            at = kk == b
            count = _U(piece_count(b))
            ob, vb = o[at], value[at]
            place = ((vb >> _U(32)) * count) >> _U(32)
            key = (ob.astype(np.int64) << 32) | place.astype(np.int64)
            order = np.argsort(key, kind="stable")
            key, bits = key[order], mix(vb[order] ^ _U(0x5851F42D4C957F2D))
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            parity = np.bitwise_xor.reduceat(bits, first)
            filled = parity != 0
            place = (key[first] & 0xFFFFFFFF).astype(_U)
            values.append(mix(parity + place * _U(0xDA942042E4DD58B5) + _U(b))[filled])
            sets.append((key[first] >> 32)[filled])
        yield view, np.concatenate(sets), np.concatenate(values), np.where(takes, apart + 1, 0)


def fingerprints(owner: np.ndarray, h: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Two names of each text's set, of 63 bits (with a last bit of 0) and of 64; together they tell sets apart."""
    first = np.searchsorted(owner, np.arange(texts + 1))
    names = []
    for salt in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB):
        sums = np.concatenate([[_U(0)], np.cumsum(mix(h ^ _U(salt)))])
        names.append(mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(_U)))
    return names[0] & ~_U(1), names[1]


def _rows(run: Callable[[pa.RecordBatch, int, int, np.ndarray, np.ndarray, int, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], width: int, column: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow function that hands slices of texts with their shingles to ``run``."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(column)):
                owner, h = shingles(data, offsets, width)
                yield from run(batch, first, end, owner, h)

    return go


def _pack(bucket: np.ndarray, **arrays: np.ndarray) -> pa.RecordBatch:
    """One row per bucket with the arrays' members as binaries."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    bounds = np.append(first, len(bucket))
    out = {"bucket": pa.array(bucket[first].astype(np.int64))}
    for name, x in arrays.items():
        raw = np.ascontiguousarray(x[order])
        at = (bounds * raw.itemsize).astype(np.int64)
        out[name] = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(at), pa.py_buffer(raw.tobytes())]).cast(pa.binary())
    return pa.RecordBatch.from_pydict(out)


def _unpack(batch: pa.RecordBatch, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in batch.column(batch.schema.get_field_index(name)).to_pylist()), kind)


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted keys: the start of each run, and the run of each member."""
    new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
    return np.flatnonzero(new), np.cumsum(new) - 1


def measure(docs: DataFrame, *, keep: list[str], text: str, width: int, num: int, den: int, salt: int) -> DataFrame:
    """``keep`` and (n, node, check, spare0, spare1): the size and names of each set, and how many pieces beyond D + 1 are
    filled in its own band and in the one before (negative: too few under this salt)."""
    zero = F.lit(0).cast("long")
    added = ("n", "node", "check", "spare0", "spare1")
    schema = docs.select(*keep, *(zero.alias(c) for c in added)).schema

    def run(batch, first, end, owner, h):  # noqa: ANN001
        texts = end - first
        n = np.bincount(owner, minlength=texts)
        spare = [np.bincount(sets, minlength=texts) - need for _, sets, _, need in pieces(owner, h, n, salt, num, den)]
        names = [x.view(np.int64) for x in fingerprints(owner, h, texts)]
        yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(first, texts) for k in range(len(keep))), *map(pa.array, (n, *names, *spare))], schema.names)

    return docs.select(*keep, text).mapInArrow(_rows(run, width, len(keep)), schema)


def paired(docs: DataFrame, buckets: int, *, text: str, width: int, num: int, den: int, salt: int) -> DataFrame:
    """(node, view, common): of each set and band, how many pieces occur in another set. Sets of one 63-bit name
    count together, which can only make a set go on to the next step."""

    def send(batch, first, end, owner, h):  # noqa: ANN001
        texts = end - first
        n = np.bincount(owner, minlength=texts)
        node, _ = fingerprints(owner, h, texts)
        for view, sets, value, _ in pieces(owner, h, n, salt, num, den):
            if not len(sets):
                continue
            name = node[sets] | _U(view)
            order = np.lexsort((name, value))
            name, value = name[order], value[order]
            fresh = np.append(True, (value[1:] != value[:-1]) | (name[1:] != name[:-1]))
            name, value = name[fresh], value[fresh]
            start, run = _groups(value)
            nth = np.arange(len(value)) - start[run]
            sent = nth < 2
            part = _pack((value[sent] % _U(buckets)).astype(np.int64), value=_narrow(value[sent] // _U(buckets)), name=name[sent])
            yield part.add_column(1, "shared", pa.array(np.zeros(part.num_rows, bool)))
            if not sent.all():  # two sets of this slice go for them; that they are shared is known here
                part = _pack((name[~sent] % _U(buckets)).astype(np.int64), value=_narrow(value[~sent] // _U(buckets)), name=name[~sent])
                yield part.add_column(1, "shared", pa.array(np.ones(part.num_rows, bool)))

    def gather(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, ...] | None:
        """(values with their bucket mixed in, names, known to be shared) of a partition."""
        parts = []
        for b in batches:
            raw = b.column(b.schema.get_field_index("value")).to_pylist()
            size = [len(x) // 6 for x in raw]
            value = mix(_wide(b"".join(raw)) * _U(buckets) + np.repeat(b.column(0).to_numpy(), size).astype(_U)) if "shared" in b.schema.names else _wide(b"".join(raw))
            known = np.repeat(b.column(1).to_numpy(zero_copy_only=False), size) if "shared" in b.schema.names else np.ones(len(value), bool)
            parts.append((value, _unpack(b, "name", "<u8"), known))
        return tuple(np.concatenate(x) for x in zip(*parts)) if parts else None

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = gather(batches)
        if got is None:
            return
        value, name, common = got
        at = np.flatnonzero(~common)
        at = at[np.argsort(value[at], kind="stable")]
        start, run = _groups(value[at])
        if len(at):
            least, most = np.minimum.reduceat(name[at], start), np.maximum.reduceat(name[at], start)
            common[at] = (least != most)[run]
        at = np.flatnonzero(common)
        at = at[np.lexsort((name[at], value[at]))]
        if len(at):  # one entry per (value, set): a set sent by several slices counts once
            at = at[np.append(True, (value[at[1:]] != value[at[:-1]]) | (name[at[1:]] != name[at[:-1]]))]
            yield _pack((name[at] % _U(buckets)).astype(np.int64), value=_narrow(value[at]), name=name[at])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = gather(batches)
        if got is None:
            return
        value, name, _ = got
        order = np.lexsort((value, name))
        value, name = value[order], name[order]
        name = name[np.append(True, (value[1:] != value[:-1]) | (name[1:] != name[:-1]))]
        start, _ = _groups(name)
        count = np.diff(np.append(start, len(name)))
        name = name[start]
        view = (name & _U(1)).astype(np.int32)
        yield pa.RecordBatch.from_pydict({"node": pa.array((name & ~_U(1)).view(np.int64)), "view": pa.array(view), "common": pa.array(count)})

    sent = docs.select(text).mapInArrow(_rows(send, width, 0), "bucket long, shared boolean, value binary, name binary")
    met = sent.repartition(buckets, "bucket").mapInArrow(meet, "bucket long, value binary, name binary")
    return met.repartition(buckets, "bucket").mapInArrow(settle, "node long, view int, common long")


def _narrow(x: np.ndarray) -> np.ndarray:
    """The low 48 bits, six bytes a value; with the bucket they tell values apart."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).view("V6").ravel()


def _wide(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


_INFO = np.dtype([("n", "<i4"), ("short", "<i4")])


def shared_pieces(texts: DataFrame, buckets: int, *, width: int, num: int, den: int, salt: int) -> DataFrame:
    """(key, node, n): of each set in ``texts`` (node, n, text), in its own band and in the one before, the rarest D + 1
    pieces that other sets share, by the number of sets and then value; pieces of its own come first and need no row."""

    def packed(bucket: np.ndarray, info: bool, **arrays: np.ndarray) -> pa.RecordBatch:
        part = _pack(bucket.astype(np.int64), **arrays)
        part = part.add_column(1, "info", pa.array(np.full(part.num_rows, info)))
        empty = pa.array([b""] * part.num_rows, pa.binary())
        return pa.RecordBatch.from_arrays([part.column(c) if c in part.schema.names else empty for c in ("bucket", "info", "value", "name", "extra")], ["bucket", "info", "value", "name", "extra"])

    def send(batch, first, end, owner, h):  # noqa: ANN001
        texts = end - first
        node = batch.column(0).slice(first, texts).to_numpy().view(_U)
        n = np.bincount(owner, minlength=texts)
        for view, sets, value, need in pieces(owner, h, n, salt, num, den):
            if len(sets):
                name = (node << _U(1)) | _U(view)
                filled = np.bincount(sets, minlength=texts)
                info = np.zeros(texts, _INFO)
                info["n"], info["short"] = n, need - filled
                has = filled > 0
                yield packed(value % _U(buckets), False, value=_narrow(value // _U(buckets)), name=name[sets])
                yield packed(name[has] % _U(buckets), True, name=name[has], extra=info[has])

    def split(batches: Iterator[pa.RecordBatch]) -> tuple[list[pa.RecordBatch], list[pa.RecordBatch]]:
        told, rest = [], []
        for b in batches:
            for out, part in ((told, b.filter(b.column(1))), (rest, b.filter(pc.invert(b.column(1))))):
                if part.num_rows:
                    out.append(part)
        return told, rest

    def values(batches: list[pa.RecordBatch]) -> np.ndarray:
        """Values without the names of their buckets, which came in front of them."""
        return np.concatenate([_wide(b"".join(raw)) * _U(buckets) + np.repeat(b.column(0).to_numpy(), [len(x) // 6 for x in raw]).astype(_U) for b in batches for raw in [b.column(2).to_pylist()]])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, rest = split(batches)
        yield from told
        if not rest:
            return
        value, name = values(rest), np.concatenate([_unpack(b, "name", "<u8") for b in rest])
        order = np.argsort(value, kind="stable")
        value, name = value[order], name[order]
        start, run = _groups(value)
        often = np.diff(np.append(start, len(value)))[run]
        keep = often > 1
        if keep.any():
            value, name, often = value[keep], name[keep], often[keep]
            yield packed(name % _U(buckets), False, value=np.ascontiguousarray(mix(value)).view("V8"), name=name, extra=often.astype(np.int32))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, rest = split(batches)
        if not rest:
            return
        value, name, often = (np.concatenate([_unpack(b, c, t) for b in rest]) for c, t in (("value", "<u8"), ("name", "<u8"), ("extra", "<i4")))
        known, info = (np.concatenate([_unpack(b, c, t) for b in told]) for c, t in (("name", "<u8"), ("extra", _INFO)))
        by = np.argsort(known, kind="stable")
        order = np.lexsort((value, often, name))
        value, name = value[order], name[order]
        own = info[by[np.searchsorted(known[by], name)]]
        start, run = _groups(name)
        shared = np.diff(np.append(start, len(name)))[run]
        at = np.flatnonzero(np.arange(len(name)) - start[run] < own["short"] + shared)
        for k in range(0, len(at), 1 << 18):
            p = at[k : k + (1 << 18)]
            yield pa.RecordBatch.from_pydict({"key": pa.array(value[p].view(np.int64)), "node": pa.array((name[p] >> _U(1)).view(np.int64)), "n": pa.array(own["n"][p].astype(np.int64))})

    schema = "bucket long, info boolean, value binary, name binary, extra binary"
    met = texts.select("node", "text").mapInArrow(_rows(send, width, 1), schema).repartition(buckets, "bucket").mapInArrow(count, schema)
    return met.repartition(buckets, "bucket").mapInArrow(choose, "key long, node long, n long")


def distinct_buckets(entries: DataFrame) -> DataFrame:
    """The entries (key, node, n) without buckets of one set, and with one bucket for all that hold the same sets, as those
    of one passage do."""
    names = [F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"_s{k}") for k in (1, 2)]
    per = entries.groupBy("key").agg(F.count("*").alias("_c"), *names).where("_c > 1")
    one = per.groupBy("_c", "_s1", "_s2").agg(F.min("key").alias("key"))
    return entries.join(one.select("key"), "key", "left_semi")


def sketches(texts: DataFrame, width: int, bits: int = SKETCH_BITS) -> DataFrame:
    """(node, sketch): the dense parity sketch of each set."""

    def run(batch, first, end, owner, h):  # noqa: ANN001
        count = end - first
        place = (mix(h ^ _U(0x8EBC6AF09C88C6E3)) % _U(bits)).astype(np.int64)
        flips = np.bincount(owner * bits + place, minlength=count * bits) & 1
        packed = np.packbits(flips.astype(np.uint8).reshape(count, bits), axis=1)
        yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, count), pa.array([r.tobytes() for r in packed], pa.binary())], ["node", "sketch"])

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(1), 250_000):  # 2048 counters a text
                for a in range(0, end - first, 256):
                    b = min(a + 256, end - first)
                    owner, h = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                    yield from run(batch, first + a, first + b, owner, h)

    return texts.select("node", "text").mapInArrow(small, "node long, sketch binary")


def verify(pairs: DataFrame, texts: DataFrame, *, width: int, num: int, den: int) -> DataFrame:
    """Those (a, b) of ``pairs`` whose whole texts' sets reach the threshold."""
    left = texts.select(F.col("node").alias("_l"), F.col("text").alias("left"))
    right = texts.select(F.col("node").alias("_r"), F.col("text").alias("right"))
    both = pairs.join(left, F.col("a") == F.col("_l")).join(right, F.col("b") == F.col("_r")).select("a", "b", "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(2)):
                for f2, e2, data2, offsets2 in slices(batch.column(3).slice(first, end - first)):
                    x, xh = shingles(data[offsets[f2] : offsets[e2]], offsets[f2 : e2 + 1] - offsets[f2], width)
                    y, yh = shingles(data2, offsets2, width)
                    count = e2 - f2
                    sizes = np.bincount(x, minlength=count) + np.bincount(y, minlength=count)
                    owner, h = np.concatenate([x, y]), np.concatenate([xh, yh])
                    order = np.argsort(owner, kind="stable")
                    union, _ = distinct(owner[order], h[order])
                    union = np.bincount(union, minlength=count)
                    part = batch.slice(first + f2, count).filter(pa.array((union > 0) & (den * (sizes - union) >= num * union)))
                    if part.num_rows:
                        hit = pa.array(_surely(part.column(2), part.column(3), width, num, den))
                        yield pa.RecordBatch.from_arrays([part.column(0).filter(hit), part.column(1).filter(hit)], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _surely(left: pa.Array, right: pa.Array, width: int, num: int, den: int) -> np.ndarray:
    """Which pairs of texts are linked, given that all are by the hashes of their shingles: where shingles of one hash
    hold other words, the words themselves are counted."""
    count = len(left)
    out = np.ones(count, bool)
    for _, _, data, offsets in slices(pa.concat_arrays([left, right]), 1 << 62):
        text, h, at, words, starts, ends = shingle_rows(data, offsets, width)
        word, _ = codes(LOWER[data], starts, ends)
        order = np.lexsort((h, text % count))
        pair, h, at, words = text[order] % count, h[order], at[order], words[order]
        same = np.flatnonzero((h[1:] == h[:-1]) & (pair[1:] == pair[:-1]))
        a, b = at[same], at[same + 1]
        other = words[same] != words[same + 1]
        for k in range(width):
            held = words[same] > k
            other |= held & (word[np.minimum(a + k, len(word) - 1)] != word[np.minimum(b + k, len(word) - 1)])
        for p in np.unique(pair[same[other]]).tolist():
            mine = [{tuple(word[i : i + n]) for i, n in zip(at[pair == p].tolist(), words[pair == p].tolist()) if (i >= np.searchsorted(starts, offsets[count])) == side} for side in (False, True)]
            both = len(mine[0] & mine[1])
            out[p] = both > 0 and den * both >= num * len(mine[0] | mine[1])
    return out


def near_pairs(entries: DataFrame, sketch: DataFrame, num: int, den: int, forest: bool, block: int | None = None, bits: int = SKETCH_BITS) -> DataFrame:
    """(a, b) of pairs in a bucket of ``entries`` (key, node, n, label) that differ in label, can reach the threshold by
    their sizes, and whose sketches are near enough: all of them, or with ``forest`` those that would join what the
    bucket's earlier pairs leave apart.

    Sets outside the bucket's largest label are its probes; they meet all sets of the bucket. Both are dealt in
    blocks, and each block of probes meets each block of sets, so few probes cost little however large the bucket.
    """
    block = BLOCK if block is None else block
    size = entries.groupBy("key", "label").agg(F.count("*").alias("_m")).groupBy("key")
    size = size.agg(F.sum("_m").alias("_c"), F.max("_m").alias("_m"), F.max_by("label", F.struct("_m", "label")).alias("_top")).withColumnRenamed("key", "_k")
    rows = entries.join(size, F.col("key") == F.col("_k")).withColumn("_all", F.ceil(F.col("_c") / block)).withColumn("_few", F.ceil((F.col("_c") - F.col("_m")) / block))
    rows = rows.withColumn("probe", F.col("label") != F.col("_top")).withColumn("_i", F.pmod(F.xxhash64("node"), "_all")).withColumn("_j", F.pmod(F.xxhash64(F.lit(1), "node"), "_few"))
    zero = F.lit(0).cast("long")
    at = lambda i, j, met, meets: F.struct(i.alias("i"), j.alias("j"), met.alias("met"), meets.alias("meets"))
    yes, no = F.lit(True), F.lit(False)
    met = F.transform(F.sequence(zero, F.col("_few") - 1), lambda j: at(F.col("_i"), j, yes, no))
    meets = F.transform(F.sequence(zero, F.col("_all") - 1), lambda i: at(i, F.col("_j"), no, yes))
    places = F.when((F.col("_all") == 1) & (F.col("_few") == 1), F.array(at(zero, zero, yes, F.col("probe")))).when(F.col("probe"), F.concat(met, meets)).otherwise(met)
    rows = rows.select("key", F.explode(places).alias("_p"), "probe", "node", "n", "label").select("key", "_p.i", "_p.j", "_p.met", "_p.meets", "probe", "node", "n", "label")
    rows = rows.join(sketch.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n")).drop("_n")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "n")

    def compare(met, meets, probe, node, n, label, sk):  # noqa: ANN001
        root = label.copy()
        member = np.flatnonzero(met)
        size = n[member]
        for a in np.flatnonzero(meets):
            low, high = np.searchsorted(size, (-(-n[a] * num // den), n[a] * den // num + 1))
            at = member[low:high]
            at = at[(root[at] != root[a]) & (label[at] != label[a]) & (~probe[at] | (node[at] > node[a]))]
            if not len(at):
                continue
            apart = np.bitwise_count(sk[at] ^ sk[a]).sum(axis=1)
            at = at[apart <= most_apart(n[at], n[a], num, den)]
            if forest and len(at):
                at = at[np.unique(root[at], return_index=True)[1]]
                root[np.isin(root, root[at])] = root[a]
            if len(at):
                yield np.full(len(at), node[a]), node[at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bits // 64
        held: list[tuple] = []
        pending: list[np.ndarray] = []
        last = None

        def flush() -> Iterator[pa.RecordBatch]:
            for x, y in compare(*(np.concatenate(c) for c in zip(*held))):
                pending.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
            if sum(map(len, pending)) > 200_000:
                yield from send()

        def send() -> Iterator[pa.RecordBatch]:
            if pending:  # a pair meets in many buckets; a task sends it about once
                both = np.unique(np.concatenate(pending), axis=0)
                pending.clear()
                yield pa.RecordBatch.from_pydict({"a": pa.array(both[:, 0]), "b": pa.array(both[:, 1])})

        for batch in batches:
            if not batch.num_rows:
                continue
            col = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(9)]
            sk = np.frombuffer(b"".join(batch.column(9).to_pylist()), "<u8").reshape(-1, words)
            change = np.flatnonzero(np.append(True, (col[0][1:] != col[0][:-1]) | (col[1][1:] != col[1][:-1]) | (col[2][1:] != col[2][:-1])))
            for s, e in zip(change, np.append(change[1:], batch.num_rows)):
                name = (col[0][s], col[1][s], col[2][s])
                if name != last and held:
                    yield from flush()
                    held.clear()
                last = name
                held.append((*(c[s:e] for c in col[3:]), sk[s:e]))
        if held:
            yield from flush()
        yield from send()

    return rows.mapInArrow(run, "a long, b long").distinct()


def _grouped(docs: DataFrame, keep: list[str], width: int, num: int, den: int, leader_rounds: int) -> DataFrame:
    """``keep``, ``n`` and the columns of ``_GROUP`` of every row of ``docs`` (``keep``, doc_id, text): equal in rows that
    links join, where n > 0."""
    spark = docs.sparkSession
    for salt in range(8):
        sets = stage(measure(docs, keep=keep, text="text", width=width, num=num, den=den, salt=salt), "sets")
        if sets.where("spare0 < 0 or spare1 < 0").isEmpty():
            break
        drop_staged(sets)
    else:
        raise RuntimeError("no salt fills enough pieces")
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(16, -(-total // ENTRIES_PER_BUCKET))
    common = paired(docs, buckets, text="text", width=width, num=num, den=den, salt=salt)
    common = stage(common.groupBy("node").agg(*(F.coalesce(F.sum(F.when(F.col("view") == v, F.col("common"))), F.lit(0)).alias(f"common{v}") for v in (0, 1))), "paired")
    release(spark)
    # a set with D + 1 pieces of its own, in both bands, has no partner
    named = sets.where("n > 0").groupBy("node", "check").agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("spare0", "spare1")))
    chosen = named.join(common, "node").where("common0 > spare0 or common1 > spare1").select("node", "check", "rep")
    chosen = stage(chosen, "chosen")
    # the text of a set is that of any row with the id of one of its rows; ids can repeat with other texts
    reps = chosen.select(F.col("rep").alias("_rep")).distinct().hint("merge")  # as many as near copies, at any size of table
    found = docs.join(reps, F.col("doc_id") == F.col("_rep"), "left_semi").select("text")
    if not chosen.where("rep is null").isEmpty():  # sets that only rows without an id have
        found = found.union(docs.where("doc_id is null").select("text"))
    whole = _with_names(found, width).join(chosen.select("node", "check"), ["node", "check"], "left_semi").dropDuplicates(["node", "check"])
    texts = stage(whole.withColumnRenamed("node", "name").withColumn("node", F.monotonically_increasing_id()), "texts")
    release(spark)

    size = texts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    pieced = stage(shared_pieces(texts, max(16, -(-size // ENTRIES_PER_BUCKET)), width=width, num=num, den=den, salt=salt), "pieces")
    entries = stage(distinct_buckets(pieced), "entries")
    drop_staged(pieced)
    sketch = stage(sketches(texts, width), "sketches")
    release(spark)
    links, labels, failed = None, None, None
    for k in range(leader_rounds + 2):
        rows = entries
        if labels is not None:
            rows = rows.join(labels.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").drop("_n")
            rows = rows.withColumn("label", F.coalesce("label", "node"))
        else:
            rows = rows.withColumn("label", F.col("node"))
        lead = F.struct(F.xxhash64(F.lit(k), "node").alias("h"), F.col("node").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"))
        open_ = rows.groupBy("key").agg(F.min(lead).alias("_lead"), F.min("label").alias("_x"), F.max("label").alias("_y")).where("_x <> _y")
        open_ = open_.select(F.col("key").alias("_k"), "_lead")
        if k < leader_rounds:
            pairs = rows.join(open_, F.col("key") == F.col("_k")).where("label <> _lead.la")
            pairs = pairs.where((den * F.least("n", "_lead.na") >= num * F.greatest("n", "_lead.na")))
            pairs = pairs.groupBy("node", F.col("_lead.a").alias("b")).count().groupBy("node").agg(F.max_by("b", F.struct("count", "b")).alias("b"))
            pairs = pairs.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
        else:
            pairs = near_pairs(rows.join(open_, F.col("key") == F.col("_k"), "left_semi"), sketch, num, den, forest=k == leader_rounds)
        pairs = stage(pairs if failed is None else pairs.join(failed, ["a", "b"], "left_anti"), "pairs")
        fresh = stage(verify(pairs, texts, width=width, num=num, den=den), "links")
        missed = pairs.join(fresh, ["a", "b"], "left_anti")
        failed = missed if failed is None else failed.union(missed)
        if links is not None and fresh.isEmpty():
            continue
        links = fresh if links is None else links.union(fresh)
        labels = stage(components(links), "labels")
        release(spark)
    joined = stage(texts.select("name", "check", "node").join(labels, "node").select(F.col("name").alias("_name"), F.col("check").alias("_check"), "label"), "joined")
    for used in (common, chosen, texts, entries, sketch):
        drop_staged(used)
    out = sets.join(joined, (F.col("node") == F.col("_name")) & (F.col("check") == F.col("_check")), "left")
    alone = F.col("label").isNull()
    return out.select(*keep, "n", alone.alias("_g0"), F.coalesce("label", "node").alias("_g1"), F.when(alone, F.col("check")).otherwise(F.lit(0)).alias("_g2"))


_GROUP = ["_g0", "_g1", "_g2"]


def link(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, num: int = NUM, den: int = DEN, leader_rounds: int = LEADER_ROUNDS) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` (smallest id reachable by links) of every document.

    Two documents are linked when den * |A and B| >= num * |A or B| for their sets of ``width``-word shingles.
    """
    rows = _grouped(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ["doc_id"], width, num, den, leader_rounds)
    out = _joined(rows, F.min("doc_id")).select("doc_id", "n", F.when(F.col("_of") > 1, F.col("_least")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.select(F.col("doc_id").alias(doc_id), F.col("n").alias("n_shingles"), "component_id")


def _joined(rows: DataFrame, least: Column) -> DataFrame:
    """The rows of ``_grouped`` with ``_least`` of their group and ``_of``, its rows; nulls for rows that are alone or have no
    words. Groups of several rows are few; each goes to ``SALTS`` places, so a large one is not joined in one task."""
    groups = rows.where("n > 0").groupBy(*_GROUP).agg(least.alias("_least"), F.count("*").alias("_of")).where("_of > 1")
    groups = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    salted = rows.withColumn("_salt", F.when(F.col("n") > 0, F.pmod(F.xxhash64(F.col("doc_id"), F.monotonically_increasing_id()), F.lit(SALTS))))
    return salted.join(groups, [*_GROUP, "_salt"], "left").drop("_salt")


def _with_names(docs: DataFrame, width: int) -> DataFrame:
    """Rows (node, check, n, text) for rows (text)."""

    def run(batch, first, end, owner, h):  # noqa: ANN001
        texts = end - first
        names = [pa.array(x.view(np.int64)) for x in fingerprints(owner, h, texts)]
        yield pa.RecordBatch.from_arrays([*names, pa.array(np.bincount(owner, minlength=texts)), batch.column(0).slice(first, texts)], ["node", "check", "n", "text"])

    zero = F.lit(0).cast("long")
    return docs.mapInArrow(_rows(run, width, 0), docs.select(zero.alias("node"), zero.alias("check"), zero.alias("n"), "text").schema)


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, num: int = NUM, den: int = DEN, leader_rounds: int = LEADER_ROUNDS) -> DataFrame:
    """The documents with one row of each component left: the one with the smallest id (a null id is the largest), of
    repeated rows any one. Documents without words stay.

    Where ids are unique and not null they name the rows; otherwise the rows are numbered and written once first.
    """
    names = docs.columns
    own = "_row" + "_" * max((len(c) for c in names), default=0)  # no column has this name
    ids = docs.select(F.col(f"`{doc_id}`").alias("_id")).groupBy("_id").count()
    options = {"width": width, "num": num, "den": den, "leader_rounds": leader_rounds}
    if ids.where("_id is null or count > 1").isEmpty():
        joined = link(docs.select(doc_id, text), doc_id=doc_id, text=text, **options)
        gone = joined.where(F.col("component_id") < F.col(doc_id)).select(F.col(doc_id).alias(own))
        return docs.join(gone, F.col(f"`{doc_id}`") == F.col(own), "left_anti")
    docs = stage(docs.withColumn(own, F.monotonically_increasing_id()), "rows")
    rows = _grouped(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(own).alias("row")), ["doc_id", "row"], **options).where("n > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    gone = _joined(rows, first).where("row <> _least.row").select(F.col("row").alias(own))
    return docs.join(gone, own, "left_anti").select(*(F.col(f"`{c}`") for c in names))
