"""Secret scans: base patterns, and strings that look random to two character Markov models.

Two first-order models over the characters of identifiers, one of random strings and one of ordinary
identifiers, are estimated from labelled samples: what the base patterns match is labelled secret (with
strings drawn from a seeded generator, so that every alphabet is seen), what stands outside is ordinary.
A run of identifier characters outside the base spans becomes a span of kind ``markov`` when the log-likelihood
ratio of the two models, in total and per character, passes the thresholds. A base span cuts a run in parts, and
each part counts by itself.

The models are fitted on about ``TRAIN_DOCS`` documents, drawn by a hash of the id; counts come back as
one table of fixed size. Scanning is one pass over whole texts without a shuffle.

Nulls: a null text is empty and has no spans. Repeated rows are scanned alike. No documents: no rows.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from deltaweave.llm.text import slices

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SHORTEST = 20
TRAIN_DOCS = 4000
LEAST_TOTAL = 20.0
LEAST_PER_CHAR = 0.8

_K = len(ALPHABET)
_CLASS = np.full(256, _K, np.int64)
_CLASS[list(ALPHABET.encode())] = np.arange(_K)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the base patterns find, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _pairs(strings: list[str]) -> np.ndarray:
    """Counts of adjacent characters of the alphabet, K by K."""
    data = np.frombuffer("\n".join(strings).encode(), np.uint8)
    c = _CLASS[data]
    both = (c[:-1] < _K) & (c[1:] < _K)
    return np.bincount(c[:-1][both] * _K + c[1:][both], minlength=_K * _K).reshape(_K, _K)


def generated(n: int = 600, seed: int = 9) -> list[str]:
    """Labelled random strings: hexadecimal, base 36, base 62 and base 64."""
    r = random.Random(seed)
    low = ALPHABET[:26] + "0123456789"
    return ["".join(r.choices(letters, k=r.randint(20, 64))) for letters in ("0123456789abcdef", low, ALPHABET[:62], ALPHABET[:64]) for _ in range(n)]


@dataclass
class Markov:
    """``ratio[a, b]``: log of the random model's chance of b after a, over the ordinary model's."""

    ratio: np.ndarray

    @classmethod
    def fit(cls, secret: np.ndarray, ordinary: np.ndarray, smooth: float = 0.5) -> Markov:
        def log(counts: np.ndarray) -> np.ndarray:
            x = counts + smooth
            return np.log(x / x.sum(axis=1, keepdims=True))

        wide = np.zeros((_K + 1, _K + 1))
        wide[:_K, :_K] = log(secret) - log(ordinary)
        return cls(wide)

    def runs(self, data: np.ndarray, offsets: np.ndarray, taken: list[tuple[int, int]] = ()) -> Iterator[tuple[int, int, int]]:
        """(text, start, end) in bytes of the slice, of runs outside ``taken`` that pass the thresholds."""
        c = _CLASS[data]
        for s, e in taken:
            c[s:e] = _K
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = c < _K
        starts = np.flatnonzero((inside[1:-1] == 1) & (inside[:-2] == 0))
        ends = np.flatnonzero((inside[1:-1] == 1) & (inside[2:] == 0)) + 1
        cuts = offsets[1:-1]
        if len(starts) and len(cuts):  # a run never crosses texts
            at = np.searchsorted(starts, cuts, side="right") - 1
            split = cuts[(at >= 0) & (starts[np.maximum(at, 0)] < cuts) & (ends[np.maximum(at, 0)] > cuts)]
            starts, ends = np.sort(np.concatenate([starts, split])), np.sort(np.concatenate([ends, split]))
        long = ends - starts >= SHORTEST
        starts, ends = starts[long], ends[long]
        if not len(starts):
            return
        step = np.zeros(len(data))
        step[1:] = self.ratio[c[:-1], c[1:]]
        total = np.cumsum(step)
        score = total[ends - 1] - total[starts]
        hit = (score >= LEAST_TOTAL) & (score >= LEAST_PER_CHAR * (ends - starts))
        text = np.searchsorted(offsets, starts[hit], side="right") - 1
        yield from zip(text.tolist(), starts[hit].tolist(), ends[hit].tolist())


def train(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", most_docs: int = TRAIN_DOCS, seed: int = 9) -> Markov:
    """Fit both models on about ``most_docs`` documents (all, if fewer)."""
    n = docs.count()
    chance = min(1.0, most_docs / max(n, 1))
    picked = docs.where((F.xxhash64(F.lit(seed), F.col(doc_id)) / F.lit(2.0**64)) + 0.5 <= chance).select(F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, _K, _K), np.int64)
        for batch in batches:
            for value in batch.column(0).to_pylist():
                if not value:
                    continue
                at, rest, inside = 0, [], []
                for s, _, e in base_spans(value):
                    rest.append(value[at:s])
                    inside.append(value[max(s, at) : e].rpartition("=")[2].strip(" \"':"))
                    at = max(at, e)
                rest.append(value[at:])
                sums[0] += _pairs(inside)
                sums[1] += _pairs(rest)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int64()), "n": pa.array(sums.ravel()[at], pa.int64())})

    sums = np.zeros(2 * _K * _K)
    for at, k in picked.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n")).collect():  # at most 2 K^2 rows
        sums[at] = k
    secret, ordinary = sums.reshape(2, _K, _K)
    return Markov.fit(secret + _pairs(generated()), ordinary)


def scan(docs: DataFrame, model: Markov, *, text: str = "text", into: str = "secrets") -> DataFrame:
    """The documents with ``into``: an array of (kind, start, end), in code points, end exclusive, ordered by
    start and then kind. Columns of the documents are kept; an own column with that name is replaced."""
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c != into))
    schema = docs.withColumn(into, F.lit(None).cast("array<struct<kind:string,start:long,end:long>>")).schema
    kinds = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for first, end, data, offsets in slices(column):
                spans = [base_spans(v) if v else [] for v in column.slice(first, end - first).to_pylist()]
                taken = []
                for k, own in enumerate(spans):
                    if own:
                        lead = np.flatnonzero((data[offsets[k] : offsets[k + 1]] & 0xC0) != 0x80) + offsets[k]
                        taken += [(lead[s], lead[e - 1] + 1) for s, _, e in own]  # they end in one byte
                upto = None  # characters before each byte of the slice
                for k, s, e in model.runs(data, offsets, taken):
                    if upto is None:
                        upto = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    start = int(upto[s] - upto[offsets[k]])
                    spans[k].append((start, 3, start + e - s))  # characters of the alphabet have one byte
                found = pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(x)] for x in spans], pa.list_(kinds))
                yield pa.RecordBatch.from_arrays([*batch.slice(first, end - first).columns, found], [*batch.schema.names, into])

    return docs.mapInArrow(find, schema)


def redact(docs: DataFrame, model: Markov, *, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The documents with every found span replaced by ``mask``; overlapping spans share one."""
    names = docs.columns
    own = "secrets" + "_" * max((len(c) for c in names), default=0)  # no column has this name
    found = scan(docs, model, text=text, into=own)
    schema = docs.schema

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            k = whole.schema.get_field_index(text)
            for first, end, _, _ in slices(whole.column(k)):
                batch = whole.slice(first, end - first)
                out = []
                for value, spans in zip(batch.column(k).to_pylist(), batch.column(batch.schema.get_field_index(own)).to_pylist()):
                    if spans:
                        parts, at = [], 0
                        for x in spans:
                            if x["start"] >= at:
                                parts += [value[at : x["start"]], mask]
                            at = max(at, x["end"])
                        value = "".join([*parts, value[at:]])
                    out.append(value)
                columns = [pa.array(out, batch.schema.field(k).type) if c == text else batch.column(batch.schema.get_field_index(c)) for c in names]
                yield pa.RecordBatch.from_arrays(columns, names)

    return found.mapInArrow(replace, schema)
