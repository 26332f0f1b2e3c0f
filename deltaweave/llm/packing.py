"""Packing token streams into fixed-length sequences with a controlled mixture.

Documents become token streams, one queue per source. Queues are served by deficit round-robin: in every
round ("window") a source is credited with its share of the window's tokens and sends pieces of documents
while its credit covers them; what is left is carried on. Served in that order, the pieces form one stream,
which is cut every ``length`` tokens, so no sequence but the last has padding.

For queues that are never empty the round of a piece has a closed form: the first r with r times the credit
at least the queue's tokens up to the end of the piece. It needs only prefix sums, so deficits are carried
over windows and partitions without a sequential pass: places in a queue come from sums over buckets of
about 1000 documents, places in the stream from sums over rounds, both summed before the shuffle. A hot
source has more buckets, not a larger one. Tokens are written once; one join brings the plan to them.

``Chunks`` tokenizes each distinct chunk of a slice of texts once. Chunks end before a space that follows
a printable character; no token of the byte-level pattern reaches over such a place.

Nulls: a null text is empty and has its end id alone; a null source is a queue of its own. Repeated rows
are packed each. No documents: no rows.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from deltaweave.llm.staging import before, stage
from deltaweave.llm.text import owners, slices

LENGTH = 2048
END_ID = 1
WINDOW_SEQUENCES = 128
SLICE = 2_500_000


class Chunks:
    """Ids of texts as the ``tokenizers`` file gives them, without added special tokens.

    ``ranks``: the same vocabulary for ``tiktoken``, which encodes chunks that hold no special-token text; the
    file of ``tokenizers`` encodes the others, and all chunks if no ranks are given.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        self.path, self._whole = path, None
        with open(path, encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        special = [t["content"].encode() for t in added]
        self.is_special = re.compile(b"|".join(map(re.escape, sorted(special, key=len, reverse=True))) if special else b"(?!)").search
        # a token that takes in white space, or looks at what stands around it, can reach over the end of a chunk
        self.whole_texts = any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added) or any(b" " in t for t in special)
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("chunks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
            self.bytes_of = np.zeros(max(table.values()) + 1, np.int64)
            for k, v in table.items():
                self.bytes_of[v] = len(k)

    @property
    def whole(self):  # noqa: ANN201
        """The tokenizer of the file; loaded when a chunk needs it."""
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.path)
        return self._whole

    def bounds(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where chunks begin, and the end."""
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        if len(data) > 1 and not self.whole_texts:
            printable = (data[:-1] > 0x20) & (data[:-1] < 0x7F)
            two = np.zeros(len(data) - 1, bool)  # the end of a two-byte character from U+00C0 on
            two[1:] = (data[:-2] >= 0xC3) & (data[:-2] <= 0xDF) & (data[1:-1] >= 0x80)
            cut[1:-1] |= (data[1:] == 0x20) & (printable | two)
        return np.flatnonzero(cut)

    def _encode(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts, number of ids of each)."""
        if self.fast is None:
            ids = [e.ids for e in self.whole.encode_batch([p.decode() for p in parts], add_special_tokens=False)]
            return np.array([i for x in ids for i in x], np.int64), np.array([len(x) for x in ids], np.int64)
        count = np.zeros(len(parts), np.int64)
        plain, odd = [], []
        for k, p in enumerate(parts):
            # a space, then no white space: such parts in a row are one text that is cut between them again
            (plain if p[:1] == b" " and len(p.split()) == 1 and p[1:2] != b" " and p.isascii() and self.is_special(p) is None and not p[1:2].isspace() and p[-1:] > b" " else odd).append(k)
        ids = np.array(self.fast.encode_ordinary(b"".join([parts[k] for k in plain]).decode()), np.int64)
        length = np.array([len(parts[k]) for k in plain], np.int64)
        where = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(length), side="left") + 1
        count[plain] = np.diff(where, prepend=0)
        own = {}
        for k in odd:
            p = parts[k]
            own[k] = self.whole.encode(p.decode(), add_special_tokens=False).ids if self.is_special(p) else self.fast.encode_ordinary(p.decode())
            count[k] = len(own[k])
        first = np.concatenate([[0], np.cumsum(count)])
        out = np.zeros(first[-1], np.int64)
        keep = np.ones(len(out), bool)
        for k, x in own.items():
            out[first[k] : first[k + 1]] = x
            keep[first[k] : first[k + 1]] = False
        out[keep] = ids
        return out, count

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of each text's ids) of a slice."""
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
        at = self.bounds(data, offsets)
        begin = at[:-1]
        chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        which = chunks.indices.to_numpy()
        ids, count = self._encode(chunks.dictionary.to_pylist())
        first = np.cumsum(count) - count
        size = count[which]
        upto = np.cumsum(size)
        place = np.arange(upto[-1]) - np.repeat(upto - size, size)
        out = ids[np.repeat(first[which], size) + place]
        chunk_of = np.searchsorted(begin, offsets)
        return out, np.concatenate([[0], upto])[chunk_of]


def tokenize(docs: DataFrame, path: str, ranks: str | None = None, pattern: str | None = None, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", end_id: int = END_ID) -> DataFrame:
    """``doc_id``, ``source``, ``n`` and ``ids`` (little-endian, two bytes an id if the vocabulary allows, else
    four) of every document's whole text, with the end id behind."""
    from tokenizers import Tokenizer

    narrow = max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1) <= 1 << 16
    kind = "<u2" if narrow else "<u4"
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    schema = picked.drop("text").withColumns({"n": F.lit(0).cast("long"), "ids": F.lit(b"")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks(path, ranks, pattern)
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(2), SLICE):
                ids, at = chunks.encode(data, offsets)
                whole = np.insert(ids, at[1:], end_id).astype(kind).tobytes()
                at = (at + np.arange(len(at))) * (2 if narrow else 4)
                blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(whole)]).cast(pa.binary())
                size = pa.array(np.diff(at) // (2 if narrow else 4))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), batch.column(1).slice(first, end - first), size, blobs], ["doc_id", "source", "n", "ids"])

    return picked.mapInArrow(run, schema)


def plan(streams: DataFrame, length: int = LENGTH, window: int = WINDOW_SEQUENCES, shares: dict[str | None, float] | None = None, seed: int = 7) -> DataFrame:
    """Per row of ``streams`` (``_row``, ``source``, ``n``) the ``pieces`` of its stream: an array of
    (start, length, sequence_id, offset).

    ``shares``: the target part of each source in every window; by default its part of all tokens. A source
    that ``shares`` does not name keeps its part of all tokens; one with a share of 0 comes after all others; one
    whose queue is empty leaves its part of the window to the others.
    """
    totals = streams.groupBy("source").agg(F.sum("n").alias("_of"), F.ceil(F.count("*") / 1000).alias("_nb"))
    everything = totals.agg(F.sum("_of")).first()[0] or 0
    part = F.col("_of") / max(everything, 1)
    if shares is not None:
        given = streams.sparkSession.createDataFrame([(k, float(v)) for k, v in shares.items()], "_k string, _share double")
        totals = totals.join(F.broadcast(given), F.col("source").cast("string").eqNullSafe(F.col("_k")), "left")  # as long as ``shares``
        part = F.coalesce("_share", part)
    totals = totals.select(F.col("source").alias("_s"), "_of", "_nb", (part * (window * length)).alias("_credit"))
    # a source without credit is served once all others are: its rounds begin after theirs
    last = totals.where("_credit > 0").agg(F.coalesce(F.max(F.ceil(F.col("_of") / F.col("_credit"))), F.lit(0))).first()[0]
    rest = F.col("_credit") <= 0
    totals = totals.select("_s", "_nb", F.when(rest, float(window * length)).otherwise(F.col("_credit")).alias("_credit"), F.when(rest, last).otherwise(0).cast("long").alias("_after"))
    docs = streams.join(totals, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    unit = F.xxhash64(F.lit(seed), "_row") / F.lit(2.0**64) + 0.5
    docs = docs.withColumn("_b", F.least(F.floor(unit * F.col("_nb")), F.col("_nb") - 1))
    docs = stage(docs, "pack-queues")
    sums = before(docs, "_b", {"_before": "n"}, ["source"])
    sums = sums.select(F.col("source").alias("_s"), F.col("_b").alias("_sb"), "_before")
    w = Window.partitionBy("source", "_b").orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    docs = docs.withColumn("_in", F.sum("n").over(w)).join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_sb"))).drop("_s", "_sb")
    docs = docs.withColumn("_from", F.col("_before") + F.col("_in") - F.col("n"))
    cut = F.explode(F.expr(f"sequence(0L, n - 1, {length}L)")).alias("start")
    units = docs.select("_row", "source", "_from", "_credit", "_after", "n", cut).withColumn("size", F.least(F.lit(length), F.col("n") - F.col("start")))
    units = units.withColumn("_round", F.col("_after") + F.ceil((F.col("_from") + F.col("start") + F.col("size")) / F.col("_credit")))
    units = units.select("_row", "source", "start", "size", (F.col("_from") + F.col("start")).alias("_pos"), "_round")
    served = before(units, "_round", {"_served": "size"}).withColumnRenamed("_round", "_r")
    w = Window.partitionBy("_round").orderBy("source", "_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    units = units.withColumn("_in", F.sum("size").over(w)).join(served, F.col("_round") == F.col("_r"))
    units = units.withColumn("_g", F.col("_served") + F.col("_in") - F.col("size"))
    room = F.lit(length) - F.col("_g") % length
    head = F.struct(F.col("start"), F.least("size", room).alias("length"), F.floor(F.col("_g") / length).alias("sequence_id"), (F.col("_g") % length).alias("offset"))
    tail = F.struct((F.col("start") + room).alias("start"), (F.col("size") - room).alias("length"), (F.floor(F.col("_g") / length) + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    both = F.when(F.col("size") > room, F.array(head, tail)).otherwise(F.array(head))
    return units.select("_row", both.alias("_p")).groupBy("_row").agg(F.flatten(F.collect_list("_p")).alias("pieces"))


def pack(docs: DataFrame, path: str, ranks: str | None = None, pattern: str | None = None, *, length: int = LENGTH, window: int = WINDOW_SEQUENCES, shares: dict[str | None, float] | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source", end_id: int = END_ID) -> DataFrame:
    """One row per piece: ``doc_id``, ``start`` (ids of its document before it), ``length``, ``doc_tokens``,
    ``sequence_id``, ``offset`` and ``ids`` (binary, unsigned little-endian 32-bit)."""
    tokens = tokenize(docs, path, ranks, pattern, doc_id=doc_id, text=text, source=source, end_id=end_id)
    tokens = stage(tokens.withColumn("_row", F.monotonically_increasing_id()), "pack-tokens")
    planned = plan(tokens.select("_row", "source", "n"), length, window, shares)
    joined = tokens.select("_row", "doc_id", "n", "ids").join(planned, "_row").select("doc_id", "n", "ids", "pieces")
    schema = joined.select("doc_id", *(F.lit(0).cast("long").alias(c) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")), F.lit(b"").alias("ids")).schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            pieces = batch.column(3)
            flat = pieces.flatten()
            start, size, sequence, offset = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            of = owners(pieces.offsets.to_numpy() - pieces.offsets[0].as_py())
            n = batch.column(1).to_numpy()
            blobs = batch.column(2).to_pylist()
            at, flush = 0, 1 << 22  # ids are sent on in batches of about 16 MB
            ends = np.cumsum(size)
            while at < len(of):
                stop = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + flush, side="right")), at + 1)
                ids = []
                for k, s, z in zip(of[at:stop].tolist(), start[at:stop].tolist(), size[at:stop].tolist()):
                    blob = blobs[k]
                    kind = "<u2" if len(blob) == 2 * n[k] else "<u4"
                    ids.append(np.frombuffer(blob, kind)[s : s + z].astype("<u4").tobytes())
                part = slice(at, stop)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(of[part])), *(pa.array(x[part].astype(np.int64)) for x in (start, size, n[of], sequence, offset)), pa.array(ids, pa.binary())],
                    ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
                )
                at = stop

    return joined.mapInArrow(cut, schema).withColumnRenamed("doc_id", doc_id)
