"""Array kernels over UTF-8 bytes, shared by the operators that read whole texts.

An Arrow string column is one byte buffer with offsets. The helpers cut a batch into slices of
about ``SLICE_BYTES`` made of whole texts (a longer text is a slice of its own), so memory follows
the slice and never the batch, and no text is cut short. Nulls count as empty texts.

Hashes are 64-bit. A span's bytes are cut in lanes of eight; every lane is mixed with its number and the mixed
lanes are summed, so no sum over the bytes themselves can cancel. Where a result promises to be exact, ``codes``
compares the bytes.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1_500_000

_U = np.uint64
_STEP, _SIZE = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)

#: The separators of words: \x20 and \x09-\x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive runs of whole texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), n)
        end = min(end, at + (1 << 20))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end
    give_back()


def give_back() -> None:
    """Return freed memory to the system, so that a Python worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche; a bijection of 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a number, and one for the end; zeros follow the data."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for arrays of starts and ends."""
    lane, size = lanes(data), end - start
    out = mix((lane[start] & _FIRST[np.minimum(size, 8)]) + _STEP)
    long = np.flatnonzero(size > 8)
    if len(long):
        more = (size[long] - 1) >> 3
        upto = np.cumsum(more)
        number = np.arange(1, upto[-1] + 1) - np.repeat(upto - more, more)
        at = np.repeat(start[long], more) + 8 * number
        left = np.minimum(np.repeat(end[long], more) - at, 8)
        rest = mix((lane[at] & _FIRST[left]) + (number + 1).astype(_U) * _STEP)
        out[long] += np.add.reduceat(rest, upto - more)
    return mix(out + size.astype(_U) * _SIZE)


def gram_hash(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each place at which there are k; k is 8 or more."""
    lane, n = lanes(data), max(len(data) - k + 1, 0)
    out = mix(lane[:n] + _STEP)
    for at in range(8, k - 7, 8):
        out = mix(out * _SIZE + lane[at : at + n])
    if k % 8:
        out = mix(out * _SIZE + lane[k - 8 : k - 8 + n])
    return out


def codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, int]:
    """(a number for data[start:end], how many numbers): equal bytes have equal numbers and others don't. Spans
    ascend and don't overlap."""
    bounds = np.empty(2 * len(start) + 1, np.int64)
    bounds[:-1:2], bounds[1::2] = start, end
    bounds[-1] = end[-1] if len(end) else 0
    bounds[2:-1:2] = start[1:]
    spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    found = spans.dictionary_encode()
    return found.indices.to_numpy()[::2].astype(np.int64), len(found.dictionary)


def tuples(parts: list[np.ndarray], n: int) -> np.ndarray:
    """A number below 2**63 for each row of ``parts``, which are below ``n``: equal rows have equal numbers and
    others don't."""
    out, most = parts[0].astype(np.int64), max(n, 1)
    for part in parts[1:]:
        if most * n >= 1 << 62:
            kept, out = np.unique(out, return_inverse=True)
            most = len(kept)
        out, most = out * n + part, most * n
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and one past the last) of runs of non-separators."""
    word = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def owners(first: np.ndarray) -> np.ndarray:
    """For bounds of consecutive groups, the group of each member."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def shingle_rows(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, ...]:
    """(text, hash, first word, number of words) of each place of a word shingle, and (starts, ends) of the words.

    Words are of A-Z lower-cased bytes. A text of fewer words has its whole sequence as one.
    """
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, _U), none, none, starts, ends
    h = span_hash(data, starts, ends)
    count = np.diff(first)
    text = owners(first)
    index = np.arange(len(h)) - first[text]
    room = np.maximum(count - width, 0)[text] >= index
    at = np.flatnonzero(room)
    out = np.zeros(len(at), _U)
    left = count[text[at]] - index[at]
    for k in range(width):
        here = h[np.minimum(at + k, len(h) - 1)]
        factor = _U(pow(0xA24BAED4963EE407 | 1, k + 1, 1 << 64))
        out = out + np.where(left > k, here * factor, _U(0))
    left = np.minimum(left, width)
    return text[at], mix(out + left.astype(_U)), at, left, starts, ends


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of each text's distinct word shingles, by text."""
    return distinct(*shingle_rows(data, offsets, width)[:2])


def distinct(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, value) without repeats, for ascending owners below 2**20; each owner's rows stay together.

    One sort of truncated keys finds the owners that can hold a repeat; only theirs are sorted in full.
    """
    assert not len(owner) or owner[-1] < 1 << 20
    key = np.sort((owner.astype(_U) << _U(44)) | (value >> _U(20)))
    same = key[1:] == key[:-1]
    if not same.any():
        return owner, value
    suspect = np.zeros(int(owner[-1]) + 1, bool)
    suspect[(key[1:][same] >> _U(44)).astype(np.int64)] = True
    at = np.flatnonzero(suspect[owner])
    at = at[np.lexsort((value[at], owner[at]))]
    repeat = (value[at[1:]] == value[at[:-1]]) & (owner[at[1:]] == owner[at[:-1]])
    keep = np.ones(len(owner), bool)
    keep[at[1:][repeat]] = False
    return owner[keep], value[keep]
