"""Vectorised work on the UTF-8 bytes of Arrow string columns.

A block is a run of whole texts whose bytes lie end to end in one buffer, so
that words, lines and n-grams of hundreds of texts are found by a few numpy
passes. Texts are never cut: a text longer than the block size is a block of
its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK_BYTES = 1_000_000
LONG_SPAN = 512

_U = np.uint64
_MUL1, _MUL2, _GOLD = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)


def bound_batches(spark, rows: int = 1000, size: str = "16m") -> None:
    """Lowers Spark's default limits of an Arrow batch, so that a Python worker holds a few megabytes of texts; limits that somebody has set stay."""
    for key, default, new in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", str(rows)), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", size)):
        if spark.conf.get(key, default) in (default, None):
            spark.conf.set(key, new)


def _table(chars) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


#: Bytes of ``[^\x20\x09-\x0D]``.
NOT_SPACE = ~_table([0x20, *range(0x09, 0x0E)])
#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` once A-Z are lower-cased.
WORD = _table([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: First bytes of code points.
LEAD = _table(x for x in range(256) if x & 0xC0 != 0x80)
#: A-Z to a-z, the rest as it is.
LOWER = np.array([x + 32 if 65 <= x <= 90 else x for x in range(256)], np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> _U(30))
    x *= _MUL1
    x ^= x >> _U(27)
    x *= _MUL2
    x ^= x >> _U(31)
    return x


def combine(parts) -> np.ndarray:
    """One hash of several arrays of hashes, in order."""
    out = None
    for p in parts:
        out = mix(p + _GOLD) if out is None else mix((out * _U(3)) ^ (p + _GOLD))
    return out


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return data, (offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64))


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of whole texts, of at most so many bytes unless one text has more."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of the maximal runs of bytes in ``inside``; first[d]:first[d + 1] are those of text d."""
    m = inside[data]
    if not len(m):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    begin, end = m.copy(), m.copy()
    begin[1:] &= ~m[:-1]
    end[:-1] &= ~m[1:]
    edge = offsets[offsets < len(m)]
    begin[edge] = m[edge]
    edge = offsets[offsets > 0] - 1
    end[edge] = m[edge]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r"""(starts, ends, first) of the pieces that splitting each text at \n gives, empty ones left out."""
    return spans(data, offsets, ~_table([0x0A]))


def eights(data: np.ndarray) -> np.ndarray:
    """For each position, the next eight bytes as an integer; past the end, zeros."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    out = np.empty(len(data) + 8, np.uint64)
    for p in range(8):
        own = len(out[p::8])
        out[p::8] = np.frombuffer(padded, "<u8", own, p) if p + 8 * own <= len(padded) else np.frombuffer(np.concatenate([padded[p:], np.zeros(8, np.uint8)]).tobytes(), "<u8", own)
    return out


_MASK = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    loads = eights(data)
    length = ends - starts
    out = mix(loads[starts] & _MASK[np.minimum(length, 8)] ^ (length.astype(np.uint64) * _GOLD))
    k, left = 8, np.flatnonzero((length > 8) & (length <= LONG_SPAN))
    while len(left):
        part = loads[starts[left] + k] & _MASK[np.minimum(length[left] - k, 8)]
        out[left] = mix((out[left] * _U(3)) ^ (part + _GOLD))
        k += 8
        left = left[length[left] > k]
    for i in np.flatnonzero(length > LONG_SPAN):
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


def grams(hashes: np.ndarray, first: np.ndarray, k: int, whole_if_short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, first) of the runs of k words of each text. whole_if_short: a text of 1 to k-1 words gives one gram of them all."""
    n = np.diff(first)
    count = np.maximum(n - k + 1, 0)
    if whole_if_short:
        count = np.where((n > 0) & (n < k), 1, count)
    out = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(out[-1]) + np.repeat(first[:-1] - out[:-1], count)
    if not len(at):
        return np.zeros(0, np.uint64), at, out
    if not whole_if_short:
        return combine([hashes[at + j] for j in range(k)]), at, out
    stop = np.repeat(first[1:], count)
    last = max(len(hashes) - 1, 0)
    return combine([np.where(at + j < stop, hashes[np.minimum(at + j, last)], _U(j)) for j in range(k)]), at, out


def owner(first: np.ndarray) -> np.ndarray:
    """For each element, the text that it belongs to."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def same_groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): an order that brings equal keys together, and where in it a new key begins."""
    order = np.argsort(keys)
    s = keys[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    return order, new


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n positions lie in one of the spans."""
    d = np.bincount(starts, minlength=n + 1)[: n + 1].astype(np.int64) - np.bincount(ends, minlength=n + 1)[: n + 1]
    return np.cumsum(d)[:n] > 0


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over the elements of each text."""
    c = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return c[first[1:]] - c[first[:-1]]
