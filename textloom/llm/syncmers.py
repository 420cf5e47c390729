"""Document fingerprints from closed syncmers.

A run of ``K`` bytes is an anchor if, of the ``S``-byte strings inside it, a
smallest one (by hash) lies at either end. Whether a run is an anchor depends
on its own bytes alone, so a passage keeps its anchors wherever it stands.
A fingerprint holds one anchor in ``share`` by hash, and the ``keep`` of
smallest hash at least, with the byte offsets of their first places: a sample
that grows with the text and is the same wherever texts agree. With a share of
1 it holds all anchors. Likeness counts, among the sampled anchors of both
texts together, the longest chain of those that both have in the same order,
so insertions cost only what they add.

Edge cases: null counts as empty; the empty text has the fingerprint ``-`` and
is like the empty text alone (1, else 0). A text without an anchor, as one of
fewer bytes than a run has, gets one made of all its bytes. Ids can be
integers, strings or dates. Rows of equal id are ordered by a hash of their text;
of repeated rows each is the next one's predecessor. Null ids come first. With
one row, that row is its own next. Only the two named columns are read, so
other columns cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import textbytes as tb

K, S = 12, 6
#: Bytes of texts that a range should hold, and ids that are looked at for each cut between ranges.
RANGE_BYTES, TRIES = 64_000_000, 20
#: Ranges and keys that the driver holds at most.
MOST_RANGES, MOST_KEYS = 20_000, 100_000


@dataclass(frozen=True)
class Sample:
    """Which anchors a fingerprint keeps: one in ``share`` by hash, and ``keep`` at least if there are so many. A share of 1 keeps all."""

    keep: int = 64
    share: int = 16

    @property
    def below(self) -> np.uint64:
        """The largest hash that is kept in any case."""
        return np.uint64(2**64 // self.share - 1)


DEFAULT = Sample()


def _scale(data: np.ndarray, offsets: np.ndarray, k: int, s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, offset in the text) of the closed syncmers of one scale; k is at most 2s, so the two end strings are the whole run."""
    n, w = len(data), k - s + 1
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = tb.mix(tb.eights(data)[: n - s + 1] & tb._MASK[s])
    low, have = h, 1
    while have < w:
        step = min(have, w - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    at = np.flatnonzero((h[: len(low)] == low) | (h[w - 1 :] == low))
    text = np.searchsorted(offsets, at, "right") - 1
    ok = at + k <= offsets[text + 1]
    at, text = at[ok], text[ok]
    return text, tb.combine([h[at], h[at + w - 1]]), at - offsets[text]


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, offset in the text) of every anchor of a block's texts."""
    text, value, at = _scale(data, offsets, K, S)
    size = np.diff(offsets)
    for d in np.flatnonzero((np.bincount(text, minlength=len(size)) == 0) & (size > 0)):
        own = data[offsets[d] : offsets[d + 1]].tobytes()
        text, at, value = np.append(text, d), np.append(at, 0), np.append(value, np.uint64(xxhash.xxh3_64_intdigest(own)))
    return text, value, at


def fingerprints(data: np.ndarray, offsets: np.ndarray, sample: Sample = DEFAULT) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes in ascending order, offsets of their first places) of the kept anchors of each text."""
    text, value, at = anchors(data, offsets)
    n = len(offsets) - 1
    if not n:
        return []
    # Far too large hashes cannot be among the smallest; the rest are ordered. Repeats are why some room is left, and a text that falls short is done in full.
    count = np.bincount(text, minlength=n)
    many = count > 8 * sample.keep
    bound = np.where(many, (4.0 * sample.keep / np.maximum(count, 1)) * 2.0**64, 2.0**64)
    maybe = (value.astype(np.float64) < bound[text]) | (value <= sample.below)
    out = _smallest(text[maybe], value[maybe], at[maybe], n, sample)
    short = [d for d in np.flatnonzero(many) if len(out[d][0]) < sample.keep]
    if short:
        own = np.isin(text, short)
        again = _smallest(text[own], value[own], at[own], n, sample)
        for d in short:
            out[d] = again[d]
    return out


def _smallest(text, value, at, n, sample: Sample) -> list[tuple[np.ndarray, np.ndarray]]:
    order = np.lexsort((at, value, text))
    text, value, at = text[order], value[order], at[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    text, value, at = text[new], value[new], at[new]
    first = np.searchsorted(text, np.arange(n + 1))
    dense = np.bincount(text[value <= sample.below], minlength=n)
    stop = np.minimum(first[1:], first[:-1] + np.maximum(dense, sample.keep))
    return [(value[a:b], at[a:b]) for a, b in zip(first[:-1], stop, strict=True)]


def written(fp: tuple[np.ndarray, np.ndarray]) -> str:
    """hash@offset of each anchor, in hex, by ascending hash; ``-`` if there is none."""
    return ",".join([f"{h:016x}@{o:x}" for h, o in zip(fp[0].tolist(), fp[1].tolist(), strict=True)]) or "-"


def read(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    pairs = [x.split("@") for x in fingerprint.split(",")] if fingerprint != "-" else []
    return np.array([int(h, 16) for h, _ in pairs], np.uint64), np.array([int(o, 16) for _, o in pairs], np.int64)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], sample: Sample = DEFAULT) -> float:
    """From 0 to 1: among the anchors of both that the sample takes from their union, the part that both have in one order."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    union = np.union1d(a[0], b[0])
    most = max(min(sample.keep, len(union)), int(np.searchsorted(union, sample.below, "right")))
    if len(union) > most:
        some = both <= union[most - 1]
        i, j = i[some], j[some]
    # The longest chain of anchors in the same order in both: ends[k] is the least place in b at which one of k + 1 ends.
    ends: list[int] = []
    for place in b[1][j][np.argsort(a[1][i])].tolist():
        k = bisect_left(ends, place)
        ends[k : k + 1] = [place]
    return len(ends) / most


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: Sample = DEFAULT) -> DataFrame:
    """One row per row of docs: the id and the fingerprint of the whole text. Nothing is shuffled."""
    tb.bound_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            data, offsets = tb.column_bytes(b.column(1))
            for i, j in tb.blocks(offsets):
                got = fingerprints(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], sample)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([written(x) for x in got])], names=[id_col, "fingerprint"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fingerprint string")


def _cuts(docs: DataFrame, least: int) -> list[tuple]:
    """Sorted (id, tie) of rows, the table's first one among them, that cut it into ranges of like numbers of bytes; least: ranges at least.

    A row is looked at with a chance that grows with its bytes, decided by a hash of it. About TRIES rows a range are sent
    here, fewer where there are many ranges, and of ranges there are MOST_RANGES at most: beyond that they hold more
    bytes, which a task streams over. So the driver holds no more than about MOST_KEYS keys, however large the table is.
    """
    size = F.octet_length("text") + 1
    seen = docs.agg(F.sum(size).alias("n"), F.min(F.struct(F.col("id").isNotNull(), "id", "tie")).alias("r")).first()
    if seen.n is None:
        return []
    ranges = min(max(least, -(-seen.n // RANGE_BYTES)), max(least, MOST_RANGES))
    tries = max(2, min(TRIES, MOST_KEYS // ranges))
    chance = F.least(F.lit(1.0), size / F.lit(seen.n / (ranges * tries)))
    unit = F.xxhash64("tie", F.lit(1)) / F.lit(2.0**64) + 0.5
    drawn = [(r.id, r.tie) for r in docs.where(unit < chance).select("id", "tie").distinct().orderBy("id", "tie").collect()]
    return sorted({(seen.r["id"], seen.r["tie"]), *drawn[tries // 2 :: tries]}, key=_order)


def _order(key: tuple) -> tuple:
    """Nulls first, as Spark has them."""
    return (False, 0, key[1]) if key[0] is None else (True, *key)


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None, sample: Sample = DEFAULT) -> DataFrame:
    """Per row: its fingerprint, that of its edited text (the last half, rounded down, gives way to as much of the
    next row's beginning) and the likeness of both, and of the row's to the next row's.

    Rows are dealt by ranges of the id and meet their successor by streaming over the sorted range; the first row
    of each range is sent to the range before it as well. This is the one shuffle, and each text is in it once.
    Rows of one id are spread over as many ranges as their bytes need.
    """
    tb.bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumn("tie", F.xxhash64("text"))
    kind = docs.schema["id"].dataType.simpleString()
    cuts = [_order(c) for c in _cuts(docs, ranges or max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))]
    if not cuts:
        return spark.createDataFrame([], f"`{id_col}` {kind}, {_EDITS}")

    @F.arrow_udf("array<int>")
    def parts(ids: pa.Array, ties: pa.Array) -> pa.Array:
        """The range of a row; for the first row of a range, that of the range before it too. The table's first row comes after its last."""
        out = []
        for key in zip(ids.to_pylist(), ties.to_pylist(), strict=True):
            key = _order(key)
            k = bisect_right(cuts, key) - 1
            out.append([k, (k - 1) % len(cuts)] if cuts[k] == key else [k])
        return pa.array(out, pa.list_(pa.int32()))

    both = docs.select("id", "text", "tie", F.posexplode(parts("id", "tie")).alias("head", "part"))
    both = both.select("id", "text", "part", (F.col("head") > 0).alias("head"), "tie")
    dealt = both.repartitionById(len(cuts), "part").sortWithinPartitions("part", "head", "id", "tie").drop("tie")

    def run(batches):
        held: list = []

        def flush(rows, after):
            """Rows with the text that comes after the last of them."""
            texts = [r[1] for r in rows]
            following = [*texts[1:], after]
            edited = [t[: len(t) - (k := len(t) // 2)] + f[:k] for t, f in zip(texts, following, strict=True)]
            data, offsets = tb.column_bytes(pa.array([*texts, after, *edited], pa.large_string()))
            got: list = []
            for i, j in tb.blocks(offsets):
                got += fingerprints(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], sample)
            n = len(texts)
            columns = {
                id_col: pa.array([r[0] for r in rows], ids),
                "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                "fingerprint": pa.array([written(x) for x in got[:n]]),
                "edited_fingerprint": pa.array([written(x) for x in got[n + 1 :]]),
                "near_edited": pa.array([likeness(got[k], got[n + 1 + k], sample) for k in range(n)], pa.float64()),
                "near_next": pa.array([likeness(got[k], got[k + 1], sample) for k in range(n)], pa.float64()),
            }
            return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        ids, size, part_now, done = None, 0, None, False
        for b in batches:
            ids = b.column(0).type
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[2] != part_now:
                    part_now, done = row[2], False
                if row[3]:
                    # Of the rows sent as heads, the first in order is the next row; more are repeats of its id.
                    if not done:
                        yield flush(held, row[1])
                        held, size, done = [], 0, True
                    continue
                held.append(row)
                size += len(row[1])
                if size > tb.BLOCK_BYTES // 2 and len(held) > 1:
                    yield flush(held[:-1], row[1])
                    held, size = held[-1:], len(row[1])

    return dealt.mapInArrow(run, f"`{id_col}` {kind}, {_EDITS}")


_EDITS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def op4_syncmers(spark, sf_dir: str) -> DataFrame:
    return compare_with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
