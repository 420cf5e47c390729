"""Quality rules with suffix-array repetition.

Each text is a sequence of words. All suffixes of a text are ranked by prefix
doubling; the longest common prefix of neighbours in that order bounds, for
every position, the longest run of words that begins there and stands a second
time in the text. Runs of at least ``min_repeat`` words are the maximal
repeated substrings; their spans are united, and a text is rejected if the
union covers too large a part of it or one repeat is too long.

Only suffixes whose first words stand twice are ranked on: each doubling step
takes those still in a group with another suffix.

Edge cases: a null or empty text has no words, fails the base rule (too few
words) and is not kept. Repeated rows and ids get a row each. Columns other
than the two named are not read, so their names cannot clash. An empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import textbytes as tb

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class QualityRules:
    """min_repeat: words that a repeat needs to count. max_covered: part of the words inside repeats.
    max_longest and longest_from: part of the words that the longest repeat may have, and the length in
    words up to which any repeat is let pass by that limit."""

    min_words: int = 50
    max_repeat_words: float = 0.5
    min_repeat: int = 8
    max_covered: float = 0.4
    max_longest: float = 0.4
    longest_from: int = 40


def longest_repeats(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest run that begins there and begins elsewhere in its text too.

    The rank of a suffix among those of its own text is refined by doubling. Levels hold, for
    every power of two, which group of equal runs each position belongs to; longest common
    prefixes of neighbours are then summed up over the levels from the highest down.
    """
    n = len(hashes)
    best = np.zeros(n, np.int64)
    if not n:
        return best
    text = tb.owner(first).astype(np.uint64)
    order, new = tb.same_groups(tb.mix(hashes ^ tb.mix(text + np.uint64(1))))
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(new)
    levels, width = [rank], 1
    while True:
        rank = levels[-1]
        size = np.bincount(rank, minlength=n + 2)
        live = np.flatnonzero(size[rank] > 1)
        if not len(live):
            break
        stop = first[1:][text[live].astype(np.int64)]
        after = live + width
        second = np.where(after < stop, rank[np.minimum(after, n - 1)], 0)
        key = rank[live] * np.int64(n + 2) + second
        by, fresh = tb.same_groups(key)
        # A finer rank keeps the order of the coarser one: ranks are spread by the number of positions below.
        below = np.cumsum(size) - size
        inner = np.arange(len(by)) - np.maximum.accumulate(np.where(np.concatenate([[True], rank[live][by][1:] != rank[live][by][:-1]]), np.arange(len(by)), 0))
        starts = np.maximum.accumulate(np.where(fresh, inner + below[rank[live][by]], 0))
        finer = below[rank].copy() + 1
        finer[live[by]] = starts + 1
        levels.append(finer)
        width *= 2
    order = np.argsort(levels[-1], kind="stable")
    a, b = order[:-1], order[1:]
    near = levels[0][a] == levels[0][b]
    a, b = a[near], b[near]
    x, y, common = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    stop = first[1:][text[a].astype(np.int64)] if len(a) else a
    for k in range(len(levels) - 1, -1, -1):
        ok = (x < stop) & (y < stop)
        ok[ok] = levels[k][x[ok]] == levels[k][y[ok]]
        step = np.where(ok, 1 << k, 0)
        x, y, common = x + step, y + step, common + step
    np.maximum.at(best, a, common)
    np.maximum.at(best, b, common)
    return best


def measure(data: np.ndarray, offsets: np.ndarray, rules: QualityRules) -> dict[str, np.ndarray]:
    """The figures of each text of a block."""
    starts, ends, first = tb.spans(data, offsets, tb.NOT_SPACE)
    hashes = tb.hash_spans(data, starts, ends)
    inside = tb.NOT_SPACE[data] & tb.LEAD[data]
    n_words = np.diff(first)
    symbols = tb.per_text(np.isin(data, np.frombuffer(SYMBOLS, np.uint8)), offsets)

    ls, le, lf = tb.line_spans(data, offsets)
    with_word = np.searchsorted(starts, le) > np.searchsorted(ends, ls, "right")
    ls, le, who = ls[with_word], le[with_word], tb.owner(lf)[with_word]
    order, new = tb.same_groups(tb.mix(tb.hash_spans(data, ls, le) ^ tb.mix(who.astype(np.uint64) + np.uint64(1))))
    dup_lines = np.bincount(who[order][~new], minlength=len(n_words))

    gram, at, gf = tb.grams(hashes, first, 3)
    order, new = tb.same_groups(tb.mix(gram ^ tb.mix(tb.owner(gf).astype(np.uint64) + np.uint64(1))))
    twice = ~new
    twice[:-1] |= ~new[1:]
    twice = at[order][twice]
    repeat_words = tb.per_text(tb.covered(len(hashes), twice, twice + 3), first)

    longest = longest_repeats(hashes, first)
    at = np.flatnonzero(longest >= rules.min_repeat)
    in_repeats = tb.per_text(tb.covered(len(hashes), at, at + longest[at]), first)
    top = np.zeros(len(n_words), np.int64)
    np.maximum.at(top, tb.owner(first)[at], longest[at])
    base_failed = (n_words < rules.min_words) | (100 * repeat_words > 100 * rules.max_repeat_words * n_words)
    bad = (in_repeats > rules.max_covered * n_words) | ((top > rules.longest_from) & (top > rules.max_longest * n_words))
    return {
        "n_words": n_words, "word_chars": tb.per_text(inside, offsets), "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat_words,
        "base_failed": base_failed, "covered_words": in_repeats, "longest_repeat": top, "kept": ~base_failed & ~bad,
    }


_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, covered_words long, longest_repeat long, kept boolean"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


def _figures(batch_text, rules: QualityRules) -> list[pa.Array]:
    data, offsets = tb.column_bytes(batch_text)
    got = [measure(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], rules) for i, j in tb.blocks(offsets)]
    return [pa.array(np.concatenate([g[n] for g in got])) if got else pa.array([], pa.bool_() if n in ("base_failed", "kept") else pa.int64()) for n in _NAMES]


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: QualityRules = QualityRules()) -> DataFrame:
    """One row per row of docs: the id and the figures and verdict of its whole text."""
    tb.bound_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *_figures(b.column(1), rules)], names=[id_col, *_NAMES])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {_SCHEMA}")


def filter_quality(docs: DataFrame, text_col: str = "text", rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of docs whose text is kept, with all their columns. Nothing is shuffled."""
    tb.bound_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            yield b.filter(_figures(b.column(at), rules)[-1])

    return docs.mapInArrow(run, docs.schema)


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_report(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", *[F.col(n) for n in _NAMES])
