"""Language identification by prediction by partial matching.

For each language a tree of byte contexts up to ``order`` long is counted over
a bounded sample, the ``per_language`` different texts of smallest hash and of
these ``sample_bytes`` bytes at most (the first is taken whole in any case),
and then frozen. The probability of a byte is that of the
longest known context; a byte that the context has not seen costs an escape
(distinct / (total + distinct)) and is looked for in the next shorter one,
where what the longer ones have seen is excluded; the last resort is a uniform
share of the bytes still left. The language with the shortest code for the
whole text wins.

Known contexts are closed under taking substrings, so the longest one at a
place depends on the last ``order`` bytes alone, and the tree becomes a finite
automaton. A text is scored in strips, each begun ``order`` bytes early to
find its state: the sum over strips is exactly the code length of the text.

A language takes about 5 MB in each worker, so hundreds of them are the limit
of this form.

Edge cases: a null text and a text without a letter (Unicode category L) are
``und`` with score 0. Copies of a text are learned from once, and rows that
repeat an id are rows like any other. Ties go to the first language by name. Repeated rows get a row each. Only the
named columns are read, so other columns cannot clash. If no row has a
language to learn, every text is ``und``. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import textbytes as tb

ORDER = 4
STRIP = 256
#: Letters, and numbers that are no decimal digits; which of them it is isalpha tells.
MAYBE_LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for m in MAYBE_LETTERS.finditer(text) for c in m[0])


@dataclass(frozen=True)
class Tree:
    """An automaton: after byte class c in state s comes state step[s, c], at a cost of cost[s, c] bits.
    classes maps bytes to classes; bytes never seen share the last one. State 0 is the empty context."""

    classes: np.ndarray
    step: np.ndarray
    cost: np.ndarray
    order: int


def grow(texts: list[bytes], order: int = ORDER, least: int = 2) -> Tree:
    """Counts contexts of up to order bytes and freezes the tree; longer contexts than one byte must stand least times."""
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    seen = np.unique(data)
    classes = np.full(256, len(seen), np.int64)
    classes[seen] = np.arange(len(seen))
    a = len(seen) + 1
    c = classes[data]
    start = np.repeat(offsets[:-1], np.diff(offsets))
    here = np.arange(len(data))
    # Contexts of length k as numbers in base a, the last byte lowest; by length, sorted.
    ids: list[np.ndarray] = [np.zeros(1, np.int64)]
    number = [np.zeros(len(data), np.int64)]
    for k in range(1, order + 1):
        n = np.zeros(len(data), np.int64)
        n[k:] = number[k - 1][k:] + c[: len(data) - k] * a ** (k - 1)
        number.append(n)
        own, count = np.unique(n[here - start >= k], return_counts=True)
        own = own[count >= (least if k > 1 else 1)]
        if k > 1:
            # Both ends of a context must be known for the tree to be closed.
            own = own[np.isin(own % a ** (k - 1), ids[k - 1]) & np.isin(own // a, ids[k - 1])]
        ids.append(own)
    base = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    states = int(base[-1])
    counts = np.zeros((states, a), np.float64)
    shorter = np.zeros(states, np.int64)
    step = np.zeros((states, a), np.int32)

    def find(k: int, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(ids[k], n)
        at = np.minimum(at, max(len(ids[k]) - 1, 0))
        return base[k] + at, (ids[k][at] == n) if len(ids[k]) else np.zeros(len(n), bool)

    for k in range(order + 1):
        ok = here - start >= k
        state, known = find(k, number[k][ok])
        np.add.at(counts, (state[known], c[ok][known]), 1)
        if k and len(ids[k]):
            shorter[base[k] : base[k + 1]] = find(k - 1, ids[k] % a ** (k - 1))[0]
    for k in range(order + 1):
        own = slice(base[k], base[k + 1])
        nxt = np.arange(a)[None] + ids[k][:, None] * a
        # The longest known context after each byte: of length k + 1, or as after the context one byte shorter.
        fallback = step[shorter[own]] if k else np.zeros((len(ids[k]), a), np.int32)
        if k < order:
            state, known = find(k + 1, nxt.ravel())
            known &= np.tile(np.arange(a) < a - 1, len(ids[k]))
            step[own] = np.where(known.reshape(nxt.shape), state.reshape(nxt.shape), fallback)
        else:
            step[own] = fallback
    cost = np.zeros((states, a), np.float32)
    for lo in range(0, states, 4096):
        cur = np.arange(lo, min(states, lo + 4096))
        out = np.full((len(cur), a), np.nan)
        excluded = np.zeros((len(cur), a), bool)
        spent = np.zeros(len(cur))
        at, live = cur.copy(), np.ones(len(cur), bool)
        for _ in range(order + 1):
            own = np.where(excluded, 0, counts[at]) * live[:, None]
            total, distinct = own.sum(1), (own > 0).sum(1)
            there = own > 0
            with np.errstate(divide="ignore"):
                out = np.where(there, spent[:, None] - np.log2(own / np.maximum(total + distinct, 1)[:, None]), out)
                spent = np.where(total > 0, spent - np.log2(np.where(total > 0, distinct / np.maximum(total + distinct, 1), 1)), spent)
            excluded |= there
            live &= at != 0
            at = shorter[at]
        left = np.log2(np.maximum(256 - excluded.sum(1), 1))
        cost[cur] = np.where(np.isnan(out), (spent + left)[:, None], out)
    return Tree(classes.astype(np.uint8), step, cost, order)


def code_lengths(data: np.ndarray, offsets: np.ndarray, trees: list[Tree]) -> np.ndarray:
    """Bits that each text of a block takes under each tree: an array of (texts, trees)."""
    size = np.diff(offsets)
    out = np.zeros((len(size), len(trees)))
    strips = -(-size // STRIP)
    text = np.repeat(np.arange(len(size)), strips)
    if not len(text):
        return out
    begin = offsets[text] + (np.arange(len(text)) - np.repeat(np.cumsum(strips) - strips, strips)) * STRIP
    end = np.minimum(begin + STRIP, offsets[text + 1])
    order = np.argsort(begin - end, kind="stable")
    text, begin, end = text[order], begin[order], end[order]
    longest_first = end - begin
    for k, tree in enumerate(trees):
        a = tree.step.shape[1]
        step, cost = tree.step.ravel() * np.int32(a), tree.cost.ravel()
        c = tree.classes[data]
        state = np.zeros(len(text), np.int32)
        for back in range(tree.order, 0, -1):
            at = begin - back
            ok = at >= offsets[text]
            state = np.where(ok, step[state + np.where(ok, c[np.maximum(at, 0)], 0)], state)
        bits = np.zeros(len(text))
        for t in range(int(longest_first[0])):
            n = int(np.searchsorted(-longest_first, -t, "left"))
            at = state[:n] + c[begin[:n] + t]
            bits[:n] += cost[at]
            state[:n] = step[at]
        out[:, k] = np.bincount(text, bits, len(size))
    return out


@dataclass(frozen=True)
class LanguageModel:
    names: list[str]
    trees: list[Tree]


def sample_texts(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int, sample_bytes: int) -> dict[str, list[bytes]]:
    """For each language, whole texts: of those of rows to learn from the per_language of smallest hash, as far as their bytes go.

    Hashes are ranked first, of which each task hands on its per_language smallest only; then their texts are read.
    """
    learned = F.col("lang").isNotNull() & (F.octet_length("text") > 0) & (F.crc32(F.col("id").cast("string")) % 5 != 0)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(learned).withColumn("h", F.xxhash64("text"))
    ranked = rows.select("lang", "h").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("rank") <= per_language)
    top = ranked.select(F.col("lang").alias("l"), F.col("h").alias("k"))
    own = rows.join(F.broadcast(top), (F.col("lang") == F.col("l")) & (F.col("h") == F.col("k"))).groupBy("lang", "h").agg(F.min("text").alias("text"))
    so_far = F.sum(F.octet_length("text")).over(Window.partitionBy("lang").orderBy("h")) - F.octet_length("text")
    got: dict[str, list[bytes]] = {}
    for r in own.withColumn("before", so_far).where((F.col("before") < sample_bytes) & ((F.col("before") == 0) | (F.col("before") + F.octet_length("text") <= sample_bytes))).select("lang", "h", "text").orderBy("lang", "h").collect():
        got.setdefault(r.lang, []).append(r.text.encode())
    return got


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 48, order: int = ORDER, sample_bytes: int = 2_000_000) -> LanguageModel:
    got = sample_texts(docs, id_col, text_col, lang_col, per_language, sample_bytes)
    return LanguageModel(list(got), [grow(x, order) for x in got.values()])


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score (the winner's share when each language counts 2 to the power of its mean bits a
    byte, negated) and bits, the winner's code length."""
    tb.bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        for b in batches:
            data, offsets = tb.column_bytes(b.column(1))
            for i, j in tb.blocks(offsets):
                texts = b.column(1).slice(i, j - i).to_pylist()
                known = np.array([has_letter(t) for t in texts], bool) & bool(model.names)
                lang, score, best = np.full(j - i, UNKNOWN, object), np.zeros(j - i), np.zeros(j - i)
                if known.any():
                    bits = code_lengths(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], model.trees)
                    win = bits.argmin(1)
                    best = bits[np.arange(j - i), win]
                    mean = (bits - best[:, None]) / np.maximum(np.diff(offsets[i : j + 1]), 1)[:, None]
                    score = np.where(known, 1 / np.exp2(-mean).sum(1), 0.0)
                    lang[known] = np.array(model.names, object)[win[known]]
                    best = np.where(known, best, 0.0)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(best)], names=[id_col, "lang_pred", "score", "bits"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, bits double")


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return predict(docs, learn(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score", "bits")
