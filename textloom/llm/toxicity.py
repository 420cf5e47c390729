"""Toxicity by a weighted lexicon and Aho-Corasick matching.

Texts are folded first: case, accents, full-width, circled and mathematical
forms (compatibility decomposition without its marks), letters of other scripts
that look like Latin ones, and digits or signs that stand in for letters
(``1d10t``, ``$cum``). Terms are whole words or beginnings of words. Hits
inside an exception phrase do not count. The weights of all other hits are
summed, and the sum and its share of the text's length go through a logistic
curve.

The lexicon, the exceptions and the curve are learned from a bounded sample of
labelled rows whose crc32 of the id, as text, leaves a remainder by 5 that is
not 0: the ``sample_rows`` ids of smallest hash, as far as ``sample_bytes``
bytes of texts go. Of these ``most_terms`` terms at most come into the lexicon
(``Learning`` holds this and the other settings). The curve is fitted on sums
from lexicons that have not seen the row (two folds); the last lexicon is
learned from both.

Edge cases: null counts as empty; an empty text has the score that the curve
gives to no hits, which is under 0.5. Without labelled rows of both kinds the
lexicon is empty and every score is 0. Labels that are null are skipped; of
several labels of one id the largest counts, of several texts the one of
smallest SHA-256 is learned from. Repeated rows get a row each.
Only the named columns are read, so other columns cannot clash. An empty table
gives an empty result.
"""

from __future__ import annotations

import heapq
import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import textbytes as tb

#: Letters that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w", "ı": "i", "ł": "l", "ø": "o", "ɡ": "g", "ѡ": "w",
}
#: Digits and signs written for letters.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l"}
#: Phrases in which a common insult is none. They hold wherever the lexicon has the term; others are learned.
EXCEPTIONS = ("bastard sword", "damn good", "dumb terminal", "dumb waiter", "garbage collection", "garbage collector", "jerk chicken", "killer app", "pig iron", "rat race", "sucker punch", "ugly duckling", "weasel words", "wild ass")

_FOLD = {ord(k): v for k, v in LOOKALIKES.items()} | {0xFF41 + i: chr(97 + i) for i in range(26)} | {0xFF10 + i: str(i) for i in range(10)} | {0x200B: None, 0x200C: None, 0x200D: None, 0xAD: None}
#: Combining marks, as decomposed letters carry them.
_MARKS = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe00-\ufe0f\ufe20-\ufe2f]+")
_ODD = re.compile("[" + "".join(map(chr, _FOLD)) + "]")
_SIGN = re.compile(r"[@$](?=[^\W_])|(?<=[^\W_])[!|](?=[^\W_])")
#: Lower-cased ASCII letters stay, digits give way to letters, bytes of other scripts stay, all else is a space.
_BYTES = bytes(ord(STAND_INS[chr(b)]) if chr(b) in STAND_INS and 48 <= b < 58 else b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b < 58 or b >= 0x80 else 32 for b in range(256))


def fold(text: str) -> str:
    """The folded text, with a space at either end and for every sign."""
    text = text.lower()
    if not text.isascii():
        # Accents, circles and the styles of mathematical letters go, then letters of other scripts are looked up.
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text)).lower()
        if _ODD.search(text):
            text = text.translate(_FOLD)
    if "@" in text or "$" in text or "!" in text or "|" in text:
        text = _SIGN.sub(lambda m: STAND_INS[m[0]], text)
    return " " + text.encode().translate(_BYTES).decode() + " "


@dataclass(frozen=True)
class Lexicon:
    """Weights of terms (`` word `` or `` beginning``, with the spaces), phrases that excuse terms inside them, and the curve's three weights."""

    terms: dict[str, float]
    exceptions: list[str]
    curve: tuple[float, float, float] = (-20.0, 0.0, 0.0)


class Matcher:
    """The lexicon's automaton."""

    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.lexicon, self.automaton = lexicon, ahocorasick.Automaton()
        for t, w in lexicon.terms.items():
            self.automaton.add_word(t, (len(t), w))
        for p in lexicon.exceptions if lexicon.terms else ():
            self.automaton.add_word(p, (len(p), None))
        if lexicon.terms:
            self.automaton.make_automaton()

    def sums(self, folded: str) -> tuple[float, int]:
        """(summed weights, hits). Of terms that begin at one place, the heaviest counts."""
        if not self.lexicon.terms:
            return 0.0, 0
        hits: dict[int, tuple[float, int]] = {}
        excused = []
        for end, (size, weight) in self.automaton.iter(folded):
            start = end - size + 1
            if weight is None:
                excused.append((start, end))
            elif start not in hits or hits[start][0] < weight:
                hits[start] = weight, end
        if excused:
            excused.sort()
            begins, reach = [a for a, _ in excused], list(accumulate((b for _, b in excused), max))
            # Of the phrases that begin where a hit does or before, the one that reaches furthest tells whether any holds it.
            hits = {s: (w, e) for s, (w, e) in hits.items() if not (k := bisect_right(begins, s)) or reach[k - 1] < e}
        return sum(w for w, _ in hits.values()), len(hits)

    def score(self, text: str) -> float:
        folded = fold(text)
        total, _ = self.sums(folded)
        return curve_at(self.lexicon.curve, *inputs(total, folded))


def inputs(total: float, folded: str) -> tuple[float, float]:
    """The summed weights, and as a share of the length in words, on log scales."""
    return math.log1p(total), math.log1p(100 * total / (folded.count(" ") or 1))


def curve_at(curve, a: float, b: float) -> float:
    z = curve[0] + curve[1] * a + curve[2] * b
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, z)))) if curve[1] or curve[2] else 0.0


@dataclass(frozen=True)
class Learning:
    """How terms are chosen. most_terms: terms of the lexicon at most. least: toxic texts that a term must be in. odds: the log of how much
    more frequent it must be in toxic texts than in clean ones. chance: a bound on the chi-square of its count against the one that the label
    leaves to chance. gain: toxic texts that a term must add to those that heavier terms cover already. beginnings: how long beginnings of words are."""

    most_terms: int = 400
    least: int = 3
    odds: float = 2.0
    chance: float = 10.0
    gain: int = 2
    beginnings: tuple[int, int] = (4, 10)


def _beginnings(word: str, how: Learning) -> list[str]:
    return [" " + word[:k] for k in range(how.beginnings[0], min(len(word), how.beginnings[1] + 1))]


def _terms(folded: str, how: Learning) -> set[str]:
    """Words and beginnings of words of a text."""
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update(_beginnings(w, how))
    return out


def learn_terms(toxic: list[str], clean: list[str], how: Learning = Learning()) -> tuple[dict[str, float], list[str]]:
    """Terms by greedy cover: each next one is in the most toxic texts that have none yet; and learned exceptions."""
    if not toxic or not clean:
        return {}, []
    where: dict[str, int] = {}
    for i, t in enumerate(toxic):
        for x in _terms(t, how):
            where[x] = where.get(x, 0) | 1 << i
    where = {x: m for x, m in where.items() if m.bit_count() >= how.least}
    other: Counter = Counter()
    for t in clean:
        other.update(x for x in _terms(t, how) if x in where)
    nt, nn = len(toxic) + 1, len(clean) + 1
    weight = {x: math.log((m.bit_count() + 0.5) / nt) - math.log((other[x] + 0.5) / nn) for x, m in where.items()}

    def beyond_chance(x: str) -> bool:
        expected = (where[x].bit_count() + other[x]) * nt / (nt + nn)
        return (where[x].bit_count() - expected) ** 2 / expected >= how.chance

    good = sorted((x for x, w in weight.items() if w >= how.odds and beyond_chance(x)), key=lambda x: (-where[x].bit_count() * weight[x], len(x), x))
    out, left = {}, (1 << len(toxic)) - 1
    # Gains only fall, so a term whose gain was already too small need not be looked at again.
    heap = [(-where[x].bit_count() * weight[x], k, x) for k, x in enumerate(good)]
    heapq.heapify(heap)
    while heap and len(out) < how.most_terms:
        old, k, x = heapq.heappop(heap)
        gain = (where[x] & left).bit_count()
        if gain < how.gain:
            continue
        new = -gain * weight[x]
        if new > old + 1e-9:
            heapq.heappush(heap, (new, k, x))
            continue
        out[x] = weight[x]
        left &= ~where[x]
    # Terms as good as those taken that merely cover the same texts come in too, unless a taken term is part of them.
    for x in good:
        if len(out) >= how.most_terms:
            break
        if x not in out and weight[x] >= 3 and not any(x.startswith(y) or (y.startswith(x.rstrip()) and weight[y] >= weight[x] - 0.7) for y in out):
            out[x] = weight[x]
    return out, learn_exceptions(out, toxic, clean, how)


def learn_exceptions(terms: dict[str, float], toxic: list[str], clean: list[str], how: Learning = Learning()) -> list[str]:
    """The fixed phrases, and pairs of neighbouring words with a term that stand in several clean texts and no toxic one."""
    known: dict[str, bool] = {}

    def is_term(w: str) -> bool:
        if w not in known:
            known[w] = f" {w} " in terms or any(x in terms for x in _beginnings(w, how))
        return known[w]

    def pairs(t: str) -> set[str]:
        w = t.split()
        return {f" {a} {b} " for a, b in zip(w, w[1:], strict=False) if is_term(a) or is_term(b)}

    bad = set().union(*map(pairs, toxic))
    seen = Counter(p for t in clean for p in pairs(t))
    return [fold(x) for x in EXCEPTIONS] + sorted(p for p, n in seen.items() if n >= how.least and p not in bad)


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float, float]:
    """Logistic regression by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return float(w[0]), float(w[1]), float(w[2])


def fit(rows: list[tuple[str, int]], how: Learning = Learning()) -> Lexicon:
    """The lexicon for (text, label) rows."""
    # Copies of one text would make its rare words look like terms.
    rows = list(dict.fromkeys((fold(t), int(y)) for t, y in rows))
    if len({y for _, y in rows}) < 2:
        return Lexicon({}, [])
    xs, ys = [], []
    for own in range(2):
        rest = [r for k, r in enumerate(rows) if k % 2 != own]
        m = Matcher(Lexicon(*learn_terms([t for t, y in rest if y], [t for t, y in rest if not y], how)))
        for t, y in rows[own::2]:
            xs.append(inputs(m.sums(t)[0], t))
            ys.append(y)
    terms, exceptions = learn_terms([t for t, y in rows if y], [t for t, y in rows if not y], how)
    return Lexicon(terms, exceptions, fit_curve(np.array(xs), np.array(ys)))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 8000, sample_bytes: int = 64_000_000, how: Learning = Learning()) -> Lexicon:
    """Learns from at most sample_rows rows and sample_bytes bytes; the sample's ids, of that proven bound, are broadcast to find their texts, which are one an id before they are sent."""
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isNotNull() & (F.crc32(F.col("id").cast("string")) % 5 != 0))
    own = own.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    got = texts.join(F.broadcast(own), "id").groupBy("id").agg(F.min_by("text", F.sha2("text", 256)).alias("text"), F.max("y").alias("y"))
    got = got.withColumn("h", F.xxhash64("id")).withColumn("size", F.octet_length("text"))
    # Over sample_rows rows at most; texts stay out of it.
    kept = got.select("id", F.sum("size").over(Window.orderBy("h", "id")).alias("so_far")).where(F.col("so_far") <= sample_bytes).select(F.col("id").alias("k"))
    return fit([(r.text, r.y) for r in got.join(F.broadcast(kept), F.col("id") == F.col("k")).orderBy("h", "id").select("text", "y").collect()], how)


def score_toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, the score of the whole text, the prediction and the number of hits."""
    tb.bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)
    made: list[Matcher] = []

    def run(batches):
        if not made:
            made.append(Matcher(sent.value))
        m = made[0]
        for b in batches:
            scores, hits = [], []
            for t in b.column(1).to_pylist():
                folded = fold(t or "")
                total, n = m.sums(folded)
                scores.append(curve_at(m.lexicon.curve, *inputs(total, folded)))
                hits.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(hits, pa.int64())], names=[id_col, "score", "predicted", "n_hits"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int, n_hits long")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lexicon = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return score_toxicity(docs, lexicon).select("doc_id", held.alias("held_out"), "score", "predicted", "n_hits")
