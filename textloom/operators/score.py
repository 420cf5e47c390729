"""Features and scores of passages and sentences.

Everything about a passage is computed on its own row with array expressions,
so scoring a corpus needs no shuffle and rows that repeat an id stay apart.
Sums of marker weights are sums of integers (tenths), so they do not depend on
an order. Null counts as the empty text, which is too short for a score. The
caller's columns travel in one struct, so their names cannot clash with those
that are made here; a column of the caller's that has a result's name gives
way to the result. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom import lexicon
from textloom.functions.text import NOT_SPACE, fixed, let, lookup
from textloom.operators.chunk import clean_sentences
from textloom.operators.normalize import normalized
from textloom.session import bound_batches

TOO_SHORT, HIGH, MIDDLE, FLAGGED = 15, 65, 40, 60
POINTS = ("ai_score", "is_flagged", "severity", "ai_markers", "robotic_phrases")
VERDICTS = ("LIKELY AI-GENERATED", "INCONCLUSIVE / MIXED", "LIKELY HUMAN-WRITTEN")
SHORT_REASON = "Text too short for reliable statistical evaluation (min 15 words)"


#: Tokens of a normalised text, as ``clean_tokens`` of functions.text has them, and the bytes between them; the dot above is the one sign of two bytes.
_TOKEN = re.compile(r"[^ \n.,;:!?\-'\"\u0307]+")
_BETWEEN = np.isin(np.arange(256), list(b"\0 \n.,;:!?-'\""))
_DOT_ABOVE = "\u0307".encode()
_CANNED = [(p, re.compile(rf"(?<!\w){re.escape(p)}(?!\w)")) for p in lexicon.CANNED]
_LIST = pa.list_(pa.string())


def _heads(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first eight bytes of spans as numbers, without those behind a span's end."""
    rows = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)[begin]
    return rows.view(">u8").ravel().astype(np.uint64) >> (8 * (8 - np.minimum(size, 8))).astype(np.uint64)


def _head_of(words: Iterable[str]) -> np.ndarray:
    return np.unique(np.array([int.from_bytes(w.encode()[:8], "big") for w in words], np.uint64))


_LEXICON = _head_of([*lexicon.AI_TENTHS, *lexicon.HUMAN_TENTHS])


def evidence(clean: list[str]) -> dict[str, pa.Array]:
    """Of normalised texts: n, how many tokens; ai and human, the tokens that the lexicons hold, in order, repeats included; canned, the canned phrases in a text, in the order of the list, each once.

    All texts of a batch are looked through at once; what a lexicon may hold is told by its first eight bytes.
    """
    # No normalised text holds a zero, so it keeps them apart.
    low = "\0".join([*clean, ""]).lower()
    raw = low.encode()
    data = np.frombuffer(raw, np.uint8)
    between = _BETWEEN[data]
    if _DOT_ABOVE in raw:
        dots = np.flatnonzero((data[:-1] == _DOT_ABOVE[0]) & (data[1:] == _DOT_ABOVE[1]))
        between[dots] = between[dots + 1] = True
    # Every text ends with a zero, so a token's end is the next place between tokens.
    edges = np.flatnonzero(np.diff(between, prepend=True))
    begin, end = edges[0::2], edges[1::2]
    zeros = np.flatnonzero(data == 0)
    text = np.searchsorted(zeros, begin)
    head = _heads(data, begin, end - begin)
    near = np.flatnonzero(_LEXICON[np.minimum(np.searchsorted(_LEXICON, head), len(_LEXICON) - 1)] == head)
    found = [(i, raw[lo:hi].decode()) for i, lo, hi in zip(text[near].tolist(), begin[near].tolist(), end[near].tolist(), strict=True)]
    canned = []
    for place, (phrase, pattern) in enumerate(_CANNED):
        own, at = phrase.encode(), 0
        while (at := raw.find(own, at)) >= 0:
            i = int(np.searchsorted(zeros, at))
            if pattern.search(clean[i].lower()):
                canned.append((i, place, phrase))
            # One find a text is enough.
            at = int(zeros[i])
    some = {"ai": [x for x in found if x[1] in lexicon.AI_TENTHS], "human": [x for x in found if x[1] in lexicon.HUMAN_TENTHS], "canned": [(i, p) for i, _, p in sorted(canned)]}
    return {"n": pa.array(np.bincount(text, minlength=len(clean)), pa.int32())} | {name: _lists(len(clean), rows) for name, rows in some.items()}


def _lists(n: int, rows: list[tuple[int, str]]) -> pa.Array:
    """n lists of what rows, in order, give each."""
    ends = np.searchsorted(np.array([i for i, _ in rows], np.int64), np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([x for _, x in rows], pa.string()))


def _struct(fields: dict[str, pa.Array]) -> pa.Array:
    return pa.StructArray.from_arrays(list(fields.values()), names=list(fields))


#: What evidence gives, and how many of a whole text's tokens are different.
EVIDENCE = "n:int,ai:array<string>,human:array<string>,canned:array<string>"
WHOLE_EVIDENCE = f"{EVIDENCE},distinct:int"


def whole_evidence(clean: list[str]) -> pa.Array:
    return _struct(evidence(clean) | {"distinct": pa.array([len(set(_TOKEN.findall(t.lower()))) for t in clean], pa.int32())})


def lines(clean: list[str]) -> pa.Array:
    return pa.array([" ".join(t.split()) for t in clean], pa.string())


def read(c: Column, entities: bool = True) -> Column:
    """(line, e): a column of texts, normalised and with one blank for all white space between words, and their WHOLE_EVIDENCE, by the pass of Arrow batches that normalises. In Spark's array functions each token is a call of several expressions."""
    bound_batches()

    @F.arrow_udf(f"struct<line:string,e:struct<{WHOLE_EVIDENCE}>>")
    def run(texts: pa.Array) -> pa.Array:
        clean = [normalized(t, entities) for t in texts.to_pylist()]
        return _struct({"line": lines(clean), "e": whole_evidence(clean)})

    return run(c)


def evidence_of(c: Column, entities: bool = True) -> Column:
    """EVIDENCE of a column of texts, once they are normalised."""
    bound_batches()

    @F.arrow_udf(f"struct<{EVIDENCE}>")
    def run(texts: pa.Array) -> pa.Array:
        return _struct(evidence([normalized(t, entities) for t in texts.to_pylist()]))

    return run(c)


def evidence_nested(c: Column, entities: bool = True) -> Column:
    """As evidence_of, for the texts in a column of arrays of arrays, with words: how many pieces between white space a text has as it comes."""
    bound_batches()

    @F.arrow_udf(f"array<array<struct<{EVIDENCE},words:int>>>")
    def run(rows: pa.Array) -> pa.Array:
        parts = [part for row in rows.to_pylist() for part in row or ()]
        texts = [t for part in parts for t in part]
        e = evidence([normalized(t, entities) for t in texts])
        each = _struct(e | {"words": pa.array([len(t.split()) for t in texts], pa.int32())})
        nested = pa.ListArray.from_arrays(_ends(map(len, parts)), each)
        return pa.ListArray.from_arrays(_ends(n or 0 for n in rows.value_lengths().to_pylist()), nested)

    return run(c)


def _ends(sizes: Iterable[int]) -> pa.Array:
    return pa.array([0, *itertools.accumulate(sizes)], pa.int32())


def tenths(found: Column, table: dict[str, int]) -> Column:
    return F.aggregate(found, F.lit(0).cast("long"), lambda acc, t: acc + lookup(table, t).cast("long"))


def opener(sentence: Column) -> Column:
    return F.lower(F.regexp_extract(sentence, f"^{NOT_SPACE}+", 0))


def first_mode(items: Column) -> Column:
    """(item, n, first): the most frequent item, of several the one seen first. Sorted once, then one pass over its runs."""
    rows = F.sort_array(F.transform(items, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    none = F.lit(None).cast("string")
    start = F.struct(none.alias("x"), F.lit(0).alias("n"), F.lit(0).alias("i"), none.alias("bx"), F.lit(0).alias("bn"), F.lit(0).alias("bi"))

    def step(s, r):
        same = s["x"].eqNullSafe(r["x"])
        n, i = F.when(same, s["n"] + 1).otherwise(F.lit(1)), F.when(same, s["i"]).otherwise(r["i"])
        better = (n > s["bn"]) | ((n == s["bn"]) & (i < s["bi"]))
        return F.struct(r["x"].alias("x"), n.alias("n"), i.alias("i"), F.when(better, r["x"]).otherwise(s["bx"]).alias("bx"), F.when(better, n).otherwise(s["bn"]).alias("bn"), F.when(better, i).otherwise(s["bi"]).alias("bi"))

    return F.aggregate(rows, start, step, lambda s: F.struct(s["bx"].alias("item"), s["bn"].alias("n"), s["bi"].alias("first")))


def verdict(score: Column) -> Column:
    return F.when(score >= HIGH, VERDICTS[0]).when(score >= MIDDLE, VERDICTS[1]).otherwise(VERDICTS[2])


def features(docs: DataFrame, text_col: str = "text", entities: bool = True) -> DataFrame:
    """_row, the row of docs as a struct, and the columns that scores are made of, all prefixed by an underscore."""
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), read(F.col(text_col), entities).alias("_read"))
    return read_features(d)


def read_features(d: DataFrame) -> DataFrame:
    """As features, from a column _read of texts that were read; other columns stay."""
    keep = [c for c in d.columns if c != "_read"]
    d = d.select(*keep, F.col("_read.e").alias("_e"), clean_sentences(F.col("_read.line")).alias("_sn"))
    # One blank stands between two words, and none at the ends.
    words = F.transform("_sn", lambda s: (F.octet_length(s) - F.octet_length(F.replace(s, F.lit(" "), F.lit(""))) + 1).cast("long"))
    d = d.select(
        *keep, F.col("_e.canned").alias("_canned"), words.alias("_wc"), first_mode(F.transform("_sn", opener)).alias("_mode"), F.size("_sn").alias("_k"), F.col("_e.n").alias("_n"),
        F.col("_e.distinct").alias("_distinct"), F.col("_e.ai").alias("_ai"), F.col("_e.human").alias("_human"),
    )
    total = lambda f: F.aggregate("_wc", F.lit(0).cast("long"), lambda acc, x: acc + f(x))
    d = d.withColumns({"_sx": total(lambda x: x), "_sxx": total(lambda x: x * x), "_ait": tenths(F.col("_ai"), lexicon.AI_TENTHS), "_humant": tenths(F.col("_human"), lexicon.HUMAN_TENTHS)})
    k = F.col("_k").cast("double")
    # From integer sums, so that no order of adding matters.
    d = d.withColumn("_std", F.when(F.col("_k") >= 2, F.sqrt((k * F.col("_sxx") - F.col("_sx") * F.col("_sx")) / (k * (k - 1)))).otherwise(0.0))
    return d.withColumns({
        "_cv": F.when((F.col("_k") >= 2) & (F.col("_sx") > 0), F.col("_std") / (F.col("_sx") / k)).otherwise(0.0),
        "_ttr": F.when(F.col("_n") > 0, F.col("_distinct") / F.col("_n")).otherwise(0.0),
    })


def passage_logit(d: DataFrame) -> DataFrame:
    """Adds _logit to features; the conditions are kept for the reasons."""
    n, k, cv, ttr = F.col("_n"), F.col("_k"), F.col("_cv"), F.col("_ttr")
    root = F.sqrt(n.cast("double"))
    d = d.withColumns({
        "_uniform": (k >= 3) & (cv < 0.35), "_varied": (k >= 2) & (cv > 0.60) & ~((k >= 3) & (cv < 0.35)), "_formal": (ttr >= 0.60) & (ttr <= 0.80) & (n > 50),
        "_opens": (k >= 4) & (F.col("_mode.n") / k > 0.35) & F.col("_mode.item").isin("the", "in", "it", "this"),
    })
    x = F.lit(-1.0)
    x = x + F.when(F.size("_ai") > 0, F.col("_ait") / 10.0 / root * 3.6).otherwise(0.0)
    x = x - F.when(F.size("_human") > 0, F.col("_humant") / 10.0 / root * 3.0).otherwise(0.0)
    x = x + F.size("_canned") * 1.5
    x = x + F.when(F.col("_uniform"), 1.2).when(F.col("_varied"), -1.3).otherwise(0.0)
    x = x + F.when(F.col("_formal"), 0.8).otherwise(0.0)
    x = x + F.when(F.coalesce(F.col("_opens"), F.lit(False)), 0.7).otherwise(0.0)
    return d.withColumn("_logit", x)


def passage_score(d: DataFrame) -> DataFrame:
    """Adds _score and _verdict to logits."""
    short = F.col("_n") < TOO_SHORT
    d = d.withColumn("_score", F.when(short, 0).otherwise(F.bround(100 * (1 / (1 + F.exp(-F.col("_logit")))))).cast("int"))
    return d.withColumn("_verdict", F.when(short, "TOO SHORT").otherwise(verdict(F.col("_score"))))


def _listed(c: Column) -> Column:
    return F.concat(F.lit("['"), F.array_join(c, "', '"), F.lit("']"))


def _markers(c: str) -> Column:
    return F.array_sort(F.array_distinct(c))


def analysis_struct() -> Column:
    """ai_score, verdict, reasons and metrics, from the columns of passage_score; of one shape for all texts (null where a short text has none)."""
    short = F.col("_n") < TOO_SHORT
    cadence = lambda words: F.format_string(f"{words} (CV: %s)", fixed(F.col("_cv"), 2))
    reasons = F.array_compact(F.array(
        F.when(F.size("_ai") > 0, F.concat(F.lit("AI academic/rhetorical markers detected: "), _listed(_markers("_ai")))),
        F.when(F.size("_human") > 0, F.concat(F.lit("Colloquial human phrasing detected: "), _listed(_markers("_human")))),
        F.when(F.size("_canned") > 0, F.concat(F.lit("Typical LLM canned phrases detected: "), _listed(F.col("_canned")))),
        F.when(F.col("_uniform"), cadence("Uniform sentence cadence")).when(F.col("_varied"), cadence("High human rhythm variance")),
        F.when(F.col("_formal"), F.format_string("Controlled lexical dispersion ratio (%s)", fixed(F.col("_ttr"), 2))),
        F.when(F.col("_opens"), F.format_string("Monotonous sentence openers (%s: %d%%)", F.initcap("_mode.item"), F.floor(F.col("_mode.n") / F.col("_k") * 100))),
    ))
    shown = lambda c: F.when(~short, c)
    metrics = F.struct(
        shown(fixed(F.col("_cv"), 4).cast("double")).alias("burstiness_cv"),
        shown(fixed(F.col("_std"), 2).cast("double")).alias("sentence_stddev"),
        shown(fixed(F.col("_ttr"), 4).cast("double")).alias("type_token_ratio"),
        shown(_markers("_ai")).alias("ai_markers_found"),
        shown(_markers("_human")).alias("human_markers_found"),
        shown(F.col("_canned")).alias("robotic_phrases_found"),
        F.col("_k").alias("sentence_count"),
        F.col("_n").alias("word_count"),
    )
    return F.struct(F.col("_score").alias("ai_score"), F.col("_verdict").alias("verdict"), F.when(short, F.array(F.lit(SHORT_REASON))).otherwise(reasons).alias("reasons"), metrics.alias("metrics"))


def analysis(docs: DataFrame, text_col: str = "text", entities: bool = True) -> DataFrame:
    """docs with the column analysis: ai_score, verdict, reasons and metrics."""
    d = passage_score(passage_logit(features(docs, text_col, entities)))
    return d.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns if c != "analysis"], analysis_struct().alias("analysis"))


def sentence_points(e: Column) -> Column:
    """Of a sentence's EVIDENCE: (ai_score, is_flagged, severity, ai_markers, robotic_phrases)."""
    none = F.array().cast("array<string>")

    def scored(n: Column, ai: Column, human: Column, canned: Column) -> Column:
        raw = F.lit(25) + F.least(F.size(ai) * 22, F.lit(50)) + F.size(canned) * 25 - F.least(F.size(human) * 20, F.lit(40)) + F.when((n > 28) & (F.size(human) == 0), 15).otherwise(0)
        return F.when(n < 3, 10).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), raw))).cast("int")

    def labelled(p: Column, x: Column) -> Column:
        short = x["n"] < 3
        severity = F.when(p >= HIGH, "high").when(p >= MIDDLE, "medium").otherwise("low")
        markers, phrases = F.when(short, none).otherwise(F.array_sort(F.array_distinct(x["ai"]))), F.when(short, none).otherwise(x["canned"])
        return F.struct(p.alias("ai_score"), (p >= FLAGGED).alias("is_flagged"), severity.alias("severity"), markers.alias("ai_markers"), phrases.alias("robotic_phrases"))

    return let(e, lambda x: let(scored(x["n"], x["ai"], x["human"], x["canned"]), lambda p: labelled(p, x)))


def sentence_scores(rows: DataFrame, text_col: str = "text", entities: bool = True) -> DataFrame:
    """rows of one sentence each, with ai_score, is_flagged, severity, ai_markers and robotic_phrases."""
    own = [f"`{c}`" for c in rows.columns if c not in POINTS]
    d = rows.select(F.struct(*own).alias("_row"), evidence_of(F.col(text_col), entities).alias("_e")).select("_row", sentence_points(F.col("_e")).alias("_points"))
    return d.select("_row.*", "_points.*")
