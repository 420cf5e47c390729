"""The composite queries against a checker in plain Python, written rule by rule, over the smallest tables."""

import hashlib
import html
import math
import os
import re
import statistics
import unicodedata

import pytest

from textloom import lexicon

from textloom.plans import planted
from textloom.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def normal(t):
    t = html.unescape(t or "").replace("\r\n", "\n").replace("\r", "\n")
    t = re.sub(r"`([^`]+)`", r"\1", re.sub(r"```[\s\S]*?```", " ", t))
    t = re.sub(r"\\[a-zA-Z]+\{([^}]*)\}", r"\1", t)
    for a, b in lexicon.LATEX:
        t = t.replace(a, b)
    t = re.sub(r"[\$\^_{}\[\]\\]", " ", re.sub(r"\\[a-zA-Z]+", " ", t))
    for a, b in lexicon.TYPOGRAPHY + lexicon.MATH + lexicon.GREEK:
        t = t.replace(a, b)
    t = "".join(c for c in t if c in "\n\t " or unicodedata.category(c)[0] not in "CZ")
    t = re.sub(r"[ \t]+", " ", re.sub(r"[^\w\s.,;:!?\-'\"]", " ", t))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"\s+([.,;:!?])", r"\1", t)).strip()


def canned(t):
    return [p for p in lexicon.CANNED if re.search(rf"\b{re.escape(p)}\b", t.lower())]


def passage(text):
    t = normal(text)
    tk = re.findall(r"\w+", t.lower())
    ss = [s.strip() for s in re.split(r"(?<=[.!?])\s+", re.sub("([a-z])([A-Z])", r"\1. \2", t).strip())]
    ss = [s for s in ss if len(s.split()) >= 2]
    if len(tk) < 15:
        return {"ai_score": 0, "verdict": "TOO SHORT", "reasons": 1, "cv": None, "std": None, "ttr": None, "n": len(tk), "k": len(ss)}
    ai, human, found = [w for w in tk if w in lexicon.AI_MARKERS], [w for w in tk if w in lexicon.HUMAN_MARKERS], canned(t)
    x, why = -1.0, bool(ai) + bool(human) + bool(found)
    x += sum(round(10 * lexicon.AI_MARKERS[w]) for w in ai) / 10 / math.sqrt(len(tk)) * 3.6
    x -= sum(round(10 * lexicon.HUMAN_MARKERS[w]) for w in human) / 10 / math.sqrt(len(tk)) * 3.0
    x += 1.5 * len(found)
    sizes = [len(s.split()) for s in ss]
    std = statistics.stdev(sizes) if len(sizes) > 1 else 0.0
    cv = std / statistics.mean(sizes) if len(sizes) > 1 else 0.0
    if len(ss) >= 3 and cv < 0.35:
        x, why = x + 1.2, why + 1
    elif len(ss) >= 2 and cv > 0.60:
        x, why = x - 1.3, why + 1
    ttr = len(set(tk)) / len(tk)
    if 0.60 <= ttr <= 0.80 and len(tk) > 50:
        x, why = x + 0.8, why + 1
    if len(ss) >= 4:
        first = [s.split()[0].lower() for s in ss]
        top = max(first, key=lambda w: (first.count(w), -first.index(w)))
        if first.count(top) / len(first) > 0.35 and top in ("the", "in", "it", "this"):
            x, why = x + 0.7, why + 1
    score = round(100 * (1 / (1 + math.exp(-x))))
    verdict = "LIKELY AI-GENERATED" if score >= 65 else "INCONCLUSIVE / MIXED" if score >= 40 else "LIKELY HUMAN-WRITTEN"
    return {"ai_score": score, "verdict": verdict, "reasons": why, "cv": round(cv, 4), "std": round(std, 2), "ttr": round(ttr, 4), "n": len(tk), "k": len(ss)}


def split(paragraph):
    t = re.sub(r"([a-z0-9])\.([A-Z])", r"\1. \2", paragraph)
    for a in lexicon.ABBREVIATIONS:
        t = re.sub(r"\b" + re.escape(a), lambda m: m[0].replace(".", "\0"), t, flags=re.I)
    parts = [p.replace("\0", ".").strip() for p in re.split(r"(?<=[.!?])(?=[\s\"']+|$)", t)]
    return [p for p in parts if len(p.split()) >= 2]


def parts(text):
    return [(i, p.strip(), split(p.strip())) for i, p in enumerate(re.split(r"\n\s*\n", (text or "").strip())) if p.strip()]


def sentence(text):
    t = normal(text)
    tk = re.findall(r"\w+", t.lower())
    if len(tk) < 3:
        return 10
    ai, human = sum(w in lexicon.AI_MARKERS for w in tk), sum(w in lexicon.HUMAN_MARKERS for w in tk)
    return max(0, min(100, 25 + min(22 * ai, 50) + 25 * len(canned(t)) - min(20 * human, 40) + (15 if len(tk) > 28 and not human else 0)))


def like(old, new, shout):
    if shout and old.isupper():
        return new.upper()
    return new.capitalize() if old[0].isupper() else new.lower()


def rewritten(s):
    n = 0
    for a, b in lexicon.PHRASE_REWRITES:
        found = re.compile(rf"\b{re.escape(a)}\b", re.I)
        n += len(found.findall(s))
        s = found.sub(lambda m, b=b: like(m[0], b, False), s)
    for a, b in lexicon.WORD_REWRITES.items():
        found = re.compile(rf"\b{re.escape(a)}\b", re.I)
        n += bool(found.search(s))
        s = found.sub(lambda m, b=b: like(m[0], b, True), s)
    if '"' not in s and "'" not in s and len(s.split()) > 6:
        for a, b in lexicon.CONTRACTIONS:
            s, k = re.subn(rf"\b{re.escape(a)}\b", lambda m, b=b: like(m[0], b, False), s, count=1, flags=re.I)
            n += k
    if len(s.split()) > 30 and "; " in s:
        s, n = s.replace("; ", ". "), n + 1
    elif len(s.split()) > 32 and ", and " in s:
        a, b = s.split(", and ", 1)
        if len(a.split()) >= 8 and len(b.split()) >= 8:
            s, n = f"{a.strip()}. And {b.strip()}", n + 1
    return re.sub(r"\s+([.,;:!?])", r"\1", re.sub(r"[ \t]+", " ", s)).strip(), n


def whole(text):
    lines = [" ".join(r for s in ss if (r := rewritten(s)[0])) for _, _, ss in parts(text)]
    return "\n\n".join(x for x in lines if x), sum(rewritten(s)[1] for _, _, ss in parts(text) for s in ss)


@pytest.fixture(scope="module")
def texts(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    raw = dict(docs.collect())
    return raw, {i: t.replace("&", " ") + " " + planted.SENTENCES[i % len(planted.SENTENCES)] for i, t in raw.items()}


def test_rectified(spark, texts):
    raw, extended = texts
    for name, own in (("rectified", extended), ("unaltered_rectified", raw)):
        for r in QUERIES[name](spark, DATA).collect():
            text, n = whole(own[r.doc_id])
            before, after = passage(own[r.doc_id]), passage(text)
            assert (r.rectified_text, r.modifications_count) == (text, n)
            assert (r.original_ai_score, r.rectified_ai_score, r.original_verdict) == (before["ai_score"], after["ai_score"], before["verdict"])
            assert r.original_text == own[r.doc_id] and len(r.modifications) == min(n, 25) and r.score_reduction == max(0, before["ai_score"] - after["ai_score"])
            for m, want in ((r.original_metrics, before), (r.rectified_metrics, after)):
                assert (m.word_count, m.sentence_count, m.burstiness_cv, m.sentence_stddev, m.type_token_ratio) == tuple(want[k] for k in ("n", "k", "cv", "std", "ttr"))


def test_detection(spark, texts):
    for r in QUERIES["detection"](spark, DATA).collect():
        want = passage(texts[1][r.doc_id])
        assert (r.ai_score, r.verdict) == (want["ai_score"], want["verdict"]) and (r.fix is not None) == (want["ai_score"] >= 65)
        assert r.rectified_text == whole(texts[1][r.doc_id])[0] and len(r.rectification_details.sample_changes) <= 5


def test_full_scan_and_offsets(spark, texts):
    refs = dict(spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect())

    def marks(t):
        tk = re.findall(r"\w+", t.lower())
        h = [hashlib.md5(" ".join(tk[i : i + 5]).encode()).hexdigest()[:16] for i in range(len(tk) - 4)]
        return {min((h[j], -j) for j in range(i, i + 4)) for i in range(len(h) - 3)}

    held = {i: [h for h, _ in marks(t)] for i, t in refs.items()}
    for r in QUERIES["full_scan"](spark, DATA).collect():
        text = texts[1][r.doc_id].replace("\n", "\n\n")
        ps = parts(text)
        points = [[sentence(s) for s in ss] for _, _, ss in ps]
        flat = [x for p in points for x in p]
        holistic = passage("\n\n".join(p for _, p, _ in ps))
        ratio = sum(x >= 65 for x in flat) / max(len(flat), 1)
        overall = max(0, min(100, round(holistic["ai_score"] * 0.5 + sum(flat) / max(len(flat), 1) * 0.3 + ratio * 100 * 0.2)))
        assert r.overall_score == overall and r.flagged_ratio == round(ratio, 4) and len(r.reasons) == holistic["reasons"]
        assert [(p.paragraph_id, p.ai_score, p.sentence_count) for p in r.paragraph_analysis] == [(i, round(sum(x) / len(x)) if x else 0, len(x)) for (i, _, _), x in zip(ps, points, strict=True)]
        at, want = 0, []
        for i, _, ss in ps:
            for k, s in enumerate(ss):
                start = text.find(s, at)
                start = at if start < 0 else start
                at = start + len(s)
                want.append((f"p{i}_s{k}", s, start, at))
        assert [(c.sentence_id, c.text, c.char_start, c.char_end) for c in r.sentence_heatmap] == want and [c.ai_score for c in r.sentence_heatmap] == flat
        asked = {h for h, _ in marks(text)}
        shared = {str(i): sum(h in asked for h in hs) for i, hs in held.items()}
        assert {i: (m.shared_fingerprints, m.similarity) for i, m in r.exact_matches.items()} == {i: (n, round(n / len(asked), 4)) for i, n in shared.items() if n}


def test_entities_are_resolved(spark, texts):
    assert all(r.clean == normal(texts[0][r.doc_id]) for r in QUERIES["unaltered_normalized"](spark, DATA).collect())
    raw = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    assert all(r.html == html.unescape(raw[r.page_id]) for r in QUERIES["html_unescape"](spark, DATA).collect())
    for r in QUERIES["unaltered_scan"](spark, DATA).collect():
        ps = parts(texts[0][r.doc_id])
        words = sum(len(s.split()) for _, _, ss in ps for s in ss)
        assert (r.total_words, r.total_paragraphs, r.total_sentences) == (words, len(ps), sum(len(ss) for _, _, ss in ps))
