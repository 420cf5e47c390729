"""Steps of full scans that are done by blocks, against plain ones, and how often they are in the plan."""

import hashlib
import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from textloom import lexicon
from textloom.operators import fingerprint, library, report, scan, score
from textloom.session import Settings


def optimized(d):
    return d._jdf.queryExecution().optimizedPlan().toString()


def executed(d):
    return d._jdf.queryExecution().executedPlan().toString()


TEXT = "the quick brown fox jumps over the lazy dog while the sun sets in the west"


def test_chunks_are_encoded_once_and_stay_where_they_are(spark):
    """The texts' chunks go through the encoder once, and no join brings what is found back to them."""
    docs = spark.createDataFrame([("a", f"{TEXT}. {TEXT}."), ("b", f"Nothing here is like it at all. {TEXT}."), ("c", None)], "doc_id string, text string")
    refs = library.index(docs)
    found = library.matches(docs, refs, "doc_id", "text", Settings())
    assert executed(library.semantic_query(docs, refs.chunks, unique=True)).count("ArrowEvalPython") == 2
    assert "query_chunk" not in "".join(line for line in optimized(found).splitlines() if "Join Inner" in line)
    rows = {r.doc_id: r for r in found.collect()}
    assert set(rows) == {"a", "b"} and [m.query_chunk for m in rows["a"].semantic_matches] == [f"{TEXT}."] * 6
    both = [library.semantic_query(docs, refs.chunks, threshold=0.1, unique=u) for u in (True, False)]
    assert both[0].schema == both[1].schema and sorted(both[0].collect()) == sorted(both[1].collect())


def test_distinct_hashes_against_plain_ones(spark):
    r = random.Random(5)
    word = lambda: r.choice(["ab", "c" * r.randint(1, 30), "é" * r.randint(1, 14), "漢", "İx", "ΑΣ", "_"])
    texts = [None, "", " ", "a", "a b c d e f g h", "--a b. c d e f g h--", "a " * 40, *["".join(word() + r.choice([" ", ", ", "\n"]) for _ in range(r.randint(0, 60))) for _ in range(60)]]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for k, w in ((5, 4), (1, 2), (2, 5)):
        q = fingerprint.query_hashes(d, k=k, w=w, unique=True)
        # Nothing is made of each token in a lambda.
        assert "md5(" not in optimized(q)
        assert sorted(q.collect()) == sorted(fingerprint.query_hashes(d, k=k, w=w).collect())
    long = "x" * 300 + " " + " ".join("word%d" % i for i in range(20))
    tk = long.split()
    own = [hashlib.md5(" ".join(tk[i : i + 5]).encode()).hexdigest()[:16] for i in range(len(tk) - 4)]
    # Slices of a larger array have offsets of their own.
    assert fingerprint._winnowed(pa.array(["zz", "yy zz", long, ""]).slice(1), 5, 1).to_pylist() == [[], sorted(own), []]


def test_evidence_against_plain_lookup():
    r = random.Random(3)
    words = [*lexicon.AI_TENTHS, *lexicon.HUMAN_TENTHS, *lexicon.CANNED, "İ", "ΑΣ", "é", "x", "漢字", "furthermorex", "Furthermore", "DELVE", "ȧb", "\U0001d400"]
    texts = ["", "a", "İ", *["".join(r.choice(words) + r.choice([" ", "\n", ". ", "-", "'", ", ", ""]) for _ in range(r.randint(0, 12))).strip() for _ in range(3000)]]
    e = score.evidence(texts)
    distinct = score.whole_evidence(texts).field("distinct").to_pylist()
    for i, t in enumerate(texts):
        low = t.lower()
        tk = re.findall(r"[^ \n.,;:!?\-'\"̇]+", low)
        canned = [p for p in lexicon.CANNED if re.search(rf"(?<!\w){re.escape(p)}(?!\w)", low)]
        assert (e["n"][i].as_py(), e["ai"][i].as_py(), e["human"][i].as_py(), e["canned"][i].as_py()) == (len(tk), [x for x in tk if x in lexicon.AI_TENTHS], [x for x in tk if x in lexicon.HUMAN_TENTHS], canned), t
        assert distinct[i] == len(set(tk))
    assert [len(x) for x in score.evidence([]).values()] == [0, 0, 0, 0]


def test_scans_look_no_words_up_in_lambdas(spark):
    d = spark.createDataFrame([(1, TEXT + ". Furthermore, we delve.\n\nShort one here."), (1, None), (2, "")], "doc_id int, text string")
    for made in (scan.document_scan(d), scan.heatmap(d), report.scan_full(d)):
        # The pattern that splits a normalised text into tokens.
        assert r"\u0307" not in optimized(made)
    got = {r.text: (r.word_count, r.ai_markers) for r in scan.heatmap(d).collect()}
    assert got == {TEXT + ".": (16, []), "Furthermore, we delve.": (3, ["delve", "furthermore"]), "Short one here.": (3, [])}
    assert scan.heatmap(d.where(F.col("doc_id") == 2)).collect() == []


def test_words_of_sentences_are_counted_without_splitting(spark):
    text = "one two\nthree  four.\n\nfive \n six seven!\n \neight nine, ten eleven twelve? " + "w " * 9 + "end."
    d = spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")
    f = score.features(d)
    assert r"[ \n]+, -1" not in optimized(f) and "regexp_extract_all" not in optimized(f)
    assert [r._wc for r in f.orderBy("_row.doc_id").collect()] == [[4, 3, 5, 10], []]


def test_premium_scans_split_texts_once(spark):
    d = spark.createDataFrame([(1, f"{TEXT}. Furthermore, we delve.Into it.\n\nA second paragraph, e.g. this one.")], "doc_id int, text string")
    full = report.scan_full(d, premium=True)
    # The pattern of stops that glue two sentences together.
    assert optimized(full).count(r"\.(?=[A-Z])(?<=[a-z0-9]\.)") == 1
    assert [s.text for s in full.first().sentence_heatmap] == [f"{TEXT}.", "Furthermore, we delve.", "Into it.", "A second paragraph, e.g. this one."]
    assert full.first().rectified_text == report.detect(d, premium=True).first().rectified_text
