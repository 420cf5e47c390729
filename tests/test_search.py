"""Fingerprints, vectors, requests, streams."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators.encoders import hashed_encoder
from textloom.operators import blocks, fingerprint, library, vectors
from textloom.sources import requests
from textloom.sources.tables import csv_table
from textloom.streaming import index


def plain_fingerprint(text, k=5, w=4):
    tk = re.findall(r"\w+", text.lower())
    hs = [hashlib.md5(" ".join(tk[i : i + k]).encode()).hexdigest()[:16] for i in range(len(tk) - k + 1)]
    return {min(((hs[j], -j) for j in range(i, i + w))) for i in range(len(hs) - w + 1)}


def test_fingerprints(spark):
    texts = ["", None, "a b c d", "a b c d e f g", "a b c d e f g h", "a " * 40, "The quick brown fox jumps over the lazy dog. " * 3, "über naïve 漢字 x y z p q r s t u v w"]
    got = fingerprint.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    for i, t in enumerate(texts):
        assert sorted((r.hash, -r.pos) for r in got if r.doc_id == i) == sorted(plain_fingerprint(t or "")), t


def test_lookup(spark):
    ref = "the quick brown fox jumps over the lazy dog while the sun sets in the west"
    docs = spark.createDataFrame([(1, ref), (2, "completely unrelated words that share nothing at all with any other text here")], "doc_id int, text string")
    ix = fingerprint.build_index(docs, k=4, w=3)
    q = spark.createDataFrame([(9, "he saw the quick brown fox jumps over the lazy dog today")], "doc_id int, text string")
    rows = fingerprint.lookup(q, ix, k=4, w=3).collect()
    assert [r.doc_id for r in rows] == [1] and rows[0].similarity > 0.3
    same = fingerprint.lookup(docs, ix, k=4, w=3).where("query_id = doc_id").collect()
    assert len(same) == 2 and all(r.similarity >= 1 for r in same)
    assert fingerprint.build_index(docs, k=4, w=3, old=ix).count() == ix.count()


def test_knn(spark):
    r = np.random.default_rng(1)
    m = r.normal(size=(300, 8)).astype(np.float32)
    m[7] = 0
    d = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(999, None)], "vec_id long, embedding array<float>").repartition(5)
    got = vectors.knn(d.where("vec_id % 50 = 0"), d, k=4).collect()
    u = vectors.unit(m)
    for q in range(0, 300, 50):
        s = u @ u[q]
        want = sorted(range(300), key=lambda i: (-s[i], i))[:4]
        assert [x.match_id for x in sorted(got, key=lambda x: x.rank) if x.query_id == q] == want
    # However the rows are dealt into cells and blocks, the result is the same.
    for cells, rows in (((1, 1), 7), ((3, 2), 100), ((1, 5), 1000)):
        assert sorted(vectors.knn(d.where("vec_id % 50 = 0"), d, k=4, cells=cells, query_rows=2, index_rows=rows).collect()) == sorted(got)
    longer = spark.createDataFrame([(0, [1.0] * 9)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="vectors of 9 places, the index of 8"):
        vectors.knn(longer, d).collect()


def test_shape_of_cells(spark):
    small, large = spark.range(10), spark.range(10**8)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert blocks.shape(small, large) == (1, n) and blocks.shape(large, small) == (n, 1) and blocks.shape(large, large)[0] == round(n**0.5)


def test_knn_takes_the_smallest_ids_of_many_equal_vectors(spark):
    rows = [(i, [0.6, 0.8]) for i in range(1000, 600, -1)] + [(i, [1.0, 0.0]) for i in range(600, 300, -1)] + [(5, [0.0, 0.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    q = spark.createDataFrame([(5, [0.0, 0.0]), (601, [0.6, 0.8]), (2000, [1.0, 0.0])], "vec_id long, embedding array<float>")
    for own, want in ((False, {5: [5, 301, 302], 601: [601, 602, 603], 2000: [301, 302, 303]}), (True, {5: [301, 302, 303], 601: [602, 603, 604], 2000: [301, 302, 303]})):
        got = vectors.knn(q, d, k=3, skip_self=own).orderBy("query_id", "rank").collect()
        assert {i: [x.match_id for x in got if x.query_id == i] for i in want} == want


def test_registered_searches_build_without_jobs(spark, tmp_path):
    from textloom.plans import queries

    r = np.random.default_rng(4)
    d = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(r.normal(size=(400, 8)))], "vec_id long, embedding array<double>").coalesce(2)
    d.write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.createDataFrame([(i, f"one sentence number {i} of a few words. And then another one, too.") for i in range(60)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, f"one sentence number {i} of a few words.") for i in range(9)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "")
    built = {n: queries.QUERIES[n](spark, str(tmp_path)) for n in ("knn_topk", "semantic_search", "full_scan", "full_scan_counts")}
    # Tables' schemas and one look whether the library holds anything; no job over queries.
    jobs = tracker.getJobIdsForGroup("building")
    spark.sparkContext.setJobGroup("", "")
    assert sum(tracker.getStageInfo(s).numTasks for j in jobs for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)) <= 30
    assert built["knn_topk"].count() == 24
    found = built["semantic_search"].collect()
    assert {r.query_id for r in found} == {0, 50} and all(r.similarity >= 0.75 for r in found)




def test_library_grows_and_answers(spark, tmp_path):
    passages = ["Alpha beta gamma delta runs. Nothing here is like the rest of it.", "Some other words stand in this one!", "", None]
    docs = spark.createDataFrame([(f"r{i}", t) for i, t in enumerate(passages)], "ref string, body string")
    library.append(docs, str(tmp_path), id_col="ref", text_col="body")
    library.append(docs.where("ref = 'r0'"), str(tmp_path), id_col="ref", text_col="body")
    kept = library.stored(spark, str(tmp_path))
    # Postings count once, vectors of a document that comes again are there twice.
    assert kept.postings.count() == library.index(docs, "ref", "body").postings.count() and kept.chunks.count() == 5
    q = spark.createDataFrame([(1, "Alpha beta gamma delta runs. Unheard of things happen now."), (2, None)], "doc_id long, text string")
    rows = library.semantic_query(q, kept.chunks, threshold=0.99).collect()
    assert [(r.query_id, r.query_pos, r.matched_doc, r.matched_text, r.rank) for r in rows if r.rank == 1] == [(1, 0, "r0", "Alpha beta gamma delta runs.", 1)]


def test_what_a_library_rejects(spark):
    text = "the quick brown fox jumps over the lazy dog while the sun sets"
    d = spark.createDataFrame([("a", text), (" ", text), (None, text), ("b", " \u00a0\n"), ("c", None)], "doc_id string, text string")
    both = library.index(d)
    assert {r.doc_id for r in both.postings.collect()} == {r.doc_id for r in both.chunks.collect()} == {"a"} and library.rejected(d).count() == 4


def test_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b\n1,"x, y"\n2,\n')
    assert [tuple(r) for r in csv_table(spark, str(tmp_path / "x.csv")).collect()] == [(1, "x, y"), (2, None)]
    assert csv_table(spark, str(tmp_path), schema="a string, b string").first().a == "1"


def test_semantic_query_against_brute_force(spark):
    import random

    r = random.Random(2)
    text = lambda: ". ".join(" ".join(r.choice(["red", "blue", "green", "dog", "cat", "sky"]) for _ in range(r.randint(3, 7))) for _ in range(4)) + "."
    docs, refs = [(i, text()) for i in range(12)], [(i, text()) for i in range(15)]
    ix = library.chunk_vectors(spark.createDataFrame(refs, "doc_id long, text string"))
    got = library.semantic_query(spark.createDataFrame(docs, "doc_id long, text string"), ix, threshold=0.5).collect()
    cut = lambda t: [s.strip() for s in re.split(r"(?<=[.!?])\s+", t.strip()) if len(s.split()) >= 4]
    entries = sorted((f"{i}#{k:09d}", str(i), c) for i, t in refs for k, c in enumerate(cut(t)))
    m = vectors.unit(hashed_encoder([c for _, _, c in entries]))
    want = set()
    for i, t in docs:
        for k, c in enumerate(cut(t)):
            s = np.cumsum(vectors.unit(hashed_encoder([c])) * m, axis=1)[:, -1]
            best = sorted(range(len(m)), key=lambda j: (-s[j], entries[j][0]))[:3]
            want |= {(i, k, c, entries[j][1], entries[j][2], n + 1) for n, j in enumerate(best) if s[j] >= 0.5}
    assert {(r.query_id, r.query_pos, r.query_chunk, r.matched_doc, r.matched_text, r.rank) for r in got} == want and want


def test_repeated_and_null_ids_and_empty_tables(spark):
    text = "the quick brown fox jumps over the lazy dog while the sun sets in the west"
    d = spark.createDataFrame([(1, text), (1, text), (1, None), (None, text), (None, "")], "doc_id long, text string").withColumns({c: F.lit("x") for c in ("hash", "pos", "tk", "h", "i", "query_id", "total")})
    ix = fingerprint.build_index(d)
    assert {r.doc_id for r in ix.collect()} == {1, None} and ix.count() == len({tuple(r) for r in ix.collect()})
    m = fingerprint.lookup(d, ix).collect()
    assert {(r.query_id, r.doc_id) for r in m} == {(a, b) for a in (1, None) for b in (1, None)} and all(r.similarity == 1 for r in m)
    assert fingerprint.lookup(d.limit(0), ix).count() == fingerprint.lookup(d, ix.limit(0)).count() == fingerprint.fingerprints(d.limit(0)).count() == 0
    v = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None)], "vec_id long, embedding array<double>")
    assert vectors.knn(v, v).count() > 0 and vectors.knn(v.limit(0), v).count() == vectors.knn(v, v.limit(0)).count() == 0


def test_text_precedence(spark):
    rows = [
        ('{"text":"a"}', "b", "c", "d", "a"), ('{"text":""}', "b", "c", "d", "b"), (None, None, '{"text":"r"}', "d", "r"), (None, "", '"js"', "d", "js"), (None, None, "plain", "d", "plain"),
        (None, None, '{"other":1}', "q", "q"), (None, None, "[1]", None, ""), (None, None, None, None, ""),
    ]
    d = spark.createDataFrame(rows, "j string, f string, b string, q string, want string")
    assert all(r.got == r.want for r in d.select("want", requests.extract_text(F.col("j"), F.col("f"), F.col("b"), F.col("q")).alias("got")).collect())


def test_stream_grows_the_index(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i} alpha beta gamma delta epsilon zeta eta theta iota kappa") for i in range(4)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    index.grow_index(stream, str(tmp_path / "ix"), str(tmp_path / "cp")).awaitTermination()
    both, want = index.read_index(spark, str(tmp_path / "ix")), library.index(docs)
    assert {tuple(r) for r in both.postings.collect()} == {tuple(r) for r in want.postings.collect()}
    assert sorted(both.chunks.collect()) == sorted(want.chunks.collect())
    q = index.match_stream(stream, both.postings).writeStream.format("memory").queryName("m").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("m").where("query_id = doc_id").count() >= 4


def test_shingles_lay_no_runs_side_by_side(spark):
    """A run's tokens are taken by place; hashes are those of the joined words, and texts that are too short have none."""
    words = [f"w{i}" for i in range(9)]
    d = spark.createDataFrame([(1, words), (2, words[:4]), (3, [])], "i int, tk array<string>")
    made = fingerprint.shingle_hashes(F.col("tk"))
    assert "arrays_zip" not in str(made)
    got = [r.h for r in d.select("i", made.alias("h")).orderBy("i").collect()]
    assert got == [[hashlib.md5(" ".join(words[i : i + 5]).encode()).hexdigest()[:16] for i in range(5)], [], []]
