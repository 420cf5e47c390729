"""The driver's queries: one or more for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions.text import each, preview, tokens, word_count
from textloom.operators import chunk, fingerprint, library, normalize, pruned, rectify, report, scan, score, sketches, vectors
from textloom.plans.planted import planted
from textloom.sources import requests
from textloom.sources.folders import shared_folder
from textloom.sources.tables import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _docs(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def _planted(spark, d):
    return _docs(spark, d).select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text"))


def _spaced(spark, d):
    """Planted documents with their lines as paragraphs."""
    return _planted(spark, d).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))


def _features(spark, d):
    return score.features(_planted(spark, d), entities=False).withColumn("doc_id", F.col("_row.doc_id"))


@query
def token_stats(spark, d):
    x = _docs(spark, d).select("doc_id", tokens(F.col("text")).alias("tk"))
    return x.select("doc_id", F.size("tk").cast("long").alias("n_tokens"), F.size(F.array_distinct("tk")).cast("long").alias("n_distinct"), F.when(F.size("tk") > 0, F.size(F.array_distinct("tk")) / F.size("tk")).otherwise(0.0).alias("ttr"))


@query
def token_frequency(spark, d):
    return each(_docs(spark, d), ["doc_id"], tokens(F.col("text")), "token").groupBy("token").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query
def sentences(spark, d):
    return each(_planted(spark, d), ["doc_id"], chunk.detector_sentences(F.col("text")), "sentence", "pos").select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence")


@query
def burstiness(spark, d):
    return _features(spark, d).select("doc_id", F.col("_k").cast("long").alias("n_sentences"), F.col("_std").alias("stddev"), F.col("_cv").alias("cv"))


@query
def opener_mode(spark, d):
    return _features(spark, d).where("_k > 0").select("doc_id", F.col("_mode.item").alias("opener"), F.col("_mode.n").cast("long").alias("n"))


@query
def marker_hits(spark, d):
    f = _features(spark, d)
    both = F.concat(F.transform("_ai", lambda t: F.struct(F.lit("ai").alias("kind"), t.alias("token"))), F.transform("_human", lambda t: F.struct(F.lit("human").alias("kind"), t.alias("token"))))
    return each(f, ["doc_id"], both, "x").groupBy("doc_id", "x.kind", "x.token").agg(F.count("*").alias("n"))


@query
def marker_weights(spark, d):
    return _features(spark, d).select("doc_id", F.col("_ait").alias("ai_tenths"), F.col("_humant").alias("human_tenths"), F.size("_ai").cast("long").alias("n_ai"), F.size("_human").cast("long").alias("n_human"))


@query
def robotic_phrases(spark, d):
    return _features(spark, d).select("doc_id", F.posexplode("_canned").alias("p", "phrase")).select("doc_id", (F.col("p") + 1).cast("long").alias("place"), "phrase")


@query
def passage_logit(spark, d):
    return score.passage_logit(_features(spark, d)).where("_n >= 15").select("doc_id", F.col("_logit").alias("logit"))


@query
def passage_score(spark, d):
    return score.passage_score(score.passage_logit(_features(spark, d))).select("doc_id", F.col("_score").alias("ai_score"), F.col("_verdict").alias("verdict"))


@query
def verdict_counts(spark, d):
    return score.passage_score(score.passage_logit(_features(spark, d))).groupBy(F.col("_verdict").alias("verdict")).agg(F.count("*").alias("n"), F.min("_score").alias("least"), F.max("_score").alias("most"))


@query
def normalized(spark, d):
    return _planted(spark, d).select("doc_id", normalize.normalize(F.col("text"), entities=False).alias("clean"))


@query
def html_unescape(spark, d):
    return table(spark, d, "pages").select("page_id", normalize.unescape_html(F.col("html")).alias("html"))


@query
def paragraphs(spark, d):
    p = chunk.paragraph_rows(_spaced(spark, d))
    return p.select("doc_id", F.col("paragraph_id").cast("long").alias("paragraph_id"), "text", F.size("sentences").cast("long").alias("n_sentences"))


@query
def chunk_sentences(spark, d):
    s = chunk.sentence_rows(_spaced(spark, d))
    return s.select("doc_id", F.col("paragraph_id").cast("long").alias("paragraph_id"), F.col("index_in_para").cast("long").alias("index_in_para"), "sentence_id", "text", F.col("word_count").cast("long").alias("word_count"))


@query
def chunk_totals(spark, d):
    p = chunk.paragraph_rows(_spaced(spark, d))
    total = F.aggregate(F.transform("sentences", lambda s: word_count(s)), F.lit(0), lambda a, x: a + x)
    return p.groupBy("doc_id").agg(F.count("*").alias("total_paragraphs"), F.sum(F.size("sentences")).alias("total_sentences"), F.sum(total).alias("total_words"))


@query
def sentence_offsets(spark, d):
    return chunk.sentence_offsets(_spaced(spark, d))


@query
def reassemble(spark, d):
    x = _spaced(spark, d).select("doc_id", F.transform(chunk.paragraphs(F.col("text")), lambda p: chunk.chunk_sentences(p["text"])).alias("n"))
    return x.select("doc_id", chunk.reassemble(F.col("n")).alias("text"))


@query
def cleaned_text(spark, d):
    return _spaced(spark, d).select("doc_id", chunk.cleaned_text(F.col("text")).alias("text"))


@query
def text_preview(spark, d):
    return _docs(spark, d).select("doc_id", preview(F.col("text"), 120).alias("text_preview"))


@query
def sentence_scores(spark, d):
    s = score.sentence_scores(chunk.sentence_rows(_spaced(spark, d)), entities=False)
    return s.select("doc_id", "sentence_id", "ai_score", "severity", "is_flagged")


@query
def heatmap(spark, d):
    s = scan.heatmap(_spaced(spark, d), entities=False, with_offsets=False)
    return s.select("doc_id", "paragraph_id", "index_in_para", "sentence_id", "text", "ai_score", "severity", "is_flagged", F.array_join("ai_markers", ",").alias("ai_markers"), F.array_join("robotic_phrases", ",").alias("robotic_phrases"))


@query
def heatmap_with_offsets(spark, d):
    s = scan.heatmap(_spaced(spark, d))
    return s.withColumns({c: F.array_join(c, ",") for c in ("ai_markers", "robotic_phrases")})


@query
def paragraph_rollup(spark, d):
    return scan.paragraph_rollup(_spaced(spark, d), entities=False)


@query
def document_scan(spark, d):
    return scan.document_scan(_spaced(spark, d), entities=False)


@query
def shingles(spark, d):
    return fingerprint.shingles(_docs(spark, d)).select("doc_id", F.col("pos").cast("long").alias("pos"), "hash")


@query
def fingerprints(spark, d):
    return fingerprint.fingerprints(_docs(spark, d)).select("doc_id", F.col("pos").cast("long").alias("pos"), "hash")


def _matches(spark, d):
    index = fingerprint.build_index(table(spark, d, "benchmark"), "item_id")
    return fingerprint.lookup(_docs(spark, d), index, unique=True)


@query
def postings(spark, d):
    return fingerprint.build_index(table(spark, d, "benchmark"), "item_id").select("hash", "doc_id", F.col("pos").cast("long").alias("pos"))


@query
def plagiarism_matches(spark, d):
    return _matches(spark, d).select("query_id", "doc_id", "similarity", F.col("shared_fingerprints").cast("long").alias("shared"), F.col("total_query_fingerprints").cast("long").alias("total"))


@query
def matched_positions(spark, d):
    return _matches(spark, d).select("query_id", "doc_id", F.array_join("matched_positions", ",").alias("positions"))


@query
def shared_hashes(spark, d):
    return fingerprint.shared_hashes(_matches(spark, d))


@query
def knn_topk(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.knn(e.where("vec_id % 50 = 0"), e, k=3).select("query_id", "match_id", F.col("rank").cast("long").alias("rank"), "similarity")


@query
def knn_threshold(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.knn(e.where("vec_id % 50 = 0"), e, k=3, threshold=0.3, skip_self=True).select("query_id", "match_id", F.col("rank").cast("long").alias("rank"), "similarity")


@query
def semantic_chunks(spark, d):
    return each(_docs(spark, d), ["doc_id"], chunk.semantic_chunks(F.col("text")), "chunk", "pos").select("doc_id", F.col("pos").cast("long").alias("pos"), "chunk")


@query
def semantic_chunks_by_space(spark, d):
    return each(_docs(spark, d), ["doc_id"], chunk.semantic_chunks(F.col("text"), spaces_only=True), "chunk", "pos").select("doc_id", F.col("pos").cast("long").alias("pos"), "chunk")


@query
def semantic_search(spark, d):
    """Chunks of the documents of ids divisible by 50 against those of all benchmark passages, with the default encoder."""
    index = library.chunk_vectors(table(spark, d, "benchmark"), "item_id")
    return library.semantic_query(_docs(spark, d).where("doc_id % 50 = 0"), index)


@query
def rectified(spark, d):
    return rectify.rectify(_planted(spark, d))


@query
def rectify_score_delta(spark, d):
    return rectify.rectify(_planted(spark, d)).select("doc_id", "original_ai_score", "rectified_ai_score", "score_reduction", "modifications_count")


@query
def rectify_contractions(spark, d):
    s = each(_planted(spark, d), ["doc_id"], chunk.chunk_sentences(F.col("text")), "s", "pos")
    return s.select("doc_id", F.col("pos").cast("long").alias("pos"), rectify.contractions(F.col("s")).alias("text"))


@query
def reports(spark, d):
    a = score.analysis(_planted(spark, d), entities=False)
    return a.select("doc_id", report.report(F.col("analysis")).alias("report"))


@query
def fix_tips(spark, d):
    a = score.analysis(_planted(spark, d), entities=False)
    return a.select("doc_id", F.array_join(report.fix_tips(F.col("analysis")), "\n").alias("tips"))


def _requests(spark, d):
    """Requests made of conversations: each turn's text comes in one of several places."""
    c, kind = table(spark, d, "conversations"), F.pmod(F.col("turn"), F.lit(5))
    body = F.to_json(F.struct("text"))
    return c.select(
        "conv_id", "turn", "role", F.when(kind == 0, body).alias("json_body"), F.when(kind == 1, F.col("text")).alias("form_text"),
        F.when(kind == 2, body).when(kind == 3, F.concat(F.lit("plain: "), F.replace("text", F.lit('"'), F.lit("'")))).alias("raw_body"), F.when(kind == 4, F.col("text")).alias("query_text"),
    )


@query
def extract_text(spark, d):
    r = _requests(spark, d).select("conv_id", "turn", requests.extract_text(F.col("json_body"), F.col("form_text"), F.col("raw_body"), F.col("query_text")).alias("text"))
    return requests.not_blank(r)


@query
def json_sink(spark, d):
    return requests.as_json(_docs(spark, d).select("doc_id", F.length("text").alias("n")))


@query
def premium_gate(spark, d):
    """Each document belongs to a user; only users that the entitlements call premium see its tips."""
    a = score.analysis(_planted(spark, d), entities=False).withColumn("user_id", F.concat(F.lit("u"), F.pmod("doc_id", F.lit(7))))
    e = spark.range(5).select(F.concat(F.lit("u"), F.col("id")).alias("user_id"), (F.col("id") % 2 == 0).alias("premium"))
    g = report.with_entitlement(a, e)
    return g.select("doc_id", "user_id", "premium", F.when(F.col("premium") & (F.col("analysis.ai_score") >= score.HIGH), F.array_join(report.fix_tips(F.col("analysis")), "\n")).alias("fix"))


@query
def detection(spark, d):
    return report.detect(_planted(spark, d), premium=True).withColumn("metrics", F.to_json("metrics"))


@query
def detection_metrics(spark, d):
    """The metrics of a detection, one column each."""
    m = report.detect(_planted(spark, d), entities=False).select("doc_id", "ai_score", "verdict", "metrics.*")
    listed = [F.array_join(c, ",").alias(c) for c in ("ai_markers_found", "human_markers_found", "robotic_phrases_found")]
    return m.select("doc_id", "ai_score", "verdict", "burstiness_cv", "type_token_ratio", "sentence_count", "word_count", *listed)


@query
def full_scan(spark, d):
    return report.scan_full(_spaced(spark, d), library.index(table(spark, d, "benchmark"), "item_id"), premium=True)


@query
def full_scan_counts(spark, d):
    """A full scan's figures and how many entries each of its lists has."""
    r = report.scan_full(_spaced(spark, d), library.index(table(spark, d, "benchmark"), "item_id"), entities=False)
    sizes = [F.size("paragraph_analysis").alias("n_paragraphs"), F.size("sentence_heatmap").alias("n_sentences"), F.size("reasons").alias("n_reasons"), F.size("exact_matches").alias("n_exact")]
    return r.select("doc_id", "overall_score", "verdict", "flagged_ai_sentence_count", *sizes)


@query
def unaltered_scan(spark, d):
    """The document scan over the documents as they are, entities included."""
    return scan.document_scan(_docs(spark, d))


@query
def unaltered_rectified(spark, d):
    """The rewriter over the documents as they are, entities included."""
    return rectify.rectify(_docs(spark, d))


@query
def unaltered_normalized(spark, d):
    return _docs(spark, d).select("doc_id", normalize.normalize(F.col("text")).alias("clean"))


@query
def distinct_sentences(spark, d):
    """How often sentences repeat over the corpus."""
    return chunk.sentence_rows(_docs(spark, d)).groupBy("text").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs")).where("n > 1")


@query
def fingerprint_rank(spark, d):
    """Documents of the benchmark by how much each query shares with them, ranked."""
    m = _matches(spark, d)
    return m.select("query_id", "doc_id", "similarity", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "doc_id")).cast("long").alias("rank"))



def _grown(spark, d):
    """A library that got the benchmark, then the documents, whose ids are partly the same, and was compacted in between."""
    lib = library.Library(spark, shared_folder(spark))
    lib.add(table(spark, d, "benchmark"), "item_id")
    lib.compact()
    lib.add(_docs(spark, d))
    return lib


@query
def library_registry(spark, d):
    """Each document of a library as of its last addition."""
    return _grown(spark, d).registry().select("doc_id", "text", F.col("n_tokens").cast("long").alias("n_tokens"))


@query
def library_postings(spark, d):
    """Postings of a library: texts added again keep their old ones, and none comes twice."""
    return _grown(spark, d).references().postings.select("hash", "doc_id", F.col("pos").cast("long").alias("pos"))


@query
def library_matches(spark, d):
    """Which documents of a library share what with the benchmark's: each part of its postings is joined as it lies, and heavy hashes are split."""
    m = fingerprint.lookup(table(spark, d, "benchmark"), _grown(spark, d).references().parts, "item_id", unique=True, split=True)
    return m.select("query_id", "doc_id", "similarity", F.col("shared_fingerprints").cast("long").alias("shared"), F.col("total_query_fingerprints").cast("long").alias("total"), F.array_join("matched_positions", ",").alias("positions"))


@query
def knn_pruned(spark, d):
    """knn_topk by the index that opens only blocks that can hold a neighbour."""
    e = table(spark, d, "embeddings")
    index = pruned.build(e, shared_folder(spark))
    return index.search(e.where("vec_id % 50 = 0"), k=3).select("query_id", "match_id", F.col("rank").cast("long").alias("rank"), "similarity")


@query
def distinct_token_sketches(spark, d):
    """Different tokens by source: exact, and whether sketches of two batches, merged, come within 5 percent."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    halves = [sketches.token_sketches(docs.where(F.pmod(F.col("doc_id"), F.lit(2)) == r), "source") for r in range(2)]
    about = sketches.estimates(sketches.merged(*halves)).select(F.col("group").alias("g"), F.col("n_tokens").alias("about"))
    exact = each(docs, ["source"], tokens(F.coalesce("text", F.lit(""))), "token").groupBy("source").agg(F.count_distinct("token").alias("n_tokens"))
    both = exact.join(about, F.col("source").eqNullSafe(F.col("g")))
    return both.select("source", "n_tokens", (F.abs(F.col("about") / F.col("n_tokens") - 1) <= 0.05).alias("close"))


@query
def full_scan_contents(spark, d):
    """What a full scan lists for each document: matches in the library by hash and by vector, as strings."""
    r = report.scan_full(_spaced(spark, d), library.index(table(spark, d, "benchmark"), "item_id"), entities=False)
    exact = F.array_join(F.transform(F.array_sort(F.map_entries("exact_matches")), lambda e: F.concat(e["key"], F.lit(":"), e["value"]["shared_fingerprints"], F.lit("/"), e["value"]["total_query_fingerprints"], F.lit("@"), F.array_join(e["value"]["matched_positions"], "+"))), ";")
    return r.select("doc_id", exact.alias("exact"), F.array_join("reasons", ";").alias("reasons"), F.array_join(F.transform("sentence_heatmap", lambda s: F.concat(s["sentence_id"], F.lit(":"), s["ai_score"], F.lit(":"), s["severity"])), ";").alias("heatmap"))
