"""Scores, scans, rewriting, reports."""

import statistics

import pytest
from pyspark.sql import functions as F

from textloom.operators import fingerprint, library, rectify, report, scan, score
from textloom.session import Settings

AI = "Furthermore, we delve into a multifaceted tapestry of ideas. Moreover, the holistic paradigm is pivotal for synergy. It is important to note that this framework is comprehensive."
HUMAN = "Honestly I kinda love this stuff, lol. It was weird tbh, like super weird and we just laughed a lot about it. Yeah, gonna do it again."


def sentence(spark, text):
    return score.sentence_scores(spark.createDataFrame([(text,)], "text string")).first()


@pytest.mark.parametrize(
    ("text", "points", "severity", "flagged"),
    [
        ("the cat sat down", 25, "low", False), ("we saw a robust cat", 47, "medium", False), ("a robust and pivotal cat", 69, "high", True), ("a robust pivotal holistic cat", 75, "high", True),
        ("it is worth noting that a robust pivotal holistic cat sat", 100, "high", True), ("robust " + "cat " * 28, 62, "medium", True), ("we had awesome food", 5, "low", False), ("two words", 10, "low", False), (None, 10, "low", False),
    ],
)
def test_sentences(spark, text, points, severity, flagged):
    r = sentence(spark, text)
    assert (r.ai_score, r.severity, r.is_flagged) == (points, severity, flagged)


def analyse(spark, text):
    return score.analysis(spark.createDataFrame([(text,)], "text string")).first().analysis


def test_passages(spark):
    assert analyse(spark, "Only three words").verdict == "TOO SHORT"
    assert analyse(spark, "cat " * 14).ai_score == 0
    plain = analyse(spark, " ".join(f"w{i}" for i in range(15)))
    assert (plain.ai_score, plain.verdict) == (27, "LIKELY HUMAN-WRITTEN")
    a = analyse(spark, AI)
    assert a.ai_score >= 65 and a.verdict == "LIKELY AI-GENERATED" and a.metrics.robotic_phrases_found == ["it is important to note that"]
    assert analyse(spark, HUMAN).ai_score < 45
    assert analyse(spark, "don't it's " * 20).metrics.human_markers_found == []


def test_paragraph_rollup_rounds_half_to_even(spark):
    text = "A robust pivotal holistic cat. It is worth noting that a robust pivotal holistic cat sat.\n\nThe cat sat down. It is worth noting that a robust pivotal holistic cat sat.\n\nWord."
    rows = scan.paragraph_rollup(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("paragraph_id").collect()
    assert [(r.ai_score, r.verdict, r.sentence_count) for r in rows] == [(88, "HIGH RISK", 2), (62, "MODERATE", 2), (0, "CLEAN", 0)]


def test_document_scan(spark):
    rows = scan.document_scan(spark.createDataFrame([(1, HUMAN + "\n\n" + AI), (2, "Too short."), (3, None)], "doc_id int, text string")).orderBy("doc_id").collect()
    assert rows[0].total_paragraphs == 2 and rows[0].total_sentences >= 3 and rows[0].flagged_ai_sentence_count > 0
    assert [(r.overall_score, r.verdict, r.flagged_ratio) for r in rows[1:]] == [(0, "TOO SHORT", 0.0)] * 2
    assert scan.heatmap(spark.createDataFrame([(1, AI)], "doc_id int, text string")).count() == 3


def test_rewriting(spark):
    text, log = rectify.rewrite("Furthermore, it is important to note that this plays a pivotal role in life.")
    assert text == "Also, keep in mind that this is key to life." and len(log) == 3
    assert rectify.rewrite("PIVOTAL Pivotal pivotal")[0] == "KEY Key key"
    assert rectify.rewrite("It is a day of which we say that it is fine.")[0] == "It's a day of which we say that it is fine."
    assert rectify.rewrite("it is not so")[0] == "it is not so"
    assert rectify.rewrite("We know it stands as a prime example of all that.")[0] == "We know it's a clear example of all that."
    r = rectify.rectify(spark.createDataFrame([(1, AI), (2, None), (3, " ")], "doc_id int, text string")).orderBy("doc_id").collect()
    assert r[0].original_ai_score > 60 and r[0].score_reduction > 20 and r[0].modifications_count >= len(r[0].sentence_comparisons) > 0
    assert r[1].rectified_text is None and r[2].rectified_text == " " and r[1].score_reduction == 0


def test_native_contractions_agree_with_the_rewriter(spark):
    texts = ["It is a day of which we say that it is fine and they are here.", 'it is "quoted" text that has many words in it', "do not do that", "Cannot we say that we are what they are today, do not you think"]
    got = [r.x for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(rectify.contractions(F.col("t")).alias("x")).collect()]
    assert got == [rectify.rewrite(t)[0] for t in texts]


def test_reports(spark):
    d = score.analysis(spark.createDataFrame([(1, AI), (2, "Short one.")], "doc_id int, text string"))
    rows = d.orderBy("doc_id").select(report.report(F.col("analysis")).alias("r"), report.fix_tips(F.col("analysis")).alias("t")).collect()
    assert rows[0].r.startswith("Verdict: LIKELY AI-GENERATED") and "Reasons:" in rows[0].r
    assert "Replace 'delve' with 'explore'" in rows[0].t and rows[0].t[-1] == report.TIP_ALWAYS
    assert rows[1].t == [report.TIP_LENGTHS, report.TIP_ALWAYS]


CLASH = ["_row", "_clean", "_tk", "_id", "_raw", "_p", "_ps", "_k", "_key", "analysis", "ai_score", "x", "p", "premium", "doc_id2", "metrics", "paragraph_id", "sentences", "id", "t"]


def odd(spark):
    """Repeated and null ids, null, blank and long texts, and columns of names that operators use."""
    rows = [(1, AI), (1, AI), (1, HUMAN), (None, AI), (None, None), (2, ""), (3, " \n "), (4, ("word and more. " * 3000) + "\n\n" + AI)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in CLASH})


@pytest.mark.parametrize("f", [scan.document_scan, rectify.rectify, report.detect, report.scan_full, lambda d: report.detect(d, premium=True), lambda d: report.scan_full(d, premium=True), score.analysis], ids=["scan", "rectify", "detect", "full", "detect premium", "full premium", "analysis"])
def test_a_row_for_each_row(spark, f):
    d = odd(spark)
    got = f(d).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in d.select("doc_id").collect())
    # Repeated rows have the same results, and other texts of the same id their own.
    assert len({str(r) for r in got if r.doc_id == 1}) == 2
    assert f(d.limit(0)).collect() == []


def test_sentences_and_paragraphs_of_repeated_ids(spark):
    d = odd(spark)
    assert scan.heatmap(d).where("doc_id = 1").count() == 2 * 3 + 3
    assert scan.paragraph_rollup(d).where("doc_id = 1").count() == 3 and scan.paragraph_rollup(d.limit(0)).count() == scan.heatmap(d.limit(0)).count() == 0
    twice = scan.document_scan(d).where("doc_id = 1").collect()
    assert all(r.total_paragraphs == 1 and r.total_sentences == 3 for r in twice)
    assert score.sentence_scores(d).columns == [*[c for c in d.columns if c not in score.POINTS], *score.POINTS]
    e = spark.createDataFrame([("clash", True)], "user_id string, premium boolean")
    g = report.with_entitlement(d.withColumn("user_id", F.lit("clash")), e)
    assert g.where("premium").count() == d.count() and g.columns.count("premium") == 1


def test_full_scan_has_all_parts(spark):
    quoted = "the quick brown fox jumps over the lazy dog while the sun sets in the west"
    refs = library.index(spark.createDataFrame([("ref", quoted + ". A second sentence of it.")], "doc_id string, text string"))
    d = spark.createDataFrame([(1, AI + "\n\n" + quoted + "."), (2, "Short."), (3, "nothing that anybody else has ever written down anywhere on any page of any book at all")], "doc_id long, text string")
    rows = {r.doc_id: r for r in report.scan_full(d, refs, premium=True).collect()}
    r = rows[1]
    assert [p.paragraph_id for p in r.paragraph_analysis] == [0, 1] and r.paragraph_analysis[0].verdict == "HIGH RISK" and len(r.sentence_heatmap) == 4
    assert r.sentence_heatmap[3].sentence_id == "p1_s0" and r.sentence_heatmap[3].char_start == len(AI) + 2
    assert r.reasons == r.holistic_analysis.reasons and r.reasons[0].startswith("AI academic")
    assert set(r.exact_matches) == {"ref"} and r.exact_matches["ref"].similarity > 0.2 and len(r.exact_matches["ref"].matched_positions) <= 10
    assert r.semantic_matches[0].matched_text == quoted + "." and r.semantic_matches[0].similarity == 1
    assert r.rectified_text and r.rectification_details.score_reduction > 0 and r.is_premium
    assert (rows[2].verdict, rows[2].paragraph_analysis, rows[2].sentence_heatmap, rows[2].reasons, rows[2].flagged_ratio) == ("TOO SHORT", [], [], [scan.SHORT_REASON], 0.0)
    assert rows[3].exact_matches == {} and rows[3].semantic_matches == []
    gated = report.scan_full(d, library.References(refs.postings.limit(0), refs.chunks)).collect()
    assert all(x.exact_matches is None and x.semantic_matches is None for x in gated)


def test_settings_change_the_scan(spark):
    text = "one two three four five six. alpha beta gamma delta"
    refs = lambda s: library.index(spark.createDataFrame([("r", text)], "doc_id string, text string"), settings=s)
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    small = Settings(winnow_k=2, winnow_w=2)
    spark.conf.set("textloom.winnow_k", "2")
    spark.conf.set("textloom.winnow_w", "2")
    try:
        assert Settings.of(spark) == small
        got = report.scan_full(d, refs(small)).first().exact_matches["r"]
    finally:
        spark.conf.unset("textloom.winnow_k")
        spark.conf.unset("textloom.winnow_w")
    assert got.total_query_fingerprints == fingerprint.fingerprints(d, k=2, w=2).select("hash").distinct().count()


def test_metrics_round_as_python(spark):
    text = " ".join(" ".join(["word"] * n) + "." for n in (2, 3, 3, 40, 7, 5))
    m = analyse(spark, text).metrics
    assert m.sentence_stddev == round(statistics.stdev([2, 3, 3, 40, 7, 5]), 2) and m.burstiness_cv == round(statistics.stdev([2, 3, 3, 40, 7, 5]) / statistics.mean([2, 3, 3, 40, 7, 5]), 4)


def test_gate(spark):
    docs = spark.createDataFrame([(1, AI)], "doc_id int, text string")
    assert "rectified_text" not in report.detect(docs).columns
    r = report.detect(docs, premium=True).first()
    assert r.rectified_text and r.fix


def test_premium_results_compute_their_steps_once(spark):
    """The text is scored once before and once after it is rewritten, on its own row: no join in a detection, and no step copied into the places that use it."""
    d = spark.createDataFrame([(1, AI), (1, AI), (2, None)], "doc_id int, text string")
    for made, scans in ((report.detect(d, premium=True), 0), (rectify.rectify(d), 0), (report.scan_full(d, premium=True), 1)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate [" not in plan
        # Sentences of a normalised text are split at one place for each text that is scored.
        assert plan.count("[ \\n](?<=[.!?][ \\n])[ \\n]*") == 2 + scans


def test_matches_join_before_scans(spark):
    """A full scan shuffles texts, not what is made of them, and deals copies of a text to several tasks."""
    d = spark.createDataFrame([(i, AI) for i in range(40)], "doc_id int, text string")
    refs = library.index(spark.createDataFrame([("r", AI)], "doc_id string, text string"))
    full = report.scan_full(d, refs)
    plan = full._jdf.queryExecution().optimizedPlan().toString()
    joins = [i for i, line in enumerate(plan.splitlines()) if "Join LeftOuter" in line]
    scored = [i for i, line in enumerate(plan.splitlines()) if "_score#" in line]
    assert joins and max(scored) < min(joins)
    rows = full.collect()
    assert len(rows) == 40 and all(r.exact_matches["r"].similarity == 1.0 and r.semantic_matches for r in rows)
