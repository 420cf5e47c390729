"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textloom.llm import exactdedup, langid, licenses, mixing, neardup, pieces, quality, secrets, syncmers, tokenalign, toxicity, warc

LONG = " ".join(f"word{i % 977} and{i}" for i in range(20_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (1, "The quick brown fox. " * 3, "en", "a", 63), (1, "The quick brown fox. " * 3, "en", "a", 63), (2, None, None, None, None), (3, "", "en", "a", 0), (4, "   \n\t ", "fr", None, 6), (5, LONG, "en", "b", len(LONG)),
    (6, "é漢字😀 \u0000 x", "fr", "b", 9), (None, "no id here at all", "en", "a", 17), (None, None, None, None, None), (7, "no id here at all", "en", "", 17), (8, "password = abcdefghijkl123", "de", "c", 26), (8, "another text of the same id", "de", "c", 27),
]
#: Names that operators use themselves, given to other columns.
CLASH = ["score", "id", "key", "size", "target", "taken", "rep", "class", "pivot", "h", "v", "c", "part", "goes", "head", "hits", "phrase", "mark", "bands", "rough", "ids", "_row", "_src", "digest", "first", "u", "y", "n"]


def docs(spark, rows):
    d = spark.createDataFrame(rows, SCHEMA)
    for c in CLASH:
        d = d.withColumn(c, F.lit("clash"))
    return d


def model(d):
    return langid.learn(d)


OPERATORS = {
    "classes": neardup.near_duplicate_classes,
    "licenses": licenses.scan_licenses,
    "syncmers": syncmers.compare_with_edits,
    "fingerprints": syncmers.fingerprint_documents,
    "mix": mixing.plan_mix,
    "languages": lambda d: langid.predict(d, model(d)),
    "pieces": lambda d: pieces.encode_texts(d, pieces.public_model(), with_ids=True, with_bounds=True),
    "quality": quality.quality_report,
    "secrets": secrets.scan_secrets,
    "alignment": lambda d: tokenalign.align(d, pieces.public_model(tokenalign.BYTE_MODEL), pieces.public_model()),
    "copies": exactdedup.mark_duplicates,
    "toxicity": lambda d: toxicity.score_toxicity(d, toxicity.learn(d, d.select("doc_id", F.lit(1).alias("toxic"), F.lit("x").alias("y")))),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_a_row_for_each_row(spark, name):
    d = docs(spark, ROWS)
    got = OPERATORS[name](d).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS)
    # Repeated rows have the same results.
    one = {repr(r) for r in got if r.doc_id == 1}
    assert len(one) == 1 or name in ("mix", "syncmers", "copies")


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables(spark, name):
    assert OPERATORS[name](docs(spark, [])).collect() == []


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_without_text(spark, name):
    assert len(OPERATORS[name](docs(spark, [(1, None, None, None, None)])).collect()) == 1


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, stage):
    for rows in (ROWS, []):
        d = docs(spark, rows)
        got = stage(spark, d, "")
        if stage is not corpus_pipeline.tokenize:
            assert got.columns == d.columns and [f.dataType for f in got.schema] == [f.dataType for f in d.schema]
        n = len(got.collect())
        assert n <= 2 * len(rows) and (n > 0 or not rows or stage is corpus_pipeline.keep_quality)


def test_archives(spark, tmp_path):
    big = "x" * 200
    rows = [(3, big), (1, big), (2, None), (5, "y"), (4, "y"), (None, big), (1, big), (7, "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n" * 30), (8, LONG)]
    d = spark.createDataFrame(rows, "page_id long, html string").withColumns({"digest": F.lit("clash"), "url": F.lit("http://a/é ?"), "key": F.lit(1)})
    raw = warc.write_archives(d, str(tmp_path), file_bytes=300)
    done = warc.normalise(raw, str(tmp_path))
    got = warc.read_archives(done).collect()
    assert raw.agg(F.sum("n_records")).first()[0] == len(rows) == len(got)
    kinds = sorted((r.key or "", r.record_type, r.refers_to, r.payload_bytes) for r in got)
    assert kinds[0] == ("", "revisit", "1", 200) and ("3", "revisit", "1", 200) in kinds and kinds.count(("1", "response", None, 200)) == 2
    assert {r.record_type for r in got if r.payload_bytes < 100} == {"response"}
    odd = spark.createDataFrame([("", "x"), (None, big), ("a b>", big), ("<urn:page-without-id>", "z")], "page_id string, html string").withColumn("url", F.lit(None).cast("string"))
    names = {r.key: r.refers_to for r in warc.read_archives(warc.normalise(warc.write_archives(odd, str(tmp_path / "o")), str(tmp_path / "o"))).collect()}
    assert names == {"": None, None: "a b>", "a b>": None, "<urn:page-without-id>": None}
    assert warc.read_archives(warc.normalise(warc.write_archives(d.limit(0), str(tmp_path / "e")), str(tmp_path / "e"))).count() == 0
