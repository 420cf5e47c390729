"""Normaliser and chunker."""

import html
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from textloom import lexicon
from textloom.functions.text import clean_tokens, fixed, tokens
from textloom.operators import chunk
from textloom.operators.normalize import normalize


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize("text", ["", None])
def test_nothing(spark, text):
    assert one(spark, text, normalize) == ""


def test_latex(spark):
    got = one(spark, r"Given $\sigma = 5$ the \textbf{variance} of $\mu$ is \sum x.", normalize)
    assert all(w in got for w in ("sigma", "mu", "variance", "sum")) and "\\textbf" not in got and "$" not in got


def test_signs(spark):
    assert one(spark, "∑ of α ≤ β, ∂Ω ≠ 2×3", normalize) == "sum of alpha less than or equal beta, partialOmega not equal 2times3"


def test_typography(spark):
    assert one(spark, "“A” ‘b’ c—d –e…", normalize) == "\"A\" 'b' c - d - e..."


def test_entities_and_controls(spark):
    assert one(spark, "a &amp; b&#x41; c\u200b\u00a0d &lt;x&gt; don't_stop", normalize) == "a bA cd x don't stop"


def plain_normalize(t):
    t = html.unescape(t or "").replace("\r\n", "\n").replace("\r", "\n")
    t = re.sub(r"`([^`]+)`", r"\1", re.sub(r"```[\s\S]*?```", " ", t))
    t = re.sub(r"\\[a-zA-Z]+\{([^}]*)\}", r"\1", t)
    for a, b in lexicon.LATEX:
        t = t.replace(a, b)
    t = re.sub(r"[\$\^_{}\[\]\\]", " ", re.sub(r"\\[a-zA-Z]+", " ", t))
    for a, b in lexicon.TYPOGRAPHY + lexicon.MATH + lexicon.GREEK:
        t = t.replace(a, b)
    t = "".join(c for c in t if c in "\n\t" or c == " " or unicodedata.category(c)[0] not in "CZ")
    t = re.sub(r"[ \t]+", " ", re.sub(r"[^\w\s.,;:!?\-'\"]", " ", t))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"\s+([.,;:!?])", r"\1", t)).strip()


def test_against_plain_python(spark):
    texts = ["x `y` ```z\nw``` v", "\\int \\in \\input{q} {a}[b]^2", "«x» ‹y› † § ·", "a  \t b\n\n\n\n c !", "é ü\u00ad漢字 ①", "tab\there\r\nnew", "2 < 3 &hellip; &notanentity; &copy", "--- ' \" ;:", "\\alpha\\beta$\\pi$ \\pmod"]
    got = [r.x for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(normalize(F.col("t")).alias("x")).collect()]
    assert got == [plain_normalize(t) for t in texts]


def sentences(spark, text):
    return one(spark, text, chunk.chunk_sentences)


def test_abbreviations(spark):
    assert len(sentences(spark, "Dr. Smith met Prof. Lee, e.g. at noon. They left at 10 a.m. promptly.")) == 2


def test_abbreviations_against_plain_python(spark):
    r = random.Random(8)
    raw = ["".join(r.choice(["e.g.", "I.E.", "i.e.g.", "e.g.e.g.", "Dr.", "xdr.", "al.", "é.g.", "etc. ", "fig.", "a b ", "c d. ", "\u00a0", '"', "'", "! ", "x.Y", "vs.", "\n"]) for _ in range(r.randint(1, 25))) for _ in range(300)]

    def plain(t):
        t = re.sub(r"([a-z0-9])\.([A-Z])", r"\1. \2", t)
        for a in lexicon.ABBREVIATIONS:
            t = re.sub(r"\b" + re.escape(a), lambda m: m[0].replace(".", "\0"), t, flags=re.I)
        return [p for x in re.split(r"(?<=[.!?])(?=[\s\"']+|$)", t) if len((p := x.replace("\0", ".").strip()).split()) >= 2]

    d = spark.createDataFrame([(i, t) for i, t in enumerate(raw)], "i int, t string")
    got = {x.i: x.s for x in d.select("i", chunk.chunk_sentences(F.col("t")).alias("s")).collect()}
    assert [got[i] for i in range(len(raw))] == [plain(t) for t in raw]


def test_missing_space(spark):
    assert sentences(spark, "We saw many observations.For instance this one.") == ["We saw many observations.", "For instance this one."]


def test_quotes_and_fragments(spark):
    assert sentences(spark, 'He said "Go now." Then left! Stop. It was done.') == ['He said "Go now.', '" Then left!', "It was done."]


@pytest.mark.parametrize("blank", ["\u00a0", "\u3000", "\u2009", "\x0b", "\x1f"])
def test_all_white_space_ends_sentences(spark, blank):
    text = f"One two three.{blank}Four five six. Seven eight."
    want = ["One two three.", "Four five six.", "Seven eight."]
    assert sentences(spark, text) == want and one(spark, text, chunk.detector_sentences) == want
    assert one(spark, f"One two three four.{blank}Five six seven eight.", chunk.semantic_chunks) == ["One two three four.", "Five six seven eight."]
    assert [p.text for p in one(spark, f"A b.\n{blank}\nC d.", chunk.paragraphs)] == ["A b.", "C d."]


def test_clean_texts_split_like_any(spark):
    r = random.Random(3)
    raw = ["".join(r.choice(["ab", "Cd", "é", "İ", "x.Y ", ". ", "! ", "\n", "_", "-", "'", '"', "? ", " ", "ß", "1"]) for _ in range(r.randint(0, 80))) for _ in range(200)]
    d = spark.createDataFrame([(i, plain_normalize(t)) for i, t in enumerate(raw)], "i int, t string")
    c = F.col("t")
    rows = d.select((chunk.clean_sentences(c) == chunk.detector_sentences(c)).alias("s"), (clean_tokens(c) == tokens(c)).alias("k")).collect()
    assert all(x.s and x.k for x in rows)


def test_camel_case(spark):
    assert one(spark, "An oldWord stands here.", chunk.detector_sentences) == ["An old.", "Word stands here."]


def test_offsets_and_totals(spark):
    text = "One two three. Four five!\n\n\n \nSix seven. Eight.\n\nNine ten eleven."
    rows = chunk.sentence_offsets(spark.createDataFrame([(1, text), (2, None), (3, "  ")], "doc_id int, text string")).orderBy("char_start").collect()
    assert [r.sentence_id for r in rows] == ["p0_s0", "p0_s1", "p1_s0", "p2_s0"]
    assert all(text[r.char_start : r.char_end] == r.text for r in rows)


def test_reassemble(spark):
    d = spark.createDataFrame([([["A b.", " C d. "], [], ["", "E f."]],)], "n array<array<string>>")
    assert d.select(chunk.reassemble(F.col("n")).alias("x")).first().x == "A b. C d.\n\nE f."


def test_fixed_rounds_as_python(spark):
    xs = [8.125, 9.995, 12.345, 123.455, 1000.005, 4095.625, 99.995, 17.0, 0.715, 0.125, 0.375, 0.285, 0.145, 0.155, 0.5, 1.005, 2.675, 0.3333, 0.0]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i")
    assert [r.y for r in d.select(fixed(F.col("x"), 2).alias("y")).collect()] == [f"{x:.2f}" for x in xs]


def test_ends_and_breaks_beside_plain_patterns(spark):
    """What looks at the ends of a text, or begins with what is rare, gives what plain patterns give, of all white space and glued words."""
    from textloom.functions import text

    odd = [" a ", " 　x y\u0085\n", "\x1c\x1f", "", "no", "​kept​", "a.B.C aBcD eF", "Hi! \n\tYou?  Me. x", "Dr. Who e.g.A b.  C d", "\u0085a. \u0085B c"]
    blank = r"[\s\x0b\x1c-\x1f\x85\xa0  -     　]"
    d = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string")
    got = d.select("i", text.strip(F.col("t")).alias("s"), text.lstrip(F.col("t")).alias("l"), chunk.detector_sentences(F.col("t")).alias("d")).orderBy("i").collect()
    for row, t in zip(got, odd, strict=True):
        assert (row.s, row.l) == (t.strip(), t.lstrip())
        parts = re.split(rf"(?<=[.!?]){blank}+", re.sub("([a-z])([A-Z])", r"\1. \2", t).strip())
        assert row.d == [p.strip() for p in parts if len(p.split()) >= 2]


def test_patterns_do_not_look_back_at_each_place():
    """A look-behind at the front of a pattern is tried at each place of a text; trimming uses no pattern."""
    from textloom.functions import text

    assert "regexp" not in str(text.strip(F.col("t"))) and "regexp" not in str(chunk.lstrip(F.col("t")))
    assert not any(p.startswith("(?<") for p in (chunk._CASE, chunk._GLUED, chunk._GAP, text.bounded("it is")))


def test_arrow_batches_are_bounded(spark):
    """Scans lower the rows and bytes that a Python worker gets at a time, unless somebody set them."""
    from textloom.operators import scan

    keys = [f"spark.sql.execution.arrow.max{k}PerBatch" for k in ("Records", "Bytes")]
    before = [spark.conf.get(k, None) for k in keys]
    try:
        for k in keys:
            spark.conf.unset(k)
        scan.document_scan(spark.createDataFrame([(1, "a b")], "doc_id int, text string"))
        assert [spark.conf.get(k) for k in keys] == ["1000", "4m"]
        spark.conf.set(keys[0], "7")
        scan.document_scan(spark.createDataFrame([(1, "a b")], "doc_id int, text string"))
        assert spark.conf.get(keys[0]) == "7"
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
