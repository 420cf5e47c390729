"""Splitting documents into paragraphs and sentences, with offsets.

Every split is an expression on the document's own row: nothing is shuffled,
and rows that repeat an id stay apart. White space is what Python takes for
it, no-break spaces included. Null and blank texts have no paragraphs. Columns
that are not named are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom import lexicon
from textloom.functions.text import NOT_BEFORE, NOT_SPACE, SPACE, each, lstrip, strip, word_count
from textloom.session import bound_batches

_DOT = "§DOT§"
_ONE = "|".join(a[:-1] for a in lexicon.ABBREVIATIONS if a.count(".") == 1)
#: The stops of abbreviations. All begin with the stop itself, so that only stops are looked at closely; in i.e.g. the later one counts.
_STOPS = (
    rf"(?i)\.(?:(?<={NOT_BEFORE}(?:{_ONE})\.)|(?<={NOT_BEFORE}e\.)(?=g\.)|(?<={NOT_BEFORE}e\.g\.)"
    rf"|(?<={NOT_BEFORE}i\.)(?=e\.(?!g\.))|(?<={NOT_BEFORE}i\.e\.)(?!g\.))"
)
#: Patterns begin with what is rare and look back from there: a look-behind at the front would be tried at each place.
_CASE = "[A-Z](?<=[a-z][A-Z])"
_GLUED = r"\.(?=[A-Z])(?<=[a-z0-9]\.)"
_GAP = rf"{SPACE}(?<=[.!?]{SPACE}){SPACE}*"
#: Of a text that begins with a word.
_TWO_WORDS = rf"{SPACE}{NOT_SPACE}"
_FOUR_WORDS = rf"^(?:{NOT_SPACE}++{SPACE}++){{3}}{NOT_SPACE}"


def detector_sentences(c: Column) -> Column:
    """Sentences as the scorer sees them: two words at least; a lower letter before an upper one ends a sentence."""
    c = strip(F.regexp_replace(c, _CASE, ". $0"))
    return F.filter(F.transform(F.split(c, _GAP), strip), lambda s: F.rlike(s, F.lit(_TWO_WORDS)))


def clean_sentences(c: Column) -> Column:
    """detector_sentences of a normalised text: it is stripped and its only white space are blanks and line breaks."""
    c = F.regexp_replace(c, _CASE, ". $0")
    return F.filter(F.split(c, r"[ \n](?<=[.!?][ \n])[ \n]*"), lambda s: F.rlike(s, F.lit(r"[ \n]")))


def semantic_chunks(c: Column, spaces_only: bool = False) -> Column:
    """Sentences of four words at least. spaces_only: a line break ends no sentence."""
    c = strip(F.coalesce(c, F.lit("")))
    # No white space is left at the ends of parts between gaps of all kinds.
    parts = F.transform(F.split(c, r" (?<=[.!?] ) *"), strip) if spaces_only else F.split(c, _GAP)
    return F.filter(parts, lambda s: F.rlike(s, F.lit(_FOUR_WORDS)))


def chunk_sentences(c: Column, stripped: bool = False) -> Column:
    """Sentences of a paragraph; stops of abbreviations end none, and parts of one word are dropped. stripped: the paragraph has no white space at its ends."""
    c = F.regexp_replace(c if stripped else strip(c), _GLUED, ". ")
    parts = F.split(F.regexp_replace(c, _STOPS, _DOT), rf"(?<=[.!?])(?={SPACE}|[\x22']|$)")
    # Only white space before a part can be left: the text is stripped, and the parts but the last end with a stop.
    whole = F.transform(parts, lambda s: F.replace(lstrip(s), F.lit(_DOT), F.lit(".")))
    return F.filter(whole, lambda s: F.rlike(s, F.lit(_TWO_WORDS)))


def paragraphs(c: Column) -> Column:
    """Array of (paragraph_id, text): stripped, blank ones left out but counted in the ids."""
    parts = F.split(strip(F.coalesce(c, F.lit(""))), rf"\n{SPACE}*\n")
    return F.filter(F.transform(parts, lambda p, i: F.struct(i.alias("paragraph_id"), strip(p).alias("text"))), lambda x: x["text"] != "")


def cleaned_text(c: Column) -> Column:
    return F.array_join(F.transform(paragraphs(c), lambda p: p["text"]), "\n\n")


def paragraph_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *carry: str) -> DataFrame:
    """A row per paragraph: id, whatever is carried, paragraph_id, text and its sentences."""
    p = each(docs, [id_col, *carry], paragraphs(F.col(text_col)), "p")
    return p.select(id_col, *carry, "p.paragraph_id", "p.text", chunk_sentences(F.col("p.text"), stripped=True).alias("sentences"))


def sentence_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per sentence: id, paragraph_id, index_in_para, sentence_id, text, word_count."""
    s = each(paragraph_rows(docs, id_col, text_col), [id_col, "paragraph_id"], "sentences", "text", "index_in_para")
    return s.select(id_col, "paragraph_id", "index_in_para", sentence_id(F.col("paragraph_id"), F.col("index_in_para")).alias("sentence_id"), "text", word_count(F.col("text")).alias("word_count"))


def parsed(c: Column) -> Column:
    """Array of (paragraph_id, text, sentences)."""
    return F.transform(paragraphs(c), lambda p: F.struct(p["paragraph_id"].alias("paragraph_id"), p["text"].alias("text"), chunk_sentences(p["text"], stripped=True).alias("sentences")))


def offsets(text: Column, nested: Column) -> Column:
    """For sentences by paragraph, (char_start, char_end): each is looked for after the end of the one before, and put there if it is not found.

    The search is sequential over the whole text, so it is an Arrow UDF: one linear scan a document.
    """
    bound_batches()

    @F.arrow_udf("array<array<struct<char_start:int,char_end:int>>>")
    def run(texts: pa.Array, rows: pa.Array) -> pa.Array:
        out = []
        for t, row in zip(texts.to_pylist(), rows.to_pylist(), strict=True):
            at, found = 0, []
            for part in row or ():
                found.append([])
                for s in part:
                    start = (t or "").find(s, at)
                    start = at if start < 0 else start
                    at = start + len(s)
                    found[-1].append({"char_start": start, "char_end": at})
            out.append(found)
        return pa.array(out, pa.list_(pa.list_(pa.struct([("char_start", pa.int32()), ("char_end", pa.int32())]))))

    return run(text, nested)


def sentence_id(paragraph_id: Column, index: Column) -> Column:
    return F.concat(F.lit("p"), paragraph_id.cast("string"), F.lit("_s"), index.cast("string"))


def sentence_offsets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per sentence with char_start and char_end in the raw text; the search runs on from paragraph to paragraph."""
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), parsed(F.col(text_col)).alias("p"))
    d = d.select("id", "p", offsets(F.col("t"), F.transform("p", lambda p: p["sentences"])).alias("o"))
    d = each(d, ["id"], F.arrays_zip("p", "o"), "x")
    d = each(d, ["id", "x.p.paragraph_id"], F.arrays_zip(F.col("x.p.sentences").alias("s"), F.col("x.o").alias("o")), "x", "i")
    return d.select(
        F.col("id").alias(id_col), "paragraph_id", F.col("i").alias("index_in_para"), sentence_id(F.col("paragraph_id"), F.col("i")).alias("sentence_id"),
        F.col("x.s").alias("text"), word_count(F.col("x.s")).alias("word_count"), "x.o.char_start", "x.o.char_end",
    )


def reassemble(nested: Column) -> Column:
    """Text of array<array<string>>: sentences joined by a space, paragraphs by an empty line, blank ones left out."""
    lines = F.transform(nested, lambda ss: F.array_join(F.filter(F.transform(ss, strip), lambda s: s != ""), " "))
    return F.array_join(F.filter(lines, lambda p: p != ""), "\n\n")
