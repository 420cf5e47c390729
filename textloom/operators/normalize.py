"""Text normalisation: an ordered chain of rewrites.

Most steps are about letters and signs of all scripts, and the first, HTML
entities, has no built-in. Measured on 26 MB, a dozen passes of Spark's regular
expressions take 17 CPU seconds and one pass of Arrow batches through Python's
5, so texts go through Python once, and what is made of them is native.
Null gives the empty string.
"""

from __future__ import annotations

import functools
import html
import re
import sys

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom import lexicon
from textloom.session import bound_batches

_FENCED, _INLINE = re.compile(r"```[\s\S]*?```"), re.compile(r"`([^`]+)`")
_COMMAND, _BARE = re.compile(r"\\[a-zA-Z]+\{([^}]*)\}"), re.compile(r"\\[a-zA-Z]+")
_BRACKETS, _OTHER = re.compile(r"[$^_{}\[\]\\]"), re.compile(r"[^\w\s.,;:!?\-'\"]")
_GAPS, _LOOSE = re.compile(r"\t[ \t]*| [ \t]+"), re.compile(r"\s+(?=[.,;:!?])")
_EMPTY_LINES = re.compile(r"\n{3,}")
#: All of these are single signs and none of their words holds one, so one pass replaces them.
_WORDS = dict(lexicon.TYPOGRAPHY + lexicon.MATH + lexicon.GREEK)
_SIGN = re.compile(f"[{''.join(_WORDS)}]")
#: What has no sign of this class, no underscore and none of _SIGN keeps all its signs.
_ODD = re.compile(r"[^\w \n\t.,;:!?\-'\"]")
#: A stop after white space, looked for by the stop, which is rarer.
_AFTER_GAP = re.compile(r"[.,;:!?](?<=\s[.,;:!?])")
_CONTROL, _FAR = re.compile(r"[\x00-\x08\x0b-\x1f\x7f]"), re.compile("[\U00010000-\U0010ffff]")


@functools.cache
def _unprintable(first: int, last: int) -> re.Pattern:
    """Signs of a range of code points that are not printable, but for line breaks and tabs."""
    out, start = [], None
    for c in range(first, last + 2):
        bad = c <= last and not chr(c).isprintable() and c not in (9, 10)
        if bad and start is None:
            start = c
        elif not bad and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return re.compile(f"[{''.join(out)}]")


def _printable(text: str) -> str:
    """The text without unprintable signs. Classes within the first 65,536 code points are looked up, others are searched range by range, so these are kept apart."""
    if text.isascii():
        return _CONTROL.sub("", text)
    text = _unprintable(0, 0xFFFF).sub("", text)
    return _unprintable(0x10000, sys.maxunicode).sub("", text) if _FAR.search(text) else text


def normalized(text: str | None, entities: bool = True) -> str:
    """One text, normalised."""
    if not text:
        return ""
    if entities and "&" in text:
        text = html.unescape(text)
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "`" in text:
        text = _INLINE.sub(r"\1", _FENCED.sub(" ", text))
    if "\\" in text:
        text = _COMMAND.sub(r"\1", text)
        for a, b in lexicon.LATEX:
            text = text.replace(a, b)
        text = _BARE.sub(" ", text)
    if "_" in text or _ODD.search(text) or not text.isascii() and _SIGN.search(text):
        text = _BRACKETS.sub(" ", text)
        if not text.isascii():
            text = _SIGN.sub(lambda m: _WORDS[m[0]], text)
        text = _OTHER.sub(" ", _printable(text))
    if "  " in text or "\t" in text:
        text = _GAPS.sub(" ", text)
    if _AFTER_GAP.search(text):
        text = _LOOSE.sub("", text)
    return (_EMPTY_LINES.sub("\n\n", text) if "\n\n\n" in text else text).strip()


def unescape_html(c: Column) -> Column:
    """HTML5 character references, numeric ones and those without a semicolon included."""
    bound_batches()

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([html.unescape(t) if t and "&" in t else t for t in texts.to_pylist()], pa.string())

    return run(c)


def normalize(c: Column, entities: bool = True) -> Column:
    """A column of texts, normalised. Without entities, HTML references stay as they are written."""
    bound_batches()

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([normalized(t, entities) for t in texts.to_pylist()], pa.string())

    return run(c)
