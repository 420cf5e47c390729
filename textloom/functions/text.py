"""Column functions on text, all inside the JVM unless the name says otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as Python's str.strip and str.split see it.
#: Printable ASCII is ruled out first: most characters are, and a class is tested from left to right.
_SPACES = r"\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
SPACE = rf"[[^!-~]&&[{_SPACES}]]"
NOT_SPACE = rf"[!-~[^{_SPACES}]]"
#: The same signs, for Spark's trimming, which looks at the ends of a text alone; a pattern would be tried at each place.
_BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: A word character is a letter, a number or an underscore of any script; Java's \w would be ASCII only.
WORD_CHAR = r"[a-zA-Z0-9_\p{L}\p{N}]"
BETWEEN_WORDS = r"[^a-zA-Z0-9_\p{L}\p{N}]+"
NOT_BEFORE, NOT_AFTER = rf"(?<!{WORD_CHAR})", rf"(?!{WORD_CHAR})"


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c, with c computed once however often f uses it: a lambda's variable is bound to a value, where a column would be copied into every place."""
    return F.element_at(F.transform(F.array(c), f), 1)


def each(d: DataFrame, kept: list, array: Column | str, item: str, pos: str = "_pos") -> DataFrame:
    """The kept columns of d, pos and item for each element of an array.

    Not explode: Spark infers a filter on the array's size for it and pushes that down to the scan, where the array is computed a second time.
    """
    return d.select(*kept, F.posexplode_outer(array).alias(pos, item)).where(F.col(pos).isNotNull())


def settled(d: DataFrame) -> DataFrame:
    """d, whose columns are computed here and once.

    Where a Python function follows on columns that were computed from another's, the optimizer merges the steps between
    and copies each of their expressions into every place that uses it. It merges nothing across a generator.
    """
    return d.select(F.explode_outer(F.array(F.struct(*[F.col(f"`{c}`") for c in d.columns]))).alias("_settled")).select("_settled.*")


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(_BLANKS))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(_BLANKS))


def bounded(text: str) -> str:
    """Pattern of a text that is no part of longer words. The text itself comes first, so that most places are ruled out by its first letter."""
    return rf"{text}{NOT_AFTER}(?<!{WORD_CHAR}{text})"


def tokens(c: Column) -> Column:
    """Lower-cased runs of word characters."""
    return F.array_remove(F.split(F.lower(c), BETWEEN_WORDS), "")


def clean_tokens(c: Column) -> Column:
    """tokens of a normalised text, in which few signs are left; the dot above is what lower case leaves of a dotted I."""
    return F.array_remove(F.split(F.lower(c), r"[ \n.,;:!?\-'\"\u0307]+"), "")


def words(c: Column) -> Column:
    """Pieces between white space."""
    return F.array_remove(F.split(c, rf"{SPACE}+"), "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def capitalize(c: Column) -> Column:
    """First letter upper, all others lower."""
    return let(c, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substring(x, 2, 2**31 - 1))))


def preview(c: Column, n: int) -> Column:
    return let(c, lambda x: F.when(F.length(x) > n, F.concat(F.left(x, F.lit(n)), F.lit("..."))).otherwise(x))


def lookup(table: dict, key: Column) -> Column:
    """Value of a small constant map, or null."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def fixed(x: Column, digits: int) -> Column:
    """A number of 0 or more with so many decimals, one at least, as a string, rounded as Python does: by its exact binary value, half to even.

    Java rounds the shortest decimal form, which differs where that form ends in a 5 just past the last digit.
    There the fraction times 2^60 is an exact integer and tells on which side of the half the number lies.
    """

    def on_edge(v: Column) -> Column:
        whole = F.floor(v)
        shown = F.replace(v.cast("string"), F.lit("."), F.lit("")).cast("decimal(20,0)")
        edge = (shown - whole * F.lit(10 ** (digits + 1))).cast("decimal(12,0)")
        exact = ((v - whole) * F.lit(2.0**60)).cast("long").cast("decimal(20,0)") * F.lit(10 ** (digits + 1)).cast("decimal(12,0)")
        half = edge * F.lit(2**60).cast("decimal(19,0)")
        low = F.floor(shown / 10)
        up = (exact > half) | ((exact == half) & (low % 2 == 1))
        return F.format_string(f"%.{digits}f", (low + F.when(up, 1).otherwise(0)).cast("double") / 10.0**digits)

    return let(x, lambda v: F.when(F.rlike(v.cast("string"), F.lit(rf"^\d+\.\d{{{digits}}}5$")), on_edge(v)).otherwise(F.format_string(f"%.{digits}f", v)))
