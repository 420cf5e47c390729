"""Distinct counts that can be kept and merged: HyperLogLog sketches per group.

A table of sketches (group, sketch) stands for all texts that went into it, in
a few kilobytes a group, and is joined with the next batch's by a union of the
sketches; no text is read again. The relative standard error is about
1.04 / sqrt(2 ** precision), and a group's estimate does not depend on how its
texts were dealt into batches.

Null texts have no tokens. Null groups are a group of their own. Repeated rows
count once for distinct counts. Empty tables give no groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import each, tokens

#: Binary logarithm of a sketch's places: an error of 1.6 percent.
PRECISION = 12


def token_sketches(docs: DataFrame, group_col: str, text_col: str = "text", precision: int = PRECISION) -> DataFrame:
    """A row per group: group and the sketch of its different tokens."""
    t = each(docs, [F.col(group_col).alias("group")], tokens(F.coalesce(F.col(text_col), F.lit(""))), "token")
    return t.groupBy("group").agg(F.hll_sketch_agg("token", F.lit(precision)).alias("sketch"))


def merged(*tables: DataFrame) -> DataFrame:
    """One table of sketches of what several stand for."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("group").agg(F.hll_union_agg("sketch").alias("sketch"))


def estimates(sketches: DataFrame) -> DataFrame:
    """A row per group: group and n_tokens, about how many different tokens it has."""
    return sketches.select("group", F.hll_sketch_estimate("sketch").alias("n_tokens"))
