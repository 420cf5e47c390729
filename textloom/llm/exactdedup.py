"""Exact duplicates by skew-safe combining.

Texts are combined in three stages, and each compares whole texts: rows meet by
digest, but the text itself is a grouping key, so equal digests alone merge
nothing.

1. Each task combines the rows of its own part of the input.
2. What the tasks leave meets by (digest, salt, text). The salt is the number
   of the task modulo ``salts``: however many tasks hold copies of one text, a
   group gets about one row for each ``salts``-th task.
3. The winners of the salts meet by digest, at most ``salts`` rows a text.

The decision goes back to the documents by digest, without texts: a row of the
join is an id and 32 bytes, and adaptive execution splits the digest of a text
that a third of the rows hold. Should two texts ever have one digest, their
rows are decided by (digest, text) instead.

Edge cases: a null text counts as empty. Of equal texts the row with the
largest id stays; a null id is smaller than any other. Where several rows have
that id, or all ids are null, one of them stays. Repeated rows get a row each.
Only the two named columns are read by the decisions, so other columns cannot
clash. An empty table gives an empty result. Texts are compared whole, however long.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import scratch

#: Groups into which the rows of one text are dealt before they are combined.
SALTS = 32


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _texts(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column], normalise: Callable[[Column], Column]) -> DataFrame:
    """id, text (normalised) and key, its digest."""
    d = docs.select(F.col(id_col).alias("id"), normalise(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    return d.withColumn("key", digest(F.col("text")))


def combine(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = sha256, normalise: Callable[[Column], Column] = lambda t: t) -> DataFrame:
    """A row per different text: key (its digest), text, keep (the largest id) and size (its rows)."""
    d = _texts(docs, id_col, text_col, digest, normalise).withColumn("salt", F.spark_partition_id() % salts)
    salted = d.groupBy("key", "salt", "text").agg(F.max("id").alias("keep"), F.count("*").alias("size"))
    return salted.repartition("key").groupBy("key", "text").agg(F.max("keep").alias("keep"), F.sum("size").alias("size"))


def _decide(rows: DataFrame, winners: DataFrame, on: list[str]) -> DataFrame:
    """rows (id, key, m, ...) with keep_id and group_size of their text; row 1 of the m rows of the id that stays is kept."""
    w = winners.select(*[F.col(c).alias(f"w_{c}") for c in on], F.col("keep").alias("keep_id"), F.col("size").alias("group_size"))
    both = rows.join(w, [F.col(c) == F.col(f"w_{c}") for c in on])
    one = both.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("m"))))
    return one.select("id", "key", "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("_n") == 1)).alias("kept"))


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = sha256, normalise: Callable[[Column], Column] = lambda t: t) -> DataFrame:
    """A row per row of docs: its id, keep_id, group_size, kept and text_key, the digest of its text.

    digest may be any function to a binary or string column: results do not depend on it.
    """
    texts = _texts(docs, id_col, text_col, digest, normalise)
    won = combine(docs, id_col, text_col, salts, digest, normalise)
    # Each key's rows lie together since the last exchange, so this needs no other. A key of more than one text keeps no decision.
    decided = scratch.write(won.groupBy("key").agg(F.count("*").alias("n"), F.max("keep").alias("keep"), F.max("size").alias("size")))
    out = _decide(texts.groupBy("id", "key").agg(F.count("*").cast("int").alias("m")), decided.where("n = 1"), ["key"])
    clashes = decided.where("n > 1").select(F.col("key").alias("clash"))
    if not clashes.isEmpty():
        in_clash = lambda d: d.join(clashes, F.col("key") == F.col("clash"), "left_semi")
        rows = in_clash(texts).groupBy("id", "key", "text").agg(F.count("*").cast("int").alias("m"))
        out = out.union(_decide(rows, in_clash(won), ["key", "text"]))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("key").alias("text_key"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, normalise: Callable[[Column], Column] = lambda t: t) -> DataFrame:
    """The rows of docs that stay, with all their columns. Rows alike in id and text are one row: which of them stays is open."""
    kept = mark_duplicates(docs, id_col, text_col, salts, normalise=normalise).where("kept").select(F.col(id_col).alias("_kept_id"), F.col("text_key").alias("_kept_key"))
    own = docs.withColumn("_own_text", normalise(F.coalesce(F.col(text_col), F.lit("")))).withColumn("_own_key", sha256(F.col("_own_text")))
    stay = own.join(kept, F.col(id_col).eqNullSafe(F.col("_kept_id")) & (F.col("_own_key") == F.col("_kept_key")), "left_semi")
    return stay.dropDuplicates([id_col, "_own_text"]).select(*[f"`{c}`" for c in docs.columns])


def op13_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mark_duplicates(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("text_key")).alias("text_sha256"))


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t
"""
