"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight and a ramp g: over training time t from 0 to 1 its
rate is weight * (1 + g * (2t - 1)). The integral over all of training is the
weight itself, which sets the source's target of words. Up to time t a source
asks for target * (g * t^2 + (1 - g) * t) words; the inverse of that curve
gives the time at which a word, and so a document, is due. Documents of a
source come in an order set by a digest of their id and text; when the source is used
up, it starts over. The last document of a source is taken in part, so that
the words taken are the rounded target exactly.

Targets share ``share`` times all words by weight; a source stops at ``cap``
times its own words and what it leaves is shared by weight among the rest
(water filling, in closed form over the sources ordered by cap per weight).

Running sums never put a whole source into one task: documents fall into 4096
digest buckets a source; the sums of the buckets are run up first, then the
documents inside each bucket. The digest is of the id and the text, so only
rows alike in both share a place; documents without words, which take nothing,
are in no running sum.

Only DataFrame functions are used. Edge cases: a null text has size 0; a null
source is a source of its own, last in order; a source without words has
target 0; documents without words take 0. Repeated rows are documents of
their own; which of them comes first makes no difference. Only the named columns are read
by ``plan_mix``, and ``apply_mix`` works under names of its own, so other
columns cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import scratch

WORD = r"[^\x20\x09-\x0D]+"
DIGITS = 3


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _due(y: Column, g: Column) -> Column:
    """The time at which a source of ramp g has asked for the part y of its target."""
    return 2 * y / ((1 - g) + F.sqrt((1 - g) * (1 - g) + 4 * g * y))


def source_targets(sources: DataFrame, weights=(3, 1, 2), ramps=(-0.5, 0.0, 0.5), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sources (_src, _words: one row a source) with _target and _ramp. The windows run over one row a source."""
    by_name = Window.orderBy(F.asc_nulls_last("_src"))
    s = sources.withColumn("_n", F.row_number().over(by_name) - 1)
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("_n") % len(xs) + 1).cast("int"))
    s = s.withColumns({"_w": pick([float(w) for w in weights]), "_ramp": pick([float(g) for g in ramps]), "_cap": F.col("_words") * F.lit(float(cap))})
    s = s.withColumn("_full_at", F.col("_cap") / F.col("_w"))
    order = Window.orderBy("_full_at", "_n")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    s = s.withColumns({"_k": F.row_number().over(order), "_level": (F.lit(float(share)) * F.sum("_words").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(rest)})
    s = s.withColumn("_first", F.min(F.when(F.col("_level") <= F.col("_full_at"), F.col("_k"))).over(everything))
    s = s.withColumn("_lambda", F.max(F.when(F.col("_k") == F.col("_first"), F.col("_level"))).over(everything))
    return s.select("_src", "_words", "_ramp", F.when((F.col("_k") < F.col("_first")) | F.col("_first").isNull(), F.col("_cap")).otherwise(F.col("_lambda") * F.col("_w")).alias("_target"))


def _starts(sized: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """From rows with _src, _size, _slot: what stands before each bucket (_b, its slot, _offset and its source's figures), and the sources' figures (_s, _words, _target, _ramp)."""
    buckets = scratch.write(sized.groupBy("_src", "_slot").agg(F.sum("_size").alias("_sum")))
    targets = scratch.write(source_targets(buckets.groupBy("_src").agg(F.sum("_sum").alias("_words")), **how).withColumnRenamed("_src", "_s"))
    so_far = Window.partitionBy("_src").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.withColumn("_offset", F.coalesce(F.sum("_sum").over(so_far), F.lit(0))).select("_src", F.col("_slot").alias("_b"), "_offset")
    # One row for each source and bucket; a source has 4096 of them at most.
    starts = offsets.join(targets, F.col("_src").eqNullSafe(F.col("_s"))).drop("_src", "_s")
    return scratch.write(starts), targets


def _planned(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """rows of some size (with _size, _digest, _slot and whatever else they carry) with _words, _target, _ramp, _taken, _copies, _part, _before."""
    inside = Window.partitionBy("_slot").orderBy("_digest").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # One key for the join and the window, so rows are dealt once.
    r = rows.join(starts, F.col("_slot") == F.col("_b")).withColumn("_run", F.sum("_size").over(inside)).drop("_b", "_slot")
    r = r.withColumns({"_before": F.col("_offset") + F.col("_run") - F.col("_size"), "_goal": F.round("_target").cast("long")})
    r = r.withColumn("_copies", F.floor(F.col("_goal") / F.col("_words")).cast("long"))
    r = r.withColumn("_part", F.least(F.col("_size"), F.greatest(F.lit(0), F.col("_goal") - F.col("_copies") * F.col("_words") - F.col("_before"))).cast("long"))
    return r.withColumn("_taken", F.col("_copies") * F.col("_size") + F.col("_part")).drop("_offset", "_run", "_goal")


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    digest = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    slot = F.concat(F.substring(digest, 1, DIGITS), F.coalesce(F.concat(F.lit("+"), F.col(source_col).cast("string")), F.lit("-")))
    return docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_src"), words(F.col(text_col)).alias("_size"), digest.alias("_digest"), slot.alias("_slot"), *more)


def _time(copy: Column) -> Column:
    """When a copy of a document is due: at the middle of what is taken of it."""
    size = F.when(copy < F.col("_copies"), F.col("_size")).otherwise(F.col("_part"))
    return F.when(F.col("_target") > 0, _due(F.least(F.lit(1.0), (copy * F.col("_words") + F.col("_before") + size / 2) / F.col("_target")), F.col("_ramp")))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """One row per row of docs, range-sorted by the time of its first copy: id, size, source_size, target, taken,
    copies (whole ones), part (words of one more copy) and position (null if nothing is taken)."""
    sized = scratch.write(_keyed(docs, id_col, text_col, source_col))
    starts, targets = _starts(sized, **how)
    figures = ["_id", "_size", "_words", "_target", "_taken", "_copies", "_part", "_at"]
    some = _planned(sized.where("_size > 0"), starts).withColumn("_at", F.when(F.col("_taken") > 0, _time(F.lit(0)))).select(*figures)
    none = F.lit(0).cast("long")
    idle = sized.where("_size = 0").join(targets, F.col("_src").eqNullSafe(F.col("_s"))).withColumns({"_taken": none, "_copies": none, "_part": none, "_at": F.lit(None).cast("double")}).select(*figures)
    names = [id_col, "size", "source_size", "target", "taken", "copies", "part", "position"]
    return some.union(idle).toDF(*names).orderBy("position", id_col)


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of docs, each as often as it is taken, in training order. A document of which a part is taken comes once
    more if that is half of it or more; texts are not cut. Rows of texts without words are left out."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    sized = scratch.write(_keyed(docs, id_col, text_col, source_col))
    starts, _ = _starts(sized, **how)
    r = _planned(_keyed(docs, id_col, text_col, source_col, whole).where("_size > 0").drop("_id", "_src"), starts)
    times = F.col("_copies") + F.when((F.col("_part") > 0) & (2 * F.col("_part") >= F.col("_size")), 1).otherwise(0)
    r = r.where(times > 0).withColumn("_copy", F.explode(F.sequence(F.lit(0), (times - 1).cast("int"))))
    r = r.select("_row", _time(F.col("_copy")).alias("_at"), "_digest").orderBy("_at", "_digest")
    return r.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    return plan_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS dig FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS words, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM d GROUP BY source
), w AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][n % 3 + 1] AS w, [-0.5::DOUBLE, 0.0::DOUBLE, 0.5::DOUBLE][n % 3 + 1] AS g, words * 2.0::DOUBLE AS cap FROM s
), l AS (
  SELECT *, row_number() OVER (ORDER BY cap / w, n) AS k,
    (1.5::DOUBLE * sum(words) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), f AS (SELECT min(k) FILTER (WHERE level <= cap / w) AS first FROM l),
m AS (SELECT max(level) AS lam FROM l, f WHERE k = first),
t AS (SELECT l.*, CASE WHEN first IS NULL OR k < first THEN cap ELSE lam * w END AS target FROM l, f LEFT JOIN m ON TRUE),
r AS (
  SELECT d.doc_id, d.size, t.words, t.target, t.g, round(t.target)::BIGINT AS goal,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY dig, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT - d.size AS bef
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (SELECT *, CASE WHEN words > 0 THEN goal // words ELSE 0 END::BIGINT AS copies FROM r),
p AS (SELECT *, least(size, greatest(0, goal - copies * words - bef))::BIGINT AS part FROM c),
y AS (SELECT *, CASE WHEN target > 0 THEN least(1.0::DOUBLE, (bef + (CASE WHEN copies > 0 THEN size ELSE part END) / 2.0::DOUBLE) / target) END AS y FROM p)
SELECT doc_id, size, words AS source_size, target, copies * size + part AS taken, copies, part,
  CASE WHEN copies * size + part > 0 THEN 2 * y / ((1 - g) + sqrt((1 - g) * (1 - g) + 4 * g * y)) END AS position
FROM y
"""
