"""Hard negatives by anchor-clustered shared lists.

Anchors are clustered by angle, and pieces of a cluster of at most MEMBERS
anchors share the work: for a segment of the candidates the piece sorts once
by an upper bound, norm times the cosine of the candidate's angle to the
cluster's center less the largest angle of a member to it. Each member walks
down that list with exact integer scores until the bound certifies that
nothing further down can enter its result. A pair of a piece and a segment
whose best bound is below all members' needs is never formed.

Two walks: the first finds each anchor's positives. They fix the band of
scores in which its negatives lie, and the second walk finds those. Both begin
with what a bounded sample of rows certifies: the k-th best score in any
subset of the candidates is one that the result cannot fall below.

Pieces and segments meet on the executors by cells (``blocks.meet``). Centers
and the sample are bounded by parameters; every row is a candidate.

Edge cases: rows with a null id, label or vector, or with a null or non-finite
component, take no part. Rows alike in id, label and scaled vector are one
row; other rows that repeat an id are rows of their own, and an anchor is not
its own positive. Shorter vectors count as if zeros followed. Scaled
components beyond LIMIT / sqrt(places) in size count as that, so that scores
fit a long. Scores that tie go by the smaller id. An anchor without other rows
of its label, or a positive without negatives in its band, gives no rows. Only
the named columns are read, so other columns cannot clash. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import scratch
from textloom.operators import blocks

LIMIT = 2.0**31
#: Below this, sums of products are exact in double precision.
EXACT = 2.0**53
LOW, HIGH = int(np.iinfo(np.int64).min), int(np.iinfo(np.int64).max)


@dataclass(frozen=True)
class Mining:
    """positives and negatives are how many are kept; a negative's score lies between low and high hundredths of its positive's.

    The index is fitted on at most sample rows and has at most centers clusters; results do not depend on either.
    """

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    sample: int = 4096
    centers: int = 64
    members: int = 128
    segment: int = 2048
    step: int = 256


def fit_centers(m: np.ndarray, most: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means over the rows of m: unit centers, one for each 32 rows, at least one and at most most."""
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    u = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
    centers = u[np.linspace(0, len(u) - 1, max(1, min(most, len(u) // 32))).astype(int)] if len(u) else np.zeros((1, m.shape[1]))
    for _ in range(rounds):
        near = (u @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, u)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(size > 0, np.divide(sums, size, out=np.zeros_like(sums), where=size > 0), centers)
    return centers


def _matrix(column, width: int) -> np.ndarray:
    """Lists of integers as rows of so many places, with zeros where a list ends earlier."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width))
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _angles(m: np.ndarray, norm: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The angle of each row to each center; rows of zeros lie at every center, where their bound is 0 as it should be."""
    cos = np.divide(m @ centers.T, norm[:, None], out=np.ones((len(m), len(centers))), where=norm[:, None] > 0)
    return np.arccos(np.clip(cos, -1, 1))


class Best:
    """The k best (score, id) of each of n lists, with the score that a newcomer must reach."""

    def __init__(self, least: np.ndarray, k: int):
        self.k, self.least = k, least.copy()
        self.list, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, which: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        which, score, ids = (np.concatenate(x) for x in ((self.list, which), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, which))
        which, score, ids = which[order], score[order], ids[order]
        first = np.flatnonzero(np.diff(which, prepend=-1))
        rank = np.arange(len(which)) - np.repeat(first, np.diff(first, append=len(which)))
        kept = rank < self.k
        self.list, self.score, self.id = which[kept], score[kept], ids[kept]
        full = rank == self.k - 1
        self.least[which[full]] = np.maximum(self.least[which[full]], score[full])


class Piece:
    """A piece of a cluster: its members' vectors, and for each member some lists with the bounds of their scores."""

    def __init__(self, table: pa.Table, centers: np.ndarray, width: int, k: int, same: bool, step: int):
        self.m, self.step, self.same = _matrix(table.column("v"), width), step, same
        self.norm = np.linalg.norm(self.m, axis=1)
        self.center = centers[table.column("cluster")[0].as_py()][None, :]
        self.theta = _angles(self.m, self.norm, self.center).max()
        self.key, self.label, self.id = (table.column(c).to_numpy() for c in ("key", "label", "id"))
        self.least, self.most = (np.stack(table.column(c).to_pylist()).astype(np.int64) for c in ("least", "most"))
        self.best = Best(self.least.ravel(), k)

    def walk(self, table: pa.Table, width: int, exact: type) -> None:
        """Walks down the list of a segment."""
        x, ids, label = _matrix(table.column("v"), width), table.column("id").to_numpy(), table.column("label").to_numpy()
        norm = np.linalg.norm(x, axis=1)
        bound = norm * np.cos(np.maximum(0, _angles(x, norm, self.center)[:, 0] - self.theta))
        # Angles have errors of about 1e-8.
        bound = bound + 1e-7 * norm
        order = np.argsort(-bound, kind="stable")
        lists = self.least.shape[1]
        for lo in range(0, len(order), self.step):
            least = self.best.least.reshape(-1, lists)
            # The list goes down: a member whose bound falls short here is done.
            live = np.flatnonzero((np.where(self.most >= least, self.norm[:, None] * bound[order[lo]] + 0.5 >= least, False)).any(axis=1))
            if not len(live):
                return
            at = order[lo : lo + self.step]
            score = (self.m[live].astype(exact) @ x[at].T.astype(exact)).astype(np.int64)
            fits = self.label[live][:, None] == label[at][None, :]
            if self.same:
                fits &= self.key[live][:, None] != table.column("key").to_numpy()[at][None, :]
            else:
                fits = ~fits
            found = (score[:, None, :] >= least[live][:, :, None]) & (score[:, None, :] <= self.most[live][:, :, None]) & fits[:, None, :]
            i, p, j = np.nonzero(found)
            if len(i):
                self.best.add(live[i] * lists + p, score[i, j], ids[at[j]])


def prepared(rows: DataFrame, id_col: str, vector_col: str, label: Column, anchors: Column) -> DataFrame:
    """id, label, v (scaled) and anchor of the rows that take part, each once."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    top = LIMIT / F.sqrt(F.greatest(F.size(v), F.lit(1)))
    # Kept as doubles: floor would be a long, which large components overflow.
    scaled = F.transform(v, lambda x: F.greatest(-top, F.least(top, x.cast("double") * 256)))
    d = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.when(finite, F.transform(scaled, lambda x: F.floor(x))).alias("v"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    return d.where("id is not null and label is not null and v is not null").dropDuplicates(["id", "label", "v"])


def _placed(rows: DataFrame, centers: np.ndarray, width: int, seeds: Callable[[], tuple] | None, lists: tuple[str, str] | None, k: int, same: bool) -> DataFrame:
    """rows with cluster and angle (to its center); with seeds, also least and most, the bounds of the scores of its lists.

    lists names the columns of lowest and highest scores that count; least is raised to the k-th best score of a seed in between.
    """

    def run(batches):
        for b in batches:
            m = _matrix(b.column(b.schema.get_field_index("v")), width)
            angle = _angles(m, np.linalg.norm(m, axis=1), centers)
            cluster = angle.argmin(axis=1)
            cols = [*b.columns, pa.array(cluster, pa.int32()), pa.array(angle[np.arange(len(m)), cluster])]
            if seeds is not None:
                key, label, x, exact = seeds()
                own_key, own_label = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("key", "label"))
                score = (m.astype(exact) @ x.T.astype(exact)).astype(np.int64)
                fits = own_label[:, None] == label[None, :]
                fits = fits & (own_key[:, None] != key[None, :]) if same else ~fits
                least, most = ([[LOW]] * len(m), [[HIGH]] * len(m)) if lists is None else (b.column(b.schema.get_field_index(c)).to_pylist() for c in lists)
                raised = []
                for i in range(len(m)):
                    own, row = np.sort(score[i][fits[i]]), []
                    for lo, hi in zip(least[i], most[i], strict=True):
                        in_band = own[: np.searchsorted(own, hi, "right")]
                        row.append(max(lo, int(in_band[-k])) if len(in_band) >= k else lo)
                    raised.append(row)
                cols += [pa.array(raised, pa.list_(pa.int64())), pa.array(most, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, "cluster", "angle", *(["least", "most"] if seeds is not None else [])])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, cluster int, angle double" + (", least array<long>, most array<long>" if seeds is not None else ""))


def _dealt(placed: DataFrame, names: list[str]) -> DataFrame:
    """Rows in the order of clusters and angles, so that blocks hold what lies together. A cluster of any size is split, by id in the end."""
    return placed.repartitionByRange("cluster", "angle", "id").sortWithinPartitions("cluster", "angle", "id").select(*names)


def _pieces(anchors: DataFrame, centers: np.ndarray, width: int, members: int) -> DataFrame:
    def describe(t: pa.Table) -> dict:
        m = _matrix(t.column("v"), width)
        norm = np.linalg.norm(m, axis=1)
        c = t.column("cluster")[0].as_py()
        open_ = [lo for least, most in zip(t.column("least").to_pylist(), t.column("most").to_pylist(), strict=True) for lo, hi in zip(least, most, strict=True) if hi >= lo]
        return {"cluster": c, "theta": float(_angles(m, norm, centers[c][None, :]).max()), "longest": float(norm.max()), "need": float(min(open_)) if open_ else float("inf")}

    return blocks.pack(_dealt(anchors, ["key", "id", "label", "v", "cluster", "least", "most"]), F.col("cluster"), members, describe, "cluster int, theta double, longest double, need double")


def _segments(rows: DataFrame, centers: np.ndarray, width: int, size: int) -> DataFrame:
    def describe(t: pa.Table) -> dict:
        m = _matrix(t.column("v"), width)
        norm = np.linalg.norm(m, axis=1)
        return {"longest": float(norm.max()), "near": _angles(m, norm, centers).min(axis=0).tolist()}

    return blocks.pack(_dealt(rows, ["key", "id", "label", "v", "cluster"]), F.col("cluster"), size, describe, "longest double, near array<double>")


def _dealt_blocks(packed: DataFrame, groups: int) -> DataFrame:
    """Written, so that their numbers and with them their groups stay what they are."""
    return scratch.write(packed.withColumn("number", F.monotonically_increasing_id())).withColumn("group", blocks.groups_of(F.col("number"), groups))


def _walked(pieces: DataFrame, segments: DataFrame, groups: int, centers: np.ndarray, width: int, exact: type, k: int, same: bool, step: int) -> DataFrame:
    """key, list (number), score and id of the k best of each list of each member: of each run of pairs of one piece, so that they are to be ranked yet."""
    bound = F.col("longest") * F.col("r_longest") * (F.greatest(F.lit(0.0), F.cos(F.greatest(F.lit(0.0), F.element_at("r_near", F.col("cluster") + 1) - F.col("theta")))) + 2e-7)
    pairs = blocks.meet(pieces.where("need < double('infinity')"), segments, groups, groups, bound + 0.5 >= F.col("need")).select("number", "block", "r_block")

    def run(batches):
        number, piece = None, None

        def done():
            if piece is not None and len(piece.best.list):
                lists = piece.least.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(piece.key[piece.best.list // lists]), pa.array(piece.best.list % lists, pa.int32()), pa.array(piece.best.score), pa.array(piece.best.id)], names=["key", "list", "score", "found"])

        for b in batches:
            for n, own, other in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                if n != number:
                    yield from done()
                    number, piece = n, Piece(blocks.unpack(own.as_py()), centers, width, k, same, step)
                piece.walk(blocks.unpack(other.as_py()), width, exact)
        yield from done()

    found = pairs.mapInArrow(run, "key long, list int, score long, found long")
    rank = F.row_number().over(Window.partitionBy("key", "list").orderBy(F.desc("score"), "found"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mine(rows: DataFrame, id_col: str, vector_col: str, label: Column, anchors: Column, options: Mining = Mining()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row where anchors holds its best rows of the same label, and for each of these the best rows of other labels in its band."""
    spark, o = rows.sparkSession, options
    table = scratch.write(prepared(rows, id_col, vector_col, label, anchors).withColumn("key", F.monotonically_increasing_id()))
    width, largest = table.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()
    width = width or 0
    exact = np.float64 if float(largest or 0) ** 2 * width < EXACT else np.int64
    some = lambda t: t.orderBy(F.xxhash64("id"), "key").limit(o.sample).select("key", "label", "v").toArrow()
    centers = fit_centers(_matrix(some(table.where("anchor")).column("v"), width), o.centers)
    sample = some(table)
    sent = spark.sparkContext.broadcast((sample.column("key").to_numpy(), sample.column("label").to_numpy(), _matrix(sample.column("v"), width), exact))
    seeds = lambda: sent.value
    groups = blocks.sides(table)
    segments = _dealt_blocks(_segments(_placed(table.select("key", "id", "label", "v"), centers, width, None, None, 0, True), centers, width, o.segment), groups)
    starts = table.where("anchor").select("key", "id", "label", "v")
    first = _dealt_blocks(_pieces(_placed(starts, centers, width, seeds, None, o.positives, True), centers, width, o.members), groups)
    positives = scratch.write(_walked(first, segments, groups, centers, width, exact, o.positives, True, o.step).select("key", F.col("rank").alias("place"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score")))
    # The band in whole numbers: from the least n with 100 n >= low p to the largest with 100 n <= high p. div goes towards zero.
    down = lambda x: F.floor(x.cast("decimal(30,0)") / 100).cast("long")
    p = F.col("positive_score").cast("decimal(20,0)")
    bands = positives.groupBy(F.col("key").alias("of")).agg(F.array_sort(F.collect_list(F.struct("place", (-down(-p * o.low)).alias("lo"), down(p * o.high).alias("hi")))).alias("bands"))
    # Where there are fewer positives, the rest are bands that hold nothing.
    filled = lambda c, empty: F.concat(F.col(f"bands.{c}"), F.array_repeat(F.lit(empty), F.lit(o.positives) - F.size("bands"))).alias(c)
    second = starts.join(bands, F.col("key") == F.col("of")).select("key", "id", "label", "v", filled("lo", HIGH), filled("hi", LOW))
    pieces = _dealt_blocks(_pieces(_placed(second, centers, width, seeds, ("lo", "hi"), o.negatives, False), centers, width, o.members), groups)
    negatives = _walked(pieces, segments, groups, centers, width, exact, o.negatives, False, o.step).select("key", (F.col("list") + 1).alias("place"), "rank", F.col("found").alias("negative_id"), F.col("score").alias("negative_score"))
    named = positives.join(starts.select("key", F.col("id").alias("anchor_id")), "key")
    return negatives.join(named, ["key", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(e, "vec_id", "embedding", label, F.col("vec_id") % 100 == 0)


SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, o.vec_id, o.label, list_inner_product(a.v, o.v)::BIGINT AS score FROM e a JOIN e o ON a.vec_id % 100 = 0 AND a.vec_id <> o.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.own AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
