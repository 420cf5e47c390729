"""An exact vector index that opens only what can hold a neighbour.

Vectors are dealt to the pivot of smallest angle and stored in blocks in the
order of pivot and angle, each with the least angle of its rows to every
pivot. Queries come in blocks as well, each with the largest angle of its rows
to their pivot. By the triangle inequality for angles a block of the index
holds nothing nearer than the cosine of the difference of the two, so a pair
whose bound falls short of what the block's queries have already is not formed.

A search has two rounds. In the first, queries meet the blocks of their own
pivot; their k-th best similarities, or those in a bounded sample that is
stored with the index where that is better, are what the second round has to
reach. Results are those of ``vectors.knn`` without an index, ties included.

Pivots are fitted on a bounded sample, ``sample`` rows of smallest hash; every
row is indexed. Rows with a null vector are left out. Zero vectors are like
none, and are never ruled out. All vectors need one length. An empty index or
no queries give an empty result. Only the named columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.operators import blocks, vectors
from textloom.sources.folders import written

#: Angles have errors of about 1e-8, cosines of them less.
SLACK = 1e-7


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


def angles(m: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The angle of each row to each center. Rows of zeros have no direction: their similarity is 0 to all, which the angle of a right angle says, and no bound may use it."""
    return np.arccos(np.clip(vectors.unit(m) @ centers.T, -1, 1))


def _placed(rows: DataFrame, id_col: str, vector_col: str, centers: np.ndarray, sample: np.ndarray | None = None, k: int = 0) -> DataFrame:
    """id, v, cell and angle; with a sample, also need: the k-th best similarity in it, or -2."""
    d = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(F.col("v").isNotNull())

    def run(batches):
        for b in batches:
            m = vectors.matrix(b.column(1))
            if len(m) and m.shape[1] != centers.shape[1]:
                raise ValueError(f"vectors of {m.shape[1]} places, the index has {centers.shape[1]}")
            m = m.reshape(len(m), centers.shape[1])
            angle = angles(m, centers)
            cell = angle.argmin(axis=1)
            cols = [b.column(0), b.column(1), pa.array(cell, pa.int32()), pa.array(angle[np.arange(len(m)), cell])]
            if sample is not None:
                near = vectors.unit(m) @ sample.T
                cols.append(pa.array(np.partition(near, len(sample) - k, axis=1)[:, len(sample) - k] - vectors.ROUNDING if len(sample) >= k else np.full(len(m), -2.0)))
            yield pa.RecordBatch.from_arrays(cols, names=["id", "v", "cell", "angle", *(["need"] if sample is not None else [])])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema)
    return d.mapInArrow(run, f"{kinds}, cell int, angle double" + (", need double" if sample is not None else ""))


def _dealt(placed: DataFrame, *more: str) -> DataFrame:
    """In the order of pivots and angles; a pivot's rows are split by angle and id, however many they are."""
    return placed.repartitionByRange("cell", "angle", "id").sortWithinPartitions("cell", "angle", "id").select("id", "v", "cell", *more)


def build(rows: DataFrame, folder: str, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = 64, sample: int = 4096, block: int = 1024) -> Pruned:
    """Writes an index of all rows to a folder."""
    spark = rows.sparkSession
    d = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(F.col("v").isNotNull())
    some = vectors.matrix(d.orderBy(F.xxhash64("id"), "id").limit(sample).select(F.col("v").cast("array<double>").alias("v")).toArrow().column("v"))
    centers = fit_centers(some, pivots)

    def describe(t: pa.Table) -> dict:
        m = vectors.matrix(t.column("v"))
        angle = angles(m, centers)
        # A row of zeros may be anybody's neighbour at similarity 0, so its block is at a right angle at most.
        return {"near": np.where((m == 0).all(axis=1)[:, None], np.minimum(angle, math.pi / 2), angle).min(axis=0).tolist()}

    packed = blocks.pack(_dealt(_placed(rows, id_col, vector_col, centers)), F.col("cell"), block, describe, "near array<double>")
    packed.withColumn("number", F.monotonically_increasing_id()).write.parquet(f"{folder}/blocks")
    of = lambda m: spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "i int, v array<double>")
    of(centers).coalesce(1).write.parquet(f"{folder}/pivots")
    of(vectors.unit(some)).coalesce(1).write.parquet(f"{folder}/sample")
    return Pruned(spark, folder)


class Pruned:
    """An index in a folder. Its pivots and its sample, both of bounded size, are read into the driver."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.blocks = spark.read.parquet(f"{folder}/blocks")
        read = lambda n: vectors.matrix(spark.read.parquet(f"{folder}/{n}").orderBy("i").select("v").toArrow().column("v"))
        self.centers, self._sample = read("pivots"), read("sample")

    def _asked(self, placed: DataFrame, groups: int, size: int) -> DataFrame:
        """Blocks of queries with theta, the largest angle to their pivot, and need, the least similarity that one of them has yet to reach."""
        centers = self.centers

        def describe(t: pa.Table) -> dict:
            m, cell = vectors.matrix(t.column("v")), t.column("cell")[0].as_py()
            # Nothing is known of the angles of a query of zeros.
            theta = math.pi if (m == 0).all(axis=1).any() else float(angles(m, centers[cell : cell + 1]).max())
            return {"cell": cell, "theta": theta, "need": min(t.column("need").to_pylist())}

        packed = blocks.pack(_dealt(placed, "need"), F.col("cell"), size, describe, "cell int, theta double, need double")
        # Written, so that each block keeps its number and with it its group.
        return written(packed.withColumn("number", F.monotonically_increasing_id())).withColumn("group", blocks.groups_of(F.col("number"), groups))

    @staticmethod
    def _bound() -> Column:
        return F.cos(F.greatest(F.lit(0.0), F.element_at("r_near", F.col("cell") + 1) - F.col("theta"))) + SLACK

    def search(self, queries: DataFrame, k: int = 3, threshold: float | None = None, id_col: str = "vec_id", vector_col: str = "embedding", skip_self: bool = False, size: int = 128, report: list | None = None) -> DataFrame:
        """query_id, match_id, rank and similarity, as vectors.knn gives them. report: a list that gets the share of all pairs of vectors that were compared."""
        if not self.centers.shape[1]:
            return vectors.knn(queries.limit(0), queries.limit(0), k, id_col=id_col, vector_col=vector_col)
        groups = blocks.sides(self.blocks)
        index = self.blocks.withColumn("group_", F.col("group")).withColumn("group", blocks.groups_of(F.col("number"), groups))
        placed = written(_placed(queries, id_col, vector_col, self.centers, self._sample, k + skip_self))
        if threshold is not None:
            placed = placed.withColumn("need", F.greatest("need", F.lit(float(threshold) - vectors.ROUNDING)))
        own = F.col("cell") == F.col("r_group_")
        kinds = f"query_id {placed.schema['id'].dataType.simpleString()}, match_id {self._id_type()}, similarity double"
        find = lambda pairs: pairs.select("block", "r_block").mapInArrow(lambda b: vectors._search(b, k, threshold, skip_self), kinds)
        first_pairs = blocks.meet(self._asked(placed, groups, size), index, groups, groups, own)
        near = written(find(first_pairs))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "match_id"))
        last = near.withColumn("rank", rank).where(F.col("rank") == k).select(F.col("query_id").alias("of"), (F.col("similarity") - vectors.ROUNDING).alias("had"))
        better = placed.join(last, F.col("id").eqNullSafe(F.col("of")), "left").withColumn("need", F.greatest("need", F.coalesce("had", F.lit(-2.0)))).drop("of", "had")
        pairs = blocks.meet(self._asked(better, groups, size), index, groups, groups, ~own & (self._bound() >= F.col("need")))
        if report is not None:
            done = first_pairs.select("n", "r_n").union(pairs.select("n", "r_n")).agg(F.sum(F.col("n").cast("double") * F.col("r_n"))).first()[0] or 0.0
            every = placed.count() * (self.blocks.agg(F.sum("n")).first()[0] or 0)
            report.append(done / every if every else 0.0)
        return vectors._ranked(near.union(find(pairs)), k, threshold)

    def _id_type(self) -> str:
        """The type of ids, as the first block has it."""
        from pyspark.sql.pandas.types import from_arrow_type

        one = self.blocks.select("block").first()
        return from_arrow_type(blocks.unpack(one.block).schema.field("id").type).simpleString() if one else "long"
