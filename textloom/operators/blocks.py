"""Blocks of rows that meet on executors.

A block is a run of rows packed into one row as an Arrow table, so that a join
of blocks compares many rows with many others in one step. Two tables of
blocks meet by cells: each side is dealt into groups by its rows' own keys,
and the blocks of a group of one side meet those of a group of the other in
one cell. A side is copied as often as the other has groups; nothing passes
through the driver, and no task holds more than one block of each side and
what Spark can spill.

A row's group depends on the row alone, so a task that runs again gives each
pair of rows once, whatever blocks it packs. Empty tables have no blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def unpack(block: bytes) -> pa.Table:
    return pa.ipc.open_stream(block).read_all()


def pack(rows: DataFrame, group: Column | str, size: int, describe: Callable[[pa.Table], dict] | None = None, fields: str = "") -> DataFrame:
    """A row per block: group, n (its rows), block, and what describe says of it, whose columns fields declares.

    Rows of one group that follow each other in a partition come into one block, up to size of them.
    """
    names = rows.columns
    keyed = rows.withColumn("_group", F.expr(group) if isinstance(group, str) else group)

    def emit(number: int, parts: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(parts).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as w:
            w.write_table(table)
        said = describe(table) if describe else {}
        cols = {"group": [number], "n": [table.num_rows], "block": [sink.getvalue().to_pybytes()]} | {k: [v] for k, v in said.items()}
        return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in kinds], names=kinds.names)

    def run(batches):
        held: dict[int, list[pa.Table]] = {}
        count: dict[int, int] = {}
        for b in batches:
            own = b.column(len(names)).to_numpy(zero_copy_only=False)
            order = np.argsort(own, kind="stable")
            edges = np.flatnonzero(np.diff(own[order], prepend=own[order[:1]] - 1)) if len(own) else []
            table = pa.Table.from_batches([b]).select(range(len(names)))
            for lo, hi in zip(edges, [*edges[1:], len(own)], strict=True):
                g, part = int(own[order[lo]]), table.take(pa.array(order[lo:hi]))
                while part.num_rows:
                    some = part.slice(0, size - count.get(g, 0))
                    held.setdefault(g, []).append(some)
                    count[g] = count.get(g, 0) + some.num_rows
                    part = part.slice(some.num_rows)
                    if count[g] == size:
                        yield emit(g, held.pop(g))
                        del count[g]
        for g, parts in held.items():
            yield emit(g, parts)

    declared = "group int, n int, block binary" + (f", {fields}" if fields else "")
    kinds = to_arrow_schema(StructType.fromDDL(declared))
    return keyed.mapInArrow(run, declared)


def groups_of(key: Column, n: int) -> Column:
    """The group of a row, by its key."""
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def sides(df: DataFrame) -> int:
    """Groups of either side so that there are about as many cells as shuffle partitions."""
    return max(1, math.ceil(math.sqrt(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))))


def shape(left: DataFrame, right: DataFrame) -> tuple[int, int]:
    """Groups of the two sides, about as many cells as shuffle partitions, so that the least is copied by the planner's estimate of their sizes: a small side comes whole to each part of a large one, which is then not copied at all."""
    cells = max(1, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    a, b = (max(1, int(str(d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))) for d in (left, right))
    groups = min(cells, max(1, round(math.sqrt(cells * a / b))))
    return groups, -(-cells // groups)


def meet(left: DataFrame, right: DataFrame, left_groups: int, right_groups: int, condition: Column | None = None) -> DataFrame:
    """A row per pair of blocks (that satisfy a condition on left's columns and on right's, which are named r_...).

    Pairs of one left block mostly follow each other.
    """
    own = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    # One constant a group and side, so that a pair of groups has one cell.
    a = left.withColumn("_cell", F.explode(F.sequence(F.lit(0), F.lit(right_groups - 1)))).withColumn("_cell", F.col("group") * right_groups + F.col("_cell"))
    b = own.withColumn("r__cell", F.explode(F.sequence(F.lit(0), F.lit(left_groups - 1)))).withColumn("r__cell", F.col("r__cell") * right_groups + F.col("r_group"))
    on = F.col("_cell") == F.col("r__cell")
    return a.join(b, on if condition is None else on & condition).drop("_cell", "r__cell")
