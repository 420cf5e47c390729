"""The pruned vector index gives what a search without an index gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import pruned, vectors


def table(spark, m, extra=()):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + list(extra), "vec_id long, embedding array<double>").repartition(3)


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("kind", ["spread", "clusters", "ties"])
def test_like_a_search_without_an_index(spark, tmp_path, kind):
    r = np.random.default_rng(7)
    m = r.normal(size=(1500, 8))
    if kind == "clusters":
        m = np.eye(8)[r.integers(0, 8, 1500)] + r.normal(size=m.shape) * 0.02
    if kind == "ties":
        m = np.where(r.random((1500, 1)) < 0.4, m[:1], np.round(m))
    m[[5, 50]] = 0
    d = table(spark, m, [(2000, None), (7, [1.0] * 8)])
    q = d.where("vec_id % 10 = 0").unionByName(spark.createDataFrame([(9000, [0.0] * 8), (9001, None)], "vec_id long, embedding array<double>"))
    index = pruned.build(d, str(tmp_path / "ix"), pivots=16, sample=400, block=50)
    for options in ({"k": 3}, {"k": 5, "skip_self": True}, {"k": 3, "threshold": 0.5, "skip_self": True}):
        share = []
        assert rows(index.search(q, **options, size=10, report=share)) == rows(vectors.knn(q, d, **options)) != []
        assert 0 < share[0] <= 1.0001
        if kind == "clusters":
            assert share[0] < 0.35
    # Read again from the folder.
    again = pruned.Pruned(spark, str(tmp_path / "ix"))
    assert rows(again.search(q.limit(3), k=2)) == rows(vectors.knn(q.limit(3), d, k=2))
    assert again.search(q.limit(0)).count() == 0


def test_empty_and_unlike(spark, tmp_path):
    d = table(spark, np.ones((40, 4)))
    empty = pruned.build(d.limit(0), str(tmp_path / "e"))
    assert empty.search(d.limit(0)).count() == 0
    index = pruned.build(d.withColumn("vec_id", F.concat(F.lit("k"), "vec_id")), str(tmp_path / "s"))
    got = index.search(d.withColumn("vec_id", F.lit("q")).limit(1), k=2)
    assert [tuple(x)[:3] for x in got.orderBy("rank").collect()] == [("q", "k0", 1), ("q", "k1", 2)]
    with pytest.raises(Exception, match="vectors of 5 places, the index has 4"):
        index.search(table(spark, np.ones((3, 5))).withColumn("vec_id", F.lit("q"))).collect()
