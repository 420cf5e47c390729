"""Hard negatives against brute force, and their edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every=100, low=30, high=90, positives=5, most=10):
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) by plain loops."""
    seen = {}
    for i, v, y in rows:
        if i is None or y is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        y = (y + 1) % 10 if i % 7 == 0 else y
        seen[(i, y, tuple(math.floor(256 * x) for x in v))] = None
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for a in seen:
        if a[0] % every:
            continue
        scored = sorted((-dot(a[2], b[2]), b[0], b[1]) for b in seen if b != a)
        for s, i, _ in [x for x in scored if x[2] == a[1]][:positives]:
            band = [(n, j) for n, j, y in scored if y != a[1] and low * -s <= 100 * -n <= high * -s][:most]
            out += [(a[0], i, r + 1, j, -s, -n) for r, (n, j) in enumerate(band)]
    return sorted(out)


def mined(spark, rows, options=negatives.Mining(), every=100, parts=4):
    d = spark.createDataFrame(rows, SCHEMA).repartition(parts).withColumns({c: F.lit("clash") for c in ("key", "id", "v", "anchor", "cluster", "angle", "least", "most", "rank")})
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(map(tuple, negatives.mine(d, "vec_id", "embedding", label, F.col("vec_id") % every == 0, options).collect()))


@pytest.mark.parametrize("kind", ["spread", "clusters", "ties"])
@pytest.mark.parametrize("options", [negatives.Mining(), negatives.Mining(sample=40, centers=5, members=3, segment=17, step=5)])
def test_equal_to_brute_force(spark, kind, options):
    r = np.random.default_rng(len(kind))
    m = r.normal(size=(900, 6))
    if kind == "clusters":
        m = m * 0.1 + r.normal(size=(6, 6))[r.integers(0, 6, 900)]
    if kind == "ties":
        m = np.where(r.random((900, 1)) < 0.4, m[:1], np.round(m))
    rows = [(i, v.tolist(), int(r.integers(0, 4))) for i, v in enumerate(m)]
    assert mined(spark, rows, options, every=25) == brute(rows, every=25) != []


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=4).tolist(), i % 3) for i in range(60)]
    rows += rows[:20]  # repeated rows
    rows += [(0, [1.0, 0.0, 0.0, 0.0], 1), (0, [0.5, 0.5], 2), (7, [], 0), (40, [0.0] * 4, 1), (None, [1.0] * 4, 1), (61, None, 1), (62, [1.0] * 4, None), (63, [nan] * 4, 1), (64, [inf, 0.0, 0.0, 0.0], 1), (65, [None, 1.0, 0.0, 0.0], 1), (20, [-1.0] * 4, 2)]
    for options in (negatives.Mining(), negatives.Mining(members=2, segment=3, step=2, sample=5)):
        assert mined(spark, rows, options, every=20) == brute(rows, every=20)
    assert mined(spark, []) == mined(spark, [(1, [1.0], 2)]) == mined(spark, [(100, [1.0], 2)]) == []
    # Large components: exact in whole numbers, and beyond the limit as the limit.
    big = [(i, (r.normal(size=3) * 3e5).tolist(), i % 2) for i in range(80)]
    assert mined(spark, big, every=10) == brute(big, every=10)
    assert all(abs(x[4]) < 2**63 for x in mined(spark, [(i, [1e300, float(i)], i % 2) for i in range(30)], every=10))


def test_walks_skip_what_bounds_rule_out(spark):
    """In clustered data pieces do not meet segments that cannot hold a result."""
    r = np.random.default_rng(2)
    at = r.integers(0, 8, 4000)
    m = np.eye(8)[at] * 3 + r.normal(size=(4000, 8)) * 0.05
    walked = []

    centers = negatives.fit_centers(m, 8)
    import pyarrow as pa

    def table(rows, **more):
        v = np.floor(m[rows] * 256).astype(np.int64)
        angle = negatives._angles(v.astype(float), np.linalg.norm(v, axis=1), centers)
        return pa.table({"key": rows, "id": rows, "label": rows % 3, "v": v.tolist(), "cluster": angle.argmin(axis=1).astype(np.int32), **more})

    own = np.flatnonzero(at == 0)[:20]
    p = negatives.Piece(table(own, least=[[negatives.LOW]] * 20, most=[[2**62]] * 20), centers, 8, 5, True, 64)
    segment = table(np.arange(4000))


    add = negatives.Best.add
    negatives.Best.add = lambda self, which, score, ids: (walked.append(len(ids)), add(self, which, score, ids))[1]
    try:
        p.walk(segment, 8, np.float64)
    finally:
        negatives.Best.add = add
    # Eight clusters of about 500: the walk ends within the members' own.
    assert 0 < len(walked) <= 10
