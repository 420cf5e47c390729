"""Exact similarities of near-duplicate links."""

import math
from collections import Counter

from textloom.llm import neardup
from tests.llm.test_exact import WORD, lower, variants


def weighted(t):
    w = WORD.findall(lower(t))
    return {g: 1 + math.log(n) for g, n in Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))).items()} if w else {}


def probability(x, y):
    """Sum over common elements of 1 / sum over all z of max(x_z / x_i, y_z / y_i)."""
    both = set(x) & set(y)
    return sum(1 / sum(max(x.get(z, 0) / x[i], y.get(z, 0) / y[i]) for z in set(x) | set(y)) for i in both)


def test_similarities_of_links(spark):
    texts = variants(11, 40) | {7000: "one two three four five six " * 9 + "and the end of it", 7001: "one two three four five six " * 7 + "and the end of it"}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = neardup.near_duplicate_links(d, with_similarity=True).collect()
    assert {(r.a, r.b) for r in got} >= {(7000, 7001)}
    for r in got:
        x, y = weighted(texts[r.a]), weighted(texts[r.b])
        assert math.isclose(r.jaccard, len(set(x) & set(y)) / len(set(x) | set(y))) and r.jaccard >= 0.8
        assert math.isclose(r.probability, probability(x, y), rel_tol=1e-9)
    assert any(abs(r.jaccard - r.probability) > 0.01 for r in got)
    assert neardup.near_duplicate_links(d.limit(0), with_similarity=True).collect() == []
