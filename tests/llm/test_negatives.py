"""Hard negatives against all products, and what the trees leave out."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import negatives
from corpusmill.llm.negatives import Mining

SCHEMA = "vec_id long, embedding array<float>, label int, anchor string, block int, score string, v int"


def brute(rows, mining):
    good = {}
    for i, v, label, *_ in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good[i, label, tuple(math.floor(mining.scale * x) for x in np.array(v, np.float32).astype(float).tolist())] = None
    out = []
    for i, label, v in good:
        if i % 10:
            continue
        score = [(-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in good if j != i and len(w) == len(v)]
        for s, j, _ in sorted(x for x in score if x[2] == label)[: mining.positives]:
            fits = sorted(x for x in score if x[2] != label and mining.low * -s <= 100 * -x[0] <= mining.high * -s)
            out += [(i, j, k, n, -s, -t) for k, (t, n, _) in enumerate(fits[: mining.negatives], 1)]
    return sorted(out)


def vectors(seed, n=300):
    """Clusters, copies under other labels, rows repeated, ids with two vectors, other lengths, and rows that take no part."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, 8))
    rows = [(k, (centres[k % 6] + rng.standard_normal(8) * 0.3).astype(np.float32).tolist(), int(rng.integers(0, 3)), "x", 1, "s", 2) for k in range(n)]
    rows += [(1000 + k, rows[10][1], k % 3, "x", 1, "s", 2) for k in range(40)] + rows[:20]
    rows += [(20, rows[3][1], 1, "x", 1, "s", 2), (2000, [1.0, 2.0], 0, "x", 1, "s", 2), (2001, [1.0, 2.5], 0, "x", 1, "s", 2), (2003, [1.0, 2.2], 1, "x", 1, "s", 2), (2010, [], 0, "x", 1, "s", 2), (2011, [], 0, "x", 1, "s", 2), (2012, [], 1, "x", 1, "s", 2)]
    rows += [(3000, None, 1, "x", 1, "s", 2), (3010, rows[0][1], None, "x", 1, "s", 2), (None, rows[0][1], 1, "x", 1, "s", 2), (3020, [float("nan")] * 8, 1, "x", 1, "s", 2), (3030, [None] * 8, 1, "x", 1, "s", 2), (3040, [0.0] * 8, 1, "x", 1, "s", 2), (3041, [float("inf")] + [0.0] * 7, 1, "x", 1, "s", 2)]
    return rows


@pytest.mark.parametrize("mining", [Mining(), Mining(block=40), Mining(positives=3, negatives=7, low=30, high=95, block=90)])
def test_all_products(spark, mining):
    rows = vectors(mining.block)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, mining)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(rows, mining)
    assert sorted(tuple(r) for r in out.collect()) == want and len(want) > 100


def test_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert negatives.hard_negatives(none, F.col("vec_id") % 10 == 0).collect() == []


def test_large_components():
    """Products that doubles cannot hold are computed as whole numbers."""
    a, b = np.array([[2.0**30, 1.0, 3.0]]), np.array([[2.0**30, 1.0, 0.0], [2.0**30, 0.0, 1.0]])
    assert negatives.dots(a, b).tolist() == [[2**60 + 1, 2**60 + 3]]


def test_bounds_prune():
    """Far clusters are left at their root; what is found is the same as without trees."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((32, 16)) * 40
    points = np.floor(np.repeat(centres, 64, axis=0) * 20 + rng.standard_normal((2048, 16)) * 5)
    ids, labels = np.arange(2048), rng.integers(0, 2, 2048)
    tree = negatives.Search(points, ids, labels)
    who = np.arange(0, 2048, 50)
    low, high, seed = (np.full(len(who), x) for x in (negatives.NONE + 1, -negatives.NONE, negatives.NONE))
    score, found = tree.best(points[who], ids[who], labels[who], True, low, high, seed, 5)
    every = (points[who] @ points.T).astype(np.int64)
    for k, q in enumerate(who):
        fits = [i for i in range(2048) if i != q and labels[i] == labels[q]]
        want = sorted(fits, key=lambda i: (-every[k, i], i))[:5]
        assert found[k].tolist() == want and score[k].tolist() == every[k, want].tolist()
    assert tree.visited < 0.5 * len(who) * len(tree.tree.nodes)
    tree.visited = 0  # a window that no cluster reaches
    tree.best(points[who], ids[who], labels[who], False, low * 0 + 10**9, high, seed, 5)
    assert tree.visited == 0
