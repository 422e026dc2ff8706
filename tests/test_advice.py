"""What the review of the first round found missing, outside of llm."""

import pytest

from corpusmill.operators import links


def test_closure_leaves_nothing_out_in_silence(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(5)], "src long, dst long")
    starts = spark.createDataFrame([(0,)], "node long")
    for rounds in (None, 5):
        assert {r["node"] for r in links.closure(edges, starts, rounds=rounds).collect()} == set(range(6))
    with pytest.raises(ValueError):
        links.closure(edges, starts, rounds=4)
