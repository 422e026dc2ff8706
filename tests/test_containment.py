"""The containment join against Python's own search."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.functions.text import without_space
from corpusmill.operators import containment


def texts(seed):
    rng = random.Random(seed)
    letters = "abé城 \n"
    docs = [(k, "".join(rng.choices(letters, k=rng.randint(0, 300)))) for k in range(80)]
    docs += [(100, None), (101, ""), (102, "x" * 200_000 + "needle in a haystack" + "y" * 100), (103, "x" * 50), (103, "x" * 50)]
    parts = [(k, "".join(rng.choices(letters, k=rng.choice([1, 2, 3, 7, 8, 9, 15, 16, 20])))) for k in range(60)]
    parts += [(200 + k, d[i : i + n]) for k, (_, d) in enumerate(docs[:80]) if d for i, n in [(rng.randrange(len(d)), rng.randint(1, 60))]]
    parts += [(400, "needle in a haystack"), (401, None), (402, ""), (403, "x" * 20), (404, "absent words of this kind"), (405, "b")]
    return docs, parts


@pytest.mark.parametrize("seed", [1, 2])
def test_holders(spark, seed):
    docs, parts = texts(seed)
    left = spark.createDataFrame(parts, "part_id long, part string").repartition(3)
    right = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, key int").repartition(4)
    want = {(p, i, t.index(x), t.count(x)) for p, x in parts if x for i, t in docs if t and x in t}
    assert {tuple(r) for r in containment.holders(left, right).collect()} == want and len(want) > 200
    bare = lambda x: "".join(x.split())
    want = {(p, i) for p, x in parts if x and bare(x) for i, t in docs if t and bare(x) in bare(t)}
    got = containment.holders(left, right, normal=without_space).select("part_id", "id")
    assert {tuple(r) for r in got.collect()} == want


def test_no_rows(spark):
    left, right = spark.createDataFrame([], "part_id long, part string"), spark.createDataFrame([(1, "text")], "doc_id long, text string")
    assert containment.holders(left, right).collect() == []
    assert containment.holders(right.select(F.col("doc_id").alias("part_id"), F.col("text").alias("part")), right.where("false")).collect() == []


def test_a_passage_in_very_many_texts(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the one line that all of them share; "), F.col("id").cast("string")).alias("text"))
    left = spark.createDataFrame([(1, "the one line that all of them share"), (2, "share; 2999"), (3, "share; 3000")], "part_id long, part string")
    found = containment.holders(left, docs).groupBy("part_id").count().collect()
    assert {r["part_id"]: r["count"] for r in found} == {1: 3000, 2: 1}
