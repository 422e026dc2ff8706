"""The index of postings against the plain search, and both against the formula."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import postings, search

WORDS = ["city", "river", "城市更新计划", "那个", "stone", "x1", "2024", "alpha-beta", "多云", "12.5%", "ＡＢＣ", "night", "door"]


def made(seed, n, least=0):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        body = " ".join(rng.choices(WORDS, [8, 5, 1, 3, 2, 1, 1, 1, 1, 1, 1, 1, 1], k=rng.randint(least, 12 if k % 3 else 60)))
        out.append((k, f"{'AbC'[k % 3]}/{k % 7}{chr(97 + k % 26)}.md", ("# " + rng.choice(WORDS) + "\n" if k % 4 == 0 else "") + body))
    return out


def plain(df):
    return sorted((r["query_id"], r["rank"], r["id"], r["path"], round(r["score"], 6), tuple(r["shared_terms"])) for r in df.collect())


@pytest.fixture(scope="module")
def archive(spark):
    rows = made(1, 120) + [(500, "z/null.md", None), (501, "z/empty.md", ""), (502, "Z/Same.md", "city river"), (503, "z/same.md", "city river"), (504, "z/one.md", "door"), (None, "n.md", "city")]
    return spark.createDataFrame(rows, "doc_id long, path string, text string")


@pytest.fixture(scope="module")
def index(archive, tmp_path_factory):
    return postings.build(archive, str(tmp_path_factory.mktemp("index") / "i"), path_col=F.col("path"), buckets=3)


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(k, t) for k, _, t in made(2, 25)] + [(90, None), (91, "nothing here"), (92, "city river")], "query_id long, text string")


def test_terms_are_counted_in_their_row(spark):
    rows = made(3, 60)
    found = {r["id"]: r for r in search.documents_with_terms(spark.createDataFrame(rows, "doc_id long, path string, text string"), title=F.lit("River 城市 city")).collect()}
    by_rows = spark.createDataFrame(rows, "doc_id long, path string, text string").select("doc_id", F.explode(search.term_list(F.lower("text"))).alias("t"))
    for k, _, text in rows:
        terms = {t["term"]: t["tf"] for t in found[k]["terms"]}
        assert found[k]["norm"] == pytest.approx(math.sqrt(sum((1 + math.log(n)) ** 2 for n in terms.values())))
        assert {t["term"] for t in found[k]["terms"] if t["titled"]} == {"river", "城市", "city"} & set(terms)
        assert "那个" not in terms and terms.get("city", 0) == text.split().count("city")
    ascii_only = [k for k, _, text in rows if text.isascii()]
    counts = Counter((r["doc_id"], r["t"]) for r in by_rows.collect())
    for k in ascii_only:
        assert {t["term"]: t["tf"] for t in found[k]["terms"]} == {t: n for (i, t), n in counts.items() if i == k}


@pytest.mark.parametrize("limit, first, spare", [(8, 20, 0.1), (1, 1, 0.9), (3, 1, 0.0), (50, 2, 0.5)])
def test_pruned_search_finds_the_same(archive, index, queries, limit, first, spare):
    want = search.search(archive.where("doc_id IS NOT NULL"), queries, limit, path=F.col("path"))
    got = plain(postings.search_many(index, queries, limit, first=first, spare=spare))
    assert got == plain(want) and len({q for q, *_ in got}) > 20


def test_ties_by_folded_path(index, queries):
    got = [r for r in plain(postings.search_many(index, queries, 50)) if r[0] == 92]
    at = [r[2] for r in got].index(502)
    assert got[at + 1][2] == 503 and got[at][4] == got[at + 1][4]
    for a, b in zip(got, got[1:]):
        assert a[4] > b[4] or a[4] == b[4] and a[3].lower() <= b[3].lower()


def test_excluded_documents_do_not_count(spark, archive, index, queries):
    """Each query leaves out documents of its own; the same as a search of an archive without them."""
    out = spark.createDataFrame([(k, (k * 5 + j) % 120) for k in range(25) for j in range(k % 4)] + [(92, 502), (92, 502), (92, 9999)], "query_id long, id long")
    got = plain(postings.search_many(index, queries, 5, excluded=out))
    for k in (3, 7, 92):
        left = archive.where("doc_id IS NOT NULL").join(out.where(f"query_id = {k}").select(F.col("id").alias("doc_id")), "doc_id", "left_anti")
        assert [r for r in got if r[0] == k] == plain(search.search(left, queries.where(f"query_id = {k}"), 5, path=F.col("path")))


def test_index_is_read_again(spark, index, queries):
    """It lasts: another reader of the same folder finds the same; a second writer is refused."""
    folder = index.documents.inputFiles()[0].rpartition("/documents/")[0]
    assert plain(postings.search_many(postings.read(spark, folder), queries)) == plain(postings.search_many(index, queries))
    with pytest.raises(Exception, match="(?i)exists"):
        postings.build(spark.createDataFrame([(1, "a")], "doc_id long, text string"), folder)


def test_nothing_to_search(spark, index, queries, tmp_path):
    none = postings.build(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "none"))
    assert postings.search_many(none, queries).collect() == []
    assert postings.search_many(index, queries.where("false")).collect() == []
    with pytest.raises(ValueError):
        search.search(index.documents.select(F.col("id").alias("doc_id"), F.lit("x").alias("text")), queries, 51)


def test_pairs_are_not_shuffled(spark, archive, queries, index):
    """Sums by query and document stay where the document lies, in slices of queries too, and with documents left out."""
    for most in (100_000, 40):
        kept, search.ASKED_AT_ONCE = search.ASKED_AT_ONCE, most
        try:
            each = search.contributions(archive, queries, title=None)
            assert (len(each) > 1) == (most == 40)
            plan = search.summed(each[0])._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning(query_id") == 0 and "Exchange hashpartitioning(id" in plan
            gone = spark.createDataFrame([(1, 3), (1, 4), (2, 7), (92, 502), (92, 999)], "query_id long, id long")
            for excluded in (None, gone):
                want = plain(postings.search_many(index, queries, limit=9, excluded=excluded))
                assert plain(search.search(archive, queries, limit=9, path=F.col("path"), excluded=excluded)) == want
        finally:
            search.ASKED_AT_ONCE = kept
