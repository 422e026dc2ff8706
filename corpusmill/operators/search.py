"""Ranked search over an archive by weighted term overlap.

All terms of a document lie in its row, so they are counted there: frequencies, the document's norm and which terms stand in
its title need no shuffle.  What is moved are the terms that a query shares.  operators/postings.py answers many
queries from an index that lasts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOP_TERMS, headings, term_length_weight
from ..functions.unicode import with_folded
from ..session import cut

LATIN = r"([a-z][a-z0-9._+\-]+|(?:19|20)[0-9]{2}|[0-9]+(?:\.[0-9]+)?(?:亿元|万元|万|亿|%|％|年|月|日|人|次|家|岁))"
CJK_RUN = r"([㐀-鿿]{2,})"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once for all its uses inside f."""
    return F.get(F.transform(F.array(value), f), 0)


def term_list(folded: Column) -> Column:
    """The terms of a folded text, each as often as it counts: Latin words, years and numbers with units once; a run of 2 to 8
    CJK characters twice, and each of its pairs, triples and quadruples once."""
    plain = F.regexp_extract_all(folded, F.lit(LATIN), F.lit(1))
    runs = F.regexp_extract_all(folded, F.lit(CJK_RUN), F.lit(1))
    whole = F.filter(runs, lambda r: F.length(r) <= 8)

    def grams(r: Column, n: int) -> Column:
        at = F.when(F.length(r) >= n, F.sequence(F.lit(1), F.length(r) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda k: F.substring(r, k, F.lit(n)))

    parts = F.flatten(F.transform(runs, lambda r: F.concat(grams(r, 2), grams(r, 3), grams(r, 4))))
    # a text without CJK characters, known by one look, has neither runs nor stop terms
    cjk = F.filter(F.concat(plain, whole, whole, parts), lambda t: ~t.isin(*STOP_TERMS))
    return F.when(folded.rlike(CJK_RUN), cjk).otherwise(plain)


#: Behind a term that stands in the title; no term holds it, so a marked term comes right after its plain copies.
MARK = "\x01"


def counted(terms: Column, title: Column | None = None) -> Column:
    """array of (term, tf, titled) for a list of terms: sorted, so that equal ones are neighbours.  titled: is it among
    ``title``, another list?"""
    body = terms if title is None else F.concat(terms, F.transform(F.array_distinct(title), lambda t: F.concat(t, F.lit(MARK))))

    def runs(s: Column) -> Column:
        at = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>"))

        def each(b: Column) -> Column:
            def one(i: Column, k: Column) -> Column:
                stop = F.get(b, k + 1)
                titled = F.coalesce(F.get(s, stop) == F.concat(F.get(s, i), F.lit(MARK)), F.lit(False)) if title is not None else F.lit(False)
                return F.struct(F.get(s, i).alias("term"), (F.coalesce(stop, F.size(s)) - i).cast("long").alias("tf"), titled.alias("titled"))

            found = F.transform(b, one)
            return found if title is None else F.filter(found, lambda x: ~F.endswith(x["term"], F.lit(MARK)))

        return _let(F.filter(at, lambda i: ~F.get(s, i).eqNullSafe(F.get(s, i - 1))), each)

    return F.coalesce(_let(F.sort_array(body), runs), F.array().cast("array<struct<term:string,tf:bigint,titled:boolean>>"))


def root_of_squares(terms: Column) -> Column:
    """Root of the sum of squared damped frequencies."""
    return F.sqrt(F.aggregate(terms, F.lit(0.0), lambda a, t: a + F.pow(1 + F.ln(t["tf"]), F.lit(2.0))))


def documents_with_terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", title: Column | None = None) -> DataFrame:
    """id, norm, terms array<struct<term, tf, titled>> of each document.  Null texts have no terms."""
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_t"), *([title.alias("_h")] if title is not None else []))
    folded = with_folded(plain, "_t", "_x")
    if title is None:
        terms = counted(term_list(F.col("_x")))
    else:
        folded = with_folded(folded, "_h", "_y")
        terms = counted(term_list(F.col("_x")), F.coalesce(term_list(F.col("_y")), F.array().cast("array<string>")))
    return folded.select("id", terms.alias("terms")).select("id", root_of_squares(F.col("terms")).alias("norm"), "terms")


def term_frequency(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, term, tf long: a row for each term of each row of docs."""
    return documents_with_terms(docs, id_col, text_col).select("id", F.explode("terms").alias("e")).select("id", "e.term", "e.tf")


def document_frequency(tf: DataFrame) -> DataFrame:
    """term, df: documents that hold a term."""
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def norms(tf: DataFrame) -> DataFrame:
    """id, norm: root of the sum of squared damped frequencies, over all terms of the document."""
    damped = 1 + F.ln("tf")
    return tf.groupBy("id").agg(F.sqrt(F.sum(damped * damped)).alias("norm"))


def query_terms(queries: DataFrame, id_col: str = "query_id", text_col: str = "text") -> DataFrame:
    """query_id, term, q_tf, q_norm of each query."""
    each = documents_with_terms(queries, id_col, text_col)
    return each.select(F.col("id").alias("query_id"), F.col("norm").alias("q_norm"), F.explode("terms").alias("e")).select("query_id", "e.term", F.col("e.tf").alias("q_tf"), "q_norm")


def default_title(text_col: str) -> Column:
    return F.array_join(headings(F.col(text_col)), "\n")


#: How many rows of query terms are sent to all tasks at once; more queries are answered in several passes.
ASKED_AT_ONCE = 100_000


def contributions(
    docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", title: Column | None = None, path: Column | None = None, excluded: DataFrame | None = None, pairs: int = 100_000
) -> list[DataFrame]:
    """query_id, id, path, term, value, norm (a frame for each slice of the queries): what each term that a document shares with a query adds to its score.

    queries: query_id, text.  title: the text whose terms count 2.5 times, by default the headings.  path: by default the id
    as text.  excluded: query_id, id of documents that don't count for a query, neither in numbers of documents.

    Of a document only the terms that any query asks for are moved, once and by its id; what the queries add to them stays in
    that partition, so sums by query and document need no shuffle.  ``pairs``: of queries and documents in a partition.
    """
    named = docs.withColumn("_id", F.struct(F.col(id_col).alias("id"), (path if path is not None else F.col(id_col).cast("string")).alias("path")))
    each = documents_with_terms(named, "_id", text_col, title if title is not None else default_title(text_col))
    tf = each.select("id.id", "id.path", "norm", F.explode("terms").alias("e")).select("id", "path", "norm", "e.*")
    asked = cut(query_terms(queries))
    # only terms of a query are counted over documents
    shared = cut(tf.join(asked.select("term").distinct(), "term", "left_semi"))
    rows = asked.join(shared.groupBy("term").agg(F.count("*").alias("df")), "term")
    total, n = docs.count(), F.lit(0)
    if excluded is not None:
        excluded = cut(excluded.join(docs.select(F.col(id_col).alias("id")), "id", "left_semi").select("query_id", "id").distinct())
        held = shared.join(excluded, "id").groupBy("query_id", "term").agg(F.count("*").alias("df_gone"))
        rows = rows.join(excluded.groupBy("query_id").agg(F.count("*").alias("n_gone")), "query_id", "left").join(held, ["query_id", "term"], "left")
        rows, n = rows.withColumn("df", F.col("df") - F.coalesce("df_gone", F.lit(0))), F.coalesce("n_gone", F.lit(0))
    weight = (1 + F.ln("q_tf")) * (F.ln((F.lit(total) - n + 1) / (F.col("df") + 1)) + 1) * term_length_weight(F.col("term"))
    weights = cut(rows.select("query_id", "term", weight.alias("a"), "q_norm"))
    slices = max(1, -(-weights.count() // ASKED_AT_ONCE))
    n_pairs = total * weights.select("query_id").distinct().count()
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-n_pairs // (slices * pairs)))
    own = (1 + F.ln("tf")) * F.when(F.col("titled"), 2.5).otherwise(1.0)
    placed = shared.select("id", "path", "norm", "term", own.alias("own")).repartition(parts, "id")
    if excluded is not None:
        gone = excluded.groupBy("id").agg(F.collect_list("query_id").alias("_gone"))
        placed = placed.join(gone.repartition(parts, "id"), "id", "left")

    def of_slice(k: int) -> DataFrame:
        some = weights.where(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == k) if slices > 1 else weights
        both = placed.join(F.broadcast(some), "term")
        if excluded is not None:
            both = both.where(F.col("_gone").isNull() | ~F.array_contains("_gone", F.col("query_id")))
        return both.select("query_id", "id", "path", "term", (F.col("a") * F.col("own")).alias("value"), (F.col("q_norm") * F.col("norm")).alias("norm"))

    return [of_slice(k) for k in range(slices)]


def scores(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", title: Column | None = None, shared: int = 20) -> DataFrame:
    """query_id, id, score, shared_terms for each query and each document that shares a term with it.

    shared_terms: the terms that add most, then the longer, then in order.
    """
    return reduce(DataFrame.union, [summed(x, shared) for x in contributions(docs, queries, id_col, text_col, title)])


def summed(each: DataFrame, shared: int = 20) -> DataFrame:
    best = F.sort_array(F.collect_list(F.struct((-F.round("value", 9)).alias("v"), (-F.length("term")).alias("n"), "term")))
    return each.groupBy("query_id", "id").agg(
        F.round(F.sum("value") / F.greatest(F.max("norm"), F.lit(1.0)), 6).alias("score"), F.transform(F.slice(best, 1, shared), lambda x: x["term"]).alias("shared_terms")
    )


def ranked(found: DataFrame, paths: DataFrame, limit: int) -> DataFrame:
    """found with rank: the best of each query, ties by the path's case-folded form.  paths: id, path."""
    if not 1 <= limit <= 50:
        raise ValueError("limit is from 1 to 50")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.lower("path"), "path", "id")
    placed = found.join(paths.select("id", "path"), "id").withColumn("rank", F.row_number().over(order))
    return placed.where(F.col("rank") <= limit).select("query_id", "rank", "id", "path", "score", "shared_terms")


def search(
    docs: DataFrame, queries: DataFrame, limit: int = 8, id_col: str = "doc_id", text_col: str = "text", title: Column | None = None, shared: int = 20, path: Column | None = None, excluded: DataFrame | None = None
) -> DataFrame:
    """query_id, rank, id, path, score, shared_terms: the best documents of each query without an index.

    queries: query_id and text, or text alone if there is one; documents that share no term are left out.  The limit
    (1 to 50) is the feature.  path: by default the id as text.  excluded: query_id, id of what a query leaves out.
    All pairs are scored where the document lies; only the best of each partition are moved, and only theirs are the terms named.
    """
    if not 1 <= limit <= 50:
        raise ValueError("limit is from 1 to 50")
    asked = queries if "query_id" in queries.columns else queries.withColumn("query_id", F.lit(0))
    each = contributions(docs.where(F.col(id_col).isNotNull()), asked, id_col, text_col, title, path, excluded, pairs=1_000_000)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.lower("path"), "path", "id")
    score = F.round(F.sum("value") / F.greatest(F.max("norm"), F.lit(1.0)), 6)
    found = [x.groupBy("query_id", "id", "path").agg(score.alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit) for x in each]
    top = cut(reduce(DataFrame.union, found))
    terms = reduce(DataFrame.union, [summed(x.join(top.select("query_id", "id"), ["query_id", "id"], "left_semi"), shared) for x in each])
    out = top.join(terms.drop("score"), ["query_id", "id"])
    return out.select("query_id", "rank", "id", "path", "score", "shared_terms").orderBy("query_id", "rank")


def excluding(docs: DataFrame, excluded: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs without those of another table (the query itself, excluded paths, links)."""
    return docs.join(excluded.select(key).distinct(), key, "left_anti")


def bundle_entries(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """files (path), but of each bundle only its entry: manifests (dir, entry) name it; the nearest one above counts."""
    steps = F.split(F.regexp_replace("path", "/?[^/]*$", ""), "/", -1)
    ups = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(steps, F.lit(1), k), "/").alias("dir")))
    chain = files.select("path", F.explode(ups).alias("u")).select("path", "u.depth", "u.dir").join(manifests, "dir")
    nearest = chain.groupBy("path").agg(F.max_by("entry", "depth").alias("_entry"))
    return files.join(nearest, "path", "left").where("_entry IS NULL OR _entry = path").drop("_entry")
