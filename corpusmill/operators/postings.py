"""An index of postings that lasts, and the exact best documents of many queries at once.

The index is three tables: ``documents`` (id, path, norm, terms: what a document consists of), ``postings`` (bucket, term, id,
weight, norm, tf: dealt by range over bucket and term, so a frequent term is several files and a reader skips
what it does not need) and ``terms`` (term, class, df, bound).  A document's class is half an octave of its norm; ``bound`` is the most
that the term adds, in units of the query's weight, to any document of the class.

A search prunes by these bounds (max-score): the rarest terms of a query give candidates, whose full scores give a lower
bound of its kth score.  The terms whose bounds together stay under a share of it cannot bring a document in alone, so in
each class only the other terms are added up, documents that cannot reach the bound even with all the rest are
dropped, and what is left is scored in full.  Nothing is approximated.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import term_length_weight
from ..session import cut, forget
from .search import default_title, documents_with_terms, query_terms, ranked, summed

#: Scores are compared after rounding to six places.
SLACK = 1e-6


@dataclass(frozen=True)
class Index:
    documents: DataFrame
    postings: DataFrame
    terms: DataFrame

    @property
    def total(self) -> int:
        return self.documents.count()


def norm_class(norm: Column) -> Column:
    return F.floor(2 * F.log2(F.greatest(norm, F.lit(1.0)))).cast("int")


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out anew where it has fewer partitions than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def build(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", path_col: Column | None = None, title: Column | None = None, buckets: int = 16, mode: str = "errorifexists") -> Index:
    """Write the index of docs under ``path`` and open it.  Rows with a null id take no part; ids are unique.

    title: the text whose terms count 2.5 times, by default the headings.  path_col: by default the id as text.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(id_col).isNotNull())
    named = rows.withColumn("_path", path_col if path_col is not None else F.col(id_col).cast("string"))
    each = documents_with_terms(spread(named).withColumn("_id", F.struct(F.col(id_col).alias("id"), F.col("_path").alias("path"))), "_id", text_col, title if title is not None else default_title(text_col))
    each.select("id.id", "id.path", "norm", "terms").write.mode(mode).parquet(f"{path}/documents")
    documents = spark.read.parquet(f"{path}/documents")
    weight = (1 + F.ln("e.tf")) * F.when(F.col("e.titled"), 2.5).otherwise(1.0) * term_length_weight(F.col("e.term"))
    postings = documents.select("id", "norm", F.explode("terms").alias("e")).select(bucket_of(F.col("e.term"), buckets).alias("bucket"), "e.term", "id", weight.alias("weight"), "norm", "e.tf")
    dealt = postings.repartitionByRange("bucket", "term", "id").sortWithinPartitions("bucket", "term", "id")
    dealt.write.mode(mode).partitionBy("bucket").parquet(f"{path}/postings")
    bounds = postings_in(path, documents).groupBy("term", norm_class(F.col("norm")).alias("class")).agg(F.count("*").alias("df"), F.max(F.col("weight") / F.col("norm")).alias("bound"))
    bounds.withColumn("bucket", bucket_of(F.col("term"), buckets)).write.mode(mode).parquet(f"{path}/terms")
    return read(spark, path)


def postings_in(path: str, documents: DataFrame) -> DataFrame:
    """By name and type, since an index of nothing has no files here."""
    kind = documents.schema["id"].dataType.simpleString()
    return documents.sparkSession.read.schema(f"term string, id {kind}, weight double, norm double, tf long, bucket int").parquet(f"{path}/postings")


def read(spark: SparkSession, path: str) -> Index:
    documents = spark.read.parquet(f"{path}/documents")
    return Index(documents, postings_in(path, documents), spark.read.parquet(f"{path}/terms"))


def asked_terms(index: Index, queries: DataFrame, excluded: DataFrame | None) -> DataFrame:
    """query_id, bucket, term, class, a (the query's weight of the term), q_norm, df, bound: a row for each class.

    Documents that a query excludes don't count, neither in its number of documents nor in its document frequencies.
    """
    asked = cut(query_terms(queries))
    total = index.total
    by_class = index.terms.join(asked.select("term").distinct(), "term", "left_semi")
    df = by_class.groupBy("term").agg(F.sum("df").alias("df"))
    rows = asked.join(df, "term")
    if excluded is None:
        n = F.lit(total)
    else:
        gone = excluded.join(index.documents.select("id"), "id", "left_semi")
        n_gone = gone.groupBy("query_id").agg(F.count("*").alias("n_gone"))
        held = index.postings.join(gone, "id").join(asked.select("query_id", "term"), ["query_id", "term"], "left_semi").groupBy("query_id", "term").agg(F.count("*").alias("df_gone"))
        rows = rows.join(n_gone, "query_id", "left").join(held, ["query_id", "term"], "left").withColumn("df", F.col("df") - F.coalesce("df_gone", F.lit(0)))
        n = F.lit(total) - F.coalesce("n_gone", F.lit(0))
    weighed = rows.withColumn("a", (1 + F.ln("q_tf")) * (F.ln((n + 1) / (F.col("df") + 1)) + 1))
    return weighed.select("query_id", "term", "a", "q_norm", "df").join(by_class.select("bucket", "term", "class", "bound"), "term")


def search_many(index: Index, queries: DataFrame, limit: int = 8, excluded: DataFrame | None = None, shared: int = 20, first: int = 20, spare: float = 0.1) -> DataFrame:
    """query_id, rank, id, path, score, shared_terms: the best documents of each query, ties by case-folded path.

    queries: query_id, text.  excluded: query_id, id.  ``first``: the rarest terms of a query are taken until they stand
    in this many times ``limit`` documents; ``spare``: the share of the kth score that terms may add up to which are left out
    at first.  Both change the work, not the result.
    """
    if excluded is not None:
        excluded = cut(excluded.select("query_id", "id").distinct())
    named = cut(asked_terms(index, queries, excluded))
    # what is asked for is read once; from here on terms are numbers
    wanted = cut(named.select("bucket", "term").distinct().withColumn("tid", F.monotonically_increasing_id()))
    asked = cut(named.join(wanted.select("term", "tid"), "term").drop("bucket", "term"))
    whole = asked.select("query_id", "tid", "a", "q_norm", "df").distinct()
    postings = cut(index.postings.join(wanted, ["bucket", "term"]).select("tid", "id", "weight", "norm"))

    def without_excluded(pairs: DataFrame) -> DataFrame:
        return pairs if excluded is None else pairs.join(excluded, ["query_id", "id"], "left_anti")

    score = F.sum(F.col("a") * F.col("weight")) / F.greatest(F.first("q_norm") * F.first("norm"), F.lit(1.0))
    by_df = Window.partitionBy("query_id").orderBy("df", "tid").rowsBetween(Window.unboundedPreceding, -1)
    rare = whole.withColumn("before", F.coalesce(F.sum("df").over(by_df), F.lit(0))).where(F.col("before") < first * limit).drop("before", "df")
    some = without_excluded(postings.join(rare, "tid").groupBy("query_id", "id").agg(score.alias("s")))
    best = Window.partitionBy("query_id").orderBy(F.desc("s"), "id")
    some = cut(some.withColumn("k", F.row_number().over(best)).where(F.col("k") <= 2 * limit).select("query_id", "id"))

    def full(pairs: DataFrame) -> DataFrame:
        """query_id, id, tid, value, norm of each term that these pairs share."""
        sought = pairs.join(whole, "query_id").select("query_id", "id", "tid", "a", "q_norm")
        return postings.join(sought, ["tid", "id"]).select("query_id", "id", "tid", (F.col("a") * F.col("weight")).alias("value"), (F.col("q_norm") * F.col("norm")).alias("norm"))

    sums = full(some).groupBy("query_id", "id").agg((F.sum("value") / F.greatest(F.first("norm"), F.lit(1.0))).alias("s"))
    kth = cut(sums.withColumn("k", F.row_number().over(best)).where(F.col("k") == limit).select("query_id", F.col("s").alias("least")))
    # of each class, the terms with the smallest bounds that stay under the kth score together
    small = Window.partitionBy("query_id", "class").orderBy("u", "tid").rowsBetween(Window.unboundedPreceding, 0)
    bounded = asked.withColumn("u", F.col("a") * F.col("bound") / F.col("q_norm")).join(kth, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0)) - SLACK)
    bounded = bounded.withColumn("together", F.sum("u").over(small)).withColumn("needed", F.col("together") >= spare * F.col("least"))
    rest = Window.partitionBy("query_id", "class")
    bounded = bounded.withColumn("rest", F.coalesce(F.sum(F.when(~F.col("needed"), F.col("u"))).over(rest), F.lit(0.0)))
    needed = cut(bounded.where("needed").select("query_id", "tid", "class", "a", "q_norm", "rest", "least"))
    part = postings.withColumn("class", norm_class(F.col("norm"))).join(needed, ["tid", "class"])
    reach = part.groupBy("query_id", "id").agg(score.alias("s"), F.first("rest").alias("rest"), F.first("least").alias("least")).where("s + rest >= least")
    chosen = cut(without_excluded(reach.select("query_id", "id")))
    total = F.round(F.sum("value") / F.greatest(F.first("norm"), F.lit(1.0)), 6)
    sums = full(chosen).groupBy("query_id", "id").agg(total.alias("score")).withColumn("shared_terms", F.array().cast("array<string>"))
    top = cut(ranked(sums, index.documents, limit))
    terms = summed(full(top.select("query_id", "id")).join(wanted.select("tid", "term"), "tid"), shared).drop("score")
    out = cut(top.drop("shared_terms").join(terms, ["query_id", "id"]).select("query_id", "rank", "id", "path", "score", "shared_terms"))
    forget(named, wanted, asked, postings, some, kth, needed, chosen, top)
    return out
