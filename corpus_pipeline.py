"""Documents through quality rules, line dedup, near-duplicate removal and packing, in this order.

Each stage takes all that the stage before it kept; all but the last return the columns of documents.

In every stage rows that repeat an id and text are treated alike, further columns are carried on (packing drops
them), and an empty table gives an empty one.  A null or empty text goes in the first stage, having too few words; a
row with a null id stays until packing, which gives it a null doc_id.  Ties go to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import line_dedup, neardup, packing, quality
from corpusmill.llm.registry import tokenizer_file
from corpusmill.llm.shared import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_good(docs)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines go; a document of which nothing is left goes whole; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs).where("NOT (n_lines > 0 AND n_removed = n_lines)")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(kind))
    return out.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (0.8 of the five-word shingles) stays: that with the smallest id."""
    kept = neardup.near_duplicates(docs, percent=80, size=5).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in the sequences."""
    pieces = packing.cut_documents(docs, tokenizer_file("byte_bpe_50k.json"))
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [("quality_rules", quality_rules), ("line_dedup", repeated_lines), ("near_dedup", near_duplicates), ("packing", pack)]

#: Similarity over all pairs and best-fit packing have no SQL form that runs on whole tables; tests/llm holds the
#: pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what one returns is written to the shared folder and reread for the next."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.keep(docs, name)
    return docs
