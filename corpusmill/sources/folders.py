"""Folders as tables: listings to a depth, with pruned branches and an order, and reads that two listings vouch for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.planning import path_order

#: Folders that hold outputs, companions of pages or nothing to read.
PRUNED = r"\.git|__pycache__|[^/]*_files|[^/]*\.files|[^/]*_processed"
LISTING = "path string, modificationTime timestamp, length long"


def plain(path: Column) -> Column:
    """A path without its scheme."""
    return F.regexp_replace(path, r"^[a-z]+:/+", "/")


def listing(spark: SparkSession, folder: str, depth: int | None = None, pruned: str = PRUNED, suffixes: tuple[str, ...] = (), outputs: DataFrame | None = None) -> DataFrame:
    """path, name, depth (1 in the folder itself), length, modificationTime of the files under a folder.

    Spark lists in parallel and opens no file.  Branches whose folder name matches ``pruned`` are left out, as are files
    deeper than ``depth``, of other suffixes, and those of ``outputs`` (path): with the stem of a file that stands beside
    them, what was made of it (``stem.processed.md`` or ``stem_processed``).
    """
    root = folder.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(plain(F.col("path")).alias("path"), "length", "modificationTime")
    base = "/" + root.partition(":")[2].lstrip("/") if ":" in root else root
    inner = F.substring("path", len(base) + 2, 1 << 20)
    rows = files.withColumns({"_inner": inner, "depth": F.size(F.split(inner, "/")), "name": F.regexp_extract("path", "([^/]*)$", 1)})
    rows = rows.where(~F.concat(F.lit("/"), "_inner").rlike(rf"/(?:{pruned})/"))
    if depth is not None:
        rows = rows.where(F.col("depth") <= depth)
    if suffixes:
        rows = rows.where(F.lower("name").rlike("(?:" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"))
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    made = rows.select(F.concat(stem, F.lit(".processed")).alias("_made")).distinct()
    rows = rows.withColumn("_stem", stem).join(made, F.col("_stem") == F.col("_made"), "left_anti")
    if outputs is not None:
        rows = rows.join(outputs.select("path").distinct(), "path", "left_anti")
    return rows.select("path", "name", "depth", "length", "modificationTime")


def in_order(files: DataFrame) -> DataFrame:
    return files.orderBy("depth", *path_order(F.col("path")))


def vouched(read: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """read (path, content) with sha256 and error: a file is taken only if the listings before and after it was read have the
    same length and time of it, and what was read has that length."""
    told = lambda df, n: df.select(F.col("path").alias(f"p{n}"), F.col("length").alias(f"l{n}"), F.col("modificationTime").alias(f"t{n}"))
    both = read.join(told(before, 1), F.col("path") == F.col("p1"), "left").join(told(after, 2), F.col("path") == F.col("p2"), "left")
    same = (F.col("l1") == F.col("l2")) & (F.col("t1") == F.col("t2")) & (F.octet_length("content") == F.col("l1"))
    error = F.when(F.col("p2").isNull(), "the file is gone").when(~F.coalesce(same, F.lit(False)), "the file changed while it was read")
    return both.withColumn("error", error).select("path", F.when(error.isNull(), F.col("content")).alias("content"), F.when(error.isNull(), F.sha2("content", 256)).alias("sha256"), "error")


def snapshot(spark: SparkSession, folder: str, **rules) -> DataFrame:
    """path, content, sha256, error of the files of a folder, each read between two listings.

    The first listing and what was read are written before the second listing is made."""
    from ..session import cut

    before = cut(listing(spark, folder, **rules))
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(plain(F.col("path")).alias("path"), "content")
    read = cut(content.join(before.select("path"), "path", "left_semi"))
    return vouched(read, before, listing(spark, folder, **rules))
