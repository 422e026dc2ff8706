"""Discovery of documents as a stream: what comes into a folder is read once, whatever happens to the process.

Spark's checkpoint remembers which files a batch held; a batch that is run again gives the same rows, and the sink takes
a row only if it has none of that path and hash.  So a restart after a failure repeats nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import cut, forget
from ..sources.documents import extract_files
from ..sources.folders import PRUNED, plain
from ..sources.sinks import exists

FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, most: int = 1000) -> DataFrame:
    """A stream of the files that come into a folder: path, length, content; pruned branches are left out."""
    stream = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", most).load(folder)
    return stream.where(~F.col("path").rlike(rf"/(?:{PRUNED})/")).select(plain(F.col("path")).alias("path"), "length", "content")


def take(batch: DataFrame, target: str) -> int:
    """Append the records of a batch of files that the target lacks; how many those were.

    Rows: path, sha256 (of the content), format, the fields of the record, error.  A file that came again unchanged is there
    already; a changed one is a row of its own.  The rows of a batch are committed together.
    """
    spark = batch.sparkSession
    files = batch.dropDuplicates(["path"]).withColumn("_sha", F.sha2("content", 256))
    if exists(spark, target):
        old = spark.read.parquet(target).select(F.col("path").alias("_p"), F.col("sha256").alias("_h"))
        files = files.join(old, (F.col("path") == F.col("_p")) & (F.col("_sha") == F.col("_h")), "left_anti")
    hashed = cut(files.select("path", "content", "_sha"))
    records = extract_files(hashed).join(hashed.select("path", F.col("_sha").alias("sha256")), "path")
    n = hashed.count()
    if n:
        records.write.mode("append").parquet(target)
    forget(hashed)
    return n


def discover(spark: SparkSession, folder: str, target: str, checkpoint: str, most: int = 1000, sink=take) -> StreamingQuery:
    """Read all that has come into the folder since the last time into the table ``target``, and stop."""
    stream = arriving(spark, folder, most).writeStream.option("checkpointLocation", checkpoint)
    return stream.foreachBatch(lambda batch, _: sink(batch, target) and None).trigger(availableNow=True).start()
