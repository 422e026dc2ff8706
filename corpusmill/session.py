"""A session with the settings this library expects."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "corpusmill", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; ``conf`` adds or replaces settings (dots as ``__``)."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which driver and executors share.

    Where that is unset a local session gets a folder of its own, and a cluster an error.
    """
    context = spark.sparkContext
    where = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not where:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="corpusmill-"))
        where = context.getCheckpointDir()
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut: written once as a table in the shared folder, where the loss of an executor doesn't reach it."""
    where = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def forget(*tables: DataFrame) -> None:
    """Delete tables that cut() made and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for where in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if where.rpartition("/")[2].startswith("cut-"):
                path = spark._jvm.org.apache.hadoop.fs.Path(where)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
