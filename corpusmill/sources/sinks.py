"""Writers: data first, the manifest last, and nothing that differs is overwritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_new(df: DataFrame, path: str, key: str, content: str, kind: str = "parquet") -> DataFrame:
    """Write rows that path lacks; the status of every row: created, identical (nothing to do) or conflict (left as it is).

    The status is written beside the data only after the data, so a reader that finds it finds all of them.
    """
    spark = df.sparkSession
    new = df.withColumn("_sha", F.sha2(F.col(content).cast("string"), 256))
    if exists(spark, path):
        old = spark.read.format(kind).load(path).select(F.col(key).alias("_key"), F.sha2(F.col(content).cast("string"), 256).alias("_old"))
        new = new.join(old, new[key] == F.col("_key"), "left").drop("_key")
    else:
        new = new.withColumn("_old", F.lit(None).cast("string"))
    status = F.when(F.col("_old").isNull(), "created").when(F.col("_old") == F.col("_sha"), "identical").otherwise("conflict")
    marked = new.withColumn("status", status)
    run = f"{path.rstrip('/')}_manifest"
    n = len(spark.read.parquet(run).select("run").distinct().collect()) if exists(spark, run) else 0
    receipt = marked.select(F.lit(n).alias("run"), F.col(key).cast("string").alias("key"), F.col("_sha").alias("sha256"), "status")
    staged = cut(receipt)
    marked.where("status = 'created'").select(df.columns).write.format(kind).mode("append").save(path)
    staged.write.mode("append").parquet(run)
    return staged


def jsonl(df: DataFrame) -> DataFrame:
    """value: each row as one line of JSON."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def front_matter(columns: list[str]) -> Column:
    """A block of ``key: JSON value`` lines between ``---`` lines."""
    lines = [F.concat(F.lit(f"{c}: "), F.coalesce(F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.col(c).cast("string"), r'([\\"])', r"\\$1"), "\n", r"\\n"), F.lit('"')), F.lit("null"))) for c in columns]
    return F.concat_ws("\n", F.lit("---"), *lines, F.lit("---"))


def markdown_document(title: Column, fields: dict[str, Column], body: Column) -> Column:
    """A heading, a list of the fields that are there, and the body."""
    items = [F.when(v.isNotNull(), F.concat(F.lit(f"- {k}: "), v)) for k, v in fields.items()]
    return F.concat(F.concat_ws("\n\n", F.concat(F.lit("# "), F.coalesce(title, F.lit("Untitled"))), F.nullif(F.concat_ws("\n", *items), F.lit("")), body), F.lit("\n"))


def image_candidates(images: DataFrame) -> DataFrame:
    """images (doc_id, idx, src) with status, sha256, size and name: data URLs decoded, remote ones only recorded.

    Images over 40 MiB are an error; names are image-NNN- and the first 12 digits of the hash.
    """
    data = F.regexp_extract("src", r"(?is)^data:image/(png|jpe?g|gif|webp|bmp);base64,(.*)$", 2)
    kind = F.lower(F.regexp_extract("src", r"(?i)^data:image/(png|jpe?g|gif|webp|bmp);base64,", 1))
    raw = F.when(kind != "", F.try_to_binary(F.regexp_replace(data, r"\s", ""), F.lit("base64")))
    status = (
        F.when(F.col("src").rlike(r"(?i)^(?:https?:|blob:|//)"), "remote_not_saved").when((kind != "") & raw.isNull(), "invalid_data")
        .when(F.length(raw) > 40 * 1024 * 1024, "too_large").when(kind != "", "decoded").when(F.col("src").rlike(r"(?i)^data:"), "unsupported").otherwise("local")
    )
    out = images.withColumn("_raw", raw).withColumn("status", status).withColumn("sha256", F.when(F.col("status") == "decoded", F.sha2("_raw", 256)))
    name = F.when(F.col("sha256").isNotNull(), F.concat(F.format_string("image-%03d-", "idx"), F.left("sha256", F.lit(12)), F.lit("."), F.replace(kind, F.lit("jpeg"), F.lit("jpg"))))
    return out.withColumns({"size": F.length("_raw"), "name": name}).drop("_raw")
