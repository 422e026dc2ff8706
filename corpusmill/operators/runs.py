"""Comparable runs of one job, and small numeric rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def real_time_factor(seconds: Column, audio_seconds: Column) -> Column:
    return seconds / F.greatest(audio_seconds, F.lit(0.001))


def fit_scale(width: Column, height: Column, max_width: float, max_height: float) -> Column:
    """The scale at which a picture fits into a box without distortion."""
    return F.least(F.lit(max_width) / width, F.lit(max_height) / height)


def ratio_to_first(runs: DataFrame, key: str, order: str, text: str, low: float = 0.8, high: float = 1.25) -> DataFrame:
    """runs with length_ratio (to the first run of the key) and passes (is it within the bounds?)."""
    first = F.first(F.length(text)).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    ratio = F.round(F.length(text) / F.nullif(first, F.lit(0)), 6)
    return runs.withColumn("length_ratio", ratio).withColumn("passes", F.coalesce(F.col("length_ratio").between(low, high), F.lit(False)))


def time_range_issues(ranges: DataFrame, start: str, end: str, duration: str) -> DataFrame:
    """ranges with ``issues``: what makes a time range unusable."""
    checks = {"start is negative": F.col(start) < 0, "end is not after start": F.col(end) <= F.col(start), "end is beyond the recording": F.col(end) > F.col(duration)}
    return ranges.withColumn("issues", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in checks.items()])))


def prefer_audio(streams: DataFrame, key: str, kind: str = "kind", duration: str = "duration_ms") -> DataFrame:
    """key, duration_ms: the longest audio stream, else the longest stream."""
    return streams.groupBy(key).agg(F.coalesce(F.max(F.when(F.col(kind) == "audio", F.col(duration))), F.max(duration)).alias("duration_ms"))


def snapshots(files: DataFrame) -> DataFrame:
    """path, size, modified_at, sha256, text of binary files (path, length, modificationTime, content), with the archive's charset policy."""
    from ..functions.unicode import decode_udf

    decoded = files.withColumn("_d", decode_udf("archive")(F.col("content")))
    return decoded.select(
        "path", F.col("length").alias("size"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("modified_at"), F.sha2("content", 256).alias("sha256"), F.col("_d.text").alias("text"), F.col("_d.error").alias("error")
    )


def plan_hash(plan: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """key, sha256: a hash of the ordered rows as JSON with sorted keys."""
    one = F.struct(F.col(order).alias("_o"), F.to_json(F.struct(*sorted(columns))).alias("j"))
    rows = F.array_join(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["j"]), ",")
    return plan.groupBy(key).agg(F.sha2(F.concat(F.lit("["), rows, F.lit("]")), 256).alias("sha256"))
