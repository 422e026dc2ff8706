"""Times in milliseconds as text, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stamp_ms(ms: Column, srt: bool = False) -> Column:
    """HH:MM:SS, cut, or with srt HH:MM:SS,mmm; nothing below 0."""
    ms = F.greatest(ms.cast("long"), F.lit(0).cast("long"))
    parts = [F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60]
    return F.format_string("%02d:%02d:%02d,%03d", *parts, ms % 1000) if srt else F.format_string("%02d:%02d:%02d", *parts)


def precise_stamp_ms(ms: Column) -> Column:
    return F.replace(stamp_ms(ms, True), F.lit(","), F.lit("."))


def precise_stamp_seconds(seconds: Column) -> Column:
    """Seconds, rounded half to even to milliseconds."""
    return precise_stamp_ms(F.bround(seconds * 1000).cast("long"))


def parse_stamp(stamp: Column) -> Column:
    """Milliseconds of [HH:]MM:SS(,|.)mmm, null where that is not what it is."""
    pattern = r"^(?:(\d+):)?([0-5]?\d):([0-5]?\d)[.,](\d{1,3})$"
    n = lambda k: F.regexp_extract(stamp, pattern, k)
    hours = F.coalesce(F.nullif(n(1), F.lit("")), F.lit("0")).try_cast("long")
    ms = F.rpad(n(4), 3, "0").try_cast("long")
    return F.when(stamp.rlike(pattern), hours * 3_600_000 + n(2).try_cast("long") * 60_000 + n(3).try_cast("long") * 1000 + ms)


def chunk_count(duration_ms: Column, target_minutes: int = 60, long_ms: int = 5_400_000) -> Column:
    """Chunks that a recording is cut into: one, two at least if it is longer than ``long_ms``, all near the target."""
    n = F.greatest(F.lit(1), F.ceil(duration_ms / (target_minutes * 60_000)))
    return F.when(duration_ms > long_ms, F.greatest(F.lit(2), n)).otherwise(n).cast("int")


def overlap_ms(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0))


def within_tolerance(a: Column, b: Column, least_ms: int, share: float) -> Column:
    """Do two durations differ by no more than the greater of a least value and a share of the first?"""
    return F.abs(a - b) <= F.greatest(F.lit(float(least_ms)), a * share)
