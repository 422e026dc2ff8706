"""Plans of overlapping time ranges, ownership of segments, and the merge of what the ranges produced."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import chunk_count, stamp_ms
from ..functions.unicode import SequenceMatcher
from ..session import cut


def chunk_plan(media: DataFrame, overlap_ms: int = 10_000, duration: str = "duration_ms", count: str | None = None) -> DataFrame:
    """media with a row for each chunk: idx from 1, core range (balanced, rounded half to even), decode range."""
    n = F.col(count) if count else chunk_count(F.col(duration))
    d = F.col(duration)
    edge = lambda k: F.bround(k.cast("decimal(30,0)") * d.cast("decimal(30,0)") / F.col("_n").cast("decimal(30,0)"), 0).cast("long")
    rows = media.withColumn("_n", n).where("_n >= 1").withColumn("idx", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    cored = rows.withColumn("core_start_ms", edge(F.col("idx") - 1)).withColumn("core_end_ms", edge(F.col("idx")))
    return cored.withColumns({"decode_start_ms": F.greatest(F.lit(0), F.col("core_start_ms") - overlap_ms), "decode_end_ms": F.least(d, F.col("core_end_ms") + overlap_ms)}).drop("_n")


def contiguous(plan: DataFrame, key: str, start: str = "core_start_ms", end: str = "core_end_ms", total: str | None = None) -> DataFrame:
    """key, ok: do the ranges of each key follow each other from 0 (to ``total``)?"""
    w = Window.partitionBy(key).orderBy(start)
    rows = plan.withColumn("_gap", (F.col(start) != F.coalesce(F.lag(end).over(w), F.lit(0))) | (F.col(end) <= F.col(start)))
    last = [(F.max(end) == F.max(total))] if total else []
    ok = ~F.bool_or("_gap")
    for x in last:
        ok = ok & x
    return rows.groupBy(key).agg(ok.alias("ok"))


def own_segments(segments: DataFrame, plan: DataFrame, key: str, slot_ms: int = 600_000) -> DataFrame:
    """segments with the idx of the chunk in whose core their midpoint lies; the last core holds its own end.

    An as-of join: the starts of cores and the midpoints of segments are one table, and each midpoint takes the last start
    before it.  Long recordings are cut into slots of time, which go to different tasks: what a slot begins with is carried
    into it from the starts alone, of which there are as many as the plan has rows.
    """
    whole = Window.partitionBy(key)
    last = F.max("core_end_ms").over(whole) == F.col("core_end_ms")
    core = F.struct(F.col("core_start_ms").alias("start"), F.col("core_end_ms").alias("end"), "idx", last.alias("last"))
    starts = plan.where(F.col(key).isNotNull()).select(key, F.col("core_start_ms").alias("_at"), core.alias("_core"))
    mid = F.expr("(start_ms + end_ms) div 2")
    columns = segments.columns
    points = segments.withColumn("_at", mid).select(key, "_at", F.lit(None).cast(starts.schema["_core"].dataType).alias("_core"), F.struct(*columns).alias("_row"))
    both = starts.withColumn("_row", F.lit(None).cast(points.schema["_row"].dataType)).unionByName(points.select(*starts.columns, "_row"))
    both = both.withColumn("_slot", F.floor(F.col("_at") / slot_ms))
    # the last core that begins in an earlier slot; a row for each slot in which one begins
    ends = starts.withColumn("_slot", F.floor(F.col("_at") / slot_ms)).groupBy(key, "_slot").agg(F.max("_core").alias("_core"))
    used = points.select(key, F.floor(F.col("_at") / slot_ms).alias("_slot")).distinct().withColumn("_core", F.lit(None).cast(starts.schema["_core"].dataType))
    slots = ends.union(used.select(key, "_slot", "_core")).groupBy(key, "_slot").agg(F.max("_core").alias("_core"))
    carried = slots.withColumn("_carry", F.max("_core").over(Window.partitionBy(key).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1))).select(key, "_slot", "_carry")
    order = Window.partitionBy(key, "_slot").orderBy("_at", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.join(carried, [key, "_slot"]).withColumn("_own", F.coalesce(F.last("_core", ignorenulls=True).over(order), "_carry")).where("_row IS NOT NULL")
    inside = (F.col("_at") < F.col("_own.end")) | (F.col("_own.last") & (F.col("_at") == F.col("_own.end")))
    # a segment of a recording that has no plan is in no chunk
    return found.join(starts.select(key).distinct(), key, "left_semi").select("_row.*", F.when(inside, F.col("_own.idx")).alias("idx"))


SEGMENT = "media_id {}, island long, start_ms long, end_ms long, text string, avg_logprob double, chunk_index int, warning string"


def running(rows: DataFrame, key: str, slot: str, order: list, value: Column, name: str) -> DataFrame:
    """rows with ``name``: the largest value among the rows before, in the order within a slot and of the slots of a key.

    Within slots the order is that of a window; between slots only their largest values are carried, a row for each slot.
    """
    valued = rows.withColumn("_value", value)
    slots = valued.groupBy(key, slot).agg(F.max("_value").alias("_most"))
    carried = slots.withColumn("_carry", F.max("_most").over(Window.partitionBy(key).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1))).drop("_most")
    own = F.max("_value").over(Window.partitionBy(key, slot).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return valued.join(carried, [key, slot]).withColumn(name, F.greatest(own, "_carry")).drop("_value", "_carry")


def islands(segments: DataFrame, key: str = "media_id", slot_ms: int = 600_000) -> DataFrame:
    """segments with island: a number for each run of segments of a key that overlap one after the other.

    An island begins where all earlier segments have ended: the running maximum of the ends is at most the start.  Its
    number is the start of its first segment, the running maximum of such starts."""
    order = ["start_ms", "end_ms", "chunk_index"]
    rows = segments.withColumn("_slot", F.floor(F.col("start_ms") / slot_ms))
    ended = running(rows, key, "_slot", order, F.col("end_ms"), "_ended")
    first = F.when(F.coalesce(F.col("start_ms") >= F.col("_ended"), F.lit(True)), F.col("start_ms"))
    numbered = running(ended.withColumn("_first", first), key, "_slot", order, F.col("_first"), "_before")
    return numbered.withColumn("island", F.coalesce("_first", "_before")).drop("_ended", "_first", "_before")


def merge_segments(segments: DataFrame, slot_ms: int = 600_000) -> DataFrame:
    """The segments of each media_id merged over chunk borders, ids from 1.

    In the order of (start, end, chunk) each is compared with the last that was kept.  If the chunks differ and the
    times overlap: from a similarity of 0.9 on the one with the better avg_logprob stays (none counts -99, a tie keeps
    the earlier); from 0.65 on both stay with a warning.  A decision needs the one before it, but only within an
    island of segments that overlap, and only where it holds two chunks; such islands go through a fold that
    remembers one row, all others stay as they are.  Rows without a start or end take no part; equal times of one chunk are
    in the order of their texts.
    """

    def normal(text: str) -> str:
        return "".join(c for c in text if c.isalnum() or c == "_").lower()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come island by island in order; what is kept leaves when the next one is."""
        last: dict | None = None
        for batch in batches:
            kept: list[dict] = []
            for r in batch.to_dict("records"):
                if last and (last["media_id"], last["island"]) != (r["media_id"], r["island"]):
                    kept.append(last)
                    last = None
                if last and last["chunk_index"] != r["chunk_index"] and min(last["end_ms"], r["end_ms"]) > max(last["start_ms"], r["start_ms"]):
                    a, b = normal(last["text"] or ""), normal(r["text"] or "")
                    alike = SequenceMatcher(None, a, b).ratio() if a and b else 0.0
                    score = [-99.0 if pd.isna(x["avg_logprob"]) else x["avg_logprob"] for x in (last, r)]
                    if alike >= 0.9:
                        if score[1] > score[0]:
                            last = r
                        continue
                    if alike >= 0.65:
                        r["warning"] = "similar texts overlap at a chunk border"
                if last:
                    kept.append(last)
                last = r
            yield pd.DataFrame(kept, columns=list(batch.columns))
        if last:
            yield pd.DataFrame([last])

    order = ["start_ms", "end_ms", "chunk_index", "text"]
    plain = segments.where("start_ms IS NOT NULL AND end_ms IS NOT NULL").select("media_id", "start_ms", "end_ms", "text", "avg_logprob", "chunk_index")
    found = cut(islands(plain, slot_ms=slot_ms).withColumn("warning", F.lit(None).cast("string")))
    schema = SEGMENT.format(segments.schema["media_id"].dataType.simpleString())
    columns = [c.split()[0] for c in schema.split(", ")]
    sizes = found.groupBy("media_id", "island").agg(F.min("chunk_index").alias("_a"), F.max("chunk_index").alias("_b"))
    contested = sizes.where("_a <> _b").select("media_id", "island")
    alone = found.join(contested, ["media_id", "island"], "left_anti").select(columns)
    dealt = found.join(contested, ["media_id", "island"], "left_semi").repartition("media_id", "island").sortWithinPartitions("media_id", "island", *order)
    merged = cut(alone.union(dealt.select(columns).mapInPandas(fold, schema)).withColumn("_slot", F.floor(F.col("start_ms") / slot_ms)))
    # numbers from 1: those of the slots before, and the place in the slot
    before = merged.groupBy("media_id", "_slot").agg(F.count("*").alias("_n")).withColumn("_sum", F.coalesce(F.sum("_n").over(Window.partitionBy("media_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("media_id", "_slot").orderBy(*order))
    out = merged.join(before.drop("_n"), ["media_id", "_slot"]).withColumn("id", (F.col("_sum") + place).cast("int"))
    return out.select("media_id", "id", "start_ms", "end_ms", "text", "avg_logprob", "chunk_index", "warning")


def previous_tail(segments: DataFrame, key: str, chunk: str = "chunk_index", order: str = "start_ms", most: int = 8, chars: int = 240) -> DataFrame:
    """key, chunk, context: the last texts of the chunk before, at most ``most`` and ``chars`` characters.

    The newest always stays; what is still too long keeps its end, after an ellipsis.
    """
    back = Window.partitionBy(key, chunk).orderBy(F.desc(order), F.desc("text"))
    rows = segments.where(F.trim("text") != "").withColumn("_n", F.row_number().over(back)).where(F.col("_n") <= most)
    used = rows.withColumn("_sum", F.sum(F.length("text") + 1).over(back.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    used = used.where((F.col("_n") == 1) | (F.col("_sum") <= chars))
    tail = used.groupBy(key, chunk).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("_n")).alias("n"), F.col("text").alias("t")))), lambda x: x["t"]), " ").alias("_c"))
    context = F.when(F.length("_c") > chars, F.concat(F.lit("…"), F.right("_c", F.lit(chars - 1)))).otherwise(F.col("_c"))
    return tail.select(key, (F.col(chunk) + 1).alias(chunk), context.alias("context"))


def thin(stamps: Column, gap: float = 0.02) -> Column:
    """Sorted times without those within ``gap`` of the last that was kept."""
    start = F.array().cast("array<double>")
    return F.aggregate(F.sort_array(stamps), start, lambda acc, x: F.when((F.size(acc) == 0) | (x - F.element_at(acc, -1) > gap), F.array_append(acc, x)).otherwise(acc))


def srt_blocks(segments: DataFrame, key: str, order: str = "start_ms") -> DataFrame:
    """key, srt: numbered caption blocks."""
    w = Window.partitionBy(key).orderBy(order, "end_ms", "text")
    block = F.concat_ws("\n", F.col("_n").cast("string"), F.concat(stamp_ms(F.col("start_ms"), True), F.lit(" --> "), stamp_ms(F.col("end_ms"), True)), "text", F.lit(""))
    rows = segments.withColumn("_n", F.row_number().over(w)).select(key, "_n", block.alias("_b"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "_b"))), lambda x: x["_b"]), "\n").alias("srt"))
