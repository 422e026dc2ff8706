"""Workflows as append-only event logs folded to their present state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import merge_segments

#: States.
STAGE1 = ("ready", "chunk_running", "failed_recoverable", "awaiting_continue", "ready_to_merge", "complete")
STAGE2 = ("pending", "running", "complete")


#: What each event needs of the stage before it.  A run may start again where one was interrupted.
NEEDS = {
    "run": ("ready", "failed_recoverable", "chunk_running"), "chunk_done": ("chunk_running",), "chunk_failed": ("chunk_running",),
    "approve": ("awaiting_continue",), "merge_ok": ("ready_to_merge",),
}


def fold(events: DataFrame, plans: DataFrame) -> DataFrame:
    """The state of each workflow.

    events: workflow_id, seq, event, chunk_index; plans: workflow_id, chunks, staged.  Events: run, chunk_done,
    chunk_failed, approve, merge_ok, merge_failed, compact_ok, compact_blocked, stage2_start, complete.  Events count in
    the order of seq, each seq once, and one that the stage before it does not allow changes nothing, as in the
    stream; so the log of a workflow (bounded by its chunks and failures) is folded in one pass.
    """
    log = events.groupBy("workflow_id").agg(F.sort_array(F.collect_set(F.struct("seq", "event", "chunk_index"))).alias("log"))
    s = plans.join(log, "workflow_id", "left")
    kind = "struct<stage1:string,seq:bigint,done:array<int>,attempts:bigint,current_chunk:int,merge:string,cleanup:string,stage2:string>"
    start = F.struct(
        F.lit("ready").alias("stage1"), F.lit(-1).cast("long").alias("seq"), F.array().cast("array<int>").alias("done"), F.lit(0).cast("long").alias("attempts"),
        F.lit(None).cast("int").alias("current_chunk"), F.lit("pending").alias("merge"), F.lit("pending").alias("cleanup"), F.lit("pending").alias("stage2"),
    ).cast(kind)

    def step(acc: Column, e: Column) -> Column:
        name, stage = e["event"], acc["stage1"]
        allowed = F.lit(True)
        for event, needs in NEEDS.items():
            allowed = F.when(name == event, stage.isin(*needs)).otherwise(allowed)
        later = {"merge_failed": stage == "ready_to_merge", "compact_ok": stage == "complete", "compact_blocked": stage == "complete", "stage2_start": acc["cleanup"] == "complete", "complete": acc["stage2"] == "running"}
        for event, needs in later.items():
            allowed = F.when(name == event, needs).otherwise(allowed)
        ok = allowed & (e["seq"] > acc["seq"])
        finished = ok & (name == "chunk_done")
        done = F.when(finished, F.array_sort(F.array_distinct(F.array_append(acc["done"], e["chunk_index"].cast("int"))))).otherwise(acc["done"])
        after_chunk = F.when(F.size(done) >= F.col("chunks"), "ready_to_merge").when(F.col("staged"), "awaiting_continue").otherwise("ready")
        new = F.when(name == "run", "chunk_running").when(name == "chunk_done", after_chunk).when(name == "chunk_failed", "failed_recoverable").when(name == "approve", "ready").when(name == "merge_ok", "complete").otherwise(stage)
        pick = lambda old, cases: F.when(ok, F.coalesce(*[F.when(name == k, v) for k, v in cases.items()], old)).otherwise(old)
        return F.struct(
            F.when(ok, new).otherwise(stage).alias("stage1"), F.greatest(acc["seq"], e["seq"]).alias("seq"), done.alias("done"), (acc["attempts"] + F.when(ok & (name == "run"), 1).otherwise(0)).alias("attempts"),
            F.when(ok & name.isin("run", "chunk_done", "chunk_failed"), e["chunk_index"].cast("int")).otherwise(acc["current_chunk"]).alias("current_chunk"),
            pick(acc["merge"], {"merge_ok": F.lit("complete"), "merge_failed": F.lit("failed_recoverable")}).alias("merge"),
            pick(acc["cleanup"], {"compact_ok": F.lit("complete"), "compact_blocked": F.lit("blocked_unknown_files")}).alias("cleanup"),
            pick(acc["stage2"], {"stage2_start": F.lit("running"), "complete": F.lit("complete")}).alias("stage2"),
        ).cast(kind)

    out = s.withColumn("s", F.aggregate(F.coalesce("log", F.array().cast(events_type(events))), start, step))
    revision = F.greatest(F.col("s.seq"), F.lit(0)).cast("long")
    return out.select("workflow_id", "chunks", "staged", "s.stage1", "s.merge", "s.cleanup", "s.stage2", F.size("s.done").alias("done"), F.col("s.done").alias("completed"), "s.attempts", "s.current_chunk", revision.alias("revision"))


def events_type(events: DataFrame) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    return f"array<struct<seq:{kinds['seq']},event:{kinds['event']},chunk_index:{kinds['chunk_index']}>>"


def next_action() -> Column:
    """What may be done next with a folded state."""
    return (
        F.when(F.col("stage2") == "complete", "none")
        .when(F.col("stage2") == "running", "complete")
        .when(F.col("stage1") == "awaiting_continue", "approve")
        .when(F.col("stage1").isin("ready", "failed_recoverable"), "run_chunk")
        .when(F.col("stage1") == "chunk_running", "resume_chunk")
        .when(F.col("stage1") == "ready_to_merge", "merge")
        .when(F.col("cleanup") == "blocked_unknown_files", "resolve_unknown_files")
        .when(F.col("cleanup") == "pending", "compact")
        .otherwise("start_stage2")
    )


def progress(plan: DataFrame, done: DataFrame, key: str = "workflow_id") -> DataFrame:
    """key, percent: share of the core time of finished chunks.  plan: key, idx, core range; done: key, idx."""
    flagged = plan.join(done.select(key, "idx").distinct().withColumn("_done", F.lit(True)), [key, "idx"], "left")
    length = F.col("core_end_ms") - F.col("core_start_ms")
    return flagged.groupBy(key).agg(F.round(100 * F.sum(F.when(F.col("_done"), length).otherwise(0)) / F.greatest(F.sum(length), F.lit(1)), 2).alias("percent"))


def last_errors(events: DataFrame, most: int = 5) -> DataFrame:
    """workflow_id, errors: the details of the latest failures, oldest first."""
    w = Window.partitionBy("workflow_id").orderBy(F.desc("seq"))
    bad = events.where(F.col("event").endswith("_failed")).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    return bad.groupBy("workflow_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "event"))), lambda x: x["event"]).alias("errors"))


def state_issues(states: DataFrame) -> DataFrame:
    """workflow_id, issues: invariants that a folded state breaks."""
    checks = {
        "unknown stage 1 state": ~F.col("stage1").isin(*STAGE1),
        "unknown stage 2 state": ~F.col("stage2").isin(*STAGE2),
        "more chunks done than planned": F.col("done") > F.col("chunks"),
        "merged before all chunks were done": (F.col("merge") == "complete") & (F.col("done") < F.col("chunks")),
        "stage 2 began before stage 1 ended": (F.col("stage2") != "pending") & (F.col("stage1") != "complete"),
        "no chunks planned": F.col("chunks") < 1,
        "chunks done out of order": F.size("completed") != F.coalesce(F.array_max("completed"), F.lit(0)),
        "a chunk outside the plan": F.exists("completed", lambda c: (c < 1) | (c > F.col("chunks"))),
        "a chunk counted twice": F.size(F.array_distinct("completed")) != F.size("completed"),
        "finished chunks without attempts": (F.col("attempts") < F.col("done")),
        "ready to merge with chunks to do": (F.col("stage1") == "ready_to_merge") & (F.col("done") < F.col("chunks")),
        "complete without a merge": (F.col("stage1") == "complete") & (F.col("merge") != "complete"),
        "merged but not complete": (F.col("merge") == "complete") & (F.col("stage1") != "complete"),
        "unknown merge state": ~F.col("merge").isin("pending", "failed_recoverable", "complete"),
        "unknown clean-up state": ~F.col("cleanup").isin("pending", "blocked_unknown_files", "complete"),
        "cleaned up before the merge": (F.col("cleanup") != "pending") & (F.col("merge") != "complete"),
        "stage 2 began before the clean-up": (F.col("stage2") != "pending") & (F.col("cleanup") != "complete"),
        "waiting for leave in a workflow without stages": (F.col("stage1") == "awaiting_continue") & ~F.col("staged"),
        "running without a chunk": F.col("stage1").isin("chunk_running", "failed_recoverable") & F.col("current_chunk").isNull(),
    }
    return states.select("workflow_id", F.array_compact(F.array(*[F.when(c, name) for name, c in checks.items()])).alias("issues"))


def reset_interrupted(states: DataFrame) -> DataFrame:
    """States after the process died: a running chunk is pending again, what is finished stays."""
    return states.withColumn("stage1", F.when(F.col("stage1") == "chunk_running", "ready").otherwise(F.col("stage1")))


def delete_plan(found: DataFrame, owned: DataFrame) -> DataFrame:
    """path, depth, allowed, in the order to delete in (deepest first): what cleaning up would remove.

    Nothing is deleted here; an entry that is not owned blocks the clean-up of its workflow.
    """
    mine = owned.select("path").distinct().withColumn("_mine", F.lit(True))
    out = found.join(mine, "path", "left").select("path", F.size(F.split("path", "/")).alias("depth"), F.coalesce("_mine", F.lit(False)).alias("allowed"))
    return out.orderBy(F.desc("depth"), "path")


def completion_gate(states: DataFrame, audits: DataFrame, archives: DataFrame, temporary: DataFrame) -> DataFrame:
    """workflow_id, may_complete, blocked_by: a workflow ends only with a clean audit, a verified archive and nothing of
    it left that depends on temporary files.

    audits: workflow_id, issues array; archives: workflow_id, verified; temporary: workflow_id, a row for each dependency.
    """
    left = temporary.groupBy("workflow_id").agg(F.count("*").alias("_left"))
    rows = states.select("workflow_id", "stage1", "stage2").join(audits.select("workflow_id", "issues"), "workflow_id", "left").join(archives.select("workflow_id", "verified"), "workflow_id", "left").join(left, "workflow_id", "left")
    blocks = {
        "stage 1 is not complete": F.col("stage1") != "complete", "stage 2 is not running": F.col("stage2") != "running", "no audit": F.col("issues").isNull(), "the audit has issues": F.size("issues") > 0,
        "the archive is not verified": ~F.coalesce("verified", F.lit(False)), "something depends on temporary files": F.coalesce("_left", F.lit(0)) > 0,
    }
    blocked = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for name, c in blocks.items()]))
    return rows.select("workflow_id", (F.size(blocked) == 0).alias("may_complete"), blocked.alias("blocked_by"))


def initial_states(plans: DataFrame, states: DataFrame) -> DataFrame:
    """workflow_id, chunks, source_sha256, status: what planning again gives.  A workflow that has a state keeps it if the
    source is the same (existing) and is refused if it changed; others are created."""
    old = states.select(F.col("workflow_id").alias("_w"), F.col("chunks").alias("_c"), F.col("source_sha256").alias("_s"))
    both = plans.join(old, F.col("workflow_id") == F.col("_w"), "left")
    status = F.when(F.col("_w").isNull(), "created").when(F.col("_s") == F.col("source_sha256"), "existing").otherwise("refused")
    return both.select("workflow_id", F.coalesce("_c", "chunks").alias("chunks"), F.coalesce("_s", "source_sha256").alias("source_sha256"), status.alias("status"))


def merge_parts(segments: DataFrame, parts: DataFrame, key: str = "workflow_id") -> DataFrame:
    """key, segment_count, warnings, sha256 of the merged segments; the same parts always give the same, and a workflow of
    which a part is missing gives none.

    segments: key, chunk_index, start_ms, end_ms, text, and avg_logprob if it is known; what two parts heard at their
    border is merged as in intervals.merge_segments.  parts: key, chunks planned.
    """
    n_parts = segments.groupBy(key).agg(F.countDistinct("chunk_index").alias("_n"))
    whole = n_parts.join(parts, key).where(F.col("_n") == F.col("chunks")).select(key)
    score = F.col("avg_logprob") if "avg_logprob" in segments.columns else F.lit(None).cast("double")
    rows = segments.join(whole, key, "left_semi").select(F.col(key).alias("media_id"), "start_ms", "end_ms", "text", score.alias("avg_logprob"), F.col("chunk_index").cast("int").alias("chunk_index"))
    item = F.struct("id", F.concat_ws(" ", F.col("start_ms").cast("string"), F.col("end_ms").cast("string"), "text").alias("line"))
    done = merge_segments(rows).groupBy(F.col("media_id").alias(key)).agg(F.sort_array(F.collect_list(item)).alias("_s"), F.count("warning").alias("warnings"))
    lines = F.array_join(F.transform("_s", lambda x: x["line"]), "\n")
    return done.select(key, F.size("_s").cast("long").alias("segment_count"), "warnings", F.sha2(lines, 256).alias("sha256"))


def now_iso(utc: bool = True) -> Column:
    """The present time to the second, with Z or the session's offset."""
    now = F.current_timestamp()
    return F.date_format(F.to_utc_timestamp(now, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'") if utc else F.date_format(now, "yyyy-MM-dd'T'HH:mm:ssXXX")
