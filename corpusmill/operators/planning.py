"""File routing, options among materials, output plans and findings that must not leave a project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import PRIVATE
from ..session import cut

#: Suffixes by kind.
VIDEO = (".mp4", ".mkv", ".mov", ".avi", ".webm", ".m4v", ".flv")
AUDIO = (".mp3", ".wav", ".m4a", ".flac", ".aac", ".ogg", ".opus")
TEXT = (".html", ".htm", ".mhtml", ".mht", ".pdf", ".docx", ".txt", ".md", ".srt", ".vtt")
LONG_MS = 5_400_000


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def material_kind(path: Column) -> Column:
    s = suffix(path)
    return F.when(s.isin(*VIDEO), "video").when(s.isin(*AUDIO), "audio").when(s.isin(*TEXT), "text").otherwise("other")


def reader_for(path: Column) -> Column:
    """Which reader takes a file, null if none does."""
    s = suffix(path)
    return (
        F.when(s.isin(".html", ".htm"), "html").when(s.isin(".mhtml", ".mht"), "mhtml").when(s.isin(".txt"), "text").when(s.isin(".md"), "markdown")
        .when(s == ".docx", "docx").when(s == ".pdf", "pdf").when(s.isin(".srt", ".vtt"), "caption")
    )


def transcript_candidate(path: Column, sample: Column) -> DataFrame | Column:
    """struct<candidate, confidence, timestamps>: could a file be a transcript?"""
    s, name = suffix(path), F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    stamped = F.coalesce(sample.rlike(r"\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?"), F.lit(False))
    named = name.rlike("transcript|subtitle|caption|字幕|转写|逐字稿|文字稿")
    high = s.isin(".srt", ".vtt") | (s.isin(".txt", ".md", ".json", ".jsonl") & named)
    possible = s.isin(".txt", ".md", ".json", ".jsonl") & stamped
    return F.struct((high | possible).alias("candidate"), F.when(high, "high").when(possible, "possible").alias("confidence"), stamped.alias("timestamps"))


def material_options(counts: DataFrame) -> DataFrame:
    """counts (project, video, audio, transcript) with what the user has to choose; nothing is chosen for them."""
    v, a, t = F.col("video"), F.col("audio"), F.col("transcript")
    media = v + a
    reasons = F.array_compact(F.array(F.when(t > 1, "multiple_transcript_candidates"), F.when(media > 1, "multiple_media_candidates"), F.when((media > 0) & (t > 0), "media_and_transcript_coexist")))
    required = v + a + t > 1
    case = F.when(~required, None).when((media > 0) & (t > 0), 5).when((v > 0) & (a > 0), 4).when(t > 1, 3).otherwise(3)
    advice = F.when(~required, None).when((media > 0) & (t > 0), "reuse_transcript_selective_verification").when((v > 0) & (a > 0), "use_existing_audio").when(t > 1, "select_one_transcript").otherwise("select_one_media")
    return counts.withColumns({"required": required, "reasons": F.when(required, reasons).otherwise(F.array().cast("array<string>")), "options": case, "recommended": advice, "selected": F.lit(None).cast("string"), "automatic": F.lit(False)})


def output_plan(tasks: DataFrame) -> DataFrame:
    """tasks (source, is_dir, output_dir, root, inside_root, confirmed) with project_dir, ingest_allowed and basis.

    Lying inside a library never means leave to write into it.
    """
    parent = F.regexp_replace("source", "/[^/]*$", "")
    allowed = F.col("confirmed") & F.col("root").isNotNull()
    basis = F.when(allowed, "explicit_task_request").when(F.col("confirmed"), "database_unavailable").otherwise("not_requested")
    return tasks.withColumns({"project_dir": F.coalesce("output_dir", F.when(F.col("is_dir"), F.col("source")).otherwise(parent)), "ingest_allowed": allowed, "basis": basis})


def inside(path: Column, root: str) -> Column:
    """Does a normalised path lie in a root, not through ``..``?"""
    r = root.rstrip("/")
    return (path == r) | (path.startswith(r + "/") & ~path.rlike(r"(?:^|/)\.\.(?:/|$)"))


def privacy_findings(files: DataFrame, path: str = "path", text: str = "text", patterns: dict[str, str] = PRIVATE) -> DataFrame:
    """path, category, line: the first place of each kind of private content; the content itself is never given.

    One pass over each text: an array of the categories found, then a row for each.
    """
    finds = []
    for name, p in patterns.items():
        at = F.regexp_instr(F.col(text), F.lit(p))
        before = F.substring(F.col(text), F.lit(1), at)
        line = (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("long")
        finds.append(F.when(F.col(text).rlike(p), F.struct(F.lit(name).alias("category"), line.alias("line"))))
    return files.select(F.col(path).alias("path"), F.explode(F.array_compact(F.array(*finds))).alias("f")).select("path", "f.category", "f.line")


def overflow(df: DataFrame, most: int, confirmed: int | None = None) -> DataFrame:
    """count, allowed: more rows than ``most`` need the exact count as confirmation."""
    n = df.agg(F.count("*").alias("count"))
    return n.withColumn("allowed", (F.col("count") <= most) | F.coalesce(F.col("count") == F.lit(confirmed), F.lit(False)))


def ranked_candidates(found: DataFrame, weights: dict[str, float]) -> DataFrame:
    """found with score (sum of the weights of its flags), best and tied (more than one has the best score)."""
    score = sum((F.when(F.col(c), w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    scored = found.withColumn("score", score)
    top = scored.groupBy("score").count().orderBy(F.desc("score")).limit(1).select(F.col("score").alias("_top"), (F.col("count") > 1).alias("tied"))
    return scored.crossJoin(F.broadcast(top)).withColumn("best", F.col("score") == F.col("_top")).drop("_top")


def material_counts(files: DataFrame, project: str = "project", path: str = "path", transcript: str = "transcript") -> DataFrame:
    """project, videos, audios, transcripts, independent_audios: an audio file beside a video of the same name is its
    sound track; where there is no video every audio file is independent.  files: project, path, transcript boolean."""
    stem = F.lower(F.regexp_replace(path, r"\.[^./]*$", ""))
    rows = files.select(F.col(project).alias("project"), material_kind(F.col(path)).alias("kind"), stem.alias("stem"), F.coalesce(F.col(transcript), F.lit(False)).alias("t"))
    by_stem = rows.groupBy("project", "stem").agg(F.count_if(F.col("kind") == "video").alias("v"), F.count_if(F.col("kind") == "audio").alias("a"), F.count_if("t").alias("t"))
    sums = by_stem.groupBy("project").agg(F.sum("v").alias("videos"), F.sum("a").alias("audios"), F.sum("t").alias("transcripts"), F.sum(F.when(F.col("v") == 0, F.col("a")).otherwise(0)).alias("independent_audios"))
    return sums


def tree_totals(files: DataFrame, root: Column, path: str = "path", size: str = "size") -> DataFrame:
    """root, files, bytes below each root."""
    return files.groupBy(root.alias("root")).agg(F.count(path).alias("files"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def nearest_root(paths: DataFrame, markers: DataFrame, path: str = "path", folder: str = "dir") -> DataFrame:
    """path, root: the nearest folder at or above a path's own that is among the markers; null if none is.

    An equi-join of each folder above a path with the markers; folders are joined once, whatever they hold.
    """
    own = F.regexp_replace(path, "/?[^/]*$", "")
    dirs = paths.select(own.alias("d")).distinct()
    steps = F.split("d", "/", -1)
    above = dirs.select("d", F.explode(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(steps, F.lit(1), k), "/").alias("up")))).alias("a"))
    near = above.select("d", "a.depth", "a.up").join(markers.select(F.col(folder).alias("up")).distinct(), "up").groupBy("d").agg(F.max_by("up", "depth").alias("root"))
    return paths.select(path, own.alias("d")).join(near, "d", "left").select(path, "root")


def missing_outputs(expected: DataFrame, registered: DataFrame, commit: Column, path: str = "path") -> DataFrame:
    """path: outputs that are expected, are not the commit record itself, and are not registered."""
    return expected.where(~commit).join(registered.select(F.col(path).alias("_p")), F.col(path) == F.col("_p"), "left_anti").select(path)


def path_order(path: Column) -> list[Column]:
    """Sort keys: the path without regard to case, then as it is."""
    return [F.lower(path), path]


def findings_gate(findings: DataFrame, files: DataFrame, allowed: list[str], path: str = "path", text: str = "text") -> DataFrame:
    """path, size, sha256, status of the files of an export: allowed ones are exported, but none of them while any has a
    finding; status is export, blocked (the gate is closed) or left_out."""
    listed = F.lit(False)
    for prefix in allowed:
        listed = listed | (F.col(path) == prefix) | F.col(path).startswith(prefix.rstrip("/") + "/")
    closed = findings.join(files.where(listed).select(F.col(path).alias("_p")), F.col("path") == F.col("_p"), "left_semi").agg((F.count("*") > 0).alias("_closed"))
    status = F.when(~listed, "left_out").when(F.col("_closed"), "blocked").otherwise("export")
    return files.crossJoin(F.broadcast(closed)).select(F.col(path).alias("path"), F.octet_length(text).cast("long").alias("size"), F.sha2(text, 256).alias("sha256"), status.alias("status"))


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their places (from 1) in a total order: dealt by ranges of it, numbered within each range, and moved on by how many
    rows the ranges before hold (a number for each range is all that is gathered)."""
    ranged = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_range": F.spark_partition_id(), "_in": F.monotonically_increasing_id()}))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"), F.min("_in").alias("_first"))
    before = sizes.withColumn("_sum", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = ranged.join(F.broadcast(before.drop("_n")), "_range").withColumn(name, F.col("_sum") + F.col("_in") - F.col("_first") + 1)
    return out.drop("_range", "_in", "_first", "_sum")


def bounded_prompt(rows: DataFrame, terms: str, context: str, budget: int, prefix: tuple = (), context_prefix: tuple = (), separator: tuple = (), least: int = 16) -> DataFrame:
    """rows (terms and context as arrays of tokens) with what of them goes into a prompt of ``budget`` tokens, and the prompt.

    ``prefix`` stands before the terms, ``context_prefix`` before the context if there is any; what they leave (``least`` at
    least) is shared: two fifths are the context's, if there is any, the rest the terms'.  Of too many terms the head and the
    tail stay with ``separator`` between them, of too long a context its end.  A prompt that is still over the budget
    keeps its end.
    """
    n_terms, n_context = F.coalesce(F.size(terms), F.lit(0)), F.greatest(F.coalesce(F.size(context), F.lit(0)), F.lit(0))
    tokens = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    content = F.when(n_context > 0, max(least, budget - len(prefix) - len(context_prefix))).otherwise(max(least, budget - len(prefix)))
    for_context = F.when(n_context > 0, F.bround(content * 0.4, 0)).otherwise(0).cast("int")
    for_terms = content - for_context
    head, tail = F.floor((for_terms + 1) / 2).cast("int"), F.floor(for_terms / 2).cast("int")
    cut = F.concat(F.slice(terms, F.lit(1), head), F.when(tail > 0, F.concat(tokens(separator), F.slice(terms, n_terms - tail + 1, tail))).otherwise(F.array().cast("array<string>")))
    last = F.slice(context, F.greatest(F.lit(1), n_context - for_context + 1), F.greatest(for_context, F.lit(0)))
    used = rows.withColumns({"terms_used": F.when(n_terms > for_terms, cut).otherwise(F.col(terms)), "context_used": F.when(n_context > for_context, last).otherwise(F.col(context))})
    none = F.array().cast("array<string>")
    whole = F.concat(tokens(prefix), F.coalesce("terms_used", none), F.when(n_context > 0, F.concat(tokens(context_prefix), F.col("context_used"))).otherwise(none))
    return used.withColumn("prompt", whole).withColumn("prompt", F.when(F.size("prompt") > budget, F.slice("prompt", F.size("prompt") - budget + 1, F.lit(budget))).otherwise(F.col("prompt")))
