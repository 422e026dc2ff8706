"""JSON readers, transcript bundles, article pairs and the Markdown that goes with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import markdown_cell
from ..functions.times import stamp_ms
from ..operators.intervals import srt_blocks

#: Fixed value: how much of a file is read to tell what it is.
PREFIX_BYTES = 262_144


def without_bom(text: Column) -> Column:
    return F.when(text.startswith("\ufeff"), F.substring(text, F.lit(2), F.length(text))).otherwise(text)


def parse_json(rows: DataFrame, text: str, schema: str) -> DataFrame:
    """rows with ``record`` (of the schema) and ``error``: a leading byte order mark and blank lines are nothing, what is
    no JSON object has an error and no record."""
    kind = StructType.fromDDL(schema).add("_bad", "string")
    value = without_bom(F.col(text))
    parsed = F.from_json(value, kind, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    blank = F.coalesce(F.trim(value), F.lit("")) == ""
    out = rows.withColumn("_p", F.when(~blank, parsed))
    bad = F.col("_p._bad").isNotNull() | (~blank & ~value.rlike(r"^\s*\{"))
    record = F.struct(*[F.col(f"_p.{f.name}").alias(f.name) for f in kind.fields[:-1]])
    return out.withColumns({"error": F.when(bad, "not a JSON object"), "record": F.when(~blank & ~bad, record)}).drop("_p")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """path, record, error of each line that is not blank."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    return parse_json(lines.where(F.trim(without_bom(F.col("value"))) != ""), "value", schema).select("path", "record", "error")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """path, record, error of each file, which holds one object."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return parse_json(files, "value", schema).select("path", "record", "error")


def prefix(content: Column, size: int = PREFIX_BYTES) -> Column:
    """The first bytes of a binary column."""
    return F.substring(content, 1, size)


def transcript_markdown(segments: DataFrame, key: str, title: Column, metadata: list[Column]) -> DataFrame:
    """key, markdown: a heading, lines about the transcript, and each segment with its time range."""
    line = F.concat(F.lit("**["), stamp_ms(F.col("start_ms")), F.lit("–"), stamp_ms(F.col("end_ms")), F.lit("]** "), F.col("text"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("start_ms", "end_ms", line.alias("l")))), lambda x: x["l"])
    body = segments.groupBy(key).agg(F.array_join(parts, "\n\n").alias("_b"))
    head = F.concat_ws("\n", F.concat(F.lit("# "), title), F.lit(""), *metadata, F.lit(""), F.col("_b"))
    return body.select(key, F.concat(F.regexp_replace(head, r"(?U)\s+$", ""), F.lit("\n")).alias("markdown"))


def bundle(segments: DataFrame, key: str, title: Column, metadata: list[Column]) -> DataFrame:
    """key, files array<struct<name, content, size, sha256>>: a transcript as Markdown, captions, JSON and JSON lines, and
    last its manifest, whose presence says that the others are all there.

    Markdown and captions begin with a byte order mark.  segments: key, start_ms, end_ms, text.
    """
    item = F.struct("start_ms", "end_ms", "text")
    lists = segments.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("_s"))
    both = lists.join(srt_blocks(segments, key), key).join(transcript_markdown(segments, key, title, metadata), key)
    mark = F.lit("\ufeff")
    content = {
        "transcript.md": F.concat(mark, F.col("markdown")), "transcript.srt": F.concat(mark, F.col("srt")),
        "transcript.json": F.to_json(F.struct(F.col(key), F.size("_s").alias("segment_count"), F.col("_s").alias("segments"))),
        "transcript.jsonl": F.concat(F.array_join(F.transform("_s", lambda x: F.to_json(x)), "\n"), F.lit("\n")),
    }
    record = lambda name, c: F.struct(F.lit(name).alias("name"), c.alias("content"), F.octet_length(c).cast("long").alias("size"), F.sha2(c, 256).alias("sha256"))
    made = both.select(key, F.size("_s").alias("_n"), F.array(*[record(n, c) for n, c in content.items()]).alias("_f"))
    outputs = F.transform("_f", lambda x: F.struct(x["name"].alias("name"), x["size"].alias("size"), x["sha256"].alias("sha256")))
    manifest = F.to_json(F.struct(F.col(key), F.col("_n").alias("segment_count"), outputs.alias("outputs")))
    return made.select(key, F.concat("_f", F.array(record("manifest.json", manifest))).alias("files"))


def bundle_issues(bundles: DataFrame, key: str) -> DataFrame:
    """key, issues of bundles as bundle() gives them: files that are missing, changed, or too many, against the manifest."""
    kind = "segment_count int, outputs array<struct<name:string,size:long,sha256:string>>"
    named = F.col("files")
    manifest = F.get(F.filter(named, lambda x: x["name"] == "manifest.json"), F.lit(0))["content"]
    told = F.from_json(manifest, kind)
    rows = bundles.select(key, "files", told.alias("_m"))
    there = F.transform(F.filter("files", lambda x: x["name"] != "manifest.json"), lambda x: x["name"])
    want = F.transform("_m.outputs", lambda x: x["name"])
    gone, more = F.array_except(want, there), F.array_except(there, want)
    changed = F.filter("_m.outputs", lambda o: F.exists("files", lambda f: (f["name"] == o["name"]) & ((F.sha2(f["content"], 256) != o["sha256"]) | (F.octet_length(f["content"]) != o["size"]))))
    say = lambda a, text: F.transform(F.array_sort(a), lambda x: F.concat(x, F.lit(text)))
    issues = F.concat(say(gone, " is missing"), say(more, " is not registered"), say(F.transform(changed, lambda x: x["name"]), " has changed"))
    return rows.select(key, F.when(F.col("_m").isNull(), F.array(F.lit("no manifest"))).otherwise(issues).alias("issues"))


def article_pair(articles: DataFrame, key: str, title: Column, fields: dict[str, Column], body: Column) -> DataFrame:
    """key, body_markdown, metadata_json: the text, and the record that is written after it and holds its hash."""
    from .sinks import markdown_document

    text = articles.withColumn("body_markdown", markdown_document(title, fields, body))
    meta = F.to_json(F.struct(F.col(key), *[v.alias(k) for k, v in fields.items()], F.octet_length("body_markdown").alias("output_bytes"), F.sha2("body_markdown", 256).alias("output_sha256")), {"ignoreNullFields": "false"})
    return text.select(key, "body_markdown", meta.alias("metadata_json"))


def write_article_pairs(pairs: DataFrame, folder: str, key: str) -> None:
    """Bodies and the records that hold their hashes, as one publication; a folder that is there is refused."""
    from .publication import Refused, publish_pairs

    if publish_pairs(pairs, folder, key) != "created":
        raise Refused(f"{folder} is there already")


def reference_index(registry: DataFrame) -> DataFrame:
    """line: the rows of a table of references, in the order of their ids.  registry: id, title, publisher, url, files array."""
    links = F.array_join(F.transform("files", lambda p, n: F.concat(F.lit("[file "), n + 1, F.lit("](<"), p, F.lit(">)"))), "; ")
    link = F.when(F.coalesce("url", F.lit("")) == "", "not given").otherwise(F.concat(F.lit("[source](<"), F.col("url"), F.lit(">)")))
    cell = lambda c: markdown_cell(F.when(F.coalesce(F.col(c), F.lit("")) == "", "not given").otherwise(F.col(c)))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", "id", F.concat_ws(" / ", cell("title"), cell("publisher")), link, links), F.lit(" |"))
    return registry.select("id", row.alias("line"))
