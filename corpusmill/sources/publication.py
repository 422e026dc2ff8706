"""Publication of several tables as one, states with revisions, and clean-ups that are checked before anything goes.

What is published is staged beside its target, read back, checked against the hashes of what was to be written and by the
caller's own join, and put in place by one rename.  A run that fails takes its staging with it; a run that is killed
leaves a staging folder, which no reader takes for a publication and sweep() removes.  So a target has all parts or
none.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.links import closure, link_spans, resolve
from ..session import cut, forget
from .records import bundle_issues
from .sinks import exists

MANIFEST = "_published"


class Refused(Exception):
    """Nothing was changed; the message says why."""


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, old: str, new: str) -> bool:
    """Move a folder to a place where there is none yet; False if there is one."""
    fs, p = _at(spark, old)
    _, q = _at(spark, new)
    if fs.exists(q):
        return False
    fs.mkdirs(q.getParent())
    return fs.rename(p, q)


def row_sha(columns: list[str]) -> Column:
    """A hash of all values of a row; a null differs from any text."""
    one = lambda c: F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.length(F.to_json(F.struct(c))), F.lit(":"), F.to_json(F.struct(c))))
    return F.sha2(F.concat(*[one(c) for c in columns]), 256)


def _digest(marked: DataFrame) -> tuple[int, str]:
    """Rows, and a sum of their hashes that no order changes."""
    r = marked.agg(F.count("*").alias("n"), F.sum(F.conv(F.left("_sha", F.lit(15)), 16, 10).cast("decimal(38,0)")).alias("s")).first()
    return r["n"], str(r["s"] or 0)


def _told(spark: SparkSession, target: str) -> dict[str, tuple[int, str]]:
    if not exists(spark, f"{target}/{MANIFEST}"):
        raise Refused(f"{target} is no publication")
    return {r["part"]: (r["rows"], r["digest"]) for r in spark.read.parquet(f"{target}/{MANIFEST}").collect()}


def publish(target: str, parts: dict[str, DataFrame], check: Callable[[dict[str, DataFrame]], DataFrame] | None = None) -> str:
    """Write the parts under ``target`` as one: "created", or "identical" if that is what is there.

    check: gets the parts as they were read back and returns the rows that speak against them; any row refuses them.  A
    target that holds something else is refused and left as it is.
    """
    spark = next(iter(parts.values())).sparkSession
    target = target.rstrip("/")
    marked = {name: df.withColumn("_sha", row_sha(df.columns)) for name, df in parts.items()}
    if exists(spark, target):
        told = _told(spark, target)
        if told == {name: _digest(df) for name, df in marked.items()}:
            return "identical"
        raise Refused(f"{target} holds something else")
    staging = f"{target}.staging-{uuid.uuid4().hex}"
    try:
        told, back = [], {}
        for name, df in marked.items():
            df.write.mode("errorifexists").parquet(f"{staging}/{name}")
            read = spark.read.schema(df.schema).parquet(f"{staging}/{name}")
            if not read.where(row_sha(parts[name].columns) != F.col("_sha")).isEmpty():
                raise Refused(f"{name} was not written as it was made")
            told.append((name, *_digest(read)))
            back[name] = read.drop("_sha")
        if check is not None:
            against = check(back).limit(5).collect()
            if against:
                raise Refused(f"{target}: " + "; ".join(str(tuple(r)) for r in against))
        spark.createDataFrame(told, "part string, rows long, digest string").coalesce(1).write.parquet(f"{staging}/{MANIFEST}")
        if not rename(spark, staging, target):
            raise Refused(f"{target} was published by another run")
    except BaseException:
        delete(spark, staging)
        raise
    return "created"


def published(spark: SparkSession, target: str) -> dict[str, DataFrame]:
    """The parts of a publication, checked against its manifest."""
    told, out = _told(spark, target.rstrip("/")), {}
    for name, want in told.items():
        df = spark.read.parquet(f"{target.rstrip('/')}/{name}")
        columns = [c for c in df.columns if c != "_sha"]
        if _digest(df.withColumn("_sha", row_sha(columns))) != want:
            raise Refused(f"{name} of {target} has changed since it was published")
        out[name] = df.select(columns)
    return out


def sweep(spark: SparkSession, target: str) -> int:
    """Remove what killed runs left beside a target; how many there were."""
    fs, p = _at(spark, target.rstrip("/"))
    if not fs.exists(p.getParent()):
        return 0
    left = [s.getPath() for s in fs.listStatus(p.getParent()) if s.getPath().getName().startswith(f"{p.getName()}.staging-")]
    for s in left:
        fs.delete(s, True)
    return len(left)


def publish_pairs(pairs: DataFrame, target: str, key: str) -> str:
    """Bodies and the records that hold their hashes (article_pair) as one: no half of a pair is ever there alone."""
    pairs = cut(pairs)

    def mismatched(back: dict[str, DataFrame]) -> DataFrame:
        body = back["bodies"].select(F.col(key).alias("_k"), F.sha2("body_markdown", 256).alias("sha"))
        record = back["metadata"].select(key, F.get_json_object("metadata_json", "$.output_sha256").alias("told"))
        return record.join(body, F.col(key).eqNullSafe(F.col("_k")), "full").where("NOT (told <=> sha) OR told IS NULL").select(F.coalesce(key, "_k").alias(key), "told", "sha")

    done = publish(target, {"bodies": pairs.select(key, "body_markdown"), "metadata": pairs.select(key, "metadata_json")}, mismatched)
    forget(pairs)
    return done


def import_bundles(bundles: DataFrame, target: str, key: str) -> str:
    """Transcripts (as bundle() gives them) with their manifests into an archive: all of them, or none if one is incomplete,
    changed or holds more than its manifest names."""
    wrong = bundle_issues(bundles, key).where(F.size("issues") > 0).limit(5).collect()
    if wrong:
        raise Refused("; ".join(f"{r[key]}: {', '.join(r['issues'])}" for r in wrong))
    files = bundles.select(key, F.explode("files").alias("f")).select(key, "f.*")

    def changed(back: dict[str, DataFrame]) -> DataFrame:
        return back["files"].where((F.sha2("content", 256) != F.col("sha256")) | (F.octet_length("content") != F.col("size"))).select(key, "name")

    return publish(target, {"files": files}, changed)


def archive_bundles(files: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entry, path, content, size, sha256; what stands against it: entry, src, dest, status) for each entry (node).

    A bundle is its entry and all files that it reaches by local links, over Markdown files; a link to nothing, out of the
    archive or of an unknown scheme speaks against it.  The last file of a bundle is its manifest (00_manifest.json).
    """
    text = files.where(F.col("path").endswith(".md")).select("path", F.col("content").alias("text"))
    all_links = cut(resolve(link_spans(text, absolute=False), files))
    reached = closure(all_links.where("status = 'found'").select("src", F.col("resolved").alias("dst")), entries.select("node"), F.col("node").endswith(".md"))
    held = cut(reached.join(files.withColumnRenamed("path", "node"), "node").select(F.col("start").alias("entry"), F.col("node").alias("path"), F.col("content").cast("string").alias("content")))
    rows = held.withColumns({"size": F.octet_length("content").cast("long"), "sha256": F.sha2("content", 256)})
    against = rows.select("entry", F.col("path").alias("src")).join(all_links.where("status NOT IN ('found', 'remote')"), "src").select("entry", "src", "dest", "status")
    against = against.unionByName(entries.join(files, F.col("node") == F.col("path"), "left_anti").select(F.col("node").alias("entry"), F.col("node").alias("src"), F.col("node").alias("dest"), F.lit("missing").alias("status")))
    listed = rows.groupBy("entry").agg(F.sort_array(F.collect_list(F.struct("path", "size", "sha256"))).alias("files"))
    manifest = F.to_json(F.struct(F.col("entry").alias("entrypoint"), "files"))
    last = listed.select("entry", F.lit("00_manifest.json").alias("path"), manifest.alias("content"))
    return rows.unionByName(last.withColumns({"size": F.octet_length("content").cast("long"), "sha256": F.sha2("content", 256)})), against


@dataclass(frozen=True)
class States:
    """A table of states with a revision: it is written by whoever read the last one, and by nobody else."""

    spark: SparkSession
    folder: str

    def revision(self) -> int:
        """0 if there is none yet."""
        fs, p = _at(self.spark, self.folder)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return max((int(n[1:]) for n in names if n[:1] == "r" and n[1:].isdigit()), default=0)

    def read(self) -> tuple[int, DataFrame]:
        n = self.revision()
        if not n:
            raise Refused(f"{self.folder} has no state")
        return n, self.spark.read.parquet(f"{self.folder}/r{n}")

    def write(self, states: DataFrame, expected: int) -> int:
        """The new revision; refused if another was written since ``expected`` was read."""
        if self.revision() != expected:
            raise Refused(f"the state is at revision {self.revision()}, not {expected}")
        staging = f"{self.folder}/staging-{uuid.uuid4().hex}"
        states.write.parquet(staging)
        if not rename(self.spark, staging, f"{self.folder}/r{expected + 1}"):
            delete(self.spark, staging)
            raise Refused(f"revision {expected + 1} was written by another run")
        return expected + 1


def clean_up_plan(spark: SparkSession, roots: list[str], registered: DataFrame) -> DataFrame:
    """path, depth, status of all files under the roots, and of the registered ones that are gone.

    registered: path (without a scheme), size, sha256.  status: owned, unregistered, changed or missing.
    """
    found = spark.createDataFrame([], "path string, size long, sha256 string")
    for root in roots:
        if exists(spark, root):
            files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
            found = found.union(files.select(F.regexp_replace("path", "^[a-z]+:/*", "/"), F.col("length"), F.sha2("content", 256)))
    told = registered.select(F.col("path").alias("p"), F.col("size").alias("s"), F.col("sha256").alias("h"))
    both = found.join(told, F.col("path") == F.col("p"), "full")
    status = F.when(F.col("p").isNull(), "unregistered").when(F.col("path").isNull(), "missing").when((F.col("size") == F.col("s")) & (F.col("sha256") == F.col("h")), "owned").otherwise("changed")
    path = F.coalesce("path", "p")
    return both.select(path.alias("path"), F.size(F.split(path, "/")).alias("depth"), status.alias("status"))


def clean_up(store: States, roots: list[str], registered: DataFrame, expected: int) -> int:
    """Remove the folders ``roots`` if every file in them is registered and unchanged; the new revision of the state.

    All files are checked before the first is deleted, and the state says ``cleanup = 'running'`` before, ``'complete'`` after.
    A run that died in between is taken up: what is gone by then is no fault.  Deepest folders go first.
    """
    spark = store.spark
    revision, states = store.read()
    if revision != expected:
        raise Refused(f"the state is at revision {revision}, not {expected}")
    running = not states.where("cleanup = 'running'").isEmpty()
    allowed = ["owned", "missing"] if running else ["owned"]
    against = clean_up_plan(spark, roots, registered).where(~F.col("status").isin(allowed)).orderBy(F.desc("depth"), "path").limit(5).collect()
    if against:
        raise Refused("; ".join(f"{r['path']} is {r['status']}" for r in against))
    if not running:
        expected = store.write(states.withColumn("cleanup", F.lit("running")), expected)
    for root in sorted(roots, key=lambda r: (-r.count("/"), r)):
        delete(spark, root)
    return store.write(store.read()[1].withColumn("cleanup", F.lit("complete")), expected)
