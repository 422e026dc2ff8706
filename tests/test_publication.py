"""Publications are whole or not there; states are written by who read them; clean-ups are checked first."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from corpusmill.sources import publication, records
from corpusmill.sources.publication import Refused, States


@pytest.fixture
def parts(spark):
    one = spark.createDataFrame([(1, "a", None), (2, None, [1, 2]), (2, None, [1, 2])], "id long, t string, x array<int>")
    return {"one": one, "two": spark.range(50).select("id", F.concat(F.lit("row "), "id").alias("t"))}


def left(folder):
    return sorted(os.listdir(folder))


def test_all_parts_or_none(spark, parts, tmp_path):
    target = str(tmp_path / "out")
    broken = parts["two"].withColumn("t", F.when(F.col("id") == 49, F.raise_error(F.lit("the writer died"))).otherwise(F.col("t")))
    with pytest.raises(Exception, match="the writer died"):
        publication.publish(target, {"one": parts["one"], "two": broken})
    assert left(tmp_path) == []
    assert publication.publish(target, parts) == "created" and left(tmp_path) == ["out"]
    assert publication.publish(target, parts) == "identical"
    with pytest.raises(Refused, match="something else"):
        publication.publish(target, {"one": parts["one"], "two": parts["two"].where("id > 0")})
    back = publication.published(spark, target)
    assert sorted(map(tuple, back["one"].collect()), key=repr) == sorted(map(tuple, parts["one"].collect()), key=repr) and back["two"].count() == 50


def test_a_killed_run_leaves_nothing_that_is_read(spark, parts, tmp_path):
    target = str(tmp_path / "out")
    parts["one"].write.parquet(f"{target}.staging-0123/one")  # as far as it came
    with pytest.raises(Refused, match="no publication"):
        publication.published(spark, f"{target}.staging-0123")
    assert publication.publish(target, parts) == "created" and publication.sweep(spark, target) == 1 and left(tmp_path) == ["out"]


def test_changes_after_publication_show(spark, parts, tmp_path):
    target = str(tmp_path / "out")
    publication.publish(target, parts)
    spark.createDataFrame([(99, "late", "x")], "id long, t string, _sha string").write.mode("append").parquet(f"{target}/two")
    with pytest.raises(Refused, match="two of .* has changed"):
        publication.published(spark, target)


def test_pairs(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"T{k}", f"body {k}") for k in range(20)], "id long, t string, b string")
    pairs = records.article_pair(rows, "id", F.col("t"), {}, F.col("b"))
    spoilt = pairs.withColumn("body_markdown", F.when(F.col("id") == 7, "another").otherwise(F.col("body_markdown")))
    with pytest.raises(Refused, match="7"):
        publication.publish_pairs(spoilt, str(tmp_path / "p"), "id")
    assert left(tmp_path) == [] and publication.publish_pairs(pairs, str(tmp_path / "p"), "id") == "created"


def test_imports_roll_back(spark, tmp_path):
    seg = spark.createDataFrame([(c, k * 1000, k * 1000 + 900, f"say {k}") for c in (1, 2) for k in range(3)], "id long, start_ms long, end_ms long, text string")
    bundles = records.bundle(seg, "id", F.lit("Talk"), [])
    cut = bundles.withColumn("files", F.when(F.col("id") == 2, F.filter("files", lambda f: f["name"] != "transcript.srt")).otherwise(F.col("files")))
    with pytest.raises(Refused, match="2: transcript.srt is missing"):
        publication.import_bundles(cut, str(tmp_path / "in"), "id")
    assert left(tmp_path) == []
    assert publication.import_bundles(bundles, str(tmp_path / "in"), "id") == "created"
    assert publication.published(spark, str(tmp_path / "in"))["files"].groupBy("id").count().collect()[0]["count"] == 5


def test_bundles_hold_what_they_reach(spark):
    files = spark.createDataFrame(
        [("a/x.md", "[b](../b/y.md) ![i](i.png)"), ("a/i.png", "png"), ("b/y.md", "[a](../a/x.md) [z](z.txt)"), ("b/z.txt", "[no](../never.md)"), ("c.md", "[gone](gone.md) [w](https://e.org)"), ("d.md", "alone")], "path string, content string"
    )
    rows, against = publication.archive_bundles(files, spark.createDataFrame([("a/x.md",), ("c.md",), ("d.md",), ("e.md",)], "node string"))
    got = {}
    for r in rows.collect():
        got.setdefault(r["entry"], {})[r["path"]] = r
    assert {e: sorted(p) for e, p in got.items()} == {"a/x.md": ["00_manifest.json", "a/i.png", "a/x.md", "b/y.md", "b/z.txt"], "c.md": ["00_manifest.json", "c.md"], "d.md": ["00_manifest.json", "d.md"]}
    assert '"entrypoint":"a/x.md"' in got["a/x.md"]["00_manifest.json"]["content"] and hashlib.sha256(b"png").hexdigest() in got["a/x.md"]["00_manifest.json"]["content"]
    assert sorted(tuple(r) for r in against.collect()) == [("c.md", "c.md", "gone.md", "missing"), ("e.md", "e.md", "e.md", "missing")]


def test_revisions(spark, tmp_path):
    store = States(spark, str(tmp_path / "state"))
    states = spark.createDataFrame([("w", "pending")], "workflow_id string, cleanup string")
    assert store.revision() == 0 and store.write(states, 0) == 1
    with pytest.raises(Refused, match="at revision 1, not 0"):
        store.write(states, 0)
    assert store.write(states, 1) == 2 and store.read()[0] == 2


def test_clean_up_is_checked_before_the_first_delete(spark, tmp_path):
    store = States(spark, str(tmp_path / "state"))
    store.write(spark.createDataFrame([("w", "pending")], "workflow_id string, cleanup string"), 0)
    root = tmp_path / "work" / "parts"
    (root / "deep").mkdir(parents=True)
    content = {root / "part-001.json": b"one", root / "deep" / "part-002.json": b"two"}
    for p, c in content.items():
        p.write_bytes(c)
    registered = spark.createDataFrame([(str(p), len(c), hashlib.sha256(c).hexdigest()) for p, c in content.items()], "path string, size long, sha256 string")
    (root / "deep" / "note.txt").write_text("mine")
    with pytest.raises(Refused, match="note.txt is unregistered"):
        publication.clean_up(store, [str(root)], registered, 1)
    (root / "deep" / "note.txt").unlink()
    (root / "part-001.json").write_bytes(b"eno")
    with pytest.raises(Refused, match="part-001.json is changed"):
        publication.clean_up(store, [str(root)], registered, 1)
    (root / "part-001.json").write_bytes(b"one")
    gone = registered.union(spark.createDataFrame([(str(root / "part-003.json"), 1, "x")], registered.schema))
    with pytest.raises(Refused, match="part-003.json is missing"):
        publication.clean_up(store, [str(root)], gone, 1)
    with pytest.raises(Refused, match="at revision 1, not 0"):
        publication.clean_up(store, [str(root)], registered, 0)
    assert sorted(p.name for p in root.rglob("*.json")) == ["part-001.json", "part-002.json"] and store.revision() == 1
    # a run that died after its first delete is taken up
    store.write(store.read()[1].withColumn("cleanup", F.lit("running")), 1)
    (root / "part-001.json").unlink()
    assert publication.clean_up(store, [str(root)], registered, 2) == 3
    assert not root.exists() and store.read()[1].first()["cleanup"] == "complete"
