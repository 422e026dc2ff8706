"""Listings, reads between two listings, and discovery that is taken up after a failure."""

import os

import pytest
from pyspark.sql import functions as F

from corpusmill.sources import documents, folders
from corpusmill.streaming import discovery


@pytest.fixture
def tree(tmp_path):
    names = ["a.md", "B.txt", "sub/c.md", "sub/deep/d.md", "sub/deep/er/e.html", "a.processed.md", "page_files/i.md", "x_processed/y.md", ".git/z.md", "sub/pic.png"]
    for n in names:
        p = tmp_path / "in" / n
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(f"# {n}\n\ntext of {n}")
    return tmp_path / "in"


def names(df, tree):
    return sorted(os.path.relpath(r["path"], tree) for r in df.collect())


def test_listing(spark, tree):
    every = folders.listing(spark, str(tree))
    assert names(every, tree) == sorted(["a.md", "B.txt", "sub/c.md", "sub/deep/d.md", "sub/deep/er/e.html", "sub/pic.png"])
    assert {os.path.relpath(r["path"], tree): r["depth"] for r in every.collect()}["sub/deep/d.md"] == 3
    assert names(folders.listing(spark, f"file://{tree}", depth=2, suffixes=(".md", ".txt")), tree) == ["B.txt", "a.md", "sub/c.md"]
    assert [r["name"] for r in folders.in_order(folders.listing(spark, str(tree), depth=2)).collect()] == ["a.md", "B.txt", "c.md", "pic.png"]
    out = every.where("name = 'a.md'").select("path")
    assert "a.md" not in names(folders.listing(spark, str(tree), outputs=out), tree)


def test_reads_are_vouched_for(spark, tree):
    done = {os.path.relpath(r["path"], tree): r for r in folders.snapshot(spark, str(tree)).collect()}
    assert len(done) == 6 and all(r["error"] is None and r["sha256"] for r in done.values())
    now = folders.listing(spark, str(tree))
    before = spark.createDataFrame(now.collect(), now.schema)
    read = spark.createDataFrame([(str(tree / n), (tree / n).read_bytes()) for n in ("a.md", "B.txt", "sub/c.md")], "path string, content binary")
    (tree / "B.txt").write_text("another text of some length")
    (tree / "sub/c.md").unlink()
    got = {os.path.relpath(r["path"], tree): r["error"] for r in folders.vouched(read, before, folders.listing(spark, str(tree))).collect()}
    assert got == {"a.md": None, "B.txt": "the file changed while it was read", "sub/c.md": "the file is gone"}


def test_discovery_repeats_nothing(spark, tree, tmp_path):
    target, state = str(tmp_path / "out"), str(tmp_path / "state")
    run = lambda **x: discovery.discover(spark, str(tree), target, state, most=2, **x).awaitTermination()
    seen = []

    def fails(batch, where):
        if len(seen) == 2:
            raise RuntimeError("the process died")
        seen.append(discovery.take(batch, where))
        return 0

    with pytest.raises(Exception):
        run(sink=fails)
    first = spark.read.parquet(target).count()
    assert 0 < first < 7
    run()
    whole = spark.read.parquet(target)
    # the batch run over the same folder (all files but the pruned ones)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tree)).where(~F.col("path").rlike(rf"/(?:{folders.PRUNED})/"))
    want = documents.extract_files(files.select(folders.plain(F.col("path")).alias("path"), "content"))
    assert whole.count() == want.count() == whole.select("path").distinct().count()
    assert documents.batch_counts(whole).first() == documents.batch_counts(want).first()
    run()
    assert spark.read.parquet(target).count() == want.count()
    (tree / "new.md").write_text("# New\n\none more")
    run()
    assert spark.read.parquet(target).where("title = 'New'").count() == 1 and spark.read.parquet(target).count() == want.count() + 1
    # a file given twice in one call, and a call that is repeated
    rows = spark.createDataFrame([(str(tree / "new.md"), 16, (tree / "new.md").read_bytes())] * 2, "path string, length long, content binary")
    assert discovery.take(rows, target) == 0 and discovery.take(rows, str(tmp_path / "other")) == 1
