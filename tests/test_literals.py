"""Small literal inputs with the rows they give, for operators whose queries make their inputs from tables."""

from pyspark.sql import functions as F

from corpusmill.operators import integrity, links, planning, search
from corpusmill.sources import posts, sinks

_CARD = '<article data-testid="tweet"><div data-testid="User-Name">A One</div><a href="/aone/status/11"><span><time datetime="2024-01-01"></time></span></a><div data-testid="tweetText">hi <a href="/evil/status/99">x</a></div></article>'
_QUOTE = '<article data-testid="tweet" data-in-reply-to-status-id="7"><a href="https://x.com/b/status/12/photo/1"><time></time></a><div data-testid="tweetText">see<br>it</div><div role="link"><div data-testid="User-Name">C</div><a href="/c/status/13"><time></time></a><div data-testid="tweetPhoto"><img src="https://p/1.jpg" alt="pic"></div></div></article>'
_LOOSE = '<article data-testid="tweet" data-tweet-id="77" data-in-reply-to-status-id="11"><div data-testid="tweetText">see <a href="/somebody/status/444">this</a></div></article>'
_AGAIN = '<article data-testid="tweet"><div data-testid="User-Name">E</div><a href="https://mobile.twitter.com/e/status/5"><time></time></a><div data-testid="tweetText">no id</div><div data-testid="socialContext">E reposted</div></article>'


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def same(df, want):
    assert rows_of(df) == sorted(want, key=repr)


def test_posts(spark):
    photo = '<article data-testid="tweet"><a href="/c/status/13"><time></time></a><img src="avatar.png"><div data-testid="tweetPhoto"><img src="a.png"></div></article>'
    pages = [("p1", _CARD + _CARD + _QUOTE + _LOOSE + _AGAIN + _CARD.replace(">x<", ">y<")), ("p2", "<div>shell</div>"), ("p3", _CARD + '<article data-testid="tweet"><p>x</p></article>'), ("p4", photo), ("p5", None)]
    found = posts.extract_posts(spark.createDataFrame(pages, "page_id string, html string"))
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0))
    got = found.select("page_id", "post_id", "author_account", "text", "relation", size("quoted_posts"), "warning", F.coalesce("page_order", F.lit(0)), "permalink", "reply_to_id", "published_at", size("media"))
    same(got, [
        ("p1", "11", "aone", "hi x", "unknown", 0, None, 1, "https://x.com/aone/status/11", None, "2024-01-01", 0),
        ("p1", "12", "b", "see\nit", "quote", 1, None, 2, "https://x.com/b/status/12", "7", None, 0),
        ("p1", "77", None, "see this", "reply", 0, None, 3, None, "11", None, 0),
        ("p1", None, None, "no id", "repost", 0, "a card without a post id or permalink", 4, None, None, None, 0),
        ("p1", "11", "aone", "hi y", "unknown", 0, "another snapshot of the same post", 5, "https://x.com/aone/status/11", None, "2024-01-01", 0),
        ("p2", None, None, None, None, 0, "no posts found", 0, None, None, None, 0),
        ("p3", None, None, None, None, 0, "a card without text or photo", 0, None, None, None, 0),
        ("p4", "13", "c", "", "unknown", 0, None, 1, "https://x.com/c/status/13", None, None, 1),
        ("p5", None, None, None, None, 0, "no posts found", 0, None, None, None, 0),
    ])


def test_bundles(spark):
    files = spark.createDataFrame([("a/x.md",), ("b/entry.md",), ("b/other.md",), ("b/c/main.md",), ("b/c/part.md",)], "path string")
    same(search.bundle_entries(files, spark.createDataFrame([("b", "b/entry.md"), ("b/c", "b/c/main.md")], "dir string, entry string")), [("a/x.md",), ("b/entry.md",), ("b/c/main.md",)])


def test_links(spark):
    text = "see [b](../b/y%20z.md#part) and ![i](<img one.png>) `[no](no.md)`\n[id]: ../b/y%20z.md\n<img src=\"p.png\"> [w](https://e.org/a_(b)) [c](c(1).md)"
    files = spark.createDataFrame([("a/x.md", text), ("b/y z.md", "back [a](../a/x.md)"), ("n.md", None)], "path string, text string")
    same(links.resolve(links.link_spans(files), files).select("src", "dest", "form", "resolved", "status"), [
        ("a/x.md", "../b/y%20z.md#part", "inline", "b/y z.md", "found"), ("a/x.md", "img one.png", "inline", "a/img one.png", "missing"), ("a/x.md", "../b/y%20z.md", "definition", "b/y z.md", "found"),
        ("a/x.md", "p.png", "attribute", "a/p.png", "missing"), ("a/x.md", "https://e.org/a_(b)", "inline", None, "remote"), ("a/x.md", "c(1).md", "inline", "a/c(1).md", "missing"), ("b/y z.md", "../a/x.md", "inline", "a/x.md", "found"),
    ])


def test_options(spark):
    rows = spark.createDataFrame([("one", 1, 0, 0), ("media+t", 1, 0, 1), ("va", 1, 1, 0), ("ts", 0, 0, 2), ("vv", 2, 0, 0)], "project string, video int, audio int, transcript int")
    same(planning.material_options(rows).select("project", "required", F.array_join("reasons", "|"), "options", "recommended"), [
        ("one", False, "", None, None), ("media+t", True, "media_and_transcript_coexist", 5, "reuse_transcript_selective_verification"), ("va", True, "multiple_media_candidates", 4, "use_existing_audio"),
        ("ts", True, "multiple_transcript_candidates", 3, "select_one_transcript"), ("vv", True, "multiple_media_candidates", 3, "select_one_media"),
    ])


def test_images(spark):
    src = ["https://e.org/a.png", "data:image/png;base64,aGVsbG8=", "data:image/png;base64,@@@", "data:text/plain,x", "img/b.png", "data:image/jpeg;base64,aGVs\r\nbG8="]
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate(src)], "doc_id int, idx int, src string")
    same(sinks.image_candidates(rows).select("idx", "status", "name"), [(0, "remote_not_saved", None), (1, "decoded", "image-001-2cf24dba5fb0.png"), (2, "invalid_data", None), (3, "unsupported", None), (4, "local", None), (5, "decoded", "image-005-2cf24dba5fb0.jpg")])


def test_companions(spark):
    files = [("a/page.html", 1), ("a/page_files/i.png", 10), ("a/page_files/s/j.png", 20), ("b/q.htm", 1), ("b/q.files/k.css", 5), ("c/lone_files/x", 9)]
    rows = spark.createDataFrame([(p, n, "") for p, n in files], "path string, size long, sha256 string")
    same(integrity.companion_dirs(rows).select("page", "dir", "file_count", "total_bytes"), [("a/page.html", "a/page_files", 2, 30), ("b/q.htm", "b/q.files", 1, 5)])


def test_numbers_of_a_total_order(spark):
    names = [f"{'Ab'[k % 2]}{k * 7919 % 1000:03d}" for k in range(1000)] + ["a000"]
    out = planning.numbered(spark.createDataFrame([(n,) for n in names], "path string").repartition(7), planning.path_order(F.col("path")), "place")
    assert [r["path"] for r in out.orderBy("place").collect()] == sorted(names, key=lambda n: (n.lower(), n)) and [r["place"] for r in out.orderBy("place").collect()] == list(range(1, 1002))
    assert planning.numbered(out.where("false").drop("place"), planning.path_order(F.col("path")), "place").collect() == []


def test_all_sources_of_a_collision(spark):
    """However many there are; a null key is a key, a null source is none."""
    rows = spark.range(2500).select(F.lit("en-7").alias("key"), (F.col("id") * 3).alias("doc_id"))
    rows = rows.union(rows).union(spark.createDataFrame([("de-1", 5), ("de-1", None), (None, 8), (None, 9)], "key string, doc_id long"))
    got = {r["key"]: (r["n"], r["sources"]) for r in integrity.collisions(rows, "key", "doc_id").collect()}
    assert got == {"en-7": (2500, list(range(0, 7500, 3))), None: (2, [8, 9])}
