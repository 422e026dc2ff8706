"""Functions and operators on literals."""

import io
import random
import zipfile

import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions import times as M
from corpusmill.functions import unicode as U
from corpusmill.operators import attribution, fidelity, frames, integrity, intervals, links, planning, search, workflow
from corpusmill.sources import captions, documents, html, posts, sinks


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


def test_normalisers(spark):
    assert one(spark, "  a \t b　\r\n\r\n\r\n\n c  d\r", T.normalize_plain) == "a b\n\nc d"
    assert one(spark, "\n\n  a  \n\n\n\n    code\t\n\n", T.normalize_structured) == "  a\n\n    code"
    assert one(spark, " a\n b　c", T.without_space) == "abc"
    assert one(spark, "Hé, 你好！_x", T.boundary_form) == "hé你好_x"
    for f in (T.normalize_plain, T.normalize_structured):
        once = one(spark, " x \n\n\n y\t\n", f)
        assert one(spark, once, f) == once


def test_anchors(spark):
    text = "时间 01:02:03 在2024年，增长 12.5% 与 300万，20245 又 2024年 和 7公里x 5人"
    assert one(spark, text, T.numeric_anchors) == ["2024年", "12.5%", "300万", "2024", "5人"]
    assert one(spark, "好吗？ok? a? what is\nthis?", T.question_anchors) == ["好吗？", "ok?", "a?", "this?"]
    assert one(spark, "本段已覆盖。", T.is_vague) and not one(spark, "明确的事实陈述在此", T.is_vague)
    assert one(spark, "编者按： 值得读", T.strip_comment_label) == "值得读"
    assert one(spark, 'a<b>:c?. ', T.file_component) == "a_b_c_"
    assert one(spark, "a|b\nc", T.markdown_cell) == "a\\|b c"
    assert one(spark, "icon: x\nname: y\n icon-set: z", T.config_without_icons) == "name: y"


def test_times(spark):
    row = spark.range(1).select(
        M.stamp_ms(F.lit(3_723_004)), M.stamp_ms(F.lit(-5), True), M.precise_stamp_ms(F.lit(3_723_004)), M.precise_stamp_seconds(F.lit(1.0005)), M.parse_stamp(F.lit("02:03,4")), M.parse_stamp(F.lit("1:02:03.045")),
        M.parse_stamp(F.lit("1:62:03.045")), M.chunk_count(F.lit(5_400_000)), M.chunk_count(F.lit(5_400_001)), M.overlap_ms(F.lit(0), F.lit(5), F.lit(3), F.lit(9)), M.within_tolerance(F.lit(100.0), F.lit(3100.0), 3000, 0.002),
    ).first()
    assert tuple(row) == ("01:02:03", "00:00:00,000", "01:02:03.004", "00:00:01.000", 123_400, 3_723_045, None, 2, 2, 2, True)


def test_plan_covers(spark):
    df = spark.createDataFrame([("m", 13_000_123, 4), ("n", 7, 3)], "media string, duration_ms long, n int")
    plan = intervals.chunk_plan(df, count="n")
    assert [tuple(r) for r in intervals.contiguous(plan, "media", total="duration_ms").orderBy("media").collect()] == [("m", True), ("n", True)]
    rows = plan.where("media = 'm'").orderBy("idx").collect()
    assert [r["core_end_ms"] for r in rows] == [round(k * 13_000_123 / 4) for k in range(1, 5)] and rows[0]["decode_start_ms"] == 0 and rows[1]["decode_start_ms"] == rows[1]["core_start_ms"] - 10_000
    seg = spark.createDataFrame([("n", 6, 8), ("n", 0, 2), ("n", 2, 2)], "media string, start_ms long, end_ms long")
    assert sorted((r["start_ms"], r["idx"]) for r in intervals.own_segments(seg, plan, "media").collect()) == [(0, 1), (2, 2), (6, 3)]


def test_merge(spark):
    schema = "media_id long, start_ms long, end_ms long, text string, avg_logprob double, chunk_index int"
    rows = [(1, 59000, 61000, "hello wide world again", -0.4, 1), (1, 59200, 61100, "Hello, wide world again!", -0.2, 2), (1, 80000, 82000, "hello wide world again", -0.2, 2)]
    rows += [(2, 59000, 61000, "alpha beta gamma delta", -0.4, 1), (2, 60000, 62000, "alpha beta other delta", None, 2)]
    out = intervals.merge_segments(spark.createDataFrame(rows, schema)).orderBy("media_id", "id").collect()
    assert [(r["media_id"], r["id"], r["chunk_index"], r["warning"] is not None) for r in out] == [(1, 1, 2, False), (1, 2, 2, False), (2, 1, 1, False), (2, 2, 2, True)]
    assert spark.range(1).select(intervals.thin(F.array(F.lit(0.0), F.lit(0.01), F.lit(0.03), F.lit(0.045)))).first()[0] == [0.0, 0.03]


def test_previous_tail(spark):
    rows = [("m", 1, k, f"seg {k} " + "x" * 30) for k in range(12)] + [("m", 2, 0, "y" * 300)]
    got = {r["chunk_index"]: r["context"] for r in intervals.previous_tail(spark.createDataFrame(rows, "m string, chunk_index int, start_ms int, text string"), "m").collect()}
    assert got[3] == "…" + "y" * 239 and len(got[2]) <= 240 and got[2].endswith(rows[11][3]) and got[2].count("seg") == 6


def test_search_ranks_related_text(spark):
    docs = spark.createDataFrame([(1, "# 城市更新\n城市更新改善居民生活，2024年投入300万元"), (2, "天气预报与足球比赛"), (3, "城市 更新计划 Python3 data.frame")], "doc_id long, text string")
    asked = spark.createDataFrame([("城市更新计划",)], "text string")
    out = search.search(docs, asked).collect()
    assert [r["id"] for r in out] == [1, 3] and "城市更新" in out[0]["shared_terms"]
    terms = {r["term"]: r["tf"] for r in search.term_frequency(spark.createDataFrame([(1, "ＡＢＣ城市 a b2 那个 1999 12.5% x.")], "doc_id long, text string")).collect()}
    assert terms == {"abc": 1, "城市": 3, "b2": 1, "1999": 1, "12.5%": 1, "x.": 1}
    with pytest.raises(ValueError):
        search.search(docs, asked, 51)


@given(st.text(alphabet="ab。！？\n ", max_size=4000), st.integers(400, 1300))
def test_chunks_are_the_text(text, most):
    spans = list(fidelity.chunk_spans(text, most))
    assert "".join(text[a:b] for a, b in spans) == text and all(0 < b - a <= most + 1 for a, b in spans)


def ledger(spark, **change):
    source = "00:00:01 In 2024年 revenue grew 12.5% to a new high. Is it lasting?\n" + "00:00:09 The reason was a change of method in the plant."
    base = {
        "id": "U001", "source_start_char": 0, "source_end_char": len(source), "source_sha256": __import__("hashlib").sha256(source.encode()).hexdigest(), "source_text": source, "minimum_information_units": 1,
        "information_units": [("claim", "revenue grew 12.5% to a new high", "revenue grew 12.5% in 2024年")],
        "numeric_anchors": [("2024年", "covered", "revenue grew 12.5% in 2024年", ""), ("12.5%", "excluded", "", "stated elsewhere")], "question_anchors": [("Is it lasting?", "noise", "", "rhetoric only")], "omissions": [],
    } | change
    unit = (
        "struct<id:string,source_start_char:long,source_end_char:long,source_sha256:string,source_text:string,minimum_information_units:long,information_units:array<struct<kind:string,source_detail:string,final_evidence:string>>,"
        "numeric_anchors:array<struct<source_value:string,status:string,final_evidence:string,reason:string>>,question_anchors:array<struct<source_question:string,status:string,final_evidence:string,reason:string>>,omissions:array<struct<source_detail:string,reason:string>>>"
    )
    order = ["id", "source_start_char", "source_end_char", "source_sha256", "source_text", "minimum_information_units", "information_units", "numeric_anchors", "question_anchors", "omissions"]
    df = spark.createDataFrame([(1, source, "So revenue grew 12.5% in 2024年, they say.", [tuple(base[k] for k in order)])], f"id int, source_text string, final_text string, units array<{unit}>")
    return fidelity.audit(df).first()["issues"]


def test_audit(spark):
    assert ledger(spark) == []
    assert any("vague" in x for x in ledger(spark, information_units=[("claim", "见正文", "revenue grew 12.5% in 2024年")]))
    assert any("evidence is not" in x for x in ledger(spark, information_units=[("claim", "revenue grew 12.5% to a new high", "nothing like that at all")]))
    assert any("not in its chunk" in x for x in ledger(spark, information_units=[("claim", "a detail from somewhere else", "revenue grew 12.5% in 2024年")]))
    assert any("number" in x for x in ledger(spark, numeric_anchors=[("2024年", "pending", "", "")]))
    assert any("hash" in x for x in ledger(spark, source_sha256="0"))
    same = ("claim", "revenue grew 12.5% to a new high", "revenue grew 12.5% in 2024年")
    assert {"repeated detail", "repeated evidence"} <= set(ledger(spark, information_units=[same, same]))


def test_greedy_keep_equals_the_loop(spark):
    rng = random.Random(4)
    values = [rng.getrandbits(12) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(values)), "id long, hash long")
    kept, want = [], {}
    for i, v in enumerate(values):
        near = [j for j in kept if bin(v ^ values[j]).count("1") <= 2]
        want[i] = (not near, near[0] if near else None)
        if not near:
            kept.append(i)
    first = {v: i for i, v in reversed([*enumerate(values)])}
    assert {r["id"]: r["representative"] for r in frames.classes(df).collect()} == {i: first[v] for i, v in enumerate(values)}
    links = {(r["a"], r["b"]) for r in frames.near_links(df, 2).collect()}
    assert links == {(i, j) for j in range(120) for i in range(j) if {i, j} <= {*first.values()} and 0 < bin(values[i] ^ values[j]).count("1") <= 2}
    # the classes and their links say the same of all pairs, and rounds over representatives the same as the loop
    every = [(i, j) for j in range(120) for i in range(j) if bin(values[i] ^ values[j]).count("1") <= 2]
    near = {(min(first[values[i]], first[values[j]]), max(first[values[i]], first[values[j]])) for i, j in every}
    assert {(a, b) for a, b in near if a < b} == links
    assert {r["id"]: (r["kept"], r["duplicate_of"]) for r in frames.greedy_frames(df, 2).collect()} == want
    pairs = spark.createDataFrame(every, "a long, b long")
    assert {r["id"]: (r["kept"], r["duplicate_of"]) for r in frames.greedy_keep(df, pairs).collect()} == want


def test_closure_ends_in_circles(spark):
    edges = spark.createDataFrame([("a.md", "b.md"), ("b.md", "a.md"), ("b.md", "c.png"), ("c.png", "d.md")], "src string, dst string")
    out = links.closure(edges, spark.createDataFrame([("a.md",)], "node string"), F.col("node").endswith(".md"))
    assert sorted(r["node"] for r in out.collect()) == ["a.md", "b.md", "c.png"]


def test_rebase_keeps_other_bytes(spark):
    text = "﻿x [b](../b/y%20z.md#p)\r\n`[c](c.md)` <img src='i.png'>"
    files = spark.createDataFrame([("a/x.md", text)], "path string, text string")
    moved = spark.createDataFrame([("a/x.md", "out")], "src string, new_folder string")
    assert links.rebase(files, moved, links.link_spans(files)).first()["text"] == "﻿x [b](../b/y%20z.md#p)\r\n`[c](c.md)` <img src='../a/i.png'>"


PAGE = """<html><head><meta property="og:title" content="T &amp; U"><meta name="author" content="Ann"><meta name="publisher" content="Pub"><link rel="canonical" href="https://e.org/1">
<script type="application/ld+json">{"@graph": [{"@type": "NewsArticle", "datePublished": "2024-01-02", "author": [{"name": "Other"}]}]}</script></head>
<body><nav>menu</nav><article><h1>Head</h1><p>转发者附言：值得一读<p>以下为原文<p>原作者：Bob<p>First paragraph of the text.<br>Second <b>part<img src="x_files/i.png"></article><footer>foot</footer></body></html>"""


def test_page_and_attribution(spark):
    r = html.extract(PAGE, "https://other")
    assert (r["title"], r["author_or_account"], r["current_publisher"], r["original_author"], r["published_at"], r["original_url"]) == ("T & U", "Ann", "Pub", "Bob", "2024-01-02", "https://e.org/1")
    assert "menu" not in r["body"] and "foot" not in r["body"] and r["body"].startswith("Head") and r["resource_references"] == ["https://e.org/1", "x_files/i.png"]
    texts = [r["body"], "转载自：某报\n编者按：好\n正文一\n正文二", "本文原创", "plain text", "来源：原创\n正文", "编者按：好\n正文", None, "转载\n原创\n正文"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(1, texts[1])], "doc_id long, text string")
    got = {x["id"]: tuple(x)[1:] for x in attribution.attribute(rows).collect()}
    assert got[0][:2] == ("repost_with_comment", "值得一读") and got[0][2].startswith("原作者")
    assert got[1] == ("repost_with_comment", "好", "正文一\n正文二", ["转载自：某报"])
    assert got[2][0] == "original" and got[3] == ("unknown", None, "plain text", []) and got[4][0] == "unknown"
    assert got[5] == ("unknown", None, "正文", []) and got[6] == ("unknown", None, None, []) and got[7] == ("repost", None, "原创\n正文", ["转载", "原创"])
    assert attribution.attribute(rows).count() == len(texts) + 1
    assert html.extract("<main>short</main><p>outside the main part</p>")["body"].split() == ["short", "outside", "the", "main", "part"]


def docx():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>Cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    core = '<c:coreProperties xmlns:c="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>Doc</dc:title><dc:creator>Cy</dc:creator></c:coreProperties>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", body)
        z.writestr("docProps/core.xml", core)
    return out.getvalue()


MHTML = (
    b"Subject: Mail title\r\nMIME-Version: 1.0\r\nContent-Type: multipart/related; boundary=B\r\n\r\n--B\r\nContent-Type: text/plain\r\n\r\nplain\r\n"
    b"--B\r\nContent-Type: text/html; charset=utf-8\r\nContent-Location: https://m.org/x\r\n\r\n<title>Page title</title><article><p>\xe8\xbd\xac\xe8\xbd\xbd\xe8\x87\xaa\xef\xbc\x9a\xe6\x9f\x90\xe6\x8a\xa5<p>long enough body text here</article>\r\n--B--\r\n"
)


def test_formats(spark, tmp_path):
    files = {
        "a.md": "---\ntitle: Front\nauthor: 'Z'\n---\n# Head\n\n    code\n".encode(), "b.txt": "作者：李四\n日期：2020\n\n正文内容 http://e.org/x.".encode("gb18030"), "c.docx": docx(), "d.mhtml": MHTML, "e.html": PAGE.encode(),
        "f.srt": b"1\n00:00:01,000 --> 00:00:02,500\nhi\nyou\n\n", "g.docx": b"broken", "h.pdf": b"%PDF", "skip.bin": b"x",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "x_files").mkdir()
    (tmp_path / "x_files" / "n.html").write_bytes(b"nested")
    out = {r["path"].rpartition("/")[2]: r for r in documents.extract_files(documents.discover(spark, str(tmp_path))).collect()}
    assert set(out) == set(files) - {"skip.bin"}
    assert out["a.md"]["title"] == "Front" and "    code" in out["a.md"]["body"] and out["a.md"]["author_or_account"] == "Z"
    assert (out["b.txt"]["author_or_account"], out["b.txt"]["published_at"], out["b.txt"]["original_url"], out["b.txt"]["detected_encoding"]) == ("李四", "2020", "http://e.org/x", "gb18030")
    assert out["c.docx"]["title"] == "Doc" and out["c.docx"]["body"].split() == ["One", "Cell"]
    assert out["d.mhtml"]["title"] == "Page title" and out["d.mhtml"]["original_url"] == "https://m.org/x"
    assert out["f.srt"]["body"] == "hi<br>you"
    assert out["g.docx"]["error"] and out["h.pdf"]["error"] and out["g.docx"]["body"] is None
    n = documents.batch_counts(spark.createDataFrame([(r["error"],) for r in out.values()], "error string")).first()
    assert (n["succeeded"], n["failed"], n["total"]) == (6, 2, 8)

    class Fake:
        def __init__(self, pages):
            self.pages = [type("P", (), {"extract_text": lambda self, t=t: t})() for t in pages]

    assert documents.from_pdf(b"", lambda f: Fake(["one", "two"]))["body"] == "one\n\ntwo"
    with pytest.raises(ValueError, match="OCR"):
        documents.from_pdf(b"", lambda f: Fake(["", " "]))


def test_decoding_policies():
    assert U.decode_bytes("文".encode("utf-16")) == ("文", "utf-16") and U.decode_bytes("﻿a".encode())[0] == "a"
    assert U.decode_bytes("中文内容".encode("gb18030"))[1] == "gb18030"
    assert U.decode_bytes(b"<meta charset=big5>" + "中".encode("big5")) == ("<meta charset=big5>中", "big5")
    assert U.decode_bytes(b"\xff\x81\xff")[1] == "utf-8-replace"
    assert U.decode_bytes("中文".encode("gb18030"), "transcript") == ("中文", "gb18030")
    with pytest.raises(UnicodeError):
        U.decode_bytes(b"\xff\xff\xff", "transcript")
    assert U.nfkc_lower.func(pd.Series(["ＡＢ", None])).tolist() == ["ab", None]


def test_captions(spark):
    vtt = "WEBVTT\n\nNOTE x\n\nid\n00:01.000 --> 00:02.000 align:left\na\nb\n\n00:03.000 --> 00:04.000\nc"
    rows = spark.createDataFrame([("v", "vtt", vtt), ("bad", "srt", "no times here"), ("back", "srt", "1\n00:00:05,000 --> 00:00:01,000\nx")], "name string, format string, text string")
    out = captions.parse_captions(rows).orderBy("key", "idx").collect()
    assert [(r["key"], r["start_ms"], r["text"], r["status"] == "ok") for r in out] == [("back", None, None, False), ("bad", None, None, False), ("v", 1000, "a<br>b", True), ("v", 3000, "c", True)]


def test_workflow_life(spark):
    steps = {"new": [], "one": [("run", 1)], "staged": [("run", 1), ("chunk_done", 1)], "approved": [("run", 1), ("chunk_done", 1), ("approve", None)], "failed": [("run", 1), ("chunk_failed", 1)], "done": [("run", 1), ("chunk_done", 1), ("approve", None), ("run", 2), ("chunk_done", 2)]}
    steps["merged"] = steps["done"] + [("merge_ok", None)]
    steps["second"] = steps["merged"] + [("compact_ok", None), ("stage2_start", None)]
    events = [(w, k, e, c) for w, xs in steps.items() for k, (e, c) in enumerate(xs)]
    plans = spark.createDataFrame([(w, 2, True) for w in steps], "workflow_id string, chunks int, staged boolean")
    states = workflow.fold(spark.createDataFrame(events, "workflow_id string, seq long, event string, chunk_index int"), plans)
    got = {r["workflow_id"]: (r["stage1"], r["a"]) for r in states.withColumn("a", workflow.next_action()).collect()}
    assert got == {
        "new": ("ready", "run_chunk"), "one": ("chunk_running", "resume_chunk"), "staged": ("awaiting_continue", "approve"), "approved": ("ready", "run_chunk"), "failed": ("failed_recoverable", "run_chunk"),
        "done": ("ready_to_merge", "merge"), "merged": ("complete", "compact"), "second": ("complete", "complete"),
    }
    assert all(r["issues"] == [] for r in workflow.state_issues(states).collect())


def test_write_new(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(x, "k string, v string")
    status = lambda df: sorted((r["key"], r["status"]) for r in df.collect())
    where = str(tmp_path / "t")
    assert status(sinks.write_new(rows(("a", "1"), ("b", "2")), where, "k", "v")) == [("a", "created"), ("b", "created")]
    assert status(sinks.write_new(rows(("a", "1"), ("b", "x"), ("c", "3")), where, "k", "v")) == [("a", "identical"), ("b", "conflict"), ("c", "created")]
    assert sorted(tuple(r) for r in spark.read.parquet(where).collect()) == [("a", "1"), ("b", "2"), ("c", "3")]
    text = spark.createDataFrame([("a\"b", None)], "x string, y string").select(sinks.front_matter(["x", "y"])).first()[0]
    assert text == '---\nx: "a\\"b"\ny: null\n---'


def test_stream_resumes(spark, tmp_path):
    from corpusmill.streaming import events as S

    schema = "workflow_id string, seq long, event string, chunk_index int"
    folder, state = tmp_path / "in", str(tmp_path / "state")
    out = {}

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        stream = S.workflow_states(S.read_events(spark, str(folder), schema), 2)
        q = stream.writeStream.outputMode("update").option("checkpointLocation", state).foreachBatch(lambda df, _: out.update({r["workflow_id"]: (r["stage1"], r["done"]) for r in df.collect()})).trigger(availableNow=True).start()
        q.awaitTermination(120)

    run([("w", 1, "run", 1), ("w", 2, "chunk_done", 1)])
    assert out == {"w": ("ready", 1)}
    run([("w", 2, "chunk_done", 1), ("w", 3, "run", 2), ("w", 4, "chunk_done", 2), ("w", 5, "merge_ok", None)])
    assert out == {"w": ("complete", 2)}


def test_small_ones(spark):
    files = spark.createDataFrame([("/r/a",), ("/r/../x",), ("/rr/a",)], "path string")
    assert [r[0] for r in files.select(planning.inside(F.col("path"), "/r")).collect()] == [True, False, False]
    found = spark.createDataFrame([("a", True, True), ("b", True, False), ("c", True, True)], "n string, x boolean, y boolean")
    out = planning.ranked_candidates(found, {"x": 1.0, "y": 2.0}).collect()
    assert [r["n"] for r in out if r["best"]] == ["a", "c"] and all(r["tied"] for r in out)
    assert posts.status_link("https://x.com/u/status/5?s=1") == ("u", "5") and posts.status_link("https://e.org/u/status/5") is None
    plan = workflow.delete_plan(spark.createDataFrame([("a",), ("a/b/c",), ("a/b",)], "path string"), spark.createDataFrame([("a/b",)], "path string"))
    assert [(r["path"], r["allowed"]) for r in plan.collect()] == [("a/b/c", False), ("a/b", True), ("a", False)]
    assert integrity.cardinalities_agree(spark.createDataFrame([(1, 1), (1, 2)], "a int, b int"), ["a", "b"]).select("agree").collect() == [(True,), (False,)]


def test_text_files():
    read = documents.from_text
    md = read("\ufeff---\r\nTitle: T\naccount: \"Acc\"\nsource_url: https://e.org/a\nauthor:\n---\r\n# H\n\n  kept".encode(), True)
    assert (md["title"], md["author_or_account"], md["current_publisher"], md["original_url"], md["body"]) == ("T", "Acc", "Acc", "https://e.org/a", "# H\n\n  kept")
    txt = read(b"---\ntitle: T\n---\n  body", False)
    assert txt["title"] is None and txt["body"] == "---\ntitle: T\n---\nbody"
    open_block = read(b"---\ntitle: T\nbody", True)
    assert open_block["title"] is None and open_block["body"] == "---\ntitle: T\nbody"
    assert read(b"---\n---\nx", True)["body"] == "x"
    for blank in (b"", b" \n ", b"---\ntitle: T\n---\n"):
        with pytest.raises(ValueError):
            read(blank, True)


def test_posts_on_saved_pages(spark):
    loose = '<article data-testid="tweet"><div data-testid="tweetText">参考 <a href="/somebody/status/444">这条推文</a></div></article>'
    (card,) = posts.cards_of(loose)
    assert card["post_id"] is None and card["author_account"] is None and card["text"] == "参考 这条推文"
    assert posts.cards_of("<html><title>X</title></html>") == [{"problem": "no posts found"}]
    inner = '<div data-testid="tweet"><a href="/q/status/2"><time datetime="d2"></time></a><div data-testid="tweetText">inner</div></div>'
    (card,) = posts.cards_of(f'<div data-testid="tweet" data-tweet-id="9"><div data-testid="tweetText">outer</div>{inner}<p>not closed')
    assert (card["post_id"], card["text"], [q["post_id"] for q in card["quoted_posts"]], card["published_at"]) == ("9", "outer", ["2"], None)
    rows = spark.createDataFrame([("a", '<x data-testid="tweet">'), ("b", "<p>tweet"), ("c", '<meta property="og:url" content="https://x.com/u">')], "id string, html string")
    assert [r[0] for r in rows.select(posts.is_post_page(F.col("html"))).collect()] == [True, False, True]


def test_logs_out_of_place(spark):
    events = [("w", 1, "chunk_done", 1), ("w", 2, "run", 1), ("w", 2, "run", 1), ("w", 3, "approve", None), ("w", 4, "chunk_done", 1), ("w", 5, "run", 2), ("w", 6, "merge_ok", None), ("w", 7, "chunk_failed", 2), ("w", 8, "stage2_start", None)]
    plans = spark.createDataFrame([("w", 2, False), ("v", 1, False)], "workflow_id string, chunks int, staged boolean")
    states = workflow.fold(spark.createDataFrame(events, "workflow_id string, seq long, event string, chunk_index int"), plans)
    got = {r["workflow_id"]: (r["stage1"], r["completed"], r["attempts"], r["merge"], r["stage2"], r["revision"]) for r in states.collect()}
    assert got == {"w": ("failed_recoverable", [1], 2, "pending", "pending", 8), "v": ("ready", [], 0, "pending", "pending", 0)}


def test_json_files_and_pairs(spark, tmp_path):
    from corpusmill.sources import records

    (tmp_path / "a.jsonl").write_bytes("﻿{\"x\": 1}\n\n{\"x\": 2\n[3]\n{\"x\": 4}\n".encode())
    (tmp_path / "b.json").write_bytes("﻿{\n \"x\": 5\n}\n".encode())
    lines = records.read_jsonl(spark, str(tmp_path / "a.jsonl"), "x int").collect()
    assert [(r["record"] and r["record"]["x"], r["error"]) for r in lines] == [(1, None), (None, "not a JSON object"), (None, "not a JSON object"), (4, None)]
    assert [r["record"]["x"] for r in records.read_json(spark, str(tmp_path / "b.json"), "x int").collect()] == [5]
    pairs = records.article_pair(spark.createDataFrame([(1, "T", None, "body")], "id long, t string, a string, b string"), "id", F.col("t"), {"author": F.col("a")}, F.col("b"))
    records.write_article_pairs(pairs, str(tmp_path / "out"), "id")
    row = spark.read.parquet(str(tmp_path / "out" / "metadata")).join(spark.read.parquet(str(tmp_path / "out" / "bodies")), "id").first()
    assert row["body_markdown"] == "# T\n\nbody\n" and '"author":null' in row["metadata_json"] and '"output_bytes":10' in row["metadata_json"]
    with pytest.raises(Exception):
        records.write_article_pairs(pairs, str(tmp_path / "out"), "id")
    assert spark.range(1).select(workflow.now_iso()).first()[0].endswith("Z")


def test_locators_count_from_one(spark):
    rows = [(1, 1, 0, 3, "abc"), (2, 1, 0, 9, "[1:02:03] x"), (3, 1, 5, 40, "01:02:03,5 then 10:20:30 and 10:20:31.250")]
    got = fidelity.coverage_units(spark.createDataFrame(rows, "id long, idx int, start long, end long, chunk string")).collect()
    assert [r["source_locator"] for r in got] == ["字符 1–3", "1:02:03", "01:02:03,5–10:20:31.250"]


def test_combining_marks_are_no_word_characters(spark):
    text = "é é ٣ Ⅳ ½ _ नि A-b 你"
    assert one(spark, text, T.boundary_form) == "".join(c for c in text if c.isalnum() or c == "_").lower()


def test_prompts_stay_in_their_budget(spark):
    from corpusmill.operators.planning import bounded_prompt

    df = spark.createDataFrame([(1, list("abcdefghij"), list("xyz")), (2, list("abcdefghijklmnopqrstuvwxyz"), list("0123456789")), (3, None, None), (4, [], []), (5, list("abcdefghijklmnopqrstuvwxyz"), None)], "id int, t array<string>, c array<string>")
    got = {r["id"]: r for r in bounded_prompt(df, "t", "c", 20, prefix=("P",), context_prefix=("Q", "R"), separator=("~",)).collect()}
    assert "".join(got[1]["prompt"]) == "PabcdefghijQRxyz" and "".join(got[3]["prompt"]) == "P" == "".join(got[4]["prompt"])
    # 17 tokens of content: 7 for the context, 10 for the terms; with the separator one too many, so the first one goes
    assert "".join(got[2]["terms_used"]) == "abcde~vwxyz" and "".join(got[2]["context_used"]) == "3456789"
    assert "".join(got[2]["prompt"]) == "abcde~vwxyzQR3456789" and len(got[5]["prompt"]) == 20
