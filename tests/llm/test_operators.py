"""The operators on small tables, with nulls, empty texts, ties, repeated rows, no rows and clashing columns."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import ann, chat, licenses, line_dedup, neardup, packing, piece_codec, quality, token_counts, token_files
from corpusmill.llm.registry import tokenizer_file
from corpusmill.llm.shared import Scratch, components

WORDS = "the of and to in is that was for on are as with be by at from they have this".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, cls int, shard int, _line int"


def sentence(k, n=60):
    rng = np.random.default_rng(k)
    return " ".join(f"{WORDS[i % 20]}{i}" for i in rng.integers(0, 5000, n))


BASE = sentence(1, 120)
NEAR = BASE.replace(BASE.split()[60], "changed", 1)
ROWS = [
    (3, BASE), (1, NEAR), (7, BASE), (7, BASE), (9, sentence(2)), (10, None), (11, ""), (12, "  \n "), (None, BASE), (13, "one two"), (14, "ONE  two"),
    (20, "long " * 5000 + sentence(3)), (21, f"{sentence(4)}\nshort line\n{sentence(5)}"), (22, f"{sentence(6)}\n{sentence(4)}\nshort line\n{sentence(7)}"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if (i or 0) % 2 else None, "s", len(t or ""), "x", 1, 2, 3) for i, t in ROWS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(df):
    return [tuple(r) for r in df.collect()]


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (20, 21), (21, 20), (7, 7), (None, 1)], "a long, b long")
    chain = spark.createDataFrame([(100 + k, 101 + k) for k in range(40)], "a long, b long")
    found = dict(plain(components(edges.union(chain), Scratch(spark))))
    assert {k: v for k, v in found.items() if k < 100} == {3: 3, 4: 3, 5: 3, 9: 3, 20: 20, 21: 20}
    assert set(found[k] for k in range(100, 141)) == {100}


def test_packing(spark, docs, none):
    file = tokenizer_file("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(file)
    out = packing.pack_documents(docs, file, packing.Limits(tokens=128))
    rows = out.collect()
    want = Counter()
    for i, text in ROWS:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 128 or min(128, len(ids))
        for k, (a, b) in enumerate(zip([0, *range(first, len(ids), 128)], range(first, len(ids) + 1, 128))):
            want[i, k, a, b - a, np.array(ids[a:b], "<u4").tobytes()] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in rows) == want
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in packing.assemble(out).collect()}
    for r in rows:
        assert whole[r["sequence_id"]][4 * r["offset"] : 4 * (r["offset"] + r["length"])] == bytes(r["ids"])
    assert sum(map(len, whole.values())) == sum(4 * r["length"] for r in rows) and max(map(len, whole.values())) <= 512
    assert packing.pack_documents(none, file).count() == 0
    odd = spark.createDataFrame([(1, 0, 5, "a"), (2, 0, None, "b"), (3, 0, 0, "c")], "doc_id long, piece int, length long, offset string")
    assert [(r["doc_id"], r["offset"]) for r in packing.pack(odd).orderBy("doc_id").collect()] == [(1, 0), (2, None), (3, None)]


def test_packing_under_capacities(spark):
    from corpusmill.llm.registry import packing_under_capacities

    bins = {}
    for r in packing_under_capacities(spark, "/root/testdata/sf0.001").collect():
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    full = [0, 0, 0]
    for rows in bins.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        cost = sum(n * n for _, n in rows)
        assert at <= 1024 and len(rows) <= 4 and cost <= 450_000
        full = [full[0] + (at > 1000), full[1] + (len(rows) == 4), full[2] + (cost > 440_000)]
    assert all(full)


def test_token_files(spark, docs, none):
    from tokenizers import Tokenizer

    file = tokenizer_file("word_bpe_49k.json")
    t = Tokenizer.from_file(file)
    path = Scratch(spark).path("files")
    token_files.write(token_files.tokenize(docs, file, 2), path, ids_per_shard=2000)
    rows = sorted(token_files.read(spark, path).collect(), key=lambda r: r["start"])
    order = [-1 if r["doc_id"] is None else r["doc_id"] for r in rows]
    assert order == sorted(-1 if i is None else i for i, _ in ROWS)
    at = 0
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert r["start"] == at
        at += len(ids)
        assert ids in [t.encode(x or "", add_special_tokens=False).ids + [2] for i, x in ROWS if i == r["doc_id"]]
    path = Scratch(spark).path("none")
    token_files.encode_documents(none, file, 2, path)
    assert token_files.read(spark, path).count() == 0
    odd = spark.createDataFrame([(-(1 << 63), "a"), (None, "b c"), (None, None), (5, "z"), (5, "y y"), (5, "z")], "doc_id long, text string")
    path = Scratch(spark).path("odd")
    token_files.encode_documents(odd, file, 2, path)
    got = [(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in sorted(token_files.read(spark, path).collect(), key=lambda r: r["start"])]
    assert [i for i, _ in got] == [None, None, -(1 << 63), 5, 5, 5] and got[0][1] == [2]
    assert Counter((i, tuple(x)) for i, x in got) == Counter((r["doc_id"], (*t.encode(r["text"] or "", add_special_tokens=False).ids, 2)) for r in odd.collect())
    with pytest.raises(ValueError):
        token_files.parse(b"no page at all, really")


def test_piece_codec(docs, none):
    import sentencepiece

    file = tokenizer_file("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=file)
    want = Counter((i, tuple(sp.encode(t or "")), sp.decode(sp.encode(t or ""))) for i, t in ROWS)
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in piece_codec.round_trip(docs, file).collect()) == want
    two = piece_codec.decode(piece_codec.encode(docs, file), file)
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in two.collect()) == want
    assert piece_codec.round_trip(none, file).count() == 0


def brute_components(rows, percent):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if None not in (i, j) and i < j and a and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return Counter((i, len(s), None if i is None else find(i)) for i, s in sets)


def test_near_duplicates(spark, docs, none):
    rng = np.random.default_rng(8)
    near = []
    base = sentence(50, 150).split()
    for k in range(60):  # a group in which some pairs are near and some are not
        words = list(base)
        for at in rng.integers(0, 150, rng.integers(1, 5)):
            words[at] = f"v{k}x{at}"
        near.append((1000 + k, " ".join(words)))
    rows = ROWS + near
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df).collect())
    assert got == brute_components(rows, 85)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in neardup.near_duplicates(docs).collect())
    assert neardup.near_duplicates(none).count() == 0


def test_blocks_split_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    base = sentence(70, 100).split()
    rows = []
    for k in range(50):
        words = list(base)
        words[k] = f"w{k}"
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df).collect())
    assert got == brute_components(rows, 85)


def brute_lines(rows, min_lines, min_words):
    """By document, the lines to remove and the copied run that begins at each place: (place, lines), the longest one.

    Every run of every length is looked for in all that comes before it.  Rows with equal id and text count once;
    order is id (null first), then, as here, one text for each id.
    """
    texts = sorted(((i, t.split("\n")) for i, t in {(i, t) for i, t in rows} if t is not None), key=lambda x: (x[0] is not None, x[0] or 0))
    out, first = {}, {}
    for at, (i, ls) in enumerate(texts):
        gone, runs = out.setdefault(i, (set(), {}))
        for k in range(len(ls)):
            for n in range(1, len(ls) - k + 1):
                doc, place = first.setdefault(tuple(ls[k : k + n]), (at, k))
                if (n >= min_lines or n == 1 and len(ls[k].split()) >= min_words) and (doc != at or place + n <= k):
                    gone.update(range(k, k + n))
                    if n >= min_lines:
                        runs[k] = n
    return out


def brute_runs(gone, runs):
    """The copied runs that no other one holds, and the lines that go alone."""
    maximal = [(k, n) for k, n in runs.items() if not any(j < k and j + m >= k + n for j, m in runs.items())]
    covered = {k + j for k, n in runs.items() for j in range(n)}
    return len(maximal) + len(gone - covered)


@pytest.mark.parametrize("min_lines, piece", [(1, 1 << 16), (2, 1 << 16), (3, 1 << 16), (2, 7), (2, 3), (5, 11)])
def test_line_dedup(spark, docs, none, min_lines, piece):
    rng = np.random.default_rng(min_lines)
    lines = [f"line {k}" for k in range(4)] + [sentence(90, 55), ""]
    rows = list(ROWS) + [(100 + k, "\n".join(lines[i] for i in rng.integers(0, 6, rng.integers(1, 12)))) for k in range(40)]
    rows += [(200, "X\nX"), (201, "Y\nY\nY"), (202, "A\nZ\nZ\nZ\nB"), (203, "W\nW\nW\nW\nW"), (204, "\n".join(f"copied {k}" for k in range(37))), (205, "\n".join(["own", *(f"copied {k}" for k in range(3, 37)), "end"]))]
    # ABC and BCD were said before, ABCD was not: two runs that overlap; a depth of two lines alone would see one
    rows += [(300, "A1\nB1\nC1"), (301, "B1\nC1\nD1"), (302, "A1\nB1\nC1\nD1"), (303, "A1\nB1\nown\nC1\nD1")]
    df = spark.createDataFrame([(i, t, "en", "s", 0, "x", 1, 2, 3) for i, t in rows], SCHEMA)
    want = brute_lines(rows, min_lines, 50)
    for r in line_dedup.dedup_lines(df, min_lines, 50, piece=piece).collect():
        text = next(t for i, t in rows if i == r["doc_id"])
        if text is None:
            assert r["text"] is None and r["n_lines"] == 0
            continue
        gone, runs = want[r["doc_id"]]
        assert r["text"] == "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
        assert (r["n_lines"], r["n_removed"]) == (text.count("\n") + 1, len(gone))
        assert r["n_runs"] == brute_runs(gone, runs)
        if min_lines == 2 and r["doc_id"] in (200, 201, 202, 203, 302):
            assert r["text"] == {200: "X\nX", 201: "Y\nY\nY", 202: "A\nZ\nZ\nZ\nB", 203: "W\nW", 302: ""}[r["doc_id"]]
        if min_lines == 2 and r["doc_id"] in (302, 303):
            assert r["n_runs"] == 2
    assert line_dedup.dedup_lines(none).count() == 0


def test_suffix_array(spark):
    """Ranks are the order of all suffixes with a repeated line, and neighbours share what they share."""
    rng = np.random.default_rng(4)
    rows = [(k, "\n".join(f"l{x}" for x in rng.integers(0, 4, rng.integers(1, 30)))) for k in range(25)]
    scratch = Scratch(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lines = line_dedup.repeated_lines(line_dedup.line_ids(df, "doc_id", "text", 50), scratch)
    array, levels = line_dedup.ranked(lines, scratch)
    place = {r["pos"]: (r["_doc"], r["_line"]) for r in lines.collect()}
    text = dict((i, t.split("\n")) for i, t in rows)
    suffix = lambda p: text[place[p][0]][place[p][1] :]
    order = [r["pos"] for r in array.orderBy("rank").collect()]
    assert [r["rank"] for r in array.orderBy("rank").collect()] == list(range(len(place))) and sorted(order) == sorted(place)

    def shared(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    common = [0] + [shared(suffix(a), suffix(b)) for a, b in zip(order, order[1:])]
    # a suffix shares as much with a neighbour as with any other one
    for k, p in enumerate(order):
        best = max(shared(suffix(p), suffix(q)) for q in order if q != p)
        assert max(common[k], common[k + 1] if k + 1 < len(order) else 0) == best
    got = {r["rank"]: r["h"] for r in line_dedup.common_prefixes(array, levels, 2, scratch).collect()}
    assert all(h == common[k] for k, h in got.items() if h >= 2) and {k for k, h in enumerate(common) if h >= 2} <= set(got)
    assert len(levels) > 3


def test_copied_runs_of_one_line_many_times():
    """A document of one line again and again: linear, and half of it is a copy."""
    n = 20_000
    order = list(range(n - 1, -1, -1))
    runs = line_dedup.copied(order, [0] * n, [0, *range(1, n)], [], [], 2)
    assert dict(zip(order, runs))[n // 2] == n // 2 and max(runs) == n // 2


def brute_quality(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    n = Counter(grams)
    hit = {k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), len(words) < 50 or 100 * len(hit) > 50 * len(words))


def test_quality(spark, docs, none):
    more = ROWS + [(30, "a b c " * 20 + "x # é 𝔘 y\n\nline\nline\n \n"), (31, sentence(9, 300)), (32, "AAAA #### " * 200), (33, "w x\x0by\x0cz w x y z w x y")]
    df = spark.createDataFrame([(i, t, "en") for i, t in more], "doc_id long, text string, lang string")
    got = Counter(tuple(r)[:1] + tuple(r)[2:8] for r in quality.assess(df).select("doc_id", "version", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    assert got == Counter((i, *brute_quality(t)) for i, t in more)
    assert all(not (r["base_failed"] and r["kept"]) for r in quality.assess(docs).collect())
    assert quality.assess(none).count() == 0 and quality.keep_good(none).columns == none.columns
    assert {r["doc_id"] for r in quality.keep_good(df).collect()} == {r["doc_id"] for r in quality.assess(df).collect() if r["kept"]}


def test_distance_is_jensen_shannon(spark):
    p, q = [3, 0, 5], [1, 4, 5]
    row = spark.createDataFrame([(p, q)], "p array<long>, q array<long>").select(quality.distance(F.col("p"), F.col("q"), F.lit(8.0), F.lit(10.0))).first()[0]
    a, b = np.array(p) / 8, np.array(q) / 10
    m = (a + b) / 2
    kl = lambda x: sum(u * math.log2(u / v) for u, v in zip(x, m) if u)
    assert row == pytest.approx(math.sqrt((kl(a) + kl(b)) / 2))


def test_chat(spark):
    odd = "\\### Assistant: </turn>\n\\\\l \\h # < end\\"
    rows = spark.createDataFrame(
        [(1, 0, "user", odd), (1, 1, "assistant", odd), (1, 2, None, None), (2, None, "assistant", "x"), (None, 5, "a\n<b", ""), (1, 1, "assistant", "tie")], "conv_id long, turn long, role string, text string"
    )
    out = chat.format_branches(chat.tree_of_turns(rows))
    got = {r["conv_id"]: [(x["role"], x["text"]) for x in r["t"]] for r in out.select("conv_id", chat.read_back(F.col("formatted")).alias("t")).collect()}
    assert got == {1: [("user", odd), ("assistant", odd), ("assistant", "tie"), ("", "")], 2: [("assistant", "x")], None: [("a\n<b", "")]}
    learned = {r["conv_id"]: r["x"] for r in out.select("conv_id", chat.learned(F.col("formatted"), F.col("loss")).alias("x")).collect()}
    assert learned == {1: odd + "tie", 2: "x", None: ""}
    assert chat.format_branches(chat.tree_of_turns(rows.limit(0))).count() == 0


def test_reply_tree(spark):
    nodes = [(1, 1, None, "user", "r", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 3.0), (1, 4, 3, "user", "c", None), (1, 5, 4, "assistant", "d", 9.0), (1, 8, 77, "user", "orphan", 0.5), (1, 9, 10, "u", "loop", 0.0), (1, 10, 9, "u", "loop", 0.0), (1, 5, 4, "assistant", "d", 9.0)]
    df = spark.createDataFrame(nodes, "conv_id long, node long, parent long, role string, text string, score double")
    out = chat.format_branches(df, top=5).orderBy("branch_rank").collect()
    assert [(r["leaf"], r["n_turns"], r["branch_score"]) for r in out] == [(5, 4, 3.0), (2, 2, 0.5), (8, 1, 0.5)]
    assert out[0]["formatted"] == "### user\nr</turn>\n### assistant\nb</turn>\n### user\nc</turn>\n### assistant\nd</turn>\n"


def test_token_counts(spark, docs, none):
    from tokenizers import Tokenizer

    file = tokenizer_file("byte_bpe_50k.json")
    t = Tokenizer.from_file(file)
    more = ROWS + [(50, "é\n\n\n𝔘x  y\n<|endoftext|>\n"), (51, "\n")]
    df = spark.createDataFrame([(i, x, 5) for i, x in more], "doc_id long, text string, section int")
    got = Counter(tuple(r) for r in token_counts.count_tokens(df, file).collect())
    want = Counter()
    for i, x in more:
        x = x or ""
        e = t.encode(x, add_special_tokens=False)
        raw = x.encode()
        sizes = token_counts.token_bytes(file)[e.ids]
        ends = np.cumsum(sizes).tolist()
        starts = [b - s for b, s in zip(ends, sizes.tolist())]
        lines = x.split("\n")
        spans, at = [], 0
        for k, line in enumerate(lines):
            stop = at + len(line) + (k < len(lines) - 1)
            if stop > at or len(lines) == 1:
                spans.append((at, stop))
            at = stop
        byte = [(len(x[:a].encode()), len(x[:b].encode())) for a, b in spans]
        count, cross = [0] * len(spans), [0] * len(spans)
        for a, b in zip(starts, ends):
            shares = [max(0, min(b, q) - max(a, p)) for p, q in byte]
            k = shares.index(max(shares))
            count[k] += 1
            cross[k] += shares[k] < b - a
        assert len(raw) == (ends[-1] if ends else 0)
        want.update((i, k, a, b, n, c) for k, ((a, b), n, c) in enumerate(zip(spans, count, cross)))
    assert got == want
    own = spark.createDataFrame([(1, "alpha beta gamma", [(0, 5), (11, 99), (3, 7), None]), (2, None, None)], "doc_id long, text string, s array<struct<start:long,end:long>>")
    rows = sorted(token_counts.count_tokens(own, file, "s").collect())
    assert sum(r["n_tokens"] for r in rows) == len(t.encode("alpha beta gamma").ids) and {r["section"] for r in rows} >= {0, 1, 2, 3}
    assert token_counts.count_tokens(none, file).count() == 0


def test_licenses(spark):
    rows = [
        ("a/LICENSE", "Released under the MIT License.", True), ("a/b/x.py", "code", False), ("a/b/y.py", "body\nLicensed under the Apache License, Version 2.0. And more text follows here.", False),
        ("a/b/c/LICENSE", "Licensed under CC BY-NC 4.0.", True), ("a/b/c/d/z", None, False), ("top.txt", "", False), (None, "Released under the MIT License.", True), ("b/q", "a licence of words about nothing", False),
        ("a/b/x.py", "code", False),
    ]
    df = spark.createDataFrame(rows, "path string, text string, is_file boolean").withColumn("license", F.lit("clash"))
    got = Counter((r["path"], r["own_license"], r["license"], r["from_dir"]) for r in licenses.scan(df, F.col("is_file")).collect())
    assert got == Counter(
        [
            ("a/LICENSE", "MIT", "MIT", None), ("a/b/x.py", None, "MIT", "a"), ("a/b/x.py", None, "MIT", "a"), ("a/b/y.py", "Apache-2.0", "Apache-2.0", None), ("a/b/c/LICENSE", "CC-BY-NC-4.0", "CC-BY-NC-4.0", None),
            ("a/b/c/d/z", None, "CC-BY-NC-4.0", "a/b/c"), ("top.txt", None, None, None), (None, None, None, None), ("b/q", None, None, None),
        ]
    )
    assert licenses.scan(df.limit(0), F.col("is_file")).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(3)
    points = rng.standard_normal((400, 8))
    rows = [(i, [float(x) for x in p], "c") for i, p in enumerate(points)] + [(1000 + k, [float(x) for x in points[5]], "c") for k in range(30)]
    rows += [(2000, None, "c"), (2001, [0.0] * 8, "c"), (2002, [float("nan")] * 8, "c"), (2003, [None] + [1.0] * 7, "c"), (2004, [1.0], "c"), (2010, [2.0, 3.0], "c"), (2011, [5.0, 7.0], "c"), (2020, [2.0, 4.0], "c"), (None, [1.0] * 8, "c"), (3, rows[3][1], "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    found = ann.nearest(df, F.col("vec_id") % 10 == 0, 5, ann.Forest(fraction=100.0, leaf=16)).collect()
    valid = {i: np.array(v) for i, v, _ in rows if i is not None and v and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)}
    got = {}
    for r in found:
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    assert set(got) == {i for i in valid if i % 10 == 0} | {2010, 2020}
    assert got.pop(2010) == [(1, 1.0, 2020), (2, 5.0, 2011)] and [x[2] for x in got.pop(2020)] == [2010, 2011]
    for q, rows_ in got.items():
        want = sorted((float(np.sqrt(((valid[q] - v) ** 2).sum())), i) for i, v in valid.items() if i != q)[:5]
        assert [(k, pytest.approx(s), i) for k, (s, i) in enumerate(want, 1)] == sorted(rows_)
    part = ann.nearest(df, F.col("vec_id") % 10 == 0, 5).collect()
    true = {(r["query_id"], r["vec_id"]) for r in found}
    assert len(true & {(r["query_id"], r["vec_id"]) for r in part}) >= 0.9 * len(true)
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0


def test_nearest_finds_nine_of_ten(spark):
    """The registered query with its production parameters, all queries, against brute force."""
    from corpusmill.llm.registry import op1_projection_forest

    sf = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect() if r["embedding"]]
    ids, points = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    found = {(r["query_id"], r["vec_id"]): r["score"] for r in op1_projection_forest(spark, sf).collect()}
    hits = total = 0
    for q, v in rows:
        if q % 100 == 0:
            far = np.sqrt(((points - v) ** 2).sum(axis=1))
            far[ids == q] = np.inf
            best = np.lexsort((ids, far))[:10]
            total += 10
            hits += sum((q, ids[b]) in found and abs(found[q, ids[b]] - far[b]) < 1e-9 for b in best)
    assert total and hits >= 0.9 * total


def test_pipeline(spark, tmp_path):
    """Natural documents, and some for each stage to take out: every stage removes some and leaves some."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    own = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r["doc_id"]: (r["text"], r["lang"]) for r in own.collect()}
    long = [t for t, _ in rows.values() if 100 < len((t or "").split()) < 2000]
    most = max(rows)
    for k in range(3):
        words = long[k].split()  # near copies, of one line each
        rows |= {most + 31 + 10 * k + j: (" ".join([*words[: len(words) // j], "changed", *words[len(words) // j + 1 :]]), "en") for j in (2, 3)}
        rows[most + 11 + k] = (long[k + 3] + "\n" + "\n".join(long[k + 4].split("\n")[:9]), "en")  # copied lines
    rows |= {most + 20: (None, "en"), most + 21: ("", None), most + 22: ("\n\n".join(["a line"] * 40), "en")}
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, (t, lang) in rows.items()], schema).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    step = corpus_pipeline.quality_rules(spark, docs, str(tmp_path))
    assert step.columns == docs.columns
    kept = {r["doc_id"] for r in step.collect()}
    assert kept <= {i for i, (t, _) in rows.items() if not brute_quality(t)[5]} and 0 < len(kept) < len(rows)
    good = [(i, rows[i][0]) for i in sorted(kept)]
    gone = {i: g for i, (g, _) in brute_lines(good, 2, 50).items()}
    assert any(gone.values())
    left = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])) for i, t in good if len(gone[i]) < t.count("\n") + 1]
    component = {a: c for a, _, c in brute_components(left, 80)}
    survivors = [(i, t) for i, t in left if component[i] == i]
    assert 0 < len(survivors) < len(left) <= len(good)
    t = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    want = {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in survivors}
    total = Counter()
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        total[r["doc_id"]] += r["length"]
    assert dict(total) == want
