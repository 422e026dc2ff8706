"""Repair of conversations against all edits of each place, for conversations in one task and in blocks."""

import hashlib
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, x string, block int, n string, place string"
BLANKS = " \t\n\x0b\x0c\r"


def brute(rows):
    """blank, duplicate, truncated, illegal, cost, audit, turns of rows (role, text) in order."""
    kinds, seen = [], set()
    for role, text in rows:
        bare = text.rstrip(BLANKS)
        kinds.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    to = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    names = {"u": "user", "a": "assistant"}

    @cache
    def best(i, q, puts=0):
        """The least (cost, audit, turns) from row i on, after a turn with the initial q."""
        ways = [(0, "", ())] if i == len(rows) and q in ("", "a") else []
        if puts < 3:
            for r in "ua":
                if (q, r) in to:
                    c, a, t = best(i, r, puts + 1)
                    ways.append((c + 5, "I" + a, ((names[r], ""), *t)))
        if i < len(rows):
            c, a, t = best(i + 1, q)
            ways.append((c + 2, "D" + a, t))
            if kinds[i] in ("", "truncated"):
                cut = 5 * (kinds[i] == "truncated")
                if (q, rows[i][0][:1]) in to:
                    c, a, t = best(i + 1, rows[i][0][:1])
                    ways.append((c + cut, "K" + a, (rows[i], *t)))
                for r in "ua":
                    if (q, r) in to:
                        c, a, t = best(i + 1, r)
                        ways.append((c + cut + 1, "R" + a, ((names[r], rows[i][1]), *t)))
        return min(ways, default=(10**9, "", ()))

    pairs = [(a[0][:1] + b[0][:1]) for a, b in zip(rows, rows[1:])]
    return (*(kinds.count(k) for k in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") or len(p) < 2 for p in pairs), *best(0, ""))


def rows_of(seed, n_conversations=60):
    rng = np.random.default_rng(seed)
    out = []
    for c in range(n_conversations):
        cid = None if c == 0 else c
        for k in range(int(rng.integers(1, 14))):
            role = str(rng.choice(["user", "assistant", "system", "tool", "", "u"], p=[0.36, 0.36, 0.12, 0.08, 0.04, 0.04]))
            text = str(rng.choice(["Yes.", "No!  ", "cut off", "", " \n\t", "Why?\n", "x" * 50 + "."])) + ("" if rng.random() < 0.5 else f" {k}.")
            turn = None if rng.random() < 0.05 else int(rng.integers(0, 20))
            again = 1 + int(rng.random() < 0.15) * 2
            out += [(cid, turn, None if rng.random() < 0.03 else role, None if rng.random() < 0.03 else text, "x", 1, "n", "p")] * again
    return out


def wanted(df):
    filled = df.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    by = {}
    for r in filled.withColumn("h", F.xxhash64("role", "text")).collect():
        by.setdefault(r["conv_id"], []).append(((r["turn"] is not None, r["turn"] or 0, r["h"], r["role"], r["text"]), r["turn"]))
    out = {}
    for c, rows in by.items():
        rows.sort(key=lambda x: x[0])
        *counts, cost, audit, turns = brute([k[3:] for k, _ in rows])
        numbers = {t for _, t in rows if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        out[c] = (gaps, *counts, cost, audit, turns)
    return out


@pytest.mark.parametrize("most_rows, block", [(50_000, 50_000), (5, 4), (9, 3)])
def test_cheapest_edits(spark, most_rows, block):
    df = spark.createDataFrame(rows_of(most_rows), SCHEMA).repartition(3)
    want = wanted(df)
    done = repair.repair(df, most_rows=most_rows, block=block)
    said = {r["conv_id"]: tuple(r)[1:-1] for r in done.conversations.collect()}
    assert said == {c: x[:-1] for c, x in want.items()}
    lines = {}
    for r in sorted(done.lines.collect(), key=lambda r: (r["block"], r["place"], r["nth"])):
        lines.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert lines == {c: list(x[-1]) for c, x in want.items() if x[-1]}
    digest = {r["conv_id"]: r["repaired_sha256"] for r in done.conversations.collect()}
    assert digest == {c: hashlib.sha256("\n".join(f"{a}:{b}" for a, b in x[-1]).encode()).hexdigest() for c, x in want.items()}


def test_one_conversation_of_copies(spark):
    """One row thousands of times, and a long text, in one conversation that goes by blocks."""
    rows = [(7, 1, "user", "Hm.", "x", 1, "n", "p")] * 3000 + [(7, k, "assistant" if k % 2 else "user", f"{k} " + "long " * 40_000 + ".", "x", 1, "n", "p") for k in range(2, 6)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    plain = repair.repair(df).conversations.collect()
    split = repair.repair(df, most_rows=100, block=2).conversations.collect()
    assert plain == split and plain[0]["duplicate"] == 2999 and plain[0]["audit"].count("D") >= 2999
    by_size = repair.repair(df, most_chars=1000, block=2).conversations.collect()
    assert by_size == plain


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", "One. Two! Three?", "x", 1, "n", "p") for c in (None, 1, 2, 3) for t in (None, *range(40))]
    df = spark.createDataFrame(rows, SCHEMA)
    want = []
    for c, t, role, text, *_ in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind:
            want += [(c, t, "user" if kind == 4 else role, {1: "", 2: "One Two Three"}.get(kind, text))] * (2 if kind == 3 else 1)
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    assert sorted((tuple(r) for r in repair.damaged(df).collect()), key=key) == sorted(want, key=key)


def test_nothing_left(spark):
    """No rows; and conversations of which the damage leaves none."""
    assert repair.repair_damaged(spark.createDataFrame([], SCHEMA)).collect() == []
    import zlib

    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    out = repair.repair_damaged(spark.createDataFrame([(gone, 0, "user", "Hm.", "x", 1, "n", "p")], SCHEMA)).collect()
    assert [tuple(r) for r in out] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
