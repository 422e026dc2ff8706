"""Hamming search at full width, pictures, islands and as-of joins against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import frames, intervals


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("distance, bits", [(5, 64), (12, 64), (12, 63), (3, 16), (0, 64)])
def test_links_at_full_width(spark, distance, bits):
    rng = random.Random(distance)
    seeds = [rng.getrandbits(bits) for _ in range(60)] + [0, (1 << bits) - 1]
    values = seeds + [s ^ sum(1 << b for b in rng.sample(range(bits), rng.randint(0, min(bits, distance + 2)))) for s in seeds for _ in range(4)]
    df = spark.createDataFrame([(k, signed(v)) for k, v in enumerate(values)] + [(9999, None)], "id long, hash long")
    first = {}
    for k, v in enumerate(values):
        first.setdefault(v, k)
    want = {(min(i, j), max(i, j), bin(a ^ b).count("1")) for a, i in first.items() for b, j in first.items() if i != j and bin(a ^ b).count("1") <= distance}
    assert {tuple(r) for r in frames.near_links(df, distance, bits=bits).collect()} == want
    assert distance == 0 or len(want) > 30


@pytest.mark.parametrize("n", [10, 1000, 10**6, 10**9])
@pytest.mark.parametrize("distance", [0, 2, 5, 12])
def test_parts_miss_nothing(n, distance):
    """The errors of the most even spread still leave a part within the radius."""
    parts, radius = frames.parts_for(distance, 64, n)
    assert distance // parts <= radius
    assert len(set(frames.balls(9, radius))) == sum(math.comb(9, r) for r in range(radius + 1))


def test_very_many_equal_hashes(spark):
    """A million equal hashes are one representative and a million members."""
    df = spark.range(1_000_000).select("id", F.when(F.col("id") % 1000 == 0, F.col("id")).otherwise(F.lit(0xFFFFFFF << 32)).alias("hash"))
    out = frames.greedy_frames(df, 2).agg(F.count("*"), F.count_if("kept"), F.count_if(F.col("duplicate_of") == 1)).first()
    assert out[0] == 1_000_000 and out[2] >= 998_999


def picture(rng, h, w, kind):
    if kind == "flat":
        return [[128] * w for _ in range(h)]
    if kind == "page":
        return [[255 if (x + y) % 7 else 0 for x in range(w)] for y in range(h)]
    return [[rng.randrange(256) for _ in range(w)] for _ in range(h)]


def brute(p):
    h, w = len(p), len(p[0])
    small = []
    for y in range(8):
        for x in range(9):
            s = sum(max(0, min((i + 1) * 8, (y + 1) * h) - max(i * 8, y * h)) * max(0, min((j + 1) * 9, (x + 1) * w) - max(j * 9, x * w)) * p[i][j] for i in range(h) for j in range(w))
            small.append((2 * s + h * w) // (2 * h * w))
    value = sum(1 << (8 * y + x) for y in range(8) for x in range(8) if small[9 * y + x] > small[9 * y + x + 1])
    flat = [v for r in p for v in r]
    mean = sum(flat) / len(flat)
    entropy = -sum(flat.count(v) / len(flat) * math.log2(flat.count(v) / len(flat)) for v in set(flat))
    edge = 0
    for y in range(h):
        for x in range(w):
            rim = y in (0, h - 1) or x in (0, w - 1)
            edge += p[y][x] if rim else max(0, min(255, 9 * p[y][x] - sum(p[y + a][x + b] for a in (-1, 0, 1) for b in (-1, 0, 1))))
    return signed(value), min(1, math.sqrt(sum((v - mean) ** 2 for v in flat) / len(flat)) / 96), min(1, entropy / 8), min(1, edge / len(flat) / 64), sum(v >= 210 for v in flat) / len(flat)


def test_pictures(spark):
    rng = random.Random(5)
    sizes = [(8, 9), (16, 18), (11, 13), (5, 4), (1, 1), (2, 7), (30, 20)]
    rows = [(k, picture(rng, h, w, kind)) for k, (h, w, kind) in enumerate((h, w, kind) for h, w in sizes for kind in ("flat", "page", "noise"))]
    df = spark.createDataFrame(rows + [(99, None)], "id int, p array<array<int>>")
    got = {r["id"]: r for r in df.select("id", frames.image_hash(F.col("p")).alias("hash"), frames.image_statistics(F.col("p")).alias("s"), frames.image_hint(frames.image_statistics(F.col("p"))).alias("hint")).collect()}
    for k, p in rows:
        value, contrast, entropy, edge, bright = brute(p)
        s = got[k]["s"]
        assert got[k]["hash"] == value
        assert (s["contrast"], s["entropy"], s["edge"], s["bright"]) == pytest.approx((contrast, entropy, edge, bright), abs=1e-9)
        assert got[k]["hint"] == frames.HINTS[0 if bright >= 0.45 and edge >= 0.05 else 1 if entropy >= 0.55 else 2]
    assert got[99]["s"] is None or got[99]["s"]["entropy"] is None


def fold(rows):
    """The rule as it is stated: one by one against the last that was kept."""
    from difflib import SequenceMatcher

    kept = []
    for r in sorted(rows, key=lambda r: (r[1], r[2], r[5], r[3])):
        r = [*r, False]
        last = kept[-1] if kept else None
        if last and last[5] != r[5] and min(last[2], r[2]) > max(last[1], r[1]):
            a, b = ("".join(c for c in x[3] if c.isalnum() or c == "_").lower() for x in (last, r))
            ratio = SequenceMatcher(None, a, b).ratio() if a and b else 0
            if ratio >= 0.9:
                if (-99 if r[4] is None else r[4]) > (-99 if last[4] is None else last[4]):
                    kept[-1] = r
                continue
            r[6] = ratio >= 0.65
        kept.append(r)
    return [(k, *r[1:4], r[5], r[6]) for k, r in enumerate(kept, 1)]


@pytest.mark.parametrize("slot", [600_000, 50])
def test_islands_are_the_fold(spark, slot):
    rng = random.Random(slot)
    texts = ["hello wide world again", "Hello, wide world again!", "hello wide word again", "something else", "alpha beta gamma delta", "alpha beta other delta", ""]
    rows = []
    for media in range(12):
        for _ in range(rng.randint(1, 60)):
            start = rng.randrange(0, 900)
            rows.append((media, start, start + rng.choice([0, 5, 10, 40]), rng.choice(texts), rng.choice([None, -0.5, -0.2, -0.1]), rng.randint(1, 3)))
    rows = list({(r[0], r[1], r[2], r[5], r[3]): r for r in rows}.values())
    df = spark.createDataFrame(rows, "media_id long, start_ms long, end_ms long, text string, avg_logprob double, chunk_index int").repartition(5)
    got = {}
    for r in intervals.merge_segments(df, slot_ms=slot).orderBy("media_id", "id").collect():
        got.setdefault(r["media_id"], []).append((r["id"], r["start_ms"], r["end_ms"], r["text"], r["chunk_index"], r["warning"] is not None))
    assert got == {m: fold([r for r in rows if r[0] == m]) for m in range(12)}
    assert intervals.merge_segments(df.where("false")).collect() == []


def test_a_long_recording_is_spread(spark):
    """One recording of 200,000 segments: no task sorts or folds them all."""
    rows = spark.range(200_000).select(F.lit(1).cast("long").alias("media_id"), (F.col("id") * 100).alias("start_ms"), (F.col("id") * 100 + 90).alias("end_ms"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"), F.lit(-0.5).alias("avg_logprob"), F.lit(1).alias("chunk_index"))
    twice = rows.union(rows.select("media_id", F.col("start_ms") + 1, F.col("end_ms") + 1, "text", F.lit(-0.1), F.lit(2)))
    out = intervals.merge_segments(twice).agg(F.count("*"), F.min("chunk_index"), F.max("id"), F.count_distinct("id")).first()
    assert tuple(out) == (200_000, 2, 200_000, 200_000)
    slots = intervals.islands(twice).groupBy("media_id", "_slot").count().agg(F.max("count")).first()[0]
    assert slots <= 12_000


def test_as_of_join(spark):
    rng = random.Random(8)
    plan = [(m, k + 1, a, b) for m in range(6) for k, (a, b) in enumerate((x, x + 250) for x in range(0, 1000, 250)) if not (m == 3 and k == 1)]
    seg = [(rng.randint(0, 7), s, s + rng.choice([0, 1, 2, 30]), f"s{k}") for k in range(400) for s in [rng.randrange(0, 1005)]] + [(2, 1000, 1000, "end"), (2, 250, 250, "border"), (2, 1002, 1004, "behind")]
    plans = spark.createDataFrame(plan, "m int, idx int, core_start_ms long, core_end_ms long")
    df = spark.createDataFrame(seg, "m int, start_ms long, end_ms long, name string")
    want = []
    for m, s, e, name in seg:
        cores = [p for p in plan if p[0] == m]
        mid = (s + e) // 2
        found = [p[1] for p in cores if p[2] <= mid < p[3]] or [p[1] for p in cores if p[3] == mid == max(c[3] for c in cores)]
        if cores:
            want.append((name, found[0] if found else None))
    for slot in (600_000, 100):
        got = intervals.own_segments(df, plans, "m", slot_ms=slot)
        assert got.columns == ["m", "start_ms", "end_ms", "name", "idx"]
        assert sorted(((r["name"], r["idx"]) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_links_with_copies(spark):
    """Every frame is there: near representatives, and each copy with its own."""
    df = spark.createDataFrame([(4, 0b111), (2, 0b111), (9, 0b111), (3, 0b110), (7, -1), (1, None)], "id long, hash long")
    want = [(2, 3, 1), (2, 4, 0), (2, 9, 0)]
    assert sorted(map(tuple, frames.links_and_copies(df, 5).collect())) == want
    # ids may repeat with other hashes: each pair of hashes is a row
    df = spark.createDataFrame([(1, 0), (1, 1), (2, 3)], "id long, hash long")
    assert sorted(map(tuple, frames.links_and_copies(df, 5).collect())) == [(1, 1, 1), (1, 2, 1), (1, 2, 2)]
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "id long, hash long")
    assert sorted(map(tuple, frames.links_and_copies(df, 5).collect())) == [(1, 1, 2), (1, 2, 1), (1, 2, 1)]
