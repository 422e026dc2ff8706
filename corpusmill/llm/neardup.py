"""Near-duplicate documents by MinHash bands, sequential Bayesian pruning and exact verification.

1. One pass over the texts gives each document its exact class (128-bit hash of its words), the size of its
   shingle set, a byte of each MinHash and the keys of its bands.  Exact copies count once from here on.
2. Documents that share a band key are candidates.  Buckets with the same members count once.  A bucket of more
   than ``BLOCK`` documents is cut into blocks by a salt, and each pair of blocks is a group of its own, so no task
   holds more than two blocks.
3. In a group, signatures are compared a batch of hashes at a time; a pair goes as soon as the posterior
   probability that it is similar enough falls under ``MISS``.  What the surviving pairs connect is a
   cluster; the same cluster from several buckets counts once.
4. Full shingle sets of clustered documents alone are made again from their texts, and every pair of a cluster is
   verified on them by counting common shingles.  Of the true links a spanning tree is emitted, never all pairs.
5. Connected components of these links and of exact copies.

A pair at the similarity asked for shares no band once in a million times (36 bands of 7 hashes at 0.85, 35 of 5 at
0.8); the pruning adds MISS for each comparison.  No bound is set on partners or candidates.
"""

from __future__ import annotations

import hashlib
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .shared import Scratch, components, give_back, long_texts, map_arrow, texts_of

HASHES, BANDS, ROWS = 256, 36, 7
BATCH = 32
MISS = 1e-7
BAND_MISS = 1e-6
BLOCK = 512
BITS = 25
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_rng = np.random.default_rng(20240)
_A = (_rng.integers(0, 1 << 31, HASHES, np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, HASHES, np.uint32)
_ORDER = _rng.permutation(HASHES)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(32)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed permutation of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[0]
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX[1]
    return x ^ (x >> np.uint64(31))


def hashed_words(texts: list[str], most: int = 1 << 22) -> tuple[list[bytes], list[np.ndarray]]:
    """Of each text its words (A-Z lower-cased, split at ASCII blanks) joined by blanks, and a 64-bit hash of each word.

    ``most`` characters at a time, or one text; the different words of a part are found by Arrow and hashed once.
    """
    import xxhash

    joined, hashes, first, size = [], [], 0, 0
    for k in range(len(texts) + 1):
        if k < len(texts) and (k == first or size + len(texts[k]) <= most):
            size += len(texts[k])
            continue
        if first < k:
            trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(pa.array(texts[first:k], pa.large_string())))
            split = pc.ascii_split_whitespace(trimmed)
            each = split.flatten().dictionary_encode()
            known = np.array([xxhash.xxh3_64_intdigest(w) for w in each.dictionary.cast(pa.large_binary()).to_pylist()], np.uint64)
            all_words, ends = known[each.indices.to_numpy()] if len(known) else np.zeros(0, np.uint64), split.offsets.to_numpy()
            joined += pc.binary_join(split, pa.scalar(" ", pa.large_string())).cast(pa.large_binary()).to_pylist()
            hashes += [all_words[x:y] if j else all_words[:0] for x, y, j in zip(ends[:-1].tolist(), ends[1:].tolist(), joined[-(k - first) :])]
        first, size = k, len(texts[k]) if k < len(texts) else 0
    return joined, hashes


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """The set of a document's shingles as sorted 64-bit hashes; fewer words than ``size`` are one shingle."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(size, n)
    total = np.full(n - k + 1, np.uint64(k), np.uint64)
    for j in range(k):
        total = total + hashes[j : n - k + 1 + j] * _POWERS[k - j]
    return np.unique(mixed(total))


def minhashes(found: np.ndarray) -> np.ndarray:
    x = (found >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, np.uint32(0xFFFFFFFF))
    for at in range(0, len(x), 1024):
        out = np.minimum(out, (x[None, at : at + 1024] * _A[:, None] + _B[:, None]).min(axis=1))
    return out


def banding(percent: int) -> np.ndarray:
    """The hashes of each band: the longest bands with which a pair at this similarity is missed BAND_MISS times at most."""
    bands, rows = BANDS, ROWS
    while percent < 85 and (bands := ceil(log(BAND_MISS) / log(1 - (percent / 100) ** rows))) * rows > HASHES:
        rows -= 1
    return _ORDER[: bands * rows].reshape(bands, rows)


def features(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, cls, n, sig, keys of each row."""
    chosen = banding(percent)

    def each(batch: pa.RecordBatch):
        import xxhash

        joined, hashes = hashed_words(texts_of(batch, "text"))
        cls = [xxhash.xxh3_128_digest(w) for w in joined]
        n, sigs, keys = [], [], []
        for h in hashes:
            found = shingles(h, size)
            n.append(len(found))
            if not len(found):
                sigs.append(None), keys.append(None)
                continue
            m = minhashes(found)
            sigs.append((m & np.uint32(255)).astype(np.uint8).tobytes())
            band = np.arange(len(chosen), dtype=np.uint64)
            for j in range(chosen.shape[1]):
                band = mixed(band * _POWERS[1] + m[chosen[:, j]])
            keys.append(band.view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(cls, pa.binary()), pa.array(n, pa.int64()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
            ["doc_id", "cls", "n", "sig", "keys"],
        )

    return map_arrow(docs, each, "doc_id long, cls binary, n long, sig binary, keys array<long>")


def least_matches(threshold: float, miss: float = MISS) -> dict[int, int]:
    """For each number of hashes compared, the fewest matches with which a pair stays in play.

    With a uniform prior on the chance of a match, the posterior probability that it reaches the threshold after
    m of n matches is a sum of binomial terms; a byte matches by chance once in 256 times.
    """
    t = threshold + (1 - threshold) / 256
    out = {}
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out[n] = m
    return out


def pairs_in(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both ends of all pairs of places within consecutive groups of these sizes."""
    ends = np.cumsum(sizes)
    end_of = np.repeat(ends, sizes)
    place = np.arange(len(end_of))
    after = end_of - place - 1
    a = np.repeat(place, after)
    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(after) - after, after)
    return a, b


def survivors(sig: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that no batch of hashes rules out; sets whose sizes are too far apart go first."""
    ok = 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])
    a, b = a[ok], b[ok]
    matches = np.zeros(len(a), np.int32)
    for at in range(0, HASHES, BATCH):
        if not len(a):
            break
        matches += (sig[a, at : at + BATCH] == sig[b, at : at + BATCH]).sum(axis=1, dtype=np.int32)
        ok = matches >= least[at + BATCH]
        a, b, matches = a[ok], b[ok], matches[ok]
    return a, b


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place that each of n places is connected with."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low), np.minimum.at(root, root[b], low)
        while (jump := root[root]).tolist() != root.tolist():
            root = jump
        ok = root[a] != root[b]
        a, b = a[ok], b[ok]
    return root


def groups(batches, key: list[str], rows: int = 20_000):
    """Batches cut between groups: rows come sorted by key, and a group's rows come together."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if held.num_rows < rows:
            continue
        change = np.zeros(held.num_rows - 1, bool)
        for k in key:
            c = held.column(k).combine_chunks()
            change |= ~np.asarray(pc.equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False), bool)
        at = np.flatnonzero(change)
        if len(at):
            cut = int(at[-1]) + 1
            yield held.slice(0, cut)
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held


def sizes_of(table: pa.Table, key: list[str]) -> np.ndarray:
    change = np.zeros(table.num_rows - 1, bool)
    for k in key:
        c = table.column(k).combine_chunks()
        change |= ~np.asarray(pc.equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False), bool)
    return np.diff(np.concatenate([[0], np.flatnonzero(change) + 1, [table.num_rows]]))


def clusters(members: DataFrame, percent: int) -> DataFrame:
    """sub, cls, rep: what the pairs that survive in each bucket connect.  members: key, size, cls, rep, n, sig."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    salted = members.withColumn("_s", F.when(F.col("size") > BLOCK, F.pmod(F.xxhash64("cls", "key"), blocks)).otherwise(0).cast("int")).withColumn("_k", blocks)
    one = salted.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    dealt = one.select("key", F.least("_s", "_o").alias("i"), F.greatest("_s", "_o").alias("j"), F.col("_s").alias("s"), "cls", "rep", "n", "sig")
    least = least_matches(percent / 100)

    def bucket(batches):
        for table in groups(batches, ["key", "i", "j"]):
            sizes = sizes_of(table, ["key", "i", "j"])
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES)
            n, s, i, j = (table.column(c).to_numpy() for c in ("n", "s", "i", "j"))
            cls, rep = table.column("cls").to_pylist(), table.column("rep").to_numpy()
            ends, at, found_a, found_b = np.cumsum(sizes), 0, [], []
            pairs = np.cumsum(sizes * (sizes - 1) // 2)
            while at < len(sizes):  # a few million pairs at a time
                to = max(at + 1, int(np.searchsorted(pairs, (pairs[at - 1] if at else 0) + 2_000_000)))
                first = int(ends[at] - sizes[at])
                a, b = pairs_in(sizes[at:to])
                a, b = a + first, b + first
                ok = (i[a] == j[a]) | (s[a] != s[b])  # within a block only where it meets itself
                a, b = survivors(sig, n, a[ok], b[ok], percent, least)
                found_a.append(a), found_b.append(b)
                at = to
            a, b = np.concatenate(found_a), np.concatenate(found_b)
            if not len(a):
                continue
            root = roots(table.num_rows, a, b)
            used = np.unique(np.concatenate([a, b]))
            used = used[np.argsort(root[used], kind="stable")]
            heads = np.flatnonzero(np.diff(root[used], prepend=-1))
            subs = [None] * len(used)
            for x, y in zip(heads.tolist(), [*heads[1:].tolist(), len(used)]):
                name = hashlib.blake2b(b"".join(sorted(cls[k] for k in used[x:y])), digest_size=16).digest()
                subs[x:y] = [name] * (y - x)
            yield pa.RecordBatch.from_arrays([pa.array(subs, pa.binary()), pa.array([cls[k] for k in used], pa.binary()), pa.array(rep[used])], ["sub", "cls", "rep"])
        give_back()

    in_order = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return in_order.mapInArrow(bucket, "sub binary, cls binary, rep long").distinct()


def links(members: DataFrame, percent: int, size: int) -> DataFrame:
    """a, b: a spanning tree of each part of a cluster that true links connect.  members: sub, cls, rep, text."""

    def verify(batches):
        import xxhash

        for table in groups(batches, ["sub"], 256):
            again = sizes_of(table, ["sub", "cls"])  # rows of one class, from repeated rows of the input, count once
            table = table.take(pa.array(np.cumsum(again) - again))
            joined, hashes = hashed_words(texts_of(table, "text"))
            cls = table.column("cls").to_pylist()
            # another text under the same id is no member
            same = np.array([xxhash.xxh3_128_digest(w) == c for w, c in zip(joined, cls)])
            grams = [shingles(h, size) for h in hashes]
            rep, out_a, out_b, at = table.column("rep").to_numpy(), [], [], 0
            for m in sizes_of(table, ["sub"]).tolist():
                own = at + np.flatnonzero(same[at : at + m])
                sets = [grams[k] for k in own]
                if len(sets) == 2:
                    x, y = sets
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        out_a.append(rep[own[0]]), out_b.append(rep[own[1]])
                elif len(sets) > 2:
                    a, b = linked(sets, percent)
                    root = roots(len(sets), a, b)
                    ok = np.flatnonzero(root != np.arange(len(sets)))
                    out_a.extend(rep[own[root[ok]]].tolist()), out_b.extend(rep[own[ok]].tolist())
                at += m
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])
        give_back()

    return members.repartition("sub").sortWithinPartitions("sub", "cls").mapInArrow(verify, "a long, b long")


def marked_only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs (doc_id, ...) without most rows whose id is not among ids: a filter before a join.

    The ids set bits in a map of 2 ** BITS bits, of which at most 2 ** BITS / 64 words reach the driver whatever the
    number of ids; a row stays if its bit is set, so no wanted row is lost.
    """
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << BITS))
    words = ids.withColumn("b", bit).select(F.shiftright("b", 6).alias("w"), F.expr("shiftleft(1L, cast(b % 64 AS int))").alias("x")).groupBy("w").agg(F.bit_or("x").alias("x"))
    bits = np.zeros(1 << (BITS - 6), np.int64)
    for row in words.collect():
        bits[row["w"]] = row["x"]
    bits = bits.view(np.uint64)

    def keep(batch: pa.RecordBatch):
        b = batch.column("_b").to_numpy()
        ok = (bits[b >> 6] >> (b & 63).astype(np.uint64)) & np.uint64(1)
        yield batch.filter(pa.array(ok.astype(bool)))

    return map_arrow(docs.where("doc_id IS NOT NULL").withColumn("_b", bit), keep, StructType([*docs.schema.fields, StructField("_b", LongType())])).drop("_b")


def linked(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of sets that are similar enough: common members counted by products of 0/1 matrices."""
    n = np.array([len(x) for x in sets])
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), n)
    shared = times[column] > 1
    renamed = np.cumsum(times > 1) - 1
    row, column = row[shared], renamed[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        part = np.zeros((len(sets), width), np.float32)
        part[row[lo:hi], column[lo:hi] - at] = 1
        common += part @ part.T
    common = common.astype(np.int64)
    ok = 100 * common >= percent * (n[:, None] + n[None, :] - common)
    return np.nonzero(np.triu(ok, 1))


def near_duplicates(docs: DataFrame, percent: int = 85, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, a row for each row of docs.

    Documents are linked if 100 * common >= percent * all shingles of both; component_id is the smallest id
    reachable.  A text without words (null or blank) has no shingles and is its own component.  Rows that repeat
    an id are versions of one document and are linked with it.  A null id is linked with nothing: its component
    is null and it is kept.  An empty table gives an empty table; other columns are dropped.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent is between 50 and 100")
    spark = docs.sparkSession
    long_texts(spark)
    scratch = Scratch(spark)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    seen = scratch.keep(features(plain, size, percent), "features")
    classes = seen.where("n > 0 AND doc_id IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("rep"))
    classes = scratch.keep(classes, "classes")
    reps = seen.join(classes.withColumnRenamed("rep", "doc_id"), ["cls", "doc_id"], "left_semi").dropDuplicates(["cls", "doc_id"])
    reps = scratch.keep(reps.withColumnRenamed("doc_id", "rep"), "reps")

    # a class goes by a short hash here; where two share one, both are candidates, which verification settles
    short = F.xxhash64("cls").alias("h")
    bands = reps.select(F.explode("keys").alias("key"), short)
    # buckets are the same if their sizes and two sums of their members' hashes are, of 64 and of 34 bits and more
    buckets = bands.groupBy("key").agg(F.count("*").alias("size"), F.bit_xor("h").alias("x"), F.sum(F.shiftright("h", 30)).alias("y")).where("size > 1")
    buckets = buckets.groupBy("size", "x", "y").agg(F.min("key").alias("key")).select("key", "size")
    # merge joins at every size: what is small on one input is not on the next
    members = bands.join(buckets.hint("merge"), "key").join(reps.select(short, "cls", "rep", "n", "sig").hint("merge"), "h").drop("h")
    found = scratch.keep(clusters(members, percent), "clusters")

    wanted = found.select(F.col("rep").alias("doc_id")).distinct()
    texts = marked_only(plain, wanted).join(found.withColumnRenamed("rep", "doc_id").hint("merge"), "doc_id")
    true = links(texts.withColumnRenamed("doc_id", "rep"), percent, size)
    copies = seen.join(classes, "cls").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    linked_ids = components(true.union(copies), scratch).withColumnRenamed("node", "doc_id")
    scratch.sweep(seen, linked_ids)
    out = seen.select("doc_id", F.col("n").alias("n_shingles")).join(linked_ids, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
