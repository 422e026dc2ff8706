"""Approximate nearest neighbours by a forest of random-projection trees.

Trees are fitted on a sample of at most ``Forest.sample`` vectors (each node halves its part of the sample at the
median along a random direction); every vector is then put into its leaf of each tree.  A query goes down all trees
through one priority queue: of all open nodes of all trees the one whose splits it would have to cross by the
least margin comes next, until the leaves reached hold ``Forest.fraction`` of all vectors, copies in several
trees counted again.  The vectors of those leaves are ranked by their exact distances in double precision.

Equal vectors are one entry with the smallest ids it can need, so a vector that a third of all rows hold is no
hot leaf; leaves of many different vectors are cut into blocks.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .neardup import groups, sizes_of
from .shared import Scratch, map_arrow

BLOCK = 2048
#: How many queries go down the trees, or are held against a block, at once, and how many visits are one batch.
QUERIES = 64
ROWS = 8192


@dataclass(frozen=True)
class Forest:
    """fraction: how much of all vectors the leaves searched for a query hold, as a sum over the trees."""

    trees: int = 4
    leaf: int = 64
    sample: int = 16_384
    fraction: float = 1.2
    seed: int = 7


class Tree:
    """Nodes in arrays: directions, thresholds, children (>= 0 a node, else leaf ~child)."""

    def __init__(self, points: np.ndarray, depth: int, rng: np.random.Generator):
        self.directions, self.thresholds, self.children, self.leaves = [], [], [], 0
        self.root = self.split(points, depth, rng)
        self.directions = np.array(self.directions).reshape(-1, points.shape[1])
        self.thresholds, self.children = np.array(self.thresholds), np.array(self.children, np.int64).reshape(-1, 2)

    def split(self, points: np.ndarray, depth: int, rng: np.random.Generator) -> int:
        if depth == 0 or len(points) < 2:
            self.leaves += 1
            return ~(self.leaves - 1)
        direction = rng.standard_normal(points.shape[1])
        direction /= np.linalg.norm(direction)
        along = points @ direction
        at = len(self.thresholds)
        threshold = float(np.median(along))
        self.directions.append(direction), self.thresholds.append(threshold), self.children.append((0, 0))
        right = along > threshold
        self.children[at] = (self.split(points[~right], depth - 1, rng), self.split(points[right], depth - 1, rng))
        return at

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        at = np.full(len(points), self.root)
        while len(inner := np.flatnonzero(at >= 0)):
            node = at[inner]
            right = (points[inner] * self.directions[node]).sum(axis=1) > self.thresholds[node]
            at[inner] = self.children[node, right.astype(int)]
        return ~at


def fit(sample: np.ndarray, rows: int, forest: Forest) -> list[Tree]:
    """Trees for this many rows: as deep as leaves of ``leaf`` rows ask for, while the sample can be halved."""
    depth = int(max(0, min(np.ceil(np.log2(max(1, rows / forest.leaf))), np.log2(max(1, len(sample) / 2)))))
    rng = np.random.default_rng(forest.seed)
    return [Tree(sample, depth, rng) for _ in range(forest.trees)]


def leaves_for(queries: np.ndarray, trees: list[Tree], held: list[np.ndarray], budget: float) -> list[list[int]]:
    """For each query, the leaves it visits, numbered through all trees; held: rows of each tree's leaves."""
    base = np.concatenate([[0], np.cumsum([t.leaves for t in trees])]).tolist()
    margins = [queries @ t.directions.T - t.thresholds if len(t.thresholds) else np.zeros((len(queries), 0)) for t in trees]
    children = [t.children.tolist() for t in trees]
    sizes = [h.tolist() for h in held]
    out = []
    for q in range(len(queries)):
        rows = [m[q].tolist() for m in margins]
        heap = [(0.0, k, t.root) for k, t in enumerate(trees)]
        found, seen = [], 0
        while heap and seen < budget:
            crossed, k, node = heapq.heappop(heap)
            margin, kids, worst = rows[k], children[k], crossed
            while node >= 0:  # to the near side at once, the far side waits
                m = margin[node]
                far = max(crossed, abs(m))
                heapq.heappush(heap, (far, k, kids[node][0 if m > 0 else 1]))
                node = kids[node][1 if m > 0 else 0]
            found.append(base[k] + ~node)
            seen += sizes[k][~node]
        out.append(found)
    return out


def visits(queries: np.ndarray, trees: list[Tree], held: list[np.ndarray], budget: float, blocks: np.ndarray):
    """(query, slot, salt) arrays of the blocks of leaves that each query visits: some queries, then some rows at a time, since
    a query crosses all nodes and visits most leaves."""
    for at in range(0, len(queries), QUERIES):
        who, slot = [], []
        for q, found in enumerate(leaves_for(queries[at : at + QUERIES], trees, held, budget)):
            slot.append(np.array(found, np.int64)), who.append(np.full(len(found), at + q))
        slot, who = np.concatenate(slot), np.concatenate(who)
        times = blocks[slot]
        ends = np.cumsum(times)
        for a in range(0, int(ends[-1]), ROWS):
            row = np.arange(a, min(a + ROWS, int(ends[-1])))
            k = np.searchsorted(ends, row, "right")
            yield who[k], slot[k], row - (ends[k] - times[k])


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v (array<double>) of vectors that are neither null nor zero, with finite components only; no repeated rows."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0)).distinct()


def nearest(vectors: DataFrame, is_query, k: int = 10, forest: Forest = Forest(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found for each row that ``is_query`` (a condition) picks.

    Candidates are all rows but the query's own id; score is the Euclidean distance of the vectors as given, ties go to
    the smaller id.  Vectors that are null, zero or hold null or non-finite components, and rows with a null
    id, take no part.  Equal rows count once; an id with several vectors is searched and found with each.  There is no
    distance between vectors of different lengths: each length has a forest of its own, and a query is searched
    among the vectors of its length.  Other columns are dropped; an empty table gives an empty table.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = scratch.keep(usable(vectors, id_col, vec_col), "vectors")
    asked = vectors.where(is_query).select(F.col(id_col).cast("long").alias("id")).distinct()
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for row in rows.select(F.size("v").alias("d")).distinct().orderBy("d").collect():
        out = out.union(nearest_of_length(rows.where(F.size("v") == row["d"]), row["d"], asked, k, forest, scratch))
    return out


def nearest_of_length(rows: DataFrame, length: int, asked: DataFrame, k: int, forest: Forest, scratch: Scratch) -> DataFrame:
    """nearest for rows (id, v) of one length; asked: the ids of queries."""
    # the k + 1 smallest ids of each vector; salted, then together
    need = k + 1
    first = Window.partitionBy("v", "_s").orderBy("id")
    then = Window.partitionBy("v").orderBy("id")
    few = rows.withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= need)
    few = few.withColumn("_n", F.row_number().over(then)).where(F.col("_n") <= need)
    entries = scratch.keep(few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "entries")
    n = entries.count()
    # a bounded sample, the same on every run: the vectors with the smallest hashes of about twice as many as wanted
    share = min(1.0, 2.0 * forest.sample / n)
    hashed = entries.select("v", F.xxhash64("v").alias("h"))
    picked = hashed.where(F.pmod(F.col("h"), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(F.pmod(F.col("h"), F.lit(1 << 30)), "h", "v").limit(forest.sample)
    sample = np.array([r["v"] for r in picked.collect()]).reshape(-1, length)
    trees = fit(sample, n, forest)
    base = np.concatenate([[0], np.cumsum([t.leaves for t in trees])])

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        return np.stack(batch.column("v").to_numpy(zero_copy_only=False))

    def index(batch: pa.RecordBatch):
        points = matrix(batch)
        slots = np.concatenate([base[k] + t.leaf_of(points) for k, t in enumerate(trees)])
        again = pa.array(np.tile(np.arange(len(points)), len(trees)))
        flat = pa.array([p.tobytes() for p in points], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), flat.take(again), batch.column("ids").take(again)], ["slot", "v", "ids"])

    items = scratch.keep(map_arrow(entries, index, "slot long, v binary, ids array<long>"), "leaves")
    held = [np.zeros(t.leaves, np.int64) for t in trees]
    for r in items.groupBy("slot").count().collect():  # a row for each leaf of the forest at most
        t = int(np.searchsorted(base, r["slot"], "right")) - 1
        held[t][r["slot"] - base[t]] = r["count"]
    counts = np.concatenate(held)
    blocks = np.maximum(1, -(-counts // BLOCK))
    budget = forest.fraction * n

    def aim(batch: pa.RecordBatch):
        points = matrix(batch)
        flat = pa.array([p.tobytes() for p in points], pa.binary())
        for who, slot, salt in visits(points, trees, held, budget, blocks):
            yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(salt.astype(np.int32)), flat.take(pa.array(who))], ["slot", "salt", "v"])

    def salted(batch: pa.RecordBatch):
        slot = batch.column("slot").to_numpy()
        salt = np.array([int.from_bytes(x[:8], "little") % 1_000_003 for x in batch.column("v").to_pylist()]) % blocks[slot]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(salt.astype(np.int32))], ["slot", "v", "ids", "salt"])

    chosen = rows.join(asked, "id", "left_semi")
    queries = map_arrow(chosen.groupBy("v").agg(F.count("*").alias("_n")).select("v"), aim, "slot long, salt int, v binary")
    dealt = map_arrow(items, salted, "slot long, v binary, ids array<long>, salt int").select("slot", "salt", F.lit(0).alias("kind"), "v", "ids")
    dealt = dealt.union(queries.select("slot", "salt", F.lit(1).alias("kind"), "v", F.lit(None).cast("array<long>").alias("ids")))

    def rank(batches):
        best: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}

        def out():
            keys = [q for q, (ids, _) in best.items() for _ in range(len(ids))]
            ids = np.concatenate([x[0] for x in best.values()])
            score = np.concatenate([x[1] for x in best.values()])
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids), pa.array(score)], ["q", "vec_id", "score"])

        for table in groups(batches, ["slot", "salt"], 4096):
            sizes = sizes_of(table, ["slot", "salt"])
            at, kind, raw, ids = 0, table.column("kind").to_numpy(), table.column("v").to_pylist(), table.column("ids").to_pylist()
            for m in sizes.tolist():
                split = at + int(np.searchsorted(kind[at : at + m], 1))
                if at < split < at + m:
                    points = np.frombuffer(b"".join(raw[at:split])).reshape(split - at, -1)
                    for q, places, score in closest(np.frombuffer(b"".join(raw[split : at + m])).reshape(at + m - split, -1), points, need):
                        found = [ids[at + p] for p in places]
                        got_ids = np.array([i for x in found for i in x], np.int64)
                        got = np.repeat(score, [len(x) for x in found])
                        key = raw[split + q]
                        if key in best:
                            got_ids, got = np.concatenate([best[key][0], got_ids]), np.concatenate([best[key][1], got])
                        order = np.lexsort((got_ids, got))
                        got_ids, got = got_ids[order], got[order]
                        new = np.concatenate([[True], (got_ids[1:] != got_ids[:-1]) | (got[1:] != got[:-1])])
                        best[key] = got_ids[new][:need], got[new][:need]
                at += m
            if len(best) > 20_000:
                yield out()
                best = {}
        if best:
            yield out()

    found = dealt.repartition("slot", "salt").sortWithinPartitions("slot", "salt", "kind").mapInArrow(rank, "q binary, vec_id long, score double")
    top = Window.partitionBy("q").orderBy("score", "vec_id")
    found = found.distinct().withColumn("_n", F.row_number().over(top)).where(F.col("_n") <= need).drop("_n")

    def flat(batch: pa.RecordBatch):
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([p.tobytes() for p in matrix(batch)], pa.binary())], ["query_id", "q"])

    who = map_arrow(chosen, flat, "query_id long, q binary")
    mine = Window.partitionBy("query_id", "q").orderBy("score", "vec_id")
    out = who.join(found, "q").where("vec_id <> query_id").withColumn("rank", F.row_number().over(mine)).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def closest(queries: np.ndarray, points: np.ndarray, k: int):
    """(query, places of the k nearest points and of any at a tie, their exact distances)."""
    norms = (points * points).sum(axis=1)
    for at in range(0, len(queries), QUERIES):
        some = queries[at : at + QUERIES]
        rough = (some * some).sum(axis=1)[:, None] + norms[None, :] - 2 * (some @ points.T)
        scale = 1e-9 * (1 + np.abs(rough).max())
        for q, row in enumerate(rough):
            near = np.arange(len(row)) if len(row) <= k else np.flatnonzero(row <= np.partition(row, k - 1)[k - 1] + scale)
            diff = points[near] - some[q]
            yield at + q, near, np.sqrt((diff * diff).sum(axis=1))
