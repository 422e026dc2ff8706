"""Hard negatives by ball trees: of each anchor the nearest rows of its label, and rows of other labels that score almost as much.

Scores are inner products of whole numbers (components times ``scale``, rounded down), so they and their ties are exact.

1. Rows that are alike but for their ids are one entry with the smallest ids that can be needed.  The entries are put
   in order by the signs of their products with fixed random directions and cut into blocks of ``block`` rows by range
   partitioning, so near ones are mostly in one block and no block is larger than others, whatever the data.
2. The task that gets a block builds a ball tree over it.  For a ball with centre c and radius r, q.c + |q| r and
   q.c - |q| r bound every score in it from above and below.  A node is left out for a query if it lies
   under the query's score window or strictly under its current kth score, or over the window.  The queries of a batch go
   down the tree side by side, each as long as it is not pruned.
3. Every query is searched in the block that holds it first.  The kth score found there is where its search in all other
   blocks starts from, so what they return is little, and blocks of other regions are left at their root.

A query set against all rows, in blocks: the work grows with queries times rows where the bounds prune nothing (vectors
spread evenly over a sphere of many dimensions), and falls with the spread of the blocks where vectors cluster.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .neardup import sizes_of
from .shared import Scratch, give_back, map_arrow

LEAF = 64
NONE = -(1 << 62)
MOST = 1 << 61
EXACT = 1 << 53


@dataclass(frozen=True)
class Mining:
    """positives and negatives: how many of each; low and high: the window of negatives in percent of the positive's score."""

    positives: int = 5
    negatives: int = 5
    low: int = 80
    high: int = 100
    scale: int = 256
    block: int = 16_384


def dots(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers as long, held within 2^61 either way."""
    if not queries.size or not points.size:
        return np.zeros((len(queries), len(points)), np.int64)
    if float(np.abs(queries).max()) * float(np.abs(points).max()) * queries.shape[1] < EXACT:
        return (queries @ points.T).astype(np.int64)
    whole = np.array([[int(x) for x in q] for q in queries], object) @ np.array([[int(x) for x in p] for p in points], object).T
    return np.clip(whole, -MOST, MOST).astype(np.int64)


class BallTree:
    """Nodes over points put in order: each is a range of them, with the ball around it."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.nodes: list[tuple[int, int, int, np.ndarray, float]] = []  # start, stop, right child (the left one follows), centre, radius
        self.build(points, 0, len(points), leaf)
        self.points = points[self.order]

    def build(self, points: np.ndarray, start: int, stop: int, leaf: int) -> int:
        own = points[self.order[start:stop]]
        centre = own.mean(axis=0)
        apart = np.sqrt(((own - centre) ** 2).sum(axis=1))
        at = len(self.nodes)
        radius = float(apart.max())
        self.nodes.append((start, stop, -1, centre, radius * (1 + 1e-9)))
        if stop - start > leaf and radius > 0:
            one = own[apart.argmax()]
            other = own[((own - one) ** 2).sum(axis=1).argmax()]
            half = (stop - start) // 2
            self.order[start:stop] = self.order[start:stop][np.argpartition(own @ (other - one), half)]
            self.build(points, start, start + half, leaf)
            self.nodes[at] = (start, stop, self.build(points, start + half, stop, leaf), centre, radius * (1 + 1e-9))
        return at


class Search:
    """The k best of a block for each query of a batch, by (score, id)."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        self.tree = BallTree(points)
        self.ids, self.labels = ids[self.tree.order], labels[self.tree.order]
        self.visited = 0

    def best(self, queries: np.ndarray, own: np.ndarray, label: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, seed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """scores and ids (each queries x k, NONE where there are fewer) of at least ``seed``, from ``low`` to ``high``."""
        self.queries, self.own, self.label, self.same, self.low, self.high, self.k = queries, own, label, same, low, high, k
        self.norm = np.sqrt((queries * queries).sum(axis=1))
        self.kth = np.maximum(seed, low)
        self.score, self.found = np.full((len(queries), k), NONE), np.full((len(queries), k), np.iinfo(np.int64).max)
        self.visit(0, np.arange(len(queries)), *self.bounds(0, np.arange(len(queries))))
        return self.score, self.found

    def bounds(self, node: int, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, _, _, centre, radius = self.tree.nodes[node]
        at = self.queries[who] @ centre
        spread = self.norm[who] * radius
        slack = 1e-9 * (np.abs(at) + spread + self.norm[who] * np.sqrt((centre * centre).sum()) + 1)
        return at + spread + slack, at - spread - slack

    def visit(self, node: int, who: np.ndarray, most: np.ndarray, least: np.ndarray) -> None:
        who = who[(most >= self.kth[who]) & (least <= self.high[who])]
        if not len(who):
            return
        self.visited += len(who)
        start, stop, right, _, _ = self.tree.nodes[node]
        if right < 0:
            return self.leaf(who, start, stop)
        sides = [(n, *self.bounds(n, who)) for n in (node + 1, right)]
        if sides[1][1].sum() > sides[0][1].sum():
            sides.reverse()
        for n, upper, lower in sides:
            self.visit(n, who, upper, lower)

    def leaf(self, who: np.ndarray, start: int, stop: int) -> None:
        score = dots(self.queries[who], self.tree.points[start:stop])
        ids = self.ids[start:stop]
        alike = self.label[who][:, None] == self.labels[None, start:stop]
        fits = (alike == self.same) & (self.own[who][:, None] != ids) & (score >= self.kth[who][:, None]) & (score <= self.high[who][:, None])
        some = fits.any(axis=1)
        if not some.any():
            return
        who = who[some]
        scores = np.concatenate([self.score[who], np.where(fits[some], score[some], NONE)], axis=1)
        all_ids = np.concatenate([self.found[who], np.broadcast_to(ids, (len(who), len(ids)))], axis=1)
        order = np.lexsort((all_ids, -scores), axis=-1)[:, : self.k]
        self.score[who], self.found[who] = np.take_along_axis(scores, order, 1), np.take_along_axis(all_ids, order, 1)
        last = self.score[who, self.k - 1]
        self.kth[who] = np.where(last > NONE, np.maximum(self.kth[who], last), self.kth[who])


def usable(vectors: DataFrame, scale: int, id_col: str, label_col: str, vec_col: str, is_anchor: Column) -> DataFrame:
    """id, label, v (whole numbers), anchor, for rows without a null, vectors of finite components only; no repeated rows."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    near = lambda x: F.greatest(F.least(F.floor(x * scale), F.lit((1 << 31) - 1)), F.lit(-(1 << 31))).cast("int")
    return rows.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").where(finite).withColumn("v", F.transform("v", near)).distinct()


def placed(vectors: DataFrame, mining: Mining, scratch: Scratch, **columns) -> DataFrame:
    """block, kind (0 an item, 1 an anchor), id, label (a hash), d, v (bytes)."""

    def coded(batch: pa.RecordBatch):
        """With the signs of the products with 32 directions, which depend on the length alone."""
        v = batch.column("v")
        ends = np.asarray(v.offsets)
        flat = v.flatten().to_numpy(zero_copy_only=False).astype("<i4")
        ends = ends - ends[0]
        d = np.diff(ends)
        code = np.zeros(len(d), np.int64)
        for n in np.unique(d).tolist():
            at = np.flatnonzero(d == n)
            points = flat[ends[at][:, None] + np.arange(n)[None, :]].astype(float)
            side = points @ np.random.default_rng(n).standard_normal((n, 32)) > 0
            code[at] = side @ (1 << np.arange(32)[::-1])
        raw = [flat[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("anchor"), pa.array(d, pa.int32()), pa.array(raw, pa.binary()), pa.array(code)], ["id", "label", "anchor", "d", "v", "code"])

    rows = usable(vectors, mining.scale, **columns).withColumn("label", F.xxhash64("label"))
    rows = scratch.keep(map_arrow(rows, coded, "id long, label long, anchor boolean, d int, v binary, code long"), "rows")
    need = max(mining.positives, mining.negatives) + 1
    alike = ["d", "code", "v", "label"]
    # the smallest ids of each entry; salted, then together
    salted = Window.partitionBy(*alike, F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    together = Window.partitionBy(*alike).orderBy("id")
    few = rows.withColumn("_n", F.row_number().over(salted)).where(F.col("_n") <= need)
    few = few.withColumn("_n", F.row_number().over(together)).where(F.col("_n") <= need)
    columns = [F.col(c) for c in ("id", "label", "d", "v", "code")]
    both = scratch.keep(few.select(F.lit(0).alias("kind"), *columns).union(rows.where("anchor").select(F.lit(1).alias("kind"), *columns)), "both")
    n = both.where("kind = 0").count()
    ranged = both.withColumn("h", F.xxhash64("v")).repartitionByRange(max(1, -(-n // mining.block)), "d", "code", "h")
    return scratch.keep(ranged.withColumns({"block": F.spark_partition_id(), "anchor": F.monotonically_increasing_id()}).drop("code", "h"), "placed")


FOUND = "anchor long, bound long, vec_id long, score long"


def search(items: DataFrame, queries: DataFrame, same: bool, k: int) -> DataFrame:
    """FOUND: of each query the best in each block it is sent to.

    queries: block, anchor, bound (together they name a query), id, label, d, v, low, high, seed."""
    empty = [F.lit(None).cast("long").alias(c) for c in ("bound", "low", "high", "seed")]
    columns = ["block", "kind", "anchor", "id", "label", "d", "v"]
    dealt = items.select(*columns, *empty).union(queries.select("block", F.lit(1).alias("kind"), "anchor", "id", "label", "d", "v", "bound", "low", "high", "seed"))
    keys = ["block", "d", "kind"]

    def each(batches):
        """Rows come by block and length, items first: a tree is built when the first query comes."""
        now, parts, tree = None, [], None
        for batch in batches:
            at = 0
            for size in sizes_of(pa.Table.from_batches([batch]), keys).tolist() if batch.num_rows else []:
                run, at = batch.slice(at, size), at + size
                block, d, kind = (run.column(c)[0].as_py() for c in keys)
                if now != (block, d):
                    now, parts, tree = (block, d), [], None
                points = np.frombuffer(b"".join(run.column("v").to_pylist()), "<i4").reshape(size, d).astype(float)
                ids, label = (run.column(c).to_numpy() for c in ("id", "label"))
                if kind == 0:
                    parts.append((points, ids, label))
                    continue
                if tree is None and parts:
                    tree = Search(*(np.concatenate(x) for x in zip(*parts)))
                if tree is None:
                    continue
                low, high, seed, anchor, bound = (run.column(c).to_numpy() for c in ("low", "high", "seed", "anchor", "bound"))
                score, found = tree.best(points, ids, label, same, low, high, seed, k)
                who, place = np.nonzero(score > NONE)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor[who], bound[who], found[who, place], score[who, place])], ["anchor", "bound", "vec_id", "score"])
        give_back()

    return dealt.repartition("block").sortWithinPartitions(*keys).mapInArrow(each, FOUND)


def best_of(found: DataFrame, k: int) -> DataFrame:
    """found with rank, the k best of each query."""
    order = Window.partitionBy("anchor", "bound").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def everywhere(items: DataFrame, queries: DataFrame, blocks: int, same: bool, k: int, scratch: Scratch) -> DataFrame:
    """FOUND and rank over all blocks; queries: home (a block), anchor, bound, id, label, d, v, low, high."""
    home = scratch.keep(search(items, queries.select("*", F.col("home").alias("block"), F.lit(NONE).alias("seed")), same, k), "home")
    # where k were found at home, only what is as good is asked for elsewhere
    seeds = home.groupBy("anchor", "bound").agg(F.count("*").alias("n"), F.min("score").alias("worst")).where(F.col("n") >= k).drop("n")
    seeded = queries.join(seeds, ["anchor", "bound"], "left").withColumn("seed", F.coalesce("worst", F.lit(NONE)))
    away = seeded.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).where("block <> home")
    return scratch.keep(best_of(home.union(search(items, away, same, k)), k), "found")


def hard_negatives(vectors: DataFrame, is_anchor: Column, mining: Mining = Mining(), id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    The positives of an anchor (a row that ``is_anchor`` picks) are its best other rows of the same label; the negatives of
    both are the best rows of other labels whose score lies from ``low`` to ``high`` percent of the positive's.  Higher
    scores come first, ties by smaller id.  A positive without such rows has none (so each with a score under 0).

    Rows with a null id, label or vector, or a null or non-finite component take no part; a vector of zeros does.  Equal
    rows count once; an id with several vectors or labels is several rows, none of them another row of its own.
    Vectors of different lengths are not compared.  Components times scale are held within 32 bits, scores within
    62.  Other columns are dropped; an empty table gives an empty table.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = placed(vectors, mining, scratch, id_col=id_col, label_col=label_col, vec_col=vec_col, is_anchor=is_anchor)
    blocks = (rows.agg(F.max("block")).first()[0] or 0) + 1
    items = rows.where("kind = 0")
    anchors = rows.where("kind = 1").withColumnRenamed("block", "home").drop("kind")
    wide = anchors.withColumns({"bound": F.lit(0).cast("long"), "low": F.lit(NONE + 1), "high": F.lit(-NONE)})
    first = everywhere(items, wide, blocks, True, mining.positives, scratch).select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    part = lambda n: F.col("positive_score").cast("decimal(28,0)") * n / 100
    windows = first.withColumns({"low": F.ceil(part(mining.low)).cast("long"), "high": F.floor(part(mining.high)).cast("long")}).where("low <= high")
    windows = scratch.keep(windows, "windows")
    # positives of one score have one window, which is searched once
    asked = windows.select("anchor", F.col("positive_score").alias("bound"), "low", "high").distinct().join(anchors, "anchor")
    found = everywhere(items, asked, blocks, False, mining.negatives, scratch)
    out = windows.join(found.select("anchor", F.col("bound").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), ["anchor", "positive_score"])
    out = out.join(anchors.select("anchor", F.col("id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def relabelled(vectors: DataFrame) -> DataFrame:
    """vectors whose label is one more (modulo 10) where vec_id is divisible by 7."""
    return vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


#: DuckDB SQL for the production query; for small tables.
SQL = """
WITH good AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5"""
