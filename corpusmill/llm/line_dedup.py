"""Removal of repeated runs of lines, by a suffix array over the sequences of line ids of all documents.

1. A document is a sequence of line ids (128-bit hashes of whole lines); documents one after the other, in the order of their
   ids, are the text, and a place is a number in it.  Only suffixes whose first line repeats can share anything.
2. Prefix doubling ranks them: a rank at depth h is the place in the array where the suffixes with the same first h lines begin;
   at depth 2h suffixes of one rank are put in order by the ranks h lines further on.  Ranks are running sums over the
   different pairs in order, which are dealt by ranges, so a frequent line is no hot group.  It goes on until no two
   suffixes share a rank: the ranks are then the suffix array.
3. Longest common prefixes of neighbours in the array: from the largest power of two down, a prefix grows by it if the ranks of
   that depth behind it are equal.
4. Intervals of neighbours that share at least d lines are nested; the maximal repeated runs are theirs.  The array is cut into
   pieces, each of which builds the tree of its intervals with the first place in each; what lies beyond a border is
   carried into it as a staircase (a common length and the first place that reaches it).  Of each place, the largest
   interval depth with an earlier copy that it does not overlap is the length of its copied run.

The lines of copied runs of at least ``min_lines`` lines go, as does a line of at least ``min_words`` words that has
occurred before.  The first copy stays.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .shared import Scratch, long_texts, map_arrow

PIECE = 1 << 16
FAR = 1 << 62


def line_ids(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """_doc, _version, _line, a, b (128 bits of the line), wordy: a row for each line of each different document."""
    text = F.col(text_col)
    rows = docs.where(text.isNotNull()).select(F.col(id_col).alias("_doc"), F.xxhash64(text).alias("_version"), F.posexplode(F.split(text, "\n", -1)).alias("_line", "_text"))
    wordy = F.regexp_count("_text", F.lit(r"[^\x20\x09-\x0D]+")) >= min_words
    return rows.select("_doc", "_version", "_line", F.xxhash64("_text").alias("a"), F.xxhash64(F.lit(1), "_text").alias("b"), wordy.alias("wordy"))


def summed(rows: DataFrame, order: list[str], scratch: Scratch, group: str | None = None) -> DataFrame:
    """rows with before: the sum of n over the rows before in a total order; and within: that of the rows of the same group,
    a number by which the order begins.

    Dealt by ranges and summed within each; of each range its sum and its first and last group are all that is gathered."""

    def each(batches):
        part, total, now, base, lead = TaskContext.get().partitionId(), 0, None, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column("n").to_numpy()
            ends = np.cumsum(n) + total
            before, total = ends - n, int(ends[-1])
            g = batch.column(group).to_numpy() if group else np.zeros(len(n), np.int64)
            lead = g[0] if lead is None else lead
            new = np.concatenate([[now is None or g[0] != now], g[1:] != g[:-1]])
            at = np.maximum.accumulate(np.where(new, np.arange(len(n)), -1))
            first = np.where(at >= 0, before[np.maximum(at, 0)], base)
            now, base = g[-1], int(first[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before), pa.array(np.where(g == lead, -1, first)), pa.array(np.full(len(n), part, np.int32))], [*batch.schema.names, "_in", "_first", "_part"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", _in long, _first long, _part int"
    ranged = scratch.keep(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(each, schema), "summed")
    g = F.col(group) if group else F.lit(0)
    parts = ranged.groupBy("_part").agg(F.sum("n").alias("n"), F.min(g).alias("a"), F.max(g).alias("b"), F.max_by("_first", g).alias("last")).orderBy("_part").collect()  # as many as ranges
    offset, lead, before, last, carried = {}, {}, 0, None, 0
    for r in parts:
        offset[r["_part"]] = before
        lead[r["_part"]] = base = carried if r["a"] == last else before
        carried, last = base if r["a"] == r["b"] else before + r["last"], r["b"]
        before += r["n"]
    if not parts:
        return ranged.withColumns({"before": F.col("_in"), "within": F.col("_in")}).drop("_in", "_first", "_part")
    at = lambda x: F.element_at(F.create_map(*[F.lit(v) for kv in x.items() for v in kv]), F.col("_part"))
    total = F.col("_in") + at(offset)
    base = F.when(F.col("_first") < 0, at(lead)).otherwise(F.col("_first") + at(offset))
    return ranged.withColumns({"before": total, "within": total - base}).drop("_in", "_first", "_part")


def repeated_lines(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """pos, start (of its document), a, b, wordy, _doc, _version, _line of the lines that occur more than once.

    The counts are combined before the shuffle; they are a table of their own, so that Spark can split the join at a line
    that is very frequent."""
    twice = scratch.keep(lines.groupBy("a", "b").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n"), "twice")
    sizes = lines.groupBy("_doc", "_version").agg((F.max("_line") + 1).cast("long").alias("n"))
    starts = summed(sizes, ["_doc", "_version"], scratch).select(F.col("_doc").alias("d"), F.col("_version").alias("v"), F.col("before").alias("start"))
    again = lines.join(twice.hint("merge"), ["a", "b"])
    placed = again.join(starts.hint("merge"), F.col("_doc").eqNullSafe(F.col("d")) & (F.col("_version") == F.col("v")))
    # rows that repeat a document are one
    return scratch.keep(placed.select((F.col("start") + F.col("_line")).alias("pos"), "start", "a", "b", "wordy", "_doc", "_version", "_line").distinct(), "repeated")


def ranked(suffixes: DataFrame, scratch: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """(pos, start, rank: the suffix array; for each depth 1, 2, 4, ... the places that share their rank there: pos, start, r, n)."""
    names = summed(suffixes.groupBy("a", "b").agg(F.count("*").alias("n")), ["a", "b"], scratch)
    now = scratch.keep(suffixes.select("pos", "start", "a", "b").join(names.hint("merge"), ["a", "b"]).select("pos", "start", F.col("before").alias("r"), "n"), "depth")
    done, now, depth = [now.where("n = 1").select("pos", "start", "r")], now.where("n > 1"), 1
    levels = [now]
    while not now.isEmpty():
        known = now.select("pos", "start", "r")
        for x in done:
            known = known.union(x)
        behind = known.where(F.col("pos") - depth >= F.col("start")).select((F.col("pos") - depth).alias("pos"), F.col("r").alias("k"))
        # what goes on with a line of its own, or ends, is alone; its place tells it from others
        pairs = scratch.keep(now.select("pos", "start", "r").join(behind.hint("merge"), "pos", "left").withColumn("alone", F.when(F.col("k").isNull(), F.col("pos"))), "pairs")
        counted = pairs.groupBy("r", F.coalesce("k", F.lit(-1)).alias("k"), F.coalesce("alone", F.lit(-1)).alias("alone")).agg(F.count("*").alias("n"))
        moved = summed(counted, ["r", "k", "alone"], scratch, "r").withColumn("new", F.col("r") + F.col("within"))
        new = pairs.select("pos", "start", "r", F.coalesce("k", F.lit(-1)).alias("k"), F.coalesce("alone", F.lit(-1)).alias("alone")).join(moved.hint("merge"), ["r", "k", "alone"])
        new = scratch.keep(new.select("pos", "start", F.col("new").alias("r"), "n"), "depth")
        scratch.drop(pairs), scratch.drop(moved)
        done.append(new.where("n = 1").select("pos", "start", "r"))
        now, depth = new.where("n > 1"), 2 * depth
        levels.append(now)
    array = done[0]
    for x in done[1:]:
        array = array.union(x)
    return array.withColumnRenamed("r", "rank"), levels


def common_prefixes(array: DataFrame, levels: list[DataFrame], least: int, scratch: Scratch) -> DataFrame:
    """rank, pos, start, h: how many lines a suffix shares with the one before it in the array (0 if under a power of two
    up to ``least``), for the suffixes that share that many with any."""
    low = max(k for k in range(len(levels)) if 1 << k <= least) if least > 1 else 0
    shared = scratch.keep(levels[low].select("pos", F.col("r").alias("group")).join(array, "pos"), "shared")
    before = shared.select((F.col("rank") + 1).alias("rank"), F.col("pos").alias("other"), F.col("start").alias("begin"), F.col("group").alias("g"))
    pairs = scratch.keep(shared.join(before, "rank").where("group = g").select("rank", "pos", "start", "other", "begin", F.lit(0).cast("long").alias("h")), "pairs")
    for k in range(len(levels) - 1, -1, -1):
        # what lies behind the end of a document is another one
        one = levels[k].select(F.col("pos").alias("p"), F.col("start").alias("s"), F.col("r").alias("x"))
        two = levels[k].select(F.col("pos").alias("q"), F.col("start").alias("b"), F.col("r").alias("y"))
        grown = pairs.join(one.hint("merge"), (F.col("pos") + F.col("h") == F.col("p")) & (F.col("start") == F.col("s")), "left")
        grown = grown.join(two.hint("merge"), (F.col("other") + F.col("h") == F.col("q")) & (F.col("begin") == F.col("b")), "left")
        longer = scratch.keep(grown.select("rank", "pos", "start", "other", "begin", (F.col("h") + F.when(F.col("x") == F.col("y"), 1 << k).otherwise(0)).alias("h")), "pairs")
        scratch.drop(pairs)
        pairs = longer
    return scratch.keep(shared.select("rank", "pos", "start").join(pairs.select("rank", "h"), "rank", "left").select("rank", "pos", "start", F.coalesce("h", F.lit(0)).alias("h")), "prefixes")


def stairs(values: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """Of (common length, place) those that come before all places with a greater or the same length, longest first."""
    out: list[tuple[int, int]] = []
    for h, p in sorted(values, key=lambda x: (-x[0], x[1])):
        if h >= least and (not out or p < out[-1][1]):
            out.append((h, p))
    return out


def copied(pos: list[int], start: list[int], h: list[int], left: list[tuple[int, int]], right: list[tuple[int, int]], least: int) -> list[int]:
    """For each suffix of a piece, the length of its copied run (0 under ``least``).

    pos, start, h in the order of the array; left and right: staircases of what lies beyond the borders."""
    places = [p for _, p in reversed(left)] + pos + [p for _, p in right]
    near = [0] + [x for x, _ in reversed(left)] if left else [0]
    near = near + h[1:] + [x for x, _ in right]
    depth, first, parent, stack, leaf = [0], [FAR], [0], [0], [0] * len(places)
    for i, p in enumerate(places):
        x, last = near[i], -1
        while depth[stack[-1]] > x:
            last = stack.pop()
            if depth[stack[-1]] >= x:
                top = stack[-1]
                parent[last], first[top], last = top, min(first[top], first[last]), -1
        if depth[stack[-1]] < x:
            depth.append(x), first.append(FAR), parent.append(0)
            new = len(depth) - 1
            if last >= 0:
                parent[last], first[new] = new, first[last]
            else:
                leaf[i - 1], first[new] = new, places[i - 1]
            stack.append(new)
        leaf[i] = stack[-1]
        first[stack[-1]] = min(first[stack[-1]], p)
    while len(stack) > 1:
        last = stack.pop()
        parent[last] = stack[-1]
        first[stack[-1]] = min(first[stack[-1]], first[last])
    # the next interval further out whose first place is another one
    jump = [0] * len(depth)
    for n in sorted(range(1, len(depth)), key=depth.__getitem__):
        jump[n] = parent[n] if first[parent[n]] < first[n] else jump[parent[n]]
    out, skip = [], len(left)
    for k, p in enumerate(pos):
        n, best = leaf[skip + k], 0
        while n and depth[n] > best and depth[n] >= least:
            f = first[n]
            if f < p:
                best = max(best, depth[n] if f < start[k] else min(depth[n], p - f))
            n = jump[n]
        out.append(best if best >= least else 0)
    return out


STAIR = "array<struct<h:bigint,p:bigint>>"


def copied_runs(prefixes: DataFrame, least: int, scratch: Scratch, piece: int = PIECE) -> DataFrame:
    """pos, depth: the length of the copied run that begins at a place, where it has at least ``least`` lines."""
    cut = scratch.keep(prefixes.withColumn("piece", F.floor(F.col("rank") / piece)), "pieces")
    as_rows = lambda x: [{"h": h, "p": p} for h, p in x]
    as_pairs = lambda x: [] if x is None else [(r["h"], r["p"]) for r in x]

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        """What a piece shows at its borders; the ranks of a piece may have gaps, where nothing is shared."""
        pdf = pdf.sort_values("rank")
        pos, h = pdf["pos"].tolist(), pdf["h"].tolist()
        to_left, to_right, low = [], [], FAR
        for x, p in zip(h, pos):
            low = min(low, x)
            if low < least:
                break
            to_left.append((low, p))
        through = min(h[1:], default=FAR)
        low = FAR
        for k in range(len(pos) - 1, -1, -1):
            to_right.append((low, pos[k]))
            low = min(low, h[k])
            if low < least:
                break
        return pd.DataFrame({"piece": pdf["piece"].iloc[:1], "first": h[:1], "through": [through], "left": [as_rows(stairs(to_left, least))], "right": [as_rows(stairs(to_right, least))]})

    seen = scratch.keep(cut.groupBy("piece").applyInPandas(summary, f"piece long, first long, through long, left {STAIR}, right {STAIR}"), "summaries")
    # pieces that hang together are a chain; a row for each piece is in it
    chained = seen.withColumn("new", (F.col("first") < least).cast("long")).select("piece", F.col("new").alias("n"))
    chain = summed(chained, ["piece"], scratch).select("piece", (F.col("before") + F.col("n")).alias("chain"))

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("piece").to_dict("records")
        left, right = [[] for _ in rows], [[] for _ in rows]
        for k in range(1, len(rows)):
            a, b = rows[k - 1], rows[k]
            seen = as_pairs(a["right"]) + [(min(h, a["through"]), p) for h, p in left[k - 1]]
            left[k] = stairs([(min(h, b["first"]), p) for h, p in seen], least)
        for k in range(len(rows) - 2, -1, -1):
            b = rows[k + 1]
            right[k] = stairs(as_pairs(b["left"]) + [(min(h, b["through"], b["first"]), p) for h, p in right[k + 1]], least)
        return pd.DataFrame({"piece": [r["piece"] for r in rows], "from_left": [as_rows(x) for x in left], "from_right": [as_rows(x) for x in right]})

    carried = scratch.keep(seen.join(chain, "piece").groupBy("chain").applyInPandas(carry, f"piece long, from_left {STAIR}, from_right {STAIR}"), "carried")

    def runs(pdf: pd.DataFrame, borders: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        pos = pdf["pos"].tolist()
        depth = copied(pos, pdf["start"].tolist(), pdf["h"].tolist(), as_pairs(borders["from_left"].iloc[0]), as_pairs(borders["from_right"].iloc[0]), least)
        out = pd.DataFrame({"pos": pos, "depth": depth})
        return out[out["depth"] > 0]

    return cut.groupBy("piece").cogroup(carried.groupBy("piece")).applyInPandas(runs, "pos long, depth long")


def removed_lines(docs: DataFrame, min_lines: int, min_words: int, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """_doc, _version, copies array<struct<line, depth>>: the copied runs of each document that has any."""
    every = scratch.keep(line_ids(docs, id_col, text_col, min_words), "lines")
    lines = repeated_lines(every, scratch)
    scratch.drop(every)
    array, levels = ranked(lines, scratch)
    found = lines.where("false").select("pos", F.lit(0).cast("long").alias("depth"))
    if len(levels) > 1:  # some line is in two places
        found = copied_runs(common_prefixes(array, levels, min_lines, scratch), min_lines, scratch, piece)
    # a long line alone: it has a copy, and is not the first
    wordy = lines.where("wordy")
    first = scratch.keep(wordy.groupBy("a", "b").agg(F.min("pos").alias("first")), "firsts")
    single = wordy.join(first.hint("merge"), ["a", "b"]).where("pos > first").select("pos", F.lit(1).cast("long").alias("depth"))
    deepest = found.union(single).groupBy("pos").agg(F.max("depth").alias("depth"))
    rows = lines.select("pos", "_doc", "_version", "_line").join(deepest, "pos")
    return rows.groupBy("_doc", "_version").agg(F.array_sort(F.collect_list(F.struct(F.col("_line").alias("line"), F.col("depth").cast("int").alias("depth")))).alias("copies"))


def dedup_lines(docs: DataFrame, min_lines: int = 2, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """docs without repeated runs of lines, and n_lines, n_removed, n_runs (long).

    Lines are what stands between line feeds; they are equal if all their characters are.  Copies are ordered by
    document id (null first), then by line.  Rows with the same id and text are one document and treated alike;
    rows with the same id and another text follow each other in the order of a hash.  A null text stays null and
    has no lines; an empty text has one empty line.  n_runs counts the maximal copied runs: the runs that begin at the
    lines of a document, each as long as it has an earlier copy without overlap, but for those inside another one; a
    long line that is copied alone is one.  Columns of the input named n_lines, n_removed or n_runs are replaced; all
    others stay.  An empty table gives an empty table.
    """
    if min_lines < 1 or min_words < 1:
        raise ValueError("min_lines and min_words are 1 or more")
    long_texts(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    docs = docs.drop("n_lines", "n_removed", "n_runs")
    gone = scratch.keep(removed_lines(docs, min_lines, min_words, scratch, id_col, text_col, piece).withColumnRenamed("copies", "_gone"), "copies")
    scratch.sweep(gone)
    on: Column = F.col(f"d.{id_col}").eqNullSafe(F.col("g._doc")) & (F.xxhash64(F.col(f"d.{text_col}")) == F.col("g._version"))
    # what goes grows with the documents, so it is never sent to all tasks
    both = docs.alias("d").join(gone.alias("g").hint("merge"), on, "left").select("d.*", "g._gone")
    names = docs.columns
    schema = StructType([*docs.schema.fields, *(StructField(c, LongType()) for c in ("n_lines", "n_removed", "n_runs"))])

    def rebuild(batch: pa.RecordBatch):
        texts, found = batch.column(text_col).to_pylist(), batch.column("_gone")
        n, removed, runs = [], [], []
        for k, t in enumerate(texts):
            n.append(0 if t is None else t.count("\n") + 1)
            removed.append(0), runs.append(0)
            if t is None or not (copies := found[k].as_py()):
                continue
            line, depth = (np.array([x[c] for x in copies]) for c in ("line", "depth"))
            change = np.zeros(n[-1] + 1, np.int64)
            np.add.at(change, line, 1), np.add.at(change, line + depth, -1)
            gone = np.cumsum(change)[:-1] > 0
            # runs of at least min_lines lines that no run from an earlier line holds, and long lines that none holds
            long = depth >= min_lines
            begin, end = line[long], line[long] + depth[long]
            reach = np.maximum.accumulate(np.concatenate([[-1], end]))
            inside = np.zeros(n[-1] + 1, np.int64)
            np.add.at(inside, begin, 1), np.add.at(inside, end, -1)
            covered = np.cumsum(inside)[:-1] > 0
            runs[-1] = int((end > reach[:-1]).sum()) + int((~covered[line[~long]]).sum())
            removed[-1] = int(gone.sum())
            texts[k] = "\n".join(x for x, out in zip(t.split("\n"), gone.tolist()) if not out)
        columns = [pa.array(texts, pa.string()) if c == text_col else batch.column(c) for c in names]
        yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.int64()) for x in (n, removed, runs))], [*names, "n_lines", "n_removed", "n_runs"])

    return map_arrow(both, rebuild, schema)


#: DuckDB SQL for the text and counts of dedup_lines with its default parameters; {docs} is the table.  Runs that occur
#: twice are made longer line by line until none does.
SQL = """
WITH RECURSIVE lines AS (
  SELECT doc_id, CAST(i AS BIGINT) AS line, parts[i] AS txt, lead(parts[i]) OVER (PARTITION BY doc_id ORDER BY i) AS nxt, i < len(parts) AS more
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM {docs} WHERE text IS NOT NULL))
), deep AS (
  SELECT 2 AS d, doc_id, line, md5(md5(txt) || md5(nxt)) AS run, first_value(doc_id) OVER w AS first_doc, first_value(line) OVER w AS first_line
  FROM lines WHERE more WINDOW w AS (PARTITION BY txt, nxt ORDER BY doc_id, line) QUALIFY count(*) OVER (PARTITION BY txt, nxt) > 1
  UNION ALL
  SELECT d, doc_id, line, run, first_value(doc_id) OVER w, first_value(line) OVER w
  FROM (SELECT deep.d + 1 AS d, deep.doc_id, deep.line, md5(deep.run || md5(l.txt)) AS run FROM deep JOIN lines l ON l.doc_id = deep.doc_id AND l.line = deep.line + deep.d)
  WINDOW w AS (PARTITION BY run ORDER BY doc_id, line) QUALIFY count(*) OVER (PARTITION BY run) > 1
), runs AS (
  SELECT doc_id, line, max(d) AS depth FROM deep WHERE first_doc <> doc_id OR first_line + d <= line GROUP BY doc_id, line
), maximal AS (
  SELECT doc_id, count(*) AS n FROM (SELECT doc_id, line + depth AS stop, max(line + depth) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM runs) WHERE reach IS NULL OR stop > reach GROUP BY doc_id
), marked AS (
  SELECT doc_id, line, txt,
    row_number() OVER (PARTITION BY txt ORDER BY doc_id, line) > 1 AND len(regexp_extract_all(txt, '[^\\x20\\x09-\\x0D]+')) >= 50 AS single,
    EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = lines.doc_id AND lines.line >= r.line AND lines.line < r.line + r.depth) AS covered
  FROM lines
), found AS (
  SELECT doc_id, coalesce(string_agg(txt, chr(10) ORDER BY line) FILTER (WHERE NOT (single OR covered)), '') AS kept_text, count(*) AS n_lines,
    count(*) FILTER (WHERE single OR covered) AS n_removed, coalesce(any_value(n), 0) + count(*) FILTER (WHERE single AND NOT covered) AS n_runs
  FROM marked LEFT JOIN maximal USING (doc_id) GROUP BY doc_id
)
"""
