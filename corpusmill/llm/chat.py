"""Chat formatting of reply trees, with DataFrame functions only.

A conversation is a tree of messages.  Its branches, the paths from a root to a leaf, are enumerated by self-joins that
double: each step joins every path with the table of ancestors twice as far away as before.  Branches are
ranked by score and each chosen one is written as one conversation:

    "### " role LF text "</turn>" LF, for each message

In roles and texts a backslash is written ``\\\\``, ``<`` is ``\\l`` and ``#`` is ``\\h`` (in roles LF is ``\\n``), so
neither marker occurs inside them, and reading an output back gives the very messages.  The loss mask is the
list of the assistant's texts as (start, length) in code points of the output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

HEAD, END = "### ", "</turn>\n"


def escaped(text: Column) -> Column:
    for plain, put in (("\\", "\\\\"), ("<", "\\l"), ("#", "\\h")):
        text = F.replace(text, F.lit(plain), F.lit(put))
    return text


def unescaped(text: Column) -> Column:
    """Two backslashes come first in reading, so what stands between them holds only the other escapes."""

    def part(x: Column) -> Column:
        return F.replace(F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#")), F.lit("\\n"), F.lit("\n"))

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), part), "\\")


def tree_of_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, node, parent, role, text, score: each turn replies to the one before it.

    Turns come in the order of their number (null first); rows with the same number in that of role and text.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("_turn").asc_nulls_first(), "role", "text")
    plain = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("_turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    numbered = plain.withColumn("node", F.row_number().over(order).cast("long"))
    return numbered.select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def branches(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, leaf, node, up (0 at the leaf): every path from a leaf to its root.

    A message whose parent is null or missing is a root.  Messages that reply to each other in a circle have no
    leaf-to-root path and are left out.
    """
    keys = nodes.select("conv_id", "node", "parent")
    a, b = keys.alias("a"), keys.select("conv_id", "node").alias("b")
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id"))
    edges = a.join(b, same & (F.col("a.parent") == F.col("b.node"))).select("a.conv_id", "a.node", F.col("a.parent").alias("far")).distinct()
    jump = scratch.keep(edges, "jump")
    leaf = keys.select("conv_id", "node").distinct().alias("a").join(jump.alias("b"), same & (F.col("a.node") == F.col("b.far")), "left_anti")
    paths = scratch.keep(leaf.select("conv_id", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "paths")
    longest = nodes.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    step = 1
    while step < longest:
        p, j = paths.alias("a"), jump.alias("b")
        on = same & (F.col("a.node") == F.col("b.node"))
        more = p.join(j, on).select("a.conv_id", "leaf", F.col("far").alias("node"), (F.col("up") + step).alias("up"))
        old, paths = paths, scratch.keep(paths.union(more), "paths")
        q = jump.alias("a").join(jump.alias("b"), same & (F.col("a.far") == F.col("b.node"))).select("a.conv_id", "a.node", "b.far")
        last, jump = jump, scratch.keep(q, "jump")
        scratch.drop(old)
        if step > 1:
            scratch.drop(last)
        step *= 2
    rooted = paths.groupBy("conv_id", "leaf").agg(F.max_by("node", "up").alias("root"), F.max("up").alias("_far"))
    ends = rooted.alias("a").join(edges.alias("b"), same & (F.col("a.root") == F.col("b.node")), "left_anti")
    p, e = paths.alias("a"), ends.alias("b")
    return p.join(e, same & (F.col("a.leaf") == F.col("b.leaf")), "left_semi")


def format_branches(nodes: DataFrame, top: int = 1, learn: str = "assistant") -> DataFrame:
    """conv_id, leaf, branch_rank, branch_score, n_turns, formatted, loss: the ``top`` branches of each conversation.

    nodes: conv_id, node, parent, role, text, score.  A branch scores the mean of its messages' scores (null counts
    as 0); ties go to the smaller leaf.  Null roles and texts are empty.  Rows that repeat a node are one message of
    several rows only if they are equal; otherwise the least by role and text stands for it.  An empty table gives
    an empty table.
    """
    scratch = Scratch(nodes.sparkSession)
    clean = nodes.select("conv_id", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    one = Window.partitionBy("conv_id", "node").orderBy("role", "text", F.col("parent").asc_nulls_first(), F.desc("score"))
    clean = scratch.keep(clean.where("node IS NOT NULL").withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n"), "nodes")
    found = branches(clean, scratch).alias("a")
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id"))
    scored = found.join(clean.alias("b"), same & (F.col("a.node") == F.col("b.node")))
    role, text = escaped(F.col("role")), escaped(F.col("text"))
    head = F.concat(F.lit(HEAD), F.replace(role, F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    turns = scored.select("a.conv_id", "leaf", "up", "score", head.alias("head"), text.alias("body"), (F.col("role") == learn).alias("learn"))
    # places in the output: running sums along the branch, from the root down
    down = Window.partitionBy("conv_id", "leaf").orderBy(F.desc("up"))
    size = F.length("head") + F.length("body") + len(END)
    turns = turns.withColumn("start", F.sum(size).over(down) - len(END) - F.length("body"))
    piece = F.struct((-F.col("up")).alias("at"), F.concat("head", "body", F.lit(END)).alias("s"), "start", F.length("body").cast("long").alias("n"), "learn")
    joined = turns.groupBy("conv_id", "leaf").agg(F.avg("score").alias("branch_score"), F.count("*").alias("n_turns"), F.sort_array(F.collect_list(piece)).alias("p"))
    ranked = joined.withColumn("branch_rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("branch_score"), "leaf"))).where(F.col("branch_rank") <= top)
    loss = F.transform(F.filter("p", lambda x: x["learn"]), lambda x: F.struct(x["start"].alias("start"), x["n"].alias("n")))
    return ranked.select("conv_id", "leaf", "branch_rank", "branch_score", "n_turns", F.array_join(F.transform("p", lambda x: x["s"]), "").alias("formatted"), loss.alias("loss"))


def read_back(formatted: Column) -> Column:
    """array of (role, text): the messages of an output."""

    def message(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        return F.struct(unescaped(F.substring(role, F.lit(len(HEAD) + 1), F.length(role))).alias("role"), unescaped(F.substring(x, F.length(role) + 2, F.length(x))).alias("text"))

    return F.transform(F.filter(F.split(formatted, END, -1), lambda x: x != ""), message)


def learned(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda x: unescaped(F.substring(formatted, x["start"].cast("int") + 1, x["n"].cast("int")))), "")
