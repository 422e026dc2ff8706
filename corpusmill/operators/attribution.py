"""Is a text original, a repost, or a repost with a comment?

Each line has marks of its own; what a line belongs to follows from the last label and the last border or repost mark
before it and from the last one of the whole text, which windows over the lines give.  Only texts with any mark
are taken apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Lines that mark a comment, a border, a repost or an original.
COMMENT = r"^(?:[>*#\-\s]*)?(?:转发者|发布者)?(?:附言|按语|评论|导语)|^(?:[>*#\-\s]*)?(?:编者按|转发语|我的评论)\s*[:：]?"
LABEL = T.COMMENT_LABEL
BORDER = r"^(?:[>*#\-\s]*)?(?:以下(?:为|是)?原文|原文(?:如下|正文)?|转载正文|转发正文)\s*[:：]?\s*$"
REPOST = r"^(?:[>*#\-\s\[【]*)?(?:本文\s*)?(?:转发|转载)(?:自|于)?(?:\s*[:：].*|\s*)$|^(?:[>*#\-\s\[【]*)?(?:转自|转载自|原文(?:来自|来源于|链接)|内容来源)\s*[:：]?.*$|^(?:[>*#\-\s\[【]*)?来源\s*[:：]\s*(?!原创\b|本号\b).+$"
ORIGINAL = r"^(?:[>*#\-\s\[【]*)?(?:原创|本文原创|作者原创)\s*(?:[\]】]|[:：].*)?$"
HEADING = r"^#{1,6}\s+"


def marked(line: Column, pattern: str) -> Column:
    return line.rlike(f"(?iU){pattern}")


def attribution_flags(body: Column) -> Column:
    """struct<repost, original, boundary, comment>: which marks any line has."""
    lines = F.transform(F.split(T.line_feeds(body), "\n", -1), T.strip)
    has = lambda p: F.exists(lines, lambda x: marked(x, p))
    return F.struct(has(REPOST).alias("repost"), has(ORIGINAL).alias("original"), has(BORDER).alias("boundary"), has(COMMENT).alias("comment"))


def attribute(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, source_type, reposter_comment, original_body, attribution_markers of each row.

    Only marks of whole lines make a text a repost or an original.  A label starts a comment, which goes on after its
    line if a border or repost mark follows, up to that or the next label; without any label, one to eight
    lines before the first border are the comment.  The body is what follows the first border, or else all but
    comments, labels and repost marks; if nothing is left, the whole.  A null text is unknown and has no body.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("version", F.xxhash64("text"))
    flags = attribution_flags(F.col("text"))
    rows = rows.withColumn("any", F.coalesce(flags["repost"] | flags["original"] | flags["boundary"] | flags["comment"], F.lit(False)))
    lines = rows.where("any").dropDuplicates(["id", "version"]).select("id", "version", F.posexplode(F.split(T.line_feeds(F.col("text")), "\n", -1)).alias("i", "line"))
    plain = T.strip(F.col("line"))
    lines = lines.withColumn("plain", plain).withColumns({"label": marked(F.col("plain"), COMMENT), "border": marked(F.col("plain"), BORDER), "repost": marked(F.col("plain"), REPOST), "original": marked(F.col("plain"), ORIGINAL)})
    whole = Window.partitionBy("id", "version")
    so_far = whole.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.when(F.col("border") | F.col("repost"), F.col("i"))
    lines = lines.withColumns(
        {
            "own_label": F.max(F.when(F.col("label"), F.col("i"))).over(so_far), "own_stop": F.max(stop).over(so_far), "last_stop": F.max(stop).over(whole),
            "first_border": F.min(F.when(F.col("border"), F.col("i"))).over(whole), "labels": F.count_if("label").over(whole), "originals": F.count_if("original").over(whole),
        }
    )
    reposted = F.col("last_stop").isNotNull()
    inside = F.coalesce(~F.col("label") & (F.col("own_label") >= F.coalesce("own_stop", F.lit(-1))) & (F.col("last_stop") > F.col("i")), F.lit(False))
    before = F.coalesce((F.col("labels") == 0) & (F.col("i") < F.col("first_border")) & (F.col("plain") != "") & ~F.col("repost") & ~marked(F.col("plain"), HEADING), F.lit(False))
    lines = lines.withColumns({"inside": inside, "before": before}).withColumn("n_before", F.count_if("before").over(whole))
    said = F.when(reposted & F.col("label"), T.strip(F.regexp_replace("plain", f"(?iU){LABEL}", ""))).when(F.col("inside") | (F.col("before") & (F.col("n_before") <= 8)), F.col("plain"))
    stays = F.when(F.col("first_border").isNotNull(), F.col("i") > F.col("first_border")).otherwise(~F.col("inside") & ~F.col("repost") & ~F.col("label"))
    mark = F.col("border") | F.col("repost") | F.col("original")

    def joined(keep: Column, value: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("i", value.alias("x"))))), lambda r: r["x"])

    found = lines.groupBy("id", "version").agg(
        joined(said != "", said).alias("comment"), joined(stays, F.col("line")).alias("body"), joined(mark & (F.col("plain") != ""), F.col("plain")).alias("markers"),
        F.first(reposted).alias("reposted"), F.first("originals").alias("originals"),
    )
    both = rows.alias("r").join(found.alias("f"), F.col("r.id").eqNullSafe(F.col("f.id")) & (F.col("r.version") == F.col("f.version")), "left")
    comment = T.normalize_plain(F.array_join("f.comment", "\n"))
    comment = F.when(comment != "", comment)
    body, all_text = T.normalize_structured(F.array_join("f.body", "\n")), T.normalize_structured(F.col("r.text"))
    kind = F.when(F.col("reposted") & comment.isNotNull(), "repost_with_comment").when(F.col("reposted"), "repost").when(F.col("originals") > 0, "original").otherwise("unknown")
    return both.select(
        "r.id", kind.alias("source_type"), F.when(F.col("reposted"), comment).alias("reposter_comment"), F.when(F.coalesce(body, F.lit("")) != "", body).otherwise(all_text).alias("original_body"),
        F.coalesce("markers", F.array().cast("array<string>")).alias("attribution_markers"),
    )
