"""Licence scans of files, with DataFrame functions only.

Lines, headers and whole texts that speak of a licence are compared with the names, statements, SPDX tags, headers
and full texts of licences (license_forms.py) by the cosine of sparse TF-IDF vectors (idf over these forms, a fixed
table).  A file's own licence is its best match; a file without one inherits that of the nearest directory above it, its own first, that holds a licence file.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_forms import FORMS
from .quality import let

#: Statements by which files name their licence: those of the SQL, all of them among the forms.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms are permitted under the BSD 3-Clause License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
#: What makes a passage worth comparing: each form has it.  Names that are words of a language (mit) are none.
HINT = r"(?i)licen[sc]e|copyright|redistribut|spdx|permission|warrant|creative commons|public domain|\b(?:mpl|cc0|cc[ -]by|[al]?gpl)\b|\b[al]?gplv\d"
#: Words that say nothing of a licence; without them prose is not near the long forms.
STOP = tuple("a all an and any are as at be but for from if in is it its may not of on or such that the this to under which with you your".split())
#: What makes a line worth comparing, in the SQL.
CLUE = r"(?i)licen[sc]e|copyright|redistribution|spdx"
TERM = r"[a-z0-9][a-z0-9.-]*[a-z0-9]|[a-z0-9]"


def template_weights(templates: dict[str, str] = TEMPLATES) -> list[tuple[str, str, float]]:
    """(licence, term, weight): unit vectors of tf * idf, idf = ln((1 + n) / (1 + df)) + 1."""
    import re

    counts = {}
    for name, text in templates.items():
        counts[name] = {t: sum(1 for x in re.findall(TERM, text.lower()) if x == t) for t in re.findall(TERM, text.lower())}
    idf = idfs(templates)
    out = []
    for name, tf in sorted(counts.items()):
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in tf.items()))
        out += [(name, t, n * idf[t] / norm) for t, n in sorted(tf.items())]
    return out


def idfs(templates: dict[str, str] = TEMPLATES) -> dict[str, float]:
    import re

    sets = [set(re.findall(TERM, t.lower())) for t in templates.values()]
    terms = sorted(set().union(*sets))
    return {t: math.log((1 + len(sets)) / (1 + sum(t in s for s in sets))) + 1 for t in terms}


def unseen(templates: dict[str, str] = TEMPLATES) -> float:
    """idf of a term that no template has."""
    return math.log(1 + len(templates)) + 1


def own_licenses(files: DataFrame, threshold: float = 0.6, templates: dict[str, tuple[str, ...]] = FORMS, id_col: str = "path", text_col: str = "text") -> DataFrame:
    """id, license, score: the best match of any passage, for files that have one of at least the threshold."""
    import re

    spark = files.sparkSession
    # fixed tables of some thousand rows: a row for each different term of each form
    named = {(name, k): " ".join(x for x in re.findall(TERM, text.lower()) if x not in STOP) for name, texts in templates.items() for k, text in enumerate(texts)}
    vectors = spark.createDataFrame([(*form, term, w) for form, term, w in template_weights(named)], "license string, form int, term string, weight double")
    idf = spark.createDataFrame(sorted(idfs(named).items()), "term string, idf double")
    rows = files.where(F.col(text_col).rlike(HINT)).select(F.col(id_col).alias("id"), passages_of(F.col(text_col)).alias("all"))
    passages = rows.select("id", F.explode("all").alias("passage")).where(F.col("passage").rlike(HINT)).withColumn("key", F.md5("passage"))
    # equal passages are scored once
    distinct = passages.groupBy("key").agg(F.first("passage").alias("passage"))
    terms = distinct.select("key", F.explode(F.regexp_extract_all(F.lower("passage"), F.lit(f"({TERM})"), F.lit(1))).alias("term")).where(~F.col("term").isin(*STOP))
    tf = terms.groupBy("key", "term").agg(F.count("*").alias("tf"))
    weighed = tf.join(F.broadcast(idf), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(unseen(named))))
    norms = weighed.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(F.broadcast(vectors), "term").groupBy("key", "license", "form").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    best = dots.join(norms, "key").select("key", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= threshold)
    best = best.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    found = passages.select("id", "key").join(best, "key").groupBy("id").agg(F.min("b").alias("b"))
    return found.select("id", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))


def sentences(line: Column) -> Column:
    """The whole line, and what stands between full stops followed by a blank."""
    return F.array_distinct(F.concat(F.array(line), F.split(line, r"(?<=[.;])\s+", -1)))


def passages_of(text: Column) -> Column:
    """Each line and its sentences, each block of lines between empty lines or the ends of comments, and the whole."""
    lines = F.flatten(F.transform(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(HINT)), sentences))
    return F.array_distinct(F.concat(lines, F.split(text, r"\r?\n[ \t]*\r?\n|\*/|-->", -1), F.array(text)))


def scan(files: DataFrame, is_license_file: Column, threshold: float = 0.6, templates: dict[str, tuple[str, ...]] = FORMS, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """path, own_license, own_score, license, from_dir: a row for each row of files.

    own_license is the best match in the file itself.  license is that, or else the licence of the nearest
    directory above the file which has a licence file with a match (from_dir names it; ties in a directory go to
    the better score, then the lesser name).  A null path or text, or a text without a match, has no own licence;
    a null path inherits nothing.  Rows that repeat a path share the best match of all of them.  An empty table
    gives an empty table; other columns are dropped.
    """
    rows = files.select(F.col(path_col).alias("path"), F.col(text_col).cast("string").alias("text"), F.coalesce(is_license_file, F.lit(False)).alias("is_file"))
    own = own_licenses(rows.where("path IS NOT NULL"), threshold, templates)
    parent = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit(""))
    joined = rows.select("path", "is_file", F.when(F.col("path").isNotNull(), parent).alias("dir")).join(own.withColumnRenamed("id", "path"), "path", "left")
    holders = joined.where("is_file AND license IS NOT NULL").groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b")).select("dir", F.col("b.license").alias("dir_license"))
    # directories inherit first, a row for each different one, so that a directory with many files is no hot key
    dirs = joined.where("dir IS NOT NULL").groupBy("dir").agg(F.count("*").alias("_n")).drop("_n")
    steps = F.split("dir", "/", -1)
    above = let(steps, lambda s: F.transform(F.sequence(F.lit(0), F.size(s)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(s, F.lit(1), k), "/").alias("up"))))
    chain = dirs.select("dir", F.explode(above).alias("a")).select("dir", "a.depth", F.col("a.up").alias("up"))
    near = chain.join(holders.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max(F.struct("depth", "up", "dir_license")).alias("h")).select("dir", F.col("h.up").alias("near"), F.col("h.dir_license").alias("given"))
    out = joined.join(near, "dir", "left")
    license = F.coalesce("license", "given")
    return out.select("path", F.col("license").alias("own_license"), F.col("score").alias("own_score"), license.alias("license"), F.when(F.col("license").isNull() & F.col("given").isNotNull(), F.col("near")).alias("from_dir"))


def sql(files: str, threshold: float = 0.6, templates: dict[str, str] = TEMPLATES) -> str:
    """DuckDB SQL for scan over a table (path, text, is_file) whose paths are different.

    It states the six statements of TEMPLATES, looked for in lines and sentences: the same rows as scan where files
    name their licences by these alone, as those of the given tables do.
    """
    vectors = ", ".join(f"('{a}', '{b}', CAST({c!r} AS DOUBLE))" for a, b, c in template_weights(templates))
    idf = ", ".join(f"('{a}', CAST({b!r} AS DOUBLE))" for a, b in sorted(idfs(templates).items()))
    return f"""
WITH files AS ({files}),
vectors(license, term, weight) AS (VALUES {vectors}),
idf(term, idf) AS (VALUES {idf}),
lines AS (SELECT path, line FROM (SELECT path, unnest(string_split(text, chr(10))) AS line FROM files) WHERE regexp_matches(line, '{CLUE}')),
parts AS (SELECT DISTINCT path, passage FROM (
  SELECT path, line AS passage FROM lines
  UNION ALL SELECT path, unnest(string_split(regexp_replace(line, '([.;])\\s+', '\\1' || chr(10), 'g'), chr(10))) FROM lines) WHERE regexp_matches(passage, '{CLUE}')),
terms AS (SELECT passage, term, count(*) AS tf FROM (SELECT passage, unnest(regexp_extract_all(lower(passage), '({TERM})')) AS term FROM (SELECT DISTINCT passage FROM parts)) GROUP BY passage, term),
weighed AS (SELECT passage, term, tf * coalesce(idf, {unseen(templates)!r}) AS w FROM terms LEFT JOIN idf USING (term)),
norms AS (SELECT passage, sqrt(sum(w * w)) AS norm FROM weighed GROUP BY passage),
dots AS (SELECT passage, license, sum(w * weight) AS dot FROM weighed JOIN vectors USING (term) GROUP BY passage, license),
best AS (SELECT path, license, round(dot / norm, 6) AS score FROM parts JOIN dots USING (passage) JOIN norms USING (passage)),
own AS (SELECT path, license, score FROM best WHERE score >= {threshold} QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, license) = 1),
joined AS (SELECT f.path, is_file, regexp_replace(f.path, '/[^/]*$', '') AS dir, license, score FROM files f LEFT JOIN own USING (path)),
holders AS (SELECT dir, license FROM joined WHERE is_file AND license IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, license) = 1),
near AS (
  SELECT d.dir, h.dir AS near, h.license AS given FROM (SELECT DISTINCT dir FROM joined) d JOIN holders h ON d.dir = h.dir OR starts_with(d.dir, h.dir || '/')
  QUALIFY row_number() OVER (PARTITION BY d.dir ORDER BY length(h.dir) DESC) = 1
)
SELECT path, license AS own_license, score AS own_score, coalesce(license, given) AS license, CASE WHEN license IS NULL AND given IS NOT NULL THEN near END AS from_dir
FROM joined LEFT JOIN near USING (dir)"""
