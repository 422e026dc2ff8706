"""Quality rules for whole texts, with DataFrame functions only.

Base rules: too few words, or too many words inside repeated three-word windows.  Beyond them a document is held
against its language: the Jensen-Shannon distances between its histograms of character classes and of
common words and those of the language's other documents that pass the base rules.  What the judged document itself adds to
them is left out.  The common words are the ``n_common`` most frequent in those documents, out of the ``n_candidates`` most
frequent in all documents of the language.  A histogram of a short text says little, so each distance counts only from a
least length on; and a few documents say little of a language, so one with fewer than ``min_documents`` or
``min_reference_words`` that pass, like a document without a language, is held against all documents.

One pass counts the words of each language (combined before the shuffle); one makes the histograms, for all languages whose
candidates fit into one look-up, or for so many languages at a time if they don't.  What it keeps of a text are
some numbers and its candidate words.  The references are a row for each language.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """min_words and repeat_percent are the base rules; the others bound the distances (0 to 1) and guard them.

    The bounds come from the labelled documents of sf0.1 that pass the base rules: README has how they part good
    ones from bad ones there and on other tables.
    """

    min_words: int = 50
    repeat_percent: int = 50
    max_char_distance: float = 0.28
    max_word_distance: float = 0.4
    min_chars: int = 200
    min_judged_words: int = 100
    n_common: int = 32
    n_candidates: int = 128
    min_documents: int = 16
    min_reference_words: int = 4000
    languages_at_once: int = 256


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once for all its uses inside f."""
    return F.get(F.transform(F.array(value), f), 0)


def without(text: Column, characters: str, put: str = "") -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(put))
    return text


def repeat_words(words: Column) -> Column:
    """How many words lie in a three-word window that is found twice or more.

    Windows are compared by 64-bit hashes: sorted with their places, equal ones are neighbours.
    """
    grams = F.when(F.size(words) < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    )

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        add = lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(3), x - acc["last"])).alias("n"))
        return F.aggregate(places, start, add, lambda acc: acc["n"])

    def count(g: Column) -> Column:
        placed = F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(let(F.sort_array(placed), covered))

    return let(grams, count)


def words_in(text: Column) -> Column:
    return F.array_remove(F.split(without(text, "\t\n\x0b\x0c\r", " "), " "), "")


def total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)


def candidates(docs: DataFrame, rules: Rules, text_col: str, lang_col: str, scratch: Scratch) -> DataFrame:
    """lang, words: the most frequent words of each language that may have a reference, and of all documents (null lang)."""
    rows = docs.select(F.col(lang_col).alias("lang"), words_in(F.col(text_col).cast("string")).alias("words"))
    counts = scratch.keep(rows.select("lang", F.explode("words").alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n")), "words")
    large = counts.where("lang IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("_n")).where(F.col("_n") >= rules.min_reference_words).drop("_n")

    def top(rows: DataFrame, keys: list[str]) -> DataFrame:
        first = Window.partitionBy(*keys).orderBy(F.desc("n"), "word")
        few = rows.withColumn("k", F.row_number().over(first)).where(F.col("k") <= rules.n_candidates) if keys else rows.orderBy(F.desc("n"), "word").limit(rules.n_candidates)
        return few.groupBy(*keys).agg(F.collect_list("word").alias("words"))

    every = top(counts.groupBy("word").agg(F.sum("n").alias("n")), []).select(F.lit(None).cast("string").alias("lang"), "words")
    # ranked first, since every task then sends a few words of a language alone
    return scratch.keep(top(counts.where("lang IS NOT NULL"), ["lang"]).join(large, "lang", "left_semi").unionByName(every), "candidates")


def measures(docs: DataFrame, listed: DataFrame, rules: Rules, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """doc_id, version, lang, the base counts, the histogram chars, and said: the words that are candidates of a language."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n = F.length(text).cast("long")
    counts = [F.regexp_count(text, F.lit(p)).cast("long") for p in (r"[A-Z]", r"[0-9]", r"[!-/:-@\[-`{-~]")]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"), F.col(lang_col).alias("lang"))
    pooled = {x for r in listed.where("lang IS NULL").collect() for x in r["words"]}
    own = sorted((r["lang"] for r in listed.where("lang IS NOT NULL").select("lang").collect()))
    parts = [own[k : k + rules.languages_at_once] for k in range(0, len(own), rules.languages_at_once)]

    def measured(rows: DataFrame, known: set[str]) -> DataFrame:
        words = sorted(known)

        def of_words(w: Column) -> Column:
            said = F.concat(F.lit(" "), F.array_join(F.filter(w, lambda x: x.isin(words)), "  "), F.lit(" ")) if words else F.lit("  ")
            return F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words"), said.alias("said"))

        return rows.select(
            "doc_id",
            F.xxhash64("_text").alias("version"),
            "lang",
            let(words_in(text), of_words).alias("w"),
            n.alias("n_chars"),
            F.length(without(text, " \t\n\x0b\x0c\r")).cast("long").alias("word_chars"),
            (n - F.length(without(text, SYMBOLS))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            # upper case, digits, punctuation, the bytes beyond one that characters take
            F.array(*counts, (F.octet_length(text) - n).cast("long")).alias("marks"),
        ).select(
            "doc_id", "version", "lang", "n_chars", "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words", "w.said",
            F.concat("marks", F.array(F.col("n_chars") - F.col("word_chars"), F.col("word_chars") - F.get("marks", F.lit(0)) - F.get("marks", F.lit(1)) - F.get("marks", F.lit(2)))).alias("chars"),
        )

    if len(parts) < 2:
        return measured(rows, pooled | {x for r in listed.collect() for x in r["words"]})
    # one look-up of all languages would be too large: each of the parts reads its own documents
    out = measured(rows.where(F.col("lang").isNull() | ~F.col("lang").isin(own)), pooled)
    for part in parts:
        out = out.union(measured(rows.where(F.col("lang").isin(part)), pooled | {x for r in listed.where(F.col("lang").isin(part)).collect() for x in r["words"]}))
    return out


def references(seen: DataFrame, listed: DataFrame, rules: Rules) -> DataFrame:
    """_lang, words, all_commons (last that of all other words), all_chars of the documents that pass the base rules.

    A row for each language with enough of them, and one (null) for all."""
    good = seen.where(~base_failed(rules))
    chars = [F.sum(F.get("chars", F.lit(i))).alias(f"c{i}") for i in range(6)]
    by_lang = good.groupBy("lang").agg(*chars, F.sum("n_words").alias("n_words"), F.count("*").alias("docs"))
    enough = (F.col("docs") >= rules.min_documents) & (F.col("n_words") >= rules.min_reference_words) & F.col("lang").isNotNull()
    pooled = by_lang.agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(6)], F.sum("n_words").alias("n_words")).select(F.lit(None).cast("string").alias("lang"), *[f"c{i}" for i in range(6)], "n_words")
    sums = by_lang.where(enough).select(pooled.columns).unionByName(pooled)
    said = good.select("lang", F.explode(F.split(F.expr("substring(said, 2, length(said) - 2)"), "  ", -1)).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n")).where("word <> ''")
    own = said.where("lang IS NOT NULL").unionByName(said.groupBy("word").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "word", "n"))
    may = listed.select(F.col("lang").alias("l"), F.explode("words").alias("v"))
    counted = own.join(may, F.col("lang").eqNullSafe(F.col("l")) & (F.col("word") == F.col("v"))).select("lang", "word", "n")
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = counted.withColumn("k", F.row_number().over(first)).where(F.col("k") <= rules.n_common).groupBy(F.col("lang").alias("t")).agg(F.sort_array(F.collect_list(F.struct("k", "word", "n"))).alias("w"))
    both = sums.join(top, F.col("lang").eqNullSafe(F.col("t")), "left")
    known = F.coalesce(F.transform("w", lambda x: x["n"]), F.array().cast("array<bigint>"))
    words = F.coalesce(F.col("w.word"), F.array().cast("array<string>"))
    return both.select(F.col("lang").alias("_lang"), words.alias("words"), F.concat(known, F.array(F.col("n_words") - total(known))).alias("all_commons"), F.array(*[f"c{i}" for i in range(6)]).alias("all_chars"))


def base_failed(rules: Rules) -> Column:
    return (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.repeat_percent * F.col("n_words"))


def distance(p: Column, q: Column, p_total: Column, q_total: Column) -> Column:
    """Jensen-Shannon distance (square root of the divergence in bits) of two histograms."""

    def part(a: Column, b: Column) -> Column:
        x, y = a / p_total, b / q_total
        m = (x + y) / 2
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0) + F.when(y > 0, y * F.log2(y / m)).otherwise(0.0)

    return F.sqrt(F.greatest(F.aggregate(F.zip_with(p, q, part), F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def assess(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, version (a hash of the text), the counts, base_failed, js_chars, js_words and kept of each row.

    A null text has no words and fails; a text under a guard, or one that nothing else can be held against, has no distance
    (null) and is kept if it passes the base rules; a null or small language is held against all documents.  Repeated rows
    are judged alike; other columns are dropped; an empty table gives an empty table.  Windows and equal texts are
    told by 64-bit hashes.
    """
    scratch = Scratch(docs.sparkSession)
    listed = candidates(docs, rules, text_col, lang_col, scratch)
    seen = scratch.keep(measures(docs, listed, rules, id_col, text_col, lang_col), "measures")
    refs = scratch.keep(references(seen, listed, rules), "references")
    pooled = refs.where("_lang IS NULL").select(F.struct("words", "all_commons", "all_chars").alias("_all"))  # one row
    own = refs.where("_lang IS NOT NULL").select("_lang", F.struct("words", "all_commons", "all_chars").alias("_own"))
    failed = base_failed(rules)
    both = seen.join(own, F.col("lang") == F.col("_lang"), "left").crossJoin(F.broadcast(pooled)).withColumn("r", F.coalesce("_own", "_all"))
    # how often each common word was said
    often = lambda said: F.transform("r.words", lambda x: ((F.length(said) - F.length(F.replace(said, F.concat(F.lit(" "), x, F.lit(" ")), F.lit("")))) / (F.length(x) + 2)).cast("long"))
    both = both.withColumn("c", often(F.col("said"))).withColumn("commons", F.concat("c", F.array(F.col("n_words") - total(F.col("c")))))
    # a document that passes is in the reference: its own counts are taken out
    others = lambda ref, mine: F.zip_with(ref, mine, lambda q, p: F.when(failed, q).otherwise(q - p))
    both = both.withColumns({"other_chars": others("r.all_chars", "chars"), "other_commons": others("r.all_commons", "commons")})
    size = lambda c: total(F.col(c)).cast("double")
    both = both.withColumns({"c_total": size("chars"), "w_total": F.col("n_words").cast("double"), "chars_total": size("other_chars"), "commons_total": size("other_commons")})
    enough = lambda n, least, others: (F.col(n) >= least) & (F.col(others) > 0)
    chars = F.when(enough("n_chars", rules.min_chars, "chars_total"), F.round(distance(F.col("chars"), F.col("other_chars"), F.col("c_total"), F.col("chars_total")), 6))
    words = F.when(enough("n_words", rules.min_judged_words, "commons_total"), F.round(distance(F.col("commons"), F.col("other_commons"), F.col("w_total"), F.col("commons_total")), 6))
    out = both.select("doc_id", "version", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), chars.alias("js_chars"), words.alias("js_words"))
    far = F.coalesce(F.col("js_chars") > rules.max_char_distance, F.lit(False)) | F.coalesce(F.col("js_words") > rules.max_word_distance, F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~far)


def keep_good(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    # a table in between: a filter on ``kept`` that is pushed below what it is made of repeats the distances in each other
    judged = Scratch(docs.sparkSession).keep(assess(docs, rules, id_col, text_col, lang_col), "judged")
    good = judged.where("kept").select(F.col("doc_id").alias("_id"), F.col("version").alias("_version")).distinct()
    return docs.join(good, F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(text_col) == F.col("_version")), "left_semi")


def sql(docs: str = "documents", rules: Rules = Rules()) -> str:
    """DuckDB SQL for assess without the column version; for small tables."""
    blanks = r"[\x20\x09-\x0D]"
    word = r"[^\x20\x09-\x0D]+"
    js = "sqrt(greatest(list_sum([CASE WHEN {p}[i] > 0 THEN {p}[i] / {a} * log2(({p}[i] / {a}) / (({p}[i] / {a} + {q}[i] / {b}) / 2)) ELSE 0.0 END + CASE WHEN {q}[i] > 0 THEN {q}[i] / {b} * log2(({q}[i] / {b}) / (({p}[i] / {a} + {q}[i] / {b}) / 2)) ELSE 0.0 END FOR i IN range(1, {k})]) / 2, 0.0))"
    chars = js.format(p="chars", q="other_chars", a="list_sum(chars)", b="list_sum(other_chars)", k=7)
    words = js.format(p="commons", q="others", a="n_words", b="list_sum(others)", k="len(commons) + 1")
    sums = ", ".join(f"sum(chars[{i}])" for i in range(1, 7))
    return f"""
WITH base AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}') AS ws FROM {docs}
), tokens AS (
  SELECT doc_id, lang, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM base
), by_lang AS (
  SELECT lang, w, count(*) AS n FROM tokens WHERE lang IS NOT NULL GROUP BY lang, w UNION ALL SELECT NULL, w, count(*) FROM tokens GROUP BY w
), candidates AS (
  SELECT lang, w FROM by_lang QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) <= {rules.n_candidates}
), windows AS (
  SELECT doc_id, i, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM tokens WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), twice AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w, w2, w3) > 1 AS hit FROM windows WHERE w3 IS NOT NULL
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest(range(0, 3)) AS k) WHERE hit GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM base) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id
), counted AS (
  SELECT doc_id, lang, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(t) AS BIGINT) AS n_chars, CAST(length(regexp_replace(t, '{blanks}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    len(regexp_extract_all(t, '[A-Z]')) AS u, len(regexp_extract_all(t, '[0-9]')) AS d, len(regexp_extract_all(t, '[!-/:-@\\[-`{{-~]')) AS p, strlen(t) - length(t) AS x
  FROM base LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
), shaped AS (
  SELECT *, [u, d, p, x, n_chars - word_chars, word_chars - u - d - p] AS chars, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.repeat_percent} * n_words AS base_failed FROM counted
), sums AS (
  SELECT lang, [{sums}] AS all_chars, sum(n_words) AS said FROM shaped WHERE NOT base_failed AND lang IS NOT NULL GROUP BY lang HAVING count(*) >= {rules.min_documents} AND sum(n_words) >= {rules.min_reference_words}
  UNION ALL SELECT NULL, [{sums}], sum(n_words) FROM shaped WHERE NOT base_failed
), good AS (
  SELECT lang, w, count(*) AS n FROM tokens SEMI JOIN (SELECT doc_id FROM shaped WHERE NOT base_failed) USING (doc_id) GROUP BY lang, w
), ranked AS (
  SELECT g.lang, g.w, g.n, row_number() OVER (PARTITION BY g.lang ORDER BY g.n DESC, g.w) AS k
  FROM (SELECT lang, w, n FROM good WHERE lang IS NOT NULL UNION ALL SELECT NULL, w, sum(n) FROM good GROUP BY w) g JOIN candidates c ON c.lang IS NOT DISTINCT FROM g.lang AND c.w = g.w
), top AS (
  SELECT lang, w, n, k FROM ranked WHERE k <= {rules.n_common}
), refs AS (
  SELECT s.lang, all_chars, coalesce(list_append(l, CAST(said - m AS BIGINT)), [CAST(said AS BIGINT)]) AS all_commons
  FROM sums s LEFT JOIN (SELECT lang, list(CAST(n AS BIGINT) ORDER BY k) AS l, sum(n) AS m FROM top GROUP BY lang) t ON t.lang IS NOT DISTINCT FROM s.lang
), placed AS (
  SELECT shaped.*, r.lang AS ref FROM shaped LEFT JOIN refs r ON r.lang = shaped.lang
), found AS (
  SELECT doc_id, w, count(*) AS n FROM tokens GROUP BY doc_id, w
), common AS (
  SELECT p.doc_id, list(coalesce(f.n, 0) ORDER BY top.k) AS c FROM placed p JOIN top ON top.lang IS NOT DISTINCT FROM p.ref LEFT JOIN found f ON f.doc_id = p.doc_id AND f.w = top.w GROUP BY p.doc_id
), held AS (
  SELECT p.*, list_append(coalesce(c, []), n_words - coalesce(list_sum(c), 0)) AS commons, r.all_chars, r.all_commons FROM placed p LEFT JOIN common USING (doc_id) JOIN refs r ON r.lang IS NOT DISTINCT FROM p.ref
), apart AS (
  SELECT *, CASE WHEN base_failed THEN all_chars ELSE [all_chars[i] - chars[i] FOR i IN range(1, 7)] END AS other_chars, CASE WHEN base_failed THEN all_commons ELSE [all_commons[i] - commons[i] FOR i IN range(1, len(commons) + 1)] END AS others FROM held
), judged AS (
  SELECT *, CASE WHEN n_chars >= {rules.min_chars} AND list_sum(other_chars) > 0 THEN round({chars}, 6) END AS js_chars, CASE WHEN n_words >= {rules.min_judged_words} AND list_sum(others) > 0 THEN round({words}, 6) END AS js_words FROM apart
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, js_chars, js_words,
  NOT base_failed AND NOT coalesce(js_chars > {rules.max_char_distance}, false) AND NOT coalesce(js_words > {rules.max_word_distance}, false) AS kept
FROM judged"""
