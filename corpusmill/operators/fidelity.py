"""Coverage of a source by a final text: chunks, anchors and the audit of a ledger."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import TIMESTAMP, is_vague, least_units, nonspace_length, numeric_anchors, question_anchors, without_space

#: Fixed values of the ledger.
KINDS = ("claim", "reasoning", "example", "anecdote", "comparison", "number_or_date", "person_or_entity", "question_answer", "prediction", "correction", "qualification", "other")
OMISSIONS = ("exact_repetition", "filler", "transcription_noise", "navigation_noise")
NUMBER_STATES = ("covered", "corrected", "excluded")
DENSITY = 450
CHARACTERS = "字符 "
QUESTION_STATES = ("covered", "partial", "unanswered", "rhetorical", "noise")


def chunk_spans(text: str, most: int = 1200) -> Iterator[tuple[int, int]]:
    """Ranges that follow each other over the text, each ending after the last good border of its last part."""
    if most < 400:
        raise ValueError("chunks have 400 characters at least")
    start = 0
    while start < len(text):
        limit = min(len(text), start + most)
        end = limit
        if limit < len(text):
            floor = start + max(1, int(most * 0.6))
            at = max((text.rfind(mark, floor, limit), mark) for mark in ("\n\n", "\n", "。", "！", "？"))
            if at[0] >= 0:
                end = at[0] + (2 if text.startswith("\n\n", at[0]) else 1)
        yield start, end
        start = end


def chunks(docs: DataFrame, most: int = 1200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, idx from 1, start, end, chunk: the chunks of each text.  The cuts depend on each other, so a text is cut by
    one Arrow-batched function; a null or empty text has none."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, k, a, b, t[a:b]) for d, t in zip(batch["id"], batch["text"]) if t for k, (a, b) in enumerate(chunk_spans(t, most), 1)]
            yield pd.DataFrame(rows, columns=["id", "idx", "start", "end", "chunk"])

    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    return plain.mapInPandas(cut, f"id {kind}, idx int, start long, end long, chunk string")


def coverage_units(cut: DataFrame) -> DataFrame:
    """The ledger's units: id, unit, range, hash, locator, least information units, anchors.

    The locator is the chunk's time stamp, its first and last one if it has several, or its range of characters from 1."""
    stamps = F.regexp_extract_all("chunk", F.lit(TIMESTAMP), F.lit(1))
    range_of = F.concat(F.lit(CHARACTERS), F.col("start") + 1, F.lit("–"), F.col("end"))
    locator = F.when(F.size(stamps) > 1, F.concat_ws("–", F.get(stamps, F.lit(0)), F.element_at(stamps, -1))).when(F.size(stamps) == 1, F.get(stamps, F.lit(0))).otherwise(range_of)
    return cut.select(
        "id", F.format_string("U%03d", "idx").alias("unit"), F.col("start").alias("source_start_char"), F.col("end").alias("source_end_char"), F.sha2("chunk", 256).alias("source_sha256"),
        locator.alias("source_locator"), F.col("chunk").alias("source_text"), least_units(F.col("chunk")).alias("minimum_information_units"),
        numeric_anchors(F.col("chunk")).alias("numeric_anchors"), question_anchors(F.col("chunk")).alias("question_anchors"),
    )


def _long(x: Column, n: int) -> Column:
    return F.coalesce(nonspace_length(x) >= n, F.lit(False))


def _evidence(evidence: Column, final: Column) -> Column:
    """Long enough and in the final text, white space aside."""
    return F.coalesce((nonspace_length(evidence) >= 8) & F.contains(final, without_space(evidence)), F.lit(False))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once for all its uses inside f."""
    return F.get(F.transform(F.array(value), f), 0)


def _list(value: Column) -> Column:
    return F.coalesce(value, F.array())


def _unit_issues(u: Column, k: Column, units: Column, source: Column, final: Column) -> Column:
    """What is wrong with the k-th unit, as an array."""
    info, start, end = _list(u["information_units"]), u["source_start_char"], u["source_end_char"]
    before = F.when(k > 0, F.get(units, k - 1)["source_end_char"]).otherwise(0)

    def checks(body: Column) -> Column:  # body: the unit's text without white space
        least = F.greatest(F.lit(1), F.ceil(F.length(body) / DENSITY)).cast("long")
        number = lambda x: F.coalesce(
            ((x["status"] == "covered") & _evidence(x["final_evidence"], final) & F.contains(x["final_evidence"], x["source_value"]))
            | ((x["status"] == "corrected") & _evidence(x["final_evidence"], final) & _long(x["reason"], 6))
            | ((x["status"] == "excluded") & _long(x["reason"], 6)), F.lit(False))
        question = lambda x: F.coalesce(
            (x["status"].isin("covered", "partial", "unanswered", "rhetorical") & _evidence(x["final_evidence"], final)) | ((x["status"] == "noise") & _long(x["reason"], 6)), F.lit(False)
        )
        named = {
            "unit ids are not consecutive": u["id"] != F.format_string("U%03d", (k + 1).cast("int")),
            "ranges do not touch": start != before,
            "text differs from the source": u["source_text"] != F.substring(source, start.cast("int") + 1, (end - start).cast("int")),
            "hash differs from the text": u["source_sha256"] != F.sha2(u["source_text"], 256),
            "minimum differs from the rule": u["minimum_information_units"] != least,
            "too few information units": F.size(info) < u["minimum_information_units"],
            "unknown kind": F.exists(info, lambda x: F.coalesce(~x["kind"].isin(*KINDS), F.lit(True))),
            "vague or short detail": F.exists(info, lambda x: ~_long(x["source_detail"], 8) | F.coalesce(is_vague(x["source_detail"]), F.lit(True))),
            "detail is not in its chunk": F.exists(info, lambda x: ~F.coalesce(F.contains(body, without_space(x["source_detail"])), F.lit(False))),
            "evidence is not in the final text": F.exists(info, lambda x: ~_evidence(x["final_evidence"], final)),
            "number not accounted for": F.exists(_list(u["numeric_anchors"]), lambda x: ~number(x)),
            "question not accounted for": F.exists(_list(u["question_anchors"]), lambda x: ~question(x)),
            "unknown omission": F.exists(_list(u["omissions"]), lambda x: ~F.coalesce(x["reason"].isin(*OMISSIONS) & _long(x["source_detail"], 4), F.lit(False))),
        }
        return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.concat_ws(": ", u["id"], F.lit(name))) for name, c in named.items()]))

    return _let(F.coalesce(without_space(u["source_text"]), F.lit("")), checks)


def audit(ledger: DataFrame) -> DataFrame:
    """id, issues, and the totals of a ledger.

    ledger: id, source_text, final_text, units array<struct<...>> as in FIXTURES A4.  Every violation is reported.  A
    ledger is one row and is judged where it lies: nothing is shuffled, the final text is normalised once, and no
    text is copied for a unit.
    """
    units = F.col("units")
    all_info = F.flatten(F.transform(units, lambda u: _list(u["information_units"])))
    per_unit = _let(F.coalesce(without_space(F.col("final_text")), F.lit("")), lambda final: F.flatten(F.transform(units, lambda u, k: _unit_issues(u, k, units, F.col("source_text"), final))))

    def repeated(field: str, name: str) -> Column:
        """Details and evidence are unique over the ledger."""
        return _let(F.transform(all_info, lambda x: without_space(x[field])), lambda v: F.when(F.size(F.array_distinct(v)) < F.size(v), f"repeated {name}"))

    end = F.coalesce(F.array_max(F.transform(units, lambda u: u["source_end_char"])), F.lit(0))
    ends = F.when(end != F.coalesce(F.length("source_text"), F.lit(0)), "the source is not covered to its end")
    issues = F.concat(_list(per_unit), F.array_compact(F.array(repeated("source_detail", "detail"), repeated("final_evidence", "evidence"), ends)))
    size = lambda c: F.coalesce(F.aggregate(F.transform(units, lambda u: F.size(_list(u[c]))), F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    return ledger.select(
        "id", issues.alias("issues"), F.coalesce(F.when(units.isNotNull(), F.size(units)), F.lit(0)).cast("long").alias("units"), size("information_units").alias("information_units"),
        size("numeric_anchors").alias("numbers"), size("question_anchors").alias("questions"), size("omissions").alias("omissions"),
    )


def assemble(docs: DataFrame, begin: str, end: str, head: str = "head", body: str = "body", full: str = "full_text") -> DataFrame:
    """docs with ``record``: head and body, and the exact full text between its markers, with its hash."""
    record = F.concat(F.concat_ws("\n\n", F.col(head), F.col(body), F.concat(F.lit(begin + "\n"), F.col(full), F.lit("\n" + end))), F.lit("\n"))
    return docs.withColumns({"record": record, "full_sha256": F.sha2(full, 256)})


def verify_full_text(records: DataFrame, begin: str, end: str, record: str = "record", sha: str = "full_sha256") -> DataFrame:
    """records with ``intact``: the markers occur once, and what stands between them has the recorded hash."""
    from ..functions.text import between

    inner = between(F.col(record), begin + "\n", "\n" + end)
    return records.withColumn("intact", F.coalesce(F.sha2(inner, 256) == F.col(sha), F.lit(False)))
