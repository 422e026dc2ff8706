"""Caption files: SRT and VTT cues."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stamp(text: str) -> int:
    m = re.fullmatch(r"(?:(\d+):)?(\d{1,2}):(\d{1,2})[.,](\d{1,3})", text.strip())
    if not m or int(m[2]) > 59 or int(m[3]) > 59:
        raise ValueError(f"no time: {text!r}")
    return int(m[1] or 0) * 3_600_000 + int(m[2]) * 60_000 + int(m[3]) * 1000 + int(m[4].ljust(3, "0"))


def cues(text: str, kind: str) -> list[tuple[int, int, str]]:
    """(start_ms, end_ms, text) of each cue; lines of a cue are joined by ``<br>``.  Any other block is an error."""
    out = []
    for block in re.split(r"\n[ \t]*\n", text.lstrip("\ufeff").replace("\r\n", "\n").replace("\r", "\n").strip("\n")):
        lines = [x.strip() for x in block.split("\n") if x.strip()]
        if not lines or kind == "vtt" and re.match(r"WEBVTT|NOTE|STYLE|REGION", lines[0]):
            continue
        at = next((k for k, x in enumerate(lines[:2]) if "-->" in x), None)
        if at is None:
            raise ValueError(f"a block without times: {lines[0][:60]!r}")
        a, _, b = lines[at].partition("-->")
        start, end = stamp(a), stamp(b.split()[0] if b.split() else "")
        if end < start:
            raise ValueError("a cue ends before it starts")
        out.append((start, end, "<br>".join(lines[at + 1 :])))
    return out


def parse_captions(files: DataFrame, key: str = "name", kind: str = "format", text: str = "text") -> DataFrame:
    """key, idx, start_ms, end_ms, text, status: a row for each cue; a file that cannot be read has one row that says why."""
    rows = files.select(F.col(key).alias("k"), F.col(kind).alias("f"), F.col(text).alias("t"))
    name = rows.schema["k"].dataType.simpleString()

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, f, t in zip(b["k"], b["f"], b["t"]):
                try:
                    out += [(k, n, s, e, x, "ok") for n, (s, e, x) in enumerate(cues(t or "", f), 1)]
                except ValueError as e:
                    out.append((k, None, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["key", "idx", "start_ms", "end_ms", "text", "status"]).astype({"idx": "Int32", "start_ms": "Int64", "end_ms": "Int64"})

    return rows.mapInPandas(each, f"key {name}, idx int, start_ms long, end_ms long, text string, status string")
