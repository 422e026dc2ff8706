"""What Spark's own functions cannot express, as Arrow-batched functions."""

from __future__ import annotations

import html
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

#: Texts of these characters only are the same after NFKC, so they need no Python.
STABLE = r"^[\x00-\x7fÀ-ÿ㐀-䶿一-鿿]*$"


@pandas_udf(StringType())
def nfkc_lower(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).lower())


def with_folded(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with lower(NFKC(text)), in one pass; only texts that NFKC could change are sent to Python, nulls for all others."""
    changes = ~F.coalesce(F.col(text).rlike(STABLE), F.lit(True))
    return df.withColumn(out, F.coalesce(nfkc_lower(F.when(changes, F.col(text))), F.lower(text)))


@pandas_udf(StringType())
def html_unescape(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else html.unescape(t))


@pandas_udf(DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of characters in the longest matching blocks of two texts."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def _declared(data: bytes) -> list[str]:
    import re

    found = re.search(rb"charset\s*=\s*[\"']?\s*([A-Za-z0-9._-]+)", data[:8192], re.I)
    return [found[1].decode("ascii")] if found else []


def _first(data: bytes, names: list[str], no_nul: bool = False) -> tuple[str, str] | None:
    for name in names:
        try:
            text = data.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
        if not (no_nul and "\0" in text and not name.lower().startswith("utf-16")):
            return text, name
    return None


def decode_bytes(data: bytes, policy: str = "sniff", declared: str | None = None) -> tuple[str, str]:
    """(text, encoding).  sniff: BOM, declared name, name in the text, UTF-8, GB18030, Big5, else UTF-8 with marks
    for what is no character.  archive: UTF-8, UTF-16, GB18030, else an error.  transcript: by BOM, UTF-8, GB18030,
    else an error."""
    bom = [n for mark, n in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")) if data.startswith(mark)]
    if policy == "sniff":
        names = bom + ([declared] if declared else []) + _declared(data) + ["utf-8-sig", "utf-8", "gb18030", "big5"]
        return _first(data, names, no_nul=True) or (data.decode("utf-8", "replace"), "utf-8-replace")
    names = {"archive": ["utf-8-sig", "utf-16", "gb18030"], "transcript": [*bom, "utf-8", "gb18030"]}[policy]
    found = _first(data, names)
    if not found:
        raise UnicodeError("no known encoding")
    return found


def decode_udf(policy: str = "sniff"):
    """struct<text,encoding,error> of binary content."""

    @pandas_udf(StructType([StructField(c, StringType()) for c in ("text", "encoding", "error")]))
    def decode(content: pd.Series) -> pd.DataFrame:
        rows = []
        for data in content:
            try:
                rows.append((None, None, None) if data is None else (*decode_bytes(bytes(data), policy), None))
            except UnicodeError as e:
                rows.append((None, None, str(e)))
        return pd.DataFrame(rows, columns=["text", "encoding", "error"])

    return decode
