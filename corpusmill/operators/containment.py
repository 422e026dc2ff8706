"""Which texts hold which passages: an exact containment join over a corpus, by rare substrings.

A passage lies in a text only if each of its substrings does.  Of each passage a few substrings of 16 bytes (of 8, or all of it,
if it is shorter) are picked by their hashes; the texts are scanned once for them, through a bitmap of fixed size, so
that only places that may match become rows.  The substring that is in the fewest texts is the passage's join key; a
passage with a substring that is in no text is out at once.  What the keys bring together is then compared exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, forget

#: Of the bitmap, which is sent to all tasks: 2^23 bits are 1 MB, whatever the number of passages.
BITS = 23
#: How many substrings of a passage are candidates for its key.
PICKED = 8
SLICE = 1 << 20
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def width_of(size: int) -> int:
    """Bytes of the substrings of a passage of so many bytes."""
    return 16 if size >= 16 else min(size, 8)


def window_hashes(data: np.ndarray, start: int, stop: int, width: int) -> np.ndarray:
    """A hash of each substring of ``width`` bytes that begins from start to stop; data has 16 bytes more behind it."""
    words = np.ndarray((stop - start,), "<u8", data.data, start, (1,))
    if width < 8:
        words = words & np.uint64((1 << 8 * width) - 1)
    out = (words ^ np.uint64(width)) * _ODD[0]
    out ^= out >> np.uint64(29)
    if width == 16:
        out += np.ndarray((stop - start,), "<u8", data.data, start + 8, (1,)) * _ODD[1]
        out ^= out >> np.uint64(32)
    out *= _ODD[2]
    return out ^ (out >> np.uint64(31))


def padded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of these texts with 16 more, and where each begins, with the end of the last; null is empty."""
    import pyarrow.compute as pc

    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    own = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.concatenate([own, np.zeros(16, np.uint8)]), ends - ends[0]


def keys_of_parts(parts: DataFrame) -> DataFrame:
    """part_id, width, key: the picked substrings of each passage (columns part_id and part)."""

    def each(batches):
        for batch in batches:
            data, ends = padded(batch.column("part"))
            which, widths, keys = [], [], []
            for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                if a < b:
                    width = width_of(b - a)
                    found = np.unique(window_hashes(data, a, b - width + 1, width))[:PICKED]
                    which.append(np.full(len(found), k)), widths.append(np.full(len(found), width)), keys.append(found.view(np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([batch.column("part_id").take(pa.array(np.concatenate(which))), pa.array(np.concatenate(widths), pa.int32()), pa.array(np.concatenate(keys))], ["part_id", "width", "key"])

    kind = parts.schema["part_id"].dataType.simpleString()
    return parts.select("part_id", "part").mapInArrow(each, f"part_id {kind}, width int, key long")


def bitmap(keys: DataFrame) -> np.ndarray:
    """The bits of all keys, put together in the tasks; a megabyte of each is all that is moved."""

    def each(batches):
        bits = np.zeros(1 << BITS, bool)
        for batch in batches:
            bits[batch.column("key").to_numpy() & ((1 << BITS) - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["at", "bits"])

    def both(rows: pd.DataFrame) -> pd.DataFrame:
        out = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in rows["bits"]], axis=0)
        return pd.DataFrame({"at": [0], "bits": [out.tobytes()]})

    schema = "at long, bits binary"
    found = keys.select("key").coalesce(8).mapInArrow(each, schema).groupBy("at").applyInPandas(both, schema).collect()
    return np.unpackbits(np.frombuffer(found[0]["bits"], np.uint8)).astype(bool) if found else np.zeros(1 << BITS, bool)


def keys_in_docs(docs: DataFrame, bits: np.ndarray, widths: list[int]) -> DataFrame:
    """id, key: the substrings of each text (columns id and text) that the bitmap knows."""

    packed = np.packbits(bits)

    def each(batches):
        known = np.unpackbits(packed).astype(bool)
        for batch in batches:
            data, ends = padded(batch.column("text"))
            rows, keys = [], []
            for width in widths:
                for a in range(0, int(ends[-1]), SLICE):
                    b = min(a + SLICE, int(ends[-1]))
                    hashes = window_hashes(data, a, b, width)
                    at = np.flatnonzero(known[hashes.view(np.int64) & ((1 << BITS) - 1)])
                    row = np.searchsorted(ends, at + a, "right") - 1
                    inside = at + a + width <= ends[row + 1]
                    rows.append(row[inside]), keys.append(hashes[at[inside]].view(np.int64))
            if rows:
                pair = np.unique(np.stack([np.concatenate(rows), np.concatenate(keys)]), axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(pair[0])), pa.array(pair[1])], ["id", "key"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").mapInArrow(each, f"id {kind}, key long")


def holders(parts: DataFrame, docs: DataFrame, part_id: str = "part_id", part: str = "part", id_col: str = "doc_id", text_col: str = "text", normal=None) -> DataFrame:
    """part_id, id, start (of the first place, from 0, in characters), n (places that don't overlap).

    normal: a function of a column that both sides go through first, such as ``without_space``.  A null or empty
    passage is held by nothing; rows that repeat an id are one.  Nothing is sampled: the substrings only choose which
    pairs are compared.
    """
    form = normal or (lambda c: c)
    named: Column = form(F.col(part).cast("string"))
    left = cut(parts.select(F.col(part_id).alias("part_id"), named.alias("part")).where("part <> ''").distinct())
    right = docs.select(F.col(id_col).alias("id"), form(F.col(text_col).cast("string")).alias("text"))
    keys = cut(keys_of_parts(left))
    widths = sorted(r["width"] for r in keys.select("width").distinct().collect())  # nine at most
    seen = cut(keys_in_docs(right, bitmap(keys), widths).distinct().join(keys.select("key").distinct(), "key", "left_semi"))
    df = seen.groupBy("key").agg(F.count("*").alias("df"))
    rarest = keys.join(df, "key", "left").groupBy("part_id").agg(F.min(F.coalesce("df", F.lit(0))).alias("least"), F.min_by("key", F.struct(F.coalesce("df", F.lit(0)), "key")).alias("key")).where("least > 0")
    pairs = cut(rarest.join(seen, "key").select("part_id", "id").distinct())
    both = pairs.join(left, "part_id").join(right, "id").where(F.contains("text", F.col("part")))
    places = ((F.length("text") - F.length(F.replace("text", F.col("part"), F.lit("")))) / F.length("part")).cast("long")
    out = cut(both.groupBy("part_id", "id").agg(F.min((F.expr("locate(part, text)") - 1).cast("long")).alias("start"), F.max(places).alias("n")))
    forget(left, keys, seen, pairs)
    return out
