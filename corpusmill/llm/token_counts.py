"""Token counts of the sections of a text, from one encoding of the whole text.

A document is encoded once; the tokens' spans and the sections' spans are joined as intervals.  A token that
crosses a border goes to the section that holds most of its bytes, the first of them at a tie; a token outside
all sections goes to none.  So the sections' counts and the rest add up to the document's tokens.

A byte-level vocabulary covers a text byte for byte, so the spans are running sums of the tokens' lengths.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import long_texts, map_arrow, word_codes

OUT = "doc_id long, section int, start long, end long, n_tokens long, n_crossing long"
_LENGTHS: dict[str, np.ndarray] = {}


def token_bytes(file: str) -> np.ndarray:
    """Bytes of each id of a byte-level vocabulary."""
    if file not in _LENGTHS:
        coder = word_codes(file, True)
        special = {i: t.content for i, t in coder.tokenizer.get_added_tokens_decoder().items()}
        names = {i: t for t, i in coder.tokenizer.get_vocab().items()}
        out = np.zeros(max(names) + 1, np.int64)
        for i, t in names.items():
            out[i] = len(special[i].encode()) if i in special else len(t)
        _LENGTHS[file] = out
    return _LENGTHS[file]


def attribute(ends: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token (-1 for none), and whether it crosses a border of a section.

    ends: the ends of tokens that follow each other from 0; start and stop: sections in order, not overlapping.
    """
    n, first = len(ends), np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    best, most = np.full(n, -1), np.zeros(n, np.int64)
    if not len(start) or not n:
        return best, np.zeros(n, bool)
    # sections that touch a token stand together: from the first that stops after its begin on
    low = np.searchsorted(stop, first, "right")
    high = np.searchsorted(start, ends, "left")
    touched = high - low
    for k in range(int(touched.max(initial=0))):  # as many rounds as sections touch one token
        at = np.flatnonzero(touched > k)
        s = low[at] + k
        share = np.minimum(stop[s], ends[at]) - np.maximum(start[s], first[at])
        better = share > most[at]
        best[at[better]], most[at[better]] = s[better], share[better]
    whole = most == ends - first
    return best, ~whole & (touched > 0)


def count_tokens(docs: DataFrame, tokenizer: str, sections: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, section int, start, end (code points), n_tokens, n_crossing: a row for each section.

    sections: a column array<struct<start,end>> of code-point ranges [start, end); null: the lines, each with the
    line feed after it.  Sections are taken in order of their start; of overlapping ones the later gives way, ranges
    are cut to the text, and null or empty ones hold no token.  Section -1 holds the tokens outside all sections
    and is there only if there are any.  A null or empty text has one row, section 0 with no tokens, unless its
    sections are given; repeated rows and null ids stay; other columns are dropped.
    """
    long_texts(docs.sparkSession)
    given = F.col(sections) if sections else F.lit(None)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), given.cast("array<struct<start:long,end:long>>").alias("sections"))
    own = sections is not None

    def each(batch: pa.RecordBatch):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        codes = word_codes(tokenizer, True).encode(texts)
        size = token_bytes(tokenizer)
        ids, number, begin, end, count, crossing = [], [], [], [], [], []
        spans = batch.column("sections").to_pylist() if own else [None] * len(texts)
        for doc, text, code, span in zip(batch.column("doc_id").to_pylist(), texts, codes, spans):
            ends = np.cumsum(size[np.frombuffer(code, "<u2")])
            raw = text.encode("utf-8", "surrogatepass")
            # the byte at which each code point starts, and the end
            at = np.append(np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80), len(raw)) if len(raw) != len(text) else None
            if own:
                pairs = sorted((max(0, x["start"]), x["end"], k) for k, x in enumerate(span or ()) if x and x["start"] is not None and x["end"] is not None)
                a, b, order, last = [], [], [], 0
                for s, e, k in pairs:
                    s, e = max(s, last), min(e, len(text))
                    if s < e:
                        a.append(s), b.append(e), order.append(k)
                        last = e
                a, b, k = np.array(a, np.int64), np.array(b, np.int64), np.array(order, np.int64)
                rows = [(x["start"], x["end"]) if x else (None, None) for x in span or ()]
                start, stop = (at[a], at[b]) if at is not None else (a, b)
            else:
                feeds = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
                stop = feeds if len(feeds) and feeds[-1] == len(raw) else np.append(feeds, len(raw))
                start = np.concatenate([[0], stop[:-1]])
                a, b = (np.searchsorted(at, start), np.searchsorted(at, stop)) if at is not None else (start, stop)
                k = np.arange(len(a))
                rows = list(zip(a.tolist(), b.tolist()))
            where, over = attribute(ends, start, stop)
            tokens, crossed = np.zeros(len(rows) + 1, np.int64), np.zeros(len(rows) + 1, np.int64)
            slot = np.append(k, len(rows))[where]  # -1 is the last
            tokens += np.bincount(slot, minlength=len(rows) + 1)
            crossed += np.bincount(slot[over], minlength=len(rows) + 1)
            if tokens[-1]:
                rows.append((None, None))
            m = len(rows)
            ids += [doc] * m
            number += [*range(m - 1), -1] if tokens[-1] else range(m)
            begin += [r[0] for r in rows]
            end += [r[1] for r in rows]
            count += tokens[:m].tolist()
            crossing += crossed[:m].tolist()
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (begin, end, count, crossing))], ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"]
        )

    return map_arrow(plain, each, OUT)
