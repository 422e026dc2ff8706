"""Best-fit packing of documents into training sequences of bounded size.

A piece asks for three things at once: tokens, one place among the documents of its sequence, and attention
cost (its length squared).  Pieces of one length ask for the same, so the plan is made on the histogram of
lengths (at most ``tokens`` rows, whatever the corpus holds): lengths in falling order, each into the open
sequences whose weighted residual is the best fit under every constraint.  Runs of sequences that look alike
are handled at once, so the plan has a bounded number of runs too.  Pieces then take their place by their
number within their length, which salted windows count.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .shared import Scratch, long_texts, map_arrow, texts_of, word_codes

PIECES = "doc_id long, piece int, start long, length long, ids binary"


@dataclass(frozen=True)
class Limits:
    """What a sequence may hold; weights and rule of the choice among sequences that have room.

    rule "norm" takes the least weighted norm of what would be left, "dot" the least weighted dot product of
    the piece and what is left.  The defaults for documents and attention bind no sooner than the tokens do.
    """

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 1e-6, 1e-6)
    rule: str = "norm"


def cut_documents(docs: DataFrame, tokenizer: str, tokens: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each text, append ``end``, and cut it into pieces of ``tokens``; only the first may be shorter.

    ids: little-endian unsigned 32-bit ids.  A null text counts as empty and gives the one id ``end``; a null
    id stays null; repeated rows give repeated pieces; other columns are dropped.
    """
    long_texts(docs.sparkSession)

    def cut(batch: pa.RecordBatch):
        ids, first, starts, lengths, data = [], [], [], [], []
        stop = np.array([end], "<u4").tobytes()
        for doc, codes in zip(batch.column(0).to_pylist(), word_codes(tokenizer, True).encode(texts_of(batch, "text"))):
            whole = np.frombuffer(codes, "<u2").astype("<u4").tobytes() + stop
            n = len(whole) // 4
            bounds = [0, *range(n % tokens or tokens, n + 1, tokens)]
            for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                ids.append(doc), first.append(k), starts.append(a), lengths.append(b - a), data.append(whole[4 * a : 4 * b])
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(first, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(data, pa.binary())],
            ["doc_id", "piece", "start", "length", "ids"],
        )

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), cut, PIECES)


def plan(counts: dict[int, int], limits: Limits = Limits()) -> np.ndarray:
    """Runs (length, first item, items, first sequence, offset): the items of a run go to one sequence each."""
    room = np.array([limits.tokens, limits.documents, limits.attention], float)
    weights = np.array(limits.weights)
    states: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
    runs: list[tuple[int, int, int, int, int]] = []
    fresh = 0

    def fill(state, bins, item, length, left):
        """Put as many items as fit into each of these sequences, while there are items."""
        rt, rd, rc = state
        fit = min(rt // length, rd, rc // (length * length))
        taken = []
        for at, (first, n) in enumerate(bins):
            while n and left:
                k = min(fit, left)
                m = min(n, left // k)
                for j in range(k):
                    runs.append((length, item + j * m, m, first, limits.tokens - rt + j * length))
                item, left = item + k * m, left - k * m
                after = (rt - k * length, rd - k, rc - k * length * length)
                taken.append((after, (first, m)))
                first, n = first + m, n - m
            if n:
                return item, left, taken, [(first, n), *bins[at + 1 :]]
        return item, left, taken, []

    for length in sorted(counts, reverse=True):
        if length > limits.tokens or length * length > limits.attention or limits.documents < 1:
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        item, left = 0, counts[length]
        need = np.array([length, 1, length * length], float)
        keys = list(states)
        table = np.array(keys, float).reshape(-1, 3)
        able = np.flatnonzero((table >= need).all(axis=1)) if len(keys) else np.array([], int)
        if len(able):
            rest = (table[able] - need) / room
            score = (weights * rest * rest).sum(axis=1) if limits.rule == "norm" else (weights * (need / room) * (table[able] / room)).sum(axis=1)
            able = able[np.lexsort((able, score))]
        for i in able:
            if not left:
                break
            state = keys[i]
            item, left, taken, kept = fill(state, states.pop(state), item, length, left)
            if kept:
                states.setdefault(state, []).extend(kept)
            for after, run in taken:
                states.setdefault(after, []).append(run)
        if left:
            state = tuple(int(x) for x in room)
            fit = min(state[0] // length, state[1], state[2] // (length * length))
            n = -(-left // fit)
            _, _, taken, _ = fill(state, [(fresh, n)], item, length, left)
            fresh += n
            for after, run in taken:
                states.setdefault(after, []).append(run)
    return np.array(runs, np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, limits: Limits = Limits(), length_col: str = "length", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """pieces with sequence_id and offset (long): each piece whole in one sequence, from 0 without gaps.

    Pieces of length 0 or null get null for both.  Clashing columns ``sequence_id`` and ``offset`` of the
    input are replaced.  An empty table gives an empty table.
    """
    scratch = Scratch(pieces.sparkSession)
    rows = scratch.keep(pieces.drop("sequence_id", "offset").withColumn("_n", F.greatest(F.coalesce(F.col(length_col).cast("long"), F.lit(0)), F.lit(0))), "pieces")
    counts = {r["_n"]: r["k"] for r in rows.where("_n > 0").groupBy("_n").agg(F.count("*").alias("k")).collect()}
    runs = plan(counts, limits)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    salts = [(int(n), int(-(-k // max(2_000, -(-k // 10_000))))) for n, k in counts.items()]
    lengths = rows.sparkSession.createDataFrame(salts, "_n long, _salts int")
    # The number of a piece within its length: a salted count, so that a length that a third of all pieces has
    # is counted by many tasks, 2000 pieces and more by each and by at most 10,000.  lengths has a row for each length.
    salted = rows.join(F.broadcast(lengths), "_n", "left").withColumn("_salt", F.pmod(F.xxhash64(*order), F.coalesce("_salts", F.lit(1))))
    before = Window.partitionBy("_n").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("_n", "_salt").agg(F.count("*").alias("_k")).withColumn("_base", F.coalesce(F.sum("_k").over(before), F.lit(0))).drop("_k")
    numbered = salted.withColumn("_item", F.row_number().over(Window.partitionBy("_n", "_salt").orderBy(*order))).join(base, ["_n", "_salt"])
    names = [c for c in rows.columns if c != "_n"]
    numbered = numbered.select(*names, "_n", (F.col("_base") + F.col("_item") - 1).alias("_item"))
    schema = StructType([*pieces.drop("sequence_id", "offset").schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def place(batch: pa.RecordBatch):
        n, item = (batch.column(c).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_n", "_item"))
        seq, offset, ok = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), n > 0
        if len(runs):
            span = int(runs[:, 1].max()) + 1 if len(runs) else 1
            span = max(span, int(item.max()) + 1)
            at = np.searchsorted(runs[:, 0] * span + runs[:, 1], n * span + item, "right") - 1
            at = np.where(ok, at, 0)
            seq, offset = runs[at, 3] + item - runs[at, 1], runs[at, 4]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(seq, mask=~ok), pa.array(offset, mask=~ok)], [*names, "sequence_id", "offset"])

    return map_arrow(numbered, place, schema)


def assemble(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the packed pieces of each sequence joined (bounded by the tokens of a sequence)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.where("sequence_id IS NOT NULL").groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), end: int = 0) -> DataFrame:
    """Cut and pack; the pieces keep their ids."""
    return pack(cut_documents(docs, tokenizer, limits.tokens, end), limits)
