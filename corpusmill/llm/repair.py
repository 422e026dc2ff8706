"""Repair of the structure of conversations at the least cost, by a weighted automaton that is made deterministic lazily.

A repaired conversation reads ``(s?(ua)+)?`` in the initials of its roles.  Four states say how far it has come: nothing
yet, after a system turn, after a user turn, after an assistant turn.  Each row can be kept, given another role or
deleted, and empty turns can be put in anywhere, at the costs of ``Costs``.

The scan goes from the last row to the first.  For each place it holds the vector of the least costs to get from
each state to a good end; less its minimum, such a vector is one state of a deterministic automaton.  Few of them exist,
since a state can be reached from any other by some edits.  Transitions between them (and what they add to the
cost) are computed when they are first met and kept in a table, so the scan is one lookup a row, done for all
conversations of a batch side by side.  The trace goes back over the scan, from the first row to the last, along arcs
whose cost is exactly the difference of the vectors (tight arcs); as it meets the edits in order, it takes the ASCII-least
of them where several are tight.  Its choices are kept in a table as well.

A conversation of more than ``most_rows`` rows or ``most_chars`` characters is not brought into one task: repeated rows are
counted, the others are dealt in order into blocks, each block gives the least costs from each state to each state (the
scan from four unit vectors), these are put together block by block, and each block is traced from all four states
at once until it is known in which it is entered.  Only the digest and the audit, which are one value, see
all rows of such a conversation in order, as a stream.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .neardup import groups, sizes_of
from .shared import BLANKS, Scratch, give_back, long_texts

#: States: nothing yet, after a system, a user, an assistant turn.  Roles: system, user, assistant, other.
KEEP = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}
#: The state after a turn that is put in or given another role, and that role.
TURN = (2, 2, 3, 2)
ROLE = ("user", "user", "assistant", "user")
MUST_GO = 8  # the symbol of a row that has to be deleted; others are 2 * role + truncated
FAR = 1 << 40
LINE = pa.struct([("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


class Automaton:
    """Vectors of least costs as states, with tables of transitions and of tight arcs that grow as they are needed."""

    def __init__(self, costs: Costs):
        self.costs = costs
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.next = np.zeros((0, 9), np.int32)
        self.added = np.zeros((0, 9), np.int64)
        self.piece = np.zeros((0, 9, 4), np.int32)
        self.then = np.zeros((0, 9, 4), np.int8)
        self.pieces: list[str] = []
        self.end = self.state(self.closed([0, FAR, FAR, 0]))[0]
        #: the turns put in after the last row, by state
        self.last = [self.chain(q) for q in range(4)]

    def chain(self, q: int) -> str:
        n = 0
        while q not in (0, 3):
            q, n = TURN[q], n + 1
        return "I" * n

    def closed(self, v: list[int]) -> list[int]:
        """v, with turns put in where that is cheaper."""
        for _ in range(3):
            v = [min(v[q], v[TURN[q]] + self.costs.insert) for q in range(4)]
        return v

    def state(self, v: list[int]) -> tuple[int, int]:
        """The number of v less its minimum, and that minimum."""
        least = min(v)
        key = tuple(x - least if x < FAR // 2 else FAR for x in v)
        if key not in self.number:
            self.number[key] = len(self.vectors)
            self.vectors.append(key)
            for name, empty in (("next", -1), ("added", 0), ("piece", -1), ("then", 0)):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.full((1, *old.shape[1:]), empty, old.dtype)]))
        return self.number[key], least

    def arcs(self, q: int, symbol: int) -> list[tuple[str, int, int]]:
        """(edit, cost, state after it) of the edits of a row, in ASCII order."""
        out = [("D", self.costs.delete, q)]
        if symbol != MUST_GO:
            role, cut = symbol // 2, symbol % 2 * self.costs.truncated
            if (q, role) in KEEP:
                out.append(("K", cut, KEEP[q, role]))
            out.append(("R", self.costs.rerole + cut, TURN[q]))
        return out

    def before(self, after: tuple[int, ...], symbol: int) -> list[int]:
        v = [min(cost + after[to] for _, cost, to in self.arcs(q, symbol)) for q in range(4)]
        return self.closed([min(x, FAR) for x in v])

    def step(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states before rows from those after them, and the costs added."""
        out = self.next[states, symbols]
        if (out < 0).any():
            for s, x in {*zip(states[out < 0].tolist(), symbols[out < 0].tolist())}:
                to, added = self.state(self.before(self.vectors[s], x))
                self.next[s, x], self.added[s, x] = to, added
            out = self.next[states, symbols]
        return out, self.added[states, symbols]

    def trace_one(self, s: int, symbol: int, q: int) -> tuple[str, int]:
        after, v, done = self.vectors[s], self.before(self.vectors[s], symbol), ""
        while True:
            for edit, cost, to in sorted([*self.arcs(q, symbol), ("I", self.costs.insert, TURN[q])]):
                if v[q] == cost + (v if edit == "I" else after)[to]:
                    break
            done, q = done + edit, to
            if edit != "I":
                return done, q

    def trace(self, after: np.ndarray, symbols: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pieces of the audit, and the states after the rows."""
        out = self.piece[after, symbols, q]
        if (out < 0).any():
            miss = out < 0
            for s, x, p in {*zip(after[miss].tolist(), symbols[miss].tolist(), q[miss].tolist())}:
                text, to = self.trace_one(s, x, p)
                if text not in self.pieces:
                    self.pieces.append(text)
                self.piece[s, x, p], self.then[s, x, p] = self.pieces.index(text), to
            out = self.piece[after, symbols, q]
        return out, self.then[after, symbols, q]

    def scan(self, symbols: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """after (the state behind each row), and the state before the first row of each run with the cost of all.

        Runs of rows follow each other; sizes: their lengths; ends: the states behind their last rows."""
        stop, order = np.cumsum(sizes), np.argsort(-sizes, kind="stable")
        after, state, total = np.zeros(len(symbols), np.int32), ends.astype(np.int32), np.zeros(len(sizes), np.int64)
        for j in range(int(sizes.max(initial=0))):
            order = order[: np.searchsorted(-sizes[order], -j)]
            rows = stop[order] - 1 - j
            after[rows] = state[order]
            state[order], added = self.step(state[order], symbols[rows])
            total[order] += added
        return after, state, total

    def follow(self, symbols: np.ndarray, sizes: np.ndarray, after: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The piece of each row and the state behind it, and the state behind each run; q: the states before the runs."""
        start, order = np.cumsum(sizes) - sizes, np.argsort(-sizes, kind="stable")
        pieces, then, q = np.zeros(len(symbols), np.int32), np.zeros(len(symbols), np.int8), q.astype(np.int8)
        for j in range(int(sizes.max(initial=0))):
            order = order[: np.searchsorted(-sizes[order], -j)]
            rows = start[order] + j
            pieces[rows], q[order] = self.trace(after[rows], symbols[rows], q[order])
            then[rows] = q[order]
        return pieces, then, q


_MADE: dict[Costs, Automaton] = {}


def automaton(costs: Costs) -> Automaton:
    """One of these in each Python worker, for all its tasks."""
    if costs not in _MADE:
        _MADE[costs] = Automaton(costs)
    return _MADE[costs]


def new_lines(piece: str, q: int, role: str | None, text: str | None) -> list[dict]:
    """The turns that a row becomes; q: the state before it."""
    out = []
    for edit in piece:
        if edit in "IR":
            out.append({"role": ROLE[q], "text": "" if edit == "I" else text, "edit": edit})
            q = TURN[q]
        elif edit == "K":
            out.append({"role": role, "text": text, "edit": edit})
    return out


def role_codes(roles: pa.Array) -> np.ndarray:
    first = pc.utf8_slice_codeunits(roles, 0, 1)
    return pc.fill_null(pc.index_in(first, pa.array(["s", "u", "a"], first.type)), 3).to_numpy(zero_copy_only=False).astype(np.int64)


def legal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1))


#: A null id is a conversation of its own.
KEY = ["coalesce(conv_id, 0) AS _c", "conv_id IS NULL AS _null"]
SUMMARY = "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
SHORT = f"{SUMMARY}, lines array<struct<role:string,text:string,edit:string>>"


def short(rows: DataFrame, costs: Costs) -> DataFrame:
    """SHORT of whole conversations, each of which a task can hold; rows: conv_id, turn, role, text, x."""

    def each(batches):
        machine = automaton(costs)
        for table in groups(batches, ["_c", "_null"], 4096):
            sizes = sizes_of(table, ["_c", "_null"])
            n, at = table.num_rows, np.repeat(np.arange(len(sizes)), sizes)
            role, text = (table.column(c).combine_chunks() for c in ("role", "text"))
            trimmed = pc.ascii_rtrim(text, characters=BLANKS)
            blank = pc.equal(pc.binary_length(trimmed), 0).to_numpy(zero_copy_only=False)
            last = pc.utf8_slice_codeunits(trimmed, -1)
            cut = ~pc.is_in(last, pa.array([".", "!", "?"], last.type)).to_numpy(zero_copy_only=False)
            codes = [c.dictionary_encode().indices.to_numpy() for c in (text, role)]
            order = np.lexsort((*codes, at))
            same = np.zeros(n, bool)
            same[1:] = np.logical_and.reduce([c[order][1:] == c[order][:-1] for c in (*codes, at)])
            twin = np.zeros(n, bool)
            twin[order] = same
            twin &= ~blank
            cut &= ~blank & ~twin
            roles = role_codes(role)
            symbols = np.where(blank | twin, MUST_GO, 2 * roles + cut)
            inner = at[1:] == at[:-1]
            illegal = np.bincount(at[1:][inner & ~legal(roles[:-1], roles[1:])], minlength=len(sizes))
            after, first, total = machine.scan(symbols, sizes, np.full(len(sizes), machine.end))
            cost = total + np.array([machine.vectors[s][0] for s in first.tolist()])
            pieces, then, left = machine.follow(symbols, sizes, after, np.zeros(len(sizes), np.int8))
            audit, lines = [], []
            said, of_role, of_text = [machine.pieces[p] for p in pieces.tolist()], role.to_pylist(), text.to_pylist()
            states, stop, left = then.tolist(), np.cumsum(sizes).tolist(), left.tolist()
            for k, b in enumerate(stop):
                a, q = b - int(sizes[k]), 0
                put = []
                for i in range(a, b):
                    put += new_lines(said[i], q, of_role[i], of_text[i])
                    q = states[i]
                end = machine.last[left[k]]
                lines.append(put + new_lines(end, q, None, None))
                audit.append("".join(said[a:b]) + end)
            head = table.column("conv_id").combine_chunks().take(pa.array(np.cumsum(sizes) - sizes))
            counted = [pa.array(np.bincount(at[x], minlength=len(sizes))) for x in (blank, twin, cut)]
            yield pa.RecordBatch.from_arrays(
                [head, *counted, pa.array(illegal), pa.array(cost), pa.array(audit, pa.string()), pa.array(lines, pa.list_(LINE))],
                ["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "lines"],
            )
        give_back()

    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "x", "role", "text")
    return dealt.selectExpr("conv_id", *KEY, "role", "text").mapInArrow(each, SHORT)


def long_blocks(rows: DataFrame, costs: Costs, block: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(SUMMARY and repaired_sha256 of each conversation, its lines) for conversations that no task should hold.

    rows: conv_id, turn, role, text, x.  Lines: conv_id, block, place, role, text, edit."""
    trimmed = F.rtrim(F.col("text"), F.lit(BLANKS))
    # rows that are all alike are one with a count
    distinct = scratch.keep(rows.groupBy("conv_id", "turn", "x", "role", "text").agg(F.count("*").alias("n")), "distinct")
    firsts = distinct.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("text").alias("t")).agg(F.min(F.struct(F.col("turn").isNotNull().alias("a"), "turn")).alias("first"))
    firsts = scratch.keep(firsts, "firsts")
    told = distinct.join(firsts.hint("merge"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("text") == F.col("t")))
    initial = F.left("role", F.lit(1))
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    blank = trimmed == ""
    twin = ~blank & ~F.col("first.turn").eqNullSafe(F.col("turn"))
    cut = ~blank & ~twin & ~F.right(trimmed, F.lit(1)).isin(".", "!", "?")
    symbol = F.when(blank | twin, MUST_GO).otherwise(2 * role + cut.cast("int"))
    faults = [F.when(blank, F.col("n")).otherwise(0).alias("blank"), F.when(twin, F.col("n")).when(~blank, F.col("n") - 1).otherwise(0).alias("duplicate"), cut.cast("long").alias("truncated")]
    marked = scratch.keep(told.select("conv_id", "turn", "x", "role", "text", "n", role.alias("code"), symbol.alias("symbol"), *faults), "marked")
    order = ["conv_id", "turn", "x"]
    ranged = marked.repartitionByRange(max(1, -(-marked.count() // block)), *order).sortWithinPartitions(*order, "role", "text")
    placed = scratch.keep(ranged.withColumns({"block": F.spark_partition_id(), "place": F.monotonically_increasing_id()}), "placed")
    bare = placed.selectExpr("conv_id", *KEY, "block", "place", "symbol", "code", "n")
    many = "conv_id long, block int, first int, last int, illegal long, m array<long>"

    def matrix(pdf: pd.DataFrame) -> pd.DataFrame:
        machine, pdf = automaton(costs), pdf.sort_values("place")
        symbols, code, extra = pdf["symbol"].to_numpy(), pdf["code"].to_numpy(), int((pdf["n"] - 1).sum())
        m = np.full((4, 4), FAR, np.int64)
        for p in range(4):
            end = machine.state([0 if q == p else FAR for q in range(4)])[0]
            _, first, total = machine.scan(symbols, np.array([len(symbols)]), np.array([end]))
            m[:, p] = [min(x + total[0], FAR) if x < FAR else FAR for x in machine.vectors[first[0]]]
        m = np.where(m < FAR, m + extra * costs.delete, FAR)
        illegal = int((~legal(code[:-1], code[1:])).sum()) + extra
        return pd.DataFrame({"conv_id": pdf["conv_id"].iloc[:1].astype("Int64"), "block": pdf["block"].iloc[:1], "first": code[:1], "last": code[-1:], "illegal": [illegal], "m": [m.ravel().tolist()]})

    blocks = scratch.keep(bare.groupBy("_c", "_null", "block").applyInPandas(matrix, many), "blocks")

    def join_up(pdf: pd.DataFrame) -> pd.DataFrame:
        machine, pdf = automaton(costs), pdf.sort_values("block")
        v, ends = np.array(machine.vectors[machine.end]), []
        for m in pdf["m"].to_numpy()[::-1]:
            ends.append((v - v.min()).tolist())
            v = np.minimum((np.array(m).reshape(4, 4) + v[None, :]).min(axis=1), FAR)
        first, last = pdf["first"].to_numpy(), pdf["last"].to_numpy()
        illegal = int(pdf["illegal"].sum() + (~legal(last[:-1], first[1:])).sum())
        return pd.DataFrame({"conv_id": pdf["conv_id"].astype("Int64"), "block": pdf["block"], "ends": ends[::-1], "cost": int(v[0]), "illegal": illegal})

    keyed = blocks.selectExpr("*", *KEY)
    joined = scratch.keep(keyed.groupBy("_c", "_null").applyInPandas(join_up, "conv_id long, block int, ends array<long>, cost long, illegal long"), "joined")

    def trace(rows: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        machine, rows = automaton(costs), rows.sort_values("place")
        symbols, one = rows["symbol"].to_numpy(), np.array([len(rows)])
        end = machine.state([int(x) for x in at["ends"].iloc[0]])[0]
        after, _, _ = machine.scan(symbols, one, np.array([end]))
        ways = [machine.follow(symbols, one, after, np.array([q])) for q in range(4)]
        said = [[machine.pieces[p] for p in w[0].tolist()] for w in ways]
        return pd.DataFrame({"conv_id": rows["conv_id"].astype("Int64"), "block": rows["block"], "place": rows["place"], "pieces": [list(x) for x in zip(*said)], "then": [list(x) for x in zip(*(w[1].tolist() for w in ways))]})

    ends = joined.selectExpr("*", *KEY)
    ways = bare.groupBy("_c", "_null", "block").cogroup(ends.groupBy("_c", "_null", "block")).applyInPandas(trace, "conv_id long, block int, place long, pieces array<string>, then array<int>")
    ways = scratch.keep(ways, "ways")
    exits = ways.selectExpr("*", *KEY).groupBy("_c", "_null", "conv_id", "block").agg(F.max_by("then", "place").alias("then"))

    def enter(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, q, into = pdf.sort_values("block"), 0, []
        for then in pdf["then"]:
            into.append(q)
            q = int(then[q])
        return pd.DataFrame({"conv_id": pdf["conv_id"].astype("Int64"), "block": pdf["block"], "entry": into, "final": [-1] * (len(pdf) - 1) + [q]})

    entries = scratch.keep(exits.groupBy("_c", "_null").applyInPandas(enter, "conv_id long, block int, entry int, final int"), "entries")
    on = lambda a, b: F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id")) & (F.col(f"{a}.block") == F.col(f"{b}.block"))
    chosen = ways.alias("w").join(entries.alias("e"), on("w", "e")).select("w.*", "entry", "final")
    edits = placed.alias("p").join(chosen.alias("c"), on("p", "c") & (F.col("p.place") == F.col("c.place"))).select("p.*", F.get("pieces", "entry").alias("piece"), "entry", F.get("then", "entry").alias("then"), "final")
    edits = scratch.keep(edits, "edits")

    def stream(batches):
        """The turns in order; behind the last row of a conversation its summary as one more."""
        machine, now, q, digest, said, sums = automaton(costs), None, 0, None, [], [0, 0, 0]
        out: list[dict] = []

        def close():
            end = machine.last[q]
            tail = new_lines(end, q, None, None)
            for x in tail:
                add(x)
            return {"conv_id": now[0], "blank": sums[0], "duplicate": sums[1], "truncated": sums[2], "audit": "".join(said) + end, "repaired_sha256": digest[0].hexdigest(), "lines": tail}

        def add(x):
            if digest[1]:
                digest[0].update(b"\n")
            digest[0].update(f"{x['role']}:{x['text']}".encode())
            digest[1] = True

        for batch in batches:
            for r in batch.to_pylist():
                if now is None or now[0] != r["conv_id"]:
                    if now is not None:
                        out.append(close())
                    now, q, digest, said, sums = (r["conv_id"],), 0, [hashlib.sha256(), False], [], [0, 0, 0]
                put = new_lines(r["piece"], q, r["role"], r["text"])
                for x in put:
                    add(x)
                said.append(r["piece"] + "D" * (r["n"] - 1))
                sums = [a + r[c] for a, c in zip(sums, ("blank", "duplicate", "truncated"))]
                q = r["then"]
                if put:
                    out.append({"conv_id": r["conv_id"], "block": r["block"], "place": r["place"], "lines": put})
                if len(out) > 2000:
                    yield pa.RecordBatch.from_pylist(out, STREAMED)
                    out = []
        if now is not None:
            out.append(close())
            yield pa.RecordBatch.from_pylist(out, STREAMED)

    dealt = edits.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "block", "place", "role", "text", "n", "piece", "then", "blank", "duplicate", "truncated")
    done = scratch.keep(dealt.mapInArrow(stream, "conv_id long, block int, place long, blank long, duplicate long, truncated long, audit string, repaired_sha256 string, lines array<struct<role:string,text:string,edit:string>>"), "streamed")
    costs_of = joined.select(F.col("conv_id").alias("c"), "cost", "illegal").distinct()
    summary = done.where("audit IS NOT NULL").join(costs_of, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    lines = done.select("conv_id", F.coalesce("block", F.lit((1 << 31) - 1)).alias("block"), F.coalesce("place", F.lit((1 << 63) - 1)).alias("place"), F.posexplode("lines").alias("nth", "line")).select("conv_id", "block", "place", "nth", "line.*")
    return summary, lines


STREAMED = pa.schema(
    [("conv_id", pa.int64()), ("block", pa.int32()), ("place", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string()), ("lines", pa.list_(LINE))]
)


@dataclass(frozen=True)
class Repaired:
    """conversations: conv_id, the counts, cost, audit, repaired_sha256; lines: conv_id, block, place, nth, role, text, edit
    (K, R or I), in the order of the three."""

    conversations: DataFrame
    lines: DataFrame


def repair(turns: DataFrame, costs: Costs = Costs(), id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", most_rows: int = 50_000, most_chars: int = 32_000_000, block: int = 50_000) -> Repaired:
    """The cheapest repair of each conversation that has rows.

    Rows are ordered by turn, null first; rows of one turn by a hash, so that equal rows follow each other.  A null role or
    text counts as one space; rows with a null id are one conversation.  The first fault of a row counts: blank, duplicate
    (its role and text were seen earlier), truncated.  gaps: turn numbers missing between the least and the largest.
    The audit has an initial for each edit (Keep, Rerole, Delete, Insert); of equally cheap ones the ASCII-least.  Very
    long texts and conversations are handled whole; other columns are dropped; an empty table gives empty ones.
    """
    spark = turns.sparkSession
    long_texts(spark)
    scratch = Scratch(spark)
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), filled(role_col).alias("role"), filled(text_col).alias("text"))
    rows = rows.withColumn("x", F.xxhash64("role", "text"))
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("chars"), F.min("turn").alias("low"), F.max("turn").alias("high"))
    turns_seen = rows.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).where("turn IS NOT NULL").groupBy(F.col("conv_id").alias("c")).agg(F.count("*").alias("seen"))
    sizes = scratch.keep(sizes, "sizes")
    gaps = sizes.join(turns_seen, F.col("conv_id").eqNullSafe(F.col("c")), "left").select(F.col("conv_id").alias("g"), F.coalesce(F.col("high") - F.col("low") + 1 - F.col("seen"), F.lit(0)).alias("gaps"))
    big = sizes.where((F.col("n") > most_rows) | (F.col("chars") > most_chars)).select(F.col("conv_id").alias("big"))
    n_big = big.count()
    said = F.array_join(F.transform("lines", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    if n_big:
        # few, since each has that many rows; counted before they are broadcast
        big = F.broadcast(big) if n_big <= 100_000 else big
        is_big = F.col("conv_id").eqNullSafe(F.col("big"))
        few = short(rows.join(big, is_big, "left_anti"), costs)
    else:
        few = short(rows, costs)
    few = scratch.keep(few, "short")
    out = few.select("conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(said, 256).alias("repaired_sha256"))
    lines = few.select("conv_id", F.lit(0).alias("block"), F.lit(0).cast("long").alias("place"), F.posexplode("lines").alias("nth", "line")).select("conv_id", "block", "place", "nth", "line.*")
    if n_big:
        summary, more = long_blocks(rows.join(big, is_big, "left_semi"), costs, block, scratch)
        out, lines = out.unionByName(summary), lines.unionByName(more)
    out = out.join(gaps, F.col("conv_id").eqNullSafe(F.col("g"))).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return Repaired(out, lines)


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, damaged by crc32 of ``conv_id:turn`` (a null is one space) modulo 20: 0 drops the row, 1 empties
    the text, 2 removes its ends of sentences, 3 repeats it, 4 makes it a user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind: Column = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    rows = turns.select("conv_id", "turn", "role", "text", kind.alias("kind")).where("kind <> 0")
    role = F.when(F.col("kind") == 4, "user").otherwise(space("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


def repair_damaged(turns: DataFrame) -> DataFrame:
    """What repair finds in the damaged turns, with a row for each conversation of turns."""
    done = repair(damaged(turns)).conversations.withColumnRenamed("conv_id", "_c")
    ids = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    both = ids.join(done, F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return both.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


#: DuckDB SQL for repair_damaged; for small tables.  crc32 bit by bit; the least (cost, audit) from each state, row by row from the end.
SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')) AS k FROM conversations
), hashed AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ascii(substr(CAST(k AS VARCHAR), i, 1)) AS BIGINT) FOR i IN range(1, octet_length(k) + 1)]),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [CAST(0 AS BIGINT) FOR i IN range(8)]), lambda x, z: xor(x >> 1, CAST(3988292384 AS BIGINT) * (x & 1)))), CAST(4294967295 AS BIGINT)) % 20 AS kind FROM keyed
), rows AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed WHERE kind <> 0
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, left(role, 1) AS c FROM rows
), faults AS (
  SELECT *, bare = '' AS blank, bare <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS twin, i > 1 AND lag(c) OVER w || c NOT IN ('su', 'ua', 'au') AS bad
  FROM ordered WINDOW w AS (PARTITION BY conv_id ORDER BY i)
), symbols AS (
  SELECT *, NOT blank AND NOT twin AND right(bare, 1) NOT IN ('.', '!', '?') AS cut, blank OR twin AS gone FROM faults
), back AS (
  SELECT DISTINCT conv_id, n AS i, (0, '', '') AS a, (10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:') AS b, (5, 'I', chr(10) || 'assistant:') AS u, (0, '', '') AS z FROM symbols
  UNION ALL
  SELECT conv_id, i - 1, least(a1, (u2[1] + 5, 'I' || u2[2], chr(10) || 'user:' || u2[3])), least(b1, (u2[1] + 5, 'I' || u2[2], chr(10) || 'user:' || u2[3])),
    least(u1, (z2[1] + 5, 'I' || z2[2], chr(10) || 'assistant:' || z2[3])), least(z1, (u2[1] + 5, 'I' || u2[2], chr(10) || 'user:' || u2[3]))
  FROM (
    SELECT *, least(u1, (z1[1] + 5, 'I' || z1[2], chr(10) || 'assistant:' || z1[3])) AS u2, least(z1, (u1[1] + 5, 'I' || u1[2], chr(10) || 'user:' || u1[3])) AS z2
    FROM (
      SELECT conv_id, i,
        least((a[1] + 2, 'D' || a[2], a[3]), CASE WHEN NOT gone AND c = 's' THEN (b[1] + t, 'K' || b[2], own || b[3]) WHEN NOT gone AND c = 'u' THEN (u[1] + t, 'K' || u[2], own || u[3]) ELSE far END, CASE WHEN NOT gone THEN (u[1] + t + 1, 'R' || u[2], as_u || u[3]) ELSE far END) AS a1,
        least((b[1] + 2, 'D' || b[2], b[3]), CASE WHEN NOT gone AND c = 'u' THEN (u[1] + t, 'K' || u[2], own || u[3]) ELSE far END, CASE WHEN NOT gone THEN (u[1] + t + 1, 'R' || u[2], as_u || u[3]) ELSE far END) AS b1,
        least((u[1] + 2, 'D' || u[2], u[3]), CASE WHEN NOT gone AND c = 'a' THEN (z[1] + t, 'K' || z[2], own || z[3]) ELSE far END, CASE WHEN NOT gone THEN (z[1] + t + 1, 'R' || z[2], as_a || z[3]) ELSE far END) AS u1,
        least((z[1] + 2, 'D' || z[2], z[3]), CASE WHEN NOT gone AND c = 'u' THEN (u[1] + t, 'K' || u[2], own || u[3]) ELSE far END, CASE WHEN NOT gone THEN (u[1] + t + 1, 'R' || u[2], as_u || u[3]) ELSE far END) AS z1
      FROM (
        SELECT back.*, s.c, s.gone, CASE WHEN s.cut THEN 5 ELSE 0 END AS t, (1000000000, '', '') AS far, chr(10) || s.role || ':' || s.text AS own, chr(10) || 'user:' || s.text AS as_u, chr(10) || 'assistant:' || s.text AS as_a
        FROM back JOIN symbols s ON s.conv_id IS NOT DISTINCT FROM back.conv_id AND s.i = back.i
      )
    )
  )
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE twin) AS duplicate, count(*) FILTER (WHERE cut) AS truncated, count(*) FILTER (WHERE bad) AS illegal
  FROM symbols GROUP BY conv_id
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(back.a[1], 0) AS BIGINT) AS cost, coalesce(back.a[2], '') AS audit, sha256(coalesce(substr(back.a[3], 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted ON counted.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN back ON back.conv_id IS NOT DISTINCT FROM o.conv_id AND back.i = 0"""
