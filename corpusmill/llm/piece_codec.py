"""Encoding and decoding with a merge-type (BPE) piece vocabulary.

Every prefix of a word has one last token.  An automaton reports the pieces that end at a place; the one that may
follow the last token of the prefix before it is the last token here.  A pair may stand side by side if merging
the characters of both never joins across their border, which is remembered for each pair.  The ids are
then read from the table backwards, in time proportional to the text.

A word is what stands after blanks: no piece holds a blank after another character, so words are encoded apart,
and each worker keeps the ids of the first ``LIMIT`` different words of at most ``LONGEST`` characters.  Pieces of blanks alone are merged
after all others, so of a run of blanks the last one goes with the word if it can, and the rest have a table of their
own, of as many rows as the longest such piece is long: longer runs start with that piece.  The constructor checks
all this of the vocabulary and refuses others.
Characters without a piece become their UTF-8 bytes; a text's own "▁" is a blank, as for the library.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .shared import long_texts, map_arrow, texts_of

BLANK = "▁"
LIMIT = 400_000
LONGEST = 64
PAIRS = 600_000


class Pieces:
    """The vocabulary of a sentencepiece model of the BPE type with byte fallback and a blank put in front."""

    def __init__(self, file: str):
        import ahocorasick
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=file)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {names[i]: i for i in plain}
        self.rank = {names[i]: -sp.get_score(i) for i in plain}
        self.length = [len(x) for x in names]
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if n > 65536 or any(BLANK in x[1:].lstrip(BLANK) for x in self.ids):
            raise ValueError("not a vocabulary whose words can be encoded apart")
        self.names = names
        self.text = [b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else x.replace(BLANK, " ").encode() for i, x in enumerate(names)]
        for b, i in enumerate(self.bytes):
            self.text[i] = bytes([b])
        self.automaton = ahocorasick.Automaton()
        for x, i in self.ids.items():
            if len(x) == 1 or self.merged(x) == [x]:  # others are never made
                self.automaton.add_word(x, (i, len(x)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.run_table()

    def run_table(self) -> None:
        """runs: the ids of 0, 1, 2, ... blanks, up to the longest piece of blanks."""
        blanks = [x for x in self.ids if x == BLANK * len(x)]
        self.longest = longest = max(map(len, blanks))
        self.alone = np.array([self.ids[BLANK]], "<u2").tobytes()
        self.runs = [np.array([self.ids[x] for x in self.merged(BLANK * n)], "<u2").tobytes() if n else b"" for n in range(longest + 1)]
        last = {r for x, r in self.rank.items() if len(x) > 1 and x in blanks}
        ok = len(last) <= 1 and all(r < min(last, default=np.inf) for x, r in self.rank.items() if x not in blanks) and not any(x.startswith(BLANK * 2) and x not in blanks for x in self.ids)
        if not ok or any(self.merged(BLANK * n) != [BLANK * longest] * (n // longest) + (self.merged(BLANK * (n % longest)) if n % longest else []) for n in range(1, 6 * longest + 2)):
            raise ValueError("not a vocabulary whose runs of blanks have a table")

    def blanks(self, n: int) -> bytes:
        return self.runs[self.longest] * (n // self.longest) + self.runs[n % self.longest]

    def merged(self, text: str, border: int = -1) -> list[str] | None:
        """What merging the best-scored neighbours, the left first, makes of the characters.

        None as soon as two are joined across the border."""
        part: list[str | None] = list(text)
        n, rank = len(text), self.rank
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, k, x) for k in range(n - 1) if (r := rank.get(x := text[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, both = heapq.heappop(heap)
            a = part[k]
            if a is None or (m := right[k]) >= n or len(both) != len(a) + len(part[m]):
                continue
            if m == border:
                return None
            part[k], part[m] = both, None
            right[k] = end = right[m]
            if end < n:
                left[end] = k
                if (r := rank.get(x := both + part[end])) is not None:
                    heapq.heappush(heap, (r, k, x))
            if k and (r := rank.get(x := part[left[k]] + both)) is not None:
                heapq.heappush(heap, (r, left[k], x))
        return [x for x in part if x is not None]

    def allowed(self, a: int, b: int) -> bool:
        """May b follow a?"""
        first = self.names[a]
        return self.merged(first + self.names[b], len(first)) is not None

    def table(self, word: str) -> list[int]:
        """The last token of each prefix, -1 after a character that has no piece."""
        last = [-1] * (len(word) + 1)
        pairs = self.pairs
        for end, (token, size) in self.automaton.iter(word):
            if last[end + 1] >= 0:
                continue
            before = last[end + 1 - size]
            if before >= 0 and size <= end:
                key = before << 16 | token
                ok = pairs.get(key)
                if ok is None:
                    if len(pairs) >= PAIRS:
                        pairs.clear()
                    ok = pairs[key] = self.allowed(before, token)
                if not ok:
                    continue
            last[end + 1] = token
        return last

    def word(self, word: str) -> list[int]:
        last, at, out = self.table(word), len(word), []
        while at:
            token = last[at]
            if token < 0:
                out.extend(self.bytes[b] for b in reversed(word[at - 1].encode("utf-8", "surrogatepass")))
                at -= 1
            else:
                out.append(token)
                at -= self.length[token]
        return out[::-1]

    def codes(self, key: str) -> bytes:
        """Ids of a word after a blank, or of one after a line feed."""
        ids = [self.bytes[10], *self.word(key[1:])] if key[0] == "\n" else self.word(BLANK + key)
        return np.array(ids, "<u2").tobytes()

    def spaced(self, keys: list[str]) -> bytes:
        """Ids of a text in which blanks stand together, at an end or before a line feed; keys: its parts between blanks."""
        out, run = [], 1  # the library puts a blank in front
        for k in keys:
            if not k:
                run += 1
                continue
            code = self.known[k]
            if k[0] == "\n":  # the blank before it was put there
                out.append(self.blanks(run - 1))
            elif code[:2] == self.alone:  # the word's blank is a piece by itself, so it is one of the run
                out.append(self.blanks(run))
                code = code[2:]
            else:
                out.append(self.blanks(run - 1))
            out.append(code)
            run = 1
        out.append(self.blanks(run - 1))
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian 16-bit numbers."""
        keys = [t.replace(BLANK, " ").replace("\n", " \n").split(" ") for t in texts]
        known, fresh = self.known, []
        for k in set().union(*keys).difference(known):
            if k:
                known[k] = self.codes(k)
                fresh.append(k)
        out = []
        for t, ks in zip(texts, keys):
            if not t:
                out.append(b"")
            elif "" in ks or ks[0][0] == "\n":
                out.append(self.spaced(ks))
            else:
                out.append(b"".join(map(known.__getitem__, ks)))
        # what is kept is bounded in bytes too: a text without blanks is one key
        long = [k for k in fresh if len(k) > LONGEST]
        for k in long:
            del known[k]
        for k in [k for k in fresh if len(k) <= LONGEST][: max(0, len(known) - LIMIT)]:
            del known[k]
        return out

    def decode(self, ids: list[int]) -> str:
        """What the library's decode gives: pieces joined, blanks put back, the blank in front dropped."""
        if not ids:
            return ""
        try:
            out = b"".join(map(self.text.__getitem__, ids)).decode()
        except UnicodeDecodeError:  # bytes that make no character
            return self.library.decode(ids)
        first = self.names[ids[0]]
        if self.library.is_control(ids[0]):
            return self.library.decode(ids)
        return out[1:] if first.startswith(BLANK) else out


_PIECES: dict[str, Pieces] = {}


def pieces(file: str) -> Pieces:
    """One of these in each Python worker."""
    if file not in _PIECES:
        _PIECES[file] = Pieces(file)
    return _PIECES[file]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>: a null or empty text gives an empty array; repeated rows and null ids stay."""
    long_texts(docs.sparkSession)

    def each(batch: pa.RecordBatch):
        raw = pieces(model).encode(texts_of(batch, "text"))
        ids = np.frombuffer(b"".join(raw), "<u2").astype(np.int32)
        ends = np.concatenate([[0], np.cumsum([len(x) // 2 for x in raw])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], ["doc_id", "ids"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), each, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """encoded with one more column, the text of each row's ids; null ids give null."""

    def each(batch: pa.RecordBatch):
        found = pieces(model)
        texts = [None if x is None else found.decode(x) for x in batch.column(ids_col).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out_col])

    rows = encoded.drop(out_col)
    return map_arrow(rows, each, StructType([*rows.schema.fields, StructField(out_col, StringType())]))


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, decoded in one pass, without handing the ids to Spark and back between the two.

    A null or empty text gives no ids and an empty text; repeated rows and null ids stay; other columns are dropped; an
    empty table gives an empty table.
    """
    long_texts(docs.sparkSession)

    def each(batch: pa.RecordBatch):
        found = pieces(model)
        raw = found.encode(texts_of(batch, "text"))
        ids = np.frombuffer(b"".join(raw), "<u2").astype(np.int32)
        ends = np.concatenate([[0], np.cumsum([len(x) // 2 for x in raw])]).astype(np.int32)
        texts = [found.decode(np.frombuffer(x, "<u2").tolist()) for x in raw]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(plain, each, "doc_id long, ids array<int>, decoded string")
