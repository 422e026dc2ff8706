"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that end a word: the ASCII blanks.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset a local session (tests) gets a temporary folder of its own; a cluster gets an error,
    because a machine-local folder would not be seen by the other machines.
    """
    conf = spark.sparkContext.getConf()
    where = conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if where:
        return where
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    where = tempfile.mkdtemp(prefix="corpusmill-")
    spark.sparkContext.setCheckpointDir(where)
    return spark.sparkContext.getCheckpointDir()


class Scratch:
    """Tables written to the shared folder, which cut lineage and survive the loss of an executor."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
        self.kept: list[str] = []

    def path(self, name: str) -> str:
        return f"{self.base}/{name}-{uuid.uuid4().hex[:8]}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back."""
        where = self.path(name)
        df.write.parquet(where)
        self.kept.append(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self, df: DataFrame) -> None:
        """Delete a table that keep() returned and nothing reads any more."""
        for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
            delete(self.spark, file)


    def sweep(self, *needed: DataFrame) -> None:
        """Delete all tables that keep() returned but those that these frames read."""
        read = {f.rpartition("/")[0].rpartition("/")[2] for df in needed for f in df.inputFiles()}
        for where in self.kept:
            if where.rpartition("/")[2] not in read:
                delete(self.spark, where)


def delete(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def long_texts(spark: SparkSession) -> None:
    """Smaller Arrow batches, since one text can be very long: 2000 rows and 16 MB, in place of Spark's own bounds.

    A session that sets these bounds itself keeps them.
    """
    for key, own, small in (("maxRecordsPerBatch", "10000", "2000"), ("maxBytesPerBatch", "67108864b", "16m")):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}") == own:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", small)


def give_back() -> None:
    """Give freed memory back at the end of a task: idle Python workers stay, and count, beside the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow for a function of one batch."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from f(batch)
        give_back()

    return df.mapInArrow(each, schema)


class WordCodes:
    """Ids of texts from the ids of their words.

    Words repeat: a batch is split into words and its different words are found by Arrow, and each worker keeps the ids
    of the first ``limit`` different words it meets.  A word is what stands between single blanks; there
    the splitting pattern always ends a token, so the ids of a text are those of its words in order.  Of a new
    word, a run of Latin letters and the punctuation after it are tokens of their own for the pattern as well, and
    the letters go straight to the library's model; any other word goes through the whole library.  Where the
    vocabulary's tokens hold blanks (``join``), a text with other blanks than single spaces and line feeds inside
    words goes through the library whole, as does any text with the string of a special token.
    Codes are little-endian unsigned 16-bit numbers.
    """

    #: ASCII punctuation, but for the apostrophe, which the patterns may take together with letters
    TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
    #: a run of letters of the Latin blocks
    LETTERS = "^\n?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+$"
    LONGEST = 40

    def __init__(self, file: str, join: bool, limit: int = 600_000):
        """join: the vocabulary's tokens start with the blank before them and keep their case.

        Otherwise blanks are dropped and letters are lower-cased."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(file)
        if self.tokenizer.get_vocab_size() > 65536:
            raise ValueError("ids of 16 bits are too small for this vocabulary")
        self.model = self.tokenizer.model
        self.join, self.limit = join, limit
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words, self.codes = pa.array([], pa.string()), pa.array([], pa.binary())
        # the characters that stand for bytes in the vocabulary, for each letter of the Latin blocks
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0x41, 0x250) if chr(c).isalpha()}
        self.blank = as_bytes.pre_tokenize_str(" ")[0][0]
        self.feed = self.whole(["\n"])[0] if join else b""
        # words of letters alone, already in those characters, with blanks between them: one text for the library
        self.plain = Tokenizer(self.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.at_border = np.zeros(65536, bool)  # the ids that begin (join) or end a word
        self.at_border[[i for x, i in self.tokenizer.get_vocab().items() if (x.startswith(self.blank) if join else x.endswith("</w>"))]] = True

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u2").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def is_bad(self, key: str) -> bool:
        """Must a text with this word be encoded whole?"""
        if any(x in key for x in self.special):
            return True
        if not self.join:
            return False
        word = key[1:] if key[:1] == "\n" else key
        return not word or word[0].isspace() or word[-1].isspace()

    def learn(self, new: list[str], easy: list[bool]) -> tuple[list[bytes], list[bool]]:
        """The codes of these keys, and which of them need the whole text; easy: letters alone."""
        codes, bad = [b""] * len(new), [False] * len(new)
        runs = [k for k, e in enumerate(easy) if e]
        hard = []
        for k, e in enumerate(easy):
            if not e:
                bad[k] = self.is_bad(new[k])
                if new[k] and not bad[k]:
                    hard.append(k)
        bare = [k for k in runs if new[k][0] == "\n"] if self.join else []
        if bare:
            runs = [k for k in runs if new[k][0] != "\n"]
            for k in bare:
                codes[k] = self.feed + np.array([t.id for t in self.model.tokenize(new[k][1:].translate(self.letters))], "<u2").tobytes()
        for start in range(0, len(runs), 20_000):  # the library's record of a text takes far more than its ids
            some = runs[start : start + 20_000]
            text = " ".join(map(new.__getitem__, some))
            text = " ".join(self.blank + x for x in text.translate(self.letters).split(" ")) if self.join else text.lower().translate(self.letters)
            ids = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u2")
            at = np.flatnonzero(self.at_border[ids])
            at = [*at.tolist(), len(ids)] if self.join else [0, *(at + 1).tolist()]
            if len(at) != len(some) + 1:
                raise ValueError("a vocabulary whose words have no borders")
            flat = ids.tobytes()
            for k, x, y in zip(some, at, at[1:]):
                codes[k] = flat[2 * x : 2 * y]
        pieces = [new[k] if not self.join or new[k][0] == "\n" else " " + new[k] for k in hard]
        for k, code in zip(hard, self.whole(pieces)):
            codes[k] = code
        return codes, bad

    def encode(self, texts: list[str], most: int = 1 << 23) -> list[bytes]:
        """The codes of each text; ``most`` characters at a time, or one text."""
        out, first, size = [], 0, 0
        for k, t in enumerate(texts):
            if size and size + len(t) > most:
                out += self.part(texts[first:k])
                first, size = k, 0
            size += len(t)
        return out + self.part(texts[first:])

    def part(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        rows = pa.array(texts, pa.large_string())
        if self.join:  # a line feed starts a word, as does the begin of the text
            rows = pc.binary_join_element_wise(pa.scalar("\n", rows.type), pc.replace_substring(rows, "\n", " \n"), pa.scalar("", rows.type))
            split = pc.split_pattern(rows, " ")
        else:
            split = pc.ascii_split_whitespace(rows)
        ends = split.offsets.to_numpy()
        each = split.flatten().dictionary_encode()
        words = each.dictionary.cast(pa.string())
        # letters and the punctuation after them apart, any other word as it is
        base = pc.ascii_rtrim(words, characters=self.TAIL)
        easy = pc.match_substring_regex(base, self.LETTERS)
        easy = pc.and_(easy, pc.less_equal(pc.subtract(pc.binary_length(words), pc.binary_length(base)), 4))
        base = pc.if_else(easy, base, words)
        n_tail = pc.binary_length(words).to_numpy() - pc.binary_length(base).to_numpy()
        lengths = [n for n in np.unique(n_tail).tolist() if n]
        where = [np.flatnonzero(n_tail == n) for n in lengths]
        tails = pa.concat_arrays([pa.array([], pa.string()), *(pc.utf8_slice_codeunits(words.take(pa.array(w)), -n) for w, n in zip(where, lengths))]).dictionary_encode()
        tail_at = np.zeros(len(words), np.int32)
        if lengths:
            tail_at[np.concatenate(where)] = tails.indices.to_numpy() + 1
        tail_codes = pa.array([b"", *self.whole(tails.dictionary.to_pylist())], pa.binary()).take(pa.array(tail_at))

        keys = base.dictionary_encode()
        own = keys.dictionary
        at = pc.index_in(own, self.words)
        unknown = pc.is_null(at)
        new = own.filter(unknown)
        codes, bad = self.learn(new.to_pylist(), pc.match_substring_regex(new, self.LETTERS).to_pylist())
        fresh = pa.array(codes, pa.binary())
        place = at.fill_null(0).to_numpy(zero_copy_only=False).copy()
        miss = np.flatnonzero(unknown.to_numpy(zero_copy_only=False))
        place[miss] = len(self.words) + np.arange(len(miss))
        of_key = pa.concat_arrays([self.codes, fresh]).take(pa.array(place))
        of_word = pc.binary_join_element_wise(of_key.take(keys.indices), tail_codes, b"")
        done = of_word.cast(pa.large_binary()).take(each.indices)
        data, to = done.buffers()[2].to_pybytes(), np.frombuffer(done.buffers()[1], np.int64, len(done) + 1)[ends]
        skip = len(self.feed)
        out = [data[a + skip : b] for a, b in zip(to[:-1].tolist(), to[1:].tolist())]
        if any(bad):
            marked = np.zeros(len(own), bool)
            marked[miss] = bad
            hits = np.flatnonzero(marked[keys.indices.to_numpy()][each.indices.to_numpy()])
            odd = np.unique(np.searchsorted(ends, hits, "right") - 1).tolist()
            for k, code in zip(odd, self.whole([texts[k] for k in odd])):
                out[k] = code
        room = self.limit - len(self.words)
        if room > 0 and len(new):
            keep = pc.and_(pa.array(~np.array(bad, bool)), pc.less_equal(pc.binary_length(new), self.LONGEST))
            self.words = pa.concat_arrays([self.words, new.filter(keep).slice(0, room)])
            self.codes = pa.concat_arrays([self.codes, fresh.filter(keep).slice(0, room)])
        return out


_CODES: dict[tuple, WordCodes] = {}


def word_codes(file: str, join: bool) -> WordCodes:
    """One of these in each Python worker, for all its tasks."""
    if (file, join) not in _CODES:
        _CODES[file, join] = WordCodes(file, join)
    return _CODES[file, join]


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    return [t or "" for t in batch.column(name).to_pylist()]


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """node, component of every node of an edge: the smallest node reachable (star contraction, min-label).

    Alternates large-star and small-star steps until no edge changes; each step is an aggregation by node
    (combined before the shuffle) and a join with what it found, which is a table of its own so that Spark can split
    the join at a node with very many edges.  Null ends and loops are ignored.
    """
    now = scratch.keep(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct(),
        "edges",
    )
    edge = F.xxhash64("u", "v")
    state = lambda df: tuple(df.agg(F.count("*"), F.sum(edge.cast("decimal(38,0)")), F.bit_xor(edge)).first())
    before = state(now)
    while before[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.keep(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        # every larger neighbour of u hangs on the least node that u knows
        large = now.select("u", F.col("v").alias("w")).join(least.select(F.col("u").alias("w"), "m").hint("merge"), "w").select("u", F.col("m").alias("v")).distinct()
        large = scratch.keep(large, "large")
        # u and its smaller neighbours hang on the least of them
        low = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low.hint("merge"), "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")).select("e.u", F.col("e.m").alias("v")).where("u <> v").distinct()
        new = scratch.keep(small, "edges")
        after = state(new)
        for done in (now, least, large, low):
            scratch.drop(done)
        now = new
        if after == before:
            break
        before = after
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
