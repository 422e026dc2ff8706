"""Token ids in files under one canonical, length-limited Huffman code.

The code is made from the counts of the ids in the whole corpus (a row for each id of the vocabulary at most
reaches the driver) by package-merge, so no code is longer than ``LIMIT`` bits and one table look-up decodes
an id.  Documents lie in ascending order of their ids, in shards that are ranges of document ids.

A shard is a run of pages, rows (shard, page, ids before it in the shard, ids, data) of a Parquet folder; the
Parquet files are only the carrier, so that any store that Spark can write will do.  A page is, little-endian:

    "CMHF", documents u32, blocks u32, payload bytes u32, documents without an id u32 (they come first)
    document ids i64 each (0 for none), ids of each document u32
    bits of each block u32
    payload: the blocks, each from a byte boundary, codes from the highest bit down

A block holds ``BLOCK`` ids of one document (its last one the rest) and decodes by itself: the running sum of
the blocks' bits, each rounded up to bytes, is its checkpoint.  ``lengths.parquet`` beside the pages has the
code length of each id, from which the canonical code follows.
"""

from __future__ import annotations

import pyarrow as pa
import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, long_texts, map_arrow, texts_of, word_codes

LIMIT = 20
BLOCK = 512
PAGE_BYTES = 1 << 18
PAGES = "shard int, page int, before long, n long, data binary"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for these counts (0 where a count is 0), by package-merge."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    n, leaf_flags = len(order), []
    packages = np.zeros(0, np.int64)
    for _ in range(limit):
        both = np.concatenate([weights, packages])
        at = np.argsort(both, kind="stable")
        leaf_flags.append(at < n)
        merged = both[at]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for flags in reversed(leaf_flags):
        leaves = int(flags[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes: by rising length, then by rising id, each the one before plus one."""
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for i in order[lengths[order] > 0].tolist():
        code <<= int(lengths[i]) - last
        codes[i], last = code, int(lengths[i])
        code += 1
    return codes


def decode_table(lengths: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """For each next ``limit`` bits: id * 32 + code length."""
    out = np.zeros(1 << limit, np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = 1 << (limit - lengths[order].astype(np.int64))
    filled = np.repeat(order.astype(np.uint32) * 32 + lengths[order], spans)
    out[: len(filled)] = filled
    return out


def block_ends(counts: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """First id and number of ids of each block, for documents of these many ids one after the other."""
    blocks = -(-counts // block)
    first = np.repeat(np.cumsum(counts) - counts, blocks)
    k = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = first + k * block
    return start, np.minimum(block, np.repeat(counts, blocks) - k * block)


def encode(ids: np.ndarray, counts: np.ndarray, lengths: np.ndarray, codes: np.ndarray, most: int = 1 << 15) -> tuple[np.ndarray, bytes]:
    """Bits of each block, and the payload, for documents of ``counts`` ids one after the other in ``ids``.

    About ``most`` ids at a time, or one document, so that the arrays stay in the processor's cache.
    """
    ends, bits, payload, doc, at = np.cumsum(counts), [np.zeros(0, np.int64)], [], 0, 0
    while doc < len(counts):
        to = max(doc + 1, int(np.searchsorted(ends, at + most, "right")))
        if ends[to - 1] > at:
            b, p = encode_some(ids[at : ends[to - 1]], counts[doc:to], lengths, codes)
            bits.append(b), payload.append(p)
        doc, at = to, int(ends[to - 1])
    return np.concatenate(bits), b"".join(payload)


def encode_some(ids: np.ndarray, counts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, bytes]:
    size = lengths[ids].astype(np.int64)
    start, n = block_ends(counts)
    ends = np.cumsum(size)
    before = np.concatenate([[0], ends])
    bits = before[start + n] - before[start]
    padded = -(-bits // 8) * 8
    at = before[:-1] + np.repeat(np.cumsum(padded) - padded - before[start], n)
    high = codes[ids] << (64 - size).astype(np.uint64)
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    out = np.zeros(int(padded.sum() + 127) // 64, np.uint64)
    heads = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[heads]] = np.bitwise_or.reduceat(high >> shift, heads)
    over = np.flatnonzero((at & 63) + size > 64)
    out[word[over] + 1] |= high[over] << (np.uint64(64) - shift[over])
    return bits, out.astype(">u8").tobytes()[: int(padded.sum()) // 8]


def decode(payload: bytes, bits: np.ndarray, n: np.ndarray, table: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """The ids of all blocks in order; the blocks are decoded side by side, an id of each at a time."""
    out = np.zeros(int(n.sum()), np.uint16)
    if not len(n):
        return out
    data = np.frombuffer(payload + b"\0" * 8, np.uint8)
    window = np.ndarray((len(data) - 3,), ">u4", data, strides=(1,))
    padded = -(-bits // 8)
    order = np.argsort(-n, kind="stable")
    at = ((np.cumsum(padded) - padded) * 8)[order]
    to = (np.cumsum(n) - n)[order]
    active = np.searchsorted(-n[order], -np.arange(int(n.max())), "left")
    mask, base = (1 << limit) - 1, 32 - limit
    for k, m in enumerate(active.tolist()):
        pos = at[:m]
        entry = table[(window[pos >> 3].astype(np.int64) >> (base - (pos & 7))) & mask]
        out[to[:m] + k] = entry >> 5
        pos += entry & 31
    return out


def tokenize(docs: DataFrame, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id long, ids binary (little-endian 16-bit ids and ``end`` after them); a null text counts as empty."""
    long_texts(docs.sparkSession)

    def each(batch: pa.RecordBatch):
        stop = np.array([end], "<u2").tobytes()
        codes = word_codes(tokenizer, False).encode(texts_of(batch, "text"))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c + stop for c in codes], pa.binary())], ["doc_id", "ids"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), each, "doc_id long, ids binary")


def count_ids(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs: counted in each task, summed, a row for each different id to the driver."""

    def each(batches):
        total = np.zeros(65536, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u2"), minlength=65536)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], ["id", "n"])

    out = np.zeros(65536, np.int64)
    for row in tokens.select("ids").mapInArrow(each, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[row["id"]] = row["n"]
    return out


def page(docs: list[int | None], n: list[int], bits: list[np.ndarray], payload: list[bytes]) -> bytes:
    flat, body = np.concatenate(bits), b"".join(payload)
    head = np.array([len(docs), len(flat), len(body), docs.count(None)], "<u4").tobytes()
    return b"CMHF" + head + np.array([d or 0 for d in docs], "<i8").tobytes() + np.array(n, "<u4").tobytes() + flat.astype("<u4").tobytes() + body


def parse(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Document ids, which of them are none, ids of each document, bits of each block, payload."""
    if data[:4] != b"CMHF":
        raise ValueError("not a page")
    d, b, size, nulls = np.frombuffer(data, "<u4", 4, 4).tolist()
    at = 20 + 12 * d
    docs, n, bits = np.frombuffer(data, "<i8", d, 20), np.frombuffer(data, "<u4", d, 20 + 8 * d), np.frombuffer(data, "<u4", b, at)
    if len(data) != at + 4 * b + size:
        raise ValueError("a page of another length than it says")
    return docs, np.arange(d) < nulls, n.astype(np.int64), bits.astype(np.int64), data[at + 4 * b :]


def write(tokens: DataFrame, path: str, ids_per_shard: int = 2_000_000) -> None:
    """Write the files of tokens (doc_id, ids) to the new folder ``path``; tokens is read three times.

    Documents without an id come first.  Documents of one id follow each other by their numbers of ids, then by their
    codes; equal rows are all written.  An empty table gives files without a page.
    """
    spark = tokens.sparkSession
    counts = count_ids(tokens)
    lengths = code_lengths(counts)
    codes = canonical(lengths)
    shards = max(1, int(counts.sum()) // ids_per_shard)
    bounds = np.unique(tokens.approxQuantile("doc_id", [k / shards for k in range(1, shards)], 0.2 / shards)) if shards > 1 else np.zeros(0)

    def squeeze(batch: pa.RecordBatch):
        raw = batch.column("ids").to_pylist()
        ids, n = np.frombuffer(b"".join(raw), "<u2"), np.array([len(x) // 2 for x in raw], np.int64)
        bits, payload = encode(ids, n, lengths, codes)
        blocks = -(-n // BLOCK)
        last_block, last_byte = np.cumsum(blocks), np.concatenate([[0], np.cumsum(-(-bits // 8))])
        parts, sizes = [], []
        for b, e in zip((last_block - blocks).tolist(), last_block.tolist()):
            parts.append(payload[last_byte[b] : last_byte[e]]), sizes.append(bits[b:e].astype("<u4").tobytes())
        doc = batch.column("doc_id")
        shard = np.searchsorted(bounds, doc.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), "left").astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(shard), doc, pa.array(n), pa.array(sizes, pa.binary()), pa.array(parts, pa.binary())], ["shard", "doc_id", "n", "bits", "payload"])

    def paged(batches):
        shard = number = None
        held: tuple[list, list, list, list] = ([], [], [], [])
        size = before = 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([before]), pa.array([sum(held[1])]), pa.array([page(*held)], pa.binary())], ["shard", "page", "before", "n", "data"])

        for batch in batches:
            for s, d, n, b, p in zip(*(c.to_pylist() for c in batch.columns)):
                if held[0] and (s != shard or size >= PAGE_BYTES):
                    yield out()
                    before += sum(held[1])
                    held, size, number = ([], [], [], []), 0, number + 1
                if s != shard:
                    shard, number, before = s, 0, 0
                for x, y in zip(held, (d, n, np.frombuffer(b, "<u4"), p)):
                    x.append(y)
                size += len(p)
        if held[0]:
            yield out()

    packed = map_arrow(tokens, squeeze, "shard int, doc_id long, n long, bits binary, payload binary")
    # a task for each shard; null ids sort first
    in_order = packed.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("doc_id", "n", "payload")
    in_order.mapInArrow(paged, PAGES).write.option("compression", "none").parquet(f"{path}/pages.parquet")
    spark.createDataFrame([(lengths.tobytes(),)], "lengths binary").coalesce(1).write.parquet(f"{path}/lengths.parquet")


def read(spark: SparkSession, path: str) -> DataFrame:
    """From the files alone: doc_id, start long (ids of all documents before it), ids binary (little-endian unsigned 32-bit)."""
    lengths = np.frombuffer(spark.read.parquet(f"{path}/lengths.parquet").first()["lengths"], np.uint8)
    pages = spark.read.schema(PAGES).parquet(f"{path}/pages.parquet")
    table: list[np.ndarray] = []

    # ids before each shard: a row for each shard, joined as its size allows
    totals = pages.groupBy("shard").agg(F.sum("n").alias("n"))
    shards = totals.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = pages.join(shards, "shard").select((F.col("base") + F.col("before")).alias("at"), "data")

    def unpack(batch: pa.RecordBatch):
        if not table:
            table.append(decode_table(lengths))
        found = [parse(x) for x in batch.column("data").to_pylist()]
        n = np.concatenate([x[2] for x in found])
        ids = decode(b"".join(x[4] for x in found), np.concatenate([x[3] for x in found]), block_ends(n)[1], table[0])
        wide = ids.astype("<u4").tobytes()
        docs = np.concatenate([x[0] for x in found])
        ends = np.cumsum(n)
        first = np.concatenate([np.cumsum(x[2]) - x[2] + at for x, at in zip(found, batch.column("at").to_pylist())])
        each = [wide[4 * a : 4 * b] for a, b in zip((ends - n).tolist(), ends.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(docs, mask=np.concatenate([x[1] for x in found])), pa.array(first), pa.array(each, pa.binary())], ["doc_id", "start", "ids"])

    return map_arrow_small(placed, unpack, "doc_id long, start long, ids binary")


def map_arrow_small(df: DataFrame, f, schema: str, rows: int = 24) -> DataFrame:
    """map_arrow with at most ``rows`` rows at a time."""

    def each(batch: pa.RecordBatch):
        for k in range(0, batch.num_rows, rows):
            yield from f(batch.slice(k, rows))

    return map_arrow(df, each, schema)


def encode_documents(docs: DataFrame, tokenizer: str, end: int, path: str) -> None:
    """Tokenize docs and write the files; the ids are kept in the shared folder until the files are written.

    A null or empty text has the one id ``end``; a null id is written as none; repeated rows are all written, in the
    order that write() states; other columns are dropped.
    """
    scratch = Scratch(docs.sparkSession)
    where = scratch.path("ids")
    tokenize(docs, tokenizer, end).write.option("compression", "zstd").parquet(where)
    kept = docs.sparkSession.read.schema("doc_id long, ids binary").parquet(where)
    write(kept, path)
    scratch.drop(kept)
