"""Language of texts by a convolutional network over their bytes, trained in numpy.

A window is ``length`` bytes of a text in UTF-8 (the last one is filled up with zeros).  Each byte is embedded, filters of
several widths run over the embedded bytes, the largest value of each filter passes a rectifier, and a softmax of these
gives the probability of each language.  Windows overlap by the widest filter less one, so every run of bytes that a
filter can see is in exactly one window, and a text is all its windows: its probabilities are the mean of
theirs, weighted by their bytes.

Embedding and filters are linear, so what a byte adds to all filters is one row of a table of 256 rows for each place in a
filter, and what two bytes add is one row of a table of 65,536: a window costs some lookups and sums.  The largest value
of a filter comes from one place, so training moves only the rows of the bytes that stand there.

The network is fitted on the driver on a sample of at most ``Network.rows`` labelled texts (as many of each language as there
is room for, those with the smallest hashes, copies once) with at most ``windows`` windows of each; windows are cut in
the tasks, so of a text no more than these reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .shared import long_texts, map_arrow

#: What a text without a letter gets.
UNKNOWN = "und"


@dataclass(frozen=True)
class Network:
    """rows bounds the labelled texts that are looked at, windows the windows of each."""

    length: int = 256
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16
    embedding: int = 12
    rows: int = 6000
    windows: int = 2
    passes: int = 4
    batch: int = 64
    rate: float = 4e-3
    seed: int = 11


@dataclass
class Model:
    """labels in order; tables: for each place in a filter what each byte adds to the filters wide enough; and the softmax."""

    network: Network
    labels: list[str]
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    of_pairs: list[np.ndarray] = field(default_factory=list)

    @property
    def places(self) -> list[int]:
        """For each place in a filter, the first filter that is wide enough to have it."""
        return [sum(self.network.filters for w in self.network.widths if w <= j) for j in range(max(self.network.widths))]

    def tables(self) -> list[np.ndarray]:
        return [self.weights["bytes"] @ self.weights[f"place{j}"] for j in range(len(self.places))]

    def pooled(self, x: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """What each filter has at each place of each window: windows x places x filters."""
        n = x.shape[1] - len(tables) + 1
        out = tables[0][x[:, :n]]
        for j, (first, table) in enumerate(zip(self.places, tables)):
            if j:
                out[:, :, first:] += table[x[:, j : j + n]]
        return out

    def pairs(self) -> list[np.ndarray]:
        """What each pair of bytes adds to all filters, for the first two places, the next two, and so on."""
        if not self.of_pairs:
            tables, n = self.tables(), self.weights["bias"].size
            for j in range(0, len(tables), 2):
                two = np.zeros((256, 256, n), np.float32)
                for k, (first, table) in enumerate(list(zip(self.places, tables))[j : j + 2]):
                    two[:, :, first:] += table[:, None] if k == 0 else table[None]
                self.of_pairs.append(two.reshape(65536, n))
        return self.of_pairs

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of each language for each window (rows of bytes)."""
        n, out = x.shape[1] - max(self.network.widths) + 1, None
        x = np.pad(x, ((0, 0), (0, 1)))  # where the widths are odd, the last pair has a place that no filter sees
        both = x[:, :-1].astype(np.int64) * 256 + x[:, 1:]
        for j, table in enumerate(self.pairs()):
            some = table.take(both[:, 2 * j : 2 * j + n].ravel(), axis=0)
            out = some if out is None else np.add(out, some, out=out)
        most = out.reshape(len(x), n, -1).max(axis=1)
        return softmax(np.maximum(most + self.weights["bias"], 0) @ self.weights["dense"] + self.weights["offset"])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, names: list[str], network: Network = Network()) -> Model:
    """The network fitted on windows (bytes) and the numbers of their labels, the same on every run."""
    rng = np.random.default_rng(network.seed)
    widths = sorted(network.widths)
    model = Model(network, names)
    n_filters = network.filters * len(widths)
    w = model.weights
    w["bytes"] = rng.standard_normal((256, network.embedding)) * 0.5
    for j, first in enumerate(model.places):
        w[f"place{j}"] = rng.standard_normal((network.embedding, n_filters - first)) * 0.3
    w["bias"], w["dense"], w["offset"] = np.zeros(n_filters), rng.standard_normal((n_filters, len(names))) * 0.1, np.zeros(len(names))
    for k in w:
        w[k] = w[k].astype(np.float32)
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    steps = network.passes * -(-len(windows) // network.batch)
    for _ in range(network.passes):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), network.batch):
            x, y = windows[order[at : at + network.batch]].copy(), labels[order[at : at + network.batch]]
            # one window in three is cut short, as the last window of a text is
            for k in np.flatnonzero(rng.random(len(x)) < 1 / 3):
                x[k, rng.integers(16, x.shape[1]) :] = 0
            grads = gradients(model, x, y)
            step += 1
            rate = network.rate * (1 - step / (steps + 1))
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                w[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def gradients(model: Model, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross entropy, by the name of the weights."""
    w, tables = model.weights, model.tables()
    seen = model.pooled(x, tables)
    where = seen.argmax(axis=1)
    most = np.take_along_axis(seen, where[:, None, :], 1)[:, 0] + w["bias"]
    hidden = np.maximum(most, 0)
    p = softmax(hidden @ w["dense"] + w["offset"])
    p[np.arange(len(y)), y] -= 1
    p /= len(y)
    back = (p @ w["dense"].T) * (most > 0)
    out = {"dense": hidden.T @ p, "offset": p.sum(axis=0), "bias": back.sum(axis=0), "bytes": np.zeros_like(w["bytes"])}
    for j, first in enumerate(model.places):
        wide = where.shape[1] - first
        byte = np.take_along_axis(x, where[:, first:] + j, 1).astype(np.int64)
        table = np.bincount((byte * wide + np.arange(wide)).ravel(), back[:, first:].ravel(), 256 * wide).reshape(256, wide).astype(np.float32)
        out[f"place{j}"] = w["bytes"].T @ table
        out["bytes"] += table @ w[f"place{j}"].T
    return out


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of these texts and where each begins, with the end of the last; null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8), ends


def windows_at(data: np.ndarray, start: np.ndarray, stop: np.ndarray, length: int) -> np.ndarray:
    at = start[:, None] + np.arange(length)
    return np.where(at < stop[:, None], data[np.minimum(at, len(data) - 1)], 0)


def starts(ends: np.ndarray, network: Network) -> tuple[np.ndarray, np.ndarray]:
    """The text and the first byte of each window; an empty text has one."""
    step = network.length - max(network.widths) + 1
    size = np.diff(ends)
    n = 1 + np.maximum(0, -(-(size - network.length) // step))
    text = np.repeat(np.arange(len(size)), n)
    return text, ends[:-1][text] + step * (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n))


def sample(labelled: DataFrame, network: Network, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, window (bytes): at most ``windows`` of each of at most ``rows`` texts."""
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang IS NOT NULL")
    rows = rows.where(F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("text"))
    known = rows.groupBy("lang", "h").agg(F.lit(1).alias("one")).drop("one")
    each = max(1, network.rows // max(1, known.select("lang").distinct().count()))
    order = Window.partitionBy("lang").orderBy("h")
    chosen = known.withColumn("k", F.row_number().over(order)).where(F.col("k") <= each).orderBy("k", "lang").limit(network.rows).select("lang", "h")
    texts = rows.join(F.broadcast(chosen), ["lang", "h"])  # as many as rows at most

    def cut(batch: pa.RecordBatch):
        data, ends = bytes_of(batch.column("text"))
        text, start = starts(ends, network)
        h = batch.column("h").to_numpy()
        keep = np.zeros(len(text), bool)
        for t, (a, b) in enumerate(zip(np.searchsorted(text, range(len(h))), np.searchsorted(text, range(1, len(h) + 1)))):
            keep[a + np.random.default_rng(abs(int(h[t]))).permutation(b - a)[: network.windows]] = True
        x = windows_at(data, start[keep], ends[1:][text[keep]], network.length).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(text[keep])), pa.array([w.tobytes() for w in x], pa.binary())], ["lang", "window"])

    return map_arrow(texts.select("lang", "h", "text"), cut, "lang string, window binary").distinct()


def fit(labelled: DataFrame, network: Network = Network(), text_col: str = "text", lang_col: str = "lang") -> Model:
    """The network for the languages of labelled texts; rows with a null language or without a letter teach nothing."""
    long_texts(labelled.sparkSession)
    rows = sorted((r["lang"], bytes(r["window"])) for r in sample(labelled, network, text_col, lang_col).collect())
    names = sorted({lang for lang, _ in rows})
    if not rows:
        return Model(network, [])
    windows = np.frombuffer(b"".join(w for _, w in rows), np.uint8).reshape(len(rows), -1)
    return train(windows, np.searchsorted(names, [lang for lang, _ in rows]), names, network)


def shares(model: Model, texts: pa.Array, most: int = 32) -> np.ndarray:
    """The probabilities of each text, ``most`` windows at a time."""
    data, ends = bytes_of(texts)
    text, start = starts(ends, model.network)
    out = np.zeros((len(texts), len(model.labels)))
    for k in range(0, len(text), most):
        t, a = text[k : k + most], start[k : k + most]
        x = windows_at(data, a, ends[1:][t], model.network.length)
        size = np.maximum(1, np.minimum(ends[1:][t] - a, model.network.length))
        np.add.at(out, t, model.probabilities(x) * size[:, None])
    return out / out.sum(axis=1, keepdims=True)


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of docs (all), and lang_pred and score (0 to 1), for each row.

    A null text or one without a letter is ``und`` with a score of 0, as is any text where no language was learned; equal
    probabilities go to the language that comes first.  Whole texts are read, however long.  Columns of the input
    named lang_pred or score are replaced; an empty table gives an empty one.
    """
    long_texts(docs.sparkSession)
    keep = [c for c in (keep or docs.columns) if c not in ("lang_pred", "score")]
    schema = StructType([*(docs.schema[c] for c in keep), StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def each(batch: pa.RecordBatch):
        texts = batch.column(text_col)
        known = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        names, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        if model.labels and known.any():
            found = shares(model, texts.filter(pa.array(known)))
            names[known], score[known] = np.array(model.labels, object)[found.argmax(axis=1)], np.minimum(found.max(axis=1), 1.0)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(names, pa.string()), pa.array(score)], schema=pa.schema([*(batch.schema.field(c) for c in keep), pa.field("lang_pred", pa.string()), pa.field("score", pa.float64())]))

    return map_arrow(docs.select(*keep, *([] if text_col in keep else [text_col])), each, schema)


def held_out(id_col: str = "doc_id"):
    """Is this row kept from learning: crc32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1
