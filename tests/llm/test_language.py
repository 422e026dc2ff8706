"""The byte network: its gradients, its windows, its tables of pairs, odd rows, and how many held-out documents it gets right."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import language
from corpusmill.llm.language import Model, Network

SMALL = Network(length=24, widths=(2, 3, 5), filters=3, embedding=4, passes=1, batch=8)
SCHEMA = "doc_id long, text string, lang string, source string, score string, lang_pred int, held_out boolean"


def small(network=SMALL, names=("a", "b", "c")):
    rng = np.random.default_rng(1)
    x = rng.integers(1, 256, (16, network.length)).astype(np.uint8)
    return language.train(x, rng.integers(0, len(names), 16), list(names), network), x


def test_gradients():
    model, x = small()
    for k in model.weights:
        model.weights[k] = model.weights[k].astype(np.float64)
    y = np.arange(len(x)) % 3

    def loss():
        hidden = np.maximum(model.pooled(x, model.tables()).max(axis=1) + model.weights["bias"], 0)
        return -np.log(language.softmax(hidden @ model.weights["dense"] + model.weights["offset"])[np.arange(len(y)), y]).mean()

    grads, rng = language.gradients(model, x, y), np.random.default_rng(2)
    for k, w in model.weights.items():
        for _ in range(12):
            at = tuple(rng.integers(0, n) for n in w.shape)
            if k == "bytes":
                at = (int(x[at[0] % len(x), at[1]]), at[1])
            was = w[at]
            w[at] = was + 1e-5
            up = loss()
            w[at] = was - 1e-5
            down = loss()
            w[at] = was
            assert abs((up - down) / 2e-5 - grads[k][at]) < 1e-4


@pytest.mark.parametrize("widths", [(2, 3, 4), (3,), (1, 2, 5), (5, 2)])
def test_pairs_of_bytes(widths):
    """Tables of pairs give what single bytes give; so does the window's last place."""
    model, x = small(Network(length=24, widths=widths, filters=3, embedding=4, passes=1, batch=8))
    hidden = np.maximum(model.pooled(x, model.tables()).max(axis=1) + model.weights["bias"], 0)
    assert np.allclose(model.probabilities(x), language.softmax(hidden @ model.weights["dense"] + model.weights["offset"]), atol=1e-6)


def test_windows_cover_texts():
    """Each run of as many bytes as the widest filter is in exactly one window; a text's probabilities are the mean of its windows."""
    model, _ = small()
    texts = ["", "é", "x" * 24, "abc" * 9, "".join(chr(97 + k % 26) for k in range(333)), None]
    data, ends = language.bytes_of(pa.array(texts, pa.string()))
    which, start = language.starts(ends, SMALL)
    got = language.shares(model, pa.array(texts, pa.string()), most=3)
    for t, text in enumerate(texts):
        raw = (text or "").encode()
        seen = [p for s in start[which == t] for p in range(s - ends[t], s - ends[t] + SMALL.length - 4) if p + 5 <= len(raw)]
        assert seen == list(range(max(0, len(raw) - 4)))
        cuts = [raw[k : k + 24] for k in range(0, max(1, len(raw) - 4), 20)]
        x = np.frombuffer(b"".join(c.ljust(24, b"\0") for c in cuts), np.uint8).reshape(-1, 24)
        size = np.maximum(1, [len(c) for c in cuts])[:, None]
        assert np.allclose(got[t], (model.probabilities(x) * size).sum(axis=0) / size.sum(), atol=1e-6)


def test_odd_rows(spark):
    """Nulls, no letters, repeated rows, a text of a million characters, columns whose names clash; nothing learned; no rows."""
    en, fr = "the cat sat on the mat and the dog ran ", "le chat est sur la table et les chiens vont "
    learn = [(k, x * 5 + str(k), lang, "s", "?", 1, None) for k in range(40) for x, lang in ((en, "en"), (fr, "fr"))] + [(900, None, "en", "s", "?", 1, None), (901, en, None, "s", "?", 1, None), (902, "12 34", "xx", "s", "?", 1, None)]
    model = language.fit(spark.createDataFrame(learn, SCHEMA), Network(passes=20))
    assert model.labels == ["en", "fr"]
    ask = [(1, en, None, "s", "?", 1, True), (1, en, None, "s", "?", 1, True), (2, fr * 25_000, "en", "s", "?", 1, False), (3, None, "en", "s", "?", 1, None), (4, "", None, None, None, None, None), (5, "1, 2. \n_?", None, "s", "?", 1, None), (None, "é", None, "s", "?", 1, None)]
    df = spark.createDataFrame(ask, SCHEMA)
    out = language.predict(df, model)
    assert out.columns == ["doc_id", "text", "lang", "source", "held_out", "lang_pred", "score"]
    rows = out.collect()
    by_id = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows}
    assert len(rows) == 7 and by_id[1][0] == "en" and by_id[2][0] == "fr" and by_id[2][1] > 0.8
    assert by_id[3] == by_id[4] == by_id[5] == ("und", 0.0) and by_id[None][0] in ("en", "fr")
    assert {tuple(r)[1:] for r in language.predict(df, Model(Network(), []), keep=["doc_id"]).collect()} == {("und", 0.0)}
    none = spark.createDataFrame([], SCHEMA)
    assert language.fit(none).labels == [] and language.predict(none, model).collect() == []


def test_sample_is_bounded(spark):
    rows = [(k, f"some words {k % 50} " * 100, "en" if k % 10 else "fr", "s", "?", 1, None) for k in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = language.sample(df, Network(rows=20, windows=3)).collect()
    assert {r["lang"] for r in got} == {"en", "fr"} and len(got) <= 60 and all(len(r["window"]) == 256 for r in got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, language.sample(df.repartition(7), Network(rows=20, windows=3)).collect()))


def test_held_out_documents(spark):
    """What it has not learned from; and the labels of these rows change nothing."""
    from corpusmill.llm.registry import op11_byte_network

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = op11_byte_network(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang", F.length("text").alias("n")), "doc_id").collect()
    held = [r for r in found if r["held_out"]]
    assert len(found) == docs.count() and 0.2 < len(held) / len(found) < 0.45 and all(0 <= r["score"] <= 1 for r in found)
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.96
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
