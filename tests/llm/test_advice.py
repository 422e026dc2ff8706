"""What the review of the first round found missing."""

import re
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from corpusmill.llm import ann, licenses, neardup, quality


COMMON = {
    "en": "the of and to in is that was for on are as with be by at".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem".split(),
}


def prose(k, common, n=300):
    """Made-up words, three in ten of them from common."""
    rng = np.random.default_rng(k)
    made = ["".join(rng.choice(list("abcdefghij"), 7)) for _ in range(n)]
    return " ".join(rng.choice(common) if common and rng.random() < 0.3 else w for w in made)


def test_stage_rejects_texts_without_the_common_words_of_their_language(spark):
    import corpus_pipeline

    en, de = COMMON["en"], COMMON["de"]
    rows = [(k, prose(k, en), "en") for k in range(40)] + [(100 + k, prose(100 + k, de), "de") for k in range(40)]
    good = {i for i, _, _ in rows}
    rows += [(900, prose(900, ()), "en"), (901, prose(901, de), "en"), (902, prose(902, en), "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in corpus_pipeline.quality_rules(spark, docs, "").collect()} == good


def test_stage_links_pairs_from_four_fifths_on(spark):
    import corpus_pipeline

    def pair(k, n, cut):  # the second has n - cut of the first's words in front and other words behind
        rng = np.random.default_rng(k)
        a = [f"w{k}x{i}" for i in rng.permutation(n)]
        return " ".join(a), " ".join(a[: n - cut] + [f"v{k}x{i}" for i in range(cut)])

    rows, gone = [], set()
    for k in range(60):
        first, second = pair(k, 204, 20 if k % 2 else 24)  # 180 of 220 shingles are common, or 176 of 224
        rows += [(2 * k, first), (2 * k + 1, second)]
        gone |= {2 * k + 1} if k % 2 else set()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {i for i, _ in rows} - gone


def test_bands_reach_the_similarity_asked_for():
    for percent in (50, 60, 70, 80, 84, 85, 90, 100):
        bands, rows = neardup.banding(percent).shape
        assert bands * rows <= neardup.HASHES and (1 - (percent / 100) ** rows) ** bands <= 1e-6
    assert neardup.banding(85).shape == (neardup.BANDS, neardup.ROWS)


APACHE = """/*
 * Copyright 2020 The Authors
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 */
package x;
"""
GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.

import os
"""
FOUND = [
    ("// SPDX-License-Identifier: MIT", "MIT"), ("# SPDX-License-Identifier: Apache-2.0\nimport os", "Apache-2.0"), ("SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"), ("BSD 3-Clause License", "BSD-3-Clause"),
    ("Apache License", "Apache-2.0"), ("Mozilla Public License Version 2.0", "MPL-2.0"), ("Creative Commons Attribution-NonCommercial 4.0 International", "CC-BY-NC-4.0"), (APACHE, "Apache-2.0"), (GPL, "GPL-3.0"),
    ("Licensed under the Foo License.", None), ("SPDX-License-Identifier: Foo-1.0", None), ("Das war es. Mit. Der Rest kam.\nMit mit", None), ("The driver needs a licence to use the road, and all of the cars in it are to be insured by the owner of the car.", None),
]


def test_licences_by_name_tag_header_and_whole_text(spark):
    from corpusmill.llm.license_forms import FORMS

    rows = [(f"d{k}/x", text, name) for k, (text, name) in enumerate(FOUND)]
    for name in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0"):
        full = "Copyright (c) 2021 Jane Roe\n" + FORMS[name][-1].split("\n", 3)[-1]  # without its title, in lines of another width
        rows.append((f"{name}/LICENSE", re.sub(r"(\S+(?: +\S+){0,5}) ", r"\1\n", full), name))
    df = spark.createDataFrame([r[:2] for r in rows], "path string, text string")
    got = {r["path"]: r["own_license"] for r in licenses.scan(df, F.lit(False)).collect()}
    assert got == {p: name for p, _, name in rows}
    assert all(re.search(licenses.HINT, x) for texts in FORMS.values() for x in texts)
    assert all(text in FORMS[name] for name, text in licenses.TEMPLATES.items())


def test_rules_that_filter_stay_small(spark, tmp_path):
    """The distances are computed once, before the filter: the plan of what is kept holds none of them."""
    rows = [(k, " ".join(f"w{(k * j) % 37} and" for j in range(60)), "en") for k in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    kept = quality.keep_good(docs)
    assert "log2" not in kept._jdf.queryExecution().analyzed().toString().lower()
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in quality.assess(docs).collect() if r["kept"]}


def test_many_queries_take_bounded_memory():
    """However many queries are one batch, the visits are those of each alone, and neither they nor the products pile up."""
    rng = np.random.default_rng(3)
    points, queries = rng.standard_normal((4096, 16)), rng.standard_normal((3000, 16))
    trees = ann.fit(points, 60_000, ann.Forest())
    held = [np.bincount(t.leaf_of(points), minlength=t.leaves) for t in trees]
    blocks = 1 + np.arange(sum(t.leaves for t in trees)) % 3
    want = [(q, s, b) for q, found in enumerate(ann.leaves_for(queries[:200], trees, held, 2000)) for s in found for b in range(int(blocks[s]))]
    got = [x for who, slot, salt in ann.visits(queries[:200], trees, held, 2000, blocks) for x in zip(who.tolist(), slot.tolist(), salt.tolist())]
    assert got == want
    tracemalloc.start()
    for who, _, _ in ann.visits(queries, trees, held, 300, blocks):
        assert len(who) <= ann.ROWS
    for q, near, score in ann.closest(queries, points, 5):
        assert len(near) == len(score) == 5
    assert q == 2999 and tracemalloc.get_traced_memory()[1] < 40e6
    tracemalloc.stop()
