"""What quality rules hold a document against: enough other documents that pass, in its language or in all."""

import random
from dataclasses import replace

import pytest

from corpusmill.llm import quality

COMMON = {"en": "the of and to in is that was for on", "de": "der die und in den von zu das mit sich", "fr": "le la les de des et un une est que"}


def prose(seed, lang, n=200):
    rng = random.Random(seed)
    return " ".join(rng.choice(COMMON[lang].split()) if rng.random() < 0.35 else "".join(rng.choices("abcdefghijklm", k=6)) for _ in range(n))


def junk(seed, n=200):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("QXZ#$%&0123456789", k=7)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    out = [(k, prose(k, "en"), "en") for k in range(40)] + [(100 + k, prose(100 + k, "de"), "de") for k in range(30)] + [(200 + k, prose(200 + k, "fr"), "fr") for k in range(25)]
    out += [(300, junk(1), "xx"), (301, junk(2), "en"), (302, junk(3), None), (303, prose(7, "en"), "yy")]
    out += [(400 + k, "same three words " * 80, "en") for k in range(60)]  # fails the base rules, and would be most of the language
    return out


def judged(spark, rows, rules=quality.Rules()):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return {r["doc_id"]: r for r in quality.assess(df, rules).collect()}


def test_junk_sets_no_standard_of_its_own(spark, rows):
    got = judged(spark, rows)
    assert not any(got[i]["kept"] for i in (300, 301, 302)) and all(got[i]["js_chars"] > 0.28 for i in (300, 301, 302))
    assert all(got[i]["kept"] for i in got if i < 300) and got[303]["kept"]


def test_rejected_documents_are_in_no_reference(spark, rows):
    got, without = judged(spark, rows), judged(spark, [r for r in rows if r[0] < 400])
    assert all(got[i] == without[i] for i in without)
    assert all(got[i]["base_failed"] and not got[i]["kept"] for i in got if i >= 400)


def test_own_counts_are_left_out(spark, rows):
    """The distance of a document that is in its reference is that to the others: the same as if it had another language's place."""
    rules = quality.Rules(min_documents=1, min_reference_words=1, max_char_distance=2, max_word_distance=2)
    alone = judged(spark, [(1, prose(1, "en"), "en")], rules)[1]
    assert alone["js_chars"] is None and alone["js_words"] is None and alone["kept"]
    two = judged(spark, [(1, prose(1, "en"), "en"), (2, junk(1), "en")], rules)
    assert two[1]["js_chars"] == two[2]["js_chars"] > 0.5
    assert judged(spark, rows)[0]["js_words"] > 0


def test_languages_beyond_one_look_up(spark, rows):
    """Parts of the languages give what all of them at once give."""
    one, many = judged(spark, rows), judged(spark, rows, replace(quality.Rules(), languages_at_once=1))
    assert one == many


def test_bars_are_words_too(spark):
    text = " | ".join(prose(k, "en", 12) for k in range(10))
    got = judged(spark, [(k, text if k < 3 else prose(k, "en") + " | x", "en") for k in range(30)])
    assert len(got) == 30 and all(r["js_words"] is not None for r in got.values())
