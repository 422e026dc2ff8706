"""Parts of the operators that need no session."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import ann, neardup, packing, piece_codec, token_counts, token_files
from corpusmill.llm.registry import tokenizer_file
from corpusmill.llm.shared import WordCodes

PARTS = ["a", "the", " ", " ", " ", "  ", "\n", "é", "É", "𝔘", "'s", "İ", "Σ", "Ti", "\t", "0", "12", ".", ",", "...", "!?", " of", " ", "\x1c", "é", "<|endoftext|>", "ß", "中", " \n", "▁", "\r", " \r", "\x0b", "\x0c", "$$$", ".%%%"]


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(n)]


@pytest.mark.parametrize("name,join", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_word_codes_equal_the_library(name, join):
    coder = WordCodes(tokenizer_file(name), join, limit=500)
    found = texts(1500)
    want = [e.ids for e in coder.tokenizer.encode_batch(found, add_special_tokens=False)]
    for _ in range(2):  # cold, then with what is known
        assert [np.frombuffer(c, "<u2").tolist() for c in coder.encode(found)] == want
    assert len(coder.words) <= 500 and len(coder.codes) == len(coder.words)


def test_pieces_equal_the_library():
    pieces = piece_codec.Pieces(tokenizer_file("piece_bpe_32k.model"))
    found = texts(3000, 2)
    ids = [np.frombuffer(c, "<u2").tolist() for c in pieces.encode(found)]
    assert ids == pieces.library.encode(found)
    assert [pieces.decode(i) for i in ids] == [pieces.library.decode(i) for i in ids]
    rng = random.Random(3)
    for _ in range(300):  # ids that no text gives
        any_ids = [rng.randrange(32000) if rng.random() < 0.6 else rng.randrange(3, 259) for _ in range(rng.randint(0, 8))]
        assert pieces.decode(any_ids) == pieces.library.decode(any_ids)


def test_prefix_table_holds_the_last_token_of_each_prefix():
    pieces = piece_codec.Pieces(tokenizer_file("piece_bpe_32k.model"))
    word = "▁internationalization"
    last = pieces.table(word)
    for k in range(1, len(word) + 1):
        assert pieces.names[last[k]] == pieces.merged(word[:k])[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=0, max_size=300), st.lists(st.integers(1, 700), min_size=1, max_size=8), st.integers(9, 20))
def test_huffman_round_trip(counts, sizes, limit):
    rng = np.random.default_rng(len(counts))
    ids = rng.integers(0, max(1, len(counts)), sum(sizes)).astype(np.uint16)
    all_counts = np.bincount(ids, minlength=65536)
    lengths = token_files.code_lengths(all_counts, limit)
    assert lengths.max() <= limit and (lengths > 0).sum() == (all_counts > 0).sum()
    assert sum(2.0 ** -int(x) for x in lengths[lengths > 0]) <= 1
    n = np.array(sizes)
    bits, payload = token_files.encode(ids, n, lengths, token_files.canonical(lengths))
    out = token_files.decode(payload, bits, token_files.block_ends(n)[1], token_files.decode_table(lengths, limit), limit)
    assert (out == ids).all()


def test_code_lengths_are_optimal_where_the_limit_does_not_bind():
    import heapq

    counts = np.array([5, 9, 12, 13, 16, 45, 0, 1])
    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        total += a + b
        heapq.heappush(heap, a + b)
    assert int((token_files.code_lengths(counts) * counts).sum()) == total
    with pytest.raises(ValueError):
        token_files.code_lengths(np.ones(9, np.int64), 3)


def test_plan_fills_sequences_under_every_constraint():
    rng = np.random.default_rng(5)
    for limits in (packing.Limits(64, 64, 64 * 64), packing.Limits(64, 3, 64 * 64), packing.Limits(64, 64, 2000), packing.Limits(64, 64, 64 * 64, rule="dot")):
        most = int(min(64, limits.attention**0.5))
        counts = {int(k): int(v) for k, v in zip(range(1, most + 1), rng.integers(0, 200, most)) if v}
        runs = packing.plan(counts, limits)
        held, seen = {}, {n: [] for n in counts}
        for length, item, n, seq, offset in runs.tolist():
            for j in range(n):
                held.setdefault(seq + j, []).append((offset, length))
                seen[length].append(item + j)
        assert all(sorted(v) == list(range(counts[k])) for k, v in seen.items())
        for places in held.values():
            places.sort()
            ends = 0
            for offset, length in places:
                assert offset == ends
                ends += length
            assert ends <= limits.tokens and len(places) <= limits.documents and sum(n * n for _, n in places) <= limits.attention
        if limits.documents == 64 and limits.attention == 64 * 64:
            # no packing can do with fewer: items over 64 - k stand alone, those over 32 apart, the rest fills up
            total = lambda a, b: sum(n * c for n, c in counts.items() if a < n <= b)
            many = lambda a, b: sum(c for n, c in counts.items() if a < n <= b)
            least = max(many(64 - k, 64) + many(32, 64 - k) + max(0, -(-(total(k - 1, 32) - (64 * many(32, 64 - k) - total(32, 64 - k))) // 64)) for k in range(33))
            assert least <= len(held) <= 1.01 * least + 1
    with pytest.raises(ValueError):
        packing.plan({65: 1}, packing.Limits(64))


def test_attribute_by_majority():
    ends, starts, stops = np.array([4, 8, 12, 20]), np.array([0, 6, 11]), np.array([6, 10, 13])
    where, crosses = token_counts.attribute(ends, starts, stops)
    assert where.tolist() == [0, 0, 1, 2] and crosses.tolist() == [False, True, True, True]
    assert token_counts.attribute(np.array([], int), starts, stops)[0].tolist() == []
    assert token_counts.attribute(ends, np.array([], int), np.array([], int))[0].tolist() == [-1] * 4


def test_linked_counts_as_sets_do():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 60, 40, np.uint64)
    sets = [np.unique(np.where(rng.random(40) < 0.08, rng.integers(0, 1 << 60, 40, np.uint64), base)) for _ in range(30)]
    a, b = neardup.linked(sets, 85)
    want = {(i, j) for i in range(30) for j in range(i + 1, 30) if 100 * len(set(sets[i].tolist()) & set(sets[j].tolist())) >= 85 * len(set(sets[i].tolist()) | set(sets[j].tolist()))}
    assert set(zip(a.tolist(), b.tolist())) == want
    assert neardup.roots(5, np.array([3, 1]), np.array([4, 2])).tolist() == [0, 1, 1, 3, 3]


def test_pruning_keeps_what_is_similar_enough():
    least = neardup.least_matches(0.85)
    rng = np.random.default_rng(1)
    lost = 0
    for _ in range(4000):
        same = rng.random(neardup.HASHES) < 0.85
        matches = np.cumsum(same)
        lost += any(matches[n - 1] < m for n, m in least.items())
    assert lost == 0 and least[256] > 150


def test_tree_leaves_hold_all_points():
    rng = np.random.default_rng(2)
    points = rng.standard_normal((500, 8))
    trees = ann.fit(points, 500, ann.Forest(trees=3, leaf=20))
    for t in trees:
        assert np.bincount(t.leaf_of(points), minlength=t.leaves).sum() == 500 and t.leaves > 8
    held = [np.bincount(t.leaf_of(points), minlength=t.leaves) for t in trees]
    everything = ann.leaves_for(points[:2], trees, held, 10_000)
    assert all(len(x) == sum(t.leaves for t in trees) for x in everything)
