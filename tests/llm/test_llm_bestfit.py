"""Best-fit packing: patterns against hand-made lengths, pieces against the tokenizers library."""

import itertools
import random
from collections import Counter

import public_tokenizers
import pytest
from test_llm_tokens import ODD, crc, plain, rows, texts_of

from umbral.llm.bestfit import LENGTH, SumIndex, best_fit_pack, patterns_of

WORD = public_tokenizers.path("word_bpe_49k.json")


def used_by(patterns):
    found: Counter = Counter()
    for count, pattern in patterns:
        assert count > 0
        for length in pattern:
            found[length] += count
    return dict(found)


def best_fit(histogram, capacity):
    return patterns_of(histogram, capacity, exact=False)


def sequences(patterns):
    return sum(count for count, _ in patterns)


def test_index_counts_sums():
    rng = random.Random(1)
    lengths = sorted(rng.sample(range(1, 40), 15))
    index = SumIndex(lengths, 60)
    for _ in range(6):
        for ways, k in ((index.one, 1), (index.two, 2), (index.three, 3)):
            want = Counter(map(sum, itertools.product(lengths, repeat=k)))
            assert ways.tolist() == [want[s] for s in range(61)]
        gone = lengths.pop(rng.randrange(len(lengths)))
        index.remove(gone)


@pytest.mark.parametrize(
    ("histogram", "filled"),
    [({7: 3, 5: 3}, 3), ({6: 2, 4: 2, 2: 2}, 2), ({5: 2, 4: 2, 2: 2, 1: 2}, 2), ({6: 1, 5: 1, 4: 1, 3: 3}, 2), ({12: 2}, 2), ({6: 4}, 2), ({4: 2, 2: 2}, 1)],
)
def test_gaps_are_filled_exactly(histogram, filled):
    patterns = patterns_of(histogram, 12)
    assert sequences(patterns) == filled and all(sum(p) == 12 for _, p in patterns) and used_by(patterns) == histogram


def test_exact_complements_beat_best_fit_alone():
    histogram = {6: 10, 5: 10, 4: 10, 3: 30}
    assert sequences(patterns_of(histogram, 12)) == 20 < sequences(best_fit(histogram, 12))
    rng, ours, alone = random.Random(2), 0, 0
    for _ in range(30):
        planted: Counter = Counter()
        for _ in range(8):
            at = [0, *sorted(rng.sample(range(1, 100), rng.randrange(4))), 100]
            planted.update(b - a for a, b in zip(at, at[1:]))
        ours += sequences(patterns_of(planted, 100))
        alone += sequences(best_fit(planted, 100))
    assert 240 <= ours < alone


def test_copies_are_not_used_twice():
    for histogram in ({6: 1, 3: 1}, {6: 1, 2: 2}, {6: 2, 3: 3}, {5: 3}):
        assert used_by(patterns_of(histogram, 12)) == histogram


def test_patterns_hold_every_piece():
    rng = random.Random(5)
    for histogram in ({}, {7: 1000}, {4096: 3}, {4095: 2, 1: 1}, {1: 5}, {2049: 5, 2047: 9}, {k: rng.randrange(1, 300) for k in range(1, 4097, 5)}):  # the last has sums that leave gaps
        patterns = patterns_of(histogram, LENGTH)
        assert used_by(patterns) == histogram and all(sum(p) <= LENGTH for _, p in patterns)
        assert len(patterns) <= 8 * len(histogram) + 2
        assert sequences(patterns) <= sequences(best_fit(histogram, LENGTH)) * 1.005
    for _ in range(200):
        histogram = {rng.randrange(1, 30): rng.randrange(1, 9) for _ in range(rng.randrange(1, 9))}
        patterns = patterns_of(histogram, 30)
        assert used_by(patterns) == histogram and all(sum(p) <= 30 for _, p in patterns)


def test_best_fit_takes_the_fullest():
    assert sorted(p for _, p in best_fit({6: 1, 7: 1, 3: 1}, 10)) == [(6,), (7, 3)]
    assert sequences(best_fit({3: 7}, 10)) == 3


def test_pieces(spark):
    texts = ODD + texts_of(400, 4) + ["lorem ipsum dolor " * 4000, "x y " * 3000, "z " * 4095, "z " * 4096] + ["copy of a text"] * 50
    ids = list(range(len(texts)))
    want = dict(zip(ids, plain(WORD, texts)))
    got = best_fit_pack(rows(spark, texts, ids).repartition(5), WORD).collect()
    places: dict = {}
    per_doc: dict = {}
    for r in got:
        own = want[r["doc_id"]]
        assert r["ids_crc32"] == crc(own[r["start"] : r["start"] + r["length"]]) and r["start"] == r["piece"] * LENGTH
        per_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert per_doc.keys() == want.keys()
    for doc, parts in per_doc.items():
        assert sorted(parts) == [(s, min(LENGTH, len(want[doc]) - s)) for s in range(0, len(want[doc]), LENGTH)]
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= LENGTH
    assert len(places) == -(-sum(map(len, want.values())) // LENGTH)


def test_odd_rows(spark):
    assert best_fit_pack(rows(spark, []), WORD).collect() == []
    got = best_fit_pack(rows(spark, ["b", "a", "a", None], [5, None, 5, 5]), WORD).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in got) == [(0, 2), (5, 1), (5, 2), (5, 2)]
    assert len({r["sequence_id"] for r in got}) == 1 and sorted(r["offset"] for r in got)[0] == 0
