"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from umbral.llm import spelling
from umbral.llm.spelling import KdTree, Steps, counts_of, letters_of, near_pairs, one_more, spelling_forms

SCHEMA = "doc_id long, text string, word string, n int, form string"


def words_of(rows):
    found: Counter = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def edits(word, letters):
    """All words one edit away."""
    out = set()
    for i in range(len(word) + 1):
        out.update(word[:i] + c + word[i:] for c in letters)
        if i < len(word):
            out.add(word[:i] + word[i + 1 :])
            out.update(word[:i] + c + word[i + 1 :] for c in letters)
    return out - {word}


def brute(rows):
    n = words_of(rows)
    letters = {c for w in n for c in w}
    near = {w: edits(w, letters) & n.keys() for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def forms(spark, rows):
    df = spark.createDataFrame([(i, t, "w", 1, "f") for i, t in rows], SCHEMA).repartition(5)
    return sorted(tuple(r) for r in spelling_forms(df).select("word", "form", "root", "n", "n_near", "form_n").collect())


def made_up(n, seed, alphabet="abcdeé", most=9):
    """Texts of words and their variants, some far more frequent than others."""
    rng = random.Random(seed)
    roots = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(5, most))) for _ in range(60)]
    pool = list(roots)
    for _ in range(300):
        w = rng.choice(pool)
        pool.append(rng.choice(sorted(edits(w, alphabet))))
    weights = [1 / (i + 1) for i in range(len(pool))]
    return [(i, " ".join(rng.choices(pool, weights, k=rng.randrange(1, 120)))) for i in range(n)]


def test_words_and_links(spark):
    rows = made_up(400, 1)
    want = brute(rows)
    assert any(r[1] for r in want) and any(r[1] != r[2] for r in want if r[1])
    assert forms(spark, rows) == want


def test_small_boxes_and_blocks(spark, monkeypatch):
    """The cluster's paths on few words: many boxes of a length, and boxes of several blocks."""
    for name, value in (("BOX", 8), ("BLOCK", 3), ("SAMPLE", 120), ("SAMPLE_BOX", 4), ("LEAF", 2)):
        monkeypatch.setattr(spelling, name, value)
    rows = made_up(300, 2)
    assert forms(spark, rows) == brute(rows)


def test_odd_rows(spark):
    long = "ab" * 5000
    rows = [(1, None), (2, ""), (None, "hello hello hello"), (None, "hello hello hello"), (3, "hell hellos Écoles écoles ÉCOLES"), (4, "×÷×÷× 1 HELLOS hellOs, hellos")]
    rows += [(5, f"{long} {long}b"), (5, f"{long} {long}b"), (6, f"{long} {long}b a{long[2:]}"), (7, "x" * 30 + "1abcde_abcde.abcde")]
    assert forms(spark, rows) == brute(rows)
    assert forms(spark, []) == []
    assert forms(spark, [(1, "a b c")]) == []


def test_anagrams_share_a_box(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK", 16)
    rng = random.Random(3)
    words = {"".join(rng.sample("aabbccdd", 8)) for _ in range(300)}
    rows = [(i, " ".join(words)) for i in range(8)]
    assert forms(spark, rows) == brute(rows)


def test_given_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in spelling_forms(df).select("word", "form", "root", "n", "n_near", "form_n").collect())
    assert got == brute(rows)


@pytest.mark.parametrize("longer", [0, 1])
def test_tree_prunes_and_loses_nothing(longer):
    rng = np.random.default_rng(4)
    own = ["".join(w) for w in rng.choice(list("abcdefgh"), (1500, 6))]
    asked = [w[:3] + "c" * longer + w[3:] for w in own[:700]]
    letters, own_letters = letters_of(own), letters_of(asked)
    points, own_points = counts_of(letters), counts_of(own_letters)
    tree = KdTree(points, 16)
    assert sorted(i for leaf in tree.leaves for i in leaf.tolist()) == list(range(1500))
    reach = 1 if longer else 2
    looked_at = sum(len(rows) * len(tree.leaves[leaf]) for leaf, rows in tree.within(own_points, reach))
    assert looked_at < 700 * 1500 / 3
    steps = Steps(points)
    got = sorted((int(q), int(p)) for a, b in near_pairs(tree, steps, steps.of(points), letters, own_points, own_letters) for q, p in zip(a, b))
    want = sorted((q, p) for q, w in enumerate(asked) for p, v in enumerate(own) if (v in {w[:i] + w[i + 1 :] for i in range(7)} if longer else sum(x != y for x, y in zip(w, v)) == 1))
    assert got == want


def test_one_letter_more():
    pairs = [("abcde", "abcd"), ("abcde", "bcde"), ("aabcd", "abcd"), ("abxcd", "abcd"), ("abcde", "abdc"), ("aaaaa", "aaaa"), ("abcab", "abca"), ("bacde", "abcd")]
    a, b = letters_of([x for x, _ in pairs]), letters_of([y for _, y in pairs])
    assert one_more(a, b).tolist() == [any(x[:i] + x[i + 1 :] == y for i in range(5)) for x, y in pairs]
