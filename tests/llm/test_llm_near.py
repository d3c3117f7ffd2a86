"""Near-duplicates against all pairs, signatures against exact similarity."""

import random
from collections import Counter

import numpy as np

from umbral.llm import near
from umbral.llm.components import components
from umbral.llm.near import Hashes, bags, drop_near, near_groups, signatures

SCHEMA = "doc_id long, text string, root string, node int"


def bag(text, words=5):
    w = (text or "").lower().split()
    return Counter([tuple(w)] if 0 < len(w) < words else [tuple(w[i : i + words]) for i in range(len(w) - words + 1)])


def similarity(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute(rows):
    found = [bag(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if found[i] and found[j] and similarity(found[i], found[j]) >= 0.8:
                root[find(i)] = find(j)
    classes = {}
    for i in range(len(rows)):
        classes.setdefault(find(i), []).append(rows[i][0])
    return sorted((rows[i][0], min(classes[find(i)]), len(classes[find(i)]), rows[i][0] == min(classes[find(i)])) for i in range(len(rows)))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "r", 3) for i, t in rows], SCHEMA).repartition(6)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = ["", None, "one", "One", "two words", "a b c d", "a b c d e", "A b  c\nd e", "spam " * 400, "spam " * 420, "spam " * 900]
    for _ in range(40):
        base = [word() for _ in range(rng.randrange(30, 300))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(0, 5)):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 40))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    chain = [word() for _ in range(200)]
    for i in range(25):  # neighbours are similar, ends are not
        texts.append(" ".join(chain))
        chain[(i * 8) % 200] = word()
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_classes(spark):
    rows = corpus(1)
    got = near_groups(frame(spark, rows)).select("doc_id", "class_id", "class_size", "kept").collect()
    assert sorted(map(tuple, got)) == brute(rows)
    left = drop_near(frame(spark, rows))
    assert left.columns == frame(spark, rows).columns
    assert sorted(r["doc_id"] for r in left.collect()) == [i for i, _, _, kept in brute(rows) if kept]


def test_star_of_copies(spark):
    rng = random.Random(3)
    base = [str(rng.randrange(10**6)) for _ in range(100)]
    rows = [(i, " ".join(base[: i % 99] + ["x%d" % i, "y%d" % i] + base[i % 99 + 2 :])) for i in range(300)] + [(999, " ".join(base))]
    got = near_groups(frame(spark, rows)).select("doc_id", "class_id", "class_size", "kept").collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_repeated_rows_and_null_ids(spark):
    a, b = "a b c d e f g", "h i j k l m n"
    got = near_groups(frame(spark, [(None, a), (7, a), (7, a), (9, a), (None, b), (7, b)])).collect()
    assert sum(r["kept"] for r in got) == 2 and {r["class_size"] for r in got} == {4, 2}
    left = drop_near(frame(spark, [(None, a), (7, a), (7, a), (9, a), (None, b), (7, b), (None, None)])).collect()
    assert sorted(str((r["doc_id"], r["text"])) for r in left) == sorted(map(str, [(7, a), (7, b), (None, None)]))
    assert near_groups(frame(spark, [])).collect() == []


def test_signatures_estimate_similarity():
    rng = random.Random(5)
    words = ["w%d" % i for i in range(60)]
    texts = []
    for _ in range(12):
        t = []
        for w in rng.sample(words, 20):
            t += [w] * rng.choice([1, 1, 2, 5, 40])
        texts.append(" ".join(t))
    doc, shingle, count = bags(texts, Hashes(), words=1)
    signed = signatures(doc, shingle, count, len(texts), 4096)
    for i in range(len(texts)):
        for j in range(i):
            exact = similarity(bag(texts[i], 1), bag(texts[j], 1))
            assert abs((signed[i] == signed[j]).mean() - exact) < 0.045


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000)]
    root = {x: x for e in edges for x in e}
    for _ in range(len(root)):
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
        if not changed:
            break
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: r for x, r in root.items() if x != r}


def test_blocks_do_not_follow_partitions(spark, monkeypatch):
    """Blocks are as full as their bounds allow at any number of partitions, so that few pairs of them meet."""
    monkeypatch.setattr(near, "BLOCK_ROWS", 10)
    monkeypatch.setattr(near, "BLOCK_BYTES", 1000)
    rows = spark.createDataFrame([(i, i % 3, i // 40, "x" * (2000 if i == 57 else 5)) for i in range(100)], "node long, root long, place long, text string")
    out = [r.asDict() for r in near.blocks_of(rows.repartition(50)).collect()]
    assert sorted(n for r in out for n in r["nodes"]) == list(range(100)) and len({r["block"] for r in out}) == len(out)
    assert all(len(r["nodes"]) <= 10 for r in out) and len(out) <= 12
    for r in out:
        assert r["roots"] == [n % 3 for n in r["nodes"]] and [len(t) for t in r["texts"]] == [2000 if n == 57 else 5 for n in r["nodes"]]
        assert max(r["nodes"]) - min(r["nodes"]) < 10
