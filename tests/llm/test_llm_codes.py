"""Vector codes against plain loops, and the bounds that spare distances."""

import hashlib
import math
import random

import numpy as np
import pytest

from umbral.llm.codes import assign, code_digest, own_distances, part_ends, squared_distances

SCHEMA = "vec_id long, embedding array<float>, label int, code string, v int"


def brute(rows, parts=4, entries=256, rounds=4):
    """All distances of all rounds in whole numbers; rows: (id, vector, label)."""
    good = []
    for i, v, label in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, [max(min(math.floor(1024.0 * float(np.float32(x))), 1 << 24), -(1 << 24)) for x in v], label))
    out, totals = [], {}
    for dim in sorted({len(v) for _, v, _ in good}):
        own = sorted((r for r in good if len(r[1]) == dim), key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], "<i4").tobytes()))
        ends = part_ends(dim, parts)
        cuts = list(zip([0, *ends], ends))
        books = [[tuple(v[a:b]) for _, v, _ in own[:entries]] for a, b in cuts]

        def nearest(p, x):
            return min((sum((y - z) ** 2 for y, z in zip(x, e)), j) for j, e in enumerate(books[p]))

        for _ in range(rounds):
            for p, (a, b) in enumerate(cuts):
                members: dict = {}
                for _, v, _ in own:
                    members.setdefault(nearest(p, v[a:b])[1], []).append(v[a:b])
                for j, found in members.items():
                    books[p][j] = tuple(sum(c) // len(found) for c in zip(*found))
        digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
        for i, v, label in own:
            found = [nearest(p, v[a:b]) for p, (a, b) in enumerate(cuts)]
            error = sum(d for d, _ in found)
            totals[label] = totals.get(label, 0) + error
            out.append((i, "".join(f"{j:02x}" for _, j in found), error, label, digest))
    return sorted(((i, c, e, totals[label], d) for i, c, e, label, d in out), key=str)


def coded(spark, rows, **args):
    df = spark.createDataFrame([(i, v, label, "c", 1) for i, v, label in rows], SCHEMA).repartition(5)
    return sorted((tuple(r) for r in code_digest(df, **args).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def test_against_all_distances(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8)], i % 3) for i in range(250)]
    rows += [(1000 + i, rows[3][1], None) for i in range(120)]  # a very common vector
    rows += [(2000 + i, [float(x) for x in rng.integers(-1, 2, 8)], 7) for i in range(130)]  # ties
    random.Random(2).shuffle(rows)
    assert coded(spark, rows, entries=40) == brute(rows, entries=40)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0, 3.0, 4.0, 5.0], 1), (50, None, 1), (100, [nan, 1.0], 2), (150, [1.0, None], 2), (None, [1.0, 1.0], 2), (1, [0.5, -inf], 3)]
    rows += [(2, [3.0, 1.0], None), (3, [-1.0, 0.25], None), (3, [-1.0, 0.25], None), (200, [2.0], 1), (4, [], 9), (250, [3e38, -3e38], 4)]
    assert coded(spark, rows) == brute(rows)
    assert coded(spark, []) == []


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").limit(300)
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    assert coded(spark, rows, entries=64, rounds=2) == brute(rows, entries=64, rounds=2)


def refine(points, book, code):
    out = book.copy()
    for j in np.unique(code):
        out[j] = points[code == j].sum(axis=0) // (code == j).sum()
    return out


@pytest.mark.parametrize("seed", range(4))
def test_bounds_spare_distances_and_change_nothing(seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-4000, 4000, (100, 6))
    points = centres[rng.integers(0, 100, 4000)] + rng.integers(-30, 31, (4000, 6))
    history = [points[:100].copy() if seed else rng.permutation(centres) + 25]
    state, full, computed = None, 0, []
    for turn in range(6):
        *state, counted = assign(points, history, None if state is None else tuple(state))
        found = squared_distances(points, history[-1])
        assert state[0].tolist() == found.argmin(axis=1).tolist()
        for at in range(turn + 1):  # distances are those of their stamp's round
            rows = state[2] == at
            assert state[1][rows].tolist() == own_distances(points[rows], history[at][state[0][rows]]).tolist()
        # every bound holds for the codebook of its stamp's round, carried to this one
        moved = [np.sqrt(own_distances(history[-1], b).astype(float)) for b in history]
        for g in range(state[3].shape[1]):
            near = np.sqrt(found[:, 32 * g : 32 * g + 32].astype(float))
            inside = (state[0] // 32) == g
            near[inside, state[0][inside] % 32] = np.inf
            carried = state[3][:, g] - np.stack(moved)[:, 32 * g : 32 * g + 32].max(axis=1)[state[4][:, g]]
            assert (carried <= near.min(axis=1) + 1e-6).all()
        computed.append(counted)
        full += found.size
        history.append(refine(points, history[-1], state[0]))
    assert computed[0] == 4000 * 100 and computed[-1] < 4000 * 100 / 4
    assert sum(computed) < full / 2


def test_net_displacement_is_tighter_than_drift():
    """An entry that comes back leaves its old bounds whole: nothing is computed again."""
    points = np.array([[0, 0], [1, 0], [100, 0], [101, 0]])
    book = np.array([[0, 0], [100, 0]])
    away = np.array([[60, 0], [40, 0]])
    *state, _ = assign(points, [book], None)
    *state, counted = assign(points, [book, book, book], tuple(state))
    assert counted == 0 and state[0].tolist() == [0, 0, 1, 1]
    *state, _ = assign(points, [book], None)
    *state, counted = assign(points, [book, away, book], tuple(state))
    assert counted == 0 and state[2].tolist() == [0, 0, 0, 0]


def test_large_numbers_stay_exact():
    rng = np.random.default_rng(3)
    points, entries = (rng.integers(-(1 << 24), 1 << 24, (n, 16)) for n in (50, 9))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, e)) for e in entries] for p in points]
    assert squared_distances(points, entries).tolist() == want
    assert squared_distances(points >> 4, entries >> 4).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, e)) for e in entries >> 4] for p in points >> 4]
