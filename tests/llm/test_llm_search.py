"""Exact top-k search against numpy."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from umbral.llm import topk
from umbral.llm.topk import top_k

SCHEMA = "vec_id long, embedding array<float>, part string, v int"


def brute(rows, k=5):
    good = sorted({(i, tuple(math.floor(256.0 * float(np.float32(x))) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    out = []
    for i, v in good:
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i and len(w) == len(v))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def search(spark, rows):
    df = spark.createDataFrame([(i, v, "p", 1) for i, v in rows], SCHEMA).repartition(5)
    return sorted(map(tuple, top_k(df, F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id", "score").collect()))


def test_random_ties_and_copies(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(700)]
    rows += [(700 + i, rows[3][1]) for i in range(300)]  # a very common vector
    rows += [(1000 + i, [float(x) for x in rng.integers(-1, 2, 8)]) for i in range(300)]  # ties
    random.Random(2).shuffle(rows)
    assert search(spark, rows) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, None), (100, [nan, 1.0]), (150, [1.0, None]), (None, [1.0, 1.0]), (1, [0.5, -inf]), (2, [3.0, 1.0]), (3, [-1.0, 0.25]), (3, [-1.0, 0.25]), (200, [2.0]), (4, []), (250, [0.0, 0.0])]
    assert search(spark, rows) == brute(rows)
    assert search(spark, []) == []
    assert search(spark, [(0, [1.0])]) == []


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = sorted(map(tuple, top_k(df, F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == brute(rows)


def test_each_block_goes_to_a_task_once(spark, monkeypatch):
    """Blocks are not joined to copies of the query blocks, which a broadcast or a worker's batch could not hold."""
    plans, rng = [], np.random.default_rng(5)
    kept = topk.materialise

    def watched(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        if df.columns == ["query_id", "vec_id", "low", "high"]:
            plans.append(plan)
        return kept(df)

    monkeypatch.setattr(topk, "materialise", watched)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 64)
    monkeypatch.setattr(topk, "QUERY_ROWS", 7)
    monkeypatch.setattr(topk, "HELD_ROWS", 50)  # results of a block of queries in several batches
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 3 + i % 2)]) for i in range(1500)]
    rows += [(2000 + i, [float(x) for x in rng.normal(0, 90.0, 3)]) for i in range(200)]  # components of more than two bytes
    assert search(spark, rows) == brute(rows)
    assert len(plans) == 1 and "Join" not in plans[0]


def test_blocks_of_queries_are_as_narrow_as_they_can_be(spark):
    for top, size in ((5, 1), (300, 2), (70_000, 4), (1 << 40, 8)):
        rows = spark.createDataFrame([(1, [1, -top]), (2, [0, 2])], "vec_id long, v array<long>").coalesce(1)
        (block,) = rows.mapInArrow(topk._blocks(1, 10, None), topk.BLOCK).collect()
        assert np.frombuffer(block["data"], f"<i{size}").tolist() == [1, -top, 0, 2]
