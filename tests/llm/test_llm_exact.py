"""Exact dedup against a dictionary."""

import hashlib
import random

from umbral.llm.exact import UPPER, LOWER, digest_table, drop_exact, exact_groups, merge_runs

LOWERED = str.maketrans(UPPER, LOWER)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, keep_id string, tie int").repartition(7)


def brute(rows):
    groups: dict = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOWERED), []).append(i)
    return sorted(
        (i, max(groups[n := (t or "").translate(LOWERED)]), len(groups[n]), i == max(groups[n]), hashlib.sha256(n.encode()).hexdigest()) for i, t in rows
    )


def test_groups(spark):
    rng = random.Random(1)
    texts = ["", None, "Ä", "ä", "abc", "ABC", "aBc ", "x" * 200_000, "İ"] + [str(rng.randrange(40)) for _ in range(300)]
    rows = list(enumerate(texts + ["hot"] * 500))
    assert sorted(map(tuple, exact_groups(frame(spark, rows)).collect())) == brute(rows)
    assert sorted((r["doc_id"], r["text"]) for r in drop_exact(frame(spark, rows)).collect()) == sorted((i, dict(rows)[i]) for i, _, _, kept, _ in brute(rows) if kept)


def test_tree_of_several_rounds(spark):
    rows = [(i, str(i % 50)) for i in range(2000)]
    digests = digest_table(frame(spark, rows).repartition(40))
    got = merge_runs(digests, fan_in=3, ranges=5).collect()
    assert sorted((r["keep_id"], r["group_size"]) for r in got) == [(1950 + i, 40) for i in range(50)]


def test_null_ids_and_repeated_rows(spark):
    df = frame(spark, [(None, "a"), (3, "a"), (3, "a"), (None, "b"), (None, "b"), (4, "A")])
    got = sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["kept"]) for r in exact_groups(df).collect())
    assert got == [(0, 0, 2, False), (0, 0, 2, True), (0, 4, 4, False), (3, 4, 4, False), (3, 4, 4, False), (4, 4, 4, True)]
    out = drop_exact(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in out.collect()) == [(0, "b"), (4, "A")]


def test_empty(spark):
    assert exact_groups(frame(spark, [])).collect() == []
    assert drop_exact(frame(spark, [])).collect() == []


def test_more_rows_than_an_arrow_batch(spark):
    rows = spark.range(60_000).selectExpr("id doc_id", "cast(id % 25001 as string) text").coalesce(2)
    got = exact_groups(rows).selectExpr("sum(group_size)", "sum(cast(kept as int))", "max(group_size)", "count(*)").collect()[0]
    assert tuple(got) == (sum(((60_000 - 1 - r) // 25001 + 1) ** 2 for r in range(25001)), 25001, 3, 60_000)
