"""Two-level order steps against single-machine results, with ranges small enough to be cut often."""

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from umbral.operators import masspoints as M
from umbral.operators import ordering as O
from umbral.operators import ranking as R


def frame(spark, n=2000, seed=3):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"k": np.where(rng.uniform(size=n) < 0.4, 0, rng.integers(1, 30, n)), "v": np.round(rng.normal(size=n), 2), "id": range(n)})
    return pdf, spark.createDataFrame(pdf).repartition(5)


def test_running_sums(spark):
    pdf, df = frame(spark)
    for reverse in (False, True):
        out = O.running_sums(df, ["k"], ["v", "id"], {"s": F.col("v"), "i": F.lit(1)}, reverse=reverse, buckets=16).toPandas()
        want = pdf.sort_values(["v", "id"], ascending=not reverse)
        want["s"], want["i"] = want.groupby("k").v.cumsum(), want.groupby("k").cumcount() + 1
        both = out.merge(want, on="id", suffixes=("", "_w"))
        assert len(both) == len(pdf)
        assert np.allclose(both.s, both.s_w) and (both.i == both.i_w).all()


def test_large_and_medium_groups_are_cut_alike(spark):
    pdf, df = frame(spark, 6000)
    sizes = O.range_buckets(df, ["k"], ["v", "id"], buckets=16).groupBy("_bucket", F.col("_group.k").alias("k")).count().toPandas()
    assert (sizes[sizes.k == 0]["_bucket"].nunique()) > 4
    assert sizes.groupby("_bucket")["count"].sum().max() < 2.5 * len(pdf) / 16


def test_many_medium_groups_have_bounded_ranges(spark):
    df = spark.range(40_000).selectExpr("id % 20 as k", "id as v")
    sizes = O.range_buckets(df, ["k"], ["v"], buckets=100).groupBy("_bucket", "_group").count().toPandas()
    assert sizes["count"].max() < 1000 and len(sizes) >= 100


def test_row_ids(spark):
    pdf, df = frame(spark)
    out = O.add_row_id(df, "rid", ["v", "id"], buckets=7).toPandas().sort_values("rid")
    assert out.rid.tolist() == list(range(1, len(pdf) + 1))
    assert out.id.tolist() == pdf.sort_values(["v", "id"]).id.tolist()


def test_ecdf(spark):
    pdf, df = frame(spark)
    out = O.ecdf(df, "v", ["k"], buckets=7).toPandas()
    for r in out.sample(40, random_state=1).itertuples():
        g = pdf[pdf.k == r.k].v
        assert np.isclose(r.share, (g <= r.v).mean())


def test_nearest(spark):
    rng = np.random.default_rng(1)
    t = pd.DataFrame({"k": np.where(rng.uniform(size=600) < 0.5, 0, rng.integers(1, 9, 600)), "v": rng.integers(0, 5000, 600).astype(float)}).drop_duplicates()
    p = pd.DataFrame({"k": np.where(rng.uniform(size=400) < 0.5, 0, rng.integers(1, 12, 400)), "v": rng.integers(-50, 5050, 400).astype(float)}).drop_duplicates()
    t["name"] = [f"t{i}" for i in range(len(t))]
    out = O.nearest_by_key(spark.createDataFrame(p), spark.createDataFrame(t), ["k"], "v", ["name"], buckets=16).toPandas()
    best = out.assign(d=(out.target_value - out.v).abs()).groupby(["k", "v"]).d.min()
    for r in p.itertuples():
        near = t[t.k == r.k].v
        if len(near) == 0:
            assert (r.k, r.v) not in best.index
        else:
            assert best[(r.k, r.v)] == (near - r.v).abs().min()


def test_neighbours_cross_blocks(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"spec": "a", "x": np.round(rng.normal(size=300), 2), "y": rng.normal(size=300)})
    pts, _ = M.prepare(spark.createDataFrame(pdf), ["y"], [], ["spec"], block=7, buckets=7)
    pts = pts.toPandas().sort_values("x").reset_index(drop=True)
    assert (pts["rank"] == np.arange(1, len(pts) + 1)).all()
    near = np.stack(pts["near"]).reshape(len(pts), 6, 3)
    own = pd.Series([v[0] for v in pts["s"]])
    for j in (1, 2, 3):
        assert np.allclose(near[:, j - 1, 0], pts.x.shift(j).values, equal_nan=True)
        assert np.allclose(near[:, 2 + j, 2], own.shift(-j).values, equal_nan=True)


def test_mass_points_are_dealt_out_by_their_number(spark):
    """A task holds a bounded number of points, ranges may be shorter than the rim, and a point of one row keeps no products."""
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"spec": rng.choice(["a", "b"], 500, p=[0.97, 0.03]), "x": np.round(rng.normal(size=500), 3), "y": rng.normal(size=500)})
    pdf = pd.concat([pdf, pdf.iloc[:40].assign(y=1.0)])
    pts, _ = M.prepare(spark.createDataFrame(pdf), ["y"], [], ["spec"], block=5)
    per_file = pts.groupBy(F.input_file_name()).count().toPandas()["count"]
    assert len(per_file) > 30 and per_file.max() < 60
    pts = pts.toPandas().sort_values(["spec", "x"])
    for spec, own in pdf.groupby("spec"):
        got = pts[pts.spec == spec].reset_index(drop=True)
        want = own.groupby("x").y.agg(["size", "sum", lambda v: (v**2).sum()]).reset_index()
        assert (got.x == want.x).all() and (got.n == want["size"]).all() and (got.cum_n == want["size"].cumsum()).all()
        assert (got["rank"] == np.arange(1, len(got) + 1)).all()
        near = np.stack(got["near"]).reshape(len(got), 6, 3)
        for j in (1, 2, 3):
            assert np.allclose(near[:, j - 1, 0], got.x.shift(j), equal_nan=True) and np.allclose(near[:, 2 + j, 2], want["sum"].shift(-j), equal_nan=True)
        assert (got.q.isna() == (got.n == 1)).all()
        kept = got.q.notna().to_numpy()
        q = M.all_products(np.stack(got.s), np.array(got.q[kept].tolist()).reshape(-1, 1), kept, [(0, 0)])
        assert np.allclose(q[:, 0], want.iloc[:, 3])


def test_first_per_key_limits_before_the_shuffle(spark):
    _, df = frame(spark)
    plan = R.first_per_key(df, ["k"], ["v", "id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_ranges_carry_their_keys_once(spark):
    """Keys are shuffled and written inside ``_group`` only, and are columns again afterwards."""
    df = spark.createDataFrame([("a", 2.0, 1), ("a", 1.0, 2), (None, 3.0, 3)], "k string, v double, n int")
    out = O.range_buckets(df, ["k"], ["v"], 2)
    assert out.columns == ["k", "v", "n", "_group", "_bucket"]
    assert sorted((r.k or "", r.v, r.n, r._group.k or "") for r in out.collect()) == [("", 3.0, 3, ""), ("a", 1.0, 2, "a"), ("a", 2.0, 1, "a")]
    (scan,) = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Relation" in x]
    assert scan.split("[")[1].startswith("v#")


def test_nearest_by_key_is_not_quadratic_and_ranks(spark):
    """A key of many rows: running frames only, and one row per probe where a rank is given."""
    rng = np.random.default_rng(3)
    targets = sorted(set(rng.integers(0, 10**9, 40_000).tolist()))
    probes = sorted(set(rng.integers(0, 10**9, 40_000).tolist()) | set(targets[:100]))
    t = spark.createDataFrame([("k", v, i) for i, v in enumerate(targets)] + [("x", 5, 0), (None, 7, 1)], "k string, v long, n int")
    p = spark.createDataFrame([("k", v) for v in probes] + [("y", 5), ("x", 9), (None, 7)], "k string, v long")
    out = O.nearest_by_key(p, t, ["k"], "v", ["n"], buckets=3)
    assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    got = {}
    for r in out.collect():
        got.setdefault((r["k"], r["v"]), set()).add((r["target_value"], r["n"]))
    want = {("x", 9): {(5, 0)}, (None, 7): {(7, 1)}}
    for v in probes:
        i = bisect.bisect_right(targets, v)
        want["k", v] = {(targets[j], j) for j in (i - 1, i) if 0 <= j < len(targets)}
    assert got == want
    one = O.nearest_by_key(p, t, ["k"], "v", ["n"], lambda t, v: F.struct(F.abs(t["v"] - v), -t["n"]), buckets=3).collect()
    assert {(r["k"], r["v"]): (r["target_value"], r["n"]) for r in one} == {
        (k, v): min(found, key=lambda f: (abs(f[0] - v), -f[1])) for (k, v), found in want.items()}
    assert len(one) == len(want)
