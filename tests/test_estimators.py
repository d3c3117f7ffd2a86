"""Estimators against independent numpy code."""

import density_reference
import numpy as np
import pandas as pd
import pytest
import rd_reference
from pyspark.sql import functions as F

from umbral.functions.distributions import p_normal, p_student
from umbral.operators import density as D
from umbral.operators import rd as R
from umbral.operators import regression as E


def test_distributions():
    assert abs(p_normal(1.959963984540054) - 0.05) < 1e-12
    for t in (0.0, 0.3, 1.0, 4.0, 50.0):
        assert abs(p_student(t, 1) - (1 - 2 / np.pi * np.arctan(t))) < 1e-12
        assert abs(p_student(-t, 2) - (1 - t / np.sqrt(2 + t * t))) < 1e-12
    assert abs(p_student(2.228138852, 10) - 0.05) < 1e-9 and abs(p_student(1.7, 1e7) - p_normal(1.7)) < 1e-6


def test_ols_with_interaction(spark):
    rng = np.random.default_rng(0)
    n = 400
    a, b, g = rng.normal(size=n), rng.normal(size=n) + 5, rng.integers(0, 2, n)
    y = 1 + 2 * a - b + 0.5 * a * b + rng.normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "y": y, "g": g}))
    out = E.ols(df, "y", ["a", "b", ("a", "b")], ["g"]).toPandas()
    for group in (0, 1):
        m = g == group
        x = np.column_stack([np.ones(m.sum()), a[m], b[m], a[m] * b[m]])
        beta = np.linalg.solve(x.T @ x, x.T @ y[m])
        s2 = ((y[m] - x @ beta) ** 2).sum() / (m.sum() - 4)
        v = s2 * np.linalg.inv(x.T @ x)
        got = out[out.g == group].set_index("term").loc[["(Intercept)", "a", "b", "a:b"]]
        assert np.allclose(got.estimate, beta) and np.allclose(got.se, np.sqrt(np.diag(v)))
        assert np.allclose(np.vstack(got.vcov), v)


def test_two_stage_least_squares(spark):
    rng = np.random.default_rng(1)
    n = 500
    z, x = rng.integers(0, 2, n).astype(float), rng.normal(size=n)
    u = rng.normal(size=n)
    d = (0.8 * z + 0.3 * u + rng.normal(size=n) > 0.5).astype(float)
    y = 1 + 2 * d + 0.5 * x + u * (1 + 0.5 * np.abs(x))
    got = E.iv_2sls(spark.createDataFrame(pd.DataFrame({"z": z, "x": x, "d": d, "y": y})), "y", "d", ["x"], "z").first()
    one = np.ones(n)
    zz, xx = np.column_stack([one, x, z]), np.column_stack([one, x, d])
    beta = np.linalg.solve(zz.T @ xx, zz.T @ y)
    xh = zz @ np.linalg.solve(zz.T @ zz, zz.T @ xx)
    bread = np.linalg.inv(xh.T @ xh)
    lev = np.einsum("ij,jk,ik->i", xh, bread, xh)
    e = y - xx @ beta
    v = bread @ (xh.T @ (xh * (e**2 / (1 - lev))[:, None])) @ bread
    assert abs(got.coeff - beta[2]) < 1e-9 and abs(got.se - np.sqrt(v[2, 2])) < 1e-9


def test_welch(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(1, 2, 30), rng.normal(0, 1, 50)
    pdf = pd.DataFrame({"g": ["a"] * 30 + ["b"] * 50, "v": np.concatenate([a, b])})
    got = E.welch_t(spark.createDataFrame(pdf), "g", ["v"], ("b", "a")).first()
    q = [s.var(ddof=1) / len(s) for s in (a, b)]
    t = (a.mean() - b.mean()) / np.sqrt(sum(q))
    df = sum(q) ** 2 / (q[0] ** 2 / 29 + q[1] ** 2 / 49)
    assert np.allclose([got.t, got["df"], got.p_value], [t, df, p_student(t, df)])


def rd_data(ties, n=600):
    rng = np.random.default_rng(5)
    x = rng.uniform(-10, 10, n)
    x = np.round(x, 1) if ties else x
    z = rng.normal(size=(n, 2))
    t = ((x >= 0) & (rng.uniform(size=n) < 0.8) | (rng.uniform(size=n) < 0.1)).astype(float)
    y = 1 + 0.3 * x - 0.02 * x**2 + 2 * t + z @ [0.5, -1] + rng.normal(size=n)
    return x, y, t, z


@pytest.mark.parametrize("take_up", [None, "t"])
def test_rd_with_covariates_and_ties(spark, take_up):
    x, y, t, z = rd_data(ties=True)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "t": t, "z1": z[:, 0], "z2": z[:, 1]}))
    out = R.rd_sharp(df, "y", "x", ["z1", "z2"], take_up, multiples=(1.0, 2.0), block=37, buckets=7).toPandas()
    d = np.column_stack([y, *([t] if take_up else []), z])
    n_y = 2 if take_up else 1
    h, b = rd_reference.bandwidth(x, d, n_y)
    for multiple, hh, bb in ((1.0, h, b), (2.0, 2 * h, 2 * h)):
        o = out[out.multiple == multiple].set_index("method")
        tau, tau_bc, se, se_rb = rd_reference.rd(x, d, n_y, hh, bb)
        assert np.allclose([o.bandwidth.iloc[0], o.bias_bandwidth.iloc[0]], [hh, bb], rtol=1e-7)
        assert np.allclose(o.estimate[["conventional", "bias-corrected", "robust"]], [tau, tau_bc, tau_bc], rtol=1e-7)
        assert np.allclose(o.se[["conventional", "bias-corrected", "robust"]], [se, se, se_rb], rtol=1e-7)
        assert o.Obs.iloc[0] == len(x) and o.eff_obs.iloc[0] == (np.abs(x) < hh).sum()


def test_rd_identities(spark):
    x, y, _, z = rd_data(ties=False)
    pdf = pd.DataFrame({"x": x, "y": y, "side": (x >= 0).astype(float), "xs": x + 7})
    df = spark.createDataFrame(pdf)
    base = R.rd_sharp(df, "y", "x", h=4.0).toPandas().set_index("method")
    shifted = R.rd_sharp(df, "y", "xs", c=7.0, h=4.0).toPandas().set_index("method")
    assert np.allclose(base.estimate, shifted.estimate) and np.allclose(base.se, shifted.se)
    fuzzy = R.rd_fuzzy(df, "y", "x", "side", h=4.0).toPandas().set_index("method")
    assert np.allclose(base.estimate, fuzzy.estimate) and np.allclose(base.se, fuzzy.se)
    second = R.rd_sharp(df, "y", "x", h=4.0, p=2).toPandas().set_index("method")
    assert np.isclose(base.estimate["robust"], second.estimate["conventional"])
    assert np.isclose(base.se["robust"], second.se["conventional"])


def test_rd_drops_redundant_covariates(spark):
    x, y, t, z = rd_data(ties=True)
    pdf = pd.DataFrame({"x": x, "y": y, "t": t, "z": z[:, 0], "zero": 0.0, "one": 1.0, "twice": 2 * z[:, 0] + 1})
    pdf["left_only"] = np.where(x < 0, 0.0, pdf.z)  # 0 on the left side: the bandwidth of that side cannot use it
    df = spark.createDataFrame(pdf)
    for take_up in (None, "t"):
        base = R.rd_sharp(df, "y", "x", ["z"], take_up).toPandas()
        for covs in (["z", "zero"], ["one", "z"], ["z", "twice"], ["zero", "z", "one", "twice"]):
            out = R.rd_sharp(df, "y", "x", covs, take_up).toPandas()
            assert np.allclose(out[["estimate", "se", "bandwidth"]].astype(float), base[["estimate", "se", "bandwidth"]].astype(float), rtol=1e-6)
    side = R.rd_bandwidth(df, "y", "x", ["left_only"]).first()
    assert side.h > 0 and side.b > 0 and side.reason is None


def test_rd_keeps_every_specification(spark):
    x, y, _, _ = rd_data(ties=False)
    full = pd.DataFrame({"spec": "full", "x": x, "y": y})
    right = pd.DataFrame({"spec": "right", "x": np.abs(x) + 0.1, "y": y})
    few = pd.DataFrame({"spec": "few", "x": [-1.0, -0.5, 0.5, 1.0], "y": [1.0, 2.0, 3.0, 4.0]})
    df = spark.createDataFrame(pd.concat([full, right, few]))
    for given in (None, 4.0):
        out = R.rd_sharp(df, "y", "x", by=["spec"], h=given).toPandas()
        assert out.groupby("spec").size().to_dict() == {"full": 3, "right": 3, "few": 3}
        lost = out[out.spec == "right"]
        assert lost.estimate.isna().all() and (lost.reason == "no rows on both sides of the cutoff").all()
        assert out[out.spec == "full"].reason.isna().all() and out[out.spec == "full"].estimate.notna().all()
    width = R.rd_bandwidth(df, "y", "x", by=["spec"]).toPandas().set_index("spec")
    assert len(width) == 3 and np.isnan(width.h["right"]) and np.isnan(width.h["few"]) and width.reason["few"]


def test_smooth_band_is_exact_at_any_size(spark):
    from umbral.operators import chartdata as C

    rng = np.random.default_rng(8)
    n = 9000
    x = np.concatenate([rng.normal(-3, 1, n) ** 3, rng.uniform(0.5, 9, n)])
    pdf = pd.DataFrame({"x": x, "y": np.sin(x) + rng.normal(size=len(x))})
    pdf = pdf[(pdf.x <= 0) | (pdf.x > 0.4)]
    out = {}
    for cells in (16, 4096):
        got = C.side_smooth(spark.createDataFrame(pdf), "x", "y", points=9, cells=cells).toPandas()
        out[cells] = got.sort_values(["side", "xvals"]).reset_index(drop=True)
    assert np.allclose(out[16].yvals, out[4096].yvals)
    for side, part in (("left", pdf[pdf.x <= 0]), ("right", pdf[pdf.x > 0])):
        grid = np.linspace(part.x.min(), part.x.max(), 9)
        got = out[4096][out[4096].side == side]
        assert np.allclose(got.xvals, grid)
        for g, v in zip(grid, got.yvals):
            d = np.abs(part.x - g)
            q = np.quantile(d, 0.75)
            w = np.sqrt(np.clip(1 - (d / q) ** 3, 0, None) ** 3)
            basis = np.vander((part.x - g) / q, 3, increasing=True)
            assert np.isclose(v, np.linalg.lstsq(basis * w.to_numpy()[:, None], part.y * w, rcond=None)[0][0], rtol=1e-6)


def test_density(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(0.5, 3, 250), 1)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    out = D.density_test(df, "x", 0.0, 3.0, 2.5, buckets=7).toPandas().set_index("order")
    for order in (2, 3):
        want = density_reference.density_jump(x, 3.0, 2.5, order)
        assert np.allclose(out.loc[order, ["f_l", "f_r", "se_l", "se_r", "se"]].astype(float), want)
    curve = D.density_curve(df, "x", 0.0, 3.0, 2.5).toPandas().set_index("gid")
    for gid in (0, 9, 10, 15):
        r = curve.loc[gid]
        h = 2.5 if r.right else 3.0
        f, psi = density_reference.influence(x, r.x, h, 3, (x >= 0) == r.right)
        assert np.isclose(r.density_bc, f) and np.isclose(r.se, np.sqrt(((psi - psi.mean()) ** 2).sum()))


@pytest.mark.parametrize(("digits", "shape", "p"), [(1, "normal", 2), (3, "skewed", 2), (2, "uniform", 1), (2, "normal", 3)])
def test_density_bandwidth(spark, digits, shape, p):
    """All four selectors against all pairs of rows, ties included; the test and the curve use the middle ones."""
    rng = np.random.default_rng(11)
    draw = {"normal": rng.normal(0.6, 3, 420), "skewed": rng.gamma(2.0, 2.0, 420) - 3, "uniform": rng.uniform(-4, 6, 420)}[shape]
    x = np.round(draw, digits)
    df = spark.createDataFrame(pd.DataFrame({"x": x + 10}))
    x = (x + 10) - 10
    got = D.density_bandwidth(df, "x", 10.0, p).toPandas().set_index("selector")
    left, right, diff, total = density_reference.bandwidths(x, p)
    assert np.allclose([got.loc["left"].hl, got.loc["right"].hr, got.loc["diff"].hl, got.loc["sum"].hr], [left, right, diff, total], rtol=1e-6)
    hl, hr = np.median([left, diff, total]), np.median([right, diff, total])
    assert np.allclose(got.loc["comb"].astype(float), [hl, hr], rtol=1e-6)
    if p == 2:
        out = D.density_test(df, "x", 10.0).toPandas().set_index("order")
        assert np.allclose(out.loc[3, ["f_l", "f_r", "se_l", "se_r", "se"]].astype(float), density_reference.density_jump(x, hl, hr, 3), rtol=1e-5)
        curve = D.density_curve(df, "x", 10.0)
        assert np.isclose(curve.where("not right").agg(F.min("x")).first()[0], max(x.min(), -3 * hl), rtol=1e-6)


def test_density_pilot_constants():
    """The constants of the pilot bandwidths for orders one to three, as published."""
    assert np.allclose([D._uniform_constant(p, 1) for p in (1, 2, 3)], [4.8, 548.571428571, 100800.0])
    for p in (1, 2):
        bias, variance = density_reference.boundary_constants(p + 2, p + 1, np.ones_like)
        assert np.isclose(D._uniform_constant(p + 2, p + 1), variance * float(np.prod(np.arange(1, p + 4))) ** 2 / bias**2)


def test_density_of_few_rows(spark):
    """One side without rows, one value, and no rows: missing numbers, no curve."""
    for values in ([1.0, 2.0, 3.0], [-1.0, 1.0], [2.0] * 5, []):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        out = D.density_test(df, "x").collect()
        assert [r["order"] for r in out] == [2, 3] and all(r["p_value"] is None for r in out)
        assert D.density_curve(df, "x").collect() == []


def test_density_power(spark):
    rng = np.random.default_rng(9)
    x = rng.uniform(-1, 1, 4000)
    moved = np.where((x > 0) & (x < 0.1) & (rng.uniform(size=4000) < 0.8), -x, x)
    flat = D.density_test(spark.createDataFrame(pd.DataFrame({"x": x})), "x").where("order = 3").first()
    bunched = D.density_test(spark.createDataFrame(pd.DataFrame({"x": moved})), "x", h_left=0.3, h_right=0.3).where("order = 3").first()
    assert flat.p_value > 0.01 and bunched.p_value < 1e-4 and bunched.jump < 0


def test_heap_windows(spark):
    rng = np.random.default_rng(3)
    r = np.round(rng.uniform(0, 100, 800), 0)
    y = 0.2 + 0.5 * (r == 50) + 0.01 * r + rng.normal(size=800) * 0.1
    df = spark.createDataFrame(pd.DataFrame({"r": r, "y": y}))
    got = E.heap_jump(df, "y", "r", [(50, 9.99)]).first()
    m = np.abs(r - 50) <= 9.99
    x = np.column_stack([np.ones(m.sum()), r[m] == 50, r[m] - 50]).astype(float)
    assert np.isclose(got.coeff, np.linalg.lstsq(x, y[m], rcond=None)[0][1])
    assert df.where(F.col("r").between(40.01, 59.99)).count() == got.n


def test_effect_plot_takes_the_selected_bandwidth(spark):
    """The fit of the bonus sample within its own bandwidth, over the years that occur in it."""
    from umbral.plans.registry import Tables
    from umbral.plans.samples import effect_plot, score_sample

    t = Tables(spark, "/root/testdata/sf0.01")
    zs = ["Trees_2000", "Development_2000", "Grassland_2000", "Plantation_2001", "Water_2000", "Crop_2000"]
    bonus = score_sample(t).where("received_bonus = 1 or not Awarded").cache()
    h = R.rd_bandwidth(bonus, "Native", "score_centered", zs).first()["h"]
    cols = ["Native", "score_centered", "Awarded", "years_since_contest", *zs]
    near = bonus.where(F.abs("score_centered") <= h).select(*[F.col(c).cast("double") for c in cols]).dropna().toPandas()
    years = near["years_since_contest"]
    x = np.column_stack([np.ones(len(near)), near["score_centered"], near["Awarded"], years, near["Awarded"] * years, near[zs]])
    b = np.linalg.lstsq(x, near["Native"], rcond=None)[0]
    out = effect_plot(t).toPandas().sort_values("xvals")
    assert len(out) == 25 and np.allclose(out["xvals"], np.linspace(years.min(), years.max(), 25), atol=1e-6)
    assert np.allclose(out["yvals"], b[2] + b[4] * out["xvals"], rtol=1e-4, atol=1e-4)


def test_all_outcomes_have_a_bandwidth_and_a_curve(spark):
    from umbral.plans.catalogue import QUERIES

    folder, five = "/root/testdata/sf0.001", {"Native", "Eucalyptus", "Pine", "Plantation", "Forest"}
    assert {r["outcome"] for r in QUERIES["rd_bandwidth"](spark, folder).collect()} == five
    assert {r["outcome"] for r in QUERIES["rd_spec_curve"](spark, folder).collect()} == five


def test_outcomes_share_mass_points(spark):
    """Estimates of several outcomes at once, some missing in some rows, are those of each outcome alone."""
    x, y, t, z = rd_data(ties=True)
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"x": x, "a": y, "b": y**2, "c": y + x, "d": np.nan, "t": t, "z": z[:, 0], "g": rng.integers(0, 2, len(x)).astype(str)})
    pdf.loc[rng.uniform(size=len(x)) < 0.3, "b"] = np.nan
    pdf.loc[rng.uniform(size=len(x)) < 0.2, ["c", "b"]] = np.nan
    df = spark.createDataFrame(pdf)
    points = R.RdPoints(df, ["a", "b", "c", "d"], "x", ["z"], "t", ["g"], block=37, buckets=7)
    for take_up in (None, "t"):
        together = points.fits(bool(take_up)).toPandas()
        assert set(together.outcome) == {"a", "b", "c"}
        for name in "abc":
            alone = R.rd_sharp(df, name, "x", ["z"], take_up, by=["g"]).toPandas()
            own = together[together.outcome == name]
            keys = ["g", "method"]
            one, two = (v.sort_values(keys)[["estimate", "se", "pval", "bandwidth", "bias_bandwidth", "Obs", "eff_obs"]].to_numpy(float) for v in (own, alone))
            assert len(one) == 6 and np.allclose(one, two, rtol=1e-8)


def test_smoother_rows_of_a_task_do_not_grow_with_its_points(spark):
    """A task gives a row for each grid point (and cell) once, however many batches of points it reads."""
    from umbral.operators import chartdata as C

    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        mass = spark.range(3000).selectExpr("'left' side", "double(id) _x", "1D _n", "double(id) _s").coalesce(1)

        def add(held, x, n, s, state):
            assert len(x) <= C.POINTS_AT_ONCE
            return np.append(n.sum(), [len(x)]) if held is None else held + [n.sum(), len(x)]

        out = C._per_point(mass, {("left",): np.zeros((2, 5))}, ["side"], "_i int, _n double", add, lambda held: {"_i": [0, 1], "_n": held}).collect()
        assert [(r["_i"], r["_n"]) for r in out] == [(0, 3000.0), (1, 3000.0)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
