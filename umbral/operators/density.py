"""Test for a jump of the density at a cutoff, and the density curve, by local polynomials of the
empirical distribution function (order ``p`` for the curve, ``p + 1`` for the test).

The running variable is reduced to ordered mass points; the distribution function and the influence
values come from two-level running sums, so no step sorts a whole column in one task. The error is the
jackknife of the U-statistic: each row's own term and its effect on all rows above it.
"""

from __future__ import annotations

from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from umbral.functions.distributions import p_normal
from umbral.functions.scalars import col, z_value
from umbral.operators.ordering import running_sums
from umbral.operators.rd import _inv, kernel_weight
from umbral.session import materialise


def distribution(df: DataFrame, x: str, c: float = 0.0, **bucket_args) -> DataFrame:
    """Mass points of ``x - c`` with ``n``, ``cum_n`` and ``cdf``, the share of the other rows at or below.

    Written once to the shared folder.
    """
    run = (col(x) - F.lit(float(c))).cast("double").alias("x")
    points = materialise(df.select(run).where(F.col("x").isNotNull()).groupBy("x").agg(F.count(F.lit(1)).alias("n")))
    ranked = running_sums(points, [], ["x"], {"cum_n": F.col("n")}, **bucket_args)
    total = points.agg(F.sum("n").alias("total"))
    out = ranked.crossJoin(F.broadcast(total))
    return materialise(out.withColumn("cdf", F.try_divide(F.col("cum_n") - 1, F.col("total") - 1)))


def _moment_array(order: int, weight: str = "k * n") -> list:
    p = ", ".join(f"sum({weight} * pow(u, {i}))" for i in range(2 * order + 1))
    r = ", ".join(f"sum({weight} * pow(u, {i}) * cdf)" for i in range(order + 1))
    return [F.expr(f"array({p})").alias("P"), F.expr(f"array({r})").alias("R")]


def _local_fit(p, r, order: int):
    """Coefficients of the local fit and the row of the inverse that gives the slope."""
    g = np.array([[p[i + j] for j in range(order + 1)] for i in range(order + 1)], dtype=float)
    inv = _inv(g)
    return inv @ np.asarray(r[: order + 1], dtype=float), inv[1]


class _Window:
    """The rows within reach of the cutoff, and per side the sums that all local fits there need.

    Both sides of the window together are one stretch of the running variable, so the filter reaches the
    scan. The driver holds two rows of sums.
    """

    def __init__(self, points: DataFrame, hl: float, hr: float, top: int, kernel: str):
        near = points.where((F.col("x") > F.lit(-hl)) & (F.col("x") < F.lit(hr))).withColumn("right", F.col("x") >= 0)
        near = near.withColumn("h", F.when(F.col("right"), F.lit(hr)).otherwise(F.lit(hl))).withColumn("u", F.expr("x / h"))
        self.rows = near.withColumn("k", kernel_weight(F.col("u"), kernel) / F.col("h"))
        self.h = {False: hl, True: hr}
        sums = self.rows.groupBy("right").agg(
            F.first("total").alias("total"), F.sum("n").alias("n_h"), F.min(F.expr("cum_n - n")).alias("below"),
            F.max("cum_n").alias("upto"), *_moment_array(top),
        )
        self.sides = {r["right"]: r for r in sums.collect()}

    @property
    def whole(self) -> bool:
        return len(self.sides) == 2

    def fit(self, order: int) -> dict[bool, tuple] | None:
        """Per side the coefficients in powers of ``x / h``, and the row of the inverse for the slope."""
        try:
            return {s: _local_fit(r["P"], r["R"], order) for s, r in self.sides.items()} if self.whole else None
        except np.linalg.LinAlgError:
            return None

    def density(self, fits: dict[bool, tuple]) -> dict[bool, float]:
        return {s: fits[s][0][1] / self.h[s] for s in fits}

    def variances(self, fits: dict[int, dict[bool, tuple]], **bucket_args) -> dict[int, tuple[float, float, float]]:
        """Jackknife variances left and right, and the covariance, of the densities of each order.

        A density is a sum over pairs of rows; its variance is the spread of the rows' shares in it. Rows
        outside the window have no weight: those below count in every indicator of the window, those above
        in none, so that their share is the same for all of them.
        """
        columns, all_g = {}, {}
        for order, sides in fits.items():
            for side, name in ((False, "l"), (True, "r")):
                coef, slope = sides[side]
                h, own = self.h[side], F.col("right") == F.lit(side)
                g = F.col("k") / F.lit(h) * _polynomial(slope)
                columns[f"g{order}{name}"] = F.when(own, g).otherwise(F.lit(0.0))
                columns[f"e{order}{name}"] = F.when(own, F.col("cdf") - _polynomial(coef)).otherwise(F.lit(0.0))
                all_g[order, name] = sum(s * m for s, m in zip(slope, self.sides[side]["P"])) / h
        rows = self.rows.withColumns(columns)
        keys = [f"{order}{name}" for order in fits for name in "lr"]
        above = running_sums(rows, [], ["x"], {f"a{k}": F.expr(f"n * g{k}") for k in keys}, reverse=True, **bucket_args)
        total = self.sides[False]["total"]
        shares, sums = {}, {}
        for order, sides in fits.items():
            density = self.density(sides)
            for side, name in ((False, "l"), (True, "r")):
                k = f"{order}{name}"
                # other rows: g_j * (1{x_i <= x_j} - fit_j), where sum g_j fit_j is the density; own row: g_i * (F(x_i) - fit_i)
                others = F.col(f"a{k}") - F.col(f"g{k}") - F.lit(density[side]) + F.col(f"g{k}") * (F.col("cdf") - F.col(f"e{k}"))
                shares[f"s{k}"] = others / F.lit(float(total - 1)) + F.col(f"g{k}") * F.col(f"e{k}")
            for x, y in (("l", "l"), ("r", "r"), ("l", "r")):
                sums[f"{order}{x}{y}"] = F.sum(F.expr(f"n * s{order}{x} * s{order}{y}"))
            for x in "lr":
                sums[f"{order}{x}"] = F.sum(F.expr(f"n * s{order}{x}"))
        found = above.withColumns(shares).agg(*[c.alias(f"v{k}") for k, c in sums.items()]).first()
        below, beyond = self.sides[False]["below"], total - self.sides[True]["upto"]
        out = {}
        for order, sides in fits.items():
            density = dict(zip("lr", (self.density(sides)[s] for s in (False, True))))
            low = {x: (all_g[order, x] - density[x]) / (total - 1) for x in "lr"}
            high = {x: -density[x] / (total - 1) for x in "lr"}
            mean = {x: found[f"v{order}{x}"] + below * low[x] + beyond * high[x] for x in "lr"}
            out[order] = tuple(
                found[f"v{order}{x}{y}"] + below * low[x] * low[y] + beyond * high[x] * high[y] - mean[x] * mean[y] / total
                for x, y in (("l", "l"), ("r", "r"), ("l", "r"))
            )
        return out


def _polynomial(coefficients):
    """Sum of the coefficients times the powers of the column ``u``."""
    out = F.lit(0.0)
    for c in reversed(list(coefficients)):
        out = out * F.col("u") + F.lit(float(c))
    return out


TEST = (
    "order int, hl double, hr double, n_h_l long, n_h_r long, f_l double, f_r double, se_l double, se_r double, jump double, se double, t double"
)


def density_test(
    df: DataFrame, x: str, c: float = 0.0, h_left: float | None = None, h_right: float | None = None, p: int = 2,
    kernel: str = "triangular", **bucket_args
) -> DataFrame:
    """Densities on both sides of the cutoff, their jackknife errors and the test of no jump: one row per order.

    Row ``order = p + 1`` is the bias-robust test; rows at the cutoff belong to the right side. A bandwidth
    that is not given is selected (:func:`density_bandwidths`). Where one side has no rows, or too few
    distinct values for a fit, all numbers are missing.
    """
    points = distribution(df, x, c, **bucket_args)
    h = _given_or_selected(points, h_left, h_right, p, kernel, **bucket_args)
    rows, orders = [], (p, p + 1)
    window = _Window(points, *h, p + 1, kernel) if h else None
    fits = {o: window.fit(o) for o in orders} if window else {}
    fits = {o: f for o, f in fits.items() if f}
    variances = window.variances(fits, **bucket_args) if fits else {}
    for order in orders:
        if order not in fits:
            rows.append((order, *[None] * 11))
            continue
        f, (v_l, v_r, v_lr) = window.density(fits[order]), variances[order]
        jump, se = f[True] - f[False], max(v_l + v_r - 2 * v_lr, 0.0) ** 0.5
        counts = [window.sides[s]["n_h"] for s in (False, True)]
        rows.append((order, *h, *counts, f[False], f[True], v_l**0.5, v_r**0.5, jump, se, jump / se if se else None))
    return _with_p(df.sparkSession.createDataFrame([tuple(None if v is None else float(v) if isinstance(v, float) else int(v) for v in r) for r in rows], TEST))


# ---- bandwidth selection -----------------------------------------------------------------------------
#: Beyond the order of a fit, so many distinct values must lie within a bandwidth.
LEAST_DISTINCT = 21


def _uniform_constant(q: int, s: int) -> float:
    """What the error of the ``s``-th derivative depends on, for a boundary fit of order ``q`` with equal weights:
    the variance constant times the squared factorial of ``q + 1`` over the squared bias constant."""
    i = np.arange(q + 1)
    inv = np.linalg.inv(1.0 / (i[:, None] + i[None, :] + 1))
    j = i[None, :]
    rise = 1 / ((j + 2) * (i[:, None] + j + 3)) + (1 / (i[:, None] + 2) - 1 / (i[:, None] + j + 3)) / (j + 1)
    bias = inv @ (1.0 / (i + q + 2))
    return (inv @ rise @ inv)[s, s] * factorial(q + 1) ** 2 / bias[s] ** 2


def _bias_constant(p: int, kernel: str) -> float:
    """Bias of the slope of a boundary fit of order ``p``, over the next coefficient and ``h ** p``."""
    moment = {
        "triangular": lambda k: 1 / ((k + 1) * (k + 2)),
        "epanechnikov": lambda k: 1 / (k + 1) - 1 / (k + 3),
        "uniform": lambda k: 1 / (k + 1),
    }[kernel]
    s = np.array([[moment(i + j) for j in range(p + 1)] for i in range(p + 1)])
    return float(np.linalg.solve(s, [moment(i + p + 1) for i in range(p + 1)])[1])


def _hermite(k: int, z: float) -> float:
    """The ``k``-th derivative of the normal density over the density itself, but for the sign."""
    before, now = 0.0, 1.0
    for i in range(k):
        before, now = now, z * now - i * before
    return now


def _reach(points: DataFrame, p: int):
    """One row: moments of the running variable, its ends, and how far the values needed on each side reach."""
    need = {"h": LEAST_DISTINCT - 1 + p + 1, "b": LEAST_DISTINCT - 1 + p + 3}
    n, v = F.col("n"), F.col("x")
    s = points.agg(
        F.sum("n").alias("n"), F.sum(n * v).alias("sx"), F.sum(n * v * v).alias("sxx"), F.min("x").alias("low"), F.max("x").alias("high"),
    )
    side = F.when(F.col("x") >= 0, F.lit("r")).otherwise(F.lit("l"))
    near = points.select(side.alias("side"), F.abs("x").alias("a"))
    # distance of the n-th nearest distinct value: the rank limit is applied before the shuffle
    ranked = near.withColumn("_rn", F.row_number().over(Window.partitionBy("side").orderBy("a"))).where(F.col("_rn") <= max(need.values()))
    least = ranked.agg(*[
        F.max(F.when((F.col("side") == at) & (F.col("_rn") <= k), F.col("a"))).alias(f"{name}_{at}") for name, k in need.items() for at in "lr"
    ])
    return s.crossJoin(least).first()  # two rows of one row each


def density_bandwidths(points: DataFrame, p: int = 2, kernel: str = "triangular", **bucket_args) -> dict[str, float] | None:
    """Bandwidths with the least estimated mean squared error: ``left``, ``right``, their ``diff`` and their ``sum``.

    Pilot bandwidths come from a normal density with the mean and spread of all rows. With the one, a fit of
    order ``p + 2`` gives the next coefficient of the distribution function on each side, hence the bias;
    with the other, a fit of order ``p`` gives the variance. A bandwidth reaches to at least
    ``LEAST_DISTINCT + p`` distinct values (as far as there are so many) and at most to the end of its side.
    None where a side has no rows or a pilot fit is not possible. ``points``: :func:`distribution`.
    """
    s = _reach(points, p)
    if s["h_l"] is None or s["h_r"] is None or s["n"] < 2:
        return None
    n, mean = s["n"], s["sx"] / s["n"]
    sd = (max(s["sxx"] - n * mean * mean, 0.0) / (n - 1)) ** 0.5
    end = {"left": -s["low"], "right": s["high"]}
    end["diff"] = end["sum"] = farthest = max(end.values())
    z = mean / sd
    density = float(np.exp(-z * z / 2) / np.sqrt(2 * np.pi))

    def pilot(k: int, constant: float, power: int, least: float) -> float:
        curve = _hermite(k, z) ** 2 * density
        h = sd * (constant / (curve * n)) ** (1 / power) if curve > 0 else farthest
        return max(min(h, farthest), least)

    wide = pilot(p + 2, (2 * p + 1) / 4 * _uniform_constant(p + 2, p + 1), 2 * p + 5, max(s["b_l"], s["b_r"]))
    narrow = pilot(p, _uniform_constant(p, 1) / (2 * p), 2 * p + 1, max(s["h_l"], s["h_r"]))
    bias_window = _Window(points, wide, wide, p + 2, kernel)
    window = _Window(points, narrow, narrow, p, kernel)
    higher, fit = bias_window.fit(p + 2), window.fit(p)
    if not higher or not fit:
        return None
    v_l, v_r, v_lr = window.variances({p: fit}, **bucket_args)[p]
    constant = _bias_constant(p, kernel)
    bias = {side: higher[side][0][p + 1] / wide ** (p + 1) * constant * (1 if side else (-1) ** p) for side in (False, True)}
    errors = {
        "left": (v_l, bias[False]), "right": (v_r, bias[True]),
        "diff": (v_l + v_r - 2 * v_lr, bias[True] - bias[False]), "sum": (v_l + v_r + 2 * v_lr, bias[True] + bias[False]),
    }
    least = {"left": s["h_l"], "right": s["h_r"], "diff": max(s["h_l"], s["h_r"]), "sum": max(s["h_l"], s["h_r"])}
    out = {}
    for name, (variance, b) in errors.items():
        h = (max(variance, 0.0) * narrow / (2 * p * b * b)) ** (1 / (2 * p + 1)) if b else farthest
        out[name] = float(max(min(h, end[name]), least[name]))
    return out


def _given_or_selected(points: DataFrame, h_left: float | None, h_right: float | None, p: int, kernel: str, **bucket_args):
    """The bandwidths given; for a missing one the middle one of its side's, the difference's and the sum's."""
    if h_left and h_right:
        return float(h_left), float(h_right)
    found = density_bandwidths(points, p, kernel, **bucket_args)
    if found is None:
        return None
    left, right = (float(np.median([found[side], found["diff"], found["sum"]])) for side in ("left", "right"))
    return float(h_left or left), float(h_right or right)


def density_bandwidth(df: DataFrame, x: str, c: float = 0.0, p: int = 2, kernel: str = "triangular", **bucket_args) -> DataFrame:
    """One row per selector (``left``, ``right``, ``diff``, ``sum``, and ``comb``, which the test uses) with ``hl`` and ``hr``."""
    found = density_bandwidths(distribution(df, x, c, **bucket_args), p, kernel, **bucket_args)
    if found is None:
        return df.sparkSession.createDataFrame([], "selector string, hl double, hr double")
    comb = [float(np.median([found[side], found["diff"], found["sum"]])) for side in ("left", "right")]
    rows = [("left", found["left"], None), ("right", None, found["right"]), *[(k, found[k], found[k]) for k in ("diff", "sum")], ("comb", *comb)]
    return df.sparkSession.createDataFrame(rows, "selector string, hl double, hr double")
# ------------------------------------------------------------------------------------------------------


def _with_p(tests: DataFrame) -> DataFrame:
    result = T.StructType([*tests.schema.fields, T.StructField("p_value", T.DoubleType())])

    def add_p(batches):
        for b in batches:
            yield b.assign(p_value=pd.Series([p_normal(t) for t in b["t"]], dtype="float64", index=b.index))

    return tests.mapInPandas(add_p, result)


def density_curve(
    df: DataFrame, x: str, c: float = 0.0, h_left: float | None = None, h_right: float | None = None, p: int = 2,
    points_per_side: int = 10, reach: float = 3.0, level: float = 0.95, kernel: str = "triangular", **bucket_args
) -> DataFrame:
    """Density along a grid on each side of the cutoff, each side fitted from its own rows.

    The grid runs ``reach`` bandwidths out, within the data. ``density`` has order ``p``; the band is
    centred on the fit of order ``p + 1`` (``density_bc``) with its jackknife error.
    """
    pts = distribution(df, x, c, **bucket_args)
    h = _given_or_selected(pts, h_left, h_right, p, kernel, **bucket_args)
    hl, hr = h or (None, None)
    one = pts.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    one = one.withColumns({"hl": F.lit(hl).cast("double"), "hr": F.lit(hr).cast("double")}).where(F.col("hl").isNotNull())
    sides = one.select(
        F.explode(
            F.array(
                F.struct(F.lit(False).alias("right"), F.col("hl").alias("h"), F.greatest(F.col("lo"), -reach * F.col("hl")).alias("end")),
                F.struct(F.lit(True).alias("right"), F.col("hr").alias("h"), F.least(F.col("hi"), reach * F.col("hr")).alias("end")),
            )
        ).alias("s")
    ).select("s.*")
    grid = sides.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points_per_side - 1))))
    grid = grid.select(
        F.when(F.col("right"), F.col("i") + points_per_side).otherwise(F.lit(points_per_side - 1) - F.col("i")).alias("gid"),
        "right", "h", (F.col("end") * F.col("i") / F.lit(float(points_per_side - 1))).alias("x0"),
    )
    near = pts.withColumn("right", F.col("x") >= 0).join(F.broadcast(grid), "right").withColumn("u", F.expr("(x - x0) / h"))
    near = near.withColumn("k", kernel_weight(F.col("u"), kernel) / F.col("h")).where(F.col("k") > 0)
    q = p + 1
    sums = near.groupBy("gid").agg(
        *[F.first(v).alias(v) for v in ("right", "x0", "h", "total")], F.min(F.expr("cum_n - n")).alias("below"),
        F.max("cum_n").alias("upto"), *_moment_array(q),
    )
    keep = ["gid", "right", "x0", "h", "total", "below", "upto"]
    schema = T.StructType([*[sums.schema[k] for k in keep], *T.StructType.fromDDL("f double, f_bc double, coef array<double>, slope array<double>").fields])

    def solve(batches):
        for batch in batches:
            rows = []
            for r in batch.to_dict("records"):
                try:
                    plain, (coef, slope) = _local_fit(r["P"], r["R"], p), _local_fit(r["P"], r["R"], q)
                    rows.append([*[r[k] for k in keep], plain[0][1] / r["h"], coef[1] / r["h"], coef.tolist(), slope.tolist()])
                except np.linalg.LinAlgError:
                    rows.append([*[r[k] for k in keep], None, None, None, None])
            yield pd.DataFrame(rows, columns=schema.names)

    state = materialise(sums.mapInPandas(solve, schema))
    poly = lambda v: " + ".join(f"get({v}, {i}) * pow(u, {i})" for i in range(q + 1))
    rows = near.select("gid", "x", "n", "cdf", "u", "k").join(F.broadcast(state.drop("x0", "right")), "gid")
    rows = rows.withColumns({"g": F.expr(f"k / h * ({poly('slope')})"), "fit": F.expr(poly("coef"))})
    rows = rows.select("gid", "x", "n", "cdf", "total", "g", "fit", F.expr("n * g").alias("w"))
    above = running_sums(rows, ["gid"], ["x"], {"above": F.col("w")}, reverse=True, **bucket_args)
    totals = rows.groupBy("gid").agg(F.sum("w").alias("all_g"), F.sum(F.expr("w * fit")).alias("all_fit"))
    psi = above.join(F.broadcast(totals), "gid").withColumn(
        "psi", F.expr("((above - g) - (all_fit - g * fit)) / (total - 1) + g * (cdf - fit)")
    )
    v = psi.groupBy("gid").agg(F.sum(F.expr("n * psi")).alias("m1"), F.sum(F.expr("n * psi * psi")).alias("m2")).join(F.broadcast(totals), "gid")
    full = state.join(v, "gid")
    # rows outside the window: those below count in every indicator of the window, those above in none
    full = full.withColumns({"low": F.expr("(all_g - all_fit) / (total - 1)"), "high": F.expr("-all_fit / (total - 1)")})
    full = full.withColumns(
        {
            "m1": F.expr("m1 + below * low + (total - upto) * high"),
            "m2": F.expr("m2 + below * low * low + (total - upto) * high * high"),
        }
    ).withColumn("se", F.expr("sqrt(m2 - m1 * m1 / total)"))
    z = z_value(level)
    return full.select(
        "gid", "right", F.col("x0").alias("x"), F.col("f").alias("density"), F.col("f_bc").alias("density_bc"), "se",
        (F.col("f_bc") - z * F.col("se")).alias("lower"), (F.col("f_bc") + z * F.col("se")).alias("upper"),
    )
