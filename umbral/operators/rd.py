"""Regression discontinuity by local polynomials: sharp and fuzzy, with covariates, data-driven bandwidth,
bias correction and robust errors.

The rows are reduced once to ordered mass points with their neighbours (``masspoints``), one table for all
outcomes and both designs. Every further step is one pass over the part of that table within the largest
window still in use: each task adds up its rows' moments per (specification, side) by matrix products,
Spark adds up the tasks' sums, and the driver, which holds one small state per specification, solves on
them. A specification that cannot be solved keeps its row, with missing numbers and a reason. A whole grid
of specifications runs in the same passes.

Powers are taken of ``x / h``, so that the moment matrices stay well conditioned.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import factorial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from umbral.functions.distributions import p_normal
from umbral.functions.scalars import col
from umbral.operators import masspoints as M

# ---- fixed values: pilot constants per kernel, weights of the mass-point rule ------------------------
PILOT = {"triangular": 2.576, "epanechnikov": 2.34, "uniform": 1.843}
MASS_SHARE, MIN_DISTINCT = 0.2, 10
METHODS = ("conventional", "bias-corrected", "robust")
MSE_LABEL = "MSE-optimal"
#: A covariate is redundant if less than this share of its sum of squares is left.
COLLINEAR = 1e-10
# -----------------------------------------------------------------------------------------------


def kernel_weight(u: Column, kernel: str) -> Column:
    """Kernel at ``u``, positive only for ``|u| < 1``."""
    a = F.abs(u)
    if kernel == "triangular":
        k = 1 - a
    elif kernel == "epanechnikov":
        k = 0.75 * (1 - u * u)
    elif kernel == "uniform":
        k = F.lit(0.5)
    else:
        raise ValueError(f"unknown kernel {kernel!r}")
    return F.when(a < 1, k).otherwise(F.lit(0.0))


def _pairs(k: int):
    return [(i, j) for i in range(k) for j in range(i, k)]


def _kernel(u, kernel: str):
    """The same as :func:`kernel_weight` on an array."""
    a = np.abs(u)
    k = 1 - a if kernel == "triangular" else 0.75 * (1 - u * u) if kernel == "epanechnikov" else np.full_like(u, 0.5)
    return np.where(a < 1, k, 0.0)


class _Rows:
    """Mass points of one specification and side, as arrays: a row of ``sums`` for each of its variables."""

    def __init__(self, batch: dict, at, right: bool, variables: Sequence[int], pairs: dict[tuple[int, int], int]):
        self.batch, self.at, self.right, self.v, self.pairs = batch, at, right, list(variables), pairs
        self.x, self.n = batch["x"][at], batch["n"][at]
        self.sums = batch["s"][np.ix_(at, self.v)].T

    @property
    def products(self) -> np.ndarray:
        own = [self.pairs[tuple(sorted((self.v[i], self.v[j])))] for i, j in _pairs(len(self.v))]
        return self.batch["q"][np.ix_(self.at, own)].T

    def window(self, tag: str, h: float, top: int, d_top: int, kernel: str, cross: bool = False) -> dict[str, np.ndarray]:
        """Sums of a kernel window of width ``h``: ``P`` powers of ``x / h``, ``U`` powers times the variables,
        ``C`` products of the variables."""
        powers = self.powers(h, top, kernel)
        out = {f"{tag}P": powers @ self.n, f"{tag}U": (powers[: d_top + 1] @ self.sums.T).ravel()}
        return out | ({f"{tag}C": self.products @ powers[0]} if cross else {})

    def powers(self, h: float, top: int, kernel: str) -> np.ndarray:
        """Weight times the powers of ``x / h``, a row for each power."""
        u = self.x / h
        out = np.empty((top + 1, len(u)))
        out[0] = _kernel(u, kernel) / h
        for i in range(top):
            out[i + 1] = out[i] * u
        return out

    def residuals(self, vs: Sequence[np.ndarray], reach: float) -> list[np.ndarray]:
        """For each combination of the variables, summed squared residuals of the mass points."""
        near = self.batch["near"][self.at].reshape(len(self.at), 2 * M.NEIGHBOURS, -1)
        take, size = M.neighbour_set(self.x, self.n, self.right, reach, near[:, :, 0].T, near[:, :, 1].T)
        near = near[:, :, [2 + i for i in self.v]].transpose(1, 2, 0)
        products = self.products
        return [M.residuals(np.asarray(v, float), self.n, self.sums, products, near, take, size) for v in vs]


def _hankel(p: Sequence[float], order: int) -> np.ndarray:
    return np.array([[p[i + j] for j in range(order + 1)] for i in range(order + 1)], dtype=float)


def _symmetric(c: Sequence[float], k: int) -> np.ndarray:
    m = np.zeros((k, k))
    for v, (i, j) in zip(c, _pairs(k)):
        m[i, j] = m[j, i] = v
    return m


def _inv(a: np.ndarray) -> np.ndarray:
    d = np.sqrt(np.abs(np.diag(a)))
    if np.any(d == 0) or not np.all(np.isfinite(a)):
        raise np.linalg.LinAlgError
    s = a / np.outer(d, d)
    if np.linalg.cond(s) > 1e14:
        raise np.linalg.LinAlgError
    return np.linalg.inv(s) / np.outer(d, d)


def _partial_out(u_mat, c_mat, inv_g, n_y: int):
    """Cross products of covariates with covariates and outcomes, net of the polynomial."""
    z = slice(n_y, c_mat.shape[0])
    net = c_mat - u_mat.T @ inv_g @ u_mat
    return net[z, z], net[z, :n_y]


def _covariate_weights(zz: np.ndarray, zy: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Least-squares weights of the covariates; redundant ones are dropped and get weight 0.

    Columns are taken in by pivoted elimination as long as something of them is left that the polynomial
    and the columns before do not explain, relative to ``scale``, their own sums of squares.
    """
    gamma = np.zeros_like(zy)
    if not (np.all(np.isfinite(zz)) and np.all(np.isfinite(zy))):
        raise np.linalg.LinAlgError("not finite")
    d = np.sqrt(np.where(scale > 0, scale, 1.0))
    a = zz / np.outer(d, d)
    left, taken = a.copy(), []
    while len(taken) < len(a):
        rest = [i for i in range(len(a)) if i not in taken]
        i = max(rest, key=lambda r: left[r, r])
        if left[i, i] <= COLLINEAR:
            break
        left = left - np.outer(left[:, i], left[i]) / left[i, i]
        taken.append(i)
    if taken:
        at = np.ix_(taken, taken)
        gamma[taken] = np.linalg.solve(a[at], zy[taken] / d[taken, None]) / d[taken, None]
    return gamma


def _combination(gamma: np.ndarray | None, n_y: int, i: int) -> np.ndarray:
    """Weights of ``d`` for outcome ``i`` net of the covariates."""
    unit = np.eye(n_y)[i]
    return unit if gamma is None else np.concatenate([unit, -gamma[:, i]])


def _direction(gamma: np.ndarray | None, n_y: int, fuzzy: bool, tau: Callable[[np.ndarray], float]) -> np.ndarray:
    """Weights of ``d`` whose local fit is the estimate to first order.

    ``tau(v)`` evaluates the fitted quantity of the combination ``v``.
    """
    sy = _combination(gamma, n_y, 0)
    if not fuzzy:
        return sy
    st = _combination(gamma, n_y, 1)
    ty, tt = tau(sy), tau(st)
    return sy / tt - st * ty / tt**2


SUMS = "spec int, right boolean, name string, at int, value double"


class _Passes:
    """The passes of one design over prepared mass points; ``states`` are the specifications' dicts."""

    def __init__(self, points: "RdPoints", fuzzy: bool, covs: bool, p: int, q: int, kernel: str):
        self.points, self.keys = points.table, [*points.keys, "_class"]
        self.source, self.fuzzy = points, fuzzy
        self.shared = [*([points.take_up] if fuzzy else []), *(points.covs if covs else [])]
        self.n_y, self.k = 1 + fuzzy, 1 + len(self.shared)
        self.p, self.q, self.kernel = p, q, kernel
        self.orders = ((q + 1, q + 1), (q, p + 1), (p, 0))  # (order, derivative) of the three pilot fits

    def _step(self, states: list[dict], reach: Callable[[dict], float], sums: Callable, solve: Callable, near: bool = False) -> None:
        """One pass: ``sums(state, rows)`` of each specification and side, then ``solve(state, left, right)``,
        whose result enters the state, or else a reason."""
        active = [i for i, st in enumerate(states) if st["reason"] is None]
        specs: dict[str, list] = {}
        for i in active:
            if np.isfinite(reach(states[i])):
                specs.setdefault(states[i]["_key"], []).append((i, states[i], reach(states[i]), [states[i]["_y"], *self.shared]))
        found: dict[tuple[int, bool], dict[str, dict[int, float]]] = {}
        if specs:
            farthest = max(r for own in specs.values() for *_, r, _ in own)
            rows = self.points.where((F.col("x") <= F.lit(farthest)) & (F.col("x") >= F.lit(-farthest)))
            rows = rows.select("_key", "x", F.col("n").cast("double").alias("n"), "s", "q", *(["near"] if near else []))
            moments = rows.mapInArrow(_moments(specs, self.source.pairs, sums), SUMS).groupBy("spec", "right", "name", "at").agg(F.sum("value").alias("value"))
            for r in moments.collect():  # the moments of each specification
                found.setdefault((r["spec"], r["right"]), {}).setdefault(r["name"], {})[r["at"]] = r["value"]
        sides = {key: {name: np.array([v[i] for i in range(len(v))]) for name, v in own.items()} for key, own in found.items()}
        for i in active:
            st = states[i]
            try:
                if (i, False) not in sides or (i, True) not in sides:
                    st["reason"] = "no rows on both sides of the cutoff"
                    continue
                out = solve(st, sides[i, False], sides[i, True])
                st.update(out)
                if any(isinstance(v, float) and not np.isfinite(v) for v in out.values()):
                    st["reason"] = "not finite"
            except np.linalg.LinAlgError:
                st["reason"] = "too few distinct values in the window"
            except (TypeError, ZeroDivisionError):
                st["reason"] = "not finite"

    def _constant_take_up(self) -> Column:
        """True if take-up does not vary on one side; the bandwidth is then that of the sharp design."""
        if not self.fuzzy:
            return F.lit(True)
        n, right = F.col("n"), F.col("x") >= 0

        def spread(side):
            at = self.source.take_up
            total = F.get("s", F.lit(at))
            own = (F.col("n"), total, F.coalesce(F.get("q", F.lit(self.source.pairs[at, at])), total * total))
            count, total, square = (F.sum(F.when(side, c).otherwise(0)) for c in own)
            return square - F.try_divide(total * total, count)

        return F.least(spread(right), spread(~right)) <= 1e-10 * F.sum(n)

    def totals(self, bwcheck: int | None) -> list[dict]:
        """A state for each outcome and group of rows: pilot bandwidth, the largest and smallest admissible ones,
        and the range of each side."""
        n, x, right = F.col("n"), F.col("x"), F.col("x") >= 0
        t = self.points.groupBy("_key").agg(
            F.sum(n).cast("double").alias("Obs"),
            F.count(F.lit(1)).cast("double").alias("distinct"),
            F.sum(F.when(~right, n).otherwise(0)).cast("double").alias("rows_l"),
            F.sum(F.when(~right, 1).otherwise(0)).cast("double").alias("dist_l"),
            F.sum(n * x).alias("sx"),
            F.sum(n * x * x).alias("sxx"),
            F.abs(F.min(x)).alias("range_l"),
            F.abs(F.max(x)).alias("range_r"),
            self._constant_take_up().alias("sharp_bw"),
        )
        seen = self.points.join(F.broadcast(t), "_key")  # a row for each group of specifications, whose points would meet in one task
        cum, rank = F.col("cum_n"), F.col("rank")

        def quartile(share):
            at = F.col("Obs") * share
            j = F.floor(at)
            lower = F.min(F.when(cum >= j, x))
            upper = F.min(F.when(cum >= j + 1, x))
            return (F.when(F.first(at) == F.first(j), (lower + upper) / 2).otherwise(upper))

        need = F.lit(float(bwcheck or MIN_DISTINCT))
        m_r = F.col("distinct") - F.col("dist_l")
        near_l = F.max(F.when(rank == F.col("dist_l") - F.least(need, F.col("dist_l")) + 1, F.abs(x)))
        near_r = F.max(F.when(rank == F.col("dist_l") + F.least(need, m_r), F.abs(x)))
        firsts = [F.first(c).alias(c) for c in ("Obs", "distinct", "rows_l", "dist_l", "sx", "sxx", "range_l", "range_r", "sharp_bw")]
        s = seen.groupBy("_key", *self.keys).agg(
            *firsts, (quartile(0.75) - quartile(0.25)).alias("iqr"), near_l.alias("near_l"), near_r.alias("near_r")
        )
        sd = F.sqrt((F.col("sxx") - F.col("sx") * F.col("sx") / F.col("Obs")) / (F.col("Obs") - 1))
        ties = F.greatest(
            1 - F.try_divide(F.col("dist_l"), F.col("rows_l")),
            1 - F.try_divide(F.col("distinct") - F.col("dist_l"), F.col("Obs") - F.col("rows_l")),
        )
        checked = F.lit(True) if bwcheck else ties >= MASS_SHARE
        bw_max = F.greatest("range_l", "range_r")
        bw_min = F.when(checked, F.greatest("near_l", "near_r") + 1e-8).otherwise(0.0)
        pilot = PILOT[self.kernel] * F.least(sd, F.col("iqr") / 1.349) * F.pow(F.col("distinct"), F.lit(-0.2))
        found = s.select(
            "_key", *self.keys, "Obs", "sharp_bw", "range_l", "range_r", bw_max.alias("bw_max"), bw_min.alias("bw_min"),
            F.greatest(F.least(pilot, bw_max), bw_min).alias("c_bw"),
        )
        return self._states(found.collect())  # a row for each group of specifications

    def _states(self, rows) -> list[dict]:
        out = []
        for r in rows:
            for i, kind in enumerate(self.source.classes):
                if kind == r["_class"]:
                    st = {k: float("nan") if v is None and k not in self.keys else v for k, v in r.asDict().items()}
                    out.append({**st, "outcome": self.source.outcomes[i], "_y": i, "reason": None})
        return out

    def given(self, h: float, b: float) -> list[dict]:
        """States with given bandwidths."""
        rows = self.points.groupBy("_key", *self.keys).agg(F.sum("n").cast("double").alias("Obs")).collect()
        return [{**st, "h": h, "b": b} for st in self._states(rows)]

    # ---- bandwidth ------------------------------------------------------------------------------

    def bandwidth(self, bwcheck: int | None = None, regularise: float = 1.0) -> list[dict]:
        """States with the MSE-optimal common bandwidths ``h`` and ``b``."""
        k, n_y, fuzzy, orders = self.k, self.n_y, self.fuzzy, self.orders
        kernel = self.kernel
        top = orders[0][0]
        states = self.totals(bwcheck)

        def pilot_sums(st, rows):
            reach = st["range_r"] if rows.right else st["range_l"]
            own = rows.window("c", st["c_bw"], 2 * top + 1, top, kernel, cross=True)
            return own | rows.window("r", reach, 2 * (top + 1), top + 1, kernel)

        def pilot_solve(st, left, right):
            out_a, out_s, out_b, out_d = [], [], [], []
            for row, rng in ((left, st["range_l"]), (right, st["range_r"])):
                u_all = np.asarray(row["cU"], dtype=float).reshape(top + 1, k)
                c_all = _symmetric(row["cC"], k)
                a, s, bc = [], [], []
                for o, nu in orders:
                    inv_g = _inv(_hankel(row["cP"], o))
                    u_mat = u_all[: o + 1]
                    gamma = None
                    if k > n_y:
                        zz, zy = _partial_out(u_mat, c_all, inv_g, n_y)
                        gamma = _covariate_weights(zz, zy, np.diag(c_all)[n_y:])
                    beta = inv_g @ u_mat
                    scale = factorial(nu) / st["c_bw"] ** nu
                    v = _direction(gamma, n_y, fuzzy and not st["sharp_bw"], lambda d: scale * float(beta[nu] @ d))
                    a.append(inv_g[nu])
                    s.append(v)
                    bc.append(float(inv_g[nu] @ np.array([row["cP"][i + o + 1] for i in range(o + 1)])))
                o, nu = orders[0]
                inv_r = _inv(_hankel(row["rP"], o + 1))
                u_r = np.asarray(row["rU"], dtype=float).reshape(o + 2, k)
                high = float((inv_r @ u_r)[o + 1] @ s[0]) / rng ** (o + 1)
                out_a.append(np.concatenate(a).tolist())
                out_s.append(np.concatenate(s).tolist())
                out_b.append(bc)
                out_d.append(float(np.sqrt(2 * (o + 1 - nu)) * bc[0] * high))
            return {"al": out_a[0], "ar": out_a[1], "sl": out_s[0], "sr": out_s[1], "bl": out_b[0], "br": out_b[1], "db": out_d}

        self._step(states, lambda st: st["bw_max"], pilot_sums, pilot_solve)

        def meat(st, rows):
            a, vs = (st[c + ("r" if rows.right else "l")] for c in "as")
            powers = rows.powers(st["c_bw"], max(o for o, _ in orders), kernel)
            residuals = rows.residuals([vs[i * k : (i + 1) * k] for i in range(len(orders))], st["c_bw"])
            out, at = [], 0
            for (o, _), r in zip(orders, residuals):
                weight = np.asarray(a[at : at + o + 1]) @ powers[: o + 1]
                out.append(weight @ (weight * r))
                at += o + 1
            return {"V": np.array(out)}

        def clamp(st, h):
            return float(max(min(h, st["bw_max"]), st["bw_min"]))

        def pilot_finish(st, left, right):
            v = [(2 * nu + 1) * st["c_bw"] * (left["V"][i] + right["V"][i]) for i, (_, nu) in enumerate(orders)]
            o = orders[0][0]
            d_bw = (v[0] / (st["db"][1] - st["db"][0]) ** 2) ** (1 / (2 * o + 3))
            return {"v": v, "d_bw": clamp(st, d_bw)}

        self._step(states, lambda st: st["c_bw"], meat, pilot_finish, near=True)

        def refine(which: int, window: str, out: str) -> None:
            o, nu = orders[which]
            o_b = o + 1

            def sums(st, rows):
                v = st["sr" if rows.right else "sl"][which * k : (which + 1) * k]
                powers = rows.powers(st[window], 2 * o_b, kernel)
                (r,) = rows.residuals([v], st[window])
                return rows.window("w", st[window], 2 * o_b, o_b, kernel) | {"Q": powers @ (powers[0] * r)}

            def solve(st, left, right):
                bias, reg = [], []
                for row, side in ((left, "l"), (right, "r")):
                    inv_g = _inv(_hankel(row["wP"], o_b))
                    s = np.asarray(st["s" + side], dtype=float)[which * k : (which + 1) * k]
                    u_mat = np.asarray(row["wU"], dtype=float).reshape(o_b + 1, k)
                    unit = st[window] ** (o + 1)
                    high = float((inv_g @ u_mat)[o + 1] @ s) / unit
                    var = float(inv_g[o + 1] @ _hankel(row["Q"], o_b) @ inv_g[o + 1]) / unit**2
                    bc = st["b" + side][which]
                    bias.append(np.sqrt(2 * (o + 1 - nu)) * bc * high)
                    reg.append(2 * (o + 1 - nu) * 3 * bc**2 * var)
                bottom = (bias[1] - bias[0]) ** 2 + regularise * (reg[0] + reg[1])
                return {out: clamp(st, (st["v"][which] / bottom) ** (1 / (2 * o + 3)))}

            self._step(states, lambda st: st[window], sums, solve, near=True)

        refine(1, "d_bw", "b")
        refine(2, "b", "h")
        return states

    # ---- estimates ------------------------------------------------------------------------------

    def fit(self, states: list[dict]) -> None:
        """Estimates and errors for every state with ``h`` and ``b``."""
        k, n_y, fuzzy, p, q, kernel = self.k, self.n_y, self.fuzzy, self.p, self.q, self.kernel

        def reach(st):
            return max(st["h"], st["b"])

        def sums(st, rows):
            return rows.window("h", st["h"], 2 * p + 1, p, kernel, cross=True) | rows.window("b", st["b"], 2 * q, q, kernel)

        def solve(st, left, right):
            ratio = (st["h"] / st["b"]) ** (p + 1)
            zz, zy, own, sides = 0.0, 0.0, 0.0, []
            for row in (left, right):
                inv_p, inv_q = _inv(_hankel(row["hP"], p)), _inv(_hankel(row["bP"], q))
                u_h = np.asarray(row["hU"], dtype=float).reshape(p + 1, k)
                u_b = np.asarray(row["bU"], dtype=float).reshape(q + 1, k)
                lift = float(inv_p[0] @ np.array([row["hP"][i + p + 1] for i in range(p + 1)])) * ratio
                if k > n_y:
                    c_all = _symmetric(row["hC"], k)
                    a, b = _partial_out(u_h, c_all, inv_p, n_y)
                    zz, zy, own = zz + a, zy + b, own + np.diag(c_all)[n_y:]
                level = (inv_p @ u_h)[0]
                sides.append((inv_p[0], lift * inv_q[p + 1], level, level - lift * (inv_q @ u_b)[p + 1]))
            gamma = _covariate_weights(zz, zy, own) if k > n_y else None
            jump, jump_bc = sides[1][2] - sides[0][2], sides[1][3] - sides[0][3]
            s = _direction(gamma, n_y, fuzzy, lambda d: float(jump @ d))
            if fuzzy:
                sy, st_ = _combination(gamma, n_y, 0), _combination(gamma, n_y, 1)
                tau = float(jump @ sy) / float(jump @ st_)
                tau_bc = tau - s[0] * float((jump - jump_bc) @ sy) - s[1] * float((jump - jump_bc) @ st_)
            else:
                tau, tau_bc = float(jump @ s), float(jump_bc @ s)
            coefs = [np.concatenate([side[0], side[1]]).tolist() for side in sides]
            return {"tau": tau, "tau_bc": tau_bc, "s": s, "wl": coefs[0], "wr": coefs[1]}

        self._step(states, reach, sums, solve)

        def meat(st, rows):
            w = np.asarray(st["wr" if rows.right else "wl"])
            powers = rows.powers(st["h"], p, kernel)
            plain = w[: p + 1] @ powers
            corrected = plain - w[p + 1 :] @ rows.powers(st["b"], q, kernel)
            (r,) = rows.residuals([st["s"]], reach(st))
            return {"v": np.array([plain @ (plain * r), corrected @ (corrected * r), rows.n[powers[0] > 0].sum()])}

        def finish(st, left, right):
            v = left["v"] + right["v"]
            se, se_rb = float(np.sqrt(v[0])), float(np.sqrt(v[1]))
            zs = [st["tau"] / se, st["tau_bc"] / se, st["tau_bc"] / se_rb] if se > 0 and se_rb > 0 else [None] * 3
            ps = dict(zip(("p1", "p2", "p3"), (None if z is None else float(p_normal(z)) for z in zs)))
            return {"se": se, "se_rb": se_rb, "eff_obs": round(v[2]), **ps}

        self._step(states, reach, meat, finish, near=True)


def _moments(specs: dict[str, list], pairs: dict[tuple[int, int], int], sums: Callable):
    """Sums of a task's mass points for each specification and side."""

    def run(batches):
        import pyarrow as pa

        total: dict[tuple[int, bool], dict[str, np.ndarray]] = {}
        for batch in batches:
            keys = batch.column("_key").dictionary_encode()
            codes = keys.indices.to_numpy()
            arrays = {c: batch.column(c).to_numpy() for c in ("x", "n")}
            for c in batch.schema.names:
                if c in ("s", "near"):
                    arrays[c] = batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            kept = batch.column("q")
            there = kept.is_valid().to_numpy(zero_copy_only=False)
            arrays["q"] = M.all_products(arrays["s"], kept.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(pairs)), there, list(pairs))
            x = arrays["x"]
            for code, key in enumerate(keys.dictionary.to_pylist()):
                for i, st, reach, variables in specs.get(key, ()):
                    inside = (codes == code) & (np.abs(x) <= reach)
                    for right in (False, True):
                        at = np.flatnonzero(inside & ((x >= 0) == right))
                        if not len(at):
                            continue
                        held = total.setdefault((i, right), {})
                        for name, values in sums(st, _Rows(arrays, at, right, variables, pairs)).items():
                            held[name] = held[name] + values if name in held else values
        for (i, right), own in total.items():
            for name, values in own.items():
                n = len(values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * n, pa.int32()), pa.array([right] * n), pa.array([name] * n), pa.array(range(n), pa.int32()), pa.array(values, pa.float64())],
                    names=["spec", "right", "name", "at", "value"],
                )

    return run


def rd_result_rows(fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Three rows per fit: conventional, bias-corrected (with the conventional error) and robust.

    ``reason`` says why a fit has no estimate.
    """
    rows = [("tau", "se", "p1"), ("tau_bc", "se", "p2"), ("tau_bc", "se_rb", "p3")]
    three = F.array(
        *[
            F.struct(F.lit(m).alias("method"), F.col(e).alias("estimate"), F.col(s).alias("se"), F.col(p).alias("pval"))
            for m, (e, s, p) in zip(METHODS, rows)
        ]
    )
    out = fits.withColumn("_r", F.explode(three))
    return out.select(
        *keys, F.col("_r.estimate").alias("estimate"), F.col("_r.se").alias("se"), F.col("_r.pval").alias("pval"),
        F.col("Obs").cast("bigint").alias("Obs"), "eff_obs", F.col("h").alias("bandwidth"), F.col("b").alias("bias_bandwidth"),
        F.col("_r.method").alias("method"), "reason",
    )


class RdPoints:
    """Mass points of all outcomes of one call, written once; several designs can be estimated from them."""

    def __init__(self, df: DataFrame, outcomes: Sequence[str], x: str, covs: Sequence[str] = (), take_up: str | None = None,
                 by: Sequence[str] = (), c: float = 0.0, block: int = M.BLOCK, **bucket_args):
        self.keys, self.outcomes = list(by), list(outcomes)
        shared = [*([take_up] if take_up else []), *covs]
        self.take_up = len(outcomes) if take_up else None
        self.covs = list(range(len(outcomes) + bool(take_up), len(outcomes) + len(shared)))
        ys, zs = [f"_y{i}" for i in range(len(outcomes))], [f"_d{i}" for i in range(len(shared))]
        rows = df.select(
            *[col(k) for k in by], (col(x) - F.lit(float(c))).cast("double").alias("_run"),
            *[col(o).cast("double").alias(name) for o, name in zip([*outcomes, *shared], [*ys, *zs])],
        ).dropna(subset=[*by, "_run", *zs])
        points, self.classes = M.prepare(rows, ys, zs, by, block, "_run", **bucket_args)
        key = F.to_json(F.struct(*[col(k).cast("string").alias(f"k{i}") for i, k in enumerate([*by, "_class"])]))
        self.table = points.withColumn("_key", key)
        self.pairs = {pair: i for i, pair in enumerate(M.product_pairs(len(ys), len(ys) + len(zs)))}
        self.spark = df.sparkSession

    def where(self, condition: Column) -> "RdPoints":
        """The specifications whose keys meet the condition."""
        out = object.__new__(RdPoints)
        out.__dict__.update(self.__dict__, table=self.table.where(condition))
        return out

    def bandwidths(self, take_up: bool = False, covs: bool = True, p: int = 1, kernel: str = "triangular", bwcheck: int | None = None) -> DataFrame:
        """``h`` and ``b`` for each outcome and specification."""
        states = _Passes(self, take_up, covs, p, p + 1, kernel).bandwidth(bwcheck)
        fields = T.StructType([*self._key_fields(), *_fields("Obs long, h double, b double, reason string")])
        return self.spark.createDataFrame([self._row(st, fields) for st in states], fields)

    def fits(self, take_up: bool = False, covs: bool = True, h: float | None = None, b: float | None = None, multiples: Sequence[float] = (1.0,),
             p: int = 1, kernel: str = "triangular", bwcheck: int | None = None) -> DataFrame:
        """Three rows for each outcome, specification and multiple of the bandwidth; see :func:`rd_sharp`."""
        passes = _Passes(self, take_up, covs, p, p + 1, kernel)
        states = passes.bandwidth(bwcheck) if h is None else passes.given(float(h), float(b if b is not None else h))
        states = [
            {**st, "multiple": float(m)} | ({} if st["reason"] else {"h": st["h"] * m, "b": st["b"] if m == 1 else st["h"] * m})
            for st in states for m in multiples
        ]
        passes.fit(states)
        fields = T.StructType([*self._key_fields(), *_fields(
            "multiple double, Obs double, h double, b double, reason string, tau double, tau_bc double, se double, se_rb double, eff_obs long, p1 double, p2 double, p3 double"
        )])
        fits = self.spark.createDataFrame([self._row(st, fields) for st in states], fields)
        return rd_result_rows(fits, [*self.keys, "outcome", "multiple"])

    def _key_fields(self) -> list[T.StructField]:
        return [*[self.table.schema[k] for k in self.keys], T.StructField("outcome", T.StringType())]

    @staticmethod
    def _row(st: dict, fields: T.StructType) -> tuple:
        """The state's values as Python numbers; what is not finite is missing."""
        out = []
        for f in fields:
            v = st.get(f.name)
            if isinstance(v, (float, np.floating)):
                v = (int(v) if isinstance(f.dataType, T.LongType) else float(v)) if np.isfinite(v) else None
            out.append(v)
        return tuple(out)


def _fields(ddl: str) -> list[T.StructField]:
    return T.StructType.fromDDL(ddl).fields


def rd_bandwidth(df: DataFrame, y: str, x: str, covs: Sequence[str] = (), take_up: str | None = None, by: Sequence[str] = (),
                 c: float = 0.0, p: int = 1, kernel: str = "triangular", bwcheck: int | None = None, block: int = M.BLOCK,
                 **bucket_args) -> DataFrame:
    """MSE-optimal bandwidths ``h`` (estimate) and ``b`` (bias) per specification."""
    points = RdPoints(df, [y], x, covs, take_up, by, c, block, **bucket_args)
    return points.bandwidths(bool(take_up), p=p, kernel=kernel, bwcheck=bwcheck).drop("outcome")


def rd_sharp(df: DataFrame, y: str, x: str, covs: Sequence[str] = (), take_up: str | None = None, by: Sequence[str] = (),
             c: float = 0.0, h: float | None = None, b: float | None = None, multiples: Sequence[float] = (1.0,), p: int = 1,
             kernel: str = "triangular", bwcheck: int | None = None, block: int = M.BLOCK, **bucket_args) -> DataFrame:
    """Jump of ``y`` at the cutoff: three rows per specification and bandwidth multiple.

    Rows at the cutoff belong to the right side; rows with a missing value are left out. Without ``h``
    the MSE-optimal bandwidth is taken; a multiple of it other than 1 is a given bandwidth with ``b = h``.
    ``by`` holds specification columns enumerated by the caller: the driver holds one small state per
    specification. ``take_up`` turns the estimate into the ratio of two jumps (fuzzy).
    """
    points = RdPoints(df, [y], x, covs, take_up, by, c, block, **bucket_args)
    return points.fits(bool(take_up), True, h, b, multiples, p, kernel, bwcheck).drop("outcome")


def rd_fuzzy(df: DataFrame, y: str, x: str, take_up: str, **args) -> DataFrame:
    """Ratio of the jump of ``y`` to the jump of take-up, with linearised errors and bias correction."""
    return rd_sharp(df, y, x, take_up=take_up, **args)
