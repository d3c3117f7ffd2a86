"""Least squares, instrumental variables, heap jumps and mean differences as grouped moment sums.

Rows are only ever summed (one aggregate per pass, combined on the map side). The small linear systems
are solved on the moment rows, one per specification, in ``mapInPandas``.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from umbral.functions.distributions import p_student
from umbral.functions.scalars import col
from umbral.operators.filters import donut
from umbral.operators.joins import join_window

Term = str | tuple[str, ...]


def term_name(term: Term) -> str:
    return term if isinstance(term, str) else ":".join(term)


def term_column(term: Term) -> Column:
    """A regressor, or the product of several for an interaction."""
    parts = [term] if isinstance(term, str) else list(term)
    return reduce(lambda a, b: a * b, [col(p).cast("double") for p in parts])


def moment_sums(df: DataFrame, vectors: Sequence[Column], by: Sequence[str], extra: Sequence[Column] = ()) -> DataFrame:
    """One row per group: ``n`` and ``m``, the upper triangle (row by row) of the sums of cross products."""
    k = len(vectors)
    named = df.select(*[col(b) for b in by], *[v.alias(f"_v{i}") for i, v in enumerate(vectors)], *extra)
    named = named.dropna(subset=[f"_v{i}" for i in range(k)])
    sums = [F.sum(F.col(f"_v{i}") * F.col(f"_v{j}")).alias(f"_m{i}_{j}") for i in range(k) for j in range(i, k)]
    out = named.groupBy(*[col(b).alias(b) for b in by]).agg(F.count(F.lit(1)).alias("n"), *sums)
    m = F.array(*[F.col(f"_m{i}_{j}") for i in range(k) for j in range(i, k)])
    return out.select(*[col(b) for b in by], "n", m.alias("m"))


def unpack(m, k: int) -> np.ndarray:
    """Symmetric matrix from its upper triangle."""
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = np.asarray(m, dtype=float)
    return out + np.triu(out, 1).T


def inverse(a: np.ndarray) -> np.ndarray | None:
    """Inverse of a symmetric matrix after scaling its diagonal to one; None if singular."""
    d = np.sqrt(np.abs(np.diag(a)))
    if np.any(d == 0) or not np.all(np.isfinite(a)):
        return None
    scaled = a / np.outer(d, d)
    if np.linalg.cond(scaled) > 1e15:
        return None
    return np.linalg.inv(scaled) / np.outer(d, d)


def _by_schema(df: DataFrame, by: Sequence[str]) -> list[T.StructField]:
    return [df.schema[b] for b in by]


def _fields(spec: str) -> list[T.StructField]:
    return T.StructType.fromDDL(spec).fields


def ols(df: DataFrame, y: str, xs: Sequence[Term], by: Sequence[str] = ()) -> DataFrame:
    """Linear model with intercept per group: a row per term with estimate, se, t, p and covariances.

    ``xs`` holds column names or tuples of names (interactions). Rows with a missing value are left out.
    ``vcov`` is the term's row of the coefficient covariance matrix, in the order intercept, ``xs``.
    """
    names = ["(Intercept)", *[term_name(x) for x in xs]]
    vectors = [F.lit(1.0), *[term_column(x) for x in xs], col(y).cast("double")]
    moments = moment_sums(df, vectors, by)
    by = list(by)
    schema = T.StructType(
        _by_schema(df, by)
        + _fields("term string, estimate double, se double, t double, p double, n bigint, df bigint, vcov array<double>")
    )

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(names)
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                key, n, m = list(r[: len(by)]), r[-2], unpack(r[-1], k + 1)
                a = inverse(m[:k, :k])
                if a is None:
                    rows += [[*key, t, None, None, None, None, n, n - k, None] for t in names]
                    continue
                b = a @ m[:k, k]
                dof = n - k
                rss = max(m[k, k] - b @ m[:k, k], 0.0)
                v = a * (rss / dof) if dof > 0 else np.full((k, k), np.nan)
                for i, t in enumerate(names):
                    se = float(np.sqrt(v[i, i])) if dof > 0 else None
                    tv = b[i] / se if se else None
                    rows.append([*key, t, b[i], se, tv, p_student(tv, dof), n, dof, v[i].tolist() if dof > 0 else None])
            yield pd.DataFrame(rows, columns=schema.names).astype({"n": "int64", "df": "int64"})

    return moments.mapInPandas(solve, schema)


def heap_jump(df: DataFrame, y: str, r: str, heaps: Sequence[tuple[float, float]], name: str = "heap_point") -> DataFrame:
    """Jump of ``y`` at each heap point: ``y`` on ``1{r = heap}`` and ``r - heap`` inside the heap's window.

    All heaps are fitted in one job.
    """
    rows = join_window(df.select(col(y).alias("_y"), col(r).alias("_r")), "_r", heaps, name)
    rows = rows.withColumns({"heap": (F.col("_r") == F.col(name)).cast("double"), "R_Z": F.col("_r") - F.col(name)})
    fits = ols(rows, "_y", ["heap", "R_Z"], [name]).where(F.col("term") == "heap")
    return fits.select(name, F.col("estimate").alias("coeff"), "se", F.col("p").alias("p_value"), "n")


def iv_2sls(
    df: DataFrame, y: str, endog: str, exog: Sequence[str], instrument: str, by: Sequence[str] = ()
) -> DataFrame:
    """Just-identified two-stage least squares with HC2 errors: a row per group for the endogenous variable.

    Pass 1 sums moments and solves; pass 2 sums ``xh xh' e^2 / (1 - h)`` with the first-stage fitted
    regressors. ``by`` must be specification columns, enumerated by the caller: the solved systems, one
    small row per specification, are broadcast for pass 2.
    """
    by = list(by)
    k = len(exog) + 2
    named = df.select(
        *[col(b) for b in by],
        *[col(x).cast("double").alias(f"_x{i}") for i, x in enumerate(exog)],
        col(instrument).cast("double").alias("_z"),
        col(endog).cast("double").alias("_d"),
        col(y).cast("double").alias("_y"),
    ).dropna(subset=[*[f"_x{i}" for i in range(len(exog))], "_z", "_d", "_y"])
    shared = [F.lit(1.0), *[F.col(f"_x{i}") for i in range(len(exog))]]
    vectors = [*shared, F.col("_z"), F.col("_d"), F.col("_y")]
    moments = moment_sums(named, vectors, by)
    schema = T.StructType(
        _by_schema(df, by) + _fields("n bigint, beta array<double>, proj array<double>, bread array<double>")
    )

    def first(batches):
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                key, n, m = list(r[: len(by)]), r[-2], unpack(r[-1], k + 2)
                z = list(range(k))  # intercept, exog, instrument
                x = [*range(k - 1), k]  # intercept, exog, endogenous
                zz, zx, zy = m[np.ix_(z, z)], m[np.ix_(z, x)], m[z, k + 1]
                zi = inverse(zz)
                if zi is None or abs(np.linalg.det(zi @ zx)) < 1e-12:
                    rows.append([*key, n, None, None, None])
                    continue
                proj = zi @ zx
                bread = inverse(proj.T @ zz @ proj)
                beta = np.linalg.solve(zx, zy)
                rows.append([*key, n, beta.tolist(), proj.ravel().tolist(), bread.ravel().tolist() if bread is not None else None])
            yield pd.DataFrame(rows, columns=schema.names)

    state = moments.mapInPandas(first, schema)
    rows = named.join(F.broadcast(state), by) if by else named.crossJoin(F.broadcast(state))
    zs = [*shared, F.col("_z")]
    total = lambda parts: reduce(add, parts)
    fitted = rows.withColumns(
        {f"_h{j}": total([zs[i] * F.get("proj", F.lit(i * k + j)) for i in range(k)]) for j in range(k)}
    )
    xs = [*shared, F.col("_d")]
    fitted = fitted.withColumns(
        {
            "_e": F.col("_y") - total([xs[j] * F.get("beta", F.lit(j)) for j in range(k)]),
            "_lev": total([F.col(f"_h{i}") * F.col(f"_h{j}") * F.get("bread", F.lit(i * k + j)) for i in range(k) for j in range(k)]),
        }
    ).withColumn("_w", F.try_divide(F.col("_e") * F.col("_e"), 1 - F.col("_lev")))
    sums = [F.sum(F.col(f"_h{i}") * F.col(f"_h{j}") * F.col("_w")).alias(f"_s{i}_{j}") for i in range(k) for j in range(i, k)]
    meat = fitted.groupBy(*[col(b).alias(b) for b in by]).agg(
        F.first("n").alias("n"), F.first("beta").alias("beta"), F.first("bread").alias("bread"), *sums
    )
    packed = meat.select(
        *[col(b) for b in by], "n", "beta", "bread",
        F.array(*[F.col(f"_s{i}_{j}") for i in range(k) for j in range(i, k)]).alias("meat"),
    )
    out_schema = T.StructType(_by_schema(df, by) + _fields("coeff double, se double, `p.val` double, n bigint"))

    def second(batches):
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                key, (n, beta, bread, packed_meat) = list(r[: len(by)]), r[len(by):]
                if beta is None or bread is None:
                    rows.append([*key, None, None, None, n])
                    continue
                a = np.asarray(bread, dtype=float).reshape(k, k)
                v = a @ unpack(packed_meat, k) @ a
                se = float(np.sqrt(v[k - 1, k - 1]))
                rows.append([*key, beta[k - 1], se, p_student(beta[k - 1] / se, n - k) if se else None, n])
            yield pd.DataFrame(rows, columns=out_schema.names)

    return packed.mapInPandas(second, out_schema)


def outcome_rows(df: DataFrame, outcomes: Sequence[str], keep: Sequence[str], name: str = "outcome", value: str = "y") -> DataFrame:
    """One row per outcome with its name and value; rows without a value are left out."""
    return df.unpivot(
        [col(k) for k in keep], [col(o).cast("double").alias(o) for o in outcomes], name, value
    ).where(F.col(value).isNotNull())


def spec_grid(
    df: DataFrame, outcomes: Sequence[str], keep: Sequence[str], levels: Mapping[str, Sequence] = {}
) -> DataFrame:
    """Every row once per outcome and level combination: nested loops over specifications as data."""
    out = outcome_rows(df, outcomes, keep)
    for name, values in levels.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def donut_iv_grid(
    df: DataFrame,
    outcomes: Sequence[str],
    bandwidths: Sequence[float],
    donut_width: float,
    running: str = "size_centered",
    treated: str = "smallholder",
    instrument: str = "below_cutoff",
) -> DataFrame:
    """2SLS of each outcome for each bandwidth without the window just under the cutoff, in one job."""
    base = df.select(
        *[col(o) for o in outcomes],
        col(running).cast("double").alias("_run"),
        col(treated).cast("double").alias("_treat"),
        col(instrument).cast("double").alias("_inst"),
    ).where(donut("_run", donut_width, max(bandwidths)))
    keep = ["_run", "_treat", "_inst"]
    rows = outcome_rows(base, outcomes, keep)
    inside = F.array_compact(F.array(*[F.when(donut("_run", donut_width, b), F.lit(float(b))) for b in bandwidths]))
    rows = rows.withColumn("bw", F.explode(inside))
    fits = iv_2sls(rows, "y", "_treat", ["_run"], "_inst", ["outcome", "bw"])
    return fits.withColumn("donut", F.lit(donut_width))


def welch_t(df: DataFrame, group: str, ys: Sequence[str], groups: tuple[str, str]) -> DataFrame:
    """Difference of means with unequal variances: a row per variable, groups in alphabetical order.

    ``mean_1`` belongs to the alphabetically first group.
    """
    first, second = sorted(groups)
    rows = outcome_rows(df.where(col(group).isin(first, second)), ys, [group], "variable")
    sums = []
    for i, g in enumerate((first, second), start=1):
        v = F.when(col(group) == g, F.col("y"))
        sums += [F.count(v).alias(f"n_{i}"), F.avg(v).alias(f"mean_{i}"), F.var_samp(v).alias(f"var_{i}")]
    per = rows.groupBy("variable").agg(*sums)
    q1 = F.try_divide(F.col("var_1"), F.col("n_1"))
    q2 = F.try_divide(F.col("var_2"), F.col("n_2"))
    stats = per.withColumns(
        {
            "t": F.try_divide(F.col("mean_1") - F.col("mean_2"), F.sqrt(q1 + q2)),
            "df": F.try_divide((q1 + q2) * (q1 + q2), F.try_divide(q1 * q1, F.col("n_1") - 1) + F.try_divide(q2 * q2, F.col("n_2") - 1)),
        }
    ).select("variable", "n_1", "n_2", "mean_1", "mean_2", "t", "df")
    schema = T.StructType([*stats.schema.fields, T.StructField("p_value", T.DoubleType())])

    def add_p(batches):
        for batch in batches:
            ps = [p_student(t, d) for t, d in zip(batch["t"], batch["df"])]
            yield batch.assign(p_value=pd.Series(ps, dtype="float64", index=batch.index))

    return stats.mapInPandas(add_p, schema)
