"""The data behind the charts: binned means, lines, histograms, treatment shares, specification curves."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from umbral.functions.scalars import bin_count, bin_edges, bin_end, bin_mid, col, z_value
from umbral.operators.aggregates import group_share
from umbral.operators.filters import cross_1row
from umbral.operators.joins import join_inner
from umbral.operators.ranking import order_estimates
from umbral.operators.regression import outcome_rows
from umbral.session import materialise


def binned_means(df: DataFrame, x: str, ys: Sequence[str], window: float = 6, bins: int | None = None) -> DataFrame:
    """Mean of ``x`` and of each outcome per equal bin of the observed range inside the window."""
    bins = bins if bins is not None else int(2 * window)
    rows = df.where(col(x).between(-window, window)).select(col(x), *[col(y) for y in ys])
    ranged = cross_1row(rows, rows.agg(F.min(col(x)).alias("_lo"), F.max(col(x)).alias("_hi")))
    binned = ranged.withColumn("bin", bin_count(x, bins, F.col("_lo"), F.col("_hi")))
    return binned.groupBy("bin").agg(*[F.avg(col(c)).alias(c) for c in (x, *ys)], F.count(F.lit(1)).alias("n"))


def side_line(df: DataFrame, x: str, ys: Sequence[str], by: Sequence[str] = (), c: float = 0.0) -> DataFrame:
    """Straight line per outcome, side of the cutoff (at it: left) and colour group."""
    rows = outcome_rows(df.where(col(x).isNotNull()), ys, [x, *by])
    side = F.when(col(x) <= c, F.lit("left")).otherwise(F.lit("right"))
    return rows.groupBy("outcome", side.alias("side"), *[col(b).alias(b) for b in by]).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("y", col(x)).alias("slope"), F.regr_intercept("y", col(x)).alias("intercept")
    )


def histogram(
    df: DataFrame,
    x: str,
    bins: int = 30,
    width: float | None = None,
    boundary: float = 0.0,
    limits: tuple[float, float] | None = None,
) -> DataFrame:
    """Counts per bin: ``bins`` equal ones over the observed range, or fixed ``width`` from ``boundary``.

    Bins are closed on the right; rows outside ``limits`` are left out first.
    """
    rows = df.where(col(x).between(*limits)) if limits else df.where(col(x).isNotNull())
    rows = rows.select(col(x).cast("double").alias("_x"))
    if width is not None:
        index = F.ceil((F.col("_x") - F.lit(float(boundary))) / F.lit(float(width)))
        counts = rows.groupBy(index.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        hi = F.col("bin") * F.lit(float(width)) + F.lit(float(boundary))
        return counts.withColumns({"lo": hi - F.lit(float(width)), "hi": hi})
    ranged = cross_1row(rows, rows.agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi")))
    index = bin_count("_x", bins, F.col("_lo"), F.col("_hi")).cast("bigint")
    counts = ranged.groupBy(index.alias("bin"), "_lo", "_hi").agg(F.count(F.lit(1)).alias("n"))
    step = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    return counts.select("bin", "n", (F.col("_lo") + (F.col("bin") - 1) * step).alias("lo"), (F.col("_lo") + F.col("bin") * step).alias("hi"))


def treatment_by_bin(
    df: DataFrame, x: str, treated: Column, lo: float, hi: float, width: float, cutoff: float = 0.0
) -> DataFrame:
    """Treated and untreated rows per right-closed bin, the treated share, the bin's middle and its side."""
    binned = df.select(bin_edges(x, lo, hi, width).alias("bin"), treated.alias("_t")).where(F.col("bin").isNotNull())
    counts = binned.groupBy("bin").agg(
        F.count(F.when(F.col("_t"), F.lit(1))).alias("small_yes"), F.count(F.when(~F.col("_t"), F.lit(1))).alias("small_no")
    )
    middle = bin_mid("bin", lo, width)
    return counts.withColumns(
        {
            "prob_smallholder": F.try_divide(F.col("small_yes"), F.col("small_yes") + F.col("small_no")),
            "bin_mid": middle,
            "below_cutoff": middle <= cutoff,
        }
    )


def count_by_bin(df: DataFrame, x: str, lo: float, hi: float, width: float, window: tuple[float, float]) -> DataFrame:
    """Rows per right-closed bin whose end lies in the window."""
    binned = df.select(bin_edges(x, lo, hi, width).alias("bin")).where(F.col("bin").isNotNull())
    ends = binned.withColumn("bin_end", bin_end("bin", lo, width)).where(F.col("bin_end").between(*window))
    return ends.groupBy("bin", "bin_end").agg(F.count(F.lit(1)).alias("n"))


def compliance(df: DataFrame, contest: str, size: str, cutoff: str) -> DataFrame:
    """Share of each contest type at or under the size limit."""
    return group_share(df, [contest], {"below": col(size) <= col(cutoff)}, "count", "prop")


def jitter_free_points(df: DataFrame, x: str, awarded: str) -> DataFrame:
    """Points of the award indicator against the score."""
    return df.select(col(x), col(awarded).cast("int").alias(awarded))


def effect_plot_data(
    fits: DataFrame, treated: str, moderator: str, terms: Sequence[str], lo: float | Column, hi: float | Column, points: int = 25,
    z: float = 1.959963984540054,
) -> DataFrame:
    """Effect of the treatment along the moderator with a 95 % band, from a fit with their product.

    ``fits`` is the output of ``ols``; ``terms`` its term names in order. ``lo`` and ``hi`` may be columns
    that are the same in all rows of ``fits``.
    """
    product = f"{treated}:{moderator}"
    at = {t: i for i, t in enumerate(terms)}
    pick = lambda t: F.first(F.when(F.col("term") == t, F.struct("estimate", "vcov")), ignorenulls=True)
    ends = [F.max(v if isinstance(v, Column) else F.lit(v)).cast("double").alias(n) for n, v in (("_lo", lo), ("_hi", hi))]
    one = fits.agg(pick(treated).alias("a"), pick(product).alias("b"), *ends)
    grid = one.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.col("_lo") + F.col("_i") * ((F.col("_hi") - F.col("_lo")) / (points - 1))
    v11 = F.get("a.vcov", F.lit(at[treated]))
    v33 = F.get("b.vcov", F.lit(at[product]))
    v13 = F.get("a.vcov", F.lit(at[product]))
    out = grid.select(x.alias("xvals"), "a", "b").withColumns(
        {
            "yvals": F.col("a.estimate") + F.col("b.estimate") * F.col("xvals"),
            "se": F.sqrt(v11 + F.col("xvals") * F.col("xvals") * v33 + 2 * F.col("xvals") * v13),
        }
    )
    return out.select(
        "xvals", "yvals", (F.col("yvals") - z * F.col("se")).alias("lower"), (F.col("yvals") + z * F.col("se")).alias("upper")
    )


def sort_levels(levels: Sequence[float]) -> list[float]:
    """Confidence levels, narrow band first."""
    if not 1 <= len(levels) <= 2:
        raise ValueError("one or two confidence levels")
    return sorted(levels)


def spec_curve(
    specs: DataFrame,
    labels: Mapping[str, Sequence[str]],
    estimate: str = "estimate",
    se: str = "se",
    seq: str = "spec_seq",
    ci: Sequence[float] = (0.90, 0.95),
    group_size: int | Sequence[int] = 1,
    order: str = "asis",
    highlight: Column | None = None,
    reference: float = 0.0,
) -> DataFrame:
    """Layout of a specification curve: order, x position with gaps, bands, indicator states, y range.

    ``specs`` is a result table (one row per specification) with one boolean column per label;
    ``labels`` groups the label columns into panels. States are yes, no, missing and highlighted.
    """
    types = dict(specs.dtypes)
    for c in (estimate, se):
        if types[c] not in {"double", "float", "int", "bigint"} and not types[c].startswith("decimal"):
            raise TypeError(f"{c} is not numeric")
    df = order_estimates(specs, estimate, order, seq, "position")
    pos = F.col("position")
    if isinstance(group_size, int):
        gap = F.ceil(pos / F.lit(float(group_size))) - 1 if group_size > 1 else F.lit(0)
    else:
        ends = [sum(group_size[: i + 1]) for i in range(len(group_size))]
        gap = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e < pos))
    marked = F.coalesce(highlight, F.lit(False)) if highlight is not None else F.lit(False)
    exprs = {"x": (pos + gap).cast("int"), "highlighted": marked}
    for i, level in enumerate(sort_levels(ci), start=1):
        half = F.lit(z_value(level)) * col(se)
        exprs[f"l{i}"], exprs[f"h{i}"] = col(estimate) - half, col(estimate) + half
    df = df.withColumns(exprs)
    states = {
        name: F.when(col(name).isNull(), "missing").when(col(name) & F.col("highlighted"), "highlighted").when(col(name), "yes").otherwise("no")
        for group in labels.values()
        for name in group
    }
    df = df.withColumns(states)
    outer = len(list(ci))
    everything = Window.partitionBy()
    lo = F.least(F.min(f"l{outer}").over(everything), F.lit(float(reference)))
    hi = F.greatest(F.max(f"h{outer}").over(everything), F.lit(float(reference)))
    return df.withColumns({"ymin": lo - (hi - lo) / 10, "ymax": hi + (hi - lo) / 10})


def label_rows(labels: Mapping[str, Sequence[str]]) -> list[tuple[str, str, int, int]]:
    """``(panel, label, label row, panel row)`` of the lower part: each panel takes one row for its name."""
    out, row = [], 1
    for panel, names in labels.items():
        head, row = row, row + 1
        for name in names:
            out.append((panel, name, row, head))
            row += 1
    return out


#: Mass points that a task sets against all grid points at a time.
POINTS_AT_ONCE = 2048


def _per_point(mass: DataFrame, states: dict[tuple, np.ndarray], keys: Sequence[str], ddl: str, add: Callable, finish: Callable) -> DataFrame:
    """One pass over the mass points: ``add(held, x, n, s, state)`` adds some points of a group to what the task holds of
    the group (None at first) and returns it, ``finish(held)`` gives rows for the group's grid points.

    The driver holds a few numbers for each grid point. A task works on few points at a time; what it holds and its
    result, given once, are a row for each grid point and cell at most, however many points it reads.
    """
    schema = T.StructType([*[mass.schema[k] for k in keys], *T.StructType.fromDDL(ddl).fields])

    def run(batches):
        held = {}
        for b in batches:
            for key, g in b.groupby(list(keys), dropna=False, sort=False):
                key = tuple(None if pd.isna(v) else v for v in key)
                x, n, s = (g[c].to_numpy() for c in ("_x", "_n", "_s"))
                for i in range(0, len(x), POINTS_AT_ONCE):
                    own = slice(i, i + POINTS_AT_ONCE)
                    held[key] = add(held.get(key), x[own], n[own], s[own], states[key])
        for key, own in held.items():
            out = pd.DataFrame(finish(own))
            for k, v in zip(keys, key):
                out[k] = v
            yield out[schema.names]

    return mass.mapInPandas(run, schema)


def _order_statistics(mass: DataFrame, wanted: dict[tuple, np.ndarray], keys: Sequence[str], cells: int) -> dict[tuple, np.ndarray]:
    """Distance of the k-th nearest row from each grid point; ``wanted``: per group, rows of (point, k).

    A bracket around the wanted distance is counted in ``cells`` equal cells per pass and narrowed to the
    distances that occur in the cell with the wanted rank, until only one is left. Memory is bounded by
    the cells, and every pass divides the bracket by their number, so a handful of passes are exact.
    """
    # per group, for each wanted distance: point, rank, ends of the bracket, rows nearer than the bracket
    states = {key: np.column_stack([v, np.zeros(len(v)), np.full(len(v), np.inf), np.zeros(len(v))]) for key, v in wanted.items()}

    def farthest(held, x, n, s, state):
        most = np.abs(state[:, 0] - np.array([[x.min()], [x.max()]])).max(axis=0)
        return most if held is None else np.maximum(held, most)

    def farthest_rows(held):
        return {"_w": np.arange(len(held)), "_most": held}

    for r in _per_point(mass, states, keys, "_w int, _most double", farthest, farthest_rows).groupBy(*keys, "_w").agg(F.max("_most").alias("_most")).collect():
        states[tuple(r[k] for k in keys)][r["_w"], 3] = r["_most"]

    def count(held, x, n, s, state):
        if held is None:
            shape = (len(state), cells)
            held = np.zeros(shape), np.full(shape, np.inf), np.full(shape, -np.inf)
        for w in np.flatnonzero(state[:, 2] < state[:, 3]):
            point, _, low, high, _ = state[w]
            d = np.abs(x - point)
            inside = (d >= low) & (d <= high)
            d = d[inside]
            if not len(d):
                continue
            cell = np.minimum(np.floor((d - low) / (high - low) * cells), cells - 1).astype(np.int64)
            held[0][w] += np.bincount(cell, n[inside], cells)
            np.minimum.at(held[1][w], cell, d)
            np.maximum.at(held[2][w], cell, d)
        return held

    def count_rows(held):
        w, cell = np.nonzero(held[0])
        return {"_w": w, "_cell": cell} | {c: v[w, cell] for c, v in zip(("_n", "_least", "_most"), held)}

    while any((s[:, 2] < s[:, 3]).any() for s in states.values()):
        counts = _per_point(mass, states, keys, "_w int, _cell int, _n double, _least double, _most double", count, count_rows)
        counts = counts.groupBy(*keys, "_w", "_cell").agg(F.sum("_n").alias("_n"), F.min("_least").alias("_least"), F.max("_most").alias("_most"))
        up_to = Window.partitionBy(*keys, "_w").orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
        ranks = F.create_map(*[x for i, (key, s) in enumerate(states.items()) for x in (F.lit(i), F.array(*[F.lit(float(v)) for v in s[:, 1] - s[:, 4]]))])
        group = reduce(lambda out, i: F.when(_is_group(keys, i[1]), F.lit(i[0])).otherwise(out), enumerate(states), F.lit(-1))
        rank = F.get(F.try_element_at(ranks, group), F.col("_w"))
        counts = counts.withColumns({"_cum": F.sum("_n").over(up_to), "_rank": rank})
        for r in counts.where((F.col("_cum") >= F.col("_rank")) & (F.col("_cum") - F.col("_n") < F.col("_rank"))).collect():  # one for each distance
            state = states[tuple(r[k] for k in keys)][r["_w"]]
            state[2:] = r["_least"], r["_most"], state[4] + r["_cum"] - r["_n"]
    return {key: s[:, 2] for key, s in states.items()}


def _is_group(keys: Sequence[str], values: Sequence) -> Column:
    return reduce(lambda a, b: a & b, [col(k).eqNullSafe(F.lit(v)) for k, v in zip(keys, values)])


def side_smooth(
    df: DataFrame, x: str, y: str, by: Sequence[str] = (), c: float = 0.0, points: int = 80, span: float = 0.75, cells: int = 1024
) -> DataFrame:
    """Local quadratic curve per side of the cutoff (and group) on an even grid, tricube weights.

    Rows are reduced to distinct ``x`` before they meet the grid. The band at a grid point is the
    distance that reaches the nearest ``span`` share of the rows, interpolated between two ranks; both
    are exact at any number of distinct values, ``cells`` only sets how fast they are found.
    """
    side = F.when(col(x) <= c, F.lit("left")).otherwise(F.lit("right"))
    rows = df.where(col(x).isNotNull() & col(y).isNotNull())
    keys = ["side", *by]
    mass = rows.groupBy(side.alias("side"), *[col(b).alias(b) for b in by], col(x).cast("double").alias("_x")).agg(
        F.count(F.lit(1)).cast("double").alias("_n"), F.sum(col(y).cast("double")).alias("_s")
    )
    mass = materialise(mass)
    spread = mass.groupBy(*keys).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.sum("_n").alias("_rows")).collect()  # a row for each side
    grid, wanted, ats = {}, {}, {}
    for r in spread:
        key = tuple(r[k] for k in keys)
        grid[key] = r["_lo"] + np.arange(points) * (r["_hi"] - r["_lo"]) / float(points - 1)
        ats[key] = at = (r["_rows"] - 1) * float(span)
        wanted[key] = np.array([(x, k) for x in grid[key] for k in (np.floor(at) + 1, np.ceil(at) + 1)])
    found = _order_statistics(mass, wanted, keys, cells)
    widths = {}
    for key, d in found.items():
        share = ats[key] - np.floor(ats[key])
        widths[key] = np.column_stack([grid[key], d[0::2] * (1 - share) + d[1::2] * share])

    names = [f"_p{i}" for i in range(5)] + [f"_r{i}" for i in range(3)]

    def moments(held, x, n, s, state):
        """Sums of the weight times powers of the scaled distance, and those times ``y``."""
        with np.errstate(divide="ignore", invalid="ignore"):
            u = (x[None, :] - state[:, :1]) / state[:, 1:]
            k = np.where(np.abs(u) < 1, (1 - np.abs(u) ** 3) ** 3, 0.0)
        u = np.where(k > 0, u, 0.0)
        out = {}
        for i in range(5):
            out[f"_p{i}"] = k @ n
            if i < 3:
                out[f"_r{i}"] = k @ s
            k = k * u
        return out if held is None else {c: held[c] + out[c] for c in names}

    def moment_rows(held):
        return {"_i": np.arange(len(held["_p0"]))} | held

    sums = _per_point(mass, widths, keys, "_i int, " + ", ".join(f"{c} double" for c in names), moments, moment_rows)
    m = sums.groupBy(*keys, "_i").agg(*[F.sum(c).alias(c) for c in names]).where("_p0 > 0")
    rows = [(*key, i, float(x)) for key, xs in grid.items() for i, x in enumerate(xs)]
    at_x = df.sparkSession.createDataFrame(rows, T.StructType([*[mass.schema[k] for k in keys], *T.StructType.fromDDL("_i int, xvals double").fields]))
    m = join_inner(m, at_x, [*keys, "_i"])
    p = [F.col(f"_p{i}") for i in range(5)]
    r = [F.col(f"_r{i}") for i in range(3)]
    det = p[0] * (p[2] * p[4] - p[3] * p[3]) - p[1] * (p[1] * p[4] - p[3] * p[2]) + p[2] * (p[1] * p[3] - p[2] * p[2])
    top = r[0] * (p[2] * p[4] - p[3] * p[3]) - p[1] * (r[1] * p[4] - p[3] * r[2]) + p[2] * (r[1] * p[3] - p[2] * r[2])
    return m.select(*[col(k) for k in keys], "xvals", F.try_divide(top, det).alias("yvals"))
