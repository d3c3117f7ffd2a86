"""Distinct values of a running variable with the sums an estimator needs, in order and with neighbours.

An estimator never goes back to the rows: for each group of rows and distinct ``x`` the table holds the
row count, the sums of the variables (outcomes, take-up, covariates) and of their products, the
running count, and the next three distinct values on either side with their counts and sums. Ranks and
neighbours come from windows over ranges of about equal length, to which the totals of the ranges before and
a rim of three points of the adjoining ranges are added, so no window spans a whole side. Rows and points are
dealt out by their number, so that what a task holds does not grow with the table. A point of one row has the
products of its sums, which are not kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from umbral.operators.ordering import range_buckets
from umbral.session import materialise, release

NEIGHBOURS = 3
#: About how many rows or mass points a task holds; their sums and products are some hundred numbers each.
BLOCK = 50_000


def _rims(rows: DataFrame) -> DataFrame:
    """For each range the three points before and after it, which may lie in several ranges."""
    narrow = rows.select("_group", "_bucket", "x", "n", "s")
    inside = Window.partitionBy("_group", "_bucket")
    ends = [
        narrow.withColumn("_at", F.row_number().over(inside.orderBy(order))).where(F.col("_at") <= NEIGHBOURS).drop("_at")
        for order in (F.col("x").asc(), F.col("x").desc())
    ]
    ends = ends[0].unionByName(ends[1]).dropDuplicates(["_group", "_bucket", "x"])
    w, point = Window.partitionBy("_group").orderBy("x"), F.struct("x", "n", "s")
    beside = {}
    for name, step, frame in (("_before", F.lag, (-NEIGHBOURS, -1)), ("_after", F.lead, (1, NEIGHBOURS))):
        outermost = ~step("_bucket").over(w).eqNullSafe(F.col("_bucket"))
        beside[name] = F.when(outermost, F.collect_list(point).over(w.rowsBetween(*frame))).otherwise(F.array())
    rim = ends.withColumns(beside).select("_group", "_bucket", F.explode(F.concat(*beside)).alias("_point"))
    return rim.select("_group", "_bucket", "_point.*")


def in_order(points: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    """Add ``cum_n`` (rows at or below), ``rank`` (distinct values at or below) and ``near``: ``x``, ``n`` and the
    sums ``s`` of the three next distinct values on the left, nearest first, and then on the right, one after the
    other in one array; NaN where there is none. The points are cut into so many ranges."""
    rows = range_buckets(points, keys, ["x"], buckets)
    parts = ["_group", "_bucket"]
    totals = rows.groupBy(*parts).agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_rank"))
    before = Window.partitionBy("_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*parts, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("_n", "_rank")])
    rim = _rims(rows).withColumns({"q": F.lit(None).cast(rows.schema["q"].dataType), "_home": F.lit(False)})
    both = rows.select(*parts, "x", "n", "s", "q", F.lit(True).alias("_home")).unionByName(rim).repartition(buckets, *parts)
    both = both.withColumn("_own", F.concat(F.array(F.col("x"), F.col("n").cast("double")), F.col("s")))
    w = Window.partitionBy(*parts).orderBy("x")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    beside = [step("_own", j).over(w) for step in (F.lag, F.lead) for j in range(1, NEIGHBOURS + 1)]
    found = both.withColumns({
        "_n": F.sum(F.when(F.col("_home"), F.col("n"))).over(so_far),
        "_rank": F.count(F.when(F.col("_home"), 1)).over(so_far),
        **{f"_near{i}": c for i, c in enumerate(beside)},
    }).where("_home")
    missing = F.concat(F.array(F.lit(float("nan")), F.lit(0.0)), F.transform("s", lambda _: F.lit(float("nan"))))
    near = F.concat(*[F.coalesce(F.col(f"_near{i}"), missing) for i in range(len(beside))])
    return found.join(offsets, parts).select(
        *[F.col("_group").getField(k).alias(k) for k in keys], "x", "n", "s", "q",
        *[(F.col(c) + F.col(f"{c}_before")).alias(name) for c, name in (("_n", "cum_n"), ("_rank", "rank"))], near.alias("near"),
    )


def neighbour_set(x, n, right: bool, reach: float, near_x, near_n):
    """Which of the six neighbours (rows of ``near_x``, ``near_n``) are in the set of each mass point, and the
    number of rows of the set, the point's own included.

    A neighbour is in the set if it lies on the same side with ``|x|`` below ``reach`` and fewer than three
    other rows are strictly nearer; equally near points enter together. Missing neighbours are NaN.
    """
    import numpy as np

    with np.errstate(invalid="ignore"):
        ok = ((near_x >= 0) == right) & (np.abs(near_x) < reach) & ~np.isnan(near_x)
        distance = np.where(ok, np.abs(near_x - x), np.inf)
    count = np.where(ok, near_n, 0.0)
    take = np.empty_like(ok)
    for m in range(len(near_x)):
        nearer = ((distance < distance[m]) * count).sum(axis=0)
        take[m] = ok[m] & (n - 1 + nearer < NEIGHBOURS)
    return take, n + (take * count).sum(axis=0)


def residuals(v, n, sums, products, near_sums, take, size):
    """Summed squared nearest-neighbour residuals of the combination ``v`` of the variables, per mass point.

    With ``J = N - 1`` neighbours a row's residual is ``sqrt(J/(J+1)) * (d - mean of the others)``; over a
    mass point only its count, sum and square sum and the set's count and sum are needed. A point without
    any neighbour gives 0. ``products``: those of each pair of variables, row by row of the upper triangle.
    """
    import numpy as np

    k = len(v)
    weights = np.array([v[i] * v[j] * (1 if i == j else 2) for i in range(k) for j in range(i, k)])
    e, q = v @ sums, weights @ products
    other = sum(np.where(take[m], v @ np.where(take[m], near_sums[m], 0.0), 0.0) for m in range(len(take)))
    t = e + other
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(size > 1, (size * size * q - 2 * size * t * e + n * t * t) / (size * (size - 1)), 0.0)


def product_pairs(outcomes: int, variables: int) -> list[tuple[int, int]]:
    """Pairs of variables whose products are summed: no outcome with another outcome."""
    return [(i, j) for i in range(variables) for j in range(i, variables) if i == j or j >= outcomes]


def all_products(sums, kept, present, pairs):
    """Products of each point: those kept (rows in order, of the points where ``present``), else those of its sums."""
    import numpy as np

    left, right = np.array(pairs, int).reshape(-1, 2).T
    out = sums[:, left] * sums[:, right]
    out[present] = kept
    return out


def prepare(
    rows: DataFrame, outcomes: Sequence[str], shared: Sequence[str], keys: Sequence[str], block: int = BLOCK, x: str = "x", buckets: int | None = None
) -> tuple[DataFrame, list[int]]:
    """Mass points in order with neighbours, one table for all outcomes, and the class of each outcome.

    Rows carry all variables, so a row is there once however many outcomes it has. Outcomes that are missing
    in the same rows are a class; a class has mass points of its own (column ``_class``), since a missing
    value changes which points are there. ``s`` has the sums of the outcomes and then the shared variables,
    ``q`` those of the products of :func:`product_pairs`, null for a point of one row.
    The driver holds the distinct patterns of missing outcomes. A task has about ``block`` rows or points; the
    rows, the points and these in order are written once to the shared folder.
    """
    m, names = len(outcomes), [*outcomes, *shared]
    missing = [F.col(o).isNull() | F.isnan(o) for o in outcomes]
    mask = sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(missing)), F.lit(0)).cast("long")
    filled = [F.when(c, F.lit(0.0)).otherwise(F.col(o)) for c, o in zip(missing, outcomes)] + [F.col(z) for z in shared]
    base = rows.where(~F.isnan(x)).select(*keys, F.col(x).alias("x"), mask.alias("_mask"), *[c.alias(f"d{i}") for i, c in enumerate(filled)])
    base = materialise(base.where(F.col("_mask") < (1 << m) - 1) if m else base)
    masks = {r["_mask"]: r["count"] for r in base.groupBy("_mask").count().collect()}
    present = [frozenset(k for k in masks if not k >> i & 1) for i in range(m)]
    kinds = list(dict.fromkeys(present))
    number = sum(masks[k] for rows_of in kinds for k in rows_of)
    parts = -(-number // block) or 1
    # a hot value's rows are dealt out as well, and meet after each task has added its own
    dealt = base.withColumn("_deal", F.monotonically_increasing_id()).repartition(parts, "_deal").drop("_deal")
    if len(masks) > 1:
        of = F.lit(None).cast("array<int>")
        for k in masks:
            of = F.when(F.col("_mask") == k, F.array(*[F.lit(c) for c, rows_of in enumerate(kinds) if k in rows_of]).cast("array<int>")).otherwise(of)
        dealt = dealt.withColumn("_class", F.explode(of))
    else:
        dealt = dealt.withColumn("_class", F.lit(0))
    pairs = product_pairs(m, len(names))
    sums = F.array(*[F.sum(f"d{i}") for i in range(len(names))])
    products = F.array(*[F.sum(F.col(f"d{i}") * F.col(f"d{j}")) for i, j in pairs])
    own = [*keys, "_class"]
    points = dealt.groupBy(*own, "x").agg(F.count(F.lit(1)).alias("n"), sums.alias("s"), products.alias("q"))
    points = materialise(points.withColumn("q", F.when(F.col("n") > 1, F.col("q"))))
    release(base)
    found = materialise(in_order(points, own, buckets or parts))
    release(points)
    return found, [kinds.index(p) for p in present]
