"""Order-dependent steps without an un-partitioned window.

All rows are dealt into contiguous ranges of (group, order value) of about equal size, so a large group
is cut into as many ranges as its rows need and small groups share one. Running sums are taken per
group and range and the totals of the earlier ranges are added afterwards, so no task ever sees a whole
group. Ties always share a range. The ranges are written once to the shared folder: every later step,
and a re-run task, sees the same cuts. The results are exact; the cuts only decide where work is done.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbral.functions.scalars import col
from umbral.session import materialise

def _group(keys: Sequence[str]) -> Column:
    """All keys as one never-NULL struct, so grouping, windows and joins share one partitioning."""
    return F.struct(*[col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))


def range_buckets(df: DataFrame, keys: Sequence[str], order: Sequence[str], buckets: int | None = None) -> DataFrame:
    """Add ``_group`` (the keys) and ``_bucket`` (range number, rising within the group).

    Spark's range partitioning samples the rows, cuts at sampled values and finds a row's range by binary
    search, so the cost per row hardly depends on the number of ranges; without ``buckets`` the session's
    shuffle partitions apply, fewer for small inputs. The keys are sent and written in ``_group`` only.
    """
    inside = [k for k in keys if k in df.columns and k not in set(order)]
    rows = df.withColumn("_group", _group(keys)).select(*[col(c) for c in df.columns if c not in set(inside)], "_group")
    by = [F.col("_group"), *[col(o) for o in order]]
    dealt = rows.repartitionByRange(buckets, *by) if buckets else rows.repartitionByRange(*by)
    written = materialise(dealt.withColumn("_bucket", F.spark_partition_id()))
    own = [F.col("_group").getField(c).alias(c) if c in set(inside) else col(c) for c in df.columns]
    return written.select(*own, "_group", "_bucket")


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column],
    reverse: bool = False,
    **bucket_args,
) -> DataFrame:
    """Inclusive running sums per group in the order of the given columns, in two levels.

    ``reverse`` sums from the far end. The order should be total, or rows with equal order values get
    their sums in arbitrary sequence.
    """
    rows = range_buckets(df, keys, order, **bucket_args)
    names = list(sums)
    rows = rows.withColumns({f"_in_{n}": e for n, e in sums.items()})
    directed = [col(o).desc() if reverse else col(o).asc() for o in order]
    inside = Window.partitionBy("_group", "_bucket").orderBy(*directed).rowsBetween(Window.unboundedPreceding, 0)
    last = F.col("_bucket").desc() if reverse else F.col("_bucket").asc()
    before = Window.partitionBy("_group").orderBy(last).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_group", "_bucket").agg(*[F.sum(f"_in_{n}").alias(f"_t_{n}") for n in names])
    offsets = totals.select(
        "_group", "_bucket", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in names]
    )
    local = rows.withColumns({f"_s_{n}": F.sum(f"_in_{n}").over(inside) for n in names})
    out = local.join(offsets, ["_group", "_bucket"])
    return out.select(
        *[col(c) for c in df.columns if c not in set(names)],
        *[(F.col(f"_s_{n}") + F.col(f"_o_{n}")).alias(n) for n in names],
    )


def add_row_id(df: DataFrame, name: str, order: Sequence[str] | None = None, **bucket_args) -> DataFrame:
    """Running row id from 1 in a stated total order; without an order, a unique but gapped id."""
    if order is None:
        return df.withColumn(name, F.monotonically_increasing_id() + 1)
    return running_sums(df, [], order, {name: F.lit(1)}, **bucket_args)


def which_rows(df: DataFrame, condition: Column, order: Sequence[str], name: str = "position", **bucket_args) -> DataFrame:
    """Positions, in the stated order, of the rows meeting a condition."""
    return add_row_id(df.withColumn("_hit", condition), name, order, **bucket_args).where("_hit").drop("_hit")


def ecdf(df: DataFrame, x: str, keys: Sequence[str] = (), **bucket_args) -> DataFrame:
    """Distinct values per group with their count, the running count and the share at or below."""
    points = df.where(col(x).isNotNull()).groupBy(*[col(k).alias(k) for k in keys], col(x).alias(x))
    points = points.agg(F.count(F.lit(1)).alias("n"))
    total = points.groupBy(_group(keys).alias("_g")).agg(F.sum("n").alias("_total"))
    run = running_sums(points, keys, [x], {"cum_n": F.col("n")}, **bucket_args)
    out = run.withColumn("_g", _group(keys)).join(total, "_g")
    return out.withColumn("share", F.col("cum_n") / F.col("_total")).drop("_g", "_total")


def nearest_by_key(
    probes: DataFrame, targets: DataFrame, keys: Sequence[str], value: str, payload: Sequence[str], rank=None, **bucket_args
) -> DataFrame:
    """For each probe ``(keys, value)`` the nearest target value at or below it and above it, same keys.

    Both inputs must be distinct in ``(keys, value)``. Returns one row per probe and target found with
    ``target_value`` and the payload. ``rank`` (of a target, a struct of ``v`` and the payload, and of the probe's
    value) keeps only the one of the two whose rank is less, so that there is one row per probe. The cost is one sort of
    both inputs, not their product. A hot key is cut into ranges whose nearest outer targets are carried over; a key
    that is in one range needs none, and no more than the number of ranges are in several.
    """
    as_target = F.struct(col(value).alias("v"), *[col(p).alias(p) for p in payload])
    t = targets.select(*[col(k) for k in keys], col(value), F.lit(0).alias("_probe"), as_target.alias("_t"))
    empty = F.lit(None).cast(t.schema["_t"].dataType)
    p = probes.select(*[col(k) for k in keys], col(value), F.lit(1).alias("_probe"), empty.alias("_t"))
    rows = range_buckets(t.unionByName(p), keys, [value], **bucket_args)
    # both ways a running frame: one that reaches to the end is summed anew for each row, which is quadratic
    last = F.last("_t", ignorenulls=True)
    up = Window.partitionBy("_group", "_bucket").orderBy(col(value), F.col("_probe")).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("_group", "_bucket").orderBy(col(value).desc(), F.col("_probe").desc()).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({"_prev": last.over(up), "_next": last.over(down)}).where(F.col("_probe") == 1)
    spans = rows.groupBy("_group").agg(F.min("_bucket").alias("_first"), F.max("_bucket").alias("_last"))
    spans = spans.where(F.col("_first") < F.col("_last")).select(F.col("_group").alias("_cut"))
    parted = rows.join(F.broadcast(spans), F.col("_group").eqNullSafe(F.col("_cut")), "left_semi")
    ends = parted.groupBy("_group", "_bucket").agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"))
    ranges, back = (Window.partitionBy("_group").orderBy(o) for o in (F.col("_bucket").asc(), F.col("_bucket").desc()))
    carry = ends.select(
        F.col("_group").alias("_of"),
        F.col("_bucket").alias("_at"),
        F.last("_hi", ignorenulls=True).over(ranges.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.last("_lo", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)).alias("_after"),
    )
    near = local.join(F.broadcast(carry), F.col("_group").eqNullSafe(F.col("_of")) & (F.col("_bucket") == F.col("_at")), "left")
    both = F.array_compact(F.array(F.coalesce(F.col("_prev"), F.col("_before")), F.coalesce(F.col("_next"), F.col("_after"))))
    if rank is None:
        both = near.withColumn("_found", F.explode(both))
    else:
        best = F.array_min(F.transform(both, lambda t: F.struct(rank(t, col(value)).alias("r"), t.alias("t"))))
        both = near.withColumn("_found", best["t"]).where(F.col("_found").isNotNull())
    return both.select(
        *[col(k) for k in keys],
        col(value),
        F.col("_found.v").alias("target_value"),
        *[F.col("_found").getField(p).alias(p) for p in payload],
    )
