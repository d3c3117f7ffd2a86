"""One winner per group, group extremes, row numbers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbral.functions.scalars import col
from umbral.operators.aggregates import group_min_broadcast


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row per key in a stated total order.

    The rank filter is planned with a group limit before the shuffle, so each map task sends at most
    one row per key and a hot key stays small.
    """
    w = Window.partitionBy(*[col(k) for k in keys]).orderBy(*[o if isinstance(o, Column) else col(o) for o in order])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def best_per_group(
    df: DataFrame,
    keys: Sequence[str],
    rank: Sequence[Column],
    ties: Sequence[str],
    null_policy: str = "drop_group",
) -> DataFrame:
    """Winner of a chain of group filters, each keeping the rows with the smallest rank value.

    ``rank`` lists ascending expressions, ``ties`` the columns that settle what is left. A missing
    rank value drops the whole group (``drop_group``) or loses to any other (``skip``). It is one
    ``min`` of a struct: combined on the map side, one shuffle, no sort of a hot group. Under
    ``drop_group`` a missing value sorts first, wins, and is removed with its group.
    """
    ranks = []
    for i, r in enumerate(rank):
        if null_policy == "skip":
            ranks.append(r.isNull().alias(f"n{i}"))
        ranks.append(r.alias(f"r{i}"))
    payload = [c for c in df.columns if c not in set(keys)]
    ordered = [c for c in ties if c in payload] + [c for c in payload if c not in set(ties)]
    best = F.min(F.struct(*ranks, F.struct(*[col(c) for c in ordered]).alias("row"))).alias("_best")
    out = df.groupBy(*[col(k).alias(k) for k in keys]).agg(best)
    if null_policy == "drop_group" and ranks:
        out = out.where(reduce(and_, [F.col(f"_best.r{i}").isNotNull() for i in range(len(rank))]))
    return out.select(*[col(c) if c in set(keys) else F.col("_best.row").getField(c).alias(c) for c in df.columns])


def filter_group_extreme(df: DataFrame, by: Sequence[str], c: str, also: Column | None = None) -> DataFrame:
    """All rows equal to their group's minimum (missing values skipped), or meeting the other condition."""
    out = group_min_broadcast(df, by, c, "_min")
    keep = F.coalesce(col(c) == F.col("_min"), F.lit(False))
    if also is not None:
        keep = keep | F.coalesce(also, F.lit(False))
    return out.where(keep).select(*[col(x) for x in df.columns])


def dedupe_keys(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row per combination of the key columns."""
    return first_per_key(df, keys, order)


def minmax_key(cols: Sequence[str]) -> Column:
    """Text of the row-wise maximum followed by the row-wise minimum, compared as text; ``NA`` if any is missing."""
    texts = [col(c).cast("string") for c in cols]
    present = reduce(and_, [t.isNotNull() for t in texts])
    return F.when(present, F.concat(F.greatest(*texts), F.least(*texts))).otherwise(F.lit("NANA"))


def dedupe_minmax(df: DataFrame, cols: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row per max/min text of the listed columns; different rows can share that key."""
    return first_per_key(df.withColumn("_mm", minmax_key(cols)), ["_mm"], order).drop("_mm")


def order_estimates(df: DataFrame, estimate: str, order: str = "asis", seq: str = "spec_seq", name: str = "position") -> DataFrame:
    """Position of each row of a small result table: as is, increasing or decreasing.

    Meant for result tables whose size is the number of specifications: the window has no partition.
    """
    keys = {
        "asis": [col(seq)],
        "increasing": [col(estimate).asc_nulls_last(), col(seq)],
        "decreasing": [col(estimate).desc_nulls_last(), col(seq)],
    }
    if order not in keys:
        raise ValueError(f"order must be one of {sorted(keys)}, not {order!r}")
    return df.withColumn(name, F.row_number().over(Window.orderBy(*keys[order])))
