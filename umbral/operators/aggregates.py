"""Grouped aggregates. All of them combine on the map side, so a hot group costs no single task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbral.functions.scalars import col, strict_mean
from umbral.operators.joins import join_inner


def _named(by: Sequence[str] | Mapping[str, Column]) -> list[Column]:
    return [e.alias(n) for n, e in by.items()] if isinstance(by, Mapping) else [col(b).alias(b) for b in by]


def group_count(df: DataFrame, by: Sequence[str] | Mapping[str, Column], name: str = "n") -> DataFrame:
    """Rows per group; groups may be named expressions."""
    return df.groupBy(*_named(by)).agg(F.count(F.lit(1)).alias(name))


def value_counts(df: DataFrame, c: str) -> DataFrame:
    return group_count(df, [c])


def group_mean(df: DataFrame, by: Sequence[str], cols: Sequence[str], strict: bool = False) -> DataFrame:
    """Means per group; ``strict`` gives NULL where any value is missing."""
    mean = strict_mean if strict else (lambda c: F.avg(col(c)))
    return df.groupBy(*_named(by)).agg(*[mean(c).alias(c) for c in cols])


def group_sum(df: DataFrame, by: Sequence[str], c: str, name: str | None = None) -> DataFrame:
    return df.groupBy(*_named(by)).agg(F.sum(col(c)).alias(name or c))


def group_min(df: DataFrame, by: Sequence[str], c: str, name: str) -> DataFrame:
    """Smallest value per group, missing values skipped."""
    return df.groupBy(*_named(by)).agg(F.min(col(c)).alias(name))


def group_share(df: DataFrame, outer: Sequence[str], inner: Mapping[str, Column], count: str = "n", share: str = "share"):
    """Counts per (outer, inner) group and their share of the outer group; the window sees counts only."""
    counts = df.groupBy(*_named(outer), *_named(inner)).agg(F.count(F.lit(1)).alias(count))
    total = F.sum(count).over(Window.partitionBy(*[col(o) for o in outer]))
    return counts.withColumn(share, F.col(count) / total)


def range_agg(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with minimum and maximum of each column."""
    return df.agg(*[f(col(c)).alias(f"{p}_{c}") for c in cols for p, f in (("min", F.min), ("max", F.max))])


def distinct_ratio(matched: DataFrame, everything: DataFrame, key: str, approx: bool = False) -> DataFrame:
    """Distinct keys (a missing key counts as one) in two frames and their ratio, in one row.

    The exact form removes duplicates before it counts, so no task ever holds all keys.
    """
    if approx:
        a = matched.agg(F.approx_count_distinct(col(key)).alias("n_matched"))
        b = everything.agg(F.approx_count_distinct(col(key)).alias("n_all"))
    else:
        a = matched.select(col(key)).distinct().agg(F.count(F.lit(1)).alias("n_matched"))
        b = everything.select(col(key)).distinct().agg(F.count(F.lit(1)).alias("n_all"))
    return a.crossJoin(F.broadcast(b)).withColumn("rate", F.try_divide(F.col("n_matched"), F.col("n_all")))


def indicator_any(df: DataFrame, ids: Sequence[str], label: str, values: Sequence[str]) -> DataFrame:
    """One 0/1 column per listed value: 1 if the group has any row with it."""
    flags = [F.max(F.coalesce((col(label) == v).cast("int"), F.lit(0))).alias(v) for v in values]
    return df.groupBy(*_named(ids)).agg(*flags)


def pivot_wider(df: DataFrame, ids: Sequence[str], label: str, value: str, values: Sequence[str], fill=None) -> DataFrame:
    """Long to wide with a given list of labels; several values of one cell are added up."""
    out = df.groupBy(*_named(ids)).pivot(label, list(values)).agg(F.sum(col(value)))
    return out if fill is None else out.fillna(fill, subset=[str(v) for v in values])


def transpose_table(df: DataFrame, label: str, cols: Sequence[str], labels: Sequence[str], row_name: str = "row") -> DataFrame:
    """Rows to columns for a small result table: one row per listed column, one column per label."""
    long = df.unpivot([col(label)], [col(c).cast("string").alias(c) for c in cols], row_name, "_value")
    return long.groupBy(row_name).pivot(label, list(labels)).agg(F.first("_value", ignorenulls=True))


def group_min_broadcast(df: DataFrame, by: Sequence[str], c: str, name: str) -> DataFrame:
    """Group minimum on every row: aggregate and join, since a window would put a hot group in one task."""
    return join_inner(df, group_min(df, by, c, name), list(by))
