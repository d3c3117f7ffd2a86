"""Row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbral.functions.scalars import col
from umbral.operators.joins import join_semi


def filter_pred(df: DataFrame, pred: Column) -> DataFrame:
    """Rows where the predicate is true; NULL counts as false, NULL OR TRUE as true."""
    return df.where(pred)


def drop_na(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def in_column(df: DataFrame, key: str, other: DataFrame, other_key: str | None = None) -> DataFrame:
    """Rows whose value occurs in a column of another frame; a missing value matches a missing one."""
    return join_semi(df, other.select(col(other_key or key).alias(key)), [key])


def regex_like(c: str | Column, pattern: str) -> Column:
    """True where the pattern occurs; a missing text is no match."""
    return F.coalesce(col(c).rlike(pattern), F.lit(False))


def range_of_other(df: DataFrame, c: str, other: DataFrame, other_col: str | None = None) -> DataFrame:
    """Rows whose value lies in the closed range of another frame's column."""
    span = other.agg(F.min(col(other_col or c)).alias("_lo"), F.max(col(other_col or c)).alias("_hi"))
    return cross_1row(df, span).where(col(c).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def cross_1row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Put the columns of an ungrouped aggregate, which has exactly one row, onto every row."""
    return df.crossJoin(F.broadcast(one_row))


def donut(x: str | Column, width: float, bandwidth: float) -> Column:
    """Bandwidth window that leaves out ``[-width, 0]``; the left side reaches ``width`` further."""
    v = col(x)
    return ~v.between(-width, 0) & (v >= -bandwidth - width) & (v <= bandwidth)


def between_closed(c: str | Column, lo, hi) -> Column:
    return col(c).between(lo, hi)


def is_in(c: str | Column, values: Sequence) -> Column:
    """Membership in a constant list; never NULL."""
    return F.coalesce(col(c).isin(*values), F.lit(False))
