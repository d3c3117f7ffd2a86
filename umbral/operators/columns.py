"""Projections over whole frames."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbral.functions.scalars import col, ratio


def select_cols(df: DataFrame, keep: Sequence[str] | None = None, drop: Sequence[str] = ()) -> DataFrame:
    """Choose, reorder or drop columns by name."""
    names = [c for c in (keep if keep is not None else df.columns) if c not in set(drop)]
    return df.select(*[col(c) for c in names])


def select_matching(df: DataFrame, patterns: Sequence[str], also: Sequence[str] = ()) -> DataFrame:
    """Columns in ``also`` followed by those matching a pattern, ignoring case."""
    found = [c for p in patterns for c in df.columns if re.search(p, c, re.IGNORECASE)]
    return df.select(*[col(c) for c in dict.fromkeys([*also, *found])])


def rename(df: DataFrame, mapping: Mapping[str | int, str]) -> DataFrame:
    """New names by old name or by position (from 0)."""
    names = {df.columns[k] if isinstance(k, int) else k: v for k, v in mapping.items()}
    return df.withColumnsRenamed(names)


def with_columns(df: DataFrame, exprs: Mapping[str, Column]) -> DataFrame:
    return df.withColumns(dict(exprs))


def across_ratio(df: DataFrame, cols: Sequence[str], denom: str, template: str = "pct_{col}") -> DataFrame:
    """Every listed column divided by one column, under templated names."""
    return df.withColumns({template.format(col=c): ratio(c, denom) for c in cols})


def across_apply(df: DataFrame, cols: Sequence[str], fn: Callable[[Column], Column]) -> DataFrame:
    """The same function over the listed columns, in place."""
    return df.withColumns({c: fn(col(c)) for c in cols})


def fill_zero(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NULL to 0 in the listed columns, or in every column that can hold a number."""
    return df.fillna(0, subset=list(cols)) if cols is not None else df.fillna(0)


def order_key(c: str | Column, values: Sequence[str]) -> Column:
    """Position of the value in a list (from 1); NULL if it is not there."""
    return F.nullif(F.array_position(F.array(*[F.lit(v) for v in values]), col(c)), F.lit(0)).cast("int")


def order_by_list(df: DataFrame, spec: Mapping[str, Sequence[str]]) -> DataFrame:
    """Sort by the position of each column's value in its list, unknown values last."""
    return df.orderBy(*[order_key(c, v).asc_nulls_last() for c, v in spec.items()])


def pivot_flags(df: DataFrame, label: str, values: Sequence[str]) -> DataFrame:
    """The label column becomes one boolean column per value; no shuffle."""
    flags = [F.coalesce(col(label) == v, F.lit(False)).alias(v) for v in values]
    return df.select(*[col(c) for c in df.columns if c != label], *flags)
