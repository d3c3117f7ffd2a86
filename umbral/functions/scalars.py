"""Numeric and conditional column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: programme rules -----------------------------------------------------------
REGIONS_200 = (5, 6, 7, 8, 9, 10, 14)
REGIONS_500 = (1, 2, 3, 4, 15)
REGIONS_800 = (11, 12)
CELL_HA = 0.0225
BASE_YEAR = 2021
STAR_BOUNDS = (1.645, 1.96, 2.58)
# -----------------------------------------------------------------------------------------------


def col(c: str | Column) -> Column:
    """A column from a name or a column; names with blanks or slashes need no quoting here."""
    return F.col("`" + c.replace("`", "``") + "`") if isinstance(c, str) else c


def region_cutoff(region: str | Column) -> Column:
    """Size limit in hectares by region number; unknown or missing regions get 500."""
    r = col(region)
    return F.when(r.isin(*REGIONS_200), F.lit(200)).when(r.isin(*REGIONS_800), F.lit(800)).otherwise(F.lit(500))


def flag_not_no(c: str | Column) -> Column:
    """0 for "No" and for a missing value, 1 for everything else."""
    return F.when(col(c).isNull() | (col(c) == "No"), F.lit(0)).otherwise(F.lit(1))


def flag_equal(c: str | Column, *values) -> Column:
    """1 if equal to one of the values, 0 if not, NULL if missing."""
    return F.when(col(c).isNull(), F.lit(None).cast("int")).otherwise(col(c).isin(*values).cast("int"))


def flag_none_of(c: str | Column, *values) -> Column:
    """1 if different from all the values, 0 if not, NULL if missing."""
    return 1 - flag_equal(c, *values)


def if_else(test: Column, yes, no) -> Column:
    """Conditional that is NULL where the test is NULL."""
    return F.when(test.isNull(), F.lit(None)).when(test, yes).otherwise(no)


def coalesce_cols(*cols: str | Column) -> Column:
    return F.coalesce(*[col(c) for c in cols])


def signed_diff(a: str | Column, b: str | Column) -> Column:
    return col(a) - col(b)


def abs_diff(a: str | Column, b: str | Column) -> Column:
    return F.abs(col(a) - col(b))


def center(x: str | Column, cutoff: str | float | Column) -> Column:
    """Signed distance to the cutoff."""
    return col(x) - (col(cutoff) if isinstance(cutoff, (str, Column)) else F.lit(cutoff))


def ratio(a: str | Column, b: str | Column) -> Column:
    """Quotient; NULL where the divisor is 0."""
    return F.try_divide(col(a), col(b))


def years_since(year: str | Column, base: int = BASE_YEAR) -> Column:
    return F.lit(base) - col(year)


def pixels_to_ha(pixels: str | Column, cell_ha: float = CELL_HA) -> Column:
    return col(pixels) * F.lit(cell_ha)


def class_total(*cols: str | Column) -> Column:
    """Plain sum; NULL if any part is NULL."""
    return reduce(add, [col(c) for c in cols])


def row_sum(*cols: str | Column) -> Column:
    """Sum over columns that skips NULL."""
    return reduce(add, [F.coalesce(col(c), F.lit(0)) for c in cols])


def any_positive(*cols: str | Column) -> Column:
    """True if the sum of the flags is positive."""
    return class_total(*cols) > 0


def bin_edges(x: str | Column, lo: float, hi: float, width: float) -> Column:
    """Index (from 1) of the right-closed bin; NULL outside ``(lo, hi]``."""
    v = col(x)
    return F.when((v > lo) & (v <= hi), F.ceil((v - F.lit(float(lo))) / F.lit(float(width))).cast("int"))


def bin_end(index: str | Column, lo: float, width: float) -> Column:
    return col(index) * F.lit(float(width)) + F.lit(float(lo))


def bin_mid(index: str | Column, lo: float, width: float) -> Column:
    return bin_end(index, lo, width) - F.lit(width / 2.0)


def bin_count(x: str | Column, n: int, lo: Column, hi: Column) -> Column:
    """One of ``n`` equal right-closed bins over the observed range; the minimum falls in bin 1."""
    step = (hi - lo) / F.lit(float(n))
    index = F.ceil(F.try_divide(col(x) - lo, step)).cast("int")
    return F.when(col(x).isNotNull(), F.least(F.lit(n), F.greatest(F.lit(1), F.coalesce(index, F.lit(1)))))


def round_heap(x: str | Column, step: float = 10, except_value: float = 200) -> Column:
    """1 for multiples of ``step`` other than the cutoff itself; the remainder takes the divisor's sign."""
    v = col(x)
    return F.when(v.isNull(), F.lit(None).cast("int")).otherwise(
        ((F.pmod(v, F.lit(step)) == 0) & (v != except_value)).cast("int")
    )


def heap_category(
    size: str | Column,
    small: Column,
    heap: tuple[float, float] = (199, 200),
    over: tuple[float, float] = (200.01, 225),
    below: tuple[float, float] = (180, 198),
) -> Column:
    """Three labels around the limit: small at it, large just over it, small clearly under it."""
    v = col(size)
    return (
        F.when(v.between(*heap) & small, F.lit("smallholder heaper"))
        .when(v.between(*over) & ~small, F.lit("other interested just over"))
        .when(v.between(*below) & small, F.lit("between 180 and 198 ha"))
    )


def stars(estimate: str | Column, se: str | Column, bounds: Sequence[float] = STAR_BOUNDS) -> Column:
    """Significance marks by |estimate / se|; both interval ends are closed, the lower mark wins a tie."""
    z = F.abs(F.try_divide(col(estimate), col(se)))
    one, two, three = bounds
    return (
        F.when(z.between(one, two), F.lit("*"))
        .when(z.between(two, three), F.lit("**"))
        .when(z >= three, F.lit("***"))
        .otherwise(F.lit(""))
    )


def z_value(level: float) -> float:
    """Two-sided normal quantile of a confidence level."""
    return NormalDist().inv_cdf(1 - (1 - level) / 2)


def ci_bounds(estimate: str | Column, se: str | Column, z: float = 1.96) -> tuple[Column, Column]:
    return col(estimate) - F.lit(z) * col(se), col(estimate) + F.lit(z) * col(se)


def cast_num(c: str | Column, to: str = "double") -> Column:
    """Text to number; NULL where the text is no number."""
    return col(c).try_cast(to)


def recode(c: str | Column, labels: Mapping[str, str]) -> Column:
    """Code to label; unknown codes stay as they are."""
    table = F.create_map(*[F.lit(v) for pair in labels.items() for v in pair])
    return F.coalesce(table[col(c)], col(c))


def strict_mean(c: str | Column) -> Column:
    """Mean that is NULL if any value is NULL (aggregate)."""
    return F.when(F.count(col(c)) == F.count(F.lit(1)), F.avg(col(c)))
