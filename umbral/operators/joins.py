"""Equi-joins in which a missing key matches a missing key.

All keys are compared with ``<=>``, which Spark plans as hash or sort-merge keys. Inner joins can be
split on both sides by adaptive skew handling, left joins on the left. A full join cannot, so it is
put together from a left join and an anti join against distinct keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbral.functions.scalars import col


def _key(i: int) -> str:
    return f"__key_{i}"


def _with_keys(df: DataFrame, on: Sequence[str], keep_keys: bool) -> DataFrame:
    keys = [col(k).alias(_key(i)) for i, k in enumerate(on)]
    rest = [col(c) for c in df.columns if keep_keys or c not in set(on)]
    return df.select(*rest, *keys)


def _condition(left: DataFrame, right: DataFrame, on: Sequence[str], na_matches: bool) -> Column:
    if na_matches:
        parts = [left[k].eqNullSafe(right[_key(i)]) for i, k in enumerate(on)]
    else:
        parts = [left[k] == right[_key(i)] for i, k in enumerate(on)]
    return reduce(and_, parts)


def _suffixed(left: DataFrame, right: DataFrame, on: Sequence[str], suffixes: tuple[str, str]):
    """Rename the non-key columns both sides carry."""
    both = (set(left.columns) & set(right.columns)) - set(on)
    return (
        left.withColumnsRenamed({c: c + suffixes[0] for c in both}),
        right.withColumnsRenamed({c: c + suffixes[1] for c in both}),
    )


def _join(left, right, on, how, suffixes, na_matches) -> DataFrame:
    left, right = _suffixed(left, right, on, suffixes)
    keyed = _with_keys(right, on, keep_keys=False)
    joined = left.join(keyed, _condition(left, keyed, on, na_matches), how)
    return joined.drop(*[_key(i) for i in range(len(on))])


def join_inner(left, right, on: Sequence[str], suffixes=("_x", "_y"), na_matches: bool = True) -> DataFrame:
    return _join(left, right, on, "inner", suffixes, na_matches)


def join_left(left, right, on: Sequence[str], suffixes=("_x", "_y"), na_matches: bool = True) -> DataFrame:
    return _join(left, right, on, "left", suffixes, na_matches)


def join_left_spread(left, right, on: Sequence[str], parts: int = 64, **args) -> DataFrame:
    """A left join for a left frame in which many rows miss a key: these are dealt over ``parts`` copies of the right
    rows that miss one, so that they do not meet in one task. ``right`` should have few such rows."""
    lacks = reduce(or_, [F.col("_lacks").getField(f"k{i}").isNull() for i in range(len(on))])
    keys = F.struct(*[col(k).alias(f"k{i}") for i, k in enumerate(on)])
    dealt = F.pmod(F.xxhash64(*[col(c) for c in left.columns]), F.lit(parts)).cast("int")
    left = left.withColumn("_lacks", keys).withColumn("_part", F.when(lacks, dealt).otherwise(0)).drop("_lacks")
    copies = F.when(lacks, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    right = right.withColumn("_lacks", keys).withColumn("_part", F.explode(copies)).drop("_lacks")
    return join_left(left, right, [*on, "_part"], **args).drop("_part")


def join_right(left, right, on: Sequence[str], suffixes=("_x", "_y"), na_matches: bool = True) -> DataFrame:
    """All rows of the right frame; written as a left join from it, with the left frame's columns first."""
    left, right = _suffixed(left, right, on, suffixes)
    out = _join(right, left, on, "left", suffixes, na_matches)
    return out.select(*[col(c) for c in left.columns], *[col(c) for c in right.columns if c not in set(on)])


def _match_only(left, right, on, how, na_matches) -> DataFrame:
    keys = _with_keys(right, on, keep_keys=True).select(*[_key(i) for i in range(len(on))]).distinct()
    return left.join(keys, _condition(left, keys, on, na_matches), how)


def join_semi(left, right, on: Sequence[str], na_matches: bool = True) -> DataFrame:
    """Rows with a match; the right side is reduced to its distinct keys before it is shuffled."""
    return _match_only(left, right, on, "left_semi", na_matches)


def join_anti(left, right, on: Sequence[str], na_matches: bool = True) -> DataFrame:
    """Rows without a match."""
    return _match_only(left, right, on, "left_anti", na_matches)


def join_full(left, right, on: Sequence[str], suffixes=("_x", "_y"), na_matches: bool = True) -> DataFrame:
    """All rows of both frames with one coalesced set of key columns.

    A left join gives the matches and the left frame's own rows; the right frame's own rows are found against
    the left frame's distinct keys. So each frame is read twice, and adaptive execution can split a hot key. The
    caller writes a frame first that is costly to work out, as the inner one of nested full joins.
    """
    kept = join_left(left, right, on, suffixes, na_matches)
    left_named, right_named = _suffixed(left, right, on, suffixes)
    only_right = join_anti(right_named, left, on, na_matches)
    return kept.unionByName(only_right, allowMissingColumns=True)


def join_window(df: DataFrame, x: str, points: Sequence[tuple[float, float]], point_col: str = "point") -> DataFrame:
    """Each row once per listed ``(point, reach)`` whose closed window holds it; no join is planned."""
    windows = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.lit(float(w)).alias("w")) for p, w in points])
    hit = F.filter(windows, lambda s: col(x).between(s["p"] - s["w"], s["p"] + s["w"]))
    return df.withColumn("_hit", F.explode(hit)).withColumn(point_col, F.col("_hit.p")).drop("_hit")
