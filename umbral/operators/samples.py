"""Samples around an eligibility cutoff."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbral.functions.scalars import CELL_HA, col, pixels_to_ha, years_since
from umbral.operators.columns import across_ratio
from umbral.operators.filters import in_column, regex_like
from umbral.operators.joins import join_inner

# ---- fixed values: contest rule -------------------------------------------------------------------
OTHER = "Other interested"
ODD_YEAR = 2014
SECOND_ROUND = "Segundo"
# -----------------------------------------------------------------------------------------------


def in_contest(contest_type: str, year: str, contest_name: str, odd_year: int = ODD_YEAR, pattern: str = SECOND_ROUND) -> Column:
    """Contests with a binding cutoff: one type in most years, the other type's second round in the odd year."""
    other = col(contest_type) == OTHER
    return (other & (col(year) != odd_year)) | ((col(year) == odd_year) & ~other & regex_like(contest_name, pattern))


def score_cutoffs(
    awarded: DataFrame,
    rejected: DataFrame,
    year: str = "ano_concurso",
    contest_type: str = "Contest type",
    contest_name: str = "contest_name",
    score: str = "score",
    odd_year: int = ODD_YEAR,
) -> DataFrame:
    """Lowest awarded score per (year, contest type), for the years with rejected applications."""
    kept = in_column(awarded.where(in_contest(contest_type, year, contest_name, odd_year)), year, rejected)
    return kept.groupBy(col(year).alias(year), col(contest_type).alias(contest_type)).agg(F.min(col(score)).alias("min_awarded_score"))


def _with_cutoff(df: DataFrame, cutoffs: DataFrame, year: str, contest_type: str, score: str, awarded: bool) -> DataFrame:
    joined = join_inner(df, cutoffs, [contest_type, year])
    return joined.withColumns({"score_centered": col(score) - F.col("min_awarded_score"), "Awarded": F.lit(awarded)})


def enrolled_sample(
    landcover: DataFrame,
    properties: DataFrame,
    cutoffs: DataFrame,
    on: Sequence[str],
    year: str = "ano_concurso",
    contest_type: str = "Contest type",
    contest_name: str = "contest_name",
    score: str = "score",
    odd_year: int = ODD_YEAR,
) -> DataFrame:
    """Enrolled properties with land cover and score distance to their contest's cutoff."""
    df = join_inner(landcover, properties, on).where(in_contest(contest_type, year, contest_name, odd_year))
    return _with_cutoff(df, cutoffs, year, contest_type, score, True)


def rejected_sample(
    landcover: DataFrame,
    rejected: DataFrame,
    cutoffs: DataFrame,
    on: Sequence[str],
    year: str = "ano_concurso",
    contest_type: str = "Contest type",
    score: str = "score",
) -> DataFrame:
    """Rejected applications with land cover, at or under the cutoff."""
    df = _with_cutoff(join_inner(landcover, rejected, on), cutoffs, year, contest_type, score, False)
    return df.where(F.col("score_centered") <= 0)


def score_sample(
    enrolled: DataFrame,
    rejected: DataFrame,
    cover_cols: Sequence[str],
    pixels: str = "pixels_count",
    year: str = "ano_concurso",
    cell_ha: float = CELL_HA,
) -> DataFrame:
    """Both groups by column name, with cover shares, years since the contest and area."""
    both = rejected.unionByName(enrolled, allowMissingColumns=True)
    return across_ratio(both, cover_cols, pixels).withColumns(
        {"years_since_contest": years_since(year), "area_ha": pixels_to_ha(pixels, cell_ha)}
    )


def score_groups(bonus: str = "received_bonus", awarded: str = "Awarded") -> dict[str, Column]:
    """Membership rules of the three overlapping samples; a rejected row is in all of them."""
    rejected = col(awarded) == F.lit(False)
    return {
        "Received bonus": (col(bonus) == 1) | rejected,
        "Never received bonus": (col(bonus) == 0) | rejected,
        "All enrollees": F.lit(True),
    }


def sample_groups(df: DataFrame, groups: Mapping[str, Column] | None = None, name: str = "data_group") -> DataFrame:
    """Each row once per sample it belongs to; a missing rule result is no membership."""
    tags = F.array(*[F.when(rule, F.lit(tag)) for tag, rule in (groups or score_groups()).items()])
    return df.withColumn(name, F.explode(F.array_compact(tags)))


def mapped_over_cutoff(
    area: str = "polyarea", cutoff: str = "size_cutoff", contest_type: str = "Contest type"
) -> Column:
    """Small applicants whose mapped size exceeds the limit."""
    return (col(area) > col(cutoff)) & (col(contest_type) == "Smallholder")


def censor_sample(
    df: DataFrame,
    area: str = "polyarea",
    cutoff: str = "size_cutoff",
    reported: str = "propertysize_reported",
    contest_type: str = "Contest type",
    drop_over: bool = True,
    max_gap: float | None = None,
) -> DataFrame:
    """Drop small applicants mapped over the limit, and rows whose two sizes differ by more than ``max_gap``.

    A row whose rule cannot be decided is dropped.
    """
    if drop_over:
        df = df.where(~mapped_over_cutoff(area, cutoff, contest_type))
    if max_gap is not None:
        df = df.where(F.abs(col(area) - col(reported)) <= max_gap)
    return df
