"""Grids of discontinuity estimates: samples x outcomes x bandwidths in a few shared passes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbral.functions.scalars import col
from umbral.operators.columns import order_key
from umbral.operators.rd import MSE_LABEL, RdPoints
from umbral.operators.samples import sample_groups

# ---- fixed values: outcomes, covariates, orders -----------------------------------------------------
MAIN_OUTCOMES = ("Native", "Eucalyptus", "Pine", "Plantation", "Forest")
MAIN_COVARIATES = (
    "years_since_contest", "Trees_2000", "Development_2000", "Grassland_2000", "Plantation_2001", "Water_2000", "Crop_2000",
)
BALANCE_COVARIATES = ("years_since_contest", "Trees_2000", "Development_2000", "Grassland_2000", "Water_2000", "Crop_2000")
BALANCE_OUTCOMES = (
    "Superficie", "Monto Solicitado", "area_ha", "Water", "Plantation_2001", "Forest_2001", "Grassland/Ag", "Orchard/Ag",
    "Bare", "Shrubland", "Urban",
)
SIZE_OUTCOMES = ("Forest", "Eucalyptus", "Pine", "Native")
SIZE_COVARIATES = ("Development_2000", "Grassland_2000", "Water_2000", "Crop_2000", "Trees_2000")
BANDWIDTH_ORDER = (MSE_LABEL, f"2 x {MSE_LABEL}")
METHOD_ORDER = ("conventional", "bias-corrected", "robust")
# -----------------------------------------------------------------------------------------------


def _labelled(fits: DataFrame, label: str) -> DataFrame:
    name = F.when(F.col("multiple") == 1, F.lit(label)).otherwise(F.lit(f"2 x {label}"))
    return fits.withColumn("bandwidth_method", name).drop("multiple")


def rd_grid(
    df: DataFrame,
    outcomes: Sequence[str] = MAIN_OUTCOMES,
    covs: Sequence[str] = MAIN_COVARIATES,
    x: str = "score_centered",
    groups: Mapping[str, Column] | None = None,
    take_up: str | None = "received_bonus",
    fuzzy_group: str = "All enrollees",
    **rd_args,
) -> DataFrame:
    """Sharp estimates at the selected and the double bandwidth for every sample and outcome, and fuzzy
    ones (missing take-up counts as none) for one sample: three rows per fit.

    ``bandwidth`` is the bandwidth of the row's own fit; ``sharp_bandwidth`` the one of the sharp fit.
    """
    tagged = sample_groups(df, groups)
    if take_up:
        tagged = tagged.withColumn("_take_up", F.coalesce(col(take_up), F.lit(0)))
    how, estimate = _split(rd_args)
    points = RdPoints(tagged, outcomes, x, covs, "_take_up" if take_up else None, ["data_group"], **how)
    sharp = _labelled(points.fits(multiples=(1.0, 2.0), **estimate), MSE_LABEL)
    sharp = sharp.withColumn("sharp_bandwidth", F.col("bandwidth"))
    if not take_up:
        return sharp
    fuzzy = _labelled(points.where(F.col("data_group") == fuzzy_group).fits(take_up=True, **estimate), MSE_LABEL)
    chosen = sharp.where((F.col("data_group") == fuzzy_group) & (F.col("bandwidth_method") == MSE_LABEL) & (F.col("method") == "robust"))
    fuzzy = fuzzy.join(chosen.select("outcome", F.col("bandwidth").alias("sharp_bandwidth")), "outcome", "left")
    return sharp.unionByName(fuzzy.withColumn("data_group", F.lit("fuzzy")))


def _split(args: dict) -> tuple[dict, dict]:
    """Arguments of the mass points, and of the estimates."""
    estimate = {k: args[k] for k in ("h", "b", "p", "kernel", "bwcheck") if k in args}
    return {k: v for k, v in args.items() if k not in estimate}, estimate


def balance_grid(
    df: DataFrame, outcomes: Sequence[str] = BALANCE_OUTCOMES, covs: Sequence[str] = BALANCE_COVARIATES, x: str = "score_centered", **rd_args
) -> DataFrame:
    """Sharp estimates for variables fixed before treatment."""
    how, estimate = _split(rd_args)
    return _labelled(RdPoints(df, outcomes, x, covs, **how).fits(**estimate), MSE_LABEL)


def rd_size_grid(
    df: DataFrame,
    rules: Mapping[str, Column],
    running: Mapping[str, str],
    outcomes: Sequence[str] = SIZE_OUTCOMES,
    covs: Sequence[str] = SIZE_COVARIATES,
    take_up: str = "smallholder",
    **rd_args,
) -> DataFrame:
    """Fuzzy estimates at the size limit for several sample rules, each with its own running variable."""
    tags = F.array(*[F.when(rule, F.struct(F.lit(tag).alias("tag"), col(running[tag]).cast("double").alias("run"))) for tag, rule in rules.items()])
    tagged = df.withColumn("_t", F.explode(F.array_compact(tags)))
    tagged = tagged.withColumns({"sample_rule": F.col("_t.tag"), "_run": F.col("_t.run")})
    how, estimate = _split(rd_args)
    points = RdPoints(tagged, outcomes, "_run", covs, take_up, ["sample_rule"], **how)
    return _labelled(points.fits(take_up=True, multiples=(1.0, 2.0), **estimate), "optimal")


def selection_filter(results: DataFrame, bandwidth_method: str = MSE_LABEL, method: str = "bias-corrected") -> DataFrame:
    """Rows of the preferred specification."""
    return results.where((F.col("bandwidth_method") == bandwidth_method) & (F.col("method") == method))


def spec_sequence(
    results: DataFrame, outcomes: Sequence[str], bandwidths: Sequence[str] = BANDWIDTH_ORDER, methods: Sequence[str] = METHOD_ORDER
) -> DataFrame:
    """Rows of the listed outcomes with ``spec_seq``, their place in the order outcome, bandwidth, method."""
    kept = results.where(col("outcome").isin(*outcomes) & col("bandwidth_method").isin(*bandwidths))
    place = (
        (order_key("outcome", outcomes) - 1) * len(bandwidths) * len(methods)
        + (order_key("bandwidth_method", bandwidths) - 1) * len(methods)
        + order_key("method", methods)
    )
    return kept.withColumn("spec_seq", place)
