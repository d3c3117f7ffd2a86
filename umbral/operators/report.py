"""Result tables with marks, rounded figures and labels. Inputs are result tables, one row per estimate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbral.functions.scalars import ci_bounds, col, recode, stars, strict_mean
from umbral.functions.text import paste
from umbral.operators.columns import order_key

# ---- fixed values: labels -------------------------------------------------------------------------
PAPER_OUTCOMES = ("Native", "Plantation", "Eucalyptus", "Pine")
MAIN_ROWS = ("LATE", " ", "Optimal bandwidth", "Effective # obs.", "Dep. var. mean")
BALANCE_LABELS = {
    "Superficie": "Subsidy area (ha)",
    "Monto Solicitado": "Subsidy amount (UTM)",
    "area_ha": "Property area (ha)",
    "Water": "Water",
    "Plantation_2001": "Plantation forest (2001)",
    "Forest_2001": "Native forest (2001)",
}
# -----------------------------------------------------------------------------------------------


def main_table(
    preferred: DataFrame,
    sample: DataFrame,
    data_group: str,
    outcomes: Sequence[str] = PAPER_OUTCOMES,
    awarded: str = "Awarded",
) -> DataFrame:
    """Estimate with marks, error, bandwidth, effective rows and the untreated mean; outcomes as columns."""
    rows = preferred.where((F.col("data_group") == data_group) & F.col("outcome").isin(*outcomes))
    cells = rows.select(
        "outcome",
        F.array(
            paste(F.round("estimate", 3), stars("estimate", "se")),
            F.concat(F.lit("("), F.round("se", 3).cast("string"), F.lit(")")),
            F.round("bandwidth", 3).cast("string"),
            F.col("eff_obs").cast("string"),
        ).alias("_cells"),
    )
    long = cells.select("outcome", F.posexplode("_cells").alias("_ord", "_value"))
    wide = long.groupBy("_ord").agg(*[F.first(F.when(F.col("outcome") == o, F.col("_value")), ignorenulls=True).alias(o) for o in outcomes])
    means = sample.where(col(awarded) == F.lit(False)).agg(*[F.round(strict_mean(o), 2).cast("string").alias(o) for o in outcomes])
    table = wide.unionByName(means.withColumn("_ord", F.lit(4)))
    label = F.get(F.array(*[F.lit(r) for r in MAIN_ROWS]), F.col("_ord"))
    return table.select(F.col("_ord").alias("ord"), label.alias("row"), *[col(o) for o in outcomes])


def balance_table(preferred: DataFrame, labels: Mapping[str, str] = BALANCE_LABELS) -> DataFrame:
    """Variable label, estimate with marks, p-value, interval, bandwidth and effective rows."""
    lower, upper = ci_bounds("estimate", "se")
    rows = preferred.where(F.col("outcome").isin(*labels))
    return rows.select(
        order_key("outcome", list(labels)).alias("ord"),
        recode("outcome", labels).alias("outcome"),
        paste(F.round("estimate", 3), stars("estimate", "se")).alias("estimate"),
        "pval",
        F.concat(F.lit("["), F.round(lower, 3).cast("string"), F.lit(", "), F.round(upper, 3).cast("string"), F.lit("]")).alias("ci"),
        F.round("bandwidth", 3).alias("bandwidth"),
        "eff_obs",
    )


def welch_table(tests: DataFrame, labels: Mapping[str, str], first: str = "justover_mean", second: str = "heaper_mean") -> DataFrame:
    """Variable label, the two group means and the p-value, in the order of the labels."""
    return tests.where(F.col("variable").isin(*labels)).select(
        order_key("variable", list(labels)).alias("ord"),
        recode("variable", labels).alias("variable"),
        F.col("mean_2").alias(second),
        F.col("mean_1").alias(first),
        "p_value",
    )
