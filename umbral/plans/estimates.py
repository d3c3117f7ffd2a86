"""Queries for the discontinuity estimators, the density test and the report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from umbral.functions.scalars import col, flag_equal, flag_not_no, heap_category, region_cutoff
from umbral.operators import density as D
from umbral.operators import grids as G
from umbral.operators import rd as R
from umbral.operators import regression as E
from umbral.operators import report as P
from umbral.operators.samples import mapped_over_cutoff
from umbral.plans import adapters as ad
from umbral.plans.registry import query
from umbral.plans.samples import CTES, score_sample

H = 6.0


def _rounded(df, **digits):
    return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else col(c) for c in df.columns])


_SIDES = f"""
w AS (SELECT score_centered >= 0 AS r, score_centered / {H} AS u, 1 - abs(score_centered) / {H} AS k, "Forest" AS y, coalesce(bonus, 0) AS t
  FROM sample WHERE abs(score_centered) < {H}),
m AS (SELECT r, count(*) AS n, sum(k) AS s0, sum(k * u) AS s1, sum(k * u * u) AS s2, sum(k * u * u * u) AS s3, sum(k * u * u * u * u) AS s4,
    sum(k * y) AS y0, sum(k * u * y) AS y1, sum(k * u * u * y) AS y2, sum(k * t) AS t0, sum(k * u * t) AS t1 FROM w GROUP BY r),
lin AS (SELECT r, n, (y0 * s2 - y1 * s1) / (s0 * s2 - s1 * s1) AS ay, (t0 * s2 - t1 * s1) / (s0 * s2 - s1 * s1) AS a_t,
    (y0 * (s2 * s4 - s3 * s3) - s1 * (y1 * s4 - s3 * y2) + s2 * (y1 * s3 - s2 * y2)) / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2)) AS qy FROM m)"""


@query(
    "rd_local_linear",
    ad.sql(
        *CTES, _SIDES,
        body="SELECT round(max(ay) FILTER (r) - max(ay) FILTER (NOT r), 4) AS estimate, (SELECT count(*) FROM sample) AS \"Obs\", CAST(sum(n) AS BIGINT) AS eff_obs, 6.0::DOUBLE AS bandwidth FROM lin",
    ),
)
def rd_local_linear(t):
    """Jump of forest cover at the cutoff with a given bandwidth."""
    out = R.rd_sharp(score_sample(t), "Forest", "score_centered", h=H).where(col("method") == "conventional")
    return out.select(F.round("estimate", 4).alias("estimate"), "Obs", "eff_obs", "bandwidth")


@query(
    "rd_bias_corrected",
    ad.sql(*CTES, _SIDES, body="SELECT round(max(qy) FILTER (r) - max(qy) FILTER (NOT r), 4) AS estimate, CAST(sum(n) AS BIGINT) AS eff_obs FROM lin"),
)
def rd_bias_corrected(t):
    """With equal bandwidths the corrected jump is the jump of the next order."""
    out = R.rd_sharp(score_sample(t), "Forest", "score_centered", h=H).where(col("method") == "robust")
    return out.select(F.round("estimate", 4).alias("estimate"), "eff_obs")


@query(
    "rd_fuzzy_ratio",
    ad.sql(
        *CTES, _SIDES,
        body="SELECT round((max(ay) FILTER (r) - max(ay) FILTER (NOT r)) / (max(a_t) FILTER (r) - max(a_t) FILTER (NOT r)), 4) AS estimate, CAST(sum(n) AS BIGINT) AS eff_obs FROM lin",
    ),
)
def rd_fuzzy_ratio(t):
    sample = score_sample(t).withColumn("received_bonus", F.coalesce("received_bonus", F.lit(0)))
    out = R.rd_fuzzy(sample, "Forest", "score_centered", "received_bonus", h=H).where(col("method") == "conventional")
    return out.select(F.round("estimate", 4).alias("estimate"), "eff_obs")


@query("rd_bandwidth")
def rd_bandwidth(t):
    """Data-driven bandwidths per outcome, with covariates."""
    points = R.RdPoints(score_sample(t), G.MAIN_OUTCOMES, "score_centered", G.MAIN_COVARIATES)
    return _rounded(points.bandwidths(), h=6, b=6)


@query("rd_covariates_grid")
def rd_covariates_grid(t):
    """Three samples, five outcomes, two bandwidths and the fuzzy fits: 35 fits, 105 rows."""
    return _rounded(G.rd_grid(score_sample(t)), estimate=6, se=6, pval=6, bandwidth=6, bias_bandwidth=6, sharp_bandwidth=6)


@query("rd_balance_grid")
def rd_balance_grid(t):
    """Eleven variables fixed before treatment: 33 rows."""
    sample = score_sample(t).withColumnsRenamed({"area": "Superficie", "amount": "Monto Solicitado"})
    bonus = sample.where((col("received_bonus") == 1) | (col("Awarded") == F.lit(False)))
    return _rounded(G.balance_grid(bonus), estimate=6, se=6, pval=6, bandwidth=6, bias_bandwidth=6)


@query("rd_size_grid")
def rd_size_grid(t):
    """Fuzzy estimates at the size limit under three sample rules: 24 fits, 72 rows."""
    app = ad.applications(t).withColumnRenamed("ctype", "Contest type")
    app = app.join(t.customer.select("c_custkey", "c_acctbal"), col("prop_id") == col("c_custkey")).join(ad.landcover(t), "app_id")
    df = app.withColumns(
        {
            "smallholder": flag_equal("Contest type", "Smallholder"),
            "size_cutoff": region_cutoff("region"),
            "polyarea": col("size_ha") + col("c_acctbal") / 500,
            "plan": flag_not_no("contest_name"),
        }
    ).withColumns({"size_centered": col("size_ha") - col("size_cutoff"), "polyarea_centered": col("polyarea") - col("size_cutoff")})
    close = (col("size_cutoff") == 200) & (col("status") == "F") & (F.abs(col("polyarea") - col("size_ha")) <= 30)
    rules = {"reported": col("plan") == 1, "censored": (col("plan") == 1) & ~mapped_over_cutoff(), "mapped": close}
    running = {"reported": "size_centered", "censored": "size_centered", "mapped": "polyarea_centered"}
    return _rounded(G.rd_size_grid(df, rules, running), estimate=5, se=5, pval=6, bandwidth=6, bias_bandwidth=6)


@query("density_test")
def density_test(t):
    """Is there a jump of the number of applications at the cutoff?"""
    out = D.density_test(score_sample(t), "score_centered")
    return _rounded(out, hl=6, hr=6, f_l=8, f_r=8, se_l=8, se_r=8, jump=8, se=8, t=6, p_value=6)


@query("density_bandwidth")
def density_bandwidth(t):
    """Bandwidths of the density test by each selector, and the ones it takes."""
    return _rounded(D.density_bandwidth(score_sample(t), "score_centered"), hl=6, hr=6)


@query("density_curve")
def density_curve(t):
    out = D.density_curve(score_sample(t), "score_centered")
    return _rounded(out, x=6, density=8, density_bc=8, se=8, lower=8, upper=8)


def _mean_gaps(sample, outcomes):
    """A plain result table: difference of means between awarded and rejected per outcome."""
    rows = E.outcome_rows(sample, outcomes, ["Awarded", "score_centered"])
    won, lost = (F.when(col("Awarded") == F.lit(v), col("y")) for v in (True, False))
    return rows.groupBy("outcome").agg(
        (F.avg(won) - F.avg(lost)).alias("estimate"),
        F.sqrt(F.var_samp(won) / F.count(won) + F.var_samp(lost) / F.count(lost)).alias("se"),
        F.stddev_samp("score_centered").alias("bandwidth"),
        F.count(F.lit(1)).alias("eff_obs"),
    )


def _gaps_sql(outcomes) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{o}' AS outcome, avg(\"{o}\") FILTER (awarded) - avg(\"{o}\") FILTER (NOT awarded) AS estimate, "
        f"sqrt(var_samp(\"{o}\") FILTER (awarded) / count(*) FILTER (awarded) + var_samp(\"{o}\") FILTER (NOT awarded) / count(*) FILTER (NOT awarded)) AS se, "
        f"stddev_samp(score_centered) AS bandwidth, count(*) AS eff_obs FROM sample"
        for o in outcomes
    )
    stars = "CASE WHEN z BETWEEN 1.645 AND 1.96 THEN '*' WHEN z BETWEEN 1.96 AND 2.58 THEN '**' WHEN z >= 2.58 THEN '***' ELSE '' END AS marks"
    return f"\ngap0 AS ({parts}),\ngap AS (SELECT *, {stars} FROM (SELECT *, abs(estimate / se) AS z FROM gap0))"


def _main_row(i: int, label: str, cell: str) -> str:
    cols = ", ".join(f"max(CASE WHEN outcome = '{o}' THEN {cell} END) AS \"{o}\"" for o in P.PAPER_OUTCOMES)
    return f"SELECT {i} AS ord, '{label}' AS \"row\", {cols} FROM gap"


_MEANS = ", ".join(f'CAST(round(avg("{o}"), 2) AS VARCHAR)' for o in P.PAPER_OUTCOMES)


@query(
    "main_table",
    ad.sql(
        *CTES, _gaps_sql(P.PAPER_OUTCOMES),
        body=" UNION ALL ".join(
            [
                _main_row(0, P.MAIN_ROWS[0], "CAST(round(estimate, 3) AS VARCHAR) || marks"),
                _main_row(1, P.MAIN_ROWS[1], "'(' || CAST(round(se, 3) AS VARCHAR) || ')'"),
                _main_row(2, P.MAIN_ROWS[2], "CAST(round(bandwidth, 3) AS VARCHAR)"),
                _main_row(3, P.MAIN_ROWS[3], "CAST(eff_obs AS VARCHAR)"),
                f"SELECT 4, '{P.MAIN_ROWS[4]}', {_MEANS} FROM sample WHERE NOT awarded",
            ]
        ),
    ),
)
def main_table(t):
    sample = score_sample(t)
    results = _mean_gaps(sample, P.PAPER_OUTCOMES).withColumn("data_group", F.lit("All enrollees"))
    return P.main_table(results, sample, "All enrollees")


_BALANCE = {"area_ha": "area_ha", "Water": "Water", "Plantation_2001": "Plantation_2001", "Forest_2001": "Forest_2001"}


@query(
    "balance_table",
    ad.sql(
        *CTES, _gaps_sql(_BALANCE),
        body="""
SELECT CASE outcome WHEN 'area_ha' THEN 3 WHEN 'Water' THEN 4 WHEN 'Plantation_2001' THEN 5 ELSE 6 END AS ord,
  CASE outcome WHEN 'area_ha' THEN 'Property area (ha)' WHEN 'Water' THEN 'Water' WHEN 'Plantation_2001' THEN 'Plantation forest (2001)' ELSE 'Native forest (2001)' END AS outcome,
  CAST(round(estimate, 3) AS VARCHAR) || marks AS estimate, '[' || CAST(round(estimate - 1.96 * se, 3) AS VARCHAR) || ', ' || CAST(round(estimate + 1.96 * se, 3) AS VARCHAR) || ']' AS ci,
  round(bandwidth, 3) AS bandwidth, eff_obs FROM gap""",
    ),
)
def balance_table(t):
    results = _mean_gaps(score_sample(t), list(_BALANCE)).withColumn("pval", F.lit(None).cast("double"))
    return P.balance_table(results).drop("pval")


@query(
    "welch_table",
    ad.sql(
        ad.APP,
        body="""
SELECT CASE variable WHEN 'timber' THEN 1 ELSE 2 END AS ord, CASE variable WHEN 'timber' THEN 'timber production' ELSE 'payment (UTM)' END AS variable,
  round(avg(y) FILTER (g = 'small'), 6) AS heaper_mean, round(avg(y) FILTER (g = 'other'), 6) AS other_mean FROM (
    SELECT g, 'timber' AS variable, CASE WHEN status = 'F' THEN 1.0::DOUBLE ELSE 0 END AS y FROM a UNION ALL SELECT g, 'amount', amount / 1000 FROM a)
GROUP BY variable""",
    ).replace("\nSELECT CASE variable", ", a AS (SELECT *, CASE WHEN ctype = 'Smallholder' AND size_ha BETWEEN 199 AND 200 THEN 'small' WHEN ctype = 'Smallholder' AND size_ha BETWEEN 180 AND 198 THEN 'other' END AS g FROM app)\nSELECT CASE variable", 1),
)
def welch_table(t):
    app = ad.applications(t).withColumns(
        {"g": heap_category("size_ha", col("ctype") == "Smallholder"), "amount": col("amount") / 1000, "timber": flag_equal("status", "F")}
    )
    tests = E.welch_t(app, "g", ["amount", "timber"], ("smallholder heaper", "between 180 and 198 ha"))
    out = P.welch_table(tests, {"timber": "timber production", "amount": "payment (UTM)"}, first="other_mean")
    return _rounded(out.drop("p_value"), heaper_mean=6, other_mean=6)


#: All outcomes, in the order of the reference's chart, which leaves out the last one.
_CURVE_OUTCOMES = ("Native", "Plantation", "Eucalyptus", "Pine", "Forest")


@query("rd_spec_curve")
def rd_spec_curve(t):
    """Specification curve of one sample's estimates: outcomes, bandwidths and methods in order."""
    from umbral.operators.chartdata import spec_curve
    from umbral.operators.columns import pivot_flags

    sample = score_sample(t)
    one = {"Received bonus": (col("received_bonus") == 1) | (col("Awarded") == F.lit(False))}
    results = G.rd_grid(sample, _CURVE_OUTCOMES, groups=one, take_up=None)
    specs = G.spec_sequence(results, _CURVE_OUTCOMES).select("spec_seq", "outcome", "estimate", "se", "method", "bandwidth_method")
    preferred = (col("bandwidth_method") == G.BANDWIDTH_ORDER[0]) & (col("method") == "bias-corrected")
    specs = specs.withColumn("preferred", preferred)
    specs = pivot_flags(pivot_flags(specs, "method", G.METHOD_ORDER), "bandwidth_method", G.BANDWIDTH_ORDER)
    out = spec_curve(specs, {"Method:": G.METHOD_ORDER, "Bandwidth:": G.BANDWIDTH_ORDER}, group_size=6, highlight=col("preferred"))
    return _rounded(out, estimate=6, se=6, l1=6, h1=6, l2=6, h2=6, ymin=6, ymax=6)
