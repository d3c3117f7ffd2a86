"""Queries for the samples around the cutoff, chart data and the simple estimators."""

from __future__ import annotations

from pyspark.sql import functions as F

from umbral.functions.scalars import center, col, flag_equal, z_value
from umbral.operators import chartdata as K
from umbral.operators import regression as E
from umbral.operators import samples as S
from umbral.operators.filters import cross_1row, donut
from umbral.operators.ordering import ecdf
from umbral.operators.rd import rd_bandwidth
from umbral.plans import adapters as ad
from umbral.plans.registry import query
from umbral.plans.relational import HEAP_VALUES, HEAP_WINDOWS

# ---- fixed values: outcomes ---------------------------------------------------------------------
OUTCOMES = ("Native", "Eucalyptus", "Pine", "Plantation", "Forest")
MEAN_OUTCOMES = ("Native", "Plantation", "Forest", "Pine", "Eucalyptus")
# -----------------------------------------------------------------------------------------------


def _renamed(t):
    names = {"ctype": "Contest type", "yr": "ano_concurso", "bonus": "received_bonus"}
    return ad.applications(t).withColumnsRenamed(names)


def cutoffs(t):
    app = _renamed(t)
    return S.score_cutoffs(app.where("awarded"), app.where(~col("awarded")), odd_year=ad.ODD_YEAR)


def score_sample(t):
    """Centred scores with land cover, one row per application."""
    land = ad.landcover(t)
    app = _renamed(t).select("app_id", "ano_concurso", "Contest type", "contest_name", "score", "region", "comuna",
                             "received_bonus", "area", "amount", "awarded")
    cuts = cutoffs(t)
    won = S.enrolled_sample(land, app.where("awarded"), cuts, ["app_id"], odd_year=ad.ODD_YEAR)
    lost = S.rejected_sample(land, app.where(~col("awarded")), cuts, ["app_id"])
    return S.score_sample(won, lost, ad.LANDCOVER_COLS)


CUTS = f"""
cuts AS (
  SELECT yr, ctype, min(score) AS min_awarded_score FROM app a
  WHERE awarded AND ((ctype = 'Other interested' AND yr <> {ad.ODD_YEAR}) OR (yr = {ad.ODD_YEAR} AND ctype <> 'Other interested' AND contest_name LIKE '%Segundo%'))
    AND EXISTS (SELECT 1 FROM app b WHERE NOT b.awarded AND a.yr = b.yr) GROUP BY yr, ctype)"""
SAMPLE = f"""
sample AS (
  SELECT a.*, l.* EXCLUDE (app_id), a.score - c.min_awarded_score AS score_centered, 2021 - a.yr AS years_since_contest, pixels_count * 0.0225::DOUBLE AS area_ha
  FROM app a JOIN land l ON l.app_id = a.app_id JOIN cuts c ON c.yr = a.yr AND c.ctype = a.ctype
  WHERE (awarded AND ((a.ctype = 'Other interested' AND a.yr <> {ad.ODD_YEAR}) OR (a.yr = {ad.ODD_YEAR} AND a.ctype <> 'Other interested' AND contest_name LIKE '%Segundo%')))
    OR (NOT awarded AND a.score - c.min_awarded_score <= 0))"""
GROUPS = """
grouped AS (
  SELECT *, 'Received bonus' AS data_group FROM sample WHERE bonus = 1 OR awarded = FALSE
  UNION ALL SELECT *, 'Never received bonus' FROM sample WHERE bonus = 0 OR awarded = FALSE
  UNION ALL SELECT *, 'All enrollees' FROM sample)"""
CTES = (ad.APP, ad.LAND, CUTS, SAMPLE)


@query("score_cutoffs", ad.sql(ad.APP, CUTS, body='SELECT yr AS ano_concurso, ctype AS "Contest type", min_awarded_score FROM cuts'))
def score_cutoffs(t):
    return cutoffs(t)


@query(
    "score_sample",
    ad.sql(
        *CTES,
        body="""
SELECT app_id, yr AS ano_concurso, ctype AS "Contest type", awarded AS "Awarded", bonus AS received_bonus, score_centered, years_since_contest, round(area_ha, 6) AS area_ha,
  "Forest", "Trees_2000", "Plantation_2001", pixels_count, round("Native" / nullif(pixels_count, 0), 4) AS "pct_Native", round("Forest" / nullif(pixels_count, 0), 4) AS "pct_Forest" FROM sample""",
    ),
)
def score_sample_query(t):
    out = score_sample(t)
    return out.select("app_id", "ano_concurso", "Contest type", "Awarded", "received_bonus", "score_centered", "years_since_contest",
                      F.round("area_ha", 6).alias("area_ha"), "Forest", "Trees_2000", "Plantation_2001", "pixels_count",
                      F.round("pct_Native", 4).alias("pct_Native"), F.round("pct_Forest", 4).alias("pct_Forest"))


@query(
    "sample_groups",
    ad.sql(*CTES, GROUPS, body="SELECT data_group, count(*) AS n, round(avg(score_centered), 6) AS mean_score FROM grouped GROUP BY data_group"),
)
def sample_groups(t):
    grouped = S.sample_groups(score_sample(t))
    return grouped.groupBy("data_group").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score_centered"), 6).alias("mean_score"))


_CENSOR = """
sized AS (SELECT app_id, prop_id, ctype, size_ha, c_acctbal / 50 + 150 AS polyarea,
  CASE WHEN region IN (5,6,7,8,9,10,14) THEN 200 WHEN region IN (11,12) THEN 800 ELSE 500 END AS size_cutoff FROM app JOIN customer ON c_custkey = prop_id)"""


@query(
    "censor_sample",
    ad.sql(
        ad.APP, _CENSOR,
        body="SELECT app_id, ctype AS \"Contest type\", size_cutoff FROM sized WHERE NOT (polyarea > size_cutoff AND ctype = 'Smallholder') AND abs(polyarea - size_ha) <= 30",
    ),
)
def censor_sample(t):
    from umbral.functions.scalars import region_cutoff

    app = ad.applications(t).withColumnRenamed("ctype", "Contest type").join(t.customer, col("c_custkey") == col("prop_id"))
    sized = app.withColumns({"polyarea": col("c_acctbal") / 50 + 150, "size_cutoff": region_cutoff("region")})
    out = S.censor_sample(sized, reported="size_ha", max_gap=30)
    return out.select("app_id", "Contest type", "size_cutoff")


@query(
    "binned_means",
    ad.sql(
        *CTES, GROUPS,
        """
win AS (SELECT * FROM grouped WHERE data_group = 'Received bonus' AND score_centered BETWEEN -6 AND 6),
bins AS (SELECT w.*, least(12, greatest(1, CAST(ceil((score_centered - lo) / ((hi - lo) / 12.0::DOUBLE)) AS INTEGER))) AS bin
  FROM win w, (SELECT min(score_centered) AS lo, max(score_centered) AS hi FROM win))""",
        body="SELECT bin, count(*) AS n, round(avg(score_centered), 4) AS score_centered, "
        + ", ".join(f'round(avg("{o}"), 4) AS "{o}"' for o in MEAN_OUTCOMES) + " FROM bins GROUP BY bin",
    ),
)
def binned_means(t):
    """Mean outcomes by distance to the contest cutoff, for the group that received the bonus."""
    grouped = S.sample_groups(score_sample(t)).where(col("data_group") == "Received bonus")
    out = K.binned_means(grouped, "score_centered", MEAN_OUTCOMES)
    return out.select("bin", "n", *[F.round(c, 4).alias(c) for c in ("score_centered", *MEAN_OUTCOMES)])


@query(
    "side_lines",
    ad.sql(
        *CTES,
        body="SELECT outcome, side, awarded AS \"Awarded\", count(*) AS n, round(regr_slope(y, score_centered), 5) AS slope, round(regr_intercept(y, score_centered), 4) AS intercept FROM ("
        + " UNION ALL ".join(
            f"SELECT '{o}' AS outcome, CASE WHEN score_centered <= 0 THEN 'left' ELSE 'right' END AS side, awarded, \"{o}\" AS y, score_centered FROM sample"
            for o in OUTCOMES
        )
        + ") GROUP BY ALL",
    ),
)
def side_lines(t):
    out = K.side_line(score_sample(t), "score_centered", OUTCOMES, ["Awarded"])
    return out.select("outcome", "side", "Awarded", "n", F.round("slope", 5).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query(
    "side_smooth",
    ad.sql(
        *CTES,
        """
m AS (SELECT CASE WHEN score_centered <= 0 THEN 'left' ELSE 'right' END AS side, CAST(score_centered AS DOUBLE) AS x, CAST("Forest" AS DOUBLE) AS y
  FROM sample WHERE score_centered IS NOT NULL AND "Forest" IS NOT NULL)""",
        """
ends AS (SELECT side, min(x) AS lo, max(x) AS hi FROM m GROUP BY side)""",
        """
grid AS (SELECT side, i, lo + i * (hi - lo) / 79.0::DOUBLE AS g FROM ends, range(80) AS t(i))""",
        """
band AS (SELECT side, i, g, quantile_cont(abs(x - g), 0.75) AS q FROM grid JOIN m USING (side) GROUP BY side, i, g)""",
        """
near AS (SELECT side, i, g, (x - g) / q AS u, y FROM band JOIN m USING (side) WHERE abs((x - g) / q) < 1)""",
        """
k AS (SELECT *, pow(1 - pow(abs(u), 3), 3) AS w FROM near)""",
        """
p AS (SELECT side, g, sum(w) AS s0, sum(w * u) AS s1, sum(w * u * u) AS s2, sum(w * u ** 3) AS s3, sum(w * u ** 4) AS s4,
    sum(w * y) AS y0, sum(w * y * u) AS y1, sum(w * y * u * u) AS y2 FROM k GROUP BY side, i, g)""",
        body="""
SELECT side, round(g, 6) AS xvals, round((y0 * (s2 * s4 - s3 * s3) - s1 * (y1 * s4 - s3 * y2) + s2 * (y1 * s3 - s2 * y2))
  / nullif(s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2), 0), 6) AS yvals FROM p""",
    ),
)
def side_smooth(t):
    """Local quadratic curve of one outcome on each side of the cutoff."""
    out = K.side_smooth(score_sample(t), "score_centered", "Forest")
    return out.select("side", F.round("xvals", 6).alias("xvals"), F.round("yvals", 6).alias("yvals"))


@query(
    "histogram_counts",
    ad.sql(
        *CTES,
        """
u AS (SELECT 'equal' AS kind, CAST(least(30, greatest(1, CAST(ceil((score_centered - lo) / ((hi - lo) / 30.0::DOUBLE)) AS INTEGER))) AS BIGINT) AS bin
  FROM sample, (SELECT min(score_centered) AS lo, max(score_centered) AS hi FROM sample)
  UNION ALL SELECT 'fixed', CAST(ceil(score_centered / 0.5::DOUBLE) AS BIGINT) FROM sample WHERE score_centered BETWEEN -5 AND 5)""",
        body="SELECT kind, bin, count(*) AS n FROM u GROUP BY kind, bin",
    ),
)
def histogram_counts(t):
    sample = score_sample(t)
    equal = K.histogram(sample, "score_centered").select(F.lit("equal").alias("kind"), "bin", "n")
    fixed = K.histogram(sample, "score_centered", width=0.5, limits=(-5, 5)).select(F.lit("fixed").alias("kind"), "bin", "n")
    return equal.unionByName(fixed)


@query(
    "treatment_by_bin",
    ad.sql(
        ad.APP,
        body="""
SELECT bin, small_yes, small_no, small_yes / (small_yes + small_no) AS prob_smallholder, bin * 25.0::DOUBLE - 12.5 AS bin_mid, bin * 25.0::DOUBLE - 12.5 <= 200 AS below_cutoff FROM (
  SELECT CAST(ceil(size_ha / 25.0::DOUBLE) AS INTEGER) AS bin, count(*) FILTER (ctype = 'Smallholder') AS small_yes, count(*) FILTER (ctype <> 'Smallholder') AS small_no
  FROM app WHERE size_ha > 0 AND size_ha <= 500 GROUP BY bin)""",
    ),
)
def treatment_by_bin(t):
    return K.treatment_by_bin(ad.applications(t), "size_ha", col("ctype") == "Smallholder", 0, 500, 25, 200)


@query(
    "count_by_bin",
    ad.sql(
        ad.APP,
        body="""
SELECT CAST(ceil(size_ha / 5.0::DOUBLE) AS INTEGER) AS bin, ceil(size_ha / 5.0::DOUBLE) * 5 AS bin_end, count(*) AS n FROM app
WHERE size_ha > 0 AND size_ha <= 500 AND ceil(size_ha / 5.0::DOUBLE) * 5 BETWEEN 125 AND 275 GROUP BY ALL""",
    ),
)
def count_by_bin(t):
    return K.count_by_bin(ad.applications(t), "size_ha", 0, 500, 5, (125, 275))


@query(
    "compliance",
    ad.sql(
        ad.APP,
        body="""
SELECT ctype, below, count, count / sum(count) OVER (PARTITION BY ctype) AS prop FROM (
  SELECT ctype, size_ha <= CASE WHEN region IN (5,6,7,8,9,10,14) THEN 200 WHEN region IN (11,12) THEN 800 ELSE 500 END AS below, count(*) AS count FROM app GROUP BY ALL)""",
    ),
)
def compliance(t):
    from umbral.functions.scalars import region_cutoff

    return K.compliance(ad.applications(t).withColumn("cut", region_cutoff("region")), "ctype", "size_ha", "cut")


@query("points_of_award", ad.sql(*CTES, body='SELECT score_centered, CAST(awarded AS INTEGER) AS "Awarded" FROM sample'))
def points_of_award(t):
    return K.jitter_free_points(score_sample(t), "score_centered", "Awarded")


Z1, Z2 = z_value(0.90), z_value(0.95)
_FLAGS = {"Flag:": ("A", "N", "R"), "Status:": ("F", "O")}


def _state(label: str, test: str) -> str:
    return f"CASE WHEN {test} THEN CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'highlighted' ELSE 'yes' END ELSE 'no' END AS \"{label}\""


@query(
    "spec_curve",
    f"""
WITH g AS (SELECT l_returnflag, l_linestatus, avg(l_extendedprice) / 1000 - 30 AS est, stddev_samp(l_extendedprice) / 1000 / sqrt(count(*)) AS se FROM lineitem GROUP BY ALL),
o AS (SELECT *, row_number() OVER (ORDER BY est, l_returnflag, l_linestatus) AS position FROM g)
SELECT CAST(position AS INTEGER) AS position, CAST(position + ceil(position / 3.0::DOUBLE) - 1 AS INTEGER) AS x, round(est, 6) AS estimate, round(est - {Z1!r} * se, 6) AS l1, round(est + {Z1!r} * se, 6) AS h1,
  round(est - {Z2!r} * se, 6) AS l2, round(est + {Z2!r} * se, 6) AS h2, {_state('A', "l_returnflag = 'A'")}, {_state('N', "l_returnflag = 'N'")}, {_state('R', "l_returnflag = 'R'")},
  {_state('F', "l_linestatus = 'F'")}, {_state('O', "l_linestatus = 'O'")}, l_returnflag = 'A' AND l_linestatus = 'F' AS highlighted,
  round(lo - (hi - lo) / 10, 6) AS ymin, round(hi + (hi - lo) / 10, 6) AS ymax
FROM o, (SELECT least(min(est - {Z2!r} * se), 0) AS lo, greatest(max(est + {Z2!r} * se), 0) AS hi FROM o)""",
)
def spec_curve(t):
    """Layout of mean-difference estimates by return flag and line status."""
    from umbral.operators.columns import pivot_flags

    specs = t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        (F.avg("l_extendedprice") / 1000 - 30).alias("estimate"),
        (F.stddev_samp("l_extendedprice") / 1000 / F.sqrt(F.count(F.lit(1)))).alias("se"),
    )
    specs = specs.withColumn("spec_seq", F.concat("l_returnflag", "l_linestatus"))
    specs = pivot_flags(pivot_flags(specs, "l_returnflag", ["A", "N", "R"]), "l_linestatus", ["F", "O"])
    out = K.spec_curve(specs, _FLAGS, group_size=3, order="increasing", highlight=col("A") & col("F"))
    rounded = [F.round(c, 6).alias(c) for c in ("estimate", "l1", "h1", "l2", "h2", "ymin", "ymax")]
    return out.select("position", "x", *rounded, "A", "N", "R", "F", "O", "highlighted")


# ---- estimators ---------------------------------------------------------------------------------


@query(
    "ols_two_regressors",
    """
WITH s AS (SELECT l_returnflag AS g, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, var_pop(x1) * count(*) AS s11, var_pop(x2) * count(*) AS s22, var_pop(y) * count(*) AS syy,
    covar_pop(x1, x2) * count(*) AS s12, covar_pop(x1, y) * count(*) AS s1y, covar_pop(x2, y) * count(*) AS s2y
  FROM (SELECT l_returnflag, l_quantity AS x1, l_discount * 100 AS x2, l_extendedprice / 1000 AS y FROM lineitem) GROUP BY l_returnflag),
b AS (SELECT *, s11 * s22 - s12 * s12 AS d, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM s),
e AS (SELECT *, (syy - b1 * s1y - b2 * s2y) / (n - 3) AS s2 FROM b)
SELECT g, 'quantity' AS term, round(b1, 5) AS estimate, round(sqrt(s2 * s22 / d), 5) AS se, round(b1 / sqrt(s2 * s22 / d), 3) AS t, n FROM e
UNION ALL SELECT g, 'discount', round(b2, 5), round(sqrt(s2 * s11 / d), 5), round(b2 / sqrt(s2 * s11 / d), 3), n FROM e""",
)
def ols_two_regressors(t):
    df = t.lineitem.select(
        col("l_returnflag").alias("g"), col("l_quantity").alias("quantity"), (col("l_discount") * 100).alias("discount"), (col("l_extendedprice") / 1000).alias("y")
    )
    fits = E.ols(df, "y", ["quantity", "discount"], ["g"]).where(col("term") != "(Intercept)")
    return fits.select("g", "term", F.round("estimate", 5).alias("estimate"), F.round("se", 5).alias("se"), F.round("t", 3).alias("t"), "n")


@query(
    "heap_jump",
    ad.sql(
        ad.APP,
        f"""
w AS (SELECT h.p AS heap_point, CASE WHEN size_ha = h.p THEN 1.0::DOUBLE ELSE 0 END AS x1, size_ha - h.p AS x2, CASE WHEN ctype = 'Smallholder' THEN 1.0::DOUBLE ELSE 0 END AS y
  FROM app JOIN (VALUES {HEAP_VALUES}) h(p, reach) ON size_ha BETWEEN h.p - reach AND h.p + reach),
s AS (SELECT heap_point, count(*) AS n, var_pop(x1) * count(*) AS s11, var_pop(x2) * count(*) AS s22, var_pop(y) * count(*) AS syy, covar_pop(x1, x2) * count(*) AS s12,
    covar_pop(x1, y) * count(*) AS s1y, covar_pop(x2, y) * count(*) AS s2y FROM w GROUP BY heap_point),
b AS (SELECT *, s11 * s22 - s12 * s12 AS d, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM s)""",
        body="SELECT heap_point, round(b1, 6) AS coeff, round(sqrt((syy - b1 * s1y - b2 * s2y) / (n - 3) * s22 / d), 6) AS se, n FROM b",
    ),
)
def heap_jump(t):
    app = ad.applications(t).withColumn("small", flag_equal("ctype", "Smallholder"))
    out = E.heap_jump(app, "small", "size_ha", HEAP_WINDOWS)
    return out.select("heap_point", F.round("coeff", 6).alias("coeff"), F.round("se", 6).alias("se"), "n")


_IV_OUTCOMES = ("area", "amount", "timber", "paid")
_IV_BANDWIDTHS = (120, 80, 60)


@query(
    "iv_donut_grid",
    ad.sql(
        ad.APP,
        """
src AS (SELECT size_ha - 200 AS x, CASE WHEN ctype = 'Smallholder' THEN 1.0::DOUBLE ELSE 0 END AS d, CASE WHEN size_ha <= 200 THEN 1.0::DOUBLE ELSE 0 END AS z,
    CASE WHEN app_id % 3 = 0 THEN NULL ELSE area / 100 END AS area, amount / 1000 AS amount, CASE WHEN status = 'F' THEN 1.0::DOUBLE ELSE 0 END AS timber, CAST(bonus AS DOUBLE) AS paid
  FROM app WHERE size_ha IS NOT NULL),
long AS (SELECT o.outcome, CASE o.outcome WHEN 'area' THEN area WHEN 'amount' THEN amount WHEN 'timber' THEN timber ELSE paid END AS y, x, d, z, bw
  FROM src, (VALUES ('area'), ('amount'), ('timber'), ('paid')) o(outcome), (VALUES (120.0::DOUBLE), (80), (60)) b(bw)
  WHERE NOT (x BETWEEN -3 AND 0) AND x >= -bw - 3 AND x <= bw),
s AS (SELECT outcome, bw, count(*) AS n, covar_pop(z, y) - covar_pop(x, z) * covar_pop(x, y) / var_pop(x) AS zy, covar_pop(z, d) - covar_pop(x, z) * covar_pop(x, d) / var_pop(x) AS zd
  FROM long WHERE y IS NOT NULL GROUP BY outcome, bw)""",
        body="SELECT outcome, bw, round(zy / zd, 3) AS coeff, n, 3 AS donut FROM s",
    ),
)
def iv_donut_grid(t):
    app = ad.applications(t).withColumns(
        {
            "size_centered": center("size_ha", 200),
            "smallholder": flag_equal("ctype", "Smallholder"),
            "below_cutoff": col("size_ha") <= 200,
            "area": F.when(col("app_id") % 3 != 0, col("area") / 100),
            "amount": col("amount") / 1000,
            "timber": flag_equal("status", "F"),
            "paid": col("bonus"),
        }
    )
    out = E.donut_iv_grid(app, _IV_OUTCOMES, _IV_BANDWIDTHS, 3)
    return out.select("outcome", "bw", F.round("coeff", 3).alias("coeff"), "n", "donut")


@query(
    "welch_means",
    ad.sql(
        ad.APP,
        """
h AS (SELECT *, CASE WHEN size_ha BETWEEN 199 AND 200 AND ctype = 'Smallholder' THEN 'smallholder heaper'
    WHEN size_ha BETWEEN 200.01 AND 225 AND ctype <> 'Smallholder' THEN 'other interested just over' END AS g FROM app),
v AS (SELECT g, 'amount' AS variable, amount / 1000 AS y FROM h UNION ALL SELECT g, 'score', score FROM h UNION ALL SELECT g, 'timber', CASE WHEN status = 'F' THEN 1.0::DOUBLE ELSE 0 END FROM h),
s AS (SELECT variable, count(*) FILTER (g LIKE 'other%') AS n_1, count(*) FILTER (g LIKE 'small%') AS n_2, avg(y) FILTER (g LIKE 'other%') AS m1, avg(y) FILTER (g LIKE 'small%') AS m2,
    var_samp(y) FILTER (g LIKE 'other%') AS v1, var_samp(y) FILTER (g LIKE 'small%') AS v2 FROM v WHERE g IS NOT NULL GROUP BY variable)""",
        body="""
SELECT variable, n_1, n_2, round(m1, 6) AS mean_1, round(m2, 6) AS mean_2, round((m1 - m2) / sqrt(v1 / n_1 + v2 / n_2), 5) AS t,
  round((v1 / n_1 + v2 / n_2) * (v1 / n_1 + v2 / n_2) / (v1 / n_1 * v1 / n_1 / (n_1 - 1) + v2 / n_2 * v2 / n_2 / (n_2 - 1)), 4) AS df FROM s""",
    ),
)
def welch_means(t):
    from umbral.functions.scalars import heap_category

    app = ad.applications(t).withColumns(
        {"g": heap_category("size_ha", col("ctype") == "Smallholder"), "amount": col("amount") / 1000, "timber": flag_equal("status", "F")}
    )
    out = E.welch_t(app, "g", ["amount", "score", "timber"], ("smallholder heaper", "other interested just over"))
    return out.select("variable", "n_1", "n_2", *[F.round(c, 6).alias(c) for c in ("mean_1", "mean_2")], F.round("t", 5).alias("t"), F.round("df", 4).alias("df"))


@query("effect_plot")
def effect_plot(t):
    """Effect of an award along the years since the contest, from a fit with their product.

    The fit takes the bonus sample within the bandwidth selected on it; the years are those of the fit's rows.
    """
    controls = ["Trees_2000", "Development_2000", "Grassland_2000", "Plantation_2001", "Water_2000", "Crop_2000"]
    bonus = score_sample(t).where((col("received_bonus") == 1) | (col("Awarded") == F.lit(False))).withColumn("Award", col("Awarded").cast("int"))
    width = rd_bandwidth(bonus, "Native", "score_centered", controls).agg(F.max("h").alias("_h"))
    xs = ["score_centered", "Award", "years_since_contest", ("Award", "years_since_contest"), *controls]
    near = cross_1row(bonus, width).where(F.abs(col("score_centered")) <= F.col("_h"))
    near = near.dropna(subset=["Native", "score_centered", "Award", "years_since_contest", *controls])
    years = near.agg(F.min("years_since_contest").alias("_from"), F.max("years_since_contest").alias("_to"))
    fits = cross_1row(E.ols(near, "Native", xs), years)
    terms = ["(Intercept)", *[E.term_name(x) for x in xs]]
    out = K.effect_plot_data(fits, "Award", "years_since_contest", terms, F.col("_from"), F.col("_to"))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(
    "ecdf_masspoints",
    """
SELECT l_returnflag, l_extendedprice, n, CAST(cum_n AS BIGINT) AS cum_n, cum_n / total AS share FROM (
  SELECT *, sum(n) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS cum_n, sum(n) OVER (PARTITION BY l_returnflag) AS total
  FROM (SELECT l_returnflag, l_extendedprice, count(*) AS n FROM lineitem GROUP BY ALL))""",
)
def ecdf_masspoints(t):
    return ecdf(t.lineitem, "l_extendedprice", ["l_returnflag"])
