"""Queries for record linkage and the administrative tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from umbral.functions.scalars import col
from umbral.functions.text import normalise_id
from umbral.operators import aggregates as A
from umbral.operators import linkage as L
from umbral.plans import adapters as ad
from umbral.plans.registry import query


def cadastre(t):
    first, second = ad.cadastre_sources(t)
    return L.cadastre_union([(first, "first", 1), (second, "second", 0)])


@query("cadastre_union", ad.sql(ad.CAD, body="SELECT * FROM cad"))
def cadastre_union(t):
    return cadastre(t)


_MATCH = """
cand AS (
  SELECT a.app_id, a.prop_id, a.ROL, a.comuna, a.yr, c.poly_id, c.polyarea, abs(c.polyarea - a.size_ha) AS area_diff,
    damerau_levenshtein(lower(strip_accents(a.comuna)), c.desccomu) AS dist, c.src_prty, a.rol_prty + c.rol_prty_ciren AS id_prty
  FROM appv a JOIN cad c ON a.ROL IS NOT DISTINCT FROM c.ROL
  WHERE damerau_levenshtein(lower(strip_accents(a.comuna)), c.desccomu) <= 1),
matched AS (
  SELECT * FROM (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY prop_id, ROL, comuna
    ORDER BY dist, area_diff NULLS FIRST, src_prty DESC, id_prty DESC, poly_id, app_id) = 1) WHERE area_diff IS NOT NULL)"""

APP_COLS = ("app_id", "prop_id", "comuna", "yr", "size_ha", "rol")


def matched(t, **kw):
    apps = ad.applications(t).select(*APP_COLS)
    return L.match_by_id(apps, cadastre(t), ties=["poly_id", "app_id"], **kw)


@query(
    "match_by_id",
    ad.sql(
        ad.APP, ad.CAD, ad.APP_VARIANTS, _MATCH,
        body="SELECT app_id, prop_id, ROL, comuna, yr, poly_id, round(polyarea, 6) AS polyarea, round(area_diff, 6) AS area_diff, CAST(dist AS INTEGER) AS name_dist, src_prty FROM matched",
    ),
)
def match_by_id(t):
    out = matched(t)
    return out.select("app_id", "prop_id", "ROL", "comuna", "yr", "poly_id", F.round("polyarea", 6).alias("polyarea"),
                      F.round("area_diff", 6).alias("area_diff"), "name_dist", "src_prty")


@query(
    "match_rate",
    ad.sql(
        ad.APP, ad.CAD, ad.APP_VARIANTS, _MATCH,
        body="""
SELECT (SELECT count(*) FROM (SELECT DISTINCT prop_id FROM matched)) AS n_matched, (SELECT count(*) FROM (SELECT DISTINCT prop_id FROM app)) AS n_all,
  (SELECT count(*) FROM (SELECT DISTINCT prop_id FROM matched)) / (SELECT count(*) FROM (SELECT DISTINCT prop_id FROM app)) AS rate""",
    ),
)
def match_rate(t):
    return A.distinct_ratio(matched(t), ad.applications(t), "prop_id")


@query(
    "match_rejected",
    ad.sql(
        ad.APP, ad.CAD, ad.APP_VARIANTS,
        body="""
SELECT a.app_id, a.comuna, a.yr, a.ctype, a.score, a.ROL, c.poly_id, round(c.polyarea, 6) AS polyarea
FROM appv a JOIN cad c ON a.ROL IS NOT DISTINCT FROM c.ROL
WHERE NOT a.awarded AND damerau_levenshtein(lower(strip_accents(a.comuna)), c.desccomu) <= 1
QUALIFY row_number() OVER (PARTITION BY a.app_id, a.comuna, a.yr, a.ctype, a.score ORDER BY c.src_prty DESC, c.poly_id, a.ROL) = 1""",
    ),
)
def match_rejected(t):
    group = ["app_id", "comuna", "yr", "ctype", "score"]
    rejected = ad.applications(t).where(~col("awarded")).select(*group, "rol")
    out = L.match_rejected(rejected, cadastre(t), group)
    return out.select(*group, "ROL", "poly_id", F.round("polyarea", 6).alias("polyarea"))


@query(
    "unmatched",
    ad.sql(
        ad.APP, ad.CAD, ad.APP_VARIANTS,
        body="SELECT app_id, ROL, rol_prty FROM appv a WHERE NOT awarded AND NOT EXISTS (SELECT 1 FROM cad c WHERE a.ROL IS NOT DISTINCT FROM c.ROL)",
    ),
)
def unmatched(t):
    rejected = ad.applications(t).where(~col("awarded")).select("app_id", "rol")
    return L.unmatched(rejected, cadastre(t)).select("app_id", "ROL", "rol_prty")


_SPATIAL = """
spat AS (
  SELECT a.app_id, a.prop_id, a.ROL, a.comuna, c_custkey AS poly_id, c_acctbal / 50 + 150 AS polyarea,
    abs(c_acctbal / 50 + 150 - a.size_ha) AS area_diff, 0 AS match_prty
  FROM appv a JOIN customer ON c_custkey = prop_id WHERE a.rol_prty = 0),
stacked AS (
  SELECT * FROM spat UNION ALL
  SELECT app_id, prop_id, ROL, comuna, poly_id, polyarea, area_diff, 1 FROM matched)"""


@query(
    "combine_matches",
    ad.sql(
        ad.APP, ad.CAD, ad.APP_VARIANTS, _MATCH, _SPATIAL,
        body="""
SELECT app_id, prop_id, ROL, comuna, poly_id, match_prty, round(area_diff, 6) AS area_diff FROM (
  SELECT * FROM stacked QUALIFY row_number() OVER (PARTITION BY prop_id, ROL, comuna
    ORDER BY match_prty DESC, area_diff NULLS FIRST, poly_id, app_id) = 1) WHERE area_diff <= 200""",
    ),
)
def combine_matches(t):
    apps = ad.applications(t).select(*APP_COLS).withColumn("ROL", normalise_id("rol"))
    by_place = apps.join(t.customer, col("prop_id") == col("c_custkey")).select(
        "app_id", "prop_id", "ROL", "comuna", col("c_custkey").alias("poly_id"),
        F.abs(col("c_acctbal") / 50 + 150 - col("size_ha")).alias("area_diff"), F.lit(0).alias("match_prty"),
    )
    cols = ["app_id", "prop_id", "ROL", "comuna", "poly_id", "area_diff", "match_prty"]
    out = L.combine_matches([by_place, matched(t)], cols, ["prop_id", "ROL", "comuna"], ["poly_id", "app_id"])
    return out.withColumn("area_diff", F.round("area_diff", 6))


@query(
    "match_stands",
    ad.sql(
        ad.STANDS, ad.STAND_ACTIVITIES,
        body="""
SELECT request, resolution, stand, stand_area, stand_year, activity, round(area_difference, 6) AS area_difference, year_difference FROM (
  SELECT *, min(area_difference) OVER (PARTITION BY activity, stand_year, resolution) AS m FROM (
    SELECT s.*, a.activity, stand_area - activity_area AS area_difference, TRY_CAST(stand_year AS DOUBLE) - activity_year AS year_difference
    FROM stands s LEFT JOIN acts a ON s.request IS NOT DISTINCT FROM a.request))
WHERE year_difference = 0 OR year_difference IS NULL OR area_difference = m""",
    ),
)
def match_stands(t):
    out = L.match_stands(
        ad.stands(t), ad.stand_activities(t), ["request"], ["activity", "stand_year", "resolution"],
        "stand_area", "activity_area", "stand_year", "activity_year",
    )
    return out.select("request", "resolution", "stand", "stand_area", "stand_year", "activity",
                      F.round("area_difference", 6).alias("area_difference"), "year_difference")


def admin_tables(t):
    """Projects, properties and owners with unmatched and missing keys on each side."""
    key = col("o_orderkey")
    projects = t.orders.select(
        F.when(key % 20 == 0, -1 - key).when(key != 21, key).alias("rptpro_id"),
        F.year("o_orderdate").alias("rptpro_ano"),
        F.when(col("o_orderpriority") == "5-LOW", None)
        .when(col("o_orderpriority") == "1-URGENT", "Otros Interesados")
        .otherwise("Pequenos Propietarios")
        .alias("rptpro_tipo_concurso"),
        F.when(key % 3 == 0, "Si").when(key % 3 == 1, "No").alias("rptpro_tiene_bonificacion_saff"),
        F.when(key % 4 == 0, "Si").when(key % 4 == 1, "No").alias("rptpro_tiene_plan_saff"),
    )
    ok = col("l_orderkey")
    properties = t.lineitem.select(
        (ok * 10 + col("l_linenumber")).alias("rptpre_id"),
        F.when(col("l_partkey") % 100 != 7, ok).alias("rptpro_id"),
        F.when(ok % 9 == 0, None)
        .when(ok % 9 == 1, col("l_partkey").cast("string"))
        .when(ok % 9 == 2, F.concat("l_partkey", F.lit("/"), "l_suppkey", F.lit("."), "l_linenumber"))
        .otherwise(F.concat("l_partkey", F.lit("-"), "l_suppkey"))
        .alias("rptpre_rol"),
    )
    prop = ok * 10 + col("l_linenumber") + F.when(ok % 13 == 0, 1).otherwise(0)
    owners = t.lineitem.select(
        F.when(col("l_suppkey") % 3 == 0, prop).otherwise(ad.OTHER_KEYS - prop).alias("rptpre_id"), col("l_suppkey").alias("owner")
    )
    return projects, properties, owners


ADMIN = f"""
projects AS (
  SELECT CASE WHEN o_orderkey % 20 = 0 THEN -1 - o_orderkey WHEN o_orderkey <> 21 THEN o_orderkey END AS rptpro_id, CAST(year(o_orderdate) AS INTEGER) AS rptpro_ano,
    CASE o_orderpriority WHEN '5-LOW' THEN NULL WHEN '1-URGENT' THEN 'Otros Interesados' ELSE 'Pequenos Propietarios' END AS tipo,
    CASE o_orderkey % 3 WHEN 0 THEN 'Si' WHEN 1 THEN 'No' END AS bono, CASE o_orderkey % 4 WHEN 0 THEN 'Si' WHEN 1 THEN 'No' END AS plan
  FROM orders),
properties AS (
  SELECT l_orderkey * 10 + l_linenumber AS rptpre_id, CASE WHEN l_partkey % 100 <> 7 THEN l_orderkey END AS rptpro_id,
    CASE l_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN CAST(l_partkey AS VARCHAR)
      WHEN 2 THEN l_partkey || '/' || l_suppkey || '.' || l_linenumber ELSE l_partkey || '-' || l_suppkey END AS rptpre_rol FROM lineitem),
owners AS (
  SELECT CASE WHEN l_suppkey % 3 = 0 THEN k ELSE {ad.OTHER_KEYS} - k END AS rptpre_id, l_suppkey AS owner
  FROM (SELECT *, l_orderkey * 10 + l_linenumber + CASE WHEN l_orderkey % 13 = 0 THEN 1 ELSE 0 END AS k FROM lineitem)),
pp AS (
  SELECT coalesce(a.rptpro_id, b.rptpro_id) AS rptpro_id, rptpro_ano, tipo, bono, plan, rptpre_id, rptpre_rol
  FROM projects a FULL JOIN properties b ON a.rptpro_id IS NOT DISTINCT FROM b.rptpro_id),
prop AS (
  SELECT coalesce(a.rptpre_id, b.rptpre_id) AS rptpre_id, rptpro_id, rptpro_ano, tipo, bono, plan, rptpre_rol, owner
  FROM pp a FULL JOIN owners b ON a.rptpre_id IS NOT DISTINCT FROM b.rptpre_id)"""

_PIECE = "string_split_regex(rptpre_rol, '[^\\p{L}\\p{N}]+')"


@query(
    "property_table",
    ad.sql(
        ADMIN,
        body=f"""
SELECT rptpre_id, rptpro_id, rptpro_ano, owner, CASE WHEN tipo = 'Otros Interesados' THEN 'Other interested' WHEN tipo IS NOT NULL THEN 'Smallholder' END AS "Contest type",
  CASE WHEN bono IS NULL OR bono = 'No' THEN 0 ELSE 1 END AS received_bonus, CASE WHEN plan IS NULL OR plan = 'No' THEN 0 ELSE 1 END AS submitted_management_plan,
  coalesce({_PIECE}[1], 'NA') || '-' || coalesce({_PIECE}[2], 'NA') AS "ROL", CASE WHEN {_PIECE}[3] IS NULL THEN 0 ELSE 1 END AS additional_props FROM prop""",
    ),
)
def property_table(t):
    out = L.build_property_table(*admin_tables(t))
    return out.select("rptpre_id", "rptpro_id", "rptpro_ano", "owner", "Contest type", "received_bonus",
                      "submitted_management_plan", "ROL", "additional_props")


@query(
    "build_activity_flags",
    ad.sql(
        ADMIN,
        body="SELECT rptpro_id, rptpro_ano, "
        + ", ".join(f"max(CASE WHEN event_type = '{e}' THEN 1 ELSE 0 END) AS \"{e}\"" for e in ad.EVENT_TYPES)
        + """ FROM (SELECT DISTINCT rptpro_id, rptpro_ano, rptpre_id FROM prop) p
LEFT JOIN (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS rptpre_id, l_partkey AS rptro_id FROM lineitem WHERE l_linenumber < 5) s
  ON p.rptpre_id IS NOT DISTINCT FROM s.rptpre_id
LEFT JOIN (SELECT DISTINCT user_id * 7 AS rptro_id, event_type FROM events WHERE value > 400) a ON s.rptro_id IS NOT DISTINCT FROM a.rptro_id
GROUP BY ALL""",
    ),
)
def build_activity_flags(t):
    """Activity types of a project's stands as 0/1 columns."""
    table = L.build_property_table(*admin_tables(t))
    prop, stand = col("l_orderkey") * 10 + col("l_linenumber"), col("user_id") * 7
    stands = t.lineitem.select(ad.missing_key(col("l_linenumber") < 5, prop, prop).alias("rptpre_id"), col("l_partkey").alias("rptro_id"))
    acts = t.events.select(ad.missing_key(col("value") > 400, stand, stand).alias("rptro_id"), col("event_type").alias("rptac_tipo"))
    return L.build_activity_flags(table, stands, acts, ad.EVENT_TYPES)


@query(
    "size_sample",
    ad.sql(
        ad.APP,
        body="""
SELECT app_id, prop_id, yr, size_cutoff, round(size_ha - size_cutoff, 6) AS size_centered, size_ha <= size_cutoff AS below_cutoff,
  CASE WHEN ctype = 'Other interested' THEN 0 ELSE 1 END AS smallholder, amount / nullif(size_ha, 0) AS price_per_hectare,
  area / nullif(size_ha, 0) AS proportion_bonusarea
FROM (SELECT *, CASE WHEN region IN (5,6,7,8,9,10,14) THEN 200 WHEN region IN (11,12) THEN 800 ELSE 500 END AS size_cutoff FROM app
  QUALIFY row_number() OVER (PARTITION BY prop_id, yr ORDER BY app_id) = 1)""",
    ),
)
def size_sample(t):
    app = ad.applications(t).withColumnRenamed("ctype", "Contest type")
    out = L.build_size_sample(
        app, None, ["prop_id", "yr"], ["app_id"], size="size_ha", region="region", bonus=None, amount="amount", bonus_area="area"
    )
    return out.select("app_id", "prop_id", "yr", "size_cutoff", F.round("size_centered", 6).alias("size_centered"), "below_cutoff",
                      "smallholder", "price_per_hectare", "proportion_bonusarea")
