"""Queries for scans, projections, filters, joins, aggregates, ranking and scalar functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from umbral.functions import scalars as S
from umbral.functions import text as X
from umbral.operators import aggregates as A
from umbral.operators import columns as C
from umbral.operators import filters as W
from umbral.operators import joins as J
from umbral.operators import ordering as O
from umbral.operators import ranking as R
from umbral.plans import adapters as ad
from umbral.plans.registry import query
from umbral.session import stage_root
from umbral.sources.stages import read_stage, write_csv, write_stage
from umbral.sources.tables import read_folder_union, read_tables

col = S.col


@query("scan_union_by_name", "SELECT * FROM customer UNION ALL BY NAME SELECT * FROM supplier")
def scan_union_by_name(t):
    return read_folder_union(t.spark, [f"{t.folder}/customer.parquet", f"{t.folder}/supplier.parquet"])


@query(
    "stage_csv_roundtrip",
    "SELECT c_custkey, c_name, c_acctbal, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
def stage_csv_roundtrip(t):
    """Columnar stage for one table, text for the other, joined after reading both back."""
    root = f"{stage_root(t.spark)}/roundtrip-{uuid.uuid4().hex}"
    src = read_tables(t.spark, t.folder, ["customer", "nation"])
    customer = src["customer"].select("c_custkey", "c_name", "c_nationkey")
    balance = src["customer"].select("c_custkey", "c_acctbal")
    write_stage(customer, f"{root}/customer")
    write_csv(balance, f"{root}/balance")
    back = read_stage(t.spark, f"{root}/customer")
    text = t.spark.read.schema(balance.schema).option("header", True).csv(f"{root}/balance")
    named = J.join_inner(back.withColumnRenamed("c_nationkey", "n_nationkey"), src["nation"], ["n_nationkey"])
    return J.join_inner(named, text, ["c_custkey"]).select("c_custkey", "c_name", "c_acctbal", "n_name")


@query(
    "select_regex_rename",
    'SELECT l_orderkey AS app_id, l_linenumber AS stand, l_shipdate, l_extendedprice AS price, l_discount AS "Discount rate" FROM lineitem',
)
def select_regex_rename(t):
    df = C.select_matching(t.lineitem, ["PRICE$", "^L_disc", "ship"], also=["l_orderkey", "l_linenumber"])
    df = C.rename(df, {0: "app_id", "l_linenumber": "stand", "l_extendedprice": "price", "l_discount": "Discount rate"})
    return C.select_cols(df, ["app_id", "stand", "l_shipdate", "price", "Discount rate"])


@query(
    "derived_columns",
    ad.sql(
        ad.APP,
        body="""
SELECT app_id, round(score - 42, 6) AS score_centered, round(abs(size_ha - area), 6) AS area_diff,
  round(size_ha - area, 6) AS signed_area_diff, 2021 - yr AS years_since_contest, round(app_id * 0.0225::DOUBLE, 6) AS area_px_ha,
  amount / nullif(size_ha, 0) AS price_per_hectare, round(size_ha + area, 6) AS both_areas,
  coalesce(size_ha, area) AS any_area, 'program' AS source, size_ha <= 200 AS below_cutoff FROM app""",
    ),
)
def derived_columns(t):
    app = ad.applications(t)
    out = C.with_columns(
        app,
        {
            "score_centered": F.round(S.center("score", 42), 6),
            "area_diff": F.round(S.abs_diff("size_ha", "area"), 6),
            "signed_area_diff": F.round(S.signed_diff("size_ha", "area"), 6),
            "years_since_contest": S.years_since("yr"),
            "area_px_ha": F.round(S.pixels_to_ha("app_id"), 6),
            "price_per_hectare": S.ratio("amount", "size_ha"),
            "both_areas": F.round(S.class_total("size_ha", "area"), 6),
            "any_area": S.coalesce_cols("size_ha", "area"),
            "source": F.lit("program"),
            "below_cutoff": col("size_ha") <= 200,
        },
    )
    return C.select_cols(
        out,
        ["app_id", "score_centered", "area_diff", "signed_area_diff", "years_since_contest", "area_px_ha",
         "price_per_hectare", "both_areas", "any_area", "source", "below_cutoff"],
    )


_RATIO = ("Native", "Pine", "Grassland/Ag")


@query(
    "across_ratio_round",
    ad.sql(
        ad.LAND,
        body="""
SELECT app_id, round("Native" / nullif(pixels_count, 0), 4) AS "pct_Native", round("Pine" / nullif(pixels_count, 0), 4) AS "pct_Pine",
  round("Grassland/Ag" / nullif(pixels_count, 0), 4) AS "pct_Grassland/Ag",
  coalesce("Native", 0) + coalesce("Pine", 0) + coalesce("Grassland/Ag", 0) AS three,
  CASE WHEN "Native" > 20 THEN "Native" ELSE 0 END AS large_native FROM land""",
    ),
)
def across_ratio_round(t):
    df = C.across_ratio(ad.landcover(t), _RATIO, "pixels_count")
    pct = [f"pct_{c}" for c in _RATIO]
    df = C.across_apply(df, pct, lambda c: F.round(c, 4))
    df = df.withColumns({"three": S.row_sum(*_RATIO), "large_native": F.when(col("Native") > 20, col("Native"))})
    return C.fill_zero(C.select_cols(df, ["app_id", *pct, "three", "large_native"]), ["large_native"])


@query(
    "row_ids",
    ad.sql(
        ad.APP,
        body="""
SELECT app_id, row_id, yr FROM (SELECT app_id, yr, ctype, row_number() OVER (ORDER BY score, app_id) AS row_id FROM app)
WHERE ctype = 'Smallholder'""",
    ),
)
def row_ids(t):
    """Positions of the small applicants in the list sorted by score."""
    app = ad.applications(t).select("app_id", "yr", "ctype", "score")
    hits = O.which_rows(app, col("ctype") == "Smallholder", ["score", "app_id"], "row_id")
    return hits.select("app_id", "row_id", "yr")


@query(
    "pred_three_valued",
    ad.sql(ad.APP, body="SELECT app_id, bonus, awarded FROM app WHERE (bonus = 1 OR awarded = FALSE) AND size_ha IS NOT NULL"),
)
def pred_three_valued(t):
    df = W.filter_pred(ad.applications(t), (col("bonus") == 1) | (col("awarded") == F.lit(False)))
    return W.drop_na(df, ["size_ha"]).select("app_id", "bonus", "awarded")


@query(
    "between_in_regex",
    ad.sql(
        ad.APP,
        body="SELECT app_id, region FROM app WHERE size_ha BETWEEN 198 AND 225 AND region IN (5,6,7,8,9,10,14) AND regexp_matches(contest_name, 'Segundo')",
    ),
)
def between_in_regex(t):
    df = ad.applications(t).where(
        W.between_closed("size_ha", 198, 225) & W.is_in("region", S.REGIONS_200) & W.regex_like("contest_name", "Segundo")
    )
    return df.select("app_id", "region")


@query(
    "in_column",
    """
WITH a AS (SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey END AS k FROM orders),
b AS (SELECT CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey END AS k FROM customer WHERE c_acctbal > 0 AND c_custkey % 3 = 0)
SELECT o_orderkey, k FROM a WHERE EXISTS (SELECT 1 FROM b WHERE a.k IS NOT DISTINCT FROM b.k)""",
)
def in_column(t):
    a = t.orders.select("o_orderkey", F.when(col("o_custkey") % 10 != 0, col("o_custkey")).alias("k"))
    key = F.when(col("c_custkey") % 7 != 0, col("c_custkey"))
    b = t.customer.select(ad.missing_key((col("c_acctbal") > 0) & (col("c_custkey") % 3 == 0), key, col("c_custkey")).alias("k"))
    return W.in_column(a, "k", b)


@query(
    "range_of_other",
    """
SELECT o_orderkey, o_totalprice FROM orders
WHERE o_totalprice BETWEEN (SELECT min(v) FROM (SELECT avg(l_extendedprice) * 3 AS v FROM lineitem GROUP BY l_suppkey))
  AND (SELECT max(v) FROM (SELECT avg(l_extendedprice) * 3 AS v FROM lineitem GROUP BY l_suppkey))""",
)
def range_of_other(t):
    means = t.lineitem.groupBy("l_suppkey").agg((F.avg("l_extendedprice") * 3).alias("v"))
    return W.range_of_other(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", means, "v")


@query(
    "donut_sample",
    ad.sql(
        ad.APP,
        body="""
SELECT app_id, round(size_ha - 200, 6) AS size_centered FROM app
WHERE NOT (size_ha - 200 BETWEEN -3 AND 0) AND size_ha - 200 >= -60 - 3 AND size_ha - 200 <= 60""",
    ),
)
def donut_sample(t):
    df = ad.applications(t).withColumn("size_centered", S.center("size_ha", 200)).where(W.donut("size_centered", 3, 60))
    return df.select("app_id", F.round("size_centered", 6).alias("size_centered"))


_NULL_KEYS = """
a AS (SELECT o_orderkey AS app_id, CASE WHEN o_orderkey % 500 = 1 THEN NULL ELSE o_custkey END AS prop_id, o_totalprice AS val FROM orders),
b AS (SELECT CASE WHEN c_custkey % 50 = 1 THEN NULL WHEN c_custkey % 4 = 2 THEN -1 - c_custkey ELSE c_custkey END AS prop_id, c_acctbal AS val FROM customer)"""


def _null_keys(t):
    a = t.orders.select(
        col("o_orderkey").alias("app_id"),
        F.when(col("o_orderkey") % 500 != 1, col("o_custkey")).alias("prop_id"),
        col("o_totalprice").alias("val"),
    )
    key = F.when(col("c_custkey") % 50 != 1, col("c_custkey"))
    b = t.customer.select(ad.missing_key(col("c_custkey") % 4 != 2, key, col("c_custkey")).alias("prop_id"), col("c_acctbal").alias("val"))
    return a, b


@query(
    "join_null_safe",
    ad.sql(
        _NULL_KEYS,
        body="SELECT a.prop_id, app_id, a.val AS val_x, b.val AS val_y FROM a JOIN b ON a.prop_id IS NOT DISTINCT FROM b.prop_id",
    ),
)
def join_null_safe(t):
    return J.join_inner(*_null_keys(t), ["prop_id"])


@query(
    "join_left_multi",
    """
SELECT l_orderkey, l_suppkey, l_linenumber, o_orderstatus FROM lineitem
LEFT JOIN (SELECT o_orderkey, o_custkey % 100 AS sk, o_orderstatus FROM orders) o ON l_orderkey = o_orderkey AND l_suppkey = sk""",
)
def join_left_multi(t):
    o = t.orders.select(col("o_orderkey").alias("l_orderkey"), (col("o_custkey") % 100).alias("l_suppkey"), "o_orderstatus")
    return J.join_left(t.lineitem.select("l_orderkey", "l_suppkey", "l_linenumber"), o, ["l_orderkey", "l_suppkey"])


@query(
    "join_right_fill",
    """
SELECT coalesce(total, 0) AS total, o_orderkey AS app_id, o_orderstatus FROM orders
LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS total FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""",
)
def join_right_fill(t):
    totals = A.group_sum(t.lineitem, ["l_orderkey"], "l_quantity", "total").withColumnRenamed("l_orderkey", "app_id")
    zones = t.orders.select(col("o_orderkey").alias("app_id"), "o_orderstatus")
    return C.fill_zero(J.join_right(totals, zones, ["app_id"]), ["total"])


@query(
    "join_full_coalesce",
    ad.sql(
        _NULL_KEYS,
        body="""
SELECT coalesce(a.prop_id, b.prop_id) AS prop_id, app_id, a.val AS val_x, b.val AS val_y
FROM a FULL JOIN b ON a.prop_id IS NOT DISTINCT FROM b.prop_id""",
    ),
)
def join_full_coalesce(t):
    return J.join_full(*_null_keys(t), ["prop_id"])


@query(
    "join_anti_variants",
    ad.sql(_NULL_KEYS, body="SELECT app_id, prop_id, val FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.prop_id IS NOT DISTINCT FROM b.prop_id)"),
)
def join_anti_variants(t):
    return J.join_anti(*_null_keys(t), ["prop_id"])


# ---- fixed values: heap points ------------------------------------------------------------------
HEAPS = (10, 20, 30, 40, 50, 70, 100, 150, 200, 300, 400, 500)
# -----------------------------------------------------------------------------------------------


def heap_reach(point: float) -> float:
    """Half width of the window around a heap point."""
    return 9.99 if point < 100 else (99.99 if point >= 200 else 49.99)


HEAP_WINDOWS = tuple((p, heap_reach(p)) for p in HEAPS)
HEAP_VALUES = ", ".join(f"({p}::DOUBLE, {w}::DOUBLE)" for p, w in HEAP_WINDOWS)


@query(
    "join_heap_windows",
    ad.sql(
        ad.APP,
        body=f"""
SELECT app_id, heap_point, round(size_ha - heap_point, 6) AS distance FROM app
JOIN (VALUES {HEAP_VALUES}) h(heap_point, reach) ON size_ha BETWEEN heap_point - reach AND heap_point + reach""",
    ),
)
def join_heap_windows(t):
    df = J.join_window(ad.applications(t), "size_ha", HEAP_WINDOWS, "heap_point")
    return df.select("app_id", "heap_point", F.round(col("size_ha") - col("heap_point"), 6).alias("distance"))


@query(
    "group_counts_share",
    ad.sql(
        ad.APP,
        body="""
SELECT ctype, below, n, n / sum(n) OVER (PARTITION BY ctype) AS share
FROM (SELECT ctype, size_ha <= 200 AS below, count(*) AS n FROM app GROUP BY ALL)""",
    ),
)
def group_counts_share(t):
    """Share of each contest type at or under the size limit."""
    return A.group_share(ad.applications(t), ["ctype"], {"below": col("size_ha") <= 200})


@query("value_counts", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def value_counts(t):
    return A.value_counts(t.lineitem, "l_returnflag")


@query(
    "strict_and_lenient_mean",
    ad.sql(
        ad.APP,
        body="""
SELECT region, round(CASE WHEN count(*) = count(size_ha) THEN avg(size_ha) END, 4) AS strict_size,
  round(avg(size_ha), 4) AS lenient_size, round(CASE WHEN count(*) = count(score) THEN avg(score) END, 4) AS strict_score
FROM (SELECT * EXCLUDE (size_ha), CASE WHEN region = 3 THEN coalesce(size_ha, 0) ELSE size_ha END AS size_ha FROM app) GROUP BY region""",
    ),
)
def strict_and_lenient_mean(t):
    app = ad.applications(t).withColumn("size_ha", F.when(col("region") == 3, F.coalesce("size_ha", F.lit(0))).otherwise(col("size_ha")))
    strict = A.group_mean(app, ["region"], ["size_ha", "score"], strict=True)
    strict = C.rename(strict, {"size_ha": "strict_size", "score": "strict_score"})
    lenient = C.rename(A.group_mean(app, ["region"], ["size_ha"]), {"size_ha": "lenient_size"})
    out = J.join_inner(strict, lenient, ["region"])
    return C.across_apply(out, ["strict_size", "lenient_size", "strict_score"], lambda c: F.round(c, 4))


@query(
    "activity_flags",
    """
WITH acts AS (SELECT user_id, event_type FROM events WHERE value > 100)
SELECT o_custkey AS project, CAST(year(o_orderdate) AS INTEGER) AS yr, """
    + ", ".join(f"max(CASE WHEN event_type = '{e}' THEN 1 ELSE 0 END) AS \"{e}\"" for e in ad.EVENT_TYPES)
    + " FROM orders LEFT JOIN acts ON user_id = o_custkey GROUP BY ALL",
)
def activity_flags(t):
    """Activity types as 0/1 columns per project and year."""
    acts = t.events.select(ad.missing_key(col("value") > 100, col("user_id"), col("user_id")).alias("project"), "event_type").distinct()
    projects = t.orders.select(col("o_custkey").alias("project"), F.year("o_orderdate").alias("yr")).distinct()
    return A.indicator_any(J.join_left(projects, acts, ["project"]), ["project", "yr"], "event_type", ad.EVENT_TYPES)


@query(
    "pivot_wider",
    "SELECT l_suppkey, coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0) AS \"A\", "
    "coalesce(sum(l_quantity) FILTER (l_returnflag = 'N'), 0) AS \"N\", "
    "coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) AS \"R\" FROM lineitem GROUP BY l_suppkey",
)
def pivot_wider(t):
    return A.pivot_wider(t.lineitem, ["l_suppkey"], "l_returnflag", "l_quantity", ["A", "N", "R"], fill=0)


@query(
    "first_per_key",
    """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1""",
)
def first_per_key(t):
    order = [col("l_linenumber").desc(), "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    return R.first_per_key(t.lineitem, ["l_orderkey"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query(
    "dedupe_minmax",
    """
WITH k AS (SELECT *, greatest(CAST(l_suppkey AS VARCHAR), CAST(l_partkey % 20 AS VARCHAR), CAST(l_linenumber AS VARCHAR))
   || least(CAST(l_suppkey AS VARCHAR), CAST(l_partkey % 20 AS VARCHAR), CAST(l_linenumber AS VARCHAR)) AS mm FROM lineitem)
SELECT l_orderkey, l_suppkey, l_partkey, l_linenumber FROM k
QUALIFY row_number() OVER (PARTITION BY mm ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) = 1""",
)
def dedupe_minmax(t):
    df = t.lineitem.withColumn("p20", col("l_partkey") % 20)
    order = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"]
    return R.dedupe_minmax(df, ["l_suppkey", "p20", "l_linenumber"], order).select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber")


@query(
    "filter_group_extreme",
    ad.sql(
        ad.APP,
        body="""
SELECT app_id, prop_id, size_ha FROM
  (SELECT *, min(size_ha) OVER (PARTITION BY prop_id, ctype) AS m FROM app)
WHERE size_ha = m OR bonus = 1 OR size_ha IS NULL""",
    ),
)
def filter_group_extreme(t):
    app = ad.applications(t)
    also = (col("bonus") == 1) | col("size_ha").isNull()
    return R.filter_group_extreme(app, ["prop_id", "ctype"], "size_ha", also).select("app_id", "prop_id", "size_ha")


_PRIORITIES = ("2-HIGH", "1-URGENT", "5-LOW")


@query(
    "order_by_list",
    """
SELECT o_orderpriority, n, position, CAST(row_number() OVER (ORDER BY n DESC, o_orderpriority) AS INTEGER) AS by_size FROM (
  SELECT o_orderpriority, count(*) AS n, CAST(nullif(list_position(['2-HIGH','1-URGENT','5-LOW'], o_orderpriority), 0) AS INTEGER) AS position
  FROM orders GROUP BY o_orderpriority)""",
)
def order_by_list(t):
    counts = A.group_count(t.orders, ["o_orderpriority"])
    placed = counts.withColumn("position", C.order_key("o_orderpriority", _PRIORITIES))
    ranked = R.order_estimates(placed, "n", "decreasing", "o_orderpriority", "by_size")
    return C.order_by_list(ranked, {"o_orderpriority": _PRIORITIES})


@query(
    "pivot_flags",
    "SELECT o_orderkey, coalesce(o_orderstatus = 'F', FALSE) AS \"F\", coalesce(o_orderstatus = 'O', FALSE) AS \"O\", "
    "coalesce(o_orderstatus = 'P', FALSE) AS \"P\" FROM orders",
)
def pivot_flags(t):
    return C.pivot_flags(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O", "P"])


@query(
    "transpose_table",
    """
WITH g AS (SELECT l_returnflag, count(*) AS n, CAST(round(avg(l_quantity), 3) AS VARCHAR) AS mean_qty FROM lineitem GROUP BY l_returnflag)
SELECT 'n' AS "row", max(CASE WHEN l_returnflag = 'A' THEN CAST(n AS VARCHAR) END) AS "A",
  max(CASE WHEN l_returnflag = 'N' THEN CAST(n AS VARCHAR) END) AS "N", max(CASE WHEN l_returnflag = 'R' THEN CAST(n AS VARCHAR) END) AS "R" FROM g
UNION ALL
SELECT 'mean_qty', max(CASE WHEN l_returnflag = 'A' THEN mean_qty END), max(CASE WHEN l_returnflag = 'N' THEN mean_qty END),
  max(CASE WHEN l_returnflag = 'R' THEN mean_qty END) FROM g""",
)
def transpose_table(t):
    g = t.lineitem.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 3).alias("mean_qty"))
    return A.transpose_table(g, "l_returnflag", ["n", "mean_qty"], ["A", "N", "R"])


@query(
    "size_cutoff_map",
    ad.sql(
        ad.APP,
        body="""
SELECT app_id, CASE WHEN r IN (5,6,7,8,9,10,14) THEN 200 WHEN r IN (11,12) THEN 800 ELSE 500 END AS size_cutoff,
  CASE WHEN s IS NULL OR s = 'No' THEN 0 ELSE 1 END AS plan_flag, CASE WHEN bonus IS NULL THEN NULL WHEN bonus = 1 THEN 'paid' ELSE 'open' END AS payment
FROM (SELECT *, CASE WHEN app_id % 40 = 3 THEN NULL ELSE region END AS r,
  CASE app_id % 3 WHEN 0 THEN 'Si' WHEN 1 THEN 'No' END AS s FROM app)""",
    ),
)
def size_cutoff_map(t):
    app = ad.applications(t).withColumns(
        {
            "r": F.when(col("app_id") % 40 != 3, col("region")),
            "s": F.when(col("app_id") % 3 == 0, "Si").when(col("app_id") % 3 == 1, "No"),
        }
    )
    return app.select(
        "app_id",
        S.region_cutoff("r").alias("size_cutoff"),
        S.flag_not_no("s").alias("plan_flag"),
        S.if_else(col("bonus") == 1, "paid", F.lit("open")).alias("payment"),
    )


@query(
    "bins_edges",
    ad.sql(
        ad.APP,
        body="""
SELECT bin, bin * 5.0::DOUBLE AS bin_end, bin * 5.0::DOUBLE - 2.5 AS bin_mid, count(*) AS n FROM
  (SELECT CASE WHEN size_ha > 0 AND size_ha <= 500 THEN CAST(ceil(size_ha / 5.0::DOUBLE) AS INTEGER) END AS bin FROM app)
WHERE bin IS NOT NULL AND bin * 5 BETWEEN 125 AND 275 GROUP BY bin""",
    ),
)
def bins_edges(t):
    """Applications per right-closed 5 ha bin in a window around the limit."""
    bins = ad.applications(t).select(S.bin_edges("size_ha", 0, 500, 5).alias("bin")).where(col("bin").isNotNull())
    named = bins.withColumns({"bin_end": S.bin_end("bin", 0, 5), "bin_mid": S.bin_mid("bin", 0, 5)})
    return A.group_count(named.where(col("bin_end").between(125, 275)), ["bin", "bin_end", "bin_mid"])


@query(
    "bins_count",
    ad.sql(
        ad.APP,
        body="""
SELECT bin, count(*) AS n, min(score) AS lo, max(score) AS hi FROM (
  SELECT score, least(12, greatest(1, CAST(ceil((score - mn) / ((mx - mn) / 12.0::DOUBLE)) AS INTEGER))) AS bin
  FROM app, (SELECT min(score) AS mn, max(score) AS mx FROM app)) GROUP BY bin""",
    ),
)
def bins_count(t):
    app = ad.applications(t).select("score")
    ranged = W.cross_1row(app, app.agg(F.min("score").alias("mn"), F.max("score").alias("mx")))
    binned = ranged.select("score", S.bin_count("score", 12, col("mn"), col("mx")).alias("bin"))
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi"))


@query(
    "heap_flags",
    ad.sql(
        ad.APP,
        body="""
SELECT app_id, CASE WHEN size_ha IS NULL THEN NULL WHEN ((size_ha % 10) + 10) % 10 = 0 AND size_ha <> 200 THEN 1 ELSE 0 END AS round_heaper,
  CASE WHEN size_ha BETWEEN 199 AND 200 AND ctype = 'Smallholder' THEN 'smallholder heaper'
       WHEN size_ha BETWEEN 200.01 AND 225 AND ctype <> 'Smallholder' THEN 'other interested just over'
       WHEN size_ha BETWEEN 180 AND 198 AND ctype = 'Smallholder' THEN 'between 180 and 198 ha' END AS threshold_heaper,
  a + b > 0 AS planting, CASE WHEN status = 'F' THEN 1 ELSE 0 END AS timber, CASE WHEN status NOT IN ('F', 'O') THEN 1 ELSE 0 END AS ecological
FROM (SELECT *, app_id % 2 AS a, CASE WHEN app_id % 5 = 0 THEN NULL ELSE app_id % 3 END AS b FROM app)""",
    ),
)
def heap_flags(t):
    app = ad.applications(t).withColumns({"a": col("app_id") % 2, "b": F.when(col("app_id") % 5 != 0, col("app_id") % 3)})
    return app.select(
        "app_id",
        S.round_heap("size_ha").alias("round_heaper"),
        S.heap_category("size_ha", col("ctype") == "Smallholder").alias("threshold_heaper"),
        S.any_positive("a", "b").alias("planting"),
        S.flag_equal("status", "F").alias("timber"),
        S.flag_none_of("status", "F", "O").alias("ecological"),
    )


@query(
    "stars_ci",
    """
WITH g AS (SELECT l_suppkey, avg(l_quantity) - 25 AS est, stddev_samp(l_quantity) / sqrt(count(*)) AS se FROM lineitem GROUP BY l_suppkey),
h AS (SELECT *, abs(est / nullif(se, 0)) AS z FROM g)
SELECT l_suppkey, CASE WHEN z BETWEEN 1.645 AND 1.96 THEN '*' WHEN z BETWEEN 1.96 AND 2.58 THEN '**' WHEN z >= 2.58 THEN '***' ELSE '' END AS stars,
  round(est - 1.96 * se, 3) AS lower, round(est + 1.96 * se, 3) AS upper,
  coalesce(CASE l_suppkey % 4 WHEN 0 THEN 'Water' WHEN 1 THEN 'Native' END, CAST(l_suppkey % 4 AS VARCHAR)) AS label,
  CASE WHEN l_suppkey % 3 = 0 THEN 'NA' ELSE CAST(l_suppkey AS VARCHAR) END || '/' || CAST(l_suppkey % 4 AS VARCHAR) AS pasted FROM h""",
)
def stars_ci(t):
    g = t.lineitem.groupBy("l_suppkey").agg(
        (F.avg("l_quantity") - 25).alias("est"), (F.stddev_samp("l_quantity") / F.sqrt(F.count(F.lit(1)))).alias("se")
    )
    lower, upper = S.ci_bounds("est", "se")
    code = (col("l_suppkey") % 4).cast("string")
    return g.select(
        "l_suppkey",
        S.stars("est", "se").alias("stars"),
        F.round(lower, 3).alias("lower"),
        F.round(upper, 3).alias("upper"),
        S.recode(code, {"0": "Water", "1": "Native"}).alias("label"),
        X.paste(F.when(col("l_suppkey") % 3 != 0, col("l_suppkey")), code, sep="/").alias("pasted"),
    )


@query(
    "cast_digits",
    """
SELECT l_orderkey, l_linenumber, TRY_CAST(y AS DOUBLE) AS as_number, TRY_CAST(regexp_replace(d, '([0-9]+).*$', '\\1') AS DOUBLE) AS prefix FROM (
  SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 11 = 0 THEN 's/i' ELSE CAST(year(l_shipdate) AS VARCHAR) END AS y,
  CASE WHEN l_orderkey % 5 = 0 THEN 'n ' ELSE '' END || year(l_shipdate) || '-' || l_linenumber AS d FROM lineitem)""",
)
def cast_digits(t):
    y = F.year("l_shipdate").cast("string")
    text = F.concat(F.when(col("l_orderkey") % 5 == 0, "n ").otherwise(""), y, F.lit("-"), col("l_linenumber").cast("string"))
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        S.cast_num(F.when(col("l_orderkey") % 11 == 0, "s/i").otherwise(y)).alias("as_number"),
        X.digits_prefix(text).alias("prefix"),
    )


_SPLIT = "string_split_regex({c}, '[^\\p{{L}}\\p{{N}}]+')"


@query(
    "id_normalise",
    ad.sql(
        ad.APP,
        body=f"""
SELECT app_id, rol1, rol2, coalesce(rol1, 'NA') || '-' || coalesce(rol2, 'NA') AS "ROL", CASE WHEN rol3 IS NULL THEN 0 ELSE 1 END AS additional_props
FROM (SELECT app_id, {_SPLIT.format(c='r')}[1] AS rol1, {_SPLIT.format(c='r')}[2] AS rol2, {_SPLIT.format(c='r')}[3] AS rol3
  FROM (SELECT app_id, CASE WHEN app_id % 31 = 0 THEN NULL WHEN app_id % 31 = 1 THEN '-' || rol ELSE rol END AS r FROM app))""",
    ),
)
def id_normalise(t):
    raw = F.when(col("app_id") % 31 == 0, None).when(col("app_id") % 31 == 1, F.concat(F.lit("-"), "rol")).otherwise(col("rol"))
    app = ad.applications(t).select("app_id", raw.alias("r"))
    rol1, rol2 = X.split_id("r", 2)
    return app.select(
        "app_id", rol1.alias("rol1"), rol2.alias("rol2"), X.normalise_id("r").alias("ROL"), X.extra_part_flag("r").alias("additional_props")
    )


@query(
    "name_distance",
    ad.sql(
        ad.APP,
        body="""
SELECT app_id, lower(strip_accents(comuna)) AS plain, CASE WHEN d <= 1 THEN CAST(d AS INTEGER) END AS dist
FROM (SELECT app_id, comuna, damerau_levenshtein(lower(strip_accents(comuna)), lower(n_name)) AS d
  FROM app JOIN customer ON prop_id = c_custkey JOIN nation ON c_nationkey = n_nationkey)""",
    ),
)
def name_distance(t):
    """Distance of the applicant's spelling to the official name, if at most 1."""
    c = t.customer.select(col("c_custkey").alias("prop_id"), col("c_nationkey").alias("n_nationkey"))
    official = J.join_inner(c, t.nation, ["n_nationkey"])
    joined = J.join_inner(ad.applications(t), official, ["prop_id"])
    named = joined.select("app_id", X.normalise_name("comuna").alias("plain"), F.lower("n_name").alias("name"))
    return named.select("app_id", "plain", X.dl_0_1("plain", "name").alias("dist"))
