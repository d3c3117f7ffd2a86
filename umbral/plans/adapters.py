"""The given tables in the shapes the operators work on, as Spark frames and as the same SQL text.

Missing values, spelling variants, heaps and identifier forms are derived by expression from the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbral.functions.scalars import col

# ---- fixed values: class dictionaries -----------------------------------------------------------
CLASSES_2021 = {
    1: "Urban", 2: "Water", 3: "Grassland/Ag", 4: "Pine", 5: "Eucalyptus",
    6: "Native", 7: "Bare", 8: "Shrubland", 9: "Orchard/Ag",
}
CLASSES_2000 = {
    1: "Crop", 111: "Water", 124: "Development", 131: "Bare", 138: "Plantations",
    144: "Trees", 152: "Shrubs", 176: "Grassland", 195: "Wetland",
}
CLASSES_2001 = {
    "Forest": "Forest", "Plantation": "Plantation", "Shrub": "Shrub", "Pasture and ag": "PastureAg",
    "Water": "Water", "Urban": "Urban", "Temporary bare soil": "Bare", "Permanent bare soil": "Bare",
    "Snow/ice": "Snow", "No data": "nodata",
}
LANDCOVER_COLS = (
    "Forest", "Plantation", "Urban", "Water", "Grassland/Ag", "Pine", "Native", "Bare", "Shrubland",
    "Eucalyptus", "Orchard/Ag", "pixels_count",
)
# -----------------------------------------------------------------------------------------------

ODD_YEAR = 1995
EVENT_TYPES = ("view", "click", "purchase", "signup", "error")


#: Keys counted down from here are apart from those of :func:`missing_key`.
OTHER_KEYS = -1_000_000_000_000


def missing_key(kept: Column, key: Column, base: Column) -> Column:
    """``key`` where ``kept``; elsewhere a negative key made of ``base``, which no other table has."""
    return F.when(kept, key).otherwise(F.coalesce(-1 - base, F.lit(-1)))


def applications(t) -> DataFrame:
    o = t.orders
    c = t.customer.select("c_custkey", "c_nationkey")
    n = t.nation.select("n_nationkey", "n_name")
    df = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, F.col("c_nationkey") == n["n_nationkey"])
    key, name = F.col("o_orderkey"), F.col("n_name")
    df = df.select(
        key.alias("app_id"),
        F.col("o_custkey").alias("prop_id"),
        F.year("o_orderdate").alias("yr"),
        (F.col("o_totalprice") / 5000).alias("score"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "Smallholder").otherwise("Other interested").alias("ctype"),
        F.when(key % 2 == 0, "Segundo concurso").otherwise("Primer concurso").alias("contest_name"),
        F.col("o_orderstatus").alias("status"),
        F.when(key % 97 == 13, None)
        .when(key % 4 == 0, F.round(F.col("o_totalprice") / 10000) * 10)
        .otherwise(F.col("o_totalprice") / 1000)
        .alias("size_ha"),
        (F.col("c_nationkey") % 15 + 1).alias("region"),
        F.when(key % 5 == 0, F.replace(name, F.lit("A"), F.lit("Á")))
        .when(key % 5 == 1, name)
        .when(key % 5 == 2, F.concat(F.substring(name, 2, 1), F.substring(name, 1, 1), F.substring(name, 3, 100)))
        .when(key % 5 == 3, F.substring(name, 2, 100))
        .otherwise(F.concat(F.lit("XX"), name))
        .alias("comuna"),
        F.when(key % 3 == 0, F.concat("o_custkey", F.lit("-"), "c_nationkey"))
        .when(key % 3 == 1, F.concat("o_custkey", F.lit("/"), "c_nationkey", F.lit(".7")))
        .otherwise(F.col("o_custkey").cast("string"))
        .alias("rol"),
        (F.col("o_totalprice") / 100).alias("amount"),
        (F.col("o_totalprice") / 2000).alias("area"),
    )
    awarded = (F.col("status") != "P") & (F.col("score") >= 40 + F.col("yr") % 5)
    return df.withColumn("awarded", awarded).withColumn(
        "bonus", F.when(F.col("awarded") & (F.col("status") == "F"), 1).when(F.col("awarded"), 0)
    )


APP = """
app0 AS (
  SELECT o.o_orderkey AS app_id, o.o_custkey AS prop_id, CAST(year(o.o_orderdate) AS INTEGER) AS yr,
    o.o_totalprice / 5000 AS score,
    CASE WHEN o.o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'Smallholder' ELSE 'Other interested' END AS ctype,
    CASE WHEN o.o_orderkey % 2 = 0 THEN 'Segundo concurso' ELSE 'Primer concurso' END AS contest_name,
    o.o_orderstatus AS status,
    CASE WHEN o.o_orderkey % 97 = 13 THEN NULL
         WHEN o.o_orderkey % 4 = 0 THEN round(o.o_totalprice / 10000) * 10
         ELSE o.o_totalprice / 1000 END AS size_ha,
    c.c_nationkey % 15 + 1 AS region,
    CASE o.o_orderkey % 5
      WHEN 0 THEN replace(n.n_name, 'A', 'Á')
      WHEN 1 THEN n.n_name
      WHEN 2 THEN substring(n.n_name, 2, 1) || substring(n.n_name, 1, 1) || substring(n.n_name, 3)
      WHEN 3 THEN substring(n.n_name, 2)
      ELSE 'XX' || n.n_name END AS comuna,
    CASE o.o_orderkey % 3
      WHEN 0 THEN o.o_custkey || '-' || c.c_nationkey
      WHEN 1 THEN o.o_custkey || '/' || c.c_nationkey || '.7'
      ELSE CAST(o.o_custkey AS VARCHAR) END AS rol,
    o.o_totalprice / 100 AS amount, o.o_totalprice / 2000 AS area
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey),
app AS (
  SELECT *, status <> 'P' AND score >= 40 + yr % 5 AS awarded,
    CASE WHEN status <> 'P' AND score >= 40 + yr % 5 AND status = 'F' THEN 1
         WHEN status <> 'P' AND score >= 40 + yr % 5 THEN 0 END AS bonus
  FROM app0)"""


def cadastre_sources(t) -> tuple[DataFrame, DataFrame]:
    """Two boundary layers with identifiers, place names and areas; either has some identifiers that no application has."""
    c = t.customer
    n = t.nation.select("n_nationkey", "n_name")
    df = c.join(n, c["c_nationkey"] == n["n_nationkey"])
    key = F.col("c_custkey")
    base = df.select(
        key.alias("poly_id"),
        F.when(key % 2 == 0, F.concat("c_custkey", F.lit("-"), "c_nationkey"))
        .otherwise(F.concat("c_custkey", F.lit(" "), "c_nationkey"))
        .alias("rol"),
        F.replace(F.col("n_name"), F.lit("A"), F.lit("Á")).alias("desccomu"),
        (F.col("c_acctbal") / 50 + 150).alias("polyarea"),
    )
    first = base.withColumn("rol", F.when(F.col("poly_id") % 3 == 0, F.concat(F.lit("x"), "rol")).otherwise(F.col("rol")))
    second = base.withColumns(
        {
            "rol": F.when(F.col("poly_id") % 4 == 1, F.concat(F.lit("x"), "rol")).otherwise(F.col("rol")),
            "polyarea": F.col("polyarea") + 1,
            "poly_id": F.col("poly_id") + 1_000_000_000,
        }
    )
    return first, second


CAD = """
cadbase AS (
  SELECT c.c_custkey AS poly_id,
    CASE WHEN c.c_custkey % 2 = 0 THEN c.c_custkey || '-' || c.c_nationkey ELSE c.c_custkey || ' ' || c.c_nationkey END AS rol,
    replace(n.n_name, 'A', 'Á') AS desccomu, c.c_acctbal / 50 + 150 AS polyarea
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey),
cadsrc AS (
  SELECT poly_id, CASE WHEN poly_id % 3 = 0 THEN 'x' ELSE '' END || rol AS rol, desccomu, polyarea, 'first' AS source, 1 AS src_prty FROM cadbase
  UNION ALL
  SELECT poly_id + 1000000000, CASE WHEN poly_id % 4 = 1 THEN 'x' ELSE '' END || rol, desccomu, polyarea + 1, 'second', 0 FROM cadbase),
cad AS (
  SELECT poly_id, lower(strip_accents(desccomu)) AS desccomu, polyarea, source, src_prty, rol AS ROL, 1 AS rol_prty_ciren FROM cadsrc
  UNION ALL
  SELECT poly_id, lower(strip_accents(desccomu)), polyarea, source, src_prty,
    coalesce(string_split_regex(rol, '[^\\p{L}\\p{N}]+')[1], 'NA') || '-' || coalesce(string_split_regex(rol, '[^\\p{L}\\p{N}]+')[2], 'NA'),
    0 FROM cadsrc)"""

APP_VARIANTS = """
appv AS (
  SELECT * EXCLUDE (rol), rol AS ROL, 1 AS rol_prty FROM app
  UNION ALL
  SELECT * EXCLUDE (rol),
    coalesce(string_split_regex(rol, '[^\\p{L}\\p{N}]+')[1], 'NA') || '-' || coalesce(string_split_regex(rol, '[^\\p{L}\\p{N}]+')[2], 'NA'),
    0 FROM app)"""


def pixels(t) -> DataFrame:
    """Weighted raster cells of a 200 x 100 grid with a class from 1 to 9; several rows may share a cell."""
    return t.lineitem.select(
        F.lit("r2021").alias("raster"),
        (F.col("l_partkey") % 200).cast("int").alias("col"),
        (F.col("l_suppkey") % 100).cast("int").alias("row"),
        (F.col("l_quantity") % 9 + 1).cast("int").alias("class"),
    )


PIXELS = """
pixels AS (
  SELECT 'r2021' AS raster, CAST(l_partkey % 200 AS INTEGER) AS col, CAST(l_suppkey % 100 AS INTEGER) AS "row",
    CAST(l_quantity % 9 + 1 AS INTEGER) AS class FROM lineitem)"""

CODES_2000 = tuple(CLASSES_2000)
LABELS_2001 = tuple(CLASSES_2001)


def pixels_three(t) -> DataFrame:
    """Three rasters on the same grid, with the codes of the three dictionaries as text."""
    codes = F.array(*[F.lit(str(c)) for c in CODES_2000])
    labels = F.array(*[F.lit(c) for c in LABELS_2001])
    base = t.lineitem.select(
        (F.col("l_partkey") % 200).cast("int").alias("col"),
        (F.col("l_suppkey") % 100).cast("int").alias("row"),
        F.array(
            F.struct(F.lit("2021").alias("r"), (F.col("l_quantity") % 9 + 1).cast("int").cast("string").alias("c")),
            F.struct(F.lit("2000").alias("r"), F.get(codes, (F.col("l_linenumber") % 9).cast("int")).alias("c")),
            F.struct(F.lit("2001").alias("r"), F.get(labels, (F.col("l_orderkey") % 10).cast("int")).alias("c")),
        ).alias("_three"),
    )
    return base.withColumn("_p", F.explode("_three")).select(
        F.col("_p.r").alias("raster"), "col", "row", F.col("_p.c").alias("class")
    )


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


PIXELS_THREE = f"""
pixels3 AS (
  SELECT '2021' AS raster, CAST(l_partkey % 200 AS INTEGER) AS col, CAST(l_suppkey % 100 AS INTEGER) AS "row",
    CAST(CAST(l_quantity % 9 + 1 AS INTEGER) AS VARCHAR) AS class FROM lineitem
  UNION ALL
  SELECT '2000', CAST(l_partkey % 200 AS INTEGER), CAST(l_suppkey % 100 AS INTEGER),
    ({_sql_list(CODES_2000)})[l_linenumber % 9 + 1] FROM lineitem
  UNION ALL
  SELECT '2001', CAST(l_partkey % 200 AS INTEGER), CAST(l_suppkey % 100 AS INTEGER),
    ({_sql_list(LABELS_2001)})[CAST(l_orderkey % 10 AS INTEGER) + 1] FROM lineitem)"""


def class_labels() -> dict[str, dict[str, str]]:
    """Raster name to its code-to-label dictionary."""
    return {
        "2021": {str(k): v for k, v in CLASSES_2021.items()},
        "2000": {str(k): v for k, v in CLASSES_2000.items()},
        "2001": dict(CLASSES_2001),
    }


def labels_sql() -> str:
    rows = ", ".join(
        f"('{raster}', '{code}', '{label}')" for raster, d in class_labels().items() for code, label in d.items()
    )
    return f"\nlabel3(raster, code, label) AS (VALUES {rows})"


def _ring(*points) -> F.Column:
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in points])


def boxes(t) -> DataFrame:
    """Axis-aligned boxes, one per customer, with corners off the cell lines."""
    k = F.col("c_custkey")
    x0, y0 = k % 180 + F.lit(0.25), k % 90 + F.lit(0.5)
    x1, y1 = x0 + 1 + k % 7, y0 + 0.75 + k % 5
    return t.customer.select(
        k.alias("zone_id"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"),
        F.array(_ring((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))).alias("geom"),
    )


BOXES = """
boxes AS (
  SELECT c_custkey AS zone_id, c_custkey % 180 + 0.25::DOUBLE AS x0, c_custkey % 90 + 0.5::DOUBLE AS y0,
    c_custkey % 180 + 0.25::DOUBLE + 1 + c_custkey % 7 AS x1, c_custkey % 90 + 0.5::DOUBLE + 0.75::DOUBLE + c_custkey % 5 AS y1
  FROM customer)"""


def triangles(t) -> DataFrame:
    """Right triangles with a square hole where they are large enough."""
    k = F.col("c_custkey")
    x0, y0 = (k % 180).cast("double"), (k % 90).cast("double")
    w = (k % 6 + 2).cast("double")
    outer = _ring((x0, y0), (x0 + w, y0), (x0, y0 + w), (x0, y0))
    h = F.lit(0.5)
    hole = _ring((x0 + h, y0 + h), (x0 + h, y0 + 2 * h), (x0 + 2 * h, y0 + 2 * h), (x0 + 2 * h, y0 + h), (x0 + h, y0 + h))
    return t.customer.select(k.alias("zone_id"), F.when(k % 6 >= 2, F.array(outer, hole)).otherwise(F.array(outer)).alias("geom"))


TRIANGLES = """
tri AS (
  SELECT c_custkey AS zone_id, CAST(c_custkey % 180 AS DOUBLE) AS x0, CAST(c_custkey % 90 AS DOUBLE) AS y0,
    CAST(c_custkey % 6 + 2 AS DOUBLE) AS w, c_custkey % 6 >= 2 AS has_hole FROM customer)"""


def points(t) -> DataFrame:
    """One point per event inside the extent of the zones."""
    return t.events.select(
        F.col("event_id").alias("point_id"),
        (F.col("user_id") % 180 + F.pmod(F.col("value"), F.lit(1.0))).alias("px"),
        (F.col("event_id") % 90 + F.pmod(F.col("value") * 7, F.lit(1.0))).alias("py"),
    )


POINTS = """
pts AS (
  SELECT event_id AS point_id, user_id % 180 + value % 1.0::DOUBLE AS px, event_id % 90 + (value * 7) % 1.0::DOUBLE AS py FROM events)"""


def landcover(t) -> DataFrame:
    """Land-cover totals per application: one column per class of each raster and the pixel total."""
    q = F.col("l_quantity")
    cls = (q % 9).cast("int")
    c00 = (F.col("l_partkey") % 9).cast("int")
    c01 = (F.col("l_suppkey") % 10).cast("int")
    zero = F.lit(0.0)
    sums = [F.sum(F.when(cls == i, q).otherwise(zero)).alias(v) for i, v in enumerate(CLASSES_2021.values())]
    sums += [F.sum(F.when(c00 == i, q).otherwise(zero)).alias(f"{v}_2000") for i, v in enumerate(CLASSES_2000.values())]
    for v in dict.fromkeys(CLASSES_2001.values()):
        codes = [i for i, x in enumerate(CLASSES_2001.values()) if x == v]
        sums.append(F.sum(F.when(c01.isin(*codes), q).otherwise(zero)).alias(f"{v}_2001"))
    out = t.lineitem.groupBy(F.col("l_orderkey").alias("app_id")).agg(*sums, F.sum(q).alias("pixels_count"))
    out = out.withColumn("Plantation", F.col("Pine") + F.col("Eucalyptus"))
    return out.withColumn("Forest", F.col("Plantation") + F.col("Native"))


def _land_sql() -> str:
    parts = [f'sum(CASE WHEN CAST(l_quantity % 9 AS INTEGER) = {i} THEN l_quantity ELSE 0 END) AS "{v}"'
             for i, v in enumerate(CLASSES_2021.values())]
    parts += [f'sum(CASE WHEN l_partkey % 9 = {i} THEN l_quantity ELSE 0 END) AS "{v}_2000"'
              for i, v in enumerate(CLASSES_2000.values())]
    for v in dict.fromkeys(CLASSES_2001.values()):
        codes = ", ".join(str(i) for i, x in enumerate(CLASSES_2001.values()) if x == v)
        parts.append(f'sum(CASE WHEN l_suppkey % 10 IN ({codes}) THEN l_quantity ELSE 0 END) AS "{v}_2001"')
    return f"""
land0 AS (SELECT l_orderkey AS app_id, {', '.join(parts)}, sum(l_quantity) AS pixels_count FROM lineitem GROUP BY l_orderkey),
land AS (SELECT *, "Pine" + "Eucalyptus" AS "Plantation", "Pine" + "Eucalyptus" + "Native" AS "Forest" FROM land0)"""


LAND = _land_sql()


def stands(t) -> DataFrame:
    """Stand rows with an execution year kept as text, some of it no number."""
    key = F.col("l_orderkey")
    return t.lineitem.select(
        key.alias("request"),
        F.col("l_suppkey").alias("resolution"),
        F.col("l_linenumber").alias("stand"),
        F.col("l_quantity").alias("stand_area"),
        F.when(key % 11 == 0, F.lit("s/i")).otherwise(F.year("l_shipdate").cast("string")).alias("stand_year"),
    )


STANDS = """
stands AS (
  SELECT l_orderkey AS request, l_suppkey AS resolution, l_linenumber AS stand, l_quantity AS stand_area,
    CASE WHEN l_orderkey % 11 = 0 THEN 's/i' ELSE CAST(year(l_shipdate) AS VARCHAR) END AS stand_year FROM lineitem)"""


def stand_activities(t) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("request"),
        F.year("o_orderdate").alias("activity_year"),
        (F.col("o_totalprice") / 10000).alias("activity_area"),
        F.col("o_orderpriority").alias("activity"),
    )


STAND_ACTIVITIES = """
acts AS (
  SELECT o_orderkey AS request, CAST(year(o_orderdate) AS INTEGER) AS activity_year, o_totalprice / 10000 AS activity_area,
    o_orderpriority AS activity FROM orders)"""


def sql(*ctes: str, body: str) -> str:
    """One statement from CTE texts and a body."""
    return "WITH " + ",".join(ctes) + "\n" + body
