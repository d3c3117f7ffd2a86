"""Areas, containment, covered cells and reprojection on known shapes."""

import math

import pytest
from pyspark.sql import functions as F

from umbral.functions import geometry as G
from umbral.operators import projection as P
from umbral.operators import rasters as R
from umbral.operators import spatial as Z
from umbral.sources.tables import RINGS


def layer(spark, shapes):
    rows = [(i, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings] if rings is not None else None) for i, rings in enumerate(shapes)]
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("geom", RINGS)])
    return spark.createDataFrame(rows, schema)


SQUARE = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
HOLE = [(1, 1), (1, 2), (2, 2), (2, 1), (1, 1)]
SLANT = [(0.3, 0.2), (5.7, 1.4), (3.1, 6.6), (0.9, 4.0), (0.3, 0.2)]


def test_areas(spark):
    df = layer(spark, [[SQUARE], [SQUARE, HOLE], [SQUARE[::-1], HOLE]])
    assert [r[0] for r in df.select(G.polygon_area_ha("geom") * 10000).collect()] == [16.0, 15.0, 15.0]
    box = layer(spark, [[[(-72, -38), (-71.99, -38), (-71.99, -37.99), (-72, -37.99), (-72, -38)]]])
    got = box.select(G.polygon_area_ha("geom", lonlat=True)).first()[0]
    want = 6371010.0**2 * math.radians(0.01) * (math.sin(math.radians(-37.99)) - math.sin(math.radians(-38))) / 1e4
    # the box has great-circle edges, the closed form has parallels
    assert abs(got - want) / want < 1e-6


def test_validation(spark):
    shapes = [[SQUARE[:4]], [SQUARE[:2] + SQUARE[1:]], [[(0, 0), (1, 1), (2, 2), (0, 0)]], [[(0, 0), (1, 1)]], None]
    out = {r.id: r for r in Z.validate_polygon(layer(spark, shapes)).collect()}
    assert [out[i].invalid for i in range(5)] == [None, None, "zero area", "too few points", "empty"]
    assert len(out[0].geom[0]) == 5 and len(out[1].geom[0]) == 5


@pytest.mark.parametrize("x,y,want", [(3, 3, True), (1.5, 1.5, False), (0, 2, True), (4, 4, True), (1, 1.5, True), (4.01, 2, False), (-1, 0, False)])
def test_containment(spark, x, y, want):
    pts = spark.createDataFrame([(float(x), float(y))], "px double, py double")
    assert (Z.join_spatial(layer(spark, [[SQUARE, HOLE]]), pts, 1.5).count() == 1) == want


def test_left_spatial_join_keeps_polygons(spark):
    pts = spark.createDataFrame([(3.0, 3.0), (None, 1.0)], "px double, py double")
    far = [[(9, 9), (10, 9), (10, 10), (9, 9)]]
    out = Z.join_spatial(layer(spark, [[SQUARE], far]), pts, 2.0, how="left", poly_key=["id"])
    assert sorted((r.id, r.px) for r in out.collect()) == [(0, 3.0), (1, None)]


def test_covered_cells_add_up_to_the_area(spark):
    df = layer(spark, [[SLANT], [SQUARE, HOLE], [SLANT[::-1]]])
    areas = [r[0] * 10000 for r in df.select(G.polygon_area_ha("geom")).collect()]
    for res in (1.0, 0.37):
        cells = Z.zone_cells(df, "id", x0=-0.2, y0=0.1, res=res).groupBy("id").agg(F.sum("share").alias("s"), F.max("share").alias("m"))
        for r in cells.collect():
            assert abs(r.s * res * res - areas[r.id]) < 1e-9 and r.m <= 1 + 1e-12


def test_zonal_keeps_every_zone_and_counts_missing_classes(spark):
    zones = layer(spark, [[SQUARE], [[(50, 50), (51, 50), (51, 51), (50, 50)]]])
    px = spark.createDataFrame([("a", 0, 0, "1"), ("a", 1, 0, None), ("a", 2, 2, "9")], "raster string, col int, row int, class string")
    labels = {"a": {"1": "Water"}}
    out = {r.id: r for r in Z.zonal_class_sum(zones, px, "id", labels, {"a": "2000"}, total_of="a").collect()}
    assert (out[0]["Water_2000"], out[0].pixels_count) == (1.0, 3.0)
    assert (out[0]["9_2000"], out[0]["NA_2000"]) == (1.0, 1.0)
    assert (out[1]["Water_2000"], out[1].pixels_count) == (0.0, 0.0)
    less = Z.zonal_class_sum(zones, px, "id", labels, {}, total_of="a", count_null_class=False).where("id = 0").first()
    assert less.pixels_count == 2.0


def test_known_utm_point_and_round_trip(spark):
    rows = [(-69.0, -33.0, 19, "WGS84"), (-75.0, -45.0, 18, "aust_SA"), (-72.5, -38.2, 18, "WGS84"), (-70.3, -54.9, 19, "aust_SA")]
    df = spark.createDataFrame(rows, "lon double, lat double, zone int, e string")
    fwd = P.lonlat_to_utm(df, "lon", "lat", F.col("zone"), F.col("e"))
    assert abs(fwd.first().x - 500000) < 1e-6
    # on the central meridian the northing is the scaled meridian arc, here by numeric integration
    f = 1 / 298.257223563
    e2, steps = f * (2 - f), 200_000
    width = math.radians(33) / steps
    arc = sum(6378137 * (1 - e2) / (1 - e2 * math.sin((i + 0.5) * width) ** 2) ** 1.5 for i in range(steps)) * width
    assert abs(fwd.first().y - (10_000_000 - 0.9996 * arc)) < 1e-4
    back = P.utm_to_lonlat(fwd, "x", "y", F.col("zone"), F.col("e"), "lon2", "lat2")
    for r in back.collect():
        assert abs(r.lon - r.lon2) < 1e-11 and abs(r.lat - r.lat2) < 1e-11


def test_zone_18_point_lands_in_zone_19(spark):
    df = spark.createDataFrame([("WGS84", 18, -72.0, -40.0)], "datum string, huso int, lon double, lat double")
    utm18 = P.lonlat_to_utm(df, "lon", "lat", F.lit(18), F.lit("WGS84"), "easting", "northing")
    utm19 = P.clean_coordinates(utm18)
    deg = P.harmonise_crs(utm19, "easting", "northing", "lonlat").first()
    assert abs(deg.easting + 72) < 1e-10 and abs(deg.northing + 40) < 1e-10


def test_other_zone_and_datum_are_dropped(spark):
    rows = [("PSAD 56", 19), ("WGS84", 20), ("otro", 19), ("wgs", None)]
    df = spark.createDataFrame([(d, z, 3.5e5, 5.6e6) for d, z in rows], "datum string, huso int, easting double, northing double")
    assert P.clean_coordinates(df).count() == 2
    assert P.clean_coordinates(df, strict=True).count() == 1


def inside_ring(x, y, ring):
    """Even-odd rule for arrays of points."""
    import numpy as np

    out = np.zeros(len(x), bool)
    for (ax, ay), (bx, by) in zip(ring, ring[1:]):
        with np.errstate(divide="ignore", invalid="ignore"):
            out ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return out


def test_runs_are_the_cells(spark):
    """Runs against fine samples of each cell; a hole, a slanted outline, another corner and cell size."""
    import numpy as np

    df = layer(spark, [[SLANT, HOLE], [SQUARE], None, []])
    for grid in (R.Grid(), R.Grid(-0.35, 0.2, 0.7), R.Grid(1.0, -3.0, 5.0)):
        runs = R.zone_runs(df, "id", {"a": grid}, band_rows=2).collect()
        assert {r.id for r in runs} == {0, 1}
        share = {(r.id, c, r.row): r.share for r in runs for c in range(r.col_from, r.col_to + 1)}
        assert len(share) == sum(r.col_to - r.col_from + 1 for r in runs)
        at = (np.arange(60) + 0.5) / 60
        for col in range(-2, 12):
            for row in range(-2, 12):
                x, y = (v.ravel() for v in np.meshgrid(grid.x0 + (col + at) * grid.res, grid.y0 + (row + at) * grid.res))
                for i, rings in ((0, (SLANT, HOLE)), (1, (SQUARE,))):
                    hit = inside_ring(x, y, rings[0])
                    for hole in rings[1:]:
                        hit &= ~inside_ring(x, y, hole)
                    assert abs(hit.mean() - share.get((i, col, row), 0.0)) < 0.02
        one_by_one = Z.zone_cells(df, "id", x0=grid.x0, y0=grid.y0, res=grid.res).collect()
        assert {(r.id, r["col"], r.row): r.share for r in one_by_one} == pytest.approx(share)


def test_a_large_zone_is_many_tasks(spark):
    """A million cells: a few runs for each row, dealt over the tasks, and the exact total."""
    big = [(0.5, 0.25), (1000.5, 0.25), (1000.5, 1000.75), (0.5, 1000.75), (0.5, 0.25)]
    df = layer(spark, [[big]])
    runs = R.zone_runs(df, "id", {"a": R.Grid()}, partitions=8).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in runs}) > 1 and len(runs) == 3 * 1001
    assert sum(r.share * (r.col_to - r.col_from + 1) for r in runs) == pytest.approx(1000 * 1000.5)
    px = spark.range(1100).select(F.lit("a").alias("raster"), F.col("id").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(1099))).alias("col"), (F.col("id") % 3).alias("class"))
    stretches = R.raster_runs(px)
    assert stretches.count() == 1100 * 18
    cover = {r["class"]: r.cover for r in R.zonal_runs(df, px, "id", {"a": R.Grid()}).collect()}
    assert sum(cover.values()) == pytest.approx(1000 * 1000.5) and cover[1] == pytest.approx(1000 * 333.75)


def test_each_raster_has_its_own_system(spark):
    """Zones in UTM on rasters in degrees and in the next zone, against projected sample points."""
    import numpy as np

    ring = [(230_300, 5_780_200), (236_700, 5_781_400), (233_900, 5_787_000), (230_300, 5_780_200)]
    df = layer(spark, [[ring]])
    own = R.Crs(19, "aust_SA")
    grids = {"deg": R.Grid(-72.1, -38.2, 0.011, R.Crs(None, "aust_SA")), "utm18": R.Grid(745_000.0, 5_760_000.0, 900.0, R.Crs(18, "aust_SA")), "own": R.Grid(230_000.0, 5_780_000.0, 1000.0, own)}
    runs = R.zone_runs(df, "id", grids, crs=own, step=200.0).collect()
    for name, grid in grids.items():
        share = {(c, r.row): r.share for r in runs if r.raster == name for c in range(r.col_from, r.col_to + 1)}
        assert len(share) > 20
        at = (np.arange(25) + 0.5) / 25
        cells = [(c, r) for c, r in share] + [(c + 1, r) for c, r in share if (c + 1, r) not in share]
        xs, ys = zip(*[(grid.x0 + (c + a) * grid.res, grid.y0 + (r + b) * grid.res) for c, r in cells for a in at for b in at])
        points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(xs, ys))], "i int, x double, y double")
        placed = points.select("i", R.projected(F.col("x"), F.col("y"), grid.crs, own).alias("p")).orderBy("i").select("p.*").toPandas()
        hit = inside_ring(placed.x.to_numpy(), placed.y.to_numpy(), ring).reshape(len(cells), -1).mean(axis=1)
        for cell, mean in zip(cells, hit):
            assert abs(mean - share.get(cell, 0.0)) < 0.04
    with pytest.raises(ValueError):
        R.zone_runs(df, "id", grids, crs=own)


def test_many_classes_without_a_label(spark, monkeypatch):
    """Beyond the number of columns, what has no label goes to a map, exactly."""
    monkeypatch.setattr(Z, "MAX_CODES", 3)
    zones = layer(spark, [[SQUARE], [[(9, 9), (9.5, 9), (9.5, 9.5), (9, 9.5), (9, 9)]]])
    cells = [("a", c, r, 4 * r + c if (c, r) != (3, 3) else None) for c in range(4) for r in range(4)] + [("b", 0, 0, 1)]
    px = spark.createDataFrame(cells, "raster string, col int, row int, class int")
    out = {r.id: r for r in Z.zonal_class_sum(zones, px, "id", {"a": {"0": "zero"}, "b": {}}, {}, total_of="a").collect()}
    assert out[0].zero == 1.0 and out[0].pixels_count == 16.0
    assert out[0].unlabelled == {**{f"a:{i}": 1.0 for i in range(1, 15)}, "a": 1.0, "b:1": 1.0}
    assert out[1].zero == 0.0 and not out[1].unlabelled


def test_runs_never_pass_the_driver(spark):
    """Runs and class totals compress so well that a size check would broadcast them."""
    px = spark.createDataFrame([("a", c, r, "1") for c in range(4) for r in range(4)], "raster string, col int, row int, class string")
    zones = layer(spark, [[SQUARE], [SLANT]])
    long = R.zonal_runs(zones, px, "id", {"a": R.Grid()}, combine=True)
    wide = Z.zonal_class_sum(zones, px, "id", {"a": {"1": "Water"}}, {}, total_of="a", combine=True)
    for df in (long, wide):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_zones_are_dealt_before_they_are_projected(spark):
    """The zones of one small file are the work of many tasks."""
    ring = [(230_300, 5_780_200), (236_700, 5_781_400), (233_900, 5_787_000), (230_300, 5_780_200)]
    df = layer(spark, [[ring]] * 8).coalesce(1)
    own = R.Crs(19, "aust_SA")
    runs = R.zone_runs(df, "id", {"deg": R.Grid(-72.1, -38.2, 0.011, R.Crs(None, "aust_SA"))}, crs=own, step=500.0, partitions=4)
    plan = runs._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition 4, true" in plan
    assert {r["count"] for r in runs.groupBy("id").count().collect()} == {runs.where("id = 0").count()}


def test_match_spatial_looks_up_areas(spark):
    """A place shared by applications and polygons: the winners of all pairs, without pairing them off."""
    sizes = [5.0, 7.5, None, 12.0, 3.0, 7.0]
    props = spark.createDataFrame(
        [(i, i, "ab", s, 2010, "1-2") for i, s in enumerate(sizes)] + [(9, 9, "zz", 5.0, 2010, "1-2")],
        "rptpro_id int, rptpre_id int, rptpre_comuna string, rptpre_superficie_predial double, rptpro_ano int, ROL string",
    )
    own = spark.createDataFrame([(i, "SAD 69", 1.0, 1.0, 19) for i in range(10)], "rptpre_id int, rptub_datum string, rptub_este double, rptub_norte double, rptub_huso int")
    stand = spark.createDataFrame([(4, None, 90.0, 90.0, None)], "rptpre_id int, rptro_datum string, rptro_este double, rptro_norte double, rptro_huso int")
    polygons = [(1, "ab", 4.0, 1, 0), (2, "ab", 6.0, 1, 0), (3, "abc", 6.0, 1, 1), (4, "ab", 9.0, 1, 1), (5, "xyz", 5.0, 1, 1), (6, "ab", 5.0, 0, 1), (7, "ab", 13.0, 1, 1)]
    cad = layer(spark, [[SQUARE]] * len(polygons)).join(
        spark.createDataFrame([(i, "r", *p) for i, p in enumerate(polygons)], "id int, ROL string, poly_id int, desccomu string, polyarea double, rol_prty_ciren int, src_prty int"), "id"
    ).drop("id")
    out = Z.match_spatial(props, own, stand, cad, cell=2.0)
    # equal differences go to the better source: of 4.0, 6.0 and 6.0 the last; 7.5 is as far from 6.0 as from 9.0
    assert {r.rptpre_id: (r.poly_id, r.area_diff) for r in out.collect()} == {0: (3, 1.0), 1: (3, 1.5), 3: (7, 1.0), 5: (3, 1.0)}
    assert "_edges" not in out._jdf.queryExecution().optimizedPlan().toString()
    gap = Z.match_spatial(props, own, stand, cad.withColumn("polyarea", F.when(F.col("poly_id") != 2, F.col("polyarea"))), cell=2.0)
    assert gap.count() == 0


@pytest.mark.parametrize("cell,split", [(2.0, 1), (2.0, 4), (8.0, 8), (0.7, 3)])
def test_points_in_polygons_by_cells(spark, cell, split):
    """Whole, cut and sub-divided cells give what testing every pair gives, and the hits are joined once."""
    moved = [(x - 5, y - 3) for x, y in SLANT]
    shapes = [[SQUARE, HOLE], [SLANT], [moved], [[(3 * x, 3 * y) for x, y in SLANT], [(3 * x, 3 * y) for x, y in HOLE]], [SLANT[:4]], None, [SQUARE]]
    rows = [(i * 7 + j, i * 0.25 - 5, j * 0.25 - 4) for i in range(60) for j in range(60)]
    rows += [(-1, 1.1, 1.3), (-1, 1.1, 1.3), (-2, None, 1.0), (None, 2.0, 2.0), (-3, 5.7 - 5, 1.4 - 3)]
    pts = spark.createDataFrame(rows, "point int, px double, py double")
    polygons = layer(spark, shapes)
    got = Z.join_spatial(polygons, pts, cell, split=split)
    assert got.columns == ["id", "geom", "point", "px", "py"]
    b = G.bounds(F.col("geom"))
    box = F.col("px").between(b["xmin"], b["xmax"]) & F.col("py").between(b["ymin"], b["ymax"])
    every = polygons.crossJoin(pts).where(box & G.inside(F.col("px"), F.col("py"), G.all_edges("geom")))
    flat = lambda df: sorted(((r.id, r.point, r.px, r.py) for r in df.collect()), key=str)
    assert flat(got) == flat(every) and len(flat(got)) > 1000
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
