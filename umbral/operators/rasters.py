"""Zones on rasters: each raster with a grid and a coordinate system of its own, zones as runs of cells.

A zone is projected onto a raster's grid, cut into bands of cell rows, and dealt out by (zone, raster, band), so
that a zone of any size is the work of many tasks. Within a row only the cells that an edge passes are worked
out one by one; between two such cells the covered share does not change, so they are one run. Runs of equal
raster cells are made likewise, and the two meet in an equi-join on stretches of a row, as overlaps of intervals.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbral.functions.geometry import bounds, edges, edges_in_row, oriented_edges, row_parts_cover
from umbral.functions.scalars import col
from umbral.operators.projection import ELLIPSOIDS, utm_forward, utm_inverse

#: Rows of cells in a band, and columns in a stretch of a row.
BAND_ROWS, STRETCH = 64, 64


@dataclass(frozen=True)
class Crs:
    """Degrees (``zone`` is None) or metres of a southern UTM zone, on an ellipsoid. No datum shift is applied."""

    zone: int | None = None
    ellipsoid: str = "WGS84"

    def __post_init__(self):
        if self.ellipsoid not in ELLIPSOIDS:
            raise ValueError(f"unknown ellipsoid {self.ellipsoid!r}")


@dataclass(frozen=True)
class Grid:
    """Cells of ``res`` from ``(x0, y0)`` on, which is the corner with the smallest coordinates of cell (0, 0).

    ``crs``: the raster's coordinate system, None for that of the zones.
    """

    x0: float = 0.0
    y0: float = 0.0
    res: float = 1.0
    crs: Crs | None = None


def projected(x: Column, y: Column, source: Crs, target: Crs) -> Column:
    """``struct<x,y>`` of a point in another coordinate system."""
    if source == target:
        return F.struct(x.alias("x"), y.alias("y"))
    degrees = F.struct(x.alias("lon"), y.alias("lat")) if source.zone is None else utm_inverse(x, y, F.lit(source.zone), F.lit(source.ellipsoid))
    # bound to a name, so that it is worked out once
    bound = F.transform(
        F.array(degrees),
        lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")) if target.zone is None
        else utm_forward(p["lon"], p["lat"], F.lit(target.zone), F.lit(target.ellipsoid)),
    )
    return F.get(bound, F.lit(0))


def densified(ring: Column, step: float) -> Column:
    """The ring with points put in, so that no edge is longer than ``step``."""

    def pieces(e):
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        n = F.greatest(F.ceil(F.sqrt(dx * dx + dy * dy) / F.lit(float(step))), F.lit(1))
        return F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.struct((e["a"]["x"] + dx * i / n).alias("x"), (e["a"]["y"] + dy * i / n).alias("y")))

    return F.concat(F.flatten(F.transform(edges(ring), pieces)), F.slice(ring, -1, 1))


def on_grid(geom: Column, grid: Grid, source: Crs | None = None, step: float | None = None) -> Column:
    """Rings in units of a grid's cells. Where the coordinate system changes, edges are densified to ``step`` first."""

    def place(p):
        return F.struct(((p["x"] - grid.x0) / grid.res).alias("x"), ((p["y"] - grid.y0) / grid.res).alias("y"))

    def moved(p):
        return projected(p["x"], p["y"], source, grid.crs)

    bends = grid.crs is not None and source is not None and grid.crs != source
    if bends and step is None:
        raise ValueError("a change of the coordinate system needs a step for densification")
    # two steps, so that a point is projected once for both of its coordinates
    return F.transform(geom, lambda ring: F.transform(F.transform(densified(ring, step), moved) if bends else ring, place))


def zone_runs(
    zones: DataFrame, zone_id: str, grids: Mapping[str, Grid], geom: str = "geom", crs: Crs | None = None, step: float | None = None,
    band_rows: int = BAND_ROWS, partitions: int | None = None,
) -> DataFrame:
    """``(zone, raster, row, col_from, col_to, share)``: cells that each zone covers on each grid, as runs of one share.

    Shares are exact for the zone's edges on the grid; an edge between two points of a densified ring is straight
    there. Zones without a geometry, or without any area, have no runs.
    """
    on = F.array(*[F.struct(F.lit(name).alias("raster"), on_grid(col(geom), grid, crs, step).alias("geom")) for name, grid in grids.items()])
    n = partitions or int(zones.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # zones are few bytes and much work: a small file would be projected by one task
    z = zones.where(col(geom).isNotNull()).select(col(zone_id).alias(zone_id), col(geom).alias(geom)).repartition(n)
    z = z.select(zone_id, F.explode(on).alias("_g"))
    z = z.select(zone_id, F.col("_g.raster").alias("raster"), F.col("_g.geom").alias("_geom"))
    b = bounds(F.col("_geom"))
    z = z.select(
        zone_id, "raster", oriented_edges("_geom").alias("_edges"), F.floor(b["ymin"]).alias("_r1"), (F.ceil(b["ymax"]) - 1).alias("_r2")
    ).where(F.col("_r2") >= F.col("_r1"))
    size = F.lit(band_rows)
    bands = z.withColumn("_band", F.explode(F.sequence(F.floor(F.col("_r1") / size), F.floor(F.col("_r2") / size))))
    low = F.col("_band") * size
    near = F.filter("_edges", lambda e: (F.least(e["ay"], e["by"]) < low + size) & (F.greatest(e["ay"], e["by"]) > low))
    bands = bands.select(
        zone_id, "raster", "_band", near.alias("_edges"), F.greatest("_r1", low).alias("_r1"), F.least("_r2", low + size - 1).alias("_r2")
    ).where(F.size("_edges") > 0)
    dealt = bands.repartition(n, zone_id, "raster", "_band")
    rows = dealt.select(zone_id, "raster", "_edges", F.explode(F.sequence("_r1", "_r2")).alias("row"))
    parts = rows.select(zone_id, "raster", "row", edges_in_row(F.col("_edges"), F.col("row")).alias("_parts"))
    runs = parts.select(zone_id, "raster", "row", F.explode(_row_runs(F.col("_parts"))).alias("_run"))
    return runs.select(zone_id, "raster", "row", *[F.col(f"_run.{c}").alias(c) for c in ("col_from", "col_to", "share")])


def _row_runs(parts: Column) -> Column:
    """Runs of one row from the parts of the edges in it."""
    passed = F.flatten(F.transform(parts, lambda p: F.sequence(F.floor(F.least(p["x1"], p["x2"])), F.floor(F.greatest(p["x1"], p["x2"])))))
    passed = F.sort_array(F.array_distinct(passed))

    def run(first, last):
        return F.struct(first.alias("col_from"), last.alias("col_to"), row_parts_cover(parts, first).alias("share"))

    def both(cells):
        between = F.zip_with(cells, F.slice(cells, F.lit(2), F.size(cells)), lambda a, b: F.struct((a + 1).alias("a"), (b - 1).alias("b")))
        between = F.filter(between, lambda g: g["b"].isNotNull() & (g["a"] <= g["b"]))
        return F.concat(F.transform(cells, lambda c: run(c, c)), F.transform(between, lambda g: run(g["a"], g["b"])))

    runs = F.flatten(F.transform(F.array(passed), both))
    return F.filter(runs, lambda r: r["share"] > 1e-12)


def raster_runs(pixels: DataFrame, combine: bool = False, stretch: int = STRETCH) -> DataFrame:
    """``(raster, row, stretch, class, weight, col_from, col_to)``: neighbouring cells of one class, within stretches of a row.

    ``combine`` adds up repeated cells of one class first; otherwise each of them is a run of its own.
    """
    p = pixels.select(
        "raster", F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), "class", F.lit(1.0).alias("weight")
    ).where(F.col("row").isNotNull() & F.col("col").isNotNull())
    p = p.withColumn("stretch", F.floor(F.col("col") / F.lit(stretch)))
    if combine:
        p = p.groupBy("raster", "row", "stretch", "col", "class").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    keys = ["raster", "row", "stretch", "class", "weight"]
    ranked = p.repartition("raster", "row", "stretch").withColumn("_at", F.col("col") - F.row_number().over(Window.partitionBy(*keys).orderBy("col")))
    return ranked.groupBy(*keys, "_at").agg(F.min("col").alias("first"), F.max("col").alias("last")).drop("_at")


def zonal_runs(
    zones: DataFrame, pixels: DataFrame, zone_id: str, grids: Mapping[str, Grid], combine: bool = False, stretch: int = STRETCH, **zone_args
) -> DataFrame:
    """Covered cells per ``(zone, raster, class)``: overlaps of the zones' runs and the rasters'.

    A run is cut at the ends of stretches of a row, so an interval meets a few others only, and neither a large
    zone nor a long run of one class is a hot key. Rasters without a grid take no part. Runs compress so well that
    Spark's size check would send them through the driver; they are always sorted instead.
    """
    z = zone_runs(zones, zone_id, grids, **zone_args)
    size = F.lit(stretch)
    z = z.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("col_from") / size), F.floor(F.col("col_to") / size))))
    z = z.withColumns({"col_from": F.greatest("col_from", F.col("stretch") * size), "col_to": F.least("col_to", F.col("stretch") * size + size - 1)})
    p = raster_runs(pixels.where(F.col("raster").isin(*grids)), combine, stretch)
    met = z.join(p.hint("merge"), ["raster", "row", "stretch"]).where((F.col("first") <= F.col("col_to")) & (F.col("last") >= F.col("col_from")))
    cells = F.least("last", "col_to") - F.greatest("first", "col_from") + 1
    return met.groupBy(zone_id, "raster", "class").agg(F.sum(F.col("share") * F.col("weight") * cells).alias("cover"))
