"""Scans: project tables, folders of files, boundary layers, rasters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RINGS = T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))


def _reader(spark: SparkSession, schema, fmt: str):
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.schema(schema) if schema is not None else reader


def read_tables(
    spark: SparkSession,
    folder: str,
    names: Sequence[str],
    schemas: Mapping[str, T.StructType] | None = None,
    fmt: str = "parquet",
) -> dict[str, DataFrame]:
    """One DataFrame per named table of a folder."""
    schemas = schemas or {}
    return {n: _reader(spark, schemas.get(n), fmt).load(f"{folder}/{n}.{fmt}") for n in names}


def read_folder_union(
    spark: SparkSession,
    paths: Sequence[str],
    schema: T.StructType | None = None,
    fmt: str = "parquet",
    source_col: str | None = None,
) -> DataFrame:
    """Rows of all files, bound by column name; columns a file lacks are NULL.

    With a common ``schema`` all paths go into one scan; files that differ are read one by one.
    """

    def load(p):
        df = _reader(spark, schema, fmt).load(p)
        return df.withColumn(source_col, F.input_file_name()) if source_col else df

    if schema is not None:
        return load(list(paths))
    return union_all_by_name([load(p) for p in paths])


def union_all_by_name(frames: Sequence[DataFrame], fill: bool = True) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=fill), frames)


def read_boundaries(spark: SparkSession, path: str, attributes: T.StructType | None = None) -> DataFrame:
    """Polygon layer: attributes and ``geom``, an array of rings of points."""
    if attributes is None:
        return spark.read.parquet(path)
    return spark.read.schema(T.StructType([*attributes.fields, T.StructField("geom", RINGS)])).parquet(path)


def explode_tiles(tiles: DataFrame, classes: str = "classes", width: str = "w") -> DataFrame:
    """Tile rows ``(raster, tile_x, tile_y, w, classes)`` to pixel rows ``(raster, col, row, class)``.

    ``tile_x`` and ``tile_y`` are the column and row of the tile's first cell; cells run row by row.
    """
    cells = tiles.select("raster", "tile_x", "tile_y", F.col(width).alias("_w"), F.posexplode(classes).alias("_pos", "class"))
    return cells.select(
        "raster",
        (F.col("tile_x") + F.pmod(F.col("_pos"), F.col("_w"))).cast("int").alias("col"),
        (F.col("tile_y") + F.floor(F.col("_pos") / F.col("_w"))).cast("int").alias("row"),
        "class",
    )


def read_pixels(spark: SparkSession, path: str, tiled: bool = False) -> DataFrame:
    """Raster as pixel rows ``(raster, col, row, class)``."""
    df = spark.read.parquet(path)
    return explode_tiles(df) if tiled else df
