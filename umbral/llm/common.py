"""What several operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from umbral.session import configure, materialise, release

__all__ = ["configure", "materialise", "release", "table", "part_count", "text_of", "mix", "columns_like"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def part_count(spark: SparkSession) -> int:
    """Number of reduce partitions of this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str) -> Column:
    """A text with null counted as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def columns_like(df: DataFrame, model: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in model.columns])


def mix(x):
    """Finaliser that spreads the bits of a uint64 array; wraps modulo 2**64."""
    import numpy as np

    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x

