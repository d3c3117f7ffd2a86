"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbral.llm.common import materialise


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.join(_least(both), "u").where(F.col("v") > F.col("u"))
    return joined.select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its lower neighbours are linked to the least of these."""
    joined = edges.join(_least(edges), "u")
    out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v"))


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node of its component, of all nodes but the roots themselves.

    ``edges`` has two columns of long ids. Every round is written and read back; the rounds end when
    the edges no longer change.
    """
    one, two = edges.columns
    pairs = edges.where(F.col(one) != F.col(two)).select(F.greatest(one, two).alias("u"), F.least(one, two).alias("v"))
    pairs = materialise(pairs.distinct())
    seen = None
    while True:
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = tuple(state)
        pairs = materialise(_small_star(_large_star(pairs).distinct()).distinct())
