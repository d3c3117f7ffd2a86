"""Session settings and the one place where intermediate tables are written."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

#: Settings every job of this library assumes. ``forceOptimizeSkewedJoin`` lets adaptive execution
#: split a hot join key even where that costs one more shuffle.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def stage_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: ``spark.checkpoint.dir`` of the cluster.

    Only a local session without that setting (tests, notebooks) gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: name a folder every executor can reach")
    return _local_root()


@lru_cache(maxsize=1)
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="umbral-stages-")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage with a columnar table, so that several later passes scan only the columns they
    need and a lost executor costs a re-read instead of a recomputation.
    """
    spark = df.sparkSession
    path = f"{stage_root(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._umbral_stage = path
    return out


def release(df: DataFrame) -> None:
    """Delete the table that :func:`materialise` wrote for ``df``, once nothing reads it any more."""
    path = getattr(df, "_umbral_stage", None)
    if path is not None:
        place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
