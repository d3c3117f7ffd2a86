"""Exact dedup: sorted runs of digests are merged along a tree until each digest has one winner."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from umbral.llm.common import materialise, part_count, text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs merged into one at each round of the tree.
FAN_IN = 8
#: The digest space is cut into so many ranges, each of which has a tree of its own.
RANGES = 4096

RUN = "bucket int, node long, sha string, n_bytes long, check long, keep_id long, keep_tie long, group_size long"


def normal_text(column: str):
    """Null counts as empty; only A-Z are lower-cased."""
    return F.translate(text_of(column), UPPER, LOWER)


def _fold(batches: Iterator) -> Iterator:
    """Merge equal neighbours of a sorted run: the first row stays, sizes add up.

    ``n_bytes`` and ``check`` are compared with the digest at every level; digests that agree without
    them would stay apart.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    last = None
    for batch in batches:
        batch = pa.RecordBatch.from_arrays(batch.columns, names=batch.schema.names)  # nullable throughout
        if last is not None:
            batch = pa.concat_batches([last, batch])
        n = batch.num_rows
        if n == 0:
            continue
        new = np.ones(n, bool)
        for name in ("bucket", "node", "sha", "n_bytes", "check"):
            c = batch.column(name)
            changed = pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            new[1:] = changed if name == "bucket" else new[1:] | changed
        starts = np.flatnonzero(new)
        sizes = np.add.reduceat(batch.column("group_size").to_numpy(), starts)
        out = batch.take(pa.array(starts))
        at = out.schema.get_field_index("group_size")
        out = pa.RecordBatch.from_arrays([*out.columns[:at], pa.array(sizes), *out.columns[at + 1 :]], names=out.schema.names)
        last = out.slice(len(starts) - 1)
        if len(starts) > 1:
            yield out.slice(0, len(starts) - 1)
    if last is not None:
        yield last


def digest_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, a tie-breaker, digest and check values of the normalised text."""
    text = normal_text(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t")).select(
        "doc_id",
        F.monotonically_increasing_id().alias("tie"),
        F.sha2(F.col("t").cast("binary"), 256).alias("sha"),
        F.octet_length("t").cast("long").alias("n_bytes"),
        F.xxhash64("t").alias("check"),
    )


def merge_runs(digests: DataFrame, fan_in: int = FAN_IN, ranges: int = RANGES) -> DataFrame:
    """Winner and size of each group of equal digests, by a tree of merges.

    Every partition sorts its digests into a run and folds it. In each round ``fan_in`` runs of one
    range of digests meet in one task, are merged and folded again, until one run is left per range.
    A digest leaves a partition at most once per round however many rows had it.
    """
    n = part_count(digests.sparkSession)
    order = ["bucket", "node", "sha", "n_bytes", "check", F.desc_nulls_last("keep_id"), "keep_tie"]
    runs = digests.select(
        (F.conv(F.substring("sha", 1, 8), 16, 10).cast("long") % ranges).cast("int").alias("bucket"),
        F.spark_partition_id().cast("long").alias("node"),
        "sha", "n_bytes", "check",
        F.col("doc_id").alias("keep_id"), F.col("tie").alias("keep_tie"), F.lit(1).cast("long").alias("group_size"),
    )
    nodes = digests.rdd.getNumPartitions()
    runs = runs.sortWithinPartitions(*order).mapInArrow(_fold, RUN)
    while nodes > 1:
        nodes = -(-nodes // fan_in)
        runs = runs.withColumn("node", F.floor(F.col("node") / fan_in))
        runs = runs.repartition(n, "bucket", "node").sortWithinPartitions(*order).mapInArrow(_fold, RUN)
    return runs.drop("bucket", "node")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with the winner of its group of equal texts.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The largest id stays,
    a null id counts as smallest. Of repeated rows with one id and one text the first read stays. An
    empty table gives no rows; other columns are ignored, whatever their names.
    """
    digests = materialise(digest_table(docs, id_col, text_col))
    winners = merge_runs(digests)
    keys = ["sha", "n_bytes", "check"]
    return digests.join(winners, keys).select(
        "doc_id",
        F.col("keep_id"),
        F.col("group_size"),
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("tie") == F.col("keep_tie"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, columns unchanged; of repeated rows with one id and text, one."""
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("null")).alias("id"),
        F.sha2(normal_text(text_col).cast("binary"), 256).alias("sha"),
    )
    kept = (
        exact_groups(docs, id_col, text_col)
        .where("kept")
        .select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id"), F.col("text_sha256").alias("sha"))
    )
    first = Window.partitionBy("id", "sha").orderBy("id", "sha")  # as the join left them: no further shuffle
    joined = rows.join(kept, ["id", "sha"]).withColumn("n", F.row_number().over(first)).where("n = 1")
    return joined.select("row.*")
