"""Exact top-k search by inner product over vector-approximation blocks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbral.llm.common import materialise, part_count

#: Cells per dimension of an approximation: one byte has the cell's number.
CELLS = 64
BLOCK_ROWS, QUERY_ROWS = 4096, 512
#: So many candidates of a block of queries are held until the bounds of all blocks of cells of a task are known.
HELD_ROWS = 1 << 20
#: Exact vectors read in the first round, as a multiple of k.
FIRST = 2

BLOCK = "dim int, part int, ids binary, data binary"
BOUND = "query_id long, vec_id long, low double, high double"


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """``vec_id`` and ``v``: each component x as floor(scale * x). Rows without id, without vector, or
    with a null or non-finite component are left out; rows repeated in full count once."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda e: F.coalesce(~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < F.lit(float("inf"))), F.lit(False)))
    ints = F.transform(x, lambda e: F.floor(e.cast("double") * F.lit(scale)).cast("long"))
    rows = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & finite)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), ints.alias("v")).distinct()


def _blocks(groups: int, rows: int, corners: dict | None):
    """Pack rows into blocks; with ``corners`` (lowest value and cell width of each dimension) as cells."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, count, held = TaskContext.get().partitionId(), 0, {}

        def close(dim):
            nonlocal count
            ids, data = held.pop(dim)
            v = np.array(data, np.int64).reshape(len(ids), dim)
            if corners is not None:
                low, width = (np.array(x) for x in corners[dim])
                v = np.minimum((v - low) // width, CELLS - 1).astype(np.uint8)
            else:  # a copy goes to every task, in the narrowest type that holds it
                v = v.astype(next(t for t in ("i1", "<i2", "<i4", "<i8") if not v.size or np.iinfo(t).min <= v.min() and v.max() <= np.iinfo(t).max))
            group = (part + 7919 * count) % groups
            count += 1
            values = [pa.array([dim], pa.int32()), pa.array([group], pa.int32()), pa.array([np.array(ids, "<i8").tobytes()]), pa.array([v.tobytes()])]
            return pa.RecordBatch.from_arrays(values, names=["dim", "part", "ids", "data"])

        for batch in batches:
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist()):
                ids, data = held.setdefault(len(v), ([], []))
                ids.append(i)
                data.extend(v)
                if len(ids) == rows:
                    yield close(len(v))
        for dim in list(held):
            yield close(dim)

    return run


def _bounds(k: int, corners: dict):
    """Candidates of each query in the blocks of cells of its part that may be among its k best there, with their bounds.

    The blocks of cells of a part come before the blocks of queries, each once, and are held."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def rows(found, kth):
            row, columns = np.concatenate([f[0] for f in found]), [np.concatenate([f[i] for f in found]) for i in range(1, 5)]
            open_ = columns[-1] >= kth[row]
            return pa.RecordBatch.from_arrays([pa.array(c[open_]) for c in columns], names=["query_id", "vec_id", "low", "high"])

        def bounds(dim, queries, q, cells):
            plus, minus, size = np.maximum(q, 0), np.minimum(q, 0), np.abs(q)
            best, found, held = np.full((len(queries), k), -np.inf), [], 0  # the k highest lower bounds so far
            for ids, data in cells:
                low, width = (np.array(x, np.float64) for x in corners[dim])
                below = low + data * width
                above = below + (width - 1)
                least = plus @ below.T + minus @ above.T
                most = plus @ above.T + minus @ below.T
                slack = 1e-12 * (size @ np.maximum(np.abs(below), np.abs(above)).T)  # of the rounded sums
                least, most = least - slack, most + slack
                own = queries[:, None] == ids[None, :]
                least[own] = most[own] = -np.inf
                top = np.partition(least, len(ids) - k, axis=1)[:, len(ids) - k :] if len(ids) > k else least
                best = np.partition(np.concatenate([best, top], axis=1), top.shape[1], axis=1)[:, top.shape[1] :]
                row, column = np.nonzero((most >= best.min(axis=1)[:, None]) & ~own)
                found.append((row, queries[row], ids[column], least[row, column], most[row, column]))
                held += len(row)
                if held > HELD_ROWS:
                    yield rows(found, best.min(axis=1))
                    found, held = [], 0
            if found:
                yield rows(found, best.min(axis=1))

        part, cells = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                (r,) = batch.slice(i, 1).to_pylist()
                if r["part"] != part:
                    part, cells = r["part"], {}
                dim, ids = r["dim"], np.frombuffer(r["ids"], "<i8")
                if r["asks"]:
                    q = np.frombuffer(r["data"], f"<i{len(r['data']) // (len(ids) * dim) if dim else 8}").reshape(len(ids), dim)
                    yield from bounds(dim, ids, q.astype(np.float64), cells.get(dim, []))
                else:
                    cells.setdefault(dim, []).append((ids, np.frombuffer(r["data"], np.uint8).reshape(len(ids), dim)))

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` highest inner products of each query with every other row, ties to the smaller id.

    Of equal vectors only the ``k + 1`` smallest ids can be in a result, so no more are kept. Blocks of
    cells are scanned for bounds; the k-th highest lower bound of a query rules most rows out. Exact
    vectors of the rest are read in the order of their upper bounds: first ``FIRST * k`` of them, whose
    k-th score then tells which of the others still can matter, and those. Vectors are compared with
    vectors of their own length. No rows: no result. ``is_query`` is a condition on ``vec_id``.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, id_col, vector_col)
    same = Window.partitionBy("v").orderBy("vec_id")
    candidates = materialise(rows.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1).drop("nth"))
    queries = materialise(rows.where(is_query))
    ranges = (
        candidates.select(F.size("v").alias("dim"), F.posexplode("v").alias("at", "x"))
        .groupBy("dim", "at").agg(F.min("x").alias("low"), F.max("x").alias("high")).collect()
    )  # fmt: skip  # two numbers for each component
    corners: dict = {0: ([], [])}
    for r in sorted(ranges, key=lambda r: (r["dim"], r["at"])):
        low, width = corners.setdefault(r["dim"], ([], []))
        low.append(r["low"])
        width.append(-(-(r["high"] - r["low"] + 1) // CELLS))
    # a part is a task of its own, with a copy of all queries: there are no more of them than blocks
    parts = max(1, min(part_count(spark), -(-candidates.count() // BLOCK_ROWS)))
    blocks = candidates.mapInArrow(_blocks(parts, BLOCK_ROWS, corners), BLOCK).withColumn("asks", F.lit(False))
    asked = queries.mapInArrow(_blocks(1, QUERY_ROWS, None), BLOCK).withColumn("asks", F.lit(True))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    # each block once: as pairs of a join they would be many times as large, in a broadcast or in a worker's batches
    dealt = blocks.unionByName(asked).repartition(parts, "part").sortWithinPartitions("part", "asks")
    bounds = materialise(dealt.mapInArrow(_bounds(k, corners), BOUND))

    by_low = Window.partitionBy("query_id").orderBy(F.desc("low"))
    sure = bounds.withColumn("nth", F.row_number().over(by_low)).where(F.col("nth") == k).select("query_id", F.col("low").alias("sure"))
    by_high = Window.partitionBy("query_id").orderBy(F.desc("high"), "vec_id")
    open_ = bounds.join(sure, "query_id", "left").where(F.col("sure").isNull() | (F.col("high") >= F.col("sure")))
    open_ = materialise(open_.select("query_id", "vec_id", "high", F.row_number().over(by_high).alias("nth")))

    product = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x)

    def score(pairs: DataFrame) -> DataFrame:
        own = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
        # vectors can compress to little, but be large in a broadcast
        read = pairs.select("query_id", "vec_id").join(candidates, "vec_id").join(own.hint("merge"), "query_id")
        return read.where(F.size("q") == F.size("v")).select("query_id", "vec_id", product.alias("score"))

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = materialise(score(open_.where(F.col("nth") <= FIRST * k)))
    kth = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    rest = open_.where(F.col("nth") > FIRST * k).join(kth, "query_id").where(F.col("high") >= F.col("kth"))
    scored = first.unionByName(score(rest)).distinct()
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
