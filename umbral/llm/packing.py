"""Packing: documents' token ids into sequences of one length, shortest pack first over a histogram."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from umbral.llm.common import materialise, text_of
from umbral.llm.tokens import END_ID, WordEncoder, crc_of, slices

LENGTH = 2048

PIECE = "part int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ordinal long"


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Packing patterns with their counts, for so many pieces of each length.

    Lengths go longest first. Pieces of one length go together into the packs with the most free
    space, as many as there are of such packs; where none has room, packs are opened that hold as many
    copies as fit. A step over a length changes packs in place, splits one group of packs at most, and
    opens two at most, so there are at most three patterns for each length.
    """
    free: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in range(capacity + 1)]
    for length in range(capacity, 0, -1):
        n = histogram.get(length, 0)
        space = capacity
        while n:
            while space >= length and not free[space]:
                space -= 1
            if space < length:
                copies = capacity // length
                for count, k in ((n // copies, copies), (1, n % copies)):
                    if count and k:
                        free[capacity - k * length].append((count, (length,) * k))
                break
            count, pattern = free[space].pop()
            used = min(count, n)
            if used < count:
                free[space].append((count - used, pattern))
            free[space - length].append((used, (*pattern, length)))
            n -= used
    return [p for packs in free for p in packs]


def _pieces(path: str, capacity: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, part = WordEncoder(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        end = np.array([END_ID], "<u2").tobytes()
        names = [f.split()[0] for f in PIECE.split(", ")]
        for whole in batches:
            for batch in slices(whole):
                rows = []
                for doc, found in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text").to_pylist())):
                    ids = np.frombuffer(found + end, "<u2")
                    for start in range(0, len(ids), capacity):
                        piece = ids[start : start + capacity]
                        rows.append((part, doc, start, len(piece), crc_of(piece), len(ids), int(seen[len(piece)])))
                        seen[len(piece)] += 1
                if rows:
                    types = [pa.int32()] + [pa.int64()] * 6
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def _place(slots):
    """Sequence and offset of each piece, from its length and its rank among the pieces of that length."""
    lengths, first, sequence, offset = slots

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        key = lengths.astype(np.int64) * (1 << 48) + first
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(key, length * (1 << 48) + rank, side="right") - 1
            columns = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            columns += [pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def slot_table(patterns: list[tuple[int, tuple[int, ...]]]):
    """For runs of ranks of a length: first rank, sequence of that rank, and offset in the sequence."""
    import numpy as np

    used: dict[int, int] = {}
    rows, sequence = [], 0
    for count, pattern in patterns:
        at = 0
        for length in pattern:
            first = used.get(length, 0)
            rows.append((length, first, sequence, at))
            used[length] = first + count
            at += length
        sequence += count
    rows.sort()
    return tuple(np.array([r[i] for r in rows], np.int64) for i in range(4))


def pack(docs: DataFrame, tokenizer: str, capacity: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their sequence and offset.

    A document's ids and an end id are cut into pieces of ``capacity``, the last of which may be
    shorter. A null text is its end id alone; repeated rows are documents of their own; an empty table
    gives no rows. The histogram (a number for each length) and the patterns made from it are the only
    things the driver holds. A piece's rank in its length is its number in its partition plus the
    numbers of the partitions before.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    pieces = materialise(rows.mapInArrow(_pieces(tokenizer, capacity), PIECE))
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = dict(counts.groupBy("length").agg(F.sum("n")).collect())
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["part", "length"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("ordinal")).alias("rank")
    )
    slots = slot_table(shortest_pack_first(histogram, capacity))
    return ranked.mapInArrow(
        _place(slots), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
