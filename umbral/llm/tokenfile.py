"""Token files: blocks of one concatenated id array with Elias-Fano coded document ends.

A block is one row: the ids of its documents as little-endian uint16, and the end of each document
in the block as an Elias-Fano sequence. Of an end, the lowest ``low_bits`` bits are packed in
``lows``; the rest is written in unary into the bit vector ``highs``, where the i-th set bit, less i,
is the high part. ``samples`` has the place of every 64th set bit as uint32, so that one end is found
by reading a few bytes. That is about 2 + log2(ids / documents) bits for a document.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbral.llm.common import part_count, text_of
from umbral.llm.tokens import END_ID, WordEncoder, crc_of, slices
from umbral.session import stage_root

#: A block is closed at so many documents or ids; a longer document has a block of its own.
BLOCK_DOCS, BLOCK_IDS = 4096, 1 << 20
SAMPLE = 64

BLOCK = (
    "shard int, block int, shard_start long, n_docs int, n_ids long, low_bits int, lows binary, highs binary, "
    "samples binary, doc_ids binary, doc_nulls binary, ids binary"
)


def elias_fano(ends) -> tuple[int, bytes, bytes, bytes]:
    """``low_bits``, ``lows``, ``highs`` and ``samples`` of a rising int64 array."""
    import numpy as np

    n = len(ends)
    universe = int(ends[-1]) if n else 0
    low = max(0, (universe // n).bit_length() - 1) if n else 0
    lows = (ends[:, None] >> np.arange(low)) & 1
    ones = (ends >> low) + np.arange(n)
    highs = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    highs[ones] = 1
    pack = lambda bits: np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
    return low, pack(lows), pack(highs), ones[::SAMPLE].astype("<u4").tobytes()


def select(low: int, lows: bytes, highs: bytes, samples: bytes, i: int) -> int:
    """The i-th end alone: from the sample before it, bytes are skipped by their number of set bits."""
    import numpy as np

    at = int(np.frombuffer(samples, "<u4", 1, i // SAMPLE * 4)[0])
    left, byte = i % SAMPLE, at // 8
    current = highs[byte] >> (at % 8) << (at % 8)
    while current.bit_count() <= left:
        left -= current.bit_count()
        byte += 1
        current = highs[byte]
    for _ in range(left):
        current &= current - 1
    one = byte * 8 + (current & -current).bit_length() - 1
    value, first = 0, i * low
    for k in range(low):
        bit = first + k
        value |= (lows[bit // 8] >> (bit % 8) & 1) << k
    return (one - i) << low | value


def decode_ends(n: int, low: int, lows: bytes, highs: bytes):
    """All ends of a block as an int64 array."""
    import numpy as np

    unpack = lambda data, count=None: np.unpackbits(np.frombuffer(data, np.uint8), count=count, bitorder="little")
    ones = np.flatnonzero(unpack(highs))
    bits = unpack(lows, n * low).reshape(n, low).astype(np.int64)
    return (ones - np.arange(n) << low) + (bits << np.arange(low)).sum(axis=1)


def _encode(path: str):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, shard = WordEncoder(path), TaskContext.get().partitionId()
        names = [f.split()[0] for f in BLOCK.split(", ")]
        types = {"shard": pa.int32(), "block": pa.int32(), "shard_start": pa.int64(), "n_docs": pa.int32(), "n_ids": pa.int64(), "low_bits": pa.int32()}
        block, start, data, docs, count = 0, 0, [], [], 0
        end = np.array([END_ID], "<u2").tobytes()

        def close():
            sizes = np.array([len(d) // 2 for d in data], np.int64)
            low, lows, highs, samples = elias_fano(np.cumsum(sizes))
            nulls = np.packbits(np.array([d is None for d in docs], np.uint8), bitorder="little").tobytes()
            own = np.array([d or 0 for d in docs], "<i8").tobytes()
            row = (shard, block, start, len(docs), int(sizes.sum()), low, lows, highs, samples, own, nulls, b"".join(data))
            return pa.RecordBatch.from_arrays([pa.array([v], types.get(k, pa.binary())) for k, v in zip(names, row)], names=names)

        for whole in batches:
            for batch in slices(whole):
                ids = encoder.encode(batch.column("text").to_pylist())
                for doc, found in zip(batch.column("doc_id").to_pylist(), ids):
                    found += end
                    if docs and (len(docs) == BLOCK_DOCS or count + len(found) // 2 > BLOCK_IDS):
                        yield close()
                        block, start, data, docs, count = block + 1, start + count, [], [], 0
                    data.append(found)
                    docs.append(doc)
                    count += len(found) // 2
        if docs:
            yield close()

    return run


def write_token_file(docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all documents in ascending id order (null first), an end id after each.

    Null texts count as empty, so such a document is its end id alone. Rows that share an id keep the
    order in which they are read. An empty table gives a file without blocks.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("tie"), text_of(text_col).alias("text"))
    n = part_count(docs.sparkSession)
    ordered = rows.repartitionByRange(n, F.asc_nulls_first("doc_id"), "tie").sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie")
    ordered.select("doc_id", "text").mapInArrow(_encode(tokenizer), BLOCK).write.parquet(path)


def _decode(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for r in batch.to_pylist():
            n = r["n_docs"]
            ends = decode_ends(n, r["low_bits"], r["lows"], r["highs"])
            starts = np.append(0, ends[:-1])
            ids = np.frombuffer(r["ids"], "<u2")
            null = np.unpackbits(np.frombuffer(r["doc_nulls"], np.uint8), count=n, bitorder="little").astype(bool)
            crcs = [crc_of(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, r["shard"], np.int32)),
                    pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=null),
                    pa.array(starts + r["shard_start"]),
                    pa.array(ends - starts),
                    pa.array(crcs, pa.int64()),
                ],
                names=["shard", "doc_id", "own", "n_tokens", "ids_crc32"],
            )


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a token file: id, ids before it, number of ids and their crc32."""
    blocks = spark.read.parquet(path)
    sizes = dict(blocks.groupBy("shard").agg(F.sum("n_ids")).collect())  # one number for each shard
    before, base = 0, []
    for shard in sorted(sizes):
        base.append((shard, before))
        before += sizes[shard]
    bases = F.broadcast(spark.createDataFrame(base, "shard int, base long"))
    rows = blocks.mapInArrow(_decode, "shard int, doc_id long, own long, n_tokens long, ids_crc32 long")
    return rows.join(bases, "shard").select("doc_id", (F.col("base") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")


def token_file_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write ``docs`` into a new token file in the shared folder and read it back."""
    spark = docs.sparkSession
    path = f"{stage_root(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_token_file(docs, tokenizer, path)
    return read_token_file(spark, path)
