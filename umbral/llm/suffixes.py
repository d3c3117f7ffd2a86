"""Removal of repeated passages by column-wise construction of sorted suffixes.

Only bytes near a repeated fingerprint can lie in a repeated passage, so the suffixes that are sorted
are those of short segments. A text's fingerprints are picked by content: of each window of ``LENGTH``
bytes the smallest hash of its ``GRAM``-byte strings is picked, so two equal windows pick the same place.
A segment is what the windows around a picked place can reach. Segments with one fingerprint form a
collection, aligned at that place: equal windows start in the same column.

A collection is built column by column from the right, one symbol of every segment each round: the
order of the suffixes is split by the new symbols, stably (the step of the Burrows-Wheeler transform
of the collection), and the common prefix of neighbours is one more than the least between their old
places. After a round, neighbours with ``LENGTH`` symbols in common tell a repeated window. As suffixes
meet only their own column, a round holds one entry per segment; it is kept in memory, since a batch
of collections is bounded and tasks have no shared place for files.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbral.llm.common import materialise, mix, part_count, text_of

LENGTH, GRAM = 200, 64
#: Windows that contain one fingerprint start at so many places; a segment reaches so far.
STARTS = LENGTH - GRAM + 1
REACH = STARTS - 1
WIDTH = REACH + LENGTH
#: Distinct segments of a collection that one task builds (some 100 MB); larger ones are compared window by window,
#: in a grouped count without any group in a task.
COLLECTION = 65_536
#: Pairs of fingerprint and segment that a scan remembers, so as not to send their bytes again.
SEEN = 1 << 17
#: Segments whose columns are built together, at least.
BATCH = 8192
#: Bits of the filters that spare rows a shuffle; a false hit costs a row and changes nothing.
FILTER_BITS = 1 << 26
SLICE = 1 << 20
BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=2)
def _powers(n: int):
    """Powers of the base of the rolling hash and of its inverse modulo 2**64, and a number for each byte."""
    import numpy as np

    inverse = pow(BASE, -1, 1 << 64)
    powers = np.full(n, BASE, np.uint64)
    inverses = np.full(n, inverse, np.uint64)
    powers[0] = inverses[0] = 1
    symbols = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.multiply.accumulate(powers), np.multiply.accumulate(inverses), symbols


def _sliding(x, width: int, pick, fill):
    """``pick`` over x[i : i + width], beyond the end over ``fill``."""
    import numpy as np

    x = np.concatenate([x, np.full(width, fill, x.dtype)])
    done = 1
    while done * 2 <= width:
        x = pick(x[:-done], x[done:])
        done *= 2
    if done < width:
        x = pick(x[: len(x) - (width - done)], x[width - done :])
    return x


def fingerprints(data, lengths):
    """Of texts laid end to end: text, place, hash of the string there, and hash of its segment.

    ``data`` are the bytes and ``lengths`` the texts' lengths. A text shorter than a window has none.
    """
    import numpy as np

    n = len(data)
    size = 1 << max(16, int(n + 1).bit_length())
    powers, inverses, symbols = _powers(size)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(symbols[data] * powers[:n], dtype=np.uint64)])
    ends = np.cumsum(lengths)
    if n < LENGTH:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * inverses[: n - GRAM + 1])
    least = _sliding(grams, STARTS, np.minimum, np.iinfo(np.uint64).max)[: n - LENGTH + 1]
    # a window counts if it lies in one text
    inside = np.zeros(n + 1, np.int32)
    whole = lengths >= LENGTH
    np.add.at(inside, (ends - lengths)[whole], 1)
    np.add.at(inside, (ends - LENGTH + 1)[whole], -1)
    least[np.cumsum(inside)[: len(least)] == 0] = 0
    # place i is picked if some window that contains it has it as its least
    back = np.concatenate([least, np.zeros(len(grams) - len(least), np.uint64)])[::-1]
    most = _sliding(back, STARTS, np.maximum, np.uint64(0))[: len(grams)][::-1]
    at = np.flatnonzero((most == grams) & (most != 0))
    text = np.searchsorted(ends, at, side="right")
    first, last = (ends - lengths)[text], ends[text]
    start, stop = np.maximum(first, at - REACH), np.minimum(last, at + LENGTH)
    segment = mix((sums[stop] - sums[start]) * inverses[start] + mix((at - start).astype(np.uint64) * np.uint64(1000) + (stop - start).astype(np.uint64)))
    return text, at - first, grams[at].view(np.int64), segment.view(np.int64)


def _slices(batch):
    """Rows of an Arrow batch with their bytes end to end, about ``SLICE`` bytes at a time."""
    import numpy as np
    import pyarrow as pa

    texts = batch.column("text").cast(pa.large_binary()).to_pylist()
    start, total = 0, 0
    for i, t in enumerate([*texts, b""]):
        if i == len(texts) or (total and total + len(t) > SLICE):
            part = texts[start:i]
            if part:
                yield batch.slice(start, i - start), part, np.frombuffer(b"".join(part), np.uint8), np.array([len(p) for p in part], np.int64)
            start, total = i, 0
        total += len(t)


def _passes(bits, prints):
    import numpy as np

    cell = prints & (FILTER_BITS - 1)
    return (bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 > 0


def _scan_prints(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for whole in batches:
        for _, _, data, lengths in _slices(whole):
            yield pa.RecordBatch.from_arrays([pa.array(fingerprints(data, lengths)[2])], names=["print"])


def _scan_kinds(shared):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bits = shared.value
        for whole in batches:
            for _, _, data, lengths in _slices(whole):
                _, _, prints, segment = fingerprints(data, lengths)
                keep = _passes(bits, prints)
                yield pa.RecordBatch.from_arrays([pa.array(prints[keep]), pa.array(segment[keep])], names=["print", "segment"])

    return run


def _scan_places(shared):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bits = shared.value
        for whole in batches:
            for rows, _, data, lengths in _slices(whole):
                text, at, prints, segment = fingerprints(data, lengths)
                keep = _passes(bits, prints)
                own = pa.array(text[keep])
                yield pa.RecordBatch.from_arrays(
                    [*[rows.column(c).take(own) for c in ("key", "check", "size")], pa.array(at[keep].astype("i4")), pa.array(prints[keep]), pa.array(segment[keep])],
                    names=["key", "check", "size", "at", "print", "segment"],
                )

    return run


def _scan_segments(shared, others=None):
    """Bytes of the segments whose fingerprint is in a filter but not in another; repeated ones seldom, ``SEEN``
    of them are remembered."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        bits, seen = shared.value, set()
        for whole in batches:
            for _, texts, data, lengths in _slices(whole):
                text, at, prints, segment = fingerprints(data, lengths)
                keep = _passes(bits, prints)
                if others is not None:
                    keep &= ~_passes(others.value, prints)
                keep = np.flatnonzero(keep)
                pairs = list(zip(prints[keep].tolist(), segment[keep].tolist()))
                fresh = []
                for i, pair in enumerate(pairs):
                    if pair not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(pair)
                        fresh.append(i)
                keep = keep[fresh]
                left = np.minimum(at[keep], REACH)
                parts = [texts[t][a - x : a + LENGTH] for t, a, x in zip(text[keep].tolist(), at[keep].tolist(), left.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(prints[keep]), pa.array(segment[keep]), pa.array(left.astype("i4")), pa.array(parts, pa.binary())],
                    names=["print", "segment", "left", "data"],
                )

    return run


def _matrix(left, parts):
    """Segments aligned at their fingerprints; 256 stands outside a text."""
    import numpy as np

    x = np.full((len(parts), WIDTH), 256, np.uint16)
    for i, (gap, part) in enumerate(zip(left, parts)):
        x[i, REACH - gap : REACH - gap + len(part)] = np.frombuffer(part, np.uint8)
    return x


def repeated_windows(x, group):
    """Columns at which each segment's window also starts in another segment of its group.

    ``group`` numbers the collections and rises. Returns a matrix of booleans, segments by starts.
    """
    import numpy as np

    n = len(x)
    found = np.zeros((n, STARTS), bool)
    order = np.arange(n)  # by group; suffixes are empty at first
    common = np.zeros(n + 1, np.int64)  # of neighbours i - 1 and i
    for column in range(x.shape[1] - 1, -1, -1):
        key = group[order].astype(np.int64) << 9 | x[order, column]
        to = np.argsort(key, kind="stable")
        same = np.flatnonzero(key[to[1:]] == key[to[:-1]])
        updated = np.zeros(n + 1, np.int64)
        if len(same):
            bounds = np.empty(2 * len(same), np.int64)
            bounds[0::2], bounds[1::2] = to[same] + 1, to[same + 1] + 1
            updated[same + 1] = np.minimum.reduceat(common, bounds)[0::2] + 1
        order, common = order[to], updated
        if column < STARTS:
            found[order, column] = np.maximum(common[:-1], common[1:]) >= LENGTH
    return found


def _valid(left, sizes):
    """Which windows of each segment lie inside its text."""
    import numpy as np

    start = np.arange(STARTS)
    first = REACH - np.asarray(left)[:, None]
    return (start >= first) & (start + LENGTH <= first + np.asarray(sizes)[:, None])


def _collections(batches: Iterator) -> Iterator:
    """Covered part of each segment, from rows sorted by fingerprint and segment."""
    import numpy as np
    import pyarrow as pa

    def solve(rows):
        prints, segments, left, parts = zip(*rows)
        prints = np.array(prints, np.int64)
        group = np.concatenate([[0], np.cumsum(prints[1:] != prints[:-1])])
        found = repeated_windows(_matrix(left, parts), group) & _valid(left, [len(p) for p in parts])
        some = np.flatnonzero(found.any(axis=1))
        first, last = found.argmax(axis=1)[some], STARTS - found[:, ::-1].argmax(axis=1)[some] - 1 + LENGTH
        return pa.RecordBatch.from_arrays(
            [pa.array(prints[some]), pa.array(np.array(segments, np.int64)[some]), pa.array(first.astype("i4")), pa.array(last.astype("i4"))],
            names=["print", "segment", "first", "last"],
        )

    held: list = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("print", "segment", "left", "data"))):
            if held and held[-1][0] == row[0] and held[-1][1] == row[1]:
                continue
            if len(held) >= BATCH and held[-1][0] != row[0]:
                yield solve(held)
                held = []
            held.append(row)
    if held:
        yield solve(held)


def _windows(batches: Iterator) -> Iterator:
    """A row for each window of a segment: two hashes of its bytes and its start."""
    import numpy as np
    import pyarrow as pa

    powers, inverses, symbols = _powers(1 << 16)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            rows = batch.slice(at, 256)
            left, parts = rows.column("left").to_pylist(), rows.column("data").to_pylist()
            x = _matrix(left, parts)
            valid = _valid(left, [len(p) for p in parts])
            hashes = []
            for salt in (0, 1):
                values = np.append(mix(symbols + np.uint64(salt)), np.uint64(0))[x] * powers[:WIDTH]
                sums = np.concatenate([np.zeros((len(x), 1), np.uint64), np.cumsum(values, axis=1, dtype=np.uint64)], axis=1)
                hashes.append(mix((sums[:, LENGTH:] - sums[:, :-LENGTH])[:, :STARTS] * inverses[:STARTS]))
            row, start = np.nonzero(valid)
            own = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [rows.column("print").take(own), rows.column("segment").take(own), pa.array(start.astype("i4")), *[pa.array(h[valid].view(np.int64)) for h in hashes]],
                names=["print", "segment", "start", "one", "two"],
            )


def fixed_filter(prints: DataFrame):
    """Bit map of fixed size with a bit for each fingerprint."""
    import numpy as np

    cell = F.col("print").bitwiseAND(FILTER_BITS - 1)
    parts = prints.select((cell + 1).alias("cell")).groupBy(F.bitmap_bucket_number("cell").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits"))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in parts.collect():
        own = np.frombuffer(bytes(r["bits"]), np.uint8)
        bits[(r["part"] - 1) * 4096 : (r["part"] - 1) * 4096 + len(own)] = own
    return bits


def covered_segments(texts: DataFrame) -> DataFrame:
    """``key``, ``check``, ``size``, ``at``, ``first``, ``last``: parts of the segments at each place that are repeated.

    ``texts`` has ``key``, ``check``, ``size`` and ``text``. It is scanned for the fingerprints, for the kinds of
    segments of the repeated ones, for the bytes of segments that are not repeated whole, and for the
    places: scans cost less than keeping what they find.
    """
    spark = texts.sparkSession
    n = part_count(spark)
    share = spark.sparkContext.broadcast
    only = texts.select("text")
    counts = only.mapInArrow(_scan_prints, "print long").groupBy("print").agg(F.count(F.lit(1)).alias("n"))
    repeated = share(fixed_filter(counts.where("n > 1")))
    kinds = only.mapInArrow(_scan_kinds(repeated), "print long, segment long")
    segments = materialise(kinds.groupBy("print", "segment").agg(F.count(F.lit(1)).alias("n")))
    prints = materialise(segments.groupBy("print").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"))
    mixed, large = (fixed_filter(prints.where(c)) for c in (F.col("kinds") <= COLLECTION, F.col("kinds") > COLLECTION))
    any_large, mixed, large = large.any(), share(mixed), share(large)

    held = "print long, segment long, left int, data binary"
    covered = "print long, segment long, first int, last int"
    dealt = only.mapInArrow(_scan_segments(mixed, large), held).repartition(n, "print").sortWithinPartitions("print", "segment")
    partly = dealt.mapInArrow(_collections, covered)
    if any_large:
        once = only.mapInArrow(_scan_segments(large), held).dropDuplicates(["print", "segment"])
        windows = materialise(once.mapInArrow(_windows, "print long, segment long, start int, one long, two long"))
        again = windows.groupBy("print", "start", "one", "two").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        wide = windows.join(again, ["print", "start", "one", "two"]).groupBy("print", "segment")
        partly = partly.unionByName(wide.agg(F.min("start").alias("first"), (F.max("start") + LENGTH).alias("last")))
    whole = segments.where("n > 1").select("print", "segment", F.lit(0).alias("first"), F.lit(WIDTH).alias("last"))
    # windows of one segment overlap, so what they cover is one run
    parts = whole.unionByName(partly.join(whole, ["print", "segment"], "left_anti"))
    places = texts.mapInArrow(_scan_places(repeated), "key long, check long, size int, at int, print long, segment long")
    return places.join(parts, ["print", "segment"]).select("key", "check", "size", "at", "first", "last")


def _cut(with_text: bool):
    def run(batches: Iterator) -> Iterator:
        import hashlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = []
            texts = batch.column("text").cast(pa.large_binary())
            for i in range(batch.num_rows):
                text, runs = texts[i].as_py(), batch.column("runs")[i].as_py() or []
                n, spans, removed, last, kept = len(text), 0, 0, -1, []
                # a segment cut short by its text's ends is repeated only if a window fits in it
                runs = sorted((max(0, r["at"] - REACH + r["first"]), min(n, r["at"] - REACH + r["last"])) for r in runs)
                at = 0
                for a, b in runs:
                    if b - a < LENGTH:
                        continue
                    if a > last:
                        spans += 1
                        kept.append(text[at:a])
                        last = at = max(at, b)
                        removed += b - a
                    elif b > last:
                        removed += b - last
                        last = at = b
                kept.append(text[at:])
                rest = b"".join(kept)
                out.append((n, removed, spans, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore") if with_text else None))
            columns = list(zip(*out)) if out else [[]] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
            arrays = [batch.column("row"), *[pa.array(c, t) for c, t in zip(columns, types)]]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", *names])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Each row of ``docs`` as ``row`` (of its columns but the text), with what is left of its text.

    Texts are UTF-8 bytes, null counts as empty. A byte goes if a string of ``LENGTH`` bytes around it
    also starts anywhere else, in the same document too, overlapping or not; all are judged on the
    input. ``kept_text`` leaves out signs that a cut has broken. Rows that repeat are documents of their
    own, so their texts go if long enough. An empty table gives no rows.
    """
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("key"),
        text_of(text_col).alias("text"),
    )
    place = ["key", "check", "size"]  # of a document: its id, and two values that tell texts under one id apart
    keyed = keyed.select("row", "key", F.xxhash64("text").alias("check"), F.octet_length("text").alias("size"), "text")
    runs = covered_segments(keyed.select(*place, "text")).groupBy(*place).agg(F.collect_set(F.struct("at", "first", "last")).alias("runs"))
    schema = keyed.select("row").schema["row"].dataType.simpleString()
    joined = keyed.join(runs, place, "left").select("row", "text", "runs")
    return joined.mapInArrow(_cut(with_text), f"row {schema}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")


def suffix_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    out = remove_repeats(docs.select(id_col, text_col), id_col, text_col, with_text=False)
    return out.select(F.col(f"row.{id_col}").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def strip_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the remaining texts; ``n_chars`` is counted anew. Every document stays."""
    out = remove_repeats(docs)
    fields = [F.col("kept_text").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    out = out.select(*fields)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.length("text").cast(kind))
    return out
