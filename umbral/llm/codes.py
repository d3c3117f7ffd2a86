"""Vector codes: parts of vectors are coded by their nearest codebook entry, entries are refined in rounds,
and bounds that carry the round they are from spare most distances.

A bound on the distance to an entry, taken in round s, still holds in round t after the entry's net way
from s to t is taken off: the length of the sum of its moves, which is at most the sum of their lengths.
So the codebooks of all rounds are kept, and every bound has a stamp.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from umbral.llm.common import materialise, release

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024.0
#: Entries that share one lower bound.
GROUP = 32
#: Components beyond this size count as this size, so that errors fit a long.
LARGEST = 1 << 24
#: Whole numbers up to here are exact in a double.
EXACT = float(1 << 53)
#: What rounding may take from a bound.
SLACK = 1e-9

#: Columns of a vector's row, all binary: its parts' entries now and a round before, the squared distance to the entry with
#: its stamp, and a lower bound on the distance to the other entries of each group with its stamp.
STATE = ("code", "was", "near", "near_at", "far", "far_at")


def part_ends(dim: int, parts: int) -> list[int]:
    """Ends of the consecutive parts of a vector; where they cannot be equal the first ones are longer."""
    return [sum(divmod(dim, parts)[0] + (i < dim % parts) for i in range(p + 1)) for p in range(parts)]


def squared_distances(points, entries):
    """All squared distances, exact: in doubles where these hold all sums, else in whole numbers."""
    import numpy as np

    most = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4.0 * most * most * max(points.shape[1], 1) < EXACT:
        p, e = points.astype(np.float64), entries.astype(np.float64)
        found = (p * p).sum(axis=1)[:, None] - 2.0 * (p @ e.T) + (e * e).sum(axis=1)[None, :]
        return found.astype(np.int64)
    return np.stack([((points - e) ** 2).sum(axis=1) for e in entries], axis=1)


def own_distances(points, entries):
    """Squared distance of each point to the entry in the same row."""
    d = points - entries
    return (d * d).sum(axis=1)


def displacement(history: list) -> list:
    """``[s]``: how far each entry of the last codebook lies from where it was in round s."""
    import numpy as np

    return [np.sqrt(own_distances(history[-1], book).astype(np.float64)) for book in history]


def assign(points, history: list, state: tuple | None) -> tuple:
    """Nearest entry of the last codebook for each point, ties to the lower index; bounds; distances computed.

    ``state``: entry, squared distance and stamp, lower bounds and stamps per group, as of the rounds before.
    """
    import numpy as np

    now, book, n = len(history) - 1, history[-1], len(points)
    groups = [slice(g, min(g + GROUP, len(book))) for g in range(0, len(book), GROUP)]
    if state is None:
        found = squared_distances(points, book)
        code = found.argmin(axis=1)
        near = found[np.arange(n), code]
        others = np.sqrt(found.astype(np.float64))
        others[np.arange(n), code] = np.inf
        far = np.stack([others[:, g].min(axis=1) for g in groups], axis=1) if n else np.zeros((0, len(groups)))
        stamps = np.full((n, len(groups)), now, np.uint8)
        return code, near, np.full(n, now, np.uint8), _below(far), stamps, n * len(book)
    code, near, near_at, far, far_at = (x.copy() for x in state)
    moved = displacement(history)
    moves = np.stack(moved)
    group_moves = np.stack([moves[:, g].max(axis=1) for g in groups], axis=1)  # [stamp, group]
    lower = far.astype(np.float64) - group_moves[far_at, np.arange(len(groups))[None, :]] * (1 + SLACK)
    upper = np.sqrt(near.astype(np.float64)) + moves[near_at, code]
    open_ = lower <= upper[:, None] * (1 + SLACK)
    rows = np.flatnonzero(open_.any(axis=1))
    counted = len(rows)
    near[rows], near_at[rows] = own_distances(points[rows], book[code[rows]]), now  # the distance itself
    upper[rows] = np.sqrt(near[rows].astype(np.float64))
    open_[rows] = lower[rows] <= upper[rows, None] * (1 + SLACK)
    best, best_code = near.copy(), code.copy()
    scans = []
    for g, entries in enumerate(groups):
        at = np.flatnonzero(open_[:, g])
        if not len(at):
            continue
        found = squared_distances(points[at], book[entries])
        counted += found.size
        index = entries.start + found.argmin(axis=1)
        least = found[np.arange(len(at)), index - entries.start]
        closer = (least < best[at]) | ((least == best[at]) & (index < best_code[at]))
        best[at[closer]], best_code[at[closer]] = least[closer], index[closer]
        scans.append((g, entries, at, found))
    left = np.flatnonzero(best_code != code)
    if len(left):  # the entry that a point leaves counts among the others of its group
        g = code[left] // GROUP
        far[left, g] = _below(np.minimum(lower[left, g], np.sqrt(near[left].astype(np.float64))))
        far_at[left, g] = now
    for g, entries, at, found in scans:
        others = np.sqrt(found.astype(np.float64))
        own = best_code[at] - entries.start
        inside = np.flatnonzero((own >= 0) & (own < found.shape[1]))
        others[inside, own[inside]] = np.inf
        far[at, g], far_at[at, g] = _below(others.min(axis=1)), now
    near_at[left] = now
    return best_code, best, near_at, far, far_at, counted


def _below(x):
    """The next smaller single-precision numbers."""
    import numpy as np

    return np.nextafter(x.astype(np.float32), np.float32(-np.inf), dtype=np.float32)


def _rows_by_length(batch):
    """Row numbers and int64 matrix of the vectors of each length."""
    import numpy as np

    data = batch.column("v").to_pylist()
    lengths = np.array([len(v) // 4 for v in data], np.int64)
    for dim in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == dim)
        yield dim, at, np.frombuffer(b"".join(data[i] for i in at.tolist()), "<i4").reshape(len(at), dim).astype(np.int64)


def _columns(batch, names, at, width, kinds):
    import numpy as np

    for name, kind in zip(names, kinds):
        values = batch.column(name).to_pylist()
        yield np.frombuffer(b"".join(values[i] for i in at.tolist()), kind).reshape(len(at), *width(name))


def _encode(histories: dict[int, list], parts: int, first: bool, last: bool):
    """One round of assignment; columns beside those of STATE stay as they are. The last round gives all distances."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out: dict[str, list] = {name: [b""] * batch.num_rows for name in STATE}
            for dim, at, vectors in _rows_by_length(batch):
                history = histories[dim]
                groups = -(-len(history[0][0]) // GROUP)
                shape = {"code": (parts,), "near": (parts,), "near_at": (parts,), "far": (parts, groups), "far_at": (parts, groups)}
                old = None
                if not first:
                    kinds = ("u1", "<i8", "u1", "<f4", "u1")
                    old = list(_columns(batch, shape, at, shape.__getitem__, kinds))
                made, start = [], 0
                for p, end in enumerate(part_ends(dim, parts)):
                    state = None if old is None else (old[0][:, p].astype(np.int64), *(x[:, p] for x in old[1:]))
                    code, near, *bounds = assign(vectors[:, start:end], [book[p] for book in history], state)[:5]
                    if last:
                        near = own_distances(vectors[:, start:end], history[-1][p][code])
                    made.append((code, near, *bounds))
                    start = end
                new = dict(zip(shape, (np.stack(x, axis=1) for x in zip(*made))))
                new = {k: np.ascontiguousarray(v, {"code": "u1", "near": "<i8", "near_at": "u1", "far": "<f4", "far_at": "u1"}[k]) for k, v in new.items()}
                new["was"] = new["code"] if old is None else old[0]
                for name in STATE:
                    for i, row in zip(at.tolist(), new[name]):
                        out[name][i] = row.tobytes()
            columns = [pa.array(out[n], pa.binary()) if n in out else batch.column(n) for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return run


SUMS = "dim int, part int, entry int, at int, total long"


def _changes(parts: int, entries: int, first: bool):
    """What the sums and counts of entries change by: all parts in the first round, later those that moved.

    ``at`` is the component, or -1 for the count. A task gives a row for each entry and component at most.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for dim, at, vectors in _rows_by_length(batch):
                code, was = _columns(batch, ("code", "was"), at, lambda _: (parts,), ("u1", "u1"))
                start = 0
                for p, end in enumerate(part_ends(dim, parts)):
                    total = sums.setdefault((dim, p), np.zeros((entries, end - start + 1), np.int64))
                    rows = np.arange(len(at)) if first else np.flatnonzero(code[:, p] != was[:, p])
                    counted = np.concatenate([vectors[rows, start:end], np.ones((len(rows), 1), np.int64)], axis=1)
                    np.add.at(total, code[rows, p], counted)
                    if not first:
                        np.subtract.at(total, was[rows, p], counted)
                    start = end
        for (dim, p), total in sums.items():
            entry, at = np.nonzero(total)
            values = total[entry, at]
            at = np.where(at == total.shape[1] - 1, -1, at)
            columns = [np.full(len(at), dim), np.full(len(at), p), entry, at]
            yield pa.RecordBatch.from_arrays([*[pa.array(c.astype(np.int32)) for c in columns], pa.array(values)], names=[f.split()[0] for f in SUMS.split(", ")])

    return run


def _first_books(vectors: DataFrame, parts: int, entries: int) -> dict[int, list]:
    """For each length of vectors, the parts of the vectors with the smallest ids."""
    import numpy as np

    order = [F.asc_nulls_last("vec_id"), F.col("v")]
    ranked = vectors.select("vec_id", "v", F.octet_length("v").alias("bytes"))
    ranked = ranked.withColumn("nth", F.row_number().over(Window.partitionBy("bytes").orderBy(*order))).where(F.col("nth") <= entries)
    rows: dict[int, list] = {}
    for r in sorted(ranked.select("bytes", "nth", "v").collect(), key=lambda r: r["nth"]):  # entries rows for each length
        rows.setdefault(r["bytes"] // 4, []).append(np.frombuffer(bytes(r["v"]), "<i4").astype(np.int64))
    books = {}
    for dim, found in rows.items():
        ends = part_ends(dim, parts)
        books[dim] = [np.stack(found)[:, a:b] for a, b in zip([0, *ends], ends)]
    return books


def book_digest(book: list) -> str:
    """sha256 of all entries' components as decimal numbers, by part, entry and place, with commas between."""
    numbers = (x for part in book for entry in part.tolist() for x in entry)
    return hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()


def vector_codes(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE,
) -> tuple[DataFrame, dict[int, list]]:
    """Codes of all vectors, and the codebook of each length of vectors: a list of parts, an array of entries each.

    Components count as floor(scale * x). The codebook starts from the vectors with the smallest ids (of
    equal ids, the smaller vector; rows without id last), fewer than ``entries`` where there are fewer. A
    round assigns each part to its nearest entry, ties to the lower index, and puts each entry in the floor
    of its parts' mean; entries without parts stay. After the rounds parts are assigned once more. Rows
    whose vector is null or has a null or non-finite component are left out; repeated rows count each.
    Vectors of different lengths have codebooks of their own; an empty table gives no rows.

    Each round reads the table of the round before and writes the next one, vectors included, and the former
    is deleted, so nothing is shuffled but the changes of the entries' sums. The driver holds the codebooks of all rounds: ``entries``
    vectors for each length and round.
    """
    import numpy as np

    if entries > 256:
        raise ValueError("an entry's index must fit a byte")
    x = F.col(vector_col)
    finite = F.forall(x, lambda e: F.coalesce(~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < F.lit(float("inf"))), F.lit(False)))
    size = F.lit(float(LARGEST))
    ints = F.transform(x, lambda e: F.floor(F.greatest(F.least(e.cast("double") * F.lit(scale), size), -size)).cast("int"))
    rows = vectors.where(x.isNotNull() & finite).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), ints.alias("v"))
    base = materialise(rows.mapInArrow(_packed, T.StructType([rows.schema["vec_id"], rows.schema["label"], T.StructField("v", T.BinaryType())])))
    books = _first_books(base, parts, entries)
    histories = {dim: [book] for dim, book in books.items()}
    totals: dict = {}
    state = base.select("vec_id", "label", "v", *[F.lit(None).cast("binary").alias(name) for name in STATE])
    held = base
    for turn in range(rounds + 1):
        state = materialise(state.mapInArrow(_encode(histories, parts, turn == 0, turn == rounds), state.schema))
        release(held)
        held = state
        if turn == rounds:
            break
        changes = state.select("v", "code", "was").mapInArrow(_changes(parts, entries, turn == 0), SUMS)
        for r in changes.groupBy("dim", "part", "entry", "at").agg(F.sum("total").alias("total")).collect():  # numbers of a codebook
            key = (r["dim"], r["part"])
            total = totals.setdefault(key, np.zeros((entries, books[r["dim"]][r["part"]].shape[1] + 1), np.int64))
            total[r["entry"], r["at"]] += r["total"]
        for dim, history in histories.items():
            book = [part.copy() for part in history[-1]]
            for p, part in enumerate(book):
                total = totals[dim, p][: len(part)]
                used = total[:, -1] > 0
                part[used] = total[used, :-1] // total[used, -1:]
            history.append(book)
    return state, {dim: history[-1] for dim, history in histories.items()}


def _packed(batches: Iterator) -> Iterator:
    """Vectors of ints as binary."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        lists = batch.column("v")
        flat, ends = lists.flatten().to_numpy().astype("<i4").tobytes(), np.append(0, np.cumsum(lists.value_lengths().to_numpy())).tolist()
        packed = pa.array([flat[4 * a : 4 * b] for a, b in zip(ends, ends[1:])], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), packed], names=["vec_id", "label", "v"])


def _digest(books: dict[int, str]):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            code = [c.hex() for c in batch.column("code").to_pylist()]
            error = [int(np.frombuffer(x, "<i8").sum()) for x in batch.column("near").to_pylist()]
            digest = [books[len(v) // 4] for v in batch.column("v").to_pylist()]
            columns = [batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error", "codebooks_sha256"])

    return run


def code_digest(vectors: DataFrame, **args) -> DataFrame:
    """Code and error of every vector, its label's total error, and the digest of the codebooks; see :func:`vector_codes`."""
    state, books = vector_codes(vectors, **args)
    fields = [state.schema["vec_id"], state.schema["label"], *T.StructType.fromDDL("code string, error long, codebooks_sha256 string")]
    coded = state.select("vec_id", "label", "v", "code", "near").mapInArrow(_digest({d: book_digest(b) for d, b in books.items()}), T.StructType(fields))
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    joined = coded.join(totals, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", "codebooks_sha256")
