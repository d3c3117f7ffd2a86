"""Best-fit packing: gaps are filled exactly by one, two or three lengths looked up by their sum, the rest by best fit."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from umbral.llm.common import materialise, text_of
from umbral.llm.packing import PIECE, _pieces, _place, slot_table

LENGTH = 4096
#: For a length, bins are tried with as many copies of it as fit, and with up to so many fewer.
FEWER = 3


class SumIndex:
    """Which sums one, two or three of the lengths at hand have.

    ``one``, ``two`` and ``three`` hold, under each sum up to ``capacity``, in how many ordered ways that
    many of the lengths add up to it. A length that runs out is taken out of all three.
    """

    def __init__(self, lengths, capacity: int):
        import numpy as np

        self.one = np.zeros(capacity + 1, np.int64)
        self.one[list(lengths)] = 1
        self.two, self.three = self._sums(self.one), None
        self.three = self._sums(self.two)

    def _sums(self, ways):
        import numpy as np

        out = np.zeros_like(ways)
        for length in np.flatnonzero(self.one):
            out[length:] += ways[: len(ways) - length]
        return out

    def remove(self, x: int) -> None:
        n = len(self.one)
        for ways, parts in ((self.three, ((3, self.two, x), (-3, self.one, 2 * x))), (self.two, ((2, self.one, x),))):
            for times, fewer, by in parts:
                if by < n:
                    ways[by:] -= times * fewer[: n - by]
        if 2 * x < n:
            self.two[2 * x] += 1
        if 3 * x < n:
            self.three[3 * x] -= 1
        self.one[x] = 0

    def fill(self, gap: int, left) -> tuple[int, ...] | None:
        """One, two or three lengths with the sum ``gap``, the longest as long as can be; ``left``: copies at hand."""
        if gap < len(self.one) and self.one[gap]:
            return (gap,)
        return self._pair(gap, gap, left) or self._triple(gap, left)

    def _pair(self, gap: int, longest: int, left, beside: int = 0) -> tuple[int, ...] | None:
        import numpy as np

        if not self.two[gap]:
            return None
        low = -(-gap // 2)
        longer = np.arange(min(longest, gap - 1), low - 1, -1)
        for a in longer[(self.one[longer] & self.one[gap - longer]) > 0].tolist():
            need = Counter((a, gap - a, *([beside] if beside else [])))
            if all(left[x] >= k for x, k in need.items()):
                return (a, gap - a)
        return None

    def _triple(self, gap: int, left) -> tuple[int, ...] | None:
        import numpy as np

        if not self.three[gap]:
            return None
        longest = np.arange(gap - 2, -(-gap // 3) - 1, -1)
        for a in longest[(self.one[longest] > 0) & (self.two[gap - longest] > 0)].tolist():
            pair = self._pair(gap - a, a, left, a)
            if pair:
                return (a, *pair)
        return None


def patterns_of(histogram: dict[int, int], capacity: int, exact: bool = True) -> list[tuple[int, tuple[int, ...]]]:
    """Packing patterns with their counts, for so many pieces of each length.

    Lengths go longest first, each into the fullest open sequence with room, or else a new one. If some
    copies of it leave a gap there that one, two or three shorter lengths close exactly, these are used up
    with it, as often as all are at hand; the sequence is then full. The residue goes by best fit alone:
    as many copies as fit, and the sequence stays open. A step uses up a length, a group of equal open
    sequences, or the copies a pattern needs, so there are a few patterns for each length.
    """
    import numpy as np

    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    index = SumIndex(np.flatnonzero(left).tolist(), capacity) if exact else None
    open_: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in range(capacity + 1)]
    for length in range(capacity, 0, -1):
        if not left[length]:
            continue
        if exact:
            index.remove(length)  # what closes its gaps is shorter
        space = length
        while left[length]:
            while space < capacity and not open_[space]:
                space += 1
            n = int(left[length])
            count, pattern = open_[space].pop() if open_[space] else (n, ())
            most = min(space // length, n)
            filled = None
            for copies in range(most, max(most - 1 - FEWER, 0), -1):
                gap = space - copies * length
                filled = () if gap == 0 else index.fill(gap, left) if exact else None
                if filled is not None:
                    break
            if filled is not None:
                need = Counter(filled)
                used = min([count, n // copies, *(int(left[x]) // k for x, k in need.items())])
                gap = 0
                for x, k in need.items():
                    left[x] -= used * k
                    if not left[x]:
                        index.remove(x)
            else:
                filled, copies = (), min(space // length, -(-n // count)) if pattern else most
                used, gap = min(count, n // copies), space - copies * length
            if used < count and pattern:
                open_[space].append((count - used, pattern))
            open_[gap].append((used, (*pattern, *(length,) * copies, *filled)))
            left[length] -= used * copies
            space = length
    return [p for packs in open_ for p in packs]


def best_fit_pack(docs: DataFrame, tokenizer: str, capacity: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their sequence and offset, in as few sequences as exact and best fits give.

    A document's ids and an end id are one piece, unless they are more than ``capacity``: then they are cut
    into pieces of that length, the last of which may be shorter. A null text is its end id alone; repeated
    rows, and rows without an id, are documents of their own; an empty table gives no rows; other columns
    are ignored, whatever their names. The driver holds a number for each length and the patterns made
    from them. A piece's rank among those of its length tells its place in the patterns.
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
    slots = slot_table(patterns_of(histogram, capacity))
    placed = ranked.mapInArrow(
        _place(slots), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
    piece = F.floor(F.col("start") / capacity).cast("int").alias("piece")
    return placed.select("doc_id", piece, "start", "length", "ids_crc32", "sequence_id", "offset")
