"""Spelling variants: words one edit apart, found by range searches in k-d trees over letter counts.

One inserted or deleted letter changes the counts of letters by one in all, a replaced one by two. Words of
one length are cut into the boxes of a k-d tree; a word goes to the boxes of its own length and of the next
shorter one that lie within that reach, and there a tree over the box's words is searched likewise. Only
what is left is compared letter by letter.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbral.llm.common import materialise, part_count, release, text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A letter is deleted from runs whose hash this divides.
TYPO_EVERY = 97
LETTERS, SHORTEST, SELDOM = "a-zÀ-ÿ", 5, 3
#: Counts of a word: one for each of a-z, and the other letters dealt over the rest.
DIMS = 32
#: Words that a box is meant to hold, words and bytes that one task holds of a box at most, and words that
#: the boxes are made from.
BOX, BLOCK, BLOCK_BYTES, SAMPLE = 8192, 16_384, 8 << 20, 1 << 18
#: Words in a leaf of the tree that is searched within a box; words of the sample for a box at least.
LEAF, SAMPLE_BOX = 128, 8
#: Letters' steps that are multiplied; words with more of them are compared count by count.
STEPS = 512
#: Cells of a comparison in memory at once.
CELLS = 1 << 22

ROUTED = "cell int, kind int, word string, n long"
LINK = "word string, near string, near_n long"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = TYPO_EVERY, least: int = SELDOM) -> DataFrame:
    """``word, n``: maximal runs of letters of all texts, with a letter deleted where the hash of id and run says so.

    Only A-Z are lower-cased. Words below five letters or ``least`` occurrences are left out. A null text
    has none; a null id counts as empty. A word's occurrences are added up before they are shuffled.
    """
    runs = F.regexp_extract_all(F.translate(text_of(text_col), UPPER, LOWER), F.lit(f"[{LETTERS}]{{{SHORTEST},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    rows = rows.select("run", h.alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = rows.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= SHORTEST).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def letters_of(words: list[str]):
    """Letters of words of one length, a byte each."""
    import numpy as np

    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def counts_of(letters):
    """How often each letter is in each word."""
    import numpy as np

    of = np.arange(256)
    of = np.where(of < 128, of - ord("a"), 26 + of % (DIMS - 26))
    out = np.zeros((len(letters), DIMS), np.int32)
    step = max(1, CELLS // letters.shape[1])
    for start in range(0, len(letters), step):
        part = letters[start : start + step]
        cells = of[part] + DIMS * np.arange(len(part))[:, None]
        out[start : start + step] = np.bincount(cells.ravel(), minlength=DIMS * len(part)).reshape(-1, DIMS)
    return out


class KdTree:
    """Boxes of counts: each node is cut in two at the median of the letter whose counts differ most."""

    def __init__(self, points, leaf_rows: int):
        import numpy as np

        self.nodes: list[tuple | None] = []
        self.leaves: list[np.ndarray] = []
        self._grow(points, np.arange(len(points)), leaf_rows)

    def _grow(self, points, rows, leaf_rows: int) -> int:
        import numpy as np

        node = len(self.nodes)
        self.nodes.append(None)
        own = points[rows]
        spread = own.var(axis=0) if len(rows) > leaf_rows else np.zeros(1)
        if spread.max() == 0:  # small enough, or all the same
            self.nodes[node] = (len(self.leaves),)
            self.leaves.append(rows)
            return node
        letter = int(spread.argmax())
        x = own[:, letter]
        most = min(int(np.median(x)), int(x.max()) - 1)
        low = x <= most
        self.nodes[node] = (letter, most, self._grow(points, rows[low], leaf_rows), self._grow(points, rows[~low], leaf_rows))
        return node

    def leaf_of(self, points):
        """Number of the leaf whose box each point is in."""
        import numpy as np

        out = np.zeros(len(points), np.int32)
        for leaf, rows in self.within(points, 0):
            out[rows] = leaf
        return out

    def within(self, points, reach: int):
        """Each leaf, with the rows of the points whose counts are at most ``reach`` away from its box."""
        import numpy as np

        ways = [(0, np.arange(len(points)), np.zeros((len(points), DIMS), np.int16), np.zeros(len(points), np.int32))]
        while ways:
            node, rows, outside, total = ways.pop()
            if len(self.nodes[node]) == 1:
                yield self.nodes[node][0], rows
                continue
            letter, most, low, high = self.nodes[node]
            x, before = points[rows, letter], outside[:, letter]
            for child, beyond in ((low, x - most), (high, most + 1 - x)):
                now = np.maximum(before, beyond)
                far = total + now - before
                near = far <= reach
                if near.any():
                    farther = outside[near]
                    farther[:, letter] = now[near]
                    ways.append((child, rows[near], farther, far[near]))


class Steps:
    """Counts as steps: a one for each letter and each number up to its count. The product of two words' steps
    is the number of letters that they share."""

    def __init__(self, points):
        import numpy as np

        most = points.max(axis=0)
        self.letter = np.repeat(np.arange(DIMS), most)
        self.step = np.concatenate([np.arange(1, m + 1) for m in most.tolist()])
        self.narrow = len(self.step) <= STEPS

    def of(self, counts):
        import numpy as np

        return (counts[:, self.letter] >= self.step).astype(np.float32) if self.narrow else counts

    def shared(self, a, b):
        """Letters that each of ``a`` shares with each of ``b``."""
        import numpy as np

        return a @ b.T if self.narrow else np.minimum(a[:, None, :], b[None, :, :]).sum(axis=2)


def near_pairs(tree: KdTree, steps: Steps, point_steps, letters, own_points, own_letters):
    """Rows (query, point) one edit apart; all points have one length, queries the same or one letter more."""
    import numpy as np

    length = letters.shape[1]
    longer = own_letters.shape[1] - length
    own_steps = steps.of(own_points)
    for leaf, rows in tree.within(own_points, 1 if longer else 2):
        members = tree.leaves[leaf]
        step = max(1, CELLS // (len(members) * (1 if steps.narrow else DIMS)))
        for start in range(0, len(rows), step):
            part = rows[start : start + step]
            q, p = np.nonzero(steps.shared(own_steps[part], point_steps[members]) >= (length if longer else length - 1))
            q, p = part[q], members[p]
            width = max(1, CELLS // length)
            for at in range(0, len(q), width):
                a, b = own_letters[q[at : at + width]], letters[p[at : at + width]]
                near = one_more(a, b) if longer else (a != b).sum(axis=1) == 1
                yield q[at : at + width][near], p[at : at + width][near]


def one_more(a, b):
    """Whether the longer row is the shorter one with a letter put in."""
    import numpy as np

    same = a[:, :-1] == b
    first = np.where(same.all(axis=1), b.shape[1], same.argmin(axis=1))
    return ((a[:, 1:] == b) | (np.arange(b.shape[1])[None, :] < first[:, None])).all(axis=1)


def _by_length(words: list[str]) -> dict[int, list[int]]:
    rows: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        rows.setdefault(len(word), []).append(i)
    return rows


def _sample(batches: Iterator) -> Iterator:
    """Length and counts, up to 255 each, of words."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        words = batch.column("word").to_pylist()
        for length, rows in _by_length(words).items():
            counts = np.minimum(counts_of(letters_of([words[i] for i in rows])), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([length] * len(rows), pa.int32()), pa.array([c.tobytes() for c in counts])], names=["length", "counts"])


def _boxes_of(trees: dict[int, KdTree]):
    """Number of words in each box of each length."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            words = batch.column("word").to_pylist()
            for length, rows in _by_length(words).items():
                boxes = np.zeros(len(rows), np.int32)
                if length in trees:
                    boxes = trees[length].leaf_of(counts_of(letters_of([words[i] for i in rows])))
                boxes, n = np.unique(boxes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([length] * len(boxes), pa.int32()), pa.array(boxes), pa.array(n, pa.int64())], names=["length", "box", "n"])

    return run


def _route(trees: dict[int, KdTree], cells: dict[int, list[tuple[int, int]]]):
    """Each word to a block of its own box, and as a query to all blocks of the boxes that it reaches.

    ``kind`` 0: a word of the cell; 1: a query from the same box; 2: from an earlier box of that length, so
    that two boxes meet once; 3: with one letter more. ``cells``: first cell and number of each box's blocks.
    """

    def run(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        def reached(length, points, reach):
            if length in trees:
                yield from trees[length].within(points, reach)
            elif length in cells:
                yield 0, np.arange(len(points))

        for batch in batches:
            words, counts = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            for length, rows in _by_length(words).items():
                own = [words[i] for i in rows]
                points = counts_of(letters_of(own))
                box = trees[length].leaf_of(points) if length in trees else np.zeros(len(own), np.int32)
                first, blocks = (np.array(x) for x in zip(*cells[length]))
                salt = np.array([zlib.crc32(w.encode()) for w in own], np.int64)
                routed = [(first[box] + salt % blocks[box], np.zeros(len(own), np.int64), np.arange(len(own)))]
                for to, reach in ((length, 2), (length - 1, 1)):
                    for leaf, found in reached(to, points, reach):
                        if to == length:
                            found = found[box[found] <= leaf]
                        start, n = cells[to][leaf]
                        kind = np.where(box[found] == leaf, 1, 2) if to == length else np.full(len(found), 3)
                        routed += [(np.full(len(found), start + b), kind, found) for b in range(n)]
                cell, kind, at = (np.concatenate(x) for x in zip(*routed))
                at = np.array(rows)[at]
                for start in range(0, len(at), 50_000):
                    part = slice(start, start + 50_000)
                    taken = pa.array(at[part])
                    columns = [pa.array(cell[part], pa.int32()), pa.array(kind[part], pa.int32()), batch.column("word").take(taken), pa.array(counts[at[part]])]
                    yield pa.RecordBatch.from_arrays(columns, names=["cell", "kind", "word", "n"])

    return run


def _search(batches: Iterator) -> Iterator:
    """Links of each cell's words with its queries, both ways. Rows come by cell, its own words first."""
    import numpy as np
    import pyarrow as pa

    cell, words, counts, tree = None, [], [], None
    steps = point_steps = letters = None
    for batch in batches:
        cells, kinds = batch.column("cell").to_numpy(), batch.column("kind").to_numpy()
        texts, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
        cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(kinds) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if a == b:
                continue
            if cells[a] != cell:
                cell, words, counts, tree = cells[a], [], [], None
            if kinds[a] == 0:
                words += texts[a:b]
                counts += n[a:b].tolist()
                continue
            if not words:
                continue
            if tree is None:
                letters = letters_of(words)
                points = counts_of(letters)
                tree, steps = KdTree(points, LEAF), Steps(points)
                point_steps = steps.of(points)
            step = max(1, BLOCK_BYTES // len(texts[a]))
            for start in range(a, b, step):
                own = texts[start : min(start + step, b)]
                own_letters = letters_of(own)
                for q, p in near_pairs(tree, steps, point_steps, letters, counts_of(own_letters), own_letters):
                    pairs = [(own[i], words[j], int(n[start + i]), counts[j]) for i, j in zip(q.tolist(), p.tolist())]
                    if kinds[a] == 1:  # both words are queries here
                        pairs = [x for x in pairs if x[0] > x[1]]
                    if pairs:
                        left, right, left_n, right_n = zip(*pairs)
                        yield pa.RecordBatch.from_arrays([pa.array(left + right), pa.array(right + left), pa.array(right_n + left_n, pa.int64())], names=["word", "near", "near_n"])


def near_words(words: DataFrame) -> DataFrame:
    """``word, near, near_n``: all words of ``word, n`` that are one edit apart, both ways.

    The driver holds the tree of boxes, made from at most ``SAMPLE`` words' counts, and the number of words
    in each box; all words are put in boxes. A box of more than ``BLOCK`` words, or ``BLOCK_BYTES`` letters,
    is cut into blocks, and what reaches the box goes to each of them.
    """
    import numpy as np

    spark = words.sparkSession
    per_length = dict(words.groupBy(F.length("word").alias("length")).agg(F.count(F.lit(1))).collect())  # a number for each length
    picked = words.orderBy(F.xxhash64("word"), "word").limit(SAMPLE) if sum(per_length.values()) > SAMPLE else words
    sample = picked.select("word").mapInArrow(_sample, "length int, counts binary").toArrow()
    lengths = sample.column("length").to_numpy()
    counts = np.frombuffer(b"".join(sample.column("counts").to_pylist()), np.uint8).reshape(-1, DIMS).astype(np.int32)
    trees = {}
    for length, n in per_length.items():
        own = counts[lengths == length]
        boxes = min(-(-n // BOX), len(own) // SAMPLE_BOX)
        if boxes > 1:
            trees[length] = KdTree(own, -(-len(own) // boxes))
    found = words.select("word").mapInArrow(_boxes_of(trees), "length int, box int, n long").groupBy("length", "box").agg(F.sum("n").alias("n"))
    sizes = {(r["length"], r["box"]): r["n"] for r in found.collect()}  # a number for each box
    cells: dict[int, list[tuple[int, int]]] = {}
    cell = 0
    for length in per_length:
        block = max(1, min(BLOCK, BLOCK_BYTES // length))
        for box in range(len(trees[length].leaves) if length in trees else 1):
            blocks = max(1, -(-sizes.get((length, box), 0) // block))
            cells.setdefault(length, []).append((cell, blocks))
            cell += blocks
    routed = words.mapInArrow(_route(trees, cells), ROUTED)
    met = routed.repartition(part_count(spark), "cell").sortWithinPartitions("cell", "kind")
    return met.mapInArrow(_search, LINK)


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for rows ``word, form``: where the forms lead to. Ways are doubled until none changes.

    A form is at least twice as frequent as its word, so no way comes back to where it was, and a way is
    no longer than the binary logarithm of the largest count.
    """
    ways = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        farther = materialise(ways.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        release(ways)
        ways = farther
        if ways.where("moved").isEmpty():
            return ways.select("word", "root")


def spelling_forms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words of all texts with the more frequent word that each is most likely a variant of.

    ``form``: of the words one edit apart the most frequent one (ties: smallest in code-point order), if it
    is at least twice as frequent; ``root``: where forms lead to, the word itself without a form; ``n_near``:
    number of words one edit apart. Null and empty texts have no words, and a table without words gives no
    rows; repeated rows count again; other columns are ignored, whatever their names.
    """
    words = materialise(word_counts(docs, id_col, text_col))
    links = materialise(near_words(words))
    best = links.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("least"), "near")).alias("best"))
    joined = words.join(best, "word", "left").withColumn("near_n", -F.col("best.least"))
    is_form = F.col("near_n") >= 2 * F.col("n")
    named = materialise(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n"),
    ))
    ends = roots(named.where(F.col("form").isNotNull()))
    out = named.join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
