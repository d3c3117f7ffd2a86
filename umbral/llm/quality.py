"""Quality classifier: random-indexing word vectors, pooled per document, under a small network."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbral.llm.common import text_of
from umbral.llm.tokens import slices

#: Words share so many cells by hash, shapes of words so many others; a cell has a vector of ``SIZE``.
WORDS, SHAPES, SIZE = 1 << 14, 1 << 11, 64
#: Non-zero components of an index vector, and neighbours on either side that count as context.
NONZERO, WINDOW = 4, 2
#: Labelled documents the network is fitted on at most, picked by a hash of their id.
FIT_ROWS = 20_000
HIDDEN, EPOCHS, RATE, SEED = 32, 60, 3e-3, 7
#: Frequent words weigh less in the pooled mean: a / (a + share of the word).
WEIGHT = 1e-3
CACHE = 300_000


def shape(word: str) -> str:
    """Runs of capitals, small letters and digits as one sign each; runs of another sign as two at most."""
    kinds = ("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    out = []
    for kind, run in groupby(kinds):
        out.append(kind if kind in "Aa0" else kind * min(2, len(list(run))))
    return "".join(out[:12])


class Cells(dict):
    """Cell of a word and of its shape, as one number; looked up once for each distinct word."""

    def __missing__(self, word: str) -> int:
        import zlib

        if len(self) > CACHE:
            self.clear()
        found = (zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORDS) << 32 | (WORDS + zlib.crc32(shape(word).encode("utf-8", "surrogatepass")) % SHAPES)
        self[word] = found
        return found


def _stream(texts: list[str], cells: Cells):
    """Words and their shapes in turn as cells, and the number of cells before each text."""
    import numpy as np

    parts = [np.fromiter(map(cells.__getitem__, text.split()), np.int64) for text in texts]
    at = np.concatenate([[0], np.cumsum([2 * len(p) for p in parts])])
    both = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    flat = np.empty(2 * len(both), np.int64)
    flat[0::2], flat[1::2] = both >> 32, both & 0xFFFFFFFF
    return flat, at


def _index_vectors():
    """Places and signs of the non-zero components of each cell's index vector."""
    import numpy as np

    rng = np.random.default_rng(SEED)
    return rng.integers(0, SIZE, (WORDS + SHAPES, NONZERO)), rng.choice([-1.0, 1.0], (WORDS + SHAPES, NONZERO))


def _contexts(batches: Iterator) -> Iterator:
    """Sums of the neighbours' index vectors for each cell over a whole partition."""
    import numpy as np
    import pyarrow as pa

    places, signs = _index_vectors()
    sums, counts, cells = np.zeros((WORDS + SHAPES) * SIZE), np.zeros(WORDS + SHAPES, np.int64), Cells()
    for whole in batches:
        for batch in slices(whole, size=4 << 20):
            flat, at = _stream(batch.column("text").to_pylist(), cells)
            counts += np.bincount(flat, minlength=len(counts))
            doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
            for step in range(1, WINDOW + 1):
                same = doc[step:] == doc[:-step]
                left, right = flat[:-step][same], flat[step:][same]
                for one, other in ((left, right), (right, left)):
                    for k in range(NONZERO):
                        sums += np.bincount(one * SIZE + places[other, k], signs[other, k], len(sums))
    used = np.flatnonzero(counts)
    rows = sums.reshape(-1, SIZE)[used]
    for at in range(0, len(used), 4096):
        columns = [pa.array(used[at : at + 4096]), pa.array(counts[used[at : at + 4096]])]
        columns += [pa.array(np.ascontiguousarray(rows[at : at + 4096, k])) for k in range(SIZE)]
        yield pa.RecordBatch.from_arrays(columns, names=["cell", "n", *[f"v{k}" for k in range(SIZE)]])


def word_vectors(docs: DataFrame, text_col: str = "text"):
    """Vectors of all cells from the whole corpus: a table of fixed size, whatever the corpus."""
    import numpy as np

    schema = "cell long, n long, " + ", ".join(f"v{k} double" for k in range(SIZE))
    sums = docs.select(text_of(text_col).alias("text")).mapInArrow(_contexts, schema)
    table = sums.groupBy("cell").agg(F.sum("n").alias("n"), *[F.sum(f"v{k}").alias(f"v{k}") for k in range(SIZE)]).toPandas()
    vectors, share = np.zeros((WORDS + SHAPES, SIZE), np.float32), np.zeros(WORDS + SHAPES)
    cell = table["cell"].to_numpy()
    values = table[[f"v{k}" for k in range(SIZE)]].to_numpy()
    vectors[cell] = values / np.maximum(np.linalg.norm(values, axis=1, keepdims=True), 1e-9)
    share[cell] = table["n"].to_numpy() / max(1, table["n"].sum())
    return (vectors * (WEIGHT / (WEIGHT + share))[:, None]).astype(np.float32)


def pooled(texts: list[str], vectors, cells: Cells):
    """Mean vector of a text's words and mean vector of their shapes, side by side; zeros if it has none."""
    import numpy as np

    flat, at = _stream(texts, cells)
    out = np.zeros((len(texts), 2 * SIZE), np.float32)
    for half, part in ((0, flat[0::2]), (1, flat[1::2])):
        first = at // 2
        for i in range(len(texts)):
            a, b = first[i], first[i + 1]
            if b > a:
                out[i, half * SIZE : (half + 1) * SIZE] = vectors[part[a:b]].mean(axis=0)
    return out


def _features(shared):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        vectors, cells = shared.value, Cells()
        for whole in batches:
            for batch in slices(whole, size=4 << 20):
                x = pooled(batch.column("text").to_pylist(), vectors, cells)
                yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([row.tobytes() for row in x], pa.binary())], names=["label", "x"])

    return run


def fit_network(x, y, seed: int = SEED):
    """Two-layer network and the temperature that fits its probabilities to every fifth row, kept apart."""
    import numpy as np

    if len(y) < 10 or y.min() == y.max():
        rate = (float(y.sum()) + 1) / (len(y) + 2)
        return {"rate": rate}
    rng = np.random.default_rng(seed)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - mean) / spread
    apart = np.arange(len(y)) % 5 == 4
    fit, target = z[~apart], y[~apart].astype(np.float64)
    p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    first, second, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(target))
        for at in range(0, len(order), 256):
            rows = order[at : at + 256]
            a, goal = fit[rows], target[rows]
            h = np.tanh(a @ p[0] + p[1])
            wrong = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -50, 50))) - goal) / len(rows)
            back = np.outer(wrong, p[2]) * (1 - h * h)
            grads = [a.T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ wrong + 1e-4 * p[2], np.array([wrong.sum()])]
            t += 1
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] = p[k] - RATE * first[k] / (1 - 0.9**t) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    logit = np.tanh(z[apart] @ p[0] + p[1]) @ p[2] + p[3]
    goal = y[apart]
    loss = lambda temperature: np.logaddexp(0, np.where(goal > 0, -1, 1) * logit / temperature).mean()
    temperature = min(np.geomspace(0.25, 8, 141), key=loss)
    return {"mean": mean, "spread": spread, "layers": p, "temperature": float(temperature)}


def probability(network, x):
    import numpy as np

    if "rate" in network:
        return np.full(len(x), network["rate"])
    w, b, v, c = network["layers"]
    logit = np.tanh((x - network["mean"]) / network["spread"] @ w + b) @ v + c
    return 1 / (1 + np.exp(-np.clip(logit / network["temperature"], -50, 50)))


def _score(shared):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        (vectors, network), cells = shared.value, Cells()
        for whole in batches:
            for batch in slices(whole, size=4 << 20):
                score = probability(network, pooled(batch.column("text").to_pylist(), vectors, cells))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score)], names=["doc_id", "held_out", "score"])

    return run


def fit_labels(labels: DataFrame, column: str, learnable, rows: int) -> DataFrame:
    """At most ``rows`` labelled ids that may be learnt from, one row each, picked by a hash of the id."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & learnable)
    own = own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(column).cast("int")).alias("label"))
    return own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def score_quality(docs: DataFrame, labels: DataFrame, held_out, threshold: float = 0.3, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Score of each document for label 1, from its text alone.

    ``held_out`` is a condition on ``doc_id``; labels of such rows are not learnt from. Word vectors
    come from all texts. Null and empty texts have the zero vector and get its score; a null id is not
    held out; repeated rows are scored each. With fewer than ten labels, or one kind, all scores are
    the smoothed share of label 1.
    """
    import numpy as np

    spark = docs.sparkSession
    held = F.coalesce(held_out, F.lit(False))
    vectors = word_vectors(docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    chosen = fit_labels(labels, "quality", ~held, fit_rows)
    sample = texts.join(F.broadcast(chosen), "doc_id").select("label", "text").mapInArrow(_features(spark.sparkContext.broadcast(vectors)), "label int, x binary")
    got = sorted((r["label"], bytes(r["x"])) for r in sample.collect())
    order = np.random.default_rng(SEED).permutation(len(got))
    y = np.array([got[i][0] for i in order], np.int64)
    x = np.array([np.frombuffer(got[i][1], np.float32) for i in order]).reshape(len(got), 2 * SIZE)
    network = fit_network(x, y)
    model = spark.sparkContext.broadcast((vectors, network))
    scored = texts.select("doc_id", held.alias("held_out"), "text").mapInArrow(_score(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
