"""Toxicity: non-negative positive-unlabelled learning on hashed words and their beginnings."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbral.llm.common import text_of
from umbral.llm.quality import fit_labels
from umbral.llm.tokens import slices

#: Cells for words and their beginnings of these lengths.
CELLS = 1 << 18
BEGINNINGS = (3, 4, 5, 6, 7)
#: Labelled documents the classifier is fitted on at most, picked by a hash of their id.
FIT_ROWS = 20_000
#: A cell gets a weight if so many confirmed toxic documents hold it, and more of them than by chance by so
#: many standard deviations.
LEAST_POSITIVE, LEAST_EXCESS = 3, 3.0
STEPS, RATE, RIDGE = 300, 0.05, 1e-4
WORD = re.compile(r"[^\W_]+")
CACHE = 300_000


class Cells(dict):
    """Cells of a word and of its beginnings, looked up once for each distinct word."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        import zlib

        if len(self) > CACHE:
            self.clear()
        parts = [word, *["^" + word[:k] for k in BEGINNINGS if len(word) > k]]
        self[word] = found = tuple(zlib.crc32(p.encode("utf-8", "surrogatepass")) % CELLS for p in parts)
        return found


def cells_of(text: str, cells: Cells):
    """Cells of a text's words and their beginnings, each once, rising."""
    import numpy as np

    found: set[int] = set()
    for word in set(WORD.findall(text.lower())):
        found.update(cells[word])
    return np.sort(np.fromiter(found, np.int64, len(found)))


def _examples(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    cells = Cells()
    for whole in batches:
        for batch in slices(whole, size=4 << 20):
            rows = [cells_of(t, cells).astype(np.int32).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(rows, pa.binary())], names=["label", "x"])


def fit_pu(examples: list, positive, prior: float):
    """Weights of cells and a bias from confirmed positives and the same rows without their labels.

    The risk of calling unlabelled rows negative, less the share of it that positives among them must
    cause, estimates the risk on negatives. Where that estimate falls below zero the step goes
    against it, so it cannot be driven down by remembering rows.
    """
    import numpy as np

    weights = np.zeros(CELLS)
    if not len(examples) or not positive.any() or positive.all():
        rate = min(max(prior, 1e-6), 1 - 1e-6)
        return weights, float(np.log(rate / (1 - rate)))
    lengths = np.array([len(e) for e in examples])
    flat, row = np.concatenate(examples), np.repeat(np.arange(len(examples)), lengths)
    held = np.bincount(flat[positive[row]], minlength=CELLS)
    chance = np.bincount(flat, minlength=CELLS) * positive.mean()
    used = np.flatnonzero((held >= LEAST_POSITIVE) & (held - chance > LEAST_EXCESS * np.sqrt(chance)))
    index = np.full(CELLS, -1)
    index[used] = np.arange(len(used))
    keep = index[flat] >= 0
    column, row = index[flat[keep]], row[keep]
    n, size = len(examples), len(used)
    w, b = np.zeros(size), 0.0
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    share = positive / positive.sum()
    for t in range(1, STEPS + 1):
        logit = np.clip(np.bincount(row, w[column], n) + b, -30, 30)
        p = 1 / (1 + np.exp(-logit))
        as_negative = np.logaddexp(0, logit)  # loss of calling a row negative
        risk = as_negative.mean() - prior * (share @ as_negative)
        negative = p / n - prior * share * p
        slope = prior * share * (p - 1) + negative if risk >= 0 else -negative
        grad = np.append(np.bincount(column, slope[row], size) + RIDGE * w, slope.sum())
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        step = RATE * first / (1 - 0.9**t) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    weights[used] = w
    return weights, float(b)


def _score(shared):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        (weights, bias), cells = shared.value, Cells()
        for whole in batches:
            for batch in slices(whole, size=4 << 20):
                logit = np.array([weights[cells_of(t, cells)].sum() + bias for t in batch.column("text").to_pylist()])
                score = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score)], names=["doc_id", "held_out", "score"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, held_out, threshold: float = 0.7, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Score of each document for toxicity, from its text alone.

    Confirmed toxic rows are the positives; all rows of the labelled sample, their labels unseen, are
    the unlabelled text; the class prior is the share of label 1 among all rows that may be learnt
    from. ``held_out`` is a condition on ``doc_id``. Null and empty texts get the score of the bias
    alone; a null id is not held out; repeated rows are scored each. Without labels of both kinds every
    score is the prior.
    """
    import numpy as np

    spark = docs.sparkSession
    held = F.coalesce(held_out, F.lit(False))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    prior = labels.where(F.col("doc_id").isNotNull() & ~held).agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    chosen = fit_labels(labels, "toxic", ~held, fit_rows)
    got = sorted((r["label"], bytes(r["x"])) for r in texts.join(F.broadcast(chosen), "doc_id").select("label", "text").mapInArrow(_examples, "label int, x binary").collect())
    model = fit_pu([np.frombuffer(x, np.int32) for _, x in got], np.array([y for y, _ in got]) > 0, float(prior or 0.0))
    shared = spark.sparkContext.broadcast(model)
    scored = texts.select("doc_id", held.alias("held_out"), "text").mapInArrow(_score(shared), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
