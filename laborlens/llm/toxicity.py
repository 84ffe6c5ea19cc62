"""Severity of toxic texts: cumulative-link ordinal regression on sparse word features.

P(grade <= k) = sigmoid(theta_k - w x): one weight vector for all thresholds, thresholds in order.
x says which words a text has. The fit sees a bounded sample of the labelled rows and keeps a
sparse weight vector; scoring covers every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlens.llm.common import flat, pieces
from laborlens.llm.words import MARKS, words

SAMPLE_ROWS = 20_000      # bound of the labelled rows that the fit sees
LEAST_TEXTS = 10           # a word of fewer texts of the sample is no feature
SPARSITY = 1e-2         # weight of the L1 term
STEPS = 300
REJECT = 0.5              # a text is rejected from this probability of grade 1 or more


class Ordinal(NamedTuple):
    """Words (sorted hashes) with their weights, and the thresholds between grades."""
    words: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..., one row for each score."""
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _features(batch: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(row, word hash) pairs of a batch, each once."""
    w = words(*flat(batch.column(text)), space=MARKS)
    order = np.lexsort((w.hash, w.doc))
    doc, value = w.doc[order], w.hash[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (value[1:] != value[:-1]))[:len(doc)]
    return doc[new], value[new]


def fit_ordinal(row: np.ndarray, value: np.ndarray, grade: np.ndarray) -> Ordinal:
    """A strict L1 fit picks the words, a mild one over these alone sets the weights without its shrinkage."""
    strict = _fit(row, value, grade, SPARSITY)
    chosen = np.isin(value, strict.words)
    return _fit(row[chosen], value[chosen], grade, SPARSITY / 50)


def _fit(row: np.ndarray, value: np.ndarray, grade: np.ndarray, sparsity: float) -> Ordinal:
    """Accelerated proximal gradient steps over pairs (row, word) of texts with grades 0, 1, ..."""
    top = int(grade.max(initial=0))
    known, column, count = np.unique(value, return_inverse=True, return_counts=True)
    frequent = count >= LEAST_TEXTS
    place = np.cumsum(frequent) - 1
    keep = frequent[column]
    row, column, known, count = row[keep], place[column[keep]], known[frequent], count[frequent]
    n = max(1, len(grade))
    if top == 0:
        return Ordinal(known[:0], np.zeros(0), np.full(max(top, 1), np.inf))
    share = np.minimum(count / n, 1 - 0.5 / n)
    scale = 1 / np.sqrt(np.maximum(share * (1 - share), 1 / n))
    middle = share * scale
    reached = np.array([(grade >= k).mean() for k in range(1, top + 1)]).clip(1e-6, 1 - 1e-6)
    theta = np.maximum.accumulate(np.log((1 - reached) / reached) + 1e-3 * np.arange(top))
    w, momentum, t, step = np.zeros(len(known)), np.zeros(len(known)), 1.0, 1.0
    low, high = np.append(-np.inf, theta), np.append(theta, np.inf)

    def score(v: np.ndarray) -> np.ndarray:
        return np.bincount(row, (v * scale)[column], minlength=n) - middle @ v

    def loss(s: np.ndarray) -> float:
        return -np.log(np.maximum(_sigmoid(high[grade] - s) - _sigmoid(low[grade] - s), 1e-12)).mean()

    for _ in range(STEPS):
        s = score(momentum)
        above, below = _sigmoid(high[grade] - s), _sigmoid(low[grade] - s)
        slope = (above * (1 - above) - below * (1 - below)) / np.maximum(above - below, 1e-12) / n
        g = np.bincount(column, slope[row], minlength=len(known)) * scale - middle * slope.sum()
        now = loss(s)
        while True:
            new = momentum - step * g
            new = np.sign(new) * np.maximum(np.abs(new) - step * sparsity, 0)
            d = new - momentum
            after = loss(score(new))
            if after <= now + g @ d + d @ d / (2 * step) + 1e-12 or step < 1e-6:
                break
            step /= 2
        # thresholds: one damped Newton step each, kept in order
        s = score(new)
        for k in range(top):
            p = _sigmoid(s - theta[k])
            theta[k] += 0.5 * ((p - (grade > k)).mean()) / max((p * (1 - p)).mean(), 1e-6)
        theta = np.maximum.accumulate(theta + 1e-3 * np.arange(top)) - 1e-3 * np.arange(top)
        theta += 1e-6 * np.arange(top)
        low, high = np.append(-np.inf, theta), np.append(theta, np.inf)
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        momentum, w, t = new + (t - 1) / later * (new - w), new, later
    used = np.flatnonzero(w)
    return Ordinal(known[used], (w * scale)[used], theta + middle @ w)


def labelled(docs: DataFrame, grades: DataFrame, rows: int, id_: str = "doc_id", text: str = "text",
             grade: str = "grade") -> DataFrame:
    """label_id, grade, text of at most ``rows`` ids: one row for each, of several texts the one with the smallest hash."""
    picked = (grades.where(F.col(id_).isNotNull() & F.col(grade).isNotNull())
              .groupBy(F.col(id_).alias("label_id")).agg(F.max(grade).cast("int").alias("grade"))
              .orderBy(F.xxhash64("label_id"), "label_id").limit(rows))
    texts = docs.select(F.col(id_).alias("label_id"), F.col(text).alias("text"))
    sample = texts.join(F.broadcast(picked) if rows <= 1_000_000 else picked, "label_id")
    return sample.groupBy("label_id", "grade").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least")) \
        .select("label_id", "grade", "least.text")


def train(docs: DataFrame, grades: DataFrame, rows: int = SAMPLE_ROWS, id_: str = "doc_id", text: str = "text",
          grade: str = "grade") -> Ordinal:
    """Fit on at most ``rows`` labelled texts, those with the smallest hash of the id.

    Rows with a NULL id or grade do not count; a repeated id has its largest grade and one of its texts.
    """
    sample = labelled(docs, grades, rows, id_, text, grade)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            row, value = _features(batch, "text")
            cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(value.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("label_id"), batch.column("grade"), lists],
                                             ["label_id", "grade", "words"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by("label_id")
        lists = table.column("words").combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        model = fit_ordinal(np.repeat(np.arange(len(table)), size), lists.flatten().to_numpy().view(np.uint64),
                            table.column("grade").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([model.words.tobytes()]), pa.array([model.weights.tobytes()]),
                                          pa.array([model.thresholds.tobytes()])], ["words", "weights", "thresholds"])

    features = sample.mapInArrow(extract, "label_id long, grade int, words array<long>")
    found = features.repartition(1).mapInArrow(fit, "words binary, weights binary, thresholds binary").first()
    if found is None:
        return Ordinal(np.zeros(0, np.uint64), np.zeros(0), np.full(1, np.inf))
    order = [np.frombuffer(found[0], np.uint64), np.frombuffer(found[1]), np.frombuffer(found[2])]
    return Ordinal(*order)


def severity(docs: DataFrame, model: Ordinal, text: str = "text") -> DataFrame:
    """Each row with expected_severity (sum of P(grade >= k)), toxic_probability (k = 1), severity_grade
    (the likeliest) and rejected. NULL or empty texts get the score of no words; clashing columns are
    replaced; rows are independent, so repeated rows get equal results.
    """
    extra = ("expected_severity", "toxic_probability", "severity_grade", "rejected")
    ours = docs.drop(*extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            w = words(*flat(batch.column(text)), space=MARKS)
            score = np.zeros(batch.num_rows)
            if len(model.words):
                at = np.searchsorted(model.words, w.hash).clip(max=len(model.words) - 1)
                hit = model.words[at] == w.hash
                pair = np.unique(w.doc[hit] * len(model.words) + at[hit])
                score = np.bincount(pair // len(model.words), model.weights[pair % len(model.words)],
                                    minlength=batch.num_rows)
            reach = model.probabilities(score)
            each = np.concatenate([np.ones((len(score), 1)), reach, np.zeros((len(score), 1))], axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(reach.sum(axis=1)), pa.array(reach[:, 0]),
                 pa.array(np.argmax(each[:, :-1] - each[:, 1:], axis=1).astype(np.int32)),
                 pa.array(reach[:, 0] >= REJECT)], [*batch.schema.names, *extra])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ours.schema)
    return ours.mapInArrow(run, f"{schema}, expected_severity double, toxic_probability double, "
                                "severity_grade int, rejected boolean")
