"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

P(word | before) = P(class | before) P(word | class, before). Features are the word before, the two
words before and, skipping one, the word before that, hashed into rows of weights; the unigram
distribution is a fixed offset, so the model without weights is the unigram model. The HEAD most
frequent words form CLASSES classes; all others are one class with unigram odds inside.
Training: each round every task runs gradient steps over its share of the texts and sends what its
weights moved; sums by block of rows make the next weights. Each training text is seen once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlens.llm.common import Scratch, flat, pieces
from laborlens.llm.words import mix, words

HEAD, CLASSES = 2048, 64
KNOWN = 1 << 18                 # most frequent words whose counts every task has; the rest is joined
CLASS_ROWS, WORD_ROWS, BLOCK = 1 << 13, 1 << 14, 512
ROUNDS, STEP, LARGEST = 2, 0.15, 20.0
AT_ONCE, GATHER = 8192, 4      # places handled at once, and how often before the weights move
END = np.uint64(0x5851F42D4C957F2D)
REMAINDER, PARTS = 2, 7         # held out: crc32(doc_id as text) mod 7 is 2


class Model(NamedTuple):
    """What all tasks have: counts of frequent words, offsets and weights; all of a fixed size."""
    known: np.ndarray            # sorted hashes
    count: np.ndarray
    rank: np.ndarray             # place among HEAD words, or HEAD
    total: int
    distinct: int
    class_offset: np.ndarray
    word_offset: np.ndarray      # class x word in class
    class_weights: np.ndarray
    word_weights: np.ndarray

    @property
    def width(self) -> int:
        return self.word_offset.shape[1]


def held_out(id_: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_).cast("string"), F.lit(""))) % PARTS == REMAINDER


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts, each followed by END; the text of each; where each text starts."""
    w = words(*flat(batch.column("text")))
    n = batch.num_rows
    out = np.full(len(w.hash) + n, END, np.uint64)
    out[np.arange(len(w.hash)) + w.doc] = w.hash
    first = w.first + np.arange(n + 1)
    return out, np.repeat(np.arange(n), np.diff(first)), first


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    size = 0

    def out() -> pa.RecordBatch:
        word, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["word", "n"])

    for batch in pieces(batches, "text"):
        held.append(_tokens(batch)[0])
        size += len(held[-1])
        if size > 1 << 22:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def _offsets(counts: np.ndarray, total: int, distinct: int) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of the unigram odds of classes and of words in their class; counts: of HEAD words, falling."""
    width = max(1, -(-len(counts) // CLASSES))
    share = np.zeros(CLASSES * width)
    share[:len(counts)] = (counts + 1) / (total + distinct + 1)
    share = share.reshape(CLASSES, width)
    with np.errstate(divide="ignore", invalid="ignore"):
        inside = np.log(share) - np.log(share.sum(axis=1, keepdims=True))
        each = np.log(np.append(share.sum(axis=1), max(1e-12, 1 - share.sum())))
    return each.astype(np.float32), np.where(np.isfinite(inside), inside, -1e4).astype(np.float32)


def _features(token: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the word before, the two before, and the one before that alone; END stands before a text."""
    one, two = np.roll(token, 1), np.roll(token, 2)
    start = first[:-1]
    one[start] = END
    two[start] = END
    second = start[np.diff(first) > 1] + 1
    two[second] = END
    salt = np.uint64(0x2545F4914F6CDD1D)
    return mix(one), mix(one * salt + two), mix(two ^ salt)


def _place(hashes: np.ndarray, rows: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - (rows.bit_length() - 1))).astype(np.int64)


def _softmax(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = np.exp(logits, out=logits)          # weights are kept small, so nothing overflows
    z = p.sum(axis=1)
    p *= (1 / z)[:, None]
    return p, np.log(z)


class Steps:
    """Logits of a batch of places, and gradient steps that remember how far each weight has moved."""

    def __init__(self, model: Model):
        self.model = model
        self.class_weights, self.word_weights = model.class_weights, model.word_weights

    def learn(self) -> None:
        self.class_weights, self.word_weights = self.class_weights.copy(), self.word_weights.copy()
        self.slopes = [np.ones_like(self.class_weights), np.ones_like(self.word_weights)]
        self.sums = [np.zeros_like(self.class_weights), np.zeros_like(self.word_weights)]
        self.waiting = 0
        self.touched = [np.zeros(CLASS_ROWS, np.float32), np.zeros(WORD_ROWS, np.float32)]

    def look(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index among known words (or -1) and place among HEAD words (or HEAD)."""
        m = self.model
        if not len(m.known):
            return np.full(len(token), -1), np.full(len(token), HEAD)
        at = np.searchsorted(m.known, token).clip(max=len(m.known) - 1)
        at = np.where(m.known[at] == token, at, -1)
        return at, np.where(at >= 0, m.rank[at], HEAD)

    def run(self, rank: np.ndarray, features: tuple, learn: bool) -> np.ndarray:
        """Log odds gained over the unigram model for each place; with ``learn`` also a step."""
        m, n = self.model, len(rank)
        one, two, skip = features
        kind = np.minimum(rank // m.width, CLASSES)
        rows = np.stack([_place(h, CLASS_ROWS) for h in (one, two, skip)])
        logits = np.take(self.class_weights, rows[0], axis=0)
        logits += np.take(self.class_weights, rows[1], axis=0)
        logits += np.take(self.class_weights, rows[2], axis=0)
        logits += m.class_offset
        every = np.arange(n)
        target = logits[every, kind] - m.class_offset[kind]
        p, z = _softmax(logits)
        gain = (target - z).astype(float)
        head = np.flatnonzero(kind < CLASSES)
        inner, place = kind[head], rank[head] % m.width
        salt = inner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        word_rows = np.stack([_place(mix(h[head] + salt), WORD_ROWS) for h in (one, skip)])
        inside = np.take(self.word_weights, word_rows[0], axis=0)
        inside += np.take(self.word_weights, word_rows[1], axis=0)
        inside += np.take(m.word_offset, inner, axis=0)
        here = np.arange(len(head))
        within = inside[here, place] - m.word_offset[inner, place]
        q, y = _softmax(inside)
        gain[head] += within - y
        if learn:
            p[every, kind] -= 1
            q[here, place] -= 1
            self._gather(0, rows, p)
            self._gather(1, word_rows, q)
            self.waiting += 1
            if self.waiting == GATHER:
                self.step()
        return gain

    def _gather(self, which: int, rows: np.ndarray, slope: np.ndarray) -> None:
        """Add the slopes of all places that share a row."""
        for one in rows:
            order = np.argsort(one, kind="stable")
            sorted_ = one[order]
            if len(sorted_):
                end = np.flatnonzero(np.append(sorted_[1:] != sorted_[:-1], True))
                upto = np.take(np.cumsum(np.take(slope, order, axis=0), axis=0), end, axis=0)
                upto[1:] -= upto[:-1].copy()
                at = sorted_[end]
                self.sums[which][at] += upto
                self.touched[which][at] += np.diff(np.append(-1, end))

    def step(self) -> None:
        """Move the weights by the slopes gathered so far."""
        for g, squares, weights in zip(self.sums, self.slopes, (self.class_weights, self.word_weights)):
            squares += g * g
            weights -= STEP * g / np.sqrt(squares)
            np.clip(weights, -LARGEST, LARGEST, out=weights)
            g[:] = 0
        self.waiting = 0


def _moves(model: Model):
    """One task's share of a round: for each block of rows the moves times the touches, and the touches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = Steps(model)
        steps.learn()
        for batch in pieces(batches, "text"):
            token, _, first = _tokens(batch)
            _, rank = steps.look(token)
            features = _features(token, first)
            for lo in range(0, len(token), AT_ONCE):
                part = slice(lo, lo + AT_ONCE)
                steps.run(rank[part], tuple(f[part] for f in features), True)
        steps.step()
        for which, (new, old) in enumerate(((steps.class_weights, model.class_weights),
                                            (steps.word_weights, model.word_weights))):
            for lo in range(0, len(old), BLOCK):
                touch = steps.touched[which][lo:lo + BLOCK]
                if touch.any():
                    move = (new[lo:lo + BLOCK] - old[lo:lo + BLOCK]) * touch[:, None]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([which], pa.int32()), pa.array([lo], pa.int32()), pa.array([move.tobytes()], pa.binary()),
                         pa.array([touch.tobytes()], pa.binary())], ["which", "lo", "move", "touch"])
    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the moves of each block in this partition; holds one block's sums for each block."""
    total: dict[tuple[int, int], list[np.ndarray]] = {}
    for batch in batches:
        for which, lo, move, touch in zip(*(c.to_pylist() for c in batch.columns)):
            new = [np.frombuffer(move, np.float32), np.frombuffer(touch, np.float32)]
            old = total.get((which, lo))
            total[which, lo] = [a + b for a, b in zip(old, new)] if old else new
    for (which, lo), (move, touch) in total.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([which], pa.int32()), pa.array([lo], pa.int32()), pa.array([move.tobytes()], pa.binary()),
             pa.array([touch.tobytes()], pa.binary())], ["which", "lo", "move", "touch"])


def train(scratch: Scratch, docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model of texts (doc_id, text) that are not held out, and the counts (word, n) of their words."""
    texts = docs.where(~held_out())
    counts = scratch.save(texts.select("text").mapInArrow(_count, "word long, n long")
                          .groupBy("word").agg(F.sum("n").alias("n")), "counts")
    size = counts.agg(F.count("*").alias("v"), F.sum("n").alias("n")).first()
    total, distinct = size["n"] or 0, size["v"]
    top = counts.orderBy(F.desc("n"), "word").limit(KNOWN).toArrow()
    word, n = top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(word)
    rank = np.minimum(np.arange(len(word)), HEAD)
    each, inside = _offsets(n[:HEAD], total, distinct)
    model = Model(word[order], n[order], rank[order], total, distinct, each, inside,
                  np.zeros((CLASS_ROWS, CLASSES + 1), np.float32), np.zeros((WORD_ROWS, inside.shape[1]), np.float32))
    share = F.pmod(F.xxhash64("text"), F.lit(ROUNDS))
    for r in range(ROUNDS if total else 0):
        sums = texts.where(F.coalesce(share, F.lit(0)) == r).select("text").mapInArrow(
            _moves(model), "which int, lo int, move binary, touch binary") \
            .repartition("which", "lo").mapInArrow(_add, "which int, lo int, move binary, touch binary")
        weights = [model.class_weights.copy(), model.word_weights.copy()]
        for row in sums.toLocalIterator():
            touch = np.frombuffer(row["touch"], np.float32)
            move = np.frombuffer(row["move"], np.float32).reshape(len(touch), -1)
            weights[row["which"]][row["lo"]:row["lo"] + len(touch)] += move / np.maximum(touch, 1)[:, None]
        model = model._replace(class_weights=weights[0], word_weights=weights[1])
    return model, counts


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = Steps(model)
        uid = TaskContext.get().partitionId() << 33
        odds = np.log10(model.count + 1.0)
        for batch in pieces(batches, "text"):
            token, doc, first = _tokens(batch)
            at, rank = steps.look(token)
            features = _features(token, first)
            gain = np.zeros(len(token))
            for lo in range(0, len(token), AT_ONCE):
                part = slice(lo, lo + AT_ONCE)
                gain[part] = steps.run(rank[part], tuple(f[part] for f in features), False)
            n = batch.num_rows
            seen = at >= 0
            base = np.bincount(doc[seen], odds[at[seen]], minlength=n) if seen.any() else np.zeros(n)
            # words that only the table of all counts can tell
            rare = np.flatnonzero(~seen)
            order = rare[np.lexsort((token[rare], doc[rare]))]
            new = np.append(True, (np.diff(doc[order]) != 0) | (token[order][1:] != token[order][:-1]))[:len(order)]
            start = np.flatnonzero(new)
            times = np.diff(np.append(start, len(order)))
            cut = pa.array(np.searchsorted(doc[order[start]], np.arange(n + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(uid + np.arange(n)), batch.column("doc_id"), batch.column("held_out"), pa.array(np.diff(first)),
                 pa.array(np.bincount(doc[seen], minlength=n)), pa.array(base),
                 pa.array(np.bincount(doc, gain, minlength=n) / np.log(10)),
                 pa.ListArray.from_arrays(cut, pa.array(token[order[start]].view(np.int64))),
                 pa.ListArray.from_arrays(cut, pa.array(times.astype(np.int32)))],
                ["uid", "doc_id", "held_out", "n_tokens", "n_seen", "base", "gain", "rare", "times"])
            uid += n
    return run


def score(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row.

    Scores are log10 probabilities of the words and one end, of the add-one unigram model and of this
    one. Texts whose crc32(doc_id as text) mod 7 is 2 are held out. NULL and empty texts are one end; a
    NULL id counts as '' ; repeated rows each have a row and count each time; an empty table gives none.
    """
    scratch = Scratch(docs.sparkSession, "maxent")
    rows = docs.select(F.col(id_).alias("doc_id"), F.col(text).alias("text"))
    model, counts = train(scratch, rows)
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = scratch.save(rows.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(
        _score(model), f"uid long, doc_id {kind}, held_out boolean, n_tokens long, n_seen long, base double, gain double, "
                       "rare array<long>, times array<int>"), "scored")
    rest = scored.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("r")).select(
        "uid", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    least = int(model.count.min(initial=1 << 62)) if len(model.known) == KNOWN else 0
    found = rest.join(counts.where(F.col("n") <= least), "word").groupBy("uid").agg(
        F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_base"))
    unit = float(np.log10(model.total + model.distinct + 1.0))
    base = F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(unit)
    return scored.drop("rare", "times").join(found, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_seen") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("gain")).alias("score"))
