"""The most frequent terms of cleaned texts, exactly, without a shuffle of all terms.

Frames of texts have them as column ``clean``; each pass makes tokens of them next to its sums, as lists of tokens cost more
to move than to make.

Each task keeps a summary of a bounded number of terms: where there are more, the count of the first one left out is
taken off all of them, and what reaches zero goes. A kept count then lacks at most the sum of what was taken off. Sums of
the summaries and of these errors bound every term's count from both sides, so a short list of candidates is proven to
hold the most frequent terms, and a second pass counts only these.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from laborlens.operators.automaton import WORD
from laborlens.session import cut_lineage, slices

SUMMARY = 1 << 14            # terms that a task keeps and sends
TOKENS = 1 << 19             # tokens looked at together; a longer text comes alone
CANDIDATE_BYTES = 4 << 20    # candidates up to this size are sent to the tasks


def tokens(batch: pa.RecordBatch, column: str) -> pa.Array:
    """Of each text its runs of at least two ASCII letters, digits or underscores, in order; NULL of NULL."""
    held = batch.column(column)
    missing = pc.is_null(held)
    held = pc.fill_null(held, "").cast(pa.large_binary())
    offsets = np.frombuffer(held.buffers()[1], np.int64)[held.offset:held.offset + len(held) + 1]
    data = np.frombuffer(held.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    solid = WORD[data]
    edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    first = solid & ~np.append(False, solid[:-1])[:len(data)]
    first[edges] = solid[edges]                     # a run ends with its text
    last = solid & ~np.append(solid[1:], False)[:len(data)]
    last[edges - 1] = solid[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    solid[start[end - start < 2]] = False
    start, size = start[end - start >= 2], (end - start)[end - start >= 2]
    ends = np.append(0, np.cumsum(size)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(size), pa.py_buffer(ends), pa.py_buffer(data[solid]))
    cut = pa.array(np.searchsorted(start, offsets), pa.int32())
    return pa.ListArray.from_arrays(cut, words, mask=missing)


class Pairs:
    """Tokens of some texts as numbers: their words, the number of each token, and its text."""

    def __init__(self, lists: pa.Array, stopwords: list[str]):
        coded = lists.flatten().dictionary_encode()
        self.words = coded.dictionary
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(len(size)), size)
        if stopwords:
            kept = ~pc.is_in(self.words, value_set=pa.array(stopwords, pa.string())).to_numpy(zero_copy_only=False)[codes]
            codes, rows = codes[kept], rows[kept]
        self.codes, self.rows = codes, rows
        self.beside = np.flatnonzero(rows[1:] == rows[:-1])      # tokens with a neighbour on their right


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with about TOKENS tokens together, whole texts only; their texts give way to lists of tokens."""
    for batch in slices(batches, "clean", 6 * TOKENS):
        kept = [name for name in batch.schema.names if name != "clean"]
        yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in kept), tokens(batch, "clean")], [*kept, "tokens"])


class Summary:
    """Counts of at most ``size`` terms and how much any of them, or a term without one, may lack."""

    def __init__(self, size: int):
        self.size, self.error, self.pending = size, 0, 0
        self.parts: list[pa.Table] = []

    def add(self, terms: pa.Array, n: np.ndarray) -> None:
        self.parts.append(pa.table({"term": terms, "n": pa.array(n, pa.int64())}))
        self.pending += len(terms)
        if self.pending > 8 * self.size:
            self.compact()

    def cut(self, terms: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """At most ``size`` of distinct terms, less the count of the first one left out."""
        if len(n) <= self.size:
            return terms, n
        first_out = np.partition(n, len(n) - self.size - 1)[len(n) - self.size - 1]
        self.error += int(first_out)
        return terms[n > first_out], n[n > first_out] - first_out

    def compact(self) -> pa.Table:
        merged = pa.concat_tables(self.parts).group_by("term").aggregate([("n", "sum")])
        at, n = self.cut(np.arange(len(merged)), merged.column("n_sum").to_numpy())
        result = pa.table({"term": merged.column("term").take(pa.array(at)), "n": pa.array(n, pa.int64())})
        self.parts, self.pending = [result], len(n)
        return result


def summarise(lists: DataFrame, bigrams: bool, stopwords: list[str], size: int) -> DataFrame:
    """(term, n, error, texts): at most ``size`` terms of each task, and a row without a term that has the other sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, texts = Summary(size), 0
        kept.add(pa.array([], pa.string()), np.zeros(0, np.int64))
        for batch in _slices(batches):
            texts += batch.num_rows
            seen = Pairs(batch.column("tokens"), stopwords)
            n = np.bincount(seen.codes, minlength=len(seen.words))
            used = np.flatnonzero(n)
            kept.add(seen.words.take(pa.array(used)), n[used])
            if bigrams and len(seen.beside):
                width = len(seen.words)
                both, n = np.unique(seen.codes[seen.beside] * width + seen.codes[seen.beside + 1], return_counts=True)
                both, n = kept.cut(both, n)         # as numbers: most pairs are never spelled
                kept.add(pc.binary_join_element_wise(seen.words.take(pa.array(both // width)),
                                                     seen.words.take(pa.array(both % width)), " "), n)
        result = kept.compact()
        zeros = pa.array(np.zeros(len(result), np.int64))
        for part in result.append_column("error", zeros).append_column("texts", zeros).combine_chunks().to_batches():
            yield part
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([0]), pa.array([kept.error]),
                                          pa.array([texts])], ["term", "n", "error", "texts"])

    return lists.select("clean").mapInArrow(run, "term string, n long, error long, texts long")


def _counter(wanted: list[str], stopwords: list[str]) -> Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Counts a batch's wanted terms: row, index in ``wanted`` and number, in order of the first two."""
    names = pa.array(wanted, pa.string())
    cut = [(w.split(" ", 1), i) for i, w in enumerate(wanted) if " " in w]
    lefts, rights = (sorted({pair[side] for pair, _ in cut}) for side in (0, 1))
    left_at, right_at = ({w: i for i, w in enumerate(part)} for part in (lefts, rights))
    known = sorted((left_at[a] * len(rights) + right_at[b], i) for (a, b), i in cut)
    pair_keys, pair_names = np.array([k for k, _ in known], np.int64), np.array([i for _, i in known], np.int64)

    def places(words: pa.Array, among: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(words, value_set=among), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def count(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        seen = Pairs(batch.column("tokens"), stopwords)
        term = places(seen.words, names)[seen.codes]
        rows, terms = [seen.rows[term >= 0]], [term[term >= 0]]
        if len(pair_keys) and len(seen.beside):
            left = places(seen.words, pa.array(lefts, pa.string()))[seen.codes[seen.beside]]
            right = places(seen.words, pa.array(rights, pa.string()))[seen.codes[seen.beside + 1]]
            both = np.where((left >= 0) & (right >= 0), left * len(rights) + right, -1)
            at = np.minimum(np.searchsorted(pair_keys, both), len(pair_keys) - 1)
            hit = pair_keys[at] == both
            rows.append(seen.rows[seen.beside[hit]])
            terms.append(pair_names[at[hit]])
        found, n = np.unique(np.concatenate(rows) * max(1, len(wanted)) + np.concatenate(terms), return_counts=True)
        return found // max(1, len(wanted)), found % max(1, len(wanted)), n

    return count


def count_words(lists: DataFrame, stopwords: list[str]) -> DataFrame:
    """(term, tf): how often the words occur in some texts that a task has read together; no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            seen = Pairs(batch.column("tokens"), stopwords)
            n = np.bincount(seen.codes, minlength=len(seen.words))
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([seen.words.take(pa.array(used)), pa.array(n[used], pa.int64())], ["term", "tf"])

    return lists.select("clean").mapInArrow(run, "term string, tf long")


def count_terms(lists: DataFrame, wanted: list[str], stopwords: list[str], key: str | None = None) -> DataFrame:
    """([key,] term, tf): how often each text that has one of the wanted terms has it; no shuffle."""
    names, count = pa.array(wanted, pa.string()), _counter(wanted, stopwords)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            rows, terms, n = count(batch)
            columns = [names.take(pa.array(terms)), pa.array(n, pa.int64())]
            if key:
                columns.insert(0, batch.column("_key").take(pa.array(rows)))
            yield pa.RecordBatch.from_arrays(columns, ["_key"] * bool(key) + ["term", "tf"])

    if not key:
        return lists.select("clean").mapInArrow(run, "term string, tf long")
    kind = lists.schema[key].dataType.simpleString()
    return (lists.select(F.col(key).alias("_key"), "clean").mapInArrow(run, f"_key {kind}, term string, tf long")
            .withColumnRenamed("_key", key))


def count_vectors(lists: DataFrame, names: list[str], stopwords: list[str], key: str, counts: str) -> DataFrame:
    """(key, counts): for each text, those without any of the terms too, the sparse vector of the terms' counts; no shuffle."""
    count = _counter(names, stopwords)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            rows, terms, n = count(batch)
            cut = pa.array(np.searchsorted(rows, np.arange(batch.num_rows + 1)), pa.int32())
            vectors = pa.StructArray.from_arrays(
                [pa.array(np.zeros(batch.num_rows, np.int8)), pa.array(np.full(batch.num_rows, len(names), np.int32)),
                 pa.ListArray.from_arrays(cut, pa.array(terms, pa.int32())),
                 pa.ListArray.from_arrays(cut, pa.array(n, pa.float64()))], ["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([batch.column("_key"), vectors], [key, counts])

    schema = StructType([StructField(key, lists.schema[key].dataType), StructField(counts, VectorUDT())])
    return lists.select(F.col(key).alias("_key"), "clean").mapInArrow(run, schema)


def candidates(lists: DataFrame, most: int, bigrams: bool, stopwords: list[str],
               size: int = SUMMARY) -> tuple[list[str] | None, int]:
    """Terms that are proven to hold the ``most`` frequent ones (None: the summaries prove no short list), and the number of texts.

    A term in no summary occurs at most ``error`` times, so the proof holds where the ``most``-th lower bound is larger.
    """
    merged = cut_lineage(summarise(lists, bigrams, stopwords, size).groupBy("term").agg(
        F.sum("n").alias("n"), F.sum("error").alias("error"), F.sum("texts").alias("texts")), "terms")
    rest = merged.where("term IS NULL").agg(F.sum("error").alias("error"), F.sum("texts").alias("texts")).first()
    error, texts = rest["error"] or 0, rest["texts"] or 0
    listed = merged.where("term IS NOT NULL")
    top = [r["n"] for r in listed.select("n").orderBy(F.desc("n")).limit(most).collect()]
    floor = top[-1] if top and len(top) == most else 0
    if error and error >= floor:
        return None, texts
    open_ = listed.where(F.col("n") + F.lit(error) >= F.lit(floor))
    if (open_.agg(F.sum(F.octet_length("term"))).first()[0] or 0) > CANDIDATE_BYTES:
        return None, texts
    return [r["term"] for r in open_.select("term").orderBy("term").collect()], texts
