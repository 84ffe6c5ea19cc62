"""Benchmark decontamination: word pairs join texts to items, Smith-Waterman scores the pairs.

A good pair is two neighbouring words of an item that a text has with at most one word between them.
Of n words let an alignment match m, with a score 2m - e >= n. Of its m - 1 gaps, those that skip
words of the item are at most n - m and cost 1 each, those with two or more added words cost 2 each, all
others are good pairs: at least n / 3 - 1 of them. So a text that reaches LEAST_SCORE has that many
within 2n words, wherever its edits are; of the item's pairs the commonest (by the corpus counts) half of
that number is left out, and the rest must still hold the other half. Texts are never shuffled: blocks
of items, bounded in rows and bytes, go to the tasks. Around the seeds a local alignment of the
item's words decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlens.llm.common import flat, pieces
from laborlens.llm.words import MARKS, Words, mix, words

MATCH, MISMATCH, GAP = 2, -1, -1
LEAST_SCORE = 0.5         # alignment score of a hit, as a share of the item's own
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20
HITS = 1 << 22            # seeds found that are held at once, if one text has no more
KNOWN = 50_000            # windows whose score a task remembers
FOUND = "doc_id long, item_id long, score double, first_word long, last_word long"


def smith_waterman(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two sequences, and the end of the best one in ``text``."""
    slide = -GAP * np.arange(1, len(text) + 1)
    above, best, end = np.zeros(len(text) + 1, np.int64), 0, 0
    for word in item:
        row = np.maximum(above[:-1] + np.where(text == word, MATCH, MISMATCH), above[1:] + GAP)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + slide) - slide      # gaps in the item
        top = int(row.argmax()) if len(row) else 0
        if len(row) and row[top] > best:
            best, end = int(row[top]), top + 1
        above[1:] = row
    return best, end


def least_pairs(size: np.ndarray) -> np.ndarray:
    """Good pairs that any copy of an item of ``size`` words with half of its score has, but 1 at least."""
    return np.maximum(1, -(-size // 3) - 1)


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * np.uint64(0xD6E8FEB86659FD93) + second)


class Block:
    """The items of one block: their words, and seeds sorted by hash with item and place."""

    def __init__(self, ids: list[int], texts: list[bytes]):
        self.ids = ids
        data = np.frombuffer(b"".join(texts), np.uint8)
        w = words(data, np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64), space=MARKS)
        self.words = [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:])]
        self.size = np.diff(w.first)
        self.vocabulary = np.unique(w.hash)
        near, size = np.arange(max(0, len(w.hash) - 1)), self.size[w.doc] if len(w.doc) else np.zeros(0, np.int64)
        near = near[(w.doc[near] == w.doc[near + 1]) & (size[near] > 2)]
        # of three words, one of which is edited, the outer two may be all that is left
        outer = w.first[:-1][self.size == 3]
        self.grams = np.append(_pair(w.hash[near], w.hash[near + 1]), _pair(w.hash[outer], w.hash[outer + 2]))
        self.item = w.doc[np.append(near, outer)]
        # half the score of one or two words is one word
        self.short: dict[int, list[int]] = {}
        for i in np.flatnonzero((self.size > 0) & (self.size < 3)).tolist():
            for word in set(self.words[i].tolist()):
                self.short.setdefault(word, []).append(i)
        self.short_words = np.array(sorted(self.short), np.uint64)
        self.asked = np.unique(self.grams)
        self.choose(np.zeros(len(self.asked), np.int64))

    def choose(self, count: np.ndarray, all_: bool = False) -> None:
        """Leave out the commonest pairs of each item, as many as a copy can spare; count belongs to ``asked``."""
        need = np.ones(len(self.size), np.int64) if all_ else least_pairs(self.size)
        spare = need // 2
        often = count[np.searchsorted(self.asked, self.grams)]
        order = np.lexsort((self.grams, -often, self.item))
        item = self.item[order]
        place = np.arange(len(order)) - np.searchsorted(item, item)        # 0: the commonest of its item
        kept = order[place >= spare[item]]
        kept = kept[np.argsort(self.grams[kept], kind="stable")]
        self.seeds, self.seed_item, self.need = self.grams[kept], self.item[kept], need - spare

    def seen(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a text with at most one word between whose words occur in the items: hashes and first words."""
        if not len(self.vocabulary):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.searchsorted(self.vocabulary, w.hash).clip(max=len(self.vocabulary) - 1)
        good = self.vocabulary[at] == w.hash
        hashes, first = [], []
        for step in (1, 2):
            n = max(0, len(good) - step)
            at = np.flatnonzero(good[:n] & good[step:] & (w.doc[:n] == w.doc[step:]))
            hashes.append(_pair(w.hash[at], w.hash[at + step]))
            first.append(at)
        return np.concatenate(hashes), np.concatenate(first)

    def count(self, w: Words, total: np.ndarray) -> None:
        h, _ = self.seen(w)
        if len(h) and len(self.asked):
            at = np.searchsorted(self.asked, h).clip(max=len(self.asked) - 1)
            total += np.bincount(at[self.asked[at] == h], minlength=len(total))

    def hits(self, w: Words) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, first word, last word) of windows that hold as many seeds of an item as a copy must."""
        h, at = self.seen(w)
        lo, hi = np.searchsorted(self.seeds, h, "left"), np.searchsorted(self.seeds, h, "right")
        found = np.flatnonzero(hi > lo)
        found = found[np.argsort(at[found], kind="stable")]
        lo, n, at = lo[found], (hi - lo)[found], at[found]
        row, total = w.doc[at], np.cumsum(n)
        a = 0
        while a < len(at):
            # whole texts, with HITS seeds or one text's
            b = int(np.searchsorted(total, (total[a - 1] if a else 0) + HITS, "right"))
            if b < len(at):
                cut = int(np.searchsorted(row, row[b]))
                b = cut if cut > a else int(np.searchsorted(row, row[b], "right"))
            yield from self._windows(w, at[a:b], lo[a:b], n[a:b])
            a = b
        if self.short:
            for p in np.flatnonzero(np.isin(w.hash, self.short_words)).tolist():
                for i in self.short[int(w.hash[p])]:
                    yield int(w.doc[p]), i, p - 3, p + 4

    def _windows(self, w: Words, at: np.ndarray, lo: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        item = self.seed_item[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        where = np.repeat(at, n)
        order = np.lexsort((where, item, w.doc[where]))
        item, where = item[order], where[order]
        new = np.append(True, (np.diff(item) != 0) | (np.diff(where) != 0)) if len(where) else np.zeros(0, bool)
        item, where = item[new], where[new]
        row, span = w.doc[where], 2 * self.size[item]
        last = np.arange(len(where)) + self.need[item] - 1
        held = last < len(where)
        last = last.clip(max=max(0, len(where) - 1))
        held &= (row[last] == row) & (item[last] == item) & (where[last] - where <= span)
        row, item, first, last, span = row[held], item[held], where[held], where[last[held]], span[held]
        if not len(row):
            return
        # windows that touch are one
        new = np.append(True, (np.diff(row) != 0) | (np.diff(item) != 0) | (np.diff(first) > span[1:]))
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(row)) - 1
        for a, b in zip(start.tolist(), end.tolist()):
            yield int(row[a]), int(item[a]), int(first[a] - span[a]), int(last[b] + span[a]) + 2


def _blocks(items: DataFrame) -> Iterator[Block]:
    size = items.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b"),
                     F.max(F.octet_length("text")).alias("most")).first()
    parts = max(1, -(-size["n"] // BLOCK_ITEMS), -(-(size["b"] or 0) // BLOCK_BYTES))
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").collect()
        if rows:
            yield Block([r["item_id"] for r in rows], [r["text"].encode() for r in rows])


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE, id_: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """doc_id, item_id, score, first_word, last_word: texts that hold a copy of an item, edited or not.

    score is the best alignment's share of the item's own score; a row for each text and item of at
    least ``least``, with the words of the text in which the best alignment lies. Punctuation and the
    case of A-Z do not count. NULL or empty texts and items have no hits; items with a NULL id keep it;
    repeated documents each have their rows, repeated items too; empty tables give no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_).cast("long").alias("doc_id"), F.col(text).alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    found = [_scan(rows, block, least) for block in _blocks(items)]
    if not found:
        return spark.createDataFrame([], FOUND)
    for more in found[1:]:
        found[0] = found[0].union(more)
    return found[0]


def _scan(rows: DataFrame, block: Block, least: float) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(block.asked), np.int64)
        for batch in pieces(batches, "text"):
            block.count(words(*flat(batch.column("text")), space=MARKS), total)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["gram", "n"])

    often = np.zeros(len(block.asked), np.int64)
    for r in rows.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        often[r["gram"]] = r["n"]
    block.choose(often, all_=least < LEAST_SCORE)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, bytes], tuple[int, int]] = {}
        for batch in pieces(batches, "text"):
            w = words(*flat(batch.column("text")), space=MARKS)
            best: dict[tuple[int, int], tuple] = {}
            for row, item, lo, hi in block.hits(w):
                lo, hi = max(lo, int(w.first[row])), min(hi, int(w.first[row + 1]))
                window, wanted = w.hash[lo:hi], block.words[item]
                key = (item, window.tobytes())
                if key not in known:
                    if len(known) >= KNOWN:
                        known.clear()
                    known[key] = smith_waterman(wanted, window)
                score, end = known[key]
                share = score / (MATCH * len(wanted))
                if share >= least and share > best.get((row, item), (0,))[0]:
                    best[row, item] = (share, max(lo, lo + end - len(wanted)) - int(w.first[row]), lo + end - 1 - int(w.first[row]))
            ids = batch.column("doc_id")
            hit = list(best)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array([r for r, _ in hit], pa.int64())), pa.array([block.ids[i] for _, i in hit], pa.int64()),
                 *(pa.array([best[x][j] for x in hit], t) for j, t in enumerate((pa.float64(), pa.int64(), pa.int64())))],
                ["doc_id", "item_id", "score", "first_word", "last_word"])

    return rows.mapInArrow(align, FOUND)
