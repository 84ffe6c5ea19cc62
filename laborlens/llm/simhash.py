"""SimHash near-duplicates: fingerprints, a binary trie self-join, components.

Two fingerprints within 3 bits agree in at least two of five blocks of bits, so each fingerprint
goes to the ten groups named by two of its blocks. Inside a group the sorted fingerprints are a
binary trie whose nodes are ranges: pairs of nodes are walked down together, bit by bit, their
differing bits add up, and a pair beyond the budget is dropped with all that lies below it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlens.llm.common import Scratch, components, pieces

RADIUS = 3
SEED = 42
#: First bit and width of the blocks.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
PAIRS = tuple(combinations(range(len(BLOCKS)), 2))
#: A group with more fingerprints is split once more, by quarters of the bits outside its two blocks.
GROUP = 20_000
FRONT = 1 << 19           # node pairs walked at once
CHUNK = 200_000           # fingerprints walked at once, if the group itself is not larger


def fingerprint(text: bytes, n: int = 3) -> int:
    """The 64-bit SimHash of a text's n-word shingles, repeats included; no word: 0."""
    found = text.lower().split()
    if not found:
        return 0
    if len(found) < n:
        hashes = [xxhash.xxh64_intdigest(b" ".join(found), SEED)]
    else:
        line = b" ".join(found)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        starts = np.append(0, ends[:-1] + 1)
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts[:len(found) - n + 1].tolist(), ends[n - 1:].tolist())]
    values = np.array(hashes, ">u8")
    votes = np.zeros(64, np.int64)
    for i in range(0, len(values), 1 << 14):
        votes += np.unpackbits(values[i:i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(values)).tobytes(), "big")


def simhash(docs: DataFrame, text: str = "text", n: int = 3) -> DataFrame:
    """The rows with a long column ``fingerprint`` in place of the text (NULL text counts as empty)."""
    rest = docs.drop("fingerprint").select(*[c for c in docs.columns if c not in (text, "fingerprint")], text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            marks = [fingerprint((t.as_py() or "").encode(), n) for t in batch.column(text)]
            cut = batch.drop_columns([text])
            yield pa.RecordBatch.from_arrays(
                [*cut.columns, pa.array(np.array(marks, np.uint64).view(np.int64))], [*cut.schema.names, "fingerprint"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema if f.name != text)
    return rest.mapInArrow(run, f"{schema}, fingerprint long")


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite a[i] and b[i]; label leads to the smallest index of a set."""
    while len(a):
        a, b = label[a], label[b]
        differ = a != b
        a, b = a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label[:] = jumped


def trie_join(values: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Of fingerprints sorted by (group, value), distinct in a group: the index of the smallest one
    reachable over links of at most ``radius`` differing bits inside the group."""
    label = np.arange(len(values))
    start = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(values) else label
    end = np.append(start[1:], len(values))
    more = end - start > 1
    none = np.zeros(0, np.int64)
    stack = [(63, start[more], end[more], none, none, none, none, none)]
    while stack:
        bit, lo, hi, a_lo, a_hi, b_lo, b_hi, diff = stack.pop()
        if len(a_lo) > FRONT:
            half = len(a_lo) // 2
            stack.append((bit, none, none, a_lo[half:], a_hi[half:], b_lo[half:], b_hi[half:], diff[half:]))
            stack.append((bit, lo, hi, a_lo[:half], a_hi[:half], b_lo[:half], b_hi[:half], diff[:half]))
            continue
        leaf = (a_hi - a_lo == 1) & (b_hi - b_lo == 1)
        if leaf.any():
            a, b = a_lo[leaf], b_lo[leaf]
            near = np.bitwise_count(values[a] ^ values[b]) <= radius
            _merge(label, a[near], b[near])
            a_lo, a_hi, b_lo, b_hi, diff = (x[~leaf] for x in (a_lo, a_hi, b_lo, b_hi, diff))
        if bit < 0 or not (len(lo) or len(a_lo)):
            continue
        ones = np.append(0, np.cumsum((values >> np.uint64(bit)) & np.uint64(1), dtype=np.int64))
        mid = hi - (ones[hi] - ones[lo])
        a_mid, b_mid = a_hi - (ones[a_hi] - ones[a_lo]), b_hi - (ones[b_hi] - ones[b_lo])
        own = np.concatenate([np.stack([lo, mid]), np.stack([mid, hi])], axis=1)
        own = own[:, own[1] - own[0] > 1]
        zeros = np.zeros_like
        pairs = np.concatenate([
            np.stack([lo, mid, mid, hi, zeros(lo) + 1]),
            np.stack([a_lo, a_mid, b_lo, b_mid, diff]), np.stack([a_mid, a_hi, b_mid, b_hi, diff]),
            np.stack([a_lo, a_mid, b_mid, b_hi, diff + 1]), np.stack([a_mid, a_hi, b_lo, b_mid, diff + 1])], axis=1)
        pairs = pairs[:, (pairs[1] > pairs[0]) & (pairs[3] > pairs[2]) & (pairs[4] <= radius)]
        stack.append((bit - 1, *own, *pairs))
    _merge(label, np.arange(len(label)), label.copy())
    return label


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) that span each group's links; rows come sorted by (key, sub, fingerprint)."""
    kept: list[np.ndarray] = []
    held = 0

    def edges(rows: np.ndarray) -> pa.RecordBatch:
        new = (np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)
        values = rows[2].view(np.uint64)
        order_group = np.append(0, np.cumsum(new))
        order = np.lexsort((values, order_group))
        values, order_group = values[order], order_group[order]
        label = trie_join(values, order_group)
        found = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(values[found].view(np.int64)),
                                           pa.array(values[label[found]].view(np.int64))], ["a", "b"])

    for batch in batches:
        kept.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
        held += batch.num_rows
        if held >= CHUNK:
            rows = np.concatenate(kept, axis=1)
            last = np.flatnonzero((rows[0] != rows[0, -1]) | (rows[1] != rows[1, -1]))
            cut = last[-1] + 1 if len(last) else 0          # the last group may go on in the next batch
            if cut:
                yield edges(rows[:, :cut])
            kept, held = [rows[:, cut:]], rows.shape[1] - cut
    if held:
        yield edges(np.concatenate(kept, axis=1))


def links(fingerprints: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints; their components are those of all links within RADIUS."""
    def block(i: int) -> str:
        return f"(shiftrightunsigned(fingerprint, {BLOCKS[i][0]}) & {(1 << BLOCKS[i][1]) - 1})"

    def rest(i: int, j: int) -> str:
        """Quarters of the 38 or 39 bits outside blocks i and j: of the budget of 3 one has none."""
        bits = [b for k, (at, width) in enumerate(BLOCKS) if k not in (i, j) for b in range(at, at + width)]
        out = []
        for q in range(4):
            mask = sum(1 << b for b in bits[len(bits) * q // 4:len(bits) * (q + 1) // 4])
            mask -= (1 << 64) * (mask >> 63)
            out.append(f"xxhash64({q}, fingerprint & {mask}L)")
        return f"array({', '.join(out)})"

    keys = F.expr("inline(array(%s))" % ", ".join(
        f"struct(({k} * {1 << 26}L + {block(i)} * {1 << 13}L + {block(j)}) as key, {rest(i, j)} as quarters)"
        for k, (i, j) in enumerate(PAIRS)))
    keyed = fingerprints.select("fingerprint").distinct().select("fingerprint", keys)
    hot = keyed.groupBy("key").count().where(F.col("count") > GROUP).select("key", F.lit(True).alias("hot"))
    subs = keyed.join(hot, "key", "left").select(
        "key", F.explode(F.when(F.col("hot"), F.col("quarters")).otherwise(F.array(F.lit(0).cast("long")))).alias("sub"),
        "fingerprint")
    dealt = subs.repartition("key", "sub").sortWithinPartitions("key", "sub", "fingerprint")
    return dealt.mapInArrow(_walk, "a long, b long")


def fingerprint_classes(scratch: Scratch, fingerprints: DataFrame, keep: str = "components") -> DataFrame:
    """fingerprint, component: for each fingerprint within RADIUS bits of another one the smallest reachable one."""
    return components(scratch, links(fingerprints), keep).withColumnRenamed("node", "fingerprint")


def near_duplicates(docs: DataFrame, id_: str = "doc_id", text: str = "text", n: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest id reachable over links.

    One row for each row of ``docs``. NULL text is empty (fingerprint 0, linked like any other);
    rows with a NULL id take part but are never the smallest; repeated rows share a class; other
    columns do not matter; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    marks = scratch.save(simhash(docs.select(F.col(id_).alias("doc_id"), F.col(text).alias("text")), n=n), "marks")
    least = scratch.save(marks.groupBy("fingerprint").agg(F.min("doc_id").alias("low")), "distinct")
    found = fingerprint_classes(scratch, least)
    near = least.join(found, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    lows = near.groupBy("component").agg(F.min("low").alias("component_id"))
    classes = near.join(lows, "component").select("fingerprint", "component_id")
    return marks.join(classes, "fingerprint").select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
