"""Near copies by content: sets of word shingles whose exact Jaccard similarity reaches a bound, and their classes.

SimHash and MinHash only propose. Texts whose fingerprints (of all their shingles, repeats included) are linked by op2's
search are a bucket, and so are texts that share a MinHash band: a pair of similarity 0.8 shares none of the 32 bands of 4 with a probability
of (1 - 0.8 ** 4) ** 32 = 5e-8. Only a sketch of each set goes to its buckets: the parity of its hashes in
about one to two cells a shingle. Two sketches differ in at most as many cells as the sets differ in shingles,
so pairs whose sketches differ too much are no link, for certain. What sketches leave connected is one
group; its texts meet once, and their sets themselves are compared. A bucket or group is searched outwards
from its first member: what was reached is not compared again, so n copies of one text cost n comparisons,
and the links that are left out do not change the classes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from laborlens.llm.common import Scratch, components, flat, pieces
from laborlens.llm.simhash import fingerprint, fingerprint_classes
from laborlens.llm.words import mix, words

SHINGLE = 5
LEAST = (4, 5)            # similarity of a link, as a fraction
BANDS, ROWS = 32, 4
#: A bucket with more members, or more shingles, is compared in parts: each part with itself and each other.
GROUP, GROUP_SHINGLES = 20_000, 4_000_000
FOLD = np.uint64(0xD6E8FEB86659FD93)
TURNS = np.random.Generator(np.random.PCG64(20240611)).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of texts that lie one after the other, sorted in each, and where each text's start.

    A text of fewer than ``n`` words is one shingle; a text without words has none.
    """
    w = words(data, offsets)
    count = np.diff(w.first)
    rows, hashes = [], []
    for k in range(1, n + 1):
        at = np.flatnonzero((count[w.doc] == k) & (w.first[w.doc] == np.arange(len(w.doc)))) if k < n \
            else np.flatnonzero(w.first[w.doc + 1] - np.arange(len(w.doc)) >= n)
        h = np.full(len(at), k, np.uint64)
        for i in range(k):
            h = h * FOLD + w.hash[at + i]
        rows.append(w.doc[at])
        hashes.append(mix(h))
    row, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.append(True, (np.diff(row) != 0) | (h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
    return h[new], np.searchsorted(row[new], np.arange(len(offsets)))


def _nodes(h: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """One hash for each set; the empty set's too."""
    total = np.append(np.uint64(0), np.cumsum(mix(h + np.uint64(1)), dtype=np.uint64))
    return mix(total[cut[1:]] - total[cut[:-1]] + np.diff(cut).astype(np.uint64)).view(np.int64)


def _bands(h: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """A row of BANDS keys for each set that is not empty."""
    start = cut[:-1][np.diff(cut) > 0]
    keys = np.zeros((len(start), BANDS), np.int64)
    for band in range(BANDS if len(start) else 0):
        key = np.full(len(start), band, np.uint64)
        for turn in TURNS[band * ROWS:(band + 1) * ROWS]:
            key = key * FOLD + np.minimum.reduceat(h * turn, start)
        keys[:, band] = mix(key).view(np.int64)
    return keys


def similar(one: np.ndarray, h: np.ndarray, cut: np.ndarray, least: tuple[int, int] = LEAST) -> np.ndarray:
    """Which of the sets in (h, cut) have a Jaccard similarity of at least ``least`` with a sorted set; none is empty."""
    at = np.searchsorted(one, h).clip(max=len(one) - 1)
    both = np.add.reduceat(one[at] == h, cut[:-1], dtype=np.int64)
    return both * (least[0] + least[1]) >= least[0] * (len(one) + np.diff(cut))


def sketches(h: np.ndarray, cut: np.ndarray) -> list[np.ndarray]:
    """For each set the parity of its hashes in a power of two of cells, at least 64 and at least one a hash; bit i is cell i."""
    size = np.diff(cut)
    cells = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    start = np.append(0, np.cumsum(cells))
    at = (h & np.repeat(cells - 1, size).astype(np.uint64)).astype(np.int64) + np.repeat(start[:-1], size)
    odd = (np.bincount(at, minlength=start[-1]) & 1).astype(np.uint8)
    packed = np.packbits(odd, bitorder="little").view("<u8")
    return [packed[a:b] for a, b in zip((start[:-1] // 64).tolist(), (start[1:] // 64).tolist())]


def apart(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """In how many shingles a sketch's set and those of a matrix of sketches differ at least."""
    while len(one) > many.shape[1]:
        one = one[:len(one) // 2] ^ one[len(one) // 2:]
    while many.shape[1] > len(one):
        many = many[:, :many.shape[1] // 2] ^ many[:, many.shape[1] // 2:]
    return np.bitwise_count(many ^ one).sum(axis=1, dtype=np.int64)


def outwards(size: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray], least: tuple[int, int]) -> list[tuple[int, int]]:
    """Pairs of indices whose links give the classes of all links; ``near(a, others)`` says which others a is linked to."""
    found, left, todo = [], np.arange(len(size)), []
    while len(left):
        if not todo:
            todo, left = [int(left[0])], left[1:]
            continue
        a = todo.pop()
        close = (size[left] * least[1] >= least[0] * size[a]) & (size[a] * least[1] >= least[0] * size[left])
        asked = left[close]
        if len(asked):
            hit = np.zeros(len(left), bool)
            hit[close] = near(a, asked)
            new = left[hit].tolist()
            found += [(a, b) for b in new]
            todo += new
            left = left[~hit]
    return found


def search(sets: list[np.ndarray], least: tuple[int, int] = LEAST) -> list[tuple[int, int]]:
    """Links of sorted sets, enough for their classes."""
    size = np.array([len(s) for s in sets])
    return outwards(size, lambda a, asked: similar(
        sets[a], np.concatenate([sets[i] for i in asked]), np.append(0, np.cumsum(size[asked])), least), least)


def search_sketches(size: np.ndarray, found: list[np.ndarray], least: tuple[int, int] = LEAST) -> list[tuple[int, int]]:
    """Pairs that hold together all sets that may be linked, by sketches of sets of ``size``."""
    length = np.array([len(x) for x in found])
    place, same = np.zeros(len(found), np.int64), {}
    for n in np.unique(length).tolist():
        at = np.flatnonzero(length == n)
        place[at], same[n] = np.arange(len(at)), np.stack([found[i] for i in at])

    def near(a: int, asked: np.ndarray) -> np.ndarray:
        out = np.zeros(len(asked), bool)
        for n in np.unique(length[asked]).tolist():     # two at most, as linked sizes differ by less than a half
            of = np.flatnonzero(length[asked] == n)
            differ = apart(found[a], same[n][place[asked[of]]])
            out[of] = differ * (least[0] + least[1]) <= (least[1] - least[0]) * (size[a] + size[asked[of]])
        return out

    return outwards(size, near, least)


def _groups(rows: Iterator[tuple], pairs_of: Callable[[list], list[tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of each group; rows (key, cell, node, member) come sorted by key and cell."""
    now, nodes, held = None, [], []

    def links() -> pa.RecordBatch:
        pairs = pairs_of(held)
        return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in pairs], pa.int64()),
                                           pa.array([nodes[j] for _, j in pairs], pa.int64())], ["a", "b"])

    for key, cell, node, member in rows:
        if (key, cell) != now:
            if len(nodes) > 1:
                yield links()
            now, nodes, held = (key, cell), [], []
        nodes.append(node)
        held.append(member)
    if len(nodes) > 1:
        yield links()


def _in_cells(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """key, cell, node: groups beyond the bounds are dealt in parts, each with itself and with each other part.

    ``members`` holds (key, node), ``sizes`` (key, n members, size in shingles).
    """
    parts = F.greatest(F.ceil(F.col("n") / GROUP), F.ceil(F.col("size") / GROUP_SHINGLES)).cast("int")
    dealt = members.select("key", "node").join(sizes.select("key", parts.alias("parts")), "key") \
        .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    return dealt.select("key", "node", "parts", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")) \
        .select("key", "node", (F.least("part", "other").cast("long") * F.col("parts") + F.greatest("part", "other")).alias("cell"))


def by_fingerprint(scratch: Scratch, marks: DataFrame) -> DataFrame:
    """node, size, key: sets with words whose fingerprints are linked, or equal, have one key."""
    marked = marks.where("size > 0").select("node", "size", "fingerprint").distinct()
    classes = fingerprint_classes(scratch, marked, "fingerprints").withColumnRenamed("fingerprint", "linked")
    held = marked.join(classes, F.col("fingerprint") == F.col("linked"), "left")
    return held.select("node", "size", F.xxhash64(F.coalesce("component", "fingerprint"), F.lit(0)).alias("key")).distinct()


def with_node(docs: DataFrame, name: str, text: str = "text", n: int = SHINGLE) -> DataFrame:
    """``docs`` with the hash of each text's shingles as column ``name``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            yield batch.append_column(name, pa.array(_nodes(*shingles(*flat(batch.column(text)), n))))

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))


def first_copies(docs: DataFrame, id_: str = "doc_id", text: str = "text", n: int = SHINGLE,
                 least: tuple[int, int] = LEAST) -> DataFrame:
    """One row of ``docs`` for each class of near copies, whole and with its columns.

    It is a row with the smallest id of the class (NULL only where the class has no other), and of that id's rows
    one whose text has the smallest shingle hash; of rows that agree in both any one. Texts that are
    NULL or without words are copies of each other.
    """
    keep = near_copies(docs, id_, text, n, least, node="node").where(F.col("doc_id").eqNullSafe(F.col("component_id"))) \
        .groupBy("component_id", "class").agg(F.min("node").alias("node")).select("component_id", "node")
    name = "node"
    while name in docs.columns:
        name += "_"
    marked = with_node(docs, name, text, n)
    kept = marked.join(keep.withColumnsRenamed({"component_id": "_kept_id", "node": "_kept_node"}), F.col(id_).eqNullSafe(
        F.col("_kept_id")) & (F.col(name) == F.col("_kept_node")), "left_semi")
    return kept.dropDuplicates([id_, name]).drop(name)


def near_copies(docs: DataFrame, id_: str = "doc_id", text: str = "text", n: int = SHINGLE,
                least: tuple[int, int] = LEAST, node: str | None = None) -> DataFrame:
    """doc_id, component_id: the smallest id reachable over links of texts whose ``n``-word shingles are similar.

    One row for each row of ``docs``; with ``node`` also a column of that name, the hash of the text's shingles,
    and ``class``, the same number for all rows of a class. Texts with equal shingles are one class, so are NULL texts and texts
    without words; rows with a NULL id take part but are never the smallest; other columns do not matter.
    """
    scratch = Scratch(docs.sparkSession, "similar")
    rows = docs.select(F.col(id_).alias("doc_id"), F.col(text).alias("text"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            h, cut = shingles(*flat(batch.column("text")), n)
            size = np.diff(cut)
            keys = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum((size > 0) * BANDS)), pa.int32()),
                                            pa.array(_bands(h, cut).ravel()))
            held = pa.array([x.tobytes() for x in sketches(h, cut)], pa.binary())
            marks = np.array([fingerprint((t.as_py() or "").encode(), n) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(_nodes(h, cut)), pa.array(size), keys, held, pa.array(marks.view(np.int64))],
                ["doc_id", "node", "size", "keys", "sketch", "fingerprint"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [pa.array(_nodes(*shingles(*flat(batch.column("text")), n))), batch.column("text")], ["node", "text"])

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = ((key, cell, node, (size, np.frombuffer(sketch.as_buffer(), "<u8"))) for batch in batches
                   for key, cell, node, size, sketch in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4)))
        return _groups(members, lambda held: search_sketches(np.array([m[0] for m in held]), [m[1] for m in held], least))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def members() -> Iterator[tuple]:
            for batch in pieces(batches, "text"):
                h, cut = shingles(*flat(batch.column("text")), n)
                yield from zip(*(batch.column(i).to_pylist() for i in range(3)), (h[a:b].copy() for a, b in zip(cut[:-1], cut[1:])))
        return _groups(members(), lambda held: search(held, least))

    id_type = rows.schema["doc_id"].dataType.simpleString()
    marks = scratch.save(rows.mapInArrow(
        mark, f"doc_id {id_type}, node long, size long, keys array<long>, sketch binary, fingerprint long"), "marks")
    nodes = scratch.save(marks.groupBy("node").agg(F.min("doc_id").alias("low"), F.first("size").alias("size"), F.first(
        "keys").alias("keys"), F.first("sketch").alias("sketch")), "nodes")
    keyed = nodes.select("node", "size", F.explode("keys").alias("key")).union(
        scratch.save(by_fingerprint(scratch, marks), "by_fingerprint"))
    # copies of one text meet in most bands with the same members: one such bucket is enough
    buckets = scratch.save(keyed.groupBy("key").agg(
        F.count("*").alias("n"), F.sum("size").alias("size"), F.bit_xor(F.xxhash64("node")).alias("x"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).where("n > 1").groupBy("n", "size", "x", "y")
        .agg(F.min("key").alias("key")), "buckets")
    members = scratch.save(keyed.join(buckets.select("key"), "key"), "members")

    order = ["key", "cell", "node"]
    sent = _in_cells(members, buckets).join(nodes.select("node", "size", "sketch"), "node") \
        .select(*order, "size", "sketch").repartition("key", "cell").sortWithinPartitions(*order)
    groups = scratch.save(components(scratch, sent.mapInArrow(maybe, "a long, b long"), "candidates"), "groups")
    # a group whose texts are too many for a task meets by buckets again, which are dealt in parts
    bounds = groups.join(nodes.select("node", "size"), "node").groupBy(F.col("component").alias("key")).agg(
        F.count("*").alias("n"), F.sum("size").alias("size"))
    fits = (F.col("n") <= GROUP) & (F.col("size") <= GROUP_SHINGLES)
    held = scratch.save(groups.join(bounds.select(F.col("key").alias("component"), fits.alias("fits")), "component"), "held")
    by_bucket = scratch.save(members.join(held.where("not fits"), "node").select(
        F.xxhash64("key", "component").alias("key"), "node", "size"), "by_bucket")
    split = _in_cells(by_bucket, by_bucket.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("size")).where("n > 1"))
    cells = held.where("fits").select(F.col("component").alias("key"), "node", F.lit(0).cast("long").alias("cell")).union(
        split.select("key", "node", "cell"))
    # only texts that share a group are sent, and one of those with equal shingles
    texts = rows.mapInArrow(whole, "node long, text string").join(held.select("node"), "node", "left_semi") \
        .groupBy("node").agg(F.first("text").alias("text"))
    dealt = cells.join(texts, "node").select(*order, "text").repartition("key", "cell").sortWithinPartitions(*order)
    found = components(scratch, dealt.mapInArrow(link, "a long, b long")).withColumnRenamed("node", "linked")
    near = nodes.select("node", "low").join(found, F.col("node") == F.col("linked"), "left") \
        .withColumn("component", F.coalesce("component", "node"))
    lows = near.groupBy("component").agg(F.min("low").alias("component_id"))
    classes = near.join(lows, "component").select("node", "component_id", F.col("component").alias("class"))
    every = marks.select("doc_id", "node").join(classes, "node")
    return every.select("doc_id", "component_id", *([F.col("node").alias(node), "class"] if node else []))
