"""Near-duplicate vectors by randomised-rotation binary codes with stored correction factors.

A unit vector o is rotated at random; its code is the vector x of signs, and its factor is <x, o>, stored with it.
For another vector q, <x, q> / <x, o> is an unbiased estimate of <o, q>. The angle between x and o bounds the
error: <o, q> >= s implies <x, q> >= cos(arccos s + arccos <x, o>), the widest confidence bound, which
never errs. Pairs within it are recomputed in double precision, the others are dropped.

Candidates share the signs of a band of code bits. The bits of a band grow with the logarithm of the rows, the
number of bands such that a pair at the bound shares none with a probability of MISS. Buckets first see narrow
rows (id and 128 sign bits): a pair is taken in the first band that it shares, and only vectors with a
partner there travel. Counts of links and a spanning set of links leave a bucket, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlens.llm.common import Scratch, components
from laborlens.llm.simhash import _merge

LEAST = 0.93
MISS = 1e-6
SEED = 20240612
BITS = 128                # sign bits of a narrow row
FEW = 64                  # rows of a bucket that share a band by chance
CELL = 4096               # a larger bucket is met in parts: each part with itself and each other
AT_ONCE = 512


def rotation(dim: int) -> np.ndarray:
    """Random rotations, one below the other, of at least BITS rows in all; the first ``dim`` rows are one rotation."""
    rng = np.random.Generator(np.random.PCG64([SEED, dim]))
    return np.concatenate([np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(-(-BITS // dim))])


class Bands:
    """Which of the BITS bits make a band, as two masks of 64 bits for each band."""

    def __init__(self, rows: int, least: float):
        same = 1 - math.acos(least) / math.pi             # that one bit agrees, at the bound
        self.width = min(24, max(4, math.ceil(math.log2(max(rows, 1) / FEW)))) if rows > FEW else 4
        self.count = max(1, math.ceil(math.log(MISS) / math.log(1 - same ** self.width))) if same < 1 else 1
        rng = np.random.Generator(np.random.PCG64([SEED, 1]))
        chosen = np.stack([rng.choice(BITS, self.width, replace=False) for _ in range(self.count)])
        bit = np.zeros((self.count, BITS), np.uint8)
        np.put_along_axis(bit, chosen, 1, axis=1)
        self.masks = np.packbits(bit, axis=1).view(np.uint64)
        # more differing bits than a pair at the bound has, by six standard deviations
        self.limit = math.ceil(BITS * (1 - same) + 6 * math.sqrt(BITS * same * (1 - same)))

    def partners(self, a: np.ndarray, b: np.ndarray, band: int) -> np.ndarray:
        """Which pairs of code rows have few differing bits, and share this band as their first."""
        one, two = a[:, None, 0] ^ b[None, :, 0], a[:, None, 1] ^ b[None, :, 1]
        near = np.bitwise_count(one).astype(np.int16) + np.bitwise_count(two) <= self.limit
        i, j = np.nonzero(near)
        one, two = one[i, j], two[i, j]
        low, high = self.masks[band]
        i, j, one, two = (x[(((one & low) | (two & high)) == 0)] for x in (i, j, one, two))
        for low, high in self.masks[:band]:
            apart = ((one & low) | (two & high)) != 0
            i, j, one, two = (x[apart] for x in (i, j, one, two))
        out = np.zeros(near.shape, bool)
        out[i, j] = True
        return out


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _encode(dim: int, bands: Bands):
    turn = rotation(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y = _unit(_vectors(batch.column("vector"), dim)) @ turn.T
            signs = y >= 0
            code = np.packbits(signs[:, :BITS], axis=1).view(np.uint64)
            factor = np.abs(y[:, :dim]).sum(axis=1) / math.sqrt(dim)
            # of each band the sign bits in it, and its number
            keys = np.stack([(code[:, 0] & low) * np.uint64(0x9E3779B97F4A7C15) ^ (code[:, 1] & high) * np.uint64(0xD6E8FEB86659FD93)
                             for low, high in bands.masks], axis=1).view(np.int64)
            own = np.packbits(signs[:, :dim], axis=1)
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c) for c in ("node", "label", "vector", "copies", "low")),
                pa.array(code[:, 0].view(np.int64)), pa.array(code[:, 1].view(np.int64)), pa.array([c.tobytes() for c in own], pa.binary()),
                pa.array(factor), pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands.count), pa.int32()),
                                                           pa.array(keys.ravel()))],
                ["node", "label", "vector", "copies", "low", "one", "two", "code", "factor", "keys"])

    return run


def _cells(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.Table]:
    """The rows of each (bucket, cell), which come sorted by these."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("bucket").to_numpy(), batch.column("cell").to_numpy()
        cuts = np.flatnonzero((key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            part = batch.slice(lo, hi - lo)
            if held and (held[-1].column("bucket")[0], held[-1].column("cell")[0]) != (part.column("bucket")[0], part.column("cell")[0]):
                yield pa.Table.from_batches(held).select(columns).combine_chunks()
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held).select(columns).combine_chunks()


def _sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Indices of the two sides of a cell, and whether they are the same part."""
    part = t.column("part").to_numpy()
    own = bool((part == part[0]).all())
    first = np.flatnonzero(part == part.min())
    return first, first if own else np.flatnonzero(part != part.min()), own


def _active(bands: Bands):
    """(bucket, cell, part, band, node) of the rows with a partner in their bucket."""
    names = ["bucket", "cell", "part", "band", "node", "one", "two", "diagonal"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _cells(batches, names):
            a, b, own = _sides(t)
            if own and (not t.column("diagonal")[0].as_py() or len(a) < 2):
                continue
            codes = np.stack([t.column(c).to_numpy().view(np.uint64) for c in ("one", "two")], axis=1)
            band, live = t.column("band")[0].as_py(), np.zeros(len(t), bool)
            for lo in range(0, len(a), AT_ONCE):
                rows = a[lo:lo + AT_ONCE]
                hit = bands.partners(codes[rows], codes[b], band)
                if own:
                    hit[np.arange(len(rows)), lo + np.arange(len(rows))] = False
                live[rows] |= hit.any(axis=1)
                live[b] |= hit.any(axis=0)
            if live.any():
                yield t.filter(pa.array(live)).select(names[:-1]).combine_chunks().to_batches()[0]

    return run


def _linked(bands: Bands, dim: int, least: float):
    """node, other, links: with ``other`` a link of a spanning set, without it how many vectors the node has links with."""
    turn = rotation(dim)[:dim]
    names = ["bucket", "cell", "part", "band", "node", "one", "two", "vector", "copies", "code", "factor"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _cells(batches, names):
            a, b, own = _sides(t)
            codes = np.stack([t.column(c).to_numpy().view(np.uint64) for c in ("one", "two")], axis=1)
            band, node, copies = t.column("band")[0].as_py(), t.column("node").to_numpy(), t.column("copies").to_numpy()
            raw = _vectors(t.column("vector").combine_chunks(), dim)
            raw = raw / np.abs(raw).max(axis=1, keepdims=True)
            norm = np.sqrt((raw * raw).sum(axis=1))
            y = (raw / norm[:, None]) @ turn.T
            signs = np.unpackbits(np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(len(t), -1),
                                  axis=1)[:, :dim] * (2 / math.sqrt(dim)) - 1 / math.sqrt(dim)
            factor = t.column("factor").to_numpy()
            # the lowest estimate that a pair at the bound can have
            floor = np.cos(np.minimum(np.arccos(np.clip(factor, -1, 1)) + math.acos(least), math.pi)) / factor - 1e-9
            links, label = np.zeros(len(t), np.int64), np.arange(len(t))
            for lo in range(0, len(a), AT_ONCE):
                rows = a[lo:lo + AT_ONCE]
                hit = bands.partners(codes[rows], codes[b], band)
                if own:
                    hit[np.arange(len(rows)), lo + np.arange(len(rows))] = False
                hit &= (signs[rows] @ y[b].T) / factor[rows][:, None] >= floor[rows][:, None]
                hit &= (y[rows] @ signs[b].T) / factor[b][None, :] >= floor[b][None, :]
                i, j = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
                if not len(i):
                    continue
                p, q = rows[i], b[j]
                cosine = (raw[p] @ raw[q].T) / (norm[p][:, None] * norm[q][None, :])
                found = hit[np.ix_(i, j)] & (cosine >= least)
                links[p] += found @ copies[q]
                if not own:
                    links[q] += found.T @ copies[p]
                x, z = np.nonzero(found)
                _merge(label, p[x], q[z])
            has, apart = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(label)))
            if len(has):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([node[has], node[apart]])),
                    pa.array(np.concatenate([node[has], node[label[apart]]]),
                             mask=np.arange(len(has) + len(apart)) < len(has)),
                    pa.array(np.concatenate([links[has], np.zeros(len(apart), np.int64)]))], ["node", "other", "links"])

    return run


def _dealt(rows: DataFrame, parts: DataFrame, *columns: str) -> DataFrame:
    """Rows with ``part``, ``cell`` and ``diagonal``: a bucket of several parts is a grid of cells of two parts each."""
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    met = rows.join(parts, "bucket").withColumn("part", part).withColumn(
        "other", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    return met.select("bucket", (low.cast("long") * F.col("parts") + high).alias("cell"), "part",
                      (low == high).alias("diagonal"), *columns)


def near_vectors(rows: DataFrame, least: float = LEAST, id_: str = "vec_id", vector: str = "embedding",
                 label: str = "label", cell: int = CELL) -> DataFrame:
    """vec_id, n_links, component_id, kept: links between vectors of one label whose cosine is at least ``least``.

    One row for each row of ``rows``; each row counts as a vector. Vectors that are NULL, empty, zero or hold NULL or
    non-finite components, and those with a NULL label, link with nothing; so do vectors of different lengths. Rows with
    a NULL id link, but are never the smallest id. Equal vectors of a label are compared once and count as many.
    ``kept``: the row's id is its component's. Other columns do not matter; an empty table gives an empty result.
    """
    scratch = Scratch(rows.sparkSession, "rotated")
    x = F.col(vector)
    fine = F.col(label).isNotNull() & (F.size(x) > 0) & F.exists(x, lambda v: v != 0) & \
        F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    given = rows.select(F.col(id_).alias("vec_id"), F.col(label).alias("label"), x.alias("vector"),
                        F.when(fine, F.xxhash64(F.lit(1), label, vector)).alias("node"))
    classes = scratch.save(given.where("node is not null").groupBy("node").agg(
        F.first("label").alias("label"), F.first("vector").alias("vector"), F.count("*").alias("copies"),
        F.min("vec_id").alias("low")).withColumn("dim", F.size("vector")), "classes")
    sizes = classes.groupBy("label", "dim").count().groupBy("dim").agg(F.max("count").alias("most")).collect()
    found = None
    for dim, most in sorted((r["dim"], r["most"]) for r in sizes):
        links = _links(scratch, classes.where(F.col("dim") == dim), dim, Bands(most, least), least, cell)
        found = links if found is None else found.union(links)
    if found is None:
        found = scratch.spark.createDataFrame([], "node long, other long, links long")
    counts = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    group = components(scratch, found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    near = classes.select("node", "copies", "low").join(counts, "node", "left").join(group, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    lows = near.groupBy("component").agg(F.min("low").alias("component_id"))
    known = near.join(lows, "component").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "component_id")
    out = given.select("vec_id", "node").join(known, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.col("vec_id").eqNullSafe(component).alias("kept"))


def _links(scratch: Scratch, classes: DataFrame, dim: int, bands: Bands, least: float, cell: int) -> DataFrame:
    kind = classes.schema["label"].dataType.simpleString()
    value = classes.schema["vector"].dataType.simpleString()
    coded = scratch.save(classes.select("node", "label", "vector", "copies", "low").mapInArrow(
        _encode(dim, bands), f"node long, label {kind}, vector {value}, copies long, low long, one long, two long, "
                             "code binary, factor double, keys array<long>"), f"coded-{dim}")
    narrow = coded.select("node", "one", "two", F.posexplode("keys").alias("band", "key"), "label").select(
        F.xxhash64("label", "band", "key").alias("bucket"), "band", "node", "one", "two")
    sizes = narrow.groupBy("bucket").count().where("count > 1")
    parts = scratch.save(sizes.select("bucket", F.ceil(F.col("count") / cell).alias("parts")), f"parts-{dim}")
    order = ["bucket", "cell", "part", "node"]
    dealt = _dealt(narrow, parts, "band", "node", "one", "two").repartition("bucket", "cell").sortWithinPartitions(*order)
    active = scratch.save(dealt.mapInArrow(
        _active(bands), "bucket long, cell long, part int, band int, node long, one long, two long"), f"active-{dim}")
    whole = active.join(coded.select("node", "vector", "copies", "code", "factor"), "node")
    return scratch.save(whole.repartition("bucket", "cell").sortWithinPartitions(*order).mapInArrow(
        _linked(bands, dim, least), "node long, other long, links long"), f"links-{dim}")
