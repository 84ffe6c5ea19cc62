"""Inverted lists for exact vector search: what a cell's or a code's bound excludes is never read.

Vectors lie in the cell of their nearest centre, with the angle to it, and as a code: one byte a component and the
length of what the bytes leave out. A query first reads the codes of the cells nearest to it. Its k-th best lower
bound is a floor. Other cells are read only where the triangle of query, centre and the cell's angles allows a
similarity above the floor, and whole vectors only where the code does. Equal vectors are one entry.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from laborlens.session import cut_lineage

#: The centres are fitted on so many distinct vectors, those of smallest hash; every vector is then assigned.
SAMPLE = 20_000
MOST_CELLS = 4096
ITERATIONS = 1
ITEM_BLOCK, QUERY_BLOCK = 16_384, 2048          # entries and queries that a task holds of a cell
AT_ONCE = 256
SLACK = 2e-9                                    # distances are rounded to nine digits


class Lists(NamedTuple):
    """The index of all vectors of one length."""
    dims: int
    centres: np.ndarray      # one row a cell, at most MOST_CELLS
    sizes: np.ndarray        # of each cell: entries, smallest and largest angle to the centre
    low: np.ndarray
    high: np.ndarray
    codes: DataFrame         # cell, part, entry, code, scale, rest
    vectors: DataFrame       # entry, vector
    members: DataFrame       # entry, item_id


def with_vector(rows: DataFrame) -> DataFrame:
    """Rows whose embedding is not NULL or empty and holds no NULL or non-finite component."""
    return rows.where("size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL "
                      "AND NOT isnan(x) AND abs(x) < double('infinity'))")


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def unit_rows(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def _packed(m: np.ndarray) -> pa.Array:
    """Rows as binary values."""
    ends = np.arange(len(m) + 1, dtype=np.int32) * (m.shape[1] * m.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(m))])


def _unpacked(column: pa.ChunkedArray, kind, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dims)


def _fit(sample: DataFrame, dims: int, cells: int) -> np.ndarray:
    """Centres by rounds of partial sums: a task sends one value a cell and component, the driver gets as many in all."""
    first = sample.orderBy("entry").limit(cells).select("vector").collect()
    centres = unit_rows(np.array([r["vector"] for r in first], np.float64))
    for _ in range(ITERATIONS if cells > 1 else 0):
        def partial(batches: Iterator[pa.RecordBatch], centres=centres) -> Iterator[pa.RecordBatch]:
            sums = np.zeros_like(centres)
            for batch in batches:
                x = unit_rows(_matrix(batch.column("vector"), dims))
                np.add.at(sums, (x @ centres.T).argmax(axis=1), x)
            used = np.flatnonzero(np.abs(sums).sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(list(sums[used]), pa.list_(pa.float64()))],
                                             ["cell", "sums"])

        parts = sample.select("vector").mapInArrow(partial, "cell int, sums array<double>")
        total = parts.select("cell", F.posexplode("sums").alias("at", "value")).groupBy("cell", "at").agg(F.sum("value").alias("value"))
        moved = np.zeros_like(centres)
        summed = total.toArrow()
        moved[summed.column("cell").to_numpy(), summed.column("at").to_numpy()] = summed.column("value").to_numpy()
        moved = unit_rows(moved)
        centres = np.where(np.abs(moved).sum(axis=1, keepdims=True) > 0, moved, centres)
    return centres


def build_lists(corpus: DataFrame) -> list[Lists]:
    """An index of (item_id, embedding) for each length of vector; a row without a usable vector is in none."""
    usable = cut_lineage(with_vector(corpus.select("item_id", "embedding")).withColumn("entry", F.xxhash64("embedding")), "items")
    distinct = cut_lineage(usable.groupBy("entry").agg(F.first("embedding").alias("vector"), F.size(F.first("embedding")).alias("dims")),
                           "vectors")
    lists = []
    for dims, n in sorted(map(tuple, distinct.groupBy("dims").count().collect())):
        mine = distinct.where(F.col("dims") == dims).select("entry", "vector")
        cells = min(MOST_CELLS, max(1, math.isqrt(n)))
        chosen = mine.orderBy(F.xxhash64("entry")).limit(SAMPLE) if n > SAMPLE else mine
        centres = _fit(chosen, dims, cells)

        def assign(batches: Iterator[pa.RecordBatch], centres=centres, dims=dims) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = unit_rows(_matrix(batch.column("vector"), dims))
                near = x @ centres.T
                cell = near.argmax(axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(x)), cell], -1, 1))
                scale = np.abs(x).max(axis=1) / 127
                code = np.rint(np.divide(x, scale[:, None], out=np.zeros_like(x), where=scale[:, None] > 0)).astype(np.int8)
                rest = np.linalg.norm(x - code * scale[:, None], axis=1) + 1e-12
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell.astype(np.int32)), batch.column("entry"), _packed(code), pa.array(scale), pa.array(rest), pa.array(angle)],
                    ["cell", "entry", "code", "scale", "rest", "angle"])

        codes = cut_lineage(mine.mapInArrow(assign, "cell int, entry long, code binary, scale double, rest double, angle double"), "codes")
        sizes, low, high = np.zeros(len(centres), np.int64), np.zeros(len(centres)), np.zeros(len(centres))
        for r in codes.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect():
            sizes[r["cell"]], low[r["cell"]], high[r["cell"]] = r["n"], r["low"], r["high"]
        parts = F.element_at(F.array(*[F.lit(int(-(-s // ITEM_BLOCK)) or 1) for s in sizes]), F.col("cell") + 1) \
            if sizes.max() > ITEM_BLOCK else F.lit(1)
        codes = codes.select("cell", F.pmod(F.xxhash64("entry"), parts).cast("int").alias("part"), "entry", "code", "scale", "rest", "angle")
        lists.append(Lists(dims, centres, sizes, low, high, codes, mine, usable.where(F.size("embedding") == dims).select("entry", "item_id")))
    return lists


def _reach(lists: Lists, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each query and cell: angle to the centre, and the highest similarity that an entry can have."""
    angle = np.arccos(np.clip(x @ lists.centres.T, -1, 1))
    least = np.maximum(np.maximum(angle - lists.high, lists.low - angle), 0)
    best = np.cos(np.minimum(least, math.pi)) + 1e-9
    best[:, lists.sizes == 0] = -np.inf
    return angle, best


def _probes(lists: Lists, k: int, first: bool):
    """(cell, part, ask, vector, floor): the cells that a query reads first, or those that its floor leaves open."""
    centres, sizes = lists.centres, lists.sizes
    bare = lists._replace(codes=None, vectors=None, members=None)
    parts = np.maximum(1, -(-sizes // ITEM_BLOCK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit_rows(_matrix(batch.column("vector"), bare.dims))
            angle, best = _reach(bare, x)
            # first: the nearest cells that hold k entries together
            order = np.argsort(np.where(sizes > 0, angle, np.inf), axis=1, kind="stable")
            before = np.cumsum(sizes[order], axis=1) - sizes[order]
            near = np.zeros(best.shape, bool)
            np.put_along_axis(near, order, (before < k) & (sizes[order] > 0), axis=1)
            if first:
                floor, chosen = np.full(len(x), -2.0), near
            else:
                floor = batch.column("floor").to_numpy(zero_copy_only=False)
                chosen = ~near & (best >= floor[:, None] - SLACK) & (sizes > 0)
            ask, cell = np.nonzero(chosen)
            times = parts[cell]
            ask, cell = np.repeat(ask, times), np.repeat(cell, times)
            part = np.arange(len(ask)) - np.repeat(np.cumsum(times) - times, times)
            for lo in range(0, len(ask), 1 << 14):
                a = ask[lo:lo + (1 << 14)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell[lo:lo + (1 << 14)].astype(np.int32)), pa.array(part[lo:lo + (1 << 14)].astype(np.int32)),
                     batch.column("ask").take(pa.array(a)), _packed(x[a]), pa.array(floor[a])],
                    ["cell", "part", "ask", "vector", "floor"])

    return run


def _candidates(lists: Lists, probes: DataFrame, k: int, block: int) -> DataFrame:
    """ask, entry, low, high, compared: entries whose highest similarity reaches the floor that the task can prove."""
    dims = lists.dims
    blocks = probes.groupBy("cell", "part").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = probes.join(blocks, ["cell", "part"]).withColumn("block", F.pmod(F.xxhash64("ask"), "blocks").cast("int"))
    across = blocks.select("cell", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    held = lists.codes.join(across, ["cell", "part"]).toDF("in_cell", "in_part", "entry", "code", "scale", "rest", "angle", "in_block")

    def meet(asked: pa.Table, stored: pa.Table) -> pa.Table:
        names = {"ask": pa.int64(), "entry": pa.int64(), "low": pa.float64(), "high": pa.float64(), "compared": pa.int64()}
        found: list[pa.Table] = []
        if asked.num_rows and stored.num_rows:
            x = _unpacked(stored.column("code"), np.int8, dims) * stored.column("scale").to_numpy()[:, None]
            rest, entry = stored.column("rest").to_numpy(), stored.column("entry").to_numpy()
            queries, ask = _unpacked(asked.column("vector"), np.float64, dims), asked.column("ask").to_numpy()
            floors = asked.column("floor").to_numpy()
            for lo in range(0, len(ask), AT_ONCE):
                near = queries[lo:lo + AT_ONCE] @ x.T
                floor = floors[lo:lo + AT_ONCE]
                if len(x) >= k:
                    floor = np.maximum(floor, np.partition(near - rest, len(x) - k, axis=1)[:, len(x) - k])
                i, j = np.nonzero(near + rest >= floor[:, None] - SLACK)
                # one row says how many codes the query met here
                count = np.where(np.append(True, i[1:] != i[:-1]), len(x), 0) if len(i) else np.zeros(0, np.int64)
                found.append(pa.table([ask[lo + i], entry[j], (near[i, j] - rest[j]), (near[i, j] + rest[j]), count], list(names)))
        return pa.concat_tables(found).cast(pa.schema(names.items())) if found else pa.schema(names.items()).empty_table()

    return dealt.groupBy("cell", "part", "block").cogroup(held.groupBy("in_cell", "in_part", "in_block")).applyInArrow(
        meet, "ask long, entry long, low double, high double, compared long")


def _floors(found: DataFrame, k: int) -> DataFrame:
    """ask, floor: the k-th best lower bound of each query, where it has k."""
    best = W.partitionBy("ask").orderBy(F.desc("low"))
    top = found.select("ask", "low", F.row_number().over(best).alias("place")).where(F.col("place") <= k)
    return top.where(F.col("place") == k).select("ask", F.col("low").alias("floor"))


def _search(lists: Lists, asked: DataFrame, k: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Matches (ask, item_id, distance), and all candidates."""
    dims = lists.dims
    probe = "cell int, part int, ask long, vector binary, floor double"
    first = cut_lineage(_candidates(lists, asked.mapInArrow(_probes(lists, k, True), probe), k, block), "first")
    open_ = asked.join(_floors(first, k), "ask", "left").select("ask", "vector", F.coalesce("floor", F.lit(-2.0)).alias("floor"))
    further = _candidates(lists, open_.mapInArrow(_probes(lists, k, False), probe), k, block)
    found = cut_lineage(first.union(further), "candidates")
    alive = (found.join(_floors(found, k), "ask", "left")
             .where(F.col("floor").isNull() | (F.col("high") >= F.col("floor") - SLACK)).select("ask", "entry"))
    whole = (alive.join(lists.vectors, "entry")
             .join(asked.select("ask", F.col("vector").alias("asked")), "ask").select("ask", "entry", "vector", "asked"))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, q = (unit_rows(_matrix(batch.column(c), dims)) for c in ("vector", "asked"))
            yield pa.RecordBatch.from_arrays([batch.column("ask"), batch.column("entry"),
                                              pa.array((1.0 - np.einsum("ij,ij->i", x, q)).round(9))], ["ask", "entry", "distance"])

    near = whole.mapInArrow(exact, "ask long, entry long, distance double")
    # of equal vectors the k smallest ids can be results
    own = W.partitionBy("entry").orderBy("item_id")
    members = lists.members.withColumn("place", F.row_number().over(own)).where(F.col("place") <= k).drop("place")
    return near.join(members, "entry").select("ask", "item_id", "distance"), \
        found.groupBy("ask").agg(F.sum("compared").alias("codes_read")).join(alive.groupBy("ask").agg(F.count("*").alias("vectors_read")), "ask")


def search_lists(index: list[Lists], queries: DataFrame, k: int = 4, block: int = QUERY_BLOCK) -> tuple[DataFrame, DataFrame]:
    """The k nearest items of each query (query_id, embedding) by cosine distance, exact, and what was read for it.

    (query_id, item_id, distance, rank), ties to the smaller id; and (query_id, codes_read, vectors_read) for each
    query with a direction. Vectors meet those of their own length; to a vector of zeros, and for a query of zeros, the
    distance is 1. Rows of queries that share an id share a ranking, as before.
    """
    spark = queries.sparkSession
    asked = cut_lineage(with_vector(queries.select("query_id", "embedding")).withColumn("ask", F.xxhash64("embedding")), "queries")
    distinct = asked.groupBy("ask").agg(F.first("embedding").alias("vector"))
    zero = F.forall("vector", lambda v: v == 0)
    matches = spark.createDataFrame([], "ask long, item_id long, distance double")
    reads = spark.createDataFrame([], "ask long, codes_read long, vectors_read long")
    for lists in index:
        mine = distinct.where(F.size("vector") == lists.dims)
        found, read = _search(lists, mine.where(~zero), k, block)
        # every item is as far from a vector of zeros: the k smallest ids
        low = lists.members.select("item_id").orderBy("item_id").limit(k).agg(F.collect_list("item_id").alias("items"))
        none = (mine.where(zero).withColumn("all", F.lit(1)).join(low.withColumn("all", F.lit(1)), "all")
                .select("ask", F.explode("items").alias("item_id"), F.lit(1.0).alias("distance")))
        matches, reads = matches.union(found).union(none), reads.union(read)
    order = W.partitionBy("query_id").orderBy("distance", "item_id")
    ranked = (asked.select("query_id", "ask").join(matches, "ask").select("query_id", "item_id", "distance")
              .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    return ranked, asked.select("query_id", "ask").join(reads, "ask").drop("ask")
