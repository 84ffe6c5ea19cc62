"""Exact top-k inner products with multi-resolution segment statistics.

Vectors are cut into segments; means and deviations of a segment bound its part of the inner
product: sum(q x) <= n (mean_q mean_x + dev_q dev_x). (With fixed norms this is the lower bound of
the squared distance.) One segment is tried first, then finer cuts for what survives the k-th best
score so far, and exact products decide the rest. A tie with the k-th best always survives.
Query blocks meet blocks of all rows: each cell of the grid is one bounded task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEGMENTS = (1, 4, 16)
QUERY_BLOCK, ROW_BLOCK, AT_ONCE = 2048, 8192, 128
EXACT = 2.0 ** 52       # beyond it doubles are not exact and Python integers are used


def _statistics(rows: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations by segment, each times the square root of the segment's length."""
    cuts = np.unique(np.linspace(0, rows.shape[1], segments + 1).astype(int))[:-1]
    length = np.diff(np.append(cuts, rows.shape[1]))
    mean = np.add.reduceat(rows, cuts, axis=1) / length
    square = np.add.reduceat(rows * rows, cuts, axis=1) / length
    return mean * np.sqrt(length), np.sqrt(np.maximum(square - mean * mean, 0) * length)


def top_products(queries: np.ndarray, rows: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> tuple:
    """Of each query the k best rows by (score descending, id): indices of query and row, and scores.

    own[q] lists rows that a query must not find, as pairs (query, row).
    """
    if not len(queries) or not len(rows) or not rows.shape[1]:
        none = np.zeros(0, np.int64)
        return none, none, none
    exact = np.abs(queries).max() * np.abs(rows).max() * rows.shape[1] < EXACT
    if not exact:
        big = [[int(v) for v in r] for r in rows]
    row_stats = [_statistics(rows, s) for s in SEGMENTS if s <= rows.shape[1]]
    found = []
    for lo in range(0, len(queries), AT_ONCE):
        block = queries[lo:lo + AT_ONCE]
        stats = [_statistics(block, s) for s in SEGMENTS if s <= rows.shape[1]]
        barred = own[(own[:, 0] >= lo) & (own[:, 0] < lo + len(block))]

        def bound(level: int, q: np.ndarray | slice, r: np.ndarray | slice, pairs: bool) -> np.ndarray:
            (qm, qd), (rm, rd) = stats[level], row_stats[level]
            if pairs:
                b = np.einsum("ij,ij->i", qm[q], rm[r]) + np.einsum("ij,ij->i", qd[q], rd[r])
            else:
                b = qm @ rm.T + qd @ rd.T
            return b + 1e-9 * np.abs(b) + 1e-6

        def products(q: np.ndarray, r: np.ndarray) -> np.ndarray:
            if exact:
                return np.einsum("ij,ij->i", block[q], rows[r])
            return np.array([sum(int(x) * y for x, y in zip(block[a], big[b])) for a, b in zip(q, r)], object)

        coarse = bound(0, slice(None), slice(None), False)
        coarse[barred[:, 0] - lo, barred[:, 1]] = -np.inf
        tried = min(len(rows), 4 * k + 8)
        first = np.argpartition(-coarse, tried - 1, axis=1)[:, :tried]
        q = np.repeat(np.arange(len(block)), tried)
        scores = products(q, first.ravel()).reshape(len(block), tried).astype(float)
        scores[~np.isfinite(np.take_along_axis(coarse, first, axis=1))] = -np.inf
        floor = np.sort(scores, axis=1)[:, ::-1][:, k - 1] if tried >= k else np.full(len(block), -np.inf)
        if not exact:
            floor = floor - 1e-6 * np.abs(floor)
        q, r = np.nonzero((coarse >= floor[:, None]) & np.isfinite(coarse))
        for level in range(1, len(stats)):
            left = []
            for i in range(0, len(q), 1 << 17):
                a, b = q[i:i + (1 << 17)], r[i:i + (1 << 17)]
                left.append(bound(level, a, b, True) >= floor[a])
            keep = np.concatenate(left) if left else np.zeros(0, bool)
            q, r = q[keep], r[keep]
        s = np.concatenate([products(q[i:i + (1 << 17)], r[i:i + (1 << 17)]) for i in range(0, len(q), 1 << 17)]
                           or [np.zeros(0)])
        order = np.lexsort((ids[r], -s, q)) if exact else np.array(
            sorted(range(len(q)), key=lambda i: (q[i], -s[i], ids[r[i]])), int)
        q, r, s = q[order], r[order], s[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        best = rank < k
        found.append((q[best] + lo, r[best], s[best].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found))


def exact_top_k(rows: DataFrame, k: int = 5, every: int = 50, scale: int = 256,
                id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best inner products of integer vectors floor(scale * x).

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but the query's
    own. Ties go to the smaller id. Vectors that are NULL, empty, hold NULL or non-finite components,
    or have no id take no part; a vector meets those of its own length. Rows equal in id and vector
    are one row; other rows of one id are different rows. Scores beyond a long are an error.
    """
    x = F.col(vector)
    fine = (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(x, lambda v: F.floor(scale * v.cast("double")).cast("double"))
    clean = (rows.where(F.col(id_).isNotNull() & fine).select(F.col(id_).alias("vec_id"), whole.alias("v")).distinct()
             .withColumns({"dim": F.size("v"), "mark": F.xxhash64("v")}))
    asked = clean.where(F.col("vec_id") % every == 0)
    n, m = clean.count(), asked.count()
    row_cells, query_cells = max(1, -(-n // ROW_BLOCK)), max(1, -(-m // QUERY_BLOCK))
    left = asked.withColumn("r", F.pmod(F.xxhash64("vec_id", "mark"), F.lit(query_cells))).withColumn(
        "c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_cells - 1).cast("long"))))
    right = clean.withColumn("c", F.pmod(F.xxhash64("vec_id", "mark", F.lit(1)), F.lit(row_cells))).withColumn(
        "r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_cells - 1).cast("long"))))

    def cell(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "query_mark", "vec_id", "score"]
        if q.empty or c.empty:
            return pd.DataFrame({n: pd.Series(dtype="int64") for n in names})
        ids, marks = c.vec_id.to_numpy(), c.mark.to_numpy()
        own = q[["vec_id", "mark"]].reset_index(drop=True).reset_index(names="q").merge(
            c[["vec_id", "mark"]].reset_index(drop=True).reset_index(names="c"), on=["vec_id", "mark"])
        a, b, s = top_products(np.stack(q.v.to_numpy()), np.stack(c.v.to_numpy()), own[["q", "c"]].to_numpy(), ids, k)
        return pd.DataFrame({"query_id": q.vec_id.to_numpy()[a], "query_mark": q.mark.to_numpy()[a],
                             "vec_id": ids[b], "score": s})

    cells = left.groupBy("dim", "r", "c").cogroup(right.groupBy("dim", "r", "c")).applyInPandas(
        cell, "query_id long, query_mark long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query_mark").orderBy(F.desc("score"), "vec_id")
    return (cells.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
