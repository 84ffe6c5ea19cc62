"""Whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

One scan of the rows multiplies a block of vectors by X and the result by X-transposed, row block by row block;
only sums as small as dimensions x block leave a task. The recurrence is the block form: X V = U R with an
upper block-bidiagonal R. U has a column entry for every row and is never written: its blocks are U = X P, so
that inner products with U follow from X'U, and both bases are orthogonalised in full, twice. The singular
values of the small R are the deviations, V times its right vectors are the components. A block of at least as
many vectors as are wanted finds equal eigenvalues too, and dimensions / block scans end the recurrence.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlens.llm.common import Scratch

COMPONENTS, SCALE, BLOCK = 4, 256, 16
SEED = 20240613
#: Directions whose variance is below this share of the largest are rounding noise and no components.
NOISE = 1e-12
CONVERGED = 1e-14


class Model(NamedTuple):
    n: int                      # rows of the fit list
    sums: list[int]
    components: np.ndarray      # dimensions x components
    variances: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _summed(rows: DataFrame, run, kind: str) -> dict[int, object]:
    """Sums by position of what ``run`` gives for each batch; a task adds its batches up before the shuffle."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = run(batch)
                total = part if total is None else total + part
        if total is not None:
            values = [Decimal(int(v)) for v in total] if kind.startswith("decimal") else total
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total)), pa.int32()),
                 pa.array(values, pa.decimal128(38, 0) if kind.startswith("decimal") else pa.float64())], ["at", "value"])

    parts = rows.mapInArrow(task, f"at int, value {kind}")
    return {r["at"]: r["value"] for r in parts.groupBy("at").agg(F.sum("value").alias("value")).collect()}


def exact_sums(fit: DataFrame, dim: int) -> tuple[int, list[int], int]:
    """n, sum of each dimension, and sum of all squares: whole numbers of any size."""
    def run(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch.column("x"), dim)
        if np.abs(x).max() >= 2.0 ** 20:
            x = x.astype(object)
        return np.array([len(x), *x.sum(axis=0), (x * x).sum()], object)

    found = _summed(fit, run, "decimal(38,0)")
    return int(found[0]), [int(found[i + 1]) for i in range(dim)], int(found[dim + 1])


def _products(fit: DataFrame, mean: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """T'T and X'T of T = X c, for the centred rows X."""
    dim, b = c.shape

    def run(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch.column("x"), dim) - mean
        t = x @ c
        return np.concatenate([(t.T @ t).ravel(), (x.T @ t).ravel()])

    found = _summed(fit, run, "double")
    flat = np.array([found[i] for i in range(b * b + dim * b)])
    return flat[:b * b].reshape(b, b), flat[b * b:].reshape(dim, b)


def _orthogonal(v: np.ndarray, against: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """An orthonormal basis of v's part outside ``against``, and the coefficients of v in it; rounding noise is no part."""
    v = v.copy()
    for _ in range(2):
        v -= against @ (against.T @ v)
    left, s, right = np.linalg.svd(v, full_matrices=False)
    keep = s > scale * 1e-11
    q = left[:, keep]
    for _ in range(2):
        q -= against @ (against.T @ q)
        q = np.linalg.qr(q)[0] if q.shape[1] else q
    return q, q.T @ v


def bidiagonalise(products, dim: int, wanted: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right singular vectors (columns) of the rows X, by falling value.

    ``products(c)`` gives T'T and X'T of T = X c. Stops when the wanted triples have converged, or V is whole.
    """
    block = min(dim, max(block, wanted))
    v = np.linalg.qr(np.random.Generator(np.random.PCG64(SEED)).normal(size=(dim, block)))[0]
    basis, ps, ws, r = v, [], [], np.zeros((0, 0))
    coupling, top = None, 0.0
    while True:
        # T = X v - U_last coupling, as X c
        c = v if coupling is None else v - ps[-1] @ coupling
        for _ in range(2):
            for p, w in zip(ps, ws):
                c = c - p @ (w.T @ c)
        gram, w = products(c)
        size, turn = np.linalg.eigh(gram)
        top = max(top, size.max(initial=0.0))
        keep = size > top * NOISE
        if not keep.any():
            a = np.zeros((0, v.shape[1]))
            p, w = np.zeros((dim, 0)), np.zeros((dim, 0))
        else:
            root = np.sqrt(size[keep])
            turn = turn[:, keep]
            a = root[:, None] * turn.T
            p, w = c @ (turn / root), w @ (turn / root)
        # a row block of R below the others: the coupling above the new diagonal block
        grown = np.zeros((r.shape[0] + a.shape[0], r.shape[1] + a.shape[1]))
        grown[:r.shape[0], :r.shape[1]] = r
        if coupling is not None:
            grown[r.shape[0] - coupling.shape[0]:r.shape[0], r.shape[1]:] = coupling
        grown[r.shape[0]:, r.shape[1]:] = a
        r = grown
        ps.append(p)
        ws.append(w)
        left, s, right = np.linalg.svd(r, full_matrices=False)
        if not a.shape[0] or basis.shape[1] >= dim:
            break
        v, b = _orthogonal(w, basis, np.sqrt(top))
        if not v.shape[1]:
            break
        coupling = b.T
        ends = np.linalg.norm(b @ left[-a.shape[0]:, :wanted], axis=0)
        if len(s) >= wanted and ends.max() <= CONVERGED * s[0]:
            break
        basis = np.concatenate([basis, v], axis=1)
    return s, basis[:, :right.shape[1]] @ right.T


def fit_model(fit: DataFrame, dim: int, components: int = COMPONENTS, block: int = BLOCK) -> Model:
    """The components of a fit list of distinct vectors x."""
    n, sums, squares = exact_sums(fit, dim)
    mean = np.array([s / n for s in sums])
    spread = n * squares - sum(s * s for s in sums)          # n * n * trace of the covariance, exact
    s, v = bidiagonalise(lambda c: _products(fit, mean, c), dim, min(components, dim), block) if spread else \
        (np.zeros(0), np.zeros((dim, 0)))
    variances = s * s / n
    k = int((variances[:components] > NOISE * variances[0]).sum()) if len(s) else 0
    return Model(n, sums, v[:, :k], variances[:k], spread / n / n)


def identity_error(fit: DataFrame, model: Model) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity."""
    k, mean, axes = len(model.variances), model.mean, model.components / np.sqrt(model.variances)

    def run(batch: pa.RecordBatch) -> np.ndarray:
        z = (_matrix(batch.column("x"), len(mean)) - mean) @ axes
        return np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])

    found = _summed(fit, run, "double")
    flat = np.array([found[i] for i in range(k + k * k)])
    middle = flat[:k] / model.n
    return float(np.abs(flat[k:].reshape(k, k) / model.n - np.outer(middle, middle) - np.eye(k)).max())


def whitened(rows: DataFrame, model: Model, error: float) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each row (vec_id, x) and component."""
    k, n, mean, dim = len(model.variances), model.n, model.mean, len(model.sums)
    axes = model.components / np.sqrt(model.variances)
    explained = model.variances / model.trace
    sums = np.array(model.sums, object)
    most = max(map(abs, model.sums))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"), dim)
            z = (x - mean) @ axes
            small = (n * int(np.abs(x).max()) + most) ** 2 * dim < 1 << 62
            apart = n * x - sums.astype(np.int64) if small else n * x.astype(object) - sums
            far = (apart * apart).sum(axis=1)
            m = len(x)
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n), pa.int64()),
                pa.array(np.repeat(far, k).tolist(), pa.int64()), pa.array(z.ravel()), pa.array(np.tile(explained, m)),
                pa.array(np.full(m * k, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, "
                                "explained double, identity_error double")


def whiten(rows: DataFrame, components: int = COMPONENTS, scale: int = SCALE, block: int = BLOCK,
           id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Each vector of whole numbers floor(scale * x), whitened along its first principal components.

    Vectors that are NULL, empty, or hold NULL or non-finite components take no part. The fit list has each distinct
    vector once; repeated rows and rows with a NULL id are whitened each. Vectors of one length are a fit of their
    own. A fit without variance has no components and so gives no rows, likewise components whose variance is
    below NOISE times the first's. An empty table gives an empty result. A deviation beyond a long is an error.
    """
    scratch = Scratch(rows.sparkSession, "whitening")
    x = F.col(vector)
    fine = (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(scale * c.cast("double")).cast("long"))
    clean = scratch.save(rows.where(fine).select(F.col(id_).alias("vec_id"), whole.alias("x"))
                         .withColumn("dim", F.size("x")), "rows")
    fit = scratch.save(clean.select("dim", "x").distinct(), "fit")
    out = None
    for dim in sorted(r["dim"] for r in fit.select("dim").distinct().collect()):
        mine = fit.where(F.col("dim") == dim).select("x")
        model = fit_model(mine, dim, components, block)
        if len(model.variances):
            found = whitened(clean.where(F.col("dim") == dim).select("vec_id", "x"), model, identity_error(mine, model))
            out = found if out is None else out.union(found)
    if out is None:
        out = clean.select("vec_id", F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"),
                           F.lit(0).cast("long").alias("deviation"), F.lit(0.0).alias("whitened"),
                           F.lit(0.0).alias("explained"), F.lit(0.0).alias("identity_error")).where("false")
    return out
