"""Near-duplicate vectors and whitening against numpy."""

import math
import random

import numpy as np
import pytest

from laborlens.llm import rotated, whitening

NAN, INF = float("nan"), float("inf")
KIND = "vec_id long, embedding array<double>, label int, node string, x int, links int"


def brute(rows, least=0.93):
    """(id, n_links, component_id, kept) of rows (id, vector, label)."""
    good = [v is not None and len(v) > 0 and None not in v and all(map(math.isfinite, v)) and any(v) and label is not None
            for _, v, label in rows]
    links = [[] for _ in rows]
    for i, (_, v, a) in enumerate(rows):
        for j, (_, w, b) in enumerate(rows):
            if i != j and good[i] and good[j] and a == b and len(v) == len(w):
                p, q = np.array(v) / max(map(abs, v)), np.array(w) / max(map(abs, w))
                if p @ q / (math.sqrt(p @ p) * math.sqrt(q @ q)) >= least:
                    links[i].append(j)
    out = []
    for i, (id_, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        low = (min(ids) if ids else None) if good[i] else id_
        out.append((id_, len(links[i]), low, id_ == low))
    return sorted(out, key=repr)


def cloud(dim, groups, members, noise, seed):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        middle = rng.normal(size=dim)
        for _ in range(members):
            out.append(((middle + noise * rng.random() * rng.normal(size=dim)) * rng.choice([1, 3.5])).tolist())
    return out


@pytest.mark.parametrize("dim, cell", [(64, 4096), (64, 16), (5, 4096), (200, 30)])
def test_links_equal_brute_force(spark, dim, cell):
    vectors = cloud(dim, 8, 25, 0.5, dim) + cloud(dim, 60, 1, 0, dim + 1)
    rng = random.Random(dim)
    rows = [(i, v, rng.choice([1, 1, 2])) for i, v in enumerate(vectors)]
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(40)]                     # a group of copies
    frame = spark.createDataFrame([(*r, "n", 1, 2) for r in rows], KIND)
    got = rotated.near_vectors(frame, cell=cell)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_links_odd_rows(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.1], 1), (None, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None),
            (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1), (8, [NAN, 1.0], 1), (9, [INF, 1.0], 1), (10, [None, 1.0], 1),
            (11, [1.0], 1), (12, [-1.0], 1), (None, None, 1), (13, [1e300, 1e299], 1), (14, [1e-300, 0.0], 1), (15, [-1.0, 0.0], 1)]
    frame = spark.createDataFrame([(*r, "n", 1, 2) for r in rows], KIND)
    want = sorted([(i, n, c, k if i is not None or c is not None else True) for i, n, c, k in brute(rows)], key=repr)
    assert sorted(map(tuple, rotated.near_vectors(frame).collect()), key=repr) == want
    assert rotated.near_vectors(frame.where("false")).collect() == []


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(4)
    o = rng.normal(size=64)
    q = 0.6 * o / np.linalg.norm(o) + 0.8 * (w := rng.normal(size=64) - 0) / np.linalg.norm(w)
    o, q = o / np.linalg.norm(o), q / np.linalg.norm(q)
    errors = []
    for _ in range(400):
        turn = np.linalg.qr(rng.normal(size=(64, 64)))[0]
        a, b = turn @ o, turn @ q
        x = np.sign(a) / 8
        factor = x @ a
        errors.append(x @ b / factor - o @ q)
        assert x @ b >= math.cos(math.acos(factor) + math.acos(min(1, o @ q))) - 1e-12
    assert abs(np.mean(errors)) < 4 * np.std(errors) / 20


def whitened_by_numpy(x):
    fit = np.unique(x, axis=0)
    c = fit - fit.mean(axis=0)
    e, v = np.linalg.eigh(c.T @ c / len(fit))
    return fit, e[::-1], v[:, ::-1]


@pytest.mark.parametrize("dim, n, block", [(64, 300, 16), (40, 300, 4), (3, 50, 16), (30, 8, 16)])
def test_whitening_equals_eigenvectors(spark, dim, n, block):
    rng = np.random.default_rng(dim)
    data = rng.normal(size=(n, dim)) * np.linspace(1, 3, dim)
    data[-2:] = data[0]
    got = whitening.whiten(spark.createDataFrame([(i, v.tolist(), 1, "n", 1, 2) for i, v in enumerate(data)], KIND), block=block).toPandas()
    x = np.floor(256 * data).astype(np.int64)
    fit, e, v = whitened_by_numpy(x)
    k = min(4, dim, len(fit) - 1)
    assert len(got) == n * k and set(got.n) == {len(fit)} and got.identity_error.max() < 1e-9
    z = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.allclose(np.abs(z), np.abs((x - fit.mean(axis=0)) @ v[:, :k] / np.sqrt(e[:k])), atol=1e-8)
    far = ((len(fit) * x - fit.sum(axis=0)) ** 2).sum(axis=1)
    assert (got[got.component == 1].sort_values("vec_id").deviation.to_numpy() == far).all()
    shares = got.drop_duplicates("component").sort_values("component").explained.to_numpy()
    assert np.allclose(shares, e[:k] / e.sum(), rtol=1e-9)


def test_equal_variances_are_all_found(spark):
    data = [(i, [float(s * (j == i % 6)) for j in range(6)], 1, "n", 1, 2) for i, s in enumerate([1] * 6 + [-1] * 6)]
    got = whitening.whiten(spark.createDataFrame(data, KIND)).toPandas()
    assert set(got.component) == {1, 2, 3, 4} and got.identity_error.max() < 1e-12
    assert np.allclose(got.explained, 1 / 6)


def test_whitening_odd_rows(spark):
    rows = [(1, [1.0, 2.0]), (2, [0.5, 0.1]), (2, [0.5, 0.1]), (None, [3.0, -1.0]), (3, None), (4, []), (5, [NAN, 1.0]), (6, [1.0, INF]),
            (7, [None, 1.0]), (8, [1.0]), (9, [1e6, 1e6])]
    frame = spark.createDataFrame([(i, v, 1, "n", 1, 2) for i, v in rows], KIND)
    got = whitening.whiten(frame.where("vec_id is null or vec_id <> 9")).toPandas()
    # one vector of length 1 has no variance and so no component
    assert sorted(got.vec_id.fillna(-1)) == [-1, -1, 1, 1, 2, 2, 2, 2] and set(got.n) == {3}
    big = whitening.whiten(frame.where("vec_id in (1, 9)")).toPandas()
    assert set(big.vec_id) == {1, 9} and set(big.component) == {1}
    assert set(big.deviation) == {(256000000 - 256) ** 2 + (256000000 - 512) ** 2}
    for empty in (frame.where("false"), frame.where("vec_id = 3")):
        none = whitening.whiten(empty)
        assert none.collect() == [] and none.columns == list(got.columns)
