"""Near copies of the pipeline against brute force: 5-word shingles, Jaccard similarity of at least 0.8."""

import random

import numpy as np
import pytest

import corpus_pipeline
from laborlens.llm import simhash, similar
from laborlens.llm.common import Scratch, table

RNG = random.Random(11)
WORDS = [f"v{i}" for i in range(400)]


def brute_classes(texts):
    sets = {}
    for d, t in texts:
        found = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
        sets[d] = {tuple(found[i:i + 5]) for i in range(len(found) - 4)} or ({tuple(found)} if found else set())
    label = {d: d for d in sets}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            x, y = sets[a], sets[b]
            if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y) and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {d: new if c == old else c for d, c in label.items()}
    return label


def edited():
    """Texts with one, two or five changed words each, chains of edits, copies, short and empty ones."""
    out = []
    for _ in range(12):
        words = [RNG.choice(WORDS) for _ in range(RNG.randint(30, 140))]
        for edits in (0, 1, 1, 2, 3, 5):
            if RNG.random() < 0.5:
                words = list(words)
            for _ in range(edits):
                words[RNG.randrange(len(words))] = RNG.choice(WORDS)
            out.append(" ".join(words))
    out += ["a b c", "A  b\tc", "a b", "a b c d e", "a b c d e f", "", None, " "]
    RNG.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("group", [similar.GROUP, 3])
def test_near_copies_equal_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(similar, "GROUP", group)
    texts = edited()
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want = brute_classes(texts)
    assert len(set(want.values())) < len(texts) - 20
    assert {r.doc_id: r.component_id for r in similar.near_copies(docs).collect()} == want


def test_near_copies_odd_rows(spark):
    docs = spark.createDataFrame([(None, "x y z"), (4, "x y z"), (4, "x y z"), (7, None), (8, ""), (None, "alone")],
                                 "doc_id long, text string")
    found = sorted(map(tuple, similar.near_copies(docs).collect()), key=repr)
    assert found == sorted([(None, 4), (4, 4), (4, 4), (7, 7), (8, 7), (None, None)], key=repr)
    assert similar.near_copies(docs.limit(0)).count() == 0


def test_bound_is_exact():
    one = np.arange(9, dtype=np.uint64)
    others = [np.arange(1, 9, dtype=np.uint64), np.arange(1, 10, dtype=np.uint64), np.arange(2, 9, dtype=np.uint64)]
    cut = np.append(0, np.cumsum([len(x) for x in others]))
    assert similar.similar(one, np.concatenate(others), cut).tolist() == [True, True, False]


def test_stage_drops_all_near_copies(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    want = brute_classes([(r.doc_id, r.text) for r in docs.collect()])
    assert len(set(want.values())) == 922
    stage = dict(corpus_pipeline.STAGES)["near_copies"]
    assert {r.doc_id for r in stage(spark, docs, "").collect()} == set(want.values())


def test_sketches_never_hide_a_link():
    """The bound of two sketches is never above the true difference, at any two sizes, and tells far sets apart."""
    rng = np.random.default_rng(5)
    for size in (1, 40, 64, 65, 300, 5000):
        base = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        for changed in (0, 1, size // 10, size // 2, size):
            other = np.unique(np.append(base[changed:], rng.integers(0, 1 << 63, changed + size // 8, dtype=np.uint64)))
            cut = np.array([0, len(base), len(base) + len(other)])
            a, b = similar.sketches(np.append(base, other), cut)
            true = len(np.setxor1d(base, other))
            assert similar.apart(a, b[None])[0] == similar.apart(b, a[None])[0] <= true
    far = np.sort(rng.integers(0, 1 << 63, 600, dtype=np.uint64))
    half = np.sort(np.append(far[:342], rng.integers(0, 1 << 63, 258, dtype=np.uint64)))         # similarity 0.4
    found = similar.sketches(np.append(far, half), np.array([0, 600, 1200]))
    assert similar.search_sketches(np.array([600, 600]), found) == []


def test_first_copies_keeps_one_row_of_a_class(spark):
    """NULL ids, repeated rows, one id with two texts, clashing columns; each class keeps exactly one row."""
    rows = [(None, "x y z", 1), (4, "x y z", 1), (4, "x y z", 1), (7, None, 1), (8, "", 1), (None, "alone", 1),
            (4, "another text of its own", 1), (9, "another text of its own", 1), (None, "alone", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int")
    found = similar.first_copies(docs)
    assert found.columns == docs.columns
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(
        [(4, "x y z", 1), (7, None, 1), (None, "alone", 1), (4, "another text of its own", 1)], key=repr)
    assert similar.first_copies(docs.limit(0)).count() == 0


def test_fingerprints_propose(spark, monkeypatch):
    """op2's fingerprints alone (no bands) lead to near copies; sets decide, so a fingerprint of a far text is no link."""
    monkeypatch.setattr(similar, "_bands", lambda h, cut: np.random.default_rng(len(h)).integers(
        -1 << 62, 1 << 62, (int((np.diff(cut) > 0).sum()), similar.BANDS)))
    words = [f"w{i}" for i in range(900)]
    near = words[:]
    near[450] = "other"
    texts = [" ".join(words), " ".join(near), " ".join(words), " ".join(words[::-1]), "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    bits = [simhash.fingerprint((t or "").encode(), similar.SHINGLE) for t in texts]
    assert 0 < (bits[0] ^ bits[1]).bit_count() <= simhash.RADIUS
    marks = spark.createDataFrame([(1, 5, 0b0), (2, 5, 0b111), (3, 5, 0b111111), (4, 5, (1 << 63) - 1), (5, 5, 0), (6, 0, 0)],
                                  "node long, size long, fingerprint long")
    keys = {r.node: r.key for r in similar.by_fingerprint(Scratch(spark, "test"), marks).collect()}
    assert keys[1] == keys[2] == keys[3] == keys[5] != keys[4] and 6 not in keys
    got = {r.doc_id: r.component_id for r in similar.near_copies(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4}
