"""Decontamination finds every text whose alignment reaches half of an item's score: against brute force."""

import random

import numpy as np

from laborlens.llm import decontaminate
from laborlens.llm.words import MARKS, words

RNG = random.Random(5)


def slow_score(a, b):
    """Smith-Waterman, cell by cell."""
    above, best = [0] * (len(b) + 1), 0
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, above[j] + (2 if x == y else -1), above[j + 1] - 1, row[j] - 1))
        best, above = max(best, max(row)), row
    return best


def edit(words, share):
    """Each word is replaced, dropped or followed by another with this probability."""
    out = []
    for word in words:
        kind = RNG.choice("rdi") if RNG.random() < share else ""
        out += {"": [word], "r": [new()], "d": [], "i": [word, new()]}[kind]
    return out


def new():
    return f"n{RNG.randrange(40)}"


def cases():
    """Items of 1 to 40 words with edited copies in other text, and copies whose edits are spread as evenly as can be."""
    items = [[RNG.choice("abcdefghijklmnopqrstuvwxyz") + RNG.choice("xyz") for _ in range(n)]
             for n in (1, 2, 3, 3, 4, 5, 6, 7, 8, 10, 13, 16, 20, 25, 30, 40)]
    texts = []
    for item in items:
        for share in (0.1, 0.2, 0.3, 0.3, 0.5, 0.7):
            texts.append([new() for _ in range(RNG.randrange(50))] + edit(item, share) + [new() for _ in range(RNG.randrange(50))])
        texts.append([x for i, w in enumerate(item) for x in ([w, new()] if i + 1 < len(item) else [w])])
        for step in (2, 3, 4, 5):
            texts.append([new() if i % step == step - 1 else w for i, w in enumerate(item)])
            texts.append([w for i, w in enumerate(item) if i % step != step - 1])
            texts.append([x for i, w in enumerate(item) for x in ([w, new(), new()] if i % step == step - 1 else [w])])
    return items, texts


def test_edited_copies_equal_brute_force(spark):
    items, texts = cases()
    want = {}
    for i, item in enumerate(items):
        for d, text in enumerate(texts):
            share = slow_score(item, text) / (2 * len(item))
            if share >= 0.5:
                want[d, i] = share
    assert len(want) > 200
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string")
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    found = decontaminate.contaminated(docs, frame).collect()
    assert {(r.doc_id, r.item_id): r.score for r in found} == want


def test_bound_on_pairs():
    """Of random alignments none that reaches half of the score has fewer good pairs than least_pairs says."""
    for _ in range(20000):
        n = RNG.randint(4, 30)
        kept = [i for i in range(n) if RNG.random() < RNG.choice((0.5, 0.7, 1))]
        cost = good = 0
        for a, b in zip(kept, kept[1:]):
            added = RNG.choice((0, 1, 2, 2))
            cost += max(b - a - 1, added)
            good += b == a + 1 and added <= 1
        if 2 * len(kept) - cost >= n:
            assert good >= decontaminate.least_pairs(np.array([n]))[0]


def test_hits_do_not_depend_on_how_many_are_held(monkeypatch):
    items, texts = cases()
    block = decontaminate.Block(list(range(len(items))), [" ".join(t).encode() for t in items])
    line = [" ".join(t).encode() for t in texts]
    w = words(np.frombuffer(b"".join(line), np.uint8), np.append(0, np.cumsum([len(t) for t in line])), space=MARKS)
    want = sorted(block.hits(w))
    for held in (1, 3, 50):
        monkeypatch.setattr(decontaminate, "HITS", held)
        assert sorted(block.hits(w)) == want
