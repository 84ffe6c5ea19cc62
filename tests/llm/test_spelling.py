"""Spelling variants against brute force."""

import random
import zlib

import pytest

from laborlens.llm import spelling


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1:] == b[i + 1:]
    a, b = max(a, b, key=len), min(a, b, key=len)
    return a[i + 1:] == b[i:]


def brute(counts):
    out = {}
    for word, n in counts.items():
        near = [t for t in counts if one_edit(word, t)]
        form = min(near, key=lambda t: (-counts[t], t), default=None)
        form = form if form and counts[form] >= 10 * n else None
        out[word] = (form, n, len(near), counts.get(form))
    rows = []
    for word, (form, n, near, form_n) in out.items():
        root = word
        while out[root][0]:
            root = out[root][0]
        rows.append((word, form, root, n, near, form_n))
    return sorted(rows, key=repr)


def vocabulary(seed):
    rng = random.Random(seed)
    letters = "abcé÷"
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(7, 9))) for _ in range(120)}
    for word in sorted(words):
        for _ in range(3):
            i, c = rng.randrange(len(word) + 1), rng.choice(letters)
            words.add(rng.choice([word[:i] + word[i + 1:], word[:i] + c + word[i:], word[:i] + c + word[i + 1:]]))
    long = "x" * 31 + "y" * 40
    words |= {long, long[1:], long[:-1], long + "z", "q" + long, long[:30] + "b" + long[31:], "z" * 3000, "z" * 2999, "z" * 3000 + "a"}
    words |= {"x" * n for n in range(7, 36)} | {"x" * 31 + "y", "x" * 30 + "y", "aaaaaaa", "aaaaaab", "baaaaaa"}
    return {w: rng.choice([2, 3, 25, 250, 2500, 2500]) for w in words if len(w) >= 7}


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_equal_brute_force(spark, seed):
    counts = vocabulary(seed)
    got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(counts)


def test_word_counts(spark):
    import re
    texts = [(1, "Recieve receive RECEIVE naïveté Naïveté×, receive"), (None, "receive naïveté×"), (2, None), (3, ""), (4, "x" * 4000 + " receive"),
             (4, "x" * 4000 + " receive"), (5, "short words")] + [(i, "thousands thousands") for i in range(10, 200)]
    want = {}
    for id_, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if id_ is None else id_}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                want[run] = want.get(run, 0) + 1
    frame = spark.createDataFrame([(i, t, "w", 1) for i, t in texts], "doc_id long, text string, word string, n int")
    got = spelling.word_counts(frame)
    assert dict(map(tuple, got.collect())) == {w: n for w, n in want.items() if n >= 2}


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.word_counts(none)).collect() == []
    one = spark.createDataFrame([("nothing", 3)], "word string, n long")
    assert list(map(tuple, spelling.variants(one).collect())) == [("nothing", None, "nothing", 3, 0, None)]
