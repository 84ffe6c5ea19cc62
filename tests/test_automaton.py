"""The lexicon automaton against the patterns themselves."""

import random
import re

import numpy as np
import pytest

from laborlens.operators import automaton, skills

RNG = random.Random(12)
ALPHABET = "abc+# _.é"


def brute(texts, lexicon, boundary):
    def pattern(skill):
        if boundary == "token":
            return rf"(?<![A-Za-z0-9_]){re.escape(skill)}(?![A-Za-z0-9_+#])"
        return rf"\b{re.escape(skill)}\b"
    tests = [(s, re.compile(pattern(s), re.ASCII)) for s in set(lexicon) if s]
    return sorted((k, s) for k, t in texts for s, p in tests if p.search(t or ""))


def words(n, longest):
    return ["".join(RNG.choice(ALPHABET) for _ in range(RNG.randint(1, longest))) for _ in range(n)]


@pytest.mark.parametrize("boundary", ["faithful", "token"])
@pytest.mark.parametrize("entries, table", [(10, automaton.TABLE_BYTES), (400, 3000)])
def test_equals_the_patterns(spark, monkeypatch, boundary, entries, table):
    monkeypatch.setattr(automaton, "TABLE_BYTES", table)
    lexicon = words(entries, 6) + ["", "a", "a", "aa", "c++", "c#"]
    texts = [(i, "".join(RNG.choice(ALPHABET) for _ in range(RNG.choice([0, 1, 5, 80, 1500])))) for i in range(60)]
    texts += [(100, None), (101, ""), (102, "a"), (103, "x" * 5000 + " c++")]
    frame = spark.createDataFrame([(k, t, "s") for k, t in texts], "posting_id long, clean string, skill string")
    got = skills.match_skills(frame, lexicon, boundary=boundary)
    assert sorted(map(tuple, got.collect())) == brute(texts, lexicon, boundary)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    table_ = spark.createDataFrame([(s,) for s in lexicon], "skill string")
    assert sorted(map(tuple, skills.match_skill_table(frame, table_, boundary=boundary).collect())) == brute(texts, lexicon, boundary)


def test_ten_thousand_entries(spark):
    lexicon = list({"".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 7))) + RNG.choice(["", " js", "+"]) for _ in range(15_000)})
    assert len(lexicon) >= 10_000
    texts = [(i, " ".join(RNG.choice(lexicon) for _ in range(30))) for i in range(20)]
    frame = spark.createDataFrame(texts, "posting_id long, clean string")
    got = sorted(map(tuple, skills.match_skills(frame, lexicon).collect()))
    assert got == brute(texts, lexicon, "faithful")


def test_occurrences_overlap_and_cross_lanes():
    machine = automaton.build([b"aba", b"ba", b"a" * 40])
    text = np.frombuffer(b"abababa" * 300 + b"a" * 1200, np.uint8)
    end, pattern = automaton.find(machine, text)
    raw = text.tobytes()
    want = sorted((i + len(p), n) for n, p in enumerate([b"aba", b"ba", b"a" * 40]) for i in range(len(raw)) if raw.startswith(p, i))
    assert sorted(zip(end.tolist(), pattern.tolist())) == want


def test_no_texts_and_no_entries(spark):
    none = spark.createDataFrame([], "posting_id string, clean string")
    assert skills.match_skills(none).collect() == []
    one = spark.createDataFrame([("x", "sql")], "posting_id string, clean string")
    assert skills.match_skills(one, []).collect() == []
    assert skills.match_skills(one, ["sql"]).collect() == [("x", "sql")]
