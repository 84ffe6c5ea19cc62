"""The vocabulary from bounded summaries against counting every term."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from laborlens.functions import detect
from laborlens.operators import clusters, heavy, skills

RNG = random.Random(5)


def zipf(n, width):
    return [f"w{min(width, int(1 / (RNG.random() + 1 / width)))}" for _ in range(n)]


def brute(texts, most, bigrams, stop):
    ctf, df = Counter(), Counter()
    for text in texts:
        tokens = [t for t in (text or "").split() if len(t) > 1 and t not in stop]
        listed = tokens + [f"{a} {b}" for a, b in zip(tokens, tokens[1:])] * bigrams
        ctf.update(listed)
        df.update(set(listed))
    return [(t, n, df[t]) for t, n in sorted(ctf.items(), key=lambda x: (-x[1], x[0]))[:most]]


def frame(spark, texts):
    """Repeated keys and texts, and other columns with the operator's own names."""
    rows = [(i // 2, t, "other", 7, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "posting_id long, clean string, term string, n long, tokens string").repartition(5)


@pytest.mark.parametrize("bigrams", [True, False])
@pytest.mark.parametrize("size", [40, 300, heavy.SUMMARY])
def test_equals_counting(spark, monkeypatch, bigrams, size):
    monkeypatch.setattr(heavy, "TOKENS", 500)
    texts = [" ".join(zipf(RNG.choice([0, 1, 3, 60, 900]), 400)) for _ in range(60)] + [None, "", "x", "w1 " * 5000, "w1 w2", "w1 w2"]
    lists = skills.token_lists(frame(spark, texts), "clean", "posting_id")
    stop = ["w3", "w5"]
    wanted, n = heavy.candidates(lists, 20, bigrams, stop, size)
    want = brute(texts, 20, bigrams, stop)
    assert n == len(texts)
    if wanted is not None:
        assert {t for t, _, _ in want} <= set(wanted)
    assert [tuple(r) for r in skills.vocabulary(frame(spark, texts), max_features=20, bigrams=bigrams, stopwords=stop).collect()] == want
    assert [tuple(r) for r in skills.count_vocabulary(lists, 20, bigrams, stop).collect()] == want


def test_short_list_is_proven_or_refused(spark, monkeypatch):
    hot = [" ".join(["aa"] * 50 + [f"r{i}x{j}" for j in range(200)]) for i in range(40)]
    lists = skills.token_lists(frame(spark, hot), "clean")
    wanted, _ = heavy.candidates(lists, 1, False, [], size=64)
    assert wanted == ["aa"]                                     # 8,000 other terms, 64 kept in a task
    assert heavy.candidates(lists, 30, False, [], size=64)[0] is None      # ties without end prove nothing
    monkeypatch.setattr(heavy, "CANDIDATE_BYTES", 10)
    assert heavy.candidates(lists, 30, False, [])[0] is None
    got = skills.vocabulary(frame(spark, hot), max_features=30, bigrams=False)
    assert [tuple(r) for r in got.collect()] == brute(hot, 30, False, [])


def test_both_ways_give_the_same_weights(spark, monkeypatch):
    texts = [" ".join(zipf(80, 60)) for _ in range(50)] + [None, ""]
    short = skills.tfidf(frame(spark, texts), max_features=25, stopwords=["w2"]).collect()
    monkeypatch.setattr(heavy, "CANDIDATE_BYTES", 0)
    plain = skills.tfidf(frame(spark, texts), max_features=25, stopwords=["w2"]).collect()
    rounded = [sorted((r.posting_id, r.term, round(r.weight, 9)) for r in rows) for rows in (short, plain)]
    assert rounded[0] == rounded[1] and rounded[0]


def test_empty(spark):
    none = frame(spark, ["aa"]).limit(0)
    assert skills.vocabulary(none).count() == 0
    assert skills.tfidf(none).count() == 0


def test_few_rows_are_shuffled(spark):
    """Tasks send at most ``size`` terms and one row, and no shuffle lies before that."""
    texts = [" ".join(zipf(300, 5000)) for _ in range(40)]
    lists = skills.token_lists(frame(spark, texts), "clean")
    sent = heavy.summarise(lists, True, [], 50)
    assert "Exchange" not in sent._jdf.queryExecution().executedPlan().toString()
    assert sent.count() <= 51 * lists.rdd.getNumPartitions()
    counted = heavy.count_terms(lists, ["w1", "w1 w2"], [])
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()


def test_summary_bounds():
    """Every term's count lies between the kept one and that plus the error, which is at most a share of all."""
    import numpy as np
    summary, true = heavy.Summary(20), Counter()
    for _ in range(60):
        part = Counter(zipf(200, 300))
        true.update(part)
        summary.add(pa.array(list(part)), np.array(list(part.values())))
        if RNG.random() < .5:
            summary.compact()
    result = summary.compact()
    kept = dict(zip(result.column("term").to_pylist(), result.column("n").to_pylist()))
    assert len(kept) <= 20
    assert all(kept.get(t, 0) <= n <= kept.get(t, 0) + summary.error for t, n in true.items())
    assert summary.error <= sum(true.values()) / 21


def test_tokens_equal_the_pattern():
    """Runs end with their text, single characters and other scripts are none; NULL stays NULL, also in a slice."""
    texts = ["ab a cd", "", None, "x", "yz", "Éab_1 c++ ünd", "日本 k8s", "ab", "_", "__ 9 99", None, "ab"]
    want = [None if t is None else re.findall("[A-Za-z0-9_]{2,}", t) for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["clean"])
    for lo in range(len(texts)):
        for hi in range(lo, len(texts) + 1):
            assert heavy.tokens(batch.slice(lo, hi - lo), "clean").to_pylist() == want[lo:hi]


def test_cluster_vectors_shuffle_few_terms(spark, monkeypatch):
    """One vector for each text, texts without a term and repeated keys included, by the same weights as counting all terms."""
    monkeypatch.setattr(heavy, "TOKENS", 500)
    texts = [" ".join(zipf(80, 300)) for _ in range(40)] + ["", "w1 w1 w2", "w1 w1 w2", "the of"]
    given = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "posting_id long, clean string").repartition(3)
    vectors, names = clusters.term_vectors(given, features=30)
    want = brute(texts, 30, True, [])
    assert names == [t for t, _, _ in want]
    assert "Exchange" not in vectors._jdf.queryExecution().executedPlan().toString()
    got = vectors.collect()
    assert sorted(r.posting_id for r in got) == sorted(i // 2 for i in range(len(texts)))
    expected = []
    for i, text in enumerate(texts):
        tokens = text.split()
        count = Counter(tokens + [f"{a} {b}" for a, b in zip(tokens, tokens[1:])])
        raw = [count[t] * (math.log((1 + len(texts)) / (1 + df)) + 1) for t, _, df in want]
        norm = math.sqrt(sum(x * x for x in raw)) or 1
        expected.append((i // 2, [round(x / norm, 9) for x in raw]))
    assert sorted((r.posting_id, [round(x, 9) for x in r.features.toArray().tolist()]) for r in got) == sorted(expected)


def test_term_report_counts_in_the_tasks(spark):
    """No row for each token; stop words, NULL and empty texts as before."""
    texts = [" ".join(zipf(60, 80)) for _ in range(30)] + ["the of w1", "", None]
    report = skills.term_report(frame(spark, texts), limit=10)
    assert "Generate" not in report._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in report.collect()] == [(t, n) for t, n, _ in brute(texts, 10, False, set(skills.english_stopwords()))]


def test_seniority_parts_lose_no_match(spark):
    """Each rule's parts find all that its pattern finds, and a part alone is no match."""
    assert [level for level, _ in detect.SENIORITY_RULES] == list(detect.SENIORITY_PARTS)
    alone = ["lead", "head of", "principal", "director", "manager", "executive", "chief", "senior", "sr", "staff", "architect", "mid",
             "mid-level", "mid level", "midlevel", "intermediate", "experienced", "3+y", "4+1", "5+x", "5+", "junior", "jr", "entry level",
             "entrylevel", "graduate", "fresh", "intern", "0-2", "0-1"]
    texts = [t for a in alone for t in (f"x {a} y", f"x{a}y", a)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    rule = F.lit("mid")
    for level, pattern in reversed(detect.SENIORITY_RULES):
        rule = F.when(F.col("text").rlike(pattern), level).otherwise(rule)
    got = rows.select("text", detect.seniority(F.lit(""), F.col("text")).alias("level"), rule.alias("want")).collect()
    assert len(got) == len(texts) and all(r.level == r.want for r in got)
    hit = detect.contains_any
    for level, pattern in detect.SENIORITY_RULES:
        found = rows.where(F.col("text").rlike(pattern) & ~hit(F.col("text"), detect.SENIORITY_PARTS[level]))
        assert found.isEmpty(), level
