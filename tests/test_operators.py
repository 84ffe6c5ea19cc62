"""Operators on small frames: branches, properties and brute-force checks."""

import itertools
import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from laborlens.operators import (
    aggregates, filters, ingest, inverted, lookup, recommend, resumes, salary, search, skills, vectors,
)

NOW = datetime(2026, 3, 31)
POSTING = ("posting_id long, title string, company string, country string, job_type string, contract_type string, "
           "seniority string, salary_min double, salary_max double, posted_at timestamp_ntz, scraped_at timestamp_ntz")


def day(n):
    return datetime(2026, 3, n)


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, f"Job {i}", "Acme_Ltd", "UK" if i % 2 else None, "remote", "full-time", "mid",
             float(i), None, day(1 + i % 30) if i % 4 else None, day(2 + i % 28)) for i in range(60)]
    data.append((99, "ABÉ old", "x", "UK", "remote", "full-time", None, 1.0, 2.0, datetime(2020, 1, 1), NOW))
    data.append((98, "no time", "x", "UK", "remote", "full-time", None, 1.0, 2.0, None, None))
    return spark.createDataFrame(data, POSTING)


def ids(df):
    return {r[0] for r in df.select("posting_id").collect()}


def test_fresh_and_expired(rows):
    new, old = ids(filters.fresh(rows, NOW)), ids(rows.where(filters.is_expired(NOW)))
    assert 99 in old and 98 not in new | old and new | old | {98} == ids(rows)


def test_fresh_reaches_the_scan(spark, rows, tmp_path):
    rows.write.parquet(str(tmp_path / "p"))
    stored = filters.fresh(spark.read.parquet(str(tmp_path / "p")), NOW).select("posting_id")
    plan = stored._jdf.queryExecution().toString()
    pushed = next(line for line in plan.split("PushedFilters")[1:])
    assert "Or(GreaterThanOrEqual(posted_at,2026-03-01T00:00),And(IsNull(posted_at)," in pushed


def test_request_filter(rows):
    assert rows.where(filters.request_filter(country="uk", seniority="all", job_type="")).count() == 32
    assert rows.where(filters.request_filter(job_type="hybrid")).count() == 0


@pytest.mark.parametrize("query, raw, hits", [
    ("  ab", False, {99}), ("É", False, set()), ("_ltd", False, set(range(60))), ("job%9", True, {9, 19, 29, 39, 49, 59}),
    ("job%9", False, set()), ("", False, set(range(60)) | {98, 99})])
def test_matches_query(rows, query, raw, hits):
    assert ids(rows.where(filters.matches_query(query, raw_pattern=raw))) == hits


def test_pages_partition_the_result(rows):
    found = search.search_postings(rows, None, NOW)
    pages = [ids(search.page_of(found, p)) for p in (1, 2, 3)]
    assert [len(p) for p in pages] == [21, 21, found.count() - 42]
    assert set.union(*pages) == ids(found)
    assert ids(search.page_of(found, 0)) == pages[0] and ids(search.page_of(found, 99)) == pages[2]
    assert ids(search.offset_page(found, 2)) == pages[1]
    assert search.page_of(found, 3).first().page_range == [1, 2, 3]
    assert search.page_of(found.limit(0), 1).count() == 0
    assert ids(search.offset_page(found, 0)) == pages[0] and ids(search.offset_page(found, 99)) == pages[2]


def test_salary_sort(rows):
    priced = (rows.withColumn("predicted_max", F.when(F.col("posting_id") == 3, 500.0))
              .withColumn("predicted_min", F.when(F.col("posting_id") == 5, 0.0)))
    assert search.salary_sort(priced, "salary_high").first().posting_id == 3
    low = [r.posting_id for r in search.salary_sort(priced, "salary_low").collect()]
    assert low[0] in (1, 98, 99) and low[-1] == 0      # a zero counts as missing
    found = search.search_postings(priced, None, NOW)
    assert ids(search.salary_sorted_page(found, 1)) == ids(search.page_of(found, 1))
    assert 3 in ids(search.salary_sorted_page(found, 1, scope="all"))


def test_salary_rounding_and_empty(spark):
    data = [(1, "a", "c", "UK", None, None, "mid", 2.0, 4.0, NOW, NOW), (2, "a", "c", "gb", None, None, "mid", 2.0, None, NOW, NOW),
            (3, "a", "c", "x", None, None, "lead", 2.0, None, NOW, NOW), (4, "a", "c", None, "r", None, None, 3.0, 3.0, NOW, NOW)]
    df = spark.createDataFrame(data, POSTING)
    got = [(r.seniority, r.avg_min, r.avg_max, r.job_count) for r in aggregates.salary_by_seniority(df, NOW).collect()]
    assert got == [("mid", 2.0, 5.0, 2), ("lead", 2.0, None, 1)]         # 2.5 to even; NULL last
    stats = {r.job_type: r.avg_min for r in aggregates.salary_stats(df.withColumn("country", F.lit(None))).collect()}
    assert stats == {None: 2.0, "r": 3.0}
    assert aggregates.salary_by_country(df.limit(0), NOW).count() == 0
    half = df.limit(2).withColumn("salary_min", F.col("posting_id") + 1.0)
    assert aggregates.salary_stats(half.withColumn("country", F.lit("z"))).first().avg_min == 3.0   # 2.5 up


def test_summary_progress_empty(spark):
    empty = spark.createDataFrame([], "summary_en string")
    assert tuple(aggregates.summary_progress(empty).first()) == (0, 0, 0)


def test_accept_defaults(spark):
    df = spark.createDataFrame([("a", "t", None), (None, None, "c")], "source_id string, title string, company string")
    good, bad = ingest.accept(df)
    row = good.first()
    assert (row.company, row.job_type, row.contract_type, row.source) == ("Unknown", "onsite", "full-time", "adzuna")
    assert bad.count() == 1
    kept, _ = ingest.accept(df.withColumn("job_type", F.lit(None)))
    assert kept.first().job_type is None


def test_first_wins_is_idempotent(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), (None, 5), (None, 5), ("b", 3)], "source_id string, at int")
    once = ingest.first_wins(df, [F.col("at")])
    assert sorted(once.collect(), key=str) == sorted(ingest.first_wins(once, [F.col("at")]).collect(), key=str)
    assert sorted((r.source_id or "", r.at) for r in once.collect()) == [("", 5), ("", 5), ("a", 1), ("b", 3)]


def test_hot_keys_are_cut_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("cast(id % 2 as string) source_id", "id at")
    plan = ingest.first_wins(df, [F.col("at")])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange hashpartitioning") < plan.index("Partial")


def test_not_stored_keeps_rows_without_key(spark):
    batch = spark.createDataFrame([("a",), ("b",), (None,)], "source_id string")
    stored = spark.createDataFrame([("a",), (None,)], "source_id string")
    assert sorted(r[0] or "" for r in ingest.not_stored(batch, stored).collect()) == ["", "b"]


def test_replace_keeps_vanished(spark):
    old = spark.createDataFrame([(1, "a", 0.1), (1, "b", 0.2)], "p int, s string, v double")
    new = spark.createDataFrame([(1, "a", 0.9), (2, "c", 0.3)], "p int, s string, v double")
    assert {tuple(r) for r in ingest.replace_rows(old, new, ["p", "s"]).collect()} == {(1, "a", .9), (1, "b", .2), (2, "c", .3)}


def test_translate_fallbacks(spark):
    table = lookup.label_table(spark)
    df = spark.createDataFrame([("remote",), ("other",), (None,)], "k string")
    assert [r.label for r in lookup.translate(df, table, "k", "ar").collect()] == ["عن بُعد", "other", None]
    assert lookup.translate(df, table, "k", "fr").first().label == "Remote"


def test_required_fields(spark):
    df = spark.createDataFrame([("a", ["x"]), ("", ["x"]), ("a", []), ("a", None)], "title string, skills array<string>")
    got = [r.error for r in filters.check_required(df, title="title is required", skills="skills list required").collect()]
    assert got == [None, "title is required", "skills list required", "skills list required"]


# --- skills -----------------------------------------------------------------------------

def test_cooccurrence_golden(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (3, "d")], "posting_id long, skill string")
    got = {(r.skill_a, r.skill_b): r.together for r in skills.cooccurrence(df, 15).collect()}
    names = "abcd"
    want = {p: 0 for p in itertools.product(names, names)}
    for a, b, n in (("a", "b", 2), ("a", "c", 1), ("b", "c", 1)):
        want[a, b] = want[b, a] = n
    assert got == want
    assert skills.cooccurrence(df.limit(0), 15).count() == 0


def test_tfidf_rows_have_unit_length(spark):
    texts = spark.createDataFrame([(1, "spark sql spark"), (2, "sql the data"), (3, "x")], "posting_id long, clean string")
    weights = skills.tfidf(texts, stopwords=["the"])
    norms = weights.groupBy("posting_id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert len(norms) == 2 and all(abs(r.n - 1) < 1e-9 for r in norms)
    idf = lambda df: math.log((1 + 3) / (1 + df)) + 1                                   # noqa: E731
    raw = {"spark": 2 * idf(1), "sql": idf(2), "spark sql": idf(1), "sql spark": idf(1)}
    size = math.sqrt(sum(v * v for v in raw.values()))
    got = {r.term: r.weight for r in weights.where("posting_id = 1").collect()}
    assert got == pytest.approx({t: v / size for t, v in raw.items()})


def test_vocabulary_limit_and_ties(spark):
    texts = spark.createDataFrame([(1, "bb aa cc aa")], "posting_id long, clean string")
    assert [tuple(r) for r in skills.vocabulary(texts, max_features=2, bigrams=False).collect()] == [("aa", 2, 1), ("bb", 1, 1)]


def test_skill_scores(spark):
    found = spark.createDataFrame([(1, "hugging face"), (1, "r")], "posting_id long, skill string")
    weights = spark.createDataFrame([(1, "hugging", .3), (1, "face", .5)], "posting_id long, term string, weight double")
    assert {r.skill: r.score for r in skills.skill_scores(found, weights).collect()} == {"hugging face": .5, "r": 0.0}


# --- recommendations --------------------------------------------------------------------

def random_market(seed, n_users, n_postings, hot=True):
    rng = random.Random(seed)
    names = [f"s{i}" for i in range(12)]
    pick = (lambda: ("s0" if hot and rng.random() < .5 else rng.choice(names)))        # noqa: E731
    users = [(u, sorted({pick().upper() for _ in range(rng.randint(1, 5))} | ({"zzz"} if u % 5 == 0 else set())))
             for u in range(n_users)]
    have = {}
    for p in range(n_postings):
        for _ in range(rng.randint(1, 5)):
            have[p, pick()] = rng.choice([0.0, .2, .5, .5, 1.0])
    return users, [(p, s, v) for (p, s), v in have.items()]


def brute(users, scores, top_n, over):
    by = {}
    for p, s, v in scores:
        by.setdefault(p, {})[s] = v
    names = {s for _, s, _ in scores}
    out = {}
    for u, wanted in users:
        known = {w.lower() for w in wanted} & names
        found = []
        for p, vec in by.items():
            if known & set(vec):
                norm = math.sqrt(sum(v * v for v in vec.values()))
                dot = sum(vec[s] for s in known & set(vec))
                found.append((-round(dot / norm / math.sqrt(len(known)), 9) if norm else 0.0, p))
        out[u] = [p for _, p in sorted(found)[:top_n * over][:top_n]]
    return {u: ps for u, ps in out.items() if ps}


@pytest.mark.parametrize("direct_rows", [10**9, 0])
@pytest.mark.parametrize("seed, hot", [(1, True), (2, False), (3, True)])
def test_recommend_equals_brute_force(spark, seed, hot, direct_rows):
    users, scores = random_market(seed, 25, 150, hot)
    df = recommend.recommend(spark.createDataFrame(users, "user_id long, skills array<string>"),
                             spark.createDataFrame(scores, "posting_id long, skill string, score double"),
                             spark.createDataFrame([(p,) for p in range(150)], "posting_id long"),
                             3, overfetch=2, direct_rows=direct_rows)
    got = {}
    for r in df.orderBy("user_id", "rank").collect():
        got.setdefault(r.user_id, []).append(r.posting_id)
        assert 0 <= r.match_score <= 1
    assert got == brute(users, scores, 3, 2)


@pytest.mark.parametrize("direct_rows", [10**9, 0])
@pytest.mark.parametrize("seed, hot", [(4, True), (5, False)])
def test_filtered_recommendations_equal_brute_force(spark, seed, hot, direct_rows):
    """Filters before the ranking, with and without bounds, where one skill is in half of all rows."""
    users, scores = random_market(seed, 25, 150, hot)
    modes, lands = ["remote", "hybrid", "onsite"], ["UK", "EG"]
    mode, land = (lambda p: modes[p % 7 % 3]), (lambda p: lands[p % 5 % 2])        # noqa: E731
    asking = [(u, s, modes[u % 3] if u % 4 else None, lands[u % 2].lower() if u % 3 else "all") for u, s in users]
    df = recommend.recommend(
        spark.createDataFrame(asking, "user_id long, skills array<string>, want_job_type string, want_country string"),
        spark.createDataFrame(scores, "posting_id long, skill string, score double"),
        spark.createDataFrame([(p, land(p), mode(p), "c", "s") for p in range(150)],
                              "posting_id long, country string, job_type string, contract_type string, seniority string"),
        3, prefilter=True, direct_rows=direct_rows)
    got = {}
    for r in df.orderBy("user_id", "rank").collect():
        got.setdefault(r.user_id, []).append(r.posting_id)
    want = {}
    for u, s, m, c in asking:
        allowed = [x for x in scores if (m is None or mode(x[0]) == m) and (c == "all" or land(x[0]).lower() == c)]
        names = {x[1] for x in scores}
        known = [x for x in {w.lower() for w in s} & names]
        rest = [(-1, n, 0.0) for n in names]                    # a skill of filtered postings stays known
        found = brute([(u, known)], allowed + rest, 4, 1).get(u, [])
        found = [p for p in found if p >= 0][:3]
        if found:
            want[u] = found
    assert got == want


def test_copies_are_cut_before_the_shuffle(spark):
    scores = spark.range(100).selectExpr("id posting_id", "'a' skill", "1.0D score")
    cut = recommend.profiles(recommend.unit_vectors(scores), 5)
    assert [tuple(r)[:1] + (r.profile_id,) for r in cut.orderBy("posting_id").collect()] == [(i, 0) for i in range(5)]
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_recommend_unknown_and_zero(spark):
    users = spark.createDataFrame([(1, ["none"]), (2, ["A", "b"])], "user_id long, skills array<string>")
    scores = spark.createDataFrame([(7, "a", 0.0), (8, "b", 1.0)], "posting_id long, skill string, score double")
    found = recommend.recommend(users, scores, spark.createDataFrame([(7,), (8,)], "posting_id long"))
    assert [tuple(r) for r in found.orderBy("rank").collect()] == [(2, 8, 0.707, 1), (2, 7, 0.0, 2)]


def test_recommend_filters_after_and_before(spark):
    users = spark.createDataFrame([(1, ["a"], "hybrid")], "user_id long, skills array<string>, want_job_type string")
    scores = spark.createDataFrame([(p, "a", 1.0) for p in range(10)], "posting_id long, skill string, score double")
    rows = spark.createDataFrame([(p, "UK", "hybrid" if p > 7 else "remote", "c", "s") for p in range(10)],
                                 "posting_id long, country string, job_type string, contract_type string, seniority string")
    after = recommend.recommend(users, scores, rows, 2, overfetch=2)
    before = recommend.recommend(users, scores, rows, 2, overfetch=2, prefilter=True)
    assert after.count() == 0 and sorted(r.posting_id for r in before.collect()) == [8, 9]


@pytest.mark.parametrize("seed, copies", [(6, 1), (7, 9)])
def test_late_filters_cut_lists_in_their_rows(spark, seed, copies):
    """Filters after the ranking: the lists of the tiers give what the join on skill gives, ids with two rows included."""
    users, scores = random_market(seed, 25, 120)
    modes = ["remote", "hybrid", "onsite"]
    asking = [(u, s, modes[u % 3] if u % 4 else None, ["uk", "all"][u % 2]) for u, s in users]
    frame = spark.createDataFrame([(p + c * 1000, s, v) for p, s, v in scores for c in range(copies)],
                                  "posting_id long, skill string, score double")
    rows = [(p, "UK" if p % 5 else None, modes[p % 7 % 3], "c", "s") for p, in frame.select("posting_id").distinct().collect()]
    rows += [(p, "EG", "remote", "c", "s") for p, *_ in rows if p % 10 == 0]
    args = (spark.createDataFrame(asking, "user_id long, skills array<string>, want_job_type string, want_country string"), frame,
            spark.createDataFrame(rows, "posting_id long, country string, job_type string, contract_type string, seniority string"))
    one, other = (recommend.recommend(*args, 3, overfetch=5, direct_rows=n) for n in (10**9, 0))
    other = other.cache()
    assert other.count() > 20 and one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty()


def test_large_joins_on_skill_are_left_out():
    """Rows of the join may all be shuffled, so only a small one is made."""
    assert recommend.DIRECT_ROWS <= 1_000_000


@pytest.mark.parametrize("tier, block, wanted", [(8192, 8192, 256), (20, 8192, 256), (20, 10, 256), (20, 10, 0)])
def test_settled_lists_hold_what_their_users_can_get(spark, monkeypatch, tier, block, wanted):
    """With one tier or several, of one cell or several: lists are written as short as the wants ask, results stay those of the join."""
    written, kept = [], recommend.cut_lineage

    def recorded(df, name):
        out = kept(df, name)
        if name == "best" and "done" in out.columns:
            written.extend(len(r.near) for r in out.where("done").collect())
        return out

    for name, value in (("TIER", tier), ("BLOCK", block), ("WANTED", wanted), ("cut_lineage", recorded)):
        monkeypatch.setattr(recommend, name, value)
    users, scores = random_market(8, 25, 120)
    modes = ["remote", "hybrid", "onsite"]
    asking = [(u, s, modes[u % 3] if u % 4 else None, ["uk", "all"][u % 2]) for u, s in users]
    asking += [(u + 100, s, "remote", "uk") for u, s in users] + [(3, ["x"], "onsite", None), (None, users[0][1], None, None)]
    rows = [(p, "UK" if p % 5 else None, modes[p % 7 % 3], "c", "s") for p in range(120)] + [(7, "EG", "remote", "c", "s")]
    args = (spark.createDataFrame(asking, "user_id long, skills array<string>, want_job_type string, want_country string"),
            spark.createDataFrame(scores, "posting_id long, skill string, score double"),
            spark.createDataFrame(rows, "posting_id long, country string, job_type string, contract_type string, seniority string"))
    one, other = (recommend.recommend(*args, 2, overfetch=6, direct_rows=n) for n in (10**9, 0))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))
    # mostly two wants ask for a request, each takes two postings of its twelve
    assert (written and sum(written) < 6 * len(written)) if wanted else not written


def test_resume_text_to_recommendations(spark):
    texts = spark.createDataFrame([(1, "Led teams. Python, and SQL!"), (2, "sql " * 5000 + "docker"), (3, None), (4, ""), (5, "cook")],
                                  "resume_id long, text string")
    scores = spark.createDataFrame([(10, "Python", 1.0), (11, "SQL", 1.0), (11, "Docker", 1.0), (12, "cook", 1.0)],
                                   "posting_id long, skill string, score double")
    found = resumes.recommend_from_text(texts, scores, scores.select("posting_id").distinct(), top_n=2)
    assert sorted((r.resume_id, r["rank"], r.posting_id) for r in found.collect()) == [(1, 1, 10), (1, 2, 11), (2, 1, 11)]


# --- vectors ----------------------------------------------------------------------------

@pytest.mark.parametrize("block", [1000, 4])
def test_vector_topk_equals_brute_force(spark, block):
    rng = np.random.default_rng(5)
    corpus = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(60)]
    corpus += [(100 + i, v) for i, (_, v) in enumerate(corpus[:5])] + [(200, [0.0] * 8)]
    asked = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(9)]
    schema = "{} long, embedding array<float>"
    got = vectors.vector_topk(spark.createDataFrame(asked, schema.format("query_id")),
                              spark.createDataFrame(corpus, schema.format("item_id")).repartition(3), 4, block)
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.item_id)

    def distance(a, b):
        a, b = np.float32(a).astype(float), np.float32(b).astype(float)
        size = np.linalg.norm(a) * np.linalg.norm(b)
        return round(1 - (a @ b / size if size else 0), 9)
    for q, v in asked:
        want = sorted((distance(v, w), i) for i, w in corpus)[:4]
        assert found[q] == [i for _, i in want]


def test_vector_topk_odd_rows(spark):
    corpus = spark.createDataFrame(
        [(1, [1.0, 0.0], "x"), (2, None, "x"), (3, [], "x"), (4, [1.0, None], "x"), (5, [float("nan"), 1.0], "x"),
         (6, [float("inf"), 1.0], "x"), (7, [1.0, 0.0, 0.0], "x"), (8, [2.0, 0.0], "x"), (1, [1.0, 0.0], "x")],
        "item_id long, embedding array<float>, distance string")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0, 1.0])], "query_id long, embedding array<float>")
    got = sorted(map(tuple, vectors.vector_topk(asked, corpus, 2).collect()))
    assert got == [(1, 1, 0.0, 1), (1, 1, 0.0, 2), (3, 7, 1.0, 1)]
    assert vectors.vector_topk(asked, corpus.limit(0)).count() == vectors.vector_topk(asked.limit(0), corpus).count() == 0


def test_inverted_lists_read_few_vectors(spark):
    """Exact at a larger scale, with a share of whole vectors read far below all; a hot vector is one entry."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("item_id"), "embedding")
    hot = e.where("item_id = 3").select(F.explode(F.sequence(F.lit(10_001).cast("long"), F.lit(11_000).cast("long"))).alias("item_id"), "embedding")
    index = inverted.build_lists(e.union(hot))
    (lists,) = index
    assert lists.sizes.sum() == 2000 and len(lists.centres) == 44 and lists.codes.count() == 2000
    asked = e.where("item_id % 40 = 3").select(F.col("item_id").alias("query_id"), "embedding")
    got, read = inverted.search_lists(index, asked, 4)
    rows = {r.item_id: r.embedding for r in e.collect()}
    x = np.array([rows[i] for i in sorted(rows)], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids = np.array(sorted(rows))
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.item_id)
    assert len(found) == 50 and found.pop(3) == [3, 10_001, 10_002, 10_003]
    for q, items in found.items():
        distance = (1 - x @ x[np.searchsorted(ids, q)]).round(9)
        want = [int(i) for i in ids[np.lexsort((ids, distance))][:4]]
        assert items == want or 3 in want and items == sorted(items, key=lambda i: want.index(min(i, 3) if i > 10_000 else i))
    share = read.agg(F.avg("vectors_read") / 2000).first()[0]
    assert share < 0.05 and read.agg(F.max("codes_read")).first()[0] <= 2000


def test_inverted_lists_skip_cells(spark):
    """Clustered vectors: the triangle of query, centre and radius leaves most cells, and their codes, unread."""
    rng = np.random.default_rng(8)
    middles = rng.normal(size=(40, 16))
    corpus = [(i, [float(v) for v in middles[i % 40] + 0.05 * rng.normal(size=16)]) for i in range(2000)]
    frame = spark.createDataFrame(corpus, "item_id long, embedding array<double>")
    asked = frame.where("item_id < 40").select(F.col("item_id").alias("query_id"), "embedding")
    got, read = inverted.search_lists(inverted.build_lists(frame), asked, 4)
    x = np.array([v for _, v in corpus])
    x /= np.linalg.norm(x, axis=1)[:, None]
    for q in range(40):
        distance = (1 - x @ x[q]).round(9)
        assert [r.item_id for r in got.where(F.col("query_id") == q).orderBy("rank").collect()] == \
            np.lexsort((np.arange(2000), distance))[:4].tolist()
        if q == 3:
            break
    assert read.agg(F.avg("codes_read") / 2000).first()[0] < 0.3


def test_search_questions(spark):
    texts = [(1, "spark engineer wanted"), (2, "pastry chef"), (3, "data engineer spark"), (4, "")]
    index = vectors.hashing_embed(spark.createDataFrame(texts, "item_id long, text string"), "text", dims=1 << 12)
    asked = spark.createDataFrame([(9, "spark engineer"), (8, "chef")], "query_id long, text string")
    got = vectors.search_questions(asked, index, 1, embed=lambda df, text, prefix: vectors.hashing_embed(
        df, text, dims=1 << 12, prefix=prefix))
    # each text also holds the word of its prefix, so the shorter of two equal matches is nearer
    assert {(r.query_id, r.item_id) for r in got.collect()} == {(9, 1), (8, 2)}


def test_hashing_embed(spark):
    df = vectors.hashing_embed(spark.createDataFrame([("Data Engineer data",), ("",)], "t string"), "t", dims=64)
    vecs = [r.embedding for r in df.collect()]
    assert all(len(v) == 64 for v in vecs) and sum(x * x for x in vecs[0]) == pytest.approx(1, abs=1e-5)


def test_context_threshold(spark):
    matches = spark.createDataFrame([(1, 5, .2, 1), (1, 6, .9, 2), (2, 5, .9, 1)], "query_id long, item_id long, distance double, rank int")
    docs = spark.createDataFrame([(5, "five"), (6, "six")], "item_id long, document string")
    asked = spark.createDataFrame([(10, 1, "hi"), (20, 2, "ho")], "conv_id long, query_id long, message string")
    turns = spark.createDataFrame([(10, t, "user", f"m{t}") for t in range(9)], "conv_id long, turn int, role string, text string")
    got = {r.conv_id: r for r in vectors.prompt_rows(asked, vectors.context_blocks(matches, docs), turns).collect()}
    assert got[10].context == "--- Matching Vacancy #1 (Semantic Match Score: 0.8) ---\nfive\n"
    assert got[10].history.split("\n") == [f"user: m{t}" for t in range(3, 9)]
    assert got[20].context.startswith("No active vacancy") and got[20].history == ""


# --- salary -----------------------------------------------------------------------------

def test_salary_model(spark, tmp_path):
    rng = random.Random(4)
    base = {"head of data": 90_000, "senior dev": 70_000, "dev": 50_000, "junior dev": 30_000}
    data = []
    for i in range(600):
        title = rng.choice(list(base))
        pay = base[title] * (1.5 if i % 2 else 1.0) + rng.uniform(-2000, 2000)
        data.append((i, title, "", "us" if i % 2 else "Egypt", "remote" if i % 3 else "onsite", "full-time", pay, pay * 1.2))
    df = spark.createDataFrame(data, "posting_id long, title string, description string, country string, job_type string, "
                                     "contract_type string, salary_min double, salary_max double")
    frame = salary.training_frame(df)
    models = salary.train(frame, trees=20, rate=0.2)
    scores = {r.target: r for r in salary.evaluate(models, frame).collect()}
    assert scores["salary_min"].r2 > 0.9 and scores["salary_max"].mae < 6000
    models.save(str(tmp_path))
    again = salary.SalaryModels.load(str(tmp_path))
    blank = df.withColumn("salary_max", F.when(F.col("posting_id") % 2 == 0, F.lit(float("nan"))).otherwise(F.col("salary_max")))
    out = salary.enrich(blank, lambda part: salary.predict(again, part))
    assert out.count() == 600 and out.where("predicted_min IS NOT NULL").count() == 300
    monthly = out.where("predicted_period IS NOT NULL").select("predicted_period").distinct().collect()
    assert [r[0] for r in monthly] == ["monthly"]        # even rows are Egyptian


def test_grouped_training_equals_row_training(spark):
    """Trees on weighted group means are the trees on the single rows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor
    data = [(i, "t", "sr dev" if i % 3 else "dev", "us" if i % 2 else "x", "remote", "full-time",
             1000.0 + i % 7 * 50 + i % 2 * 900 + i % 3 * 400, 9000.0) for i in range(120)]
    df = spark.createDataFrame(data, "posting_id long, title string, description string, country string, job_type string, "
                                     "contract_type string, salary_min double, salary_max double")
    frame = salary.training_frame(df)
    models = salary.train(frame, trees=5, rate=0.3)
    single = Pipeline(stages=[
        VectorAssembler(inputCols=list(salary.FEATURES), outputCol="features"),
        GBTRegressor(labelCol="salary_min", predictionCol="one", maxIter=5, stepSize=0.3, maxDepth=5, seed=42),
    ]).fit(frame.where("NOT is_test"))
    both = single.transform(salary.raw_predictions(models, frame))
    assert both.where("abs(one - usd_salary_min) > 0.01").count() == 0


def test_skill_matrix_grows_by_tasks(spark, monkeypatch):
    """The number of tasks follows the rows; repeated rows are averaged, a NULL posting is one row, with 0 filled in."""
    monkeypatch.setattr(skills, "MATRIX_ROWS", 10)
    data = [((i % 21) or None, "ab"[i % 2], float(i)) for i in range(100)] + [(500, "other", 1.0), (501, None, 2.0)]
    given = spark.createDataFrame(data, "posting_id long, skill string, score double")
    got = skills.skill_matrix(given, ["a", "b"])
    assert got.rdd.getNumPartitions() == 11
    want = {}
    for posting, skill, score in data:
        want.setdefault(posting or 0, {"a": [], "b": []}).get(skill, []).append(score)
    assert {r.posting_id or 0: (r.a, r.b) for r in got.collect()} == {
        k: tuple(sum(v[c]) / len(v[c]) if v[c] else 0.0 for c in "ab") for k, v in want.items()}
    assert got.count() == len(want)
