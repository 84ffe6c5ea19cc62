"""Golden rows for the text rules and their quirks."""

import uuid
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from laborlens import vocab
from laborlens.functions import detect, labels, money, replies, resume, text
from laborlens.operators import resumes, skills


def skills_in(spark, words, lexicon, **options):
    df = spark.createDataFrame([(1, words)], "posting_id long, clean string")
    inline = {r.skill for r in skills.match_skills(df, lexicon, **options).collect()}
    table = spark.createDataFrame([(s,) for s in lexicon], "skill string")
    joined = {r.skill for r in skills.match_skill_table(df, table, **options).collect()}
    assert joined == {r.skill for r in skills.join_skill_table(df, table, **options).collect()}
    assert inline == joined
    return inline


@pytest.mark.parametrize("raw, want", [
    (None, ""), ("<p>Data-Driven  C++</p> & R/D.", "data-driven c++ r/d."), ("Émile\n\tsql", "mile sql")])
def test_clean_text(one, raw, want):
    assert one(text.clean_text, raw) == want


def test_clean_words(one):
    assert one(text.clean_words, "<b>A-b</b> c# 1.5") == "a b c# 1 5"


def test_lexicon_quirks(spark):
    lexicon = ["c++", "c#", "r", "go", "power bi", "++", "sql"]
    assert skills_in(spark, "we use c++ and sql", lexicon) == {"sql"}
    assert skills_in(spark, "c++11 power bi", lexicon) == {"c++", "power bi", "++"}
    assert skills_in(spark, "c# dev r d go on", lexicon) == {"r", "go"}
    assert skills_in(spark, "postgresql power", lexicon) == set()


def test_lexicon_token_boundary(spark):
    lexicon = ["c++", "c#", "sql"]
    assert skills_in(spark, "c++ and c# sql", lexicon) == {"sql"}
    assert skills_in(spark, "c++ and c# sql", lexicon, boundary="token") == {"c++", "c#", "sql"}


def test_terms_and_bigrams(spark):
    df = spark.createDataFrame([("ab c de fg",), ("",), ("xy",)], "clean string")
    got = [r[0] for r in df.select(skills.text_terms("clean", True, ["zz"])).collect()]
    assert got == [["ab", "de", "fg", "ab de", "de fg"], [], ["xy"]]


@pytest.mark.parametrize("title, desc, want", [
    ("reports to the manager, junior role", "", "lead"), ("Sr. developer", None, "senior"),
    ("3+ years", "", "mid"), ("junior 3+ years", "", "junior"), ("junior 3+years", "", "mid"),
    ("entry-level", "", "mid"), ("entry level", "", "junior"), ("0-2 years", "", "junior"),
    ("internship", "", "mid"), ("fresh", "", "junior"), (None, None, "mid")])
def test_seniority(one, title, desc, want):
    assert one(detect.seniority, title, desc) == want


@pytest.mark.parametrize("words, want", [
    ("international team", "internship"), ("part time", "part-time"), ("contract", "contract"), ("x", "full-time")])
def test_board_contract(one, words, want):
    assert one(detect.board_contract, words) == want


def test_work_modes(one):
    assert one(detect.work_mode, "hybrid or remote", "") == "remote"
    assert one(detect.work_mode, "wfh", "") == "onsite"
    assert one(detect.board_work_mode, "WFH") == "remote"
    assert one(detect.feed_work_mode, "fulltime", "hybrid role") == "onsite"


@pytest.mark.parametrize("raw, want", [
    ("5,000 - 10,000 EGP", (5000, 10000)), ("7,500", (7500, None)), ("50", (None, None)),
    ("٥٠٠٠ - 10,000 EGP", (5000, 10000)), (None, (None, None))])
def test_parse_salary(one, raw, want):
    assert tuple(one(money.parse_salary, raw)) == want


@pytest.mark.parametrize("low, high, want", [
    ("5000", "7000.5", (5000, 7000.5)), ("nan", "7", (None, 7)), ("x", "7", (None, None)),
    ("", None, (None, None)), ("0", "9", (None, 9))])
def test_amount_pair(one, low, high, want):
    assert tuple(one(money.amount_pair, low, high)) == want


@pytest.mark.parametrize("raw, want", [
    ("UK", "United Kingdom"), ("usa", "United States"), ("eg", "Egypt"), ("Dubai, UAE", "United Arab Emirates"),
    ("Saudi", "Saudi Arabia"), ("Jordan", "default"), (None, "default"), ("", "default")])
def test_canonical_country(one, raw, want):
    assert one(detect.canonical_country, raw) == want


def test_location_country(one):
    assert one(detect.country_of_location, "Cairo, Egypt") == "Egypt"
    assert one(detect.last_word, "Saudi Arabia") == "Arabia"


def test_local_salary(one):
    pay = one(money.local_salary, 90000.0, 60000.0, "Egypt", 0.08, 50.0)
    assert (pay.salary_min, pay.salary_max, pay.period) == (20000, 30000, "monthly")
    assert one(money.local_salary, -5.0, 2.5, "default", 1.0, 1.0).salary_max == 2


def test_salary_label(one):
    assert one(money.salary_label, "Egypt", 1000.0, 2500.0, None, None, None) == "E£1,000–E£2,500"
    assert one(money.salary_label, None, None, 0.0, 1500.0, None, "monthly") == "£1,500/mo (ML Predicted)"
    assert one(money.salary_label, "us", None, None, None, None, None) == "ML Predicted"


def test_source_id(one):
    for url in ("https://jobs.example.org/p/abc", "http://x/é"):
        want = "site_" + uuid.uuid5(uuid.NAMESPACE_URL, url).hex[:12]
        assert one(lambda c: labels.source_id("site", c), url) == want
    both = [one(lambda c, t: labels.source_id("s", c, t), "", t) for t in ("a", "a", "b")]
    assert both[0] == both[1] != both[2]


@pytest.mark.parametrize("raw, want", [
    ("2026-01-01T10:00:00Z", datetime(2026, 1, 1, 10)), ("2026-01-01", datetime(2026, 1, 1)), ("bad", None)])
def test_parse_time(one, raw, want):
    assert one(labels.parse_time, raw) == want


@pytest.mark.parametrize("day, en, ar", [
    ("2026-01-11", "today", "النهاردة"), ("2026-01-10T23:00", "today", "النهاردة"),
    ("2026-01-09", "yesterday", "إمبارح"), ("2026-01-08", "2 days ago", "من يومين"),
    ("2026-01-05", "5 days ago", "من 5 أيام"), ("2025-12-01", "40 days ago", "من 40 يوم"), ("bad", "", ""), (None, "", "")])
def test_age_label(one, day, en, ar):
    today = date(2026, 1, 10)
    assert one(labels.age_label, day, today) == en
    assert one(lambda a, b: labels.age_label(a, b, "ar"), day, today) == ar


def test_document(one):
    got = one(labels.posting_document, "Dev", None, "Cairo", None, None, "contract", None, 100.0, 100.0, None, None)
    assert got.split("\n") == ["Title: Dev", "Company: Unknown", "Location: Cairo, Unknown", "Workplace Type: onsite",
                               "Contract Type: contract", "Seniority: mid", "Salary Range: £100",
                               "Required Skills: None", "Description: "]
    assert one(labels.salary_text, 2.5, 3.5) == "£2 - £4"
    assert one(labels.salary_text, None, 9.0) == "Not specified"


def test_tiers(one):
    assert [one(labels.match_tier, s) for s in (0.7, 0.699, 0.4, 0.1)] == ["high", "medium", "medium", "low"]
    assert [one(labels.resume_tier, s) for s in (75, 45, 44)] == ["high", "mid", "low"]


def test_metric_count(one):
    words = "by 40% and 10k users, 5+ years, 5+years, 3 years, 2x, 40%faster"
    assert one(resume.metric_count, words) == 5


def score(spark, body):
    df = spark.createDataFrame([(1, body)], "resume_id long, text string")
    return resumes.with_feedback(resumes.score_resumes(df)).first()


@pytest.mark.parametrize("count, points", [
    (149, 5), (150, 12), (299, 12), (300, 20), (900, 20), (901, 15), (1300, 15), (1301, 5)])
def test_resume_length(one, count, points):
    assert one(resume.length_points, count) == points


def test_resume_empty(spark):
    for body in (None, "", " \n"):
        row = score(spark, body)
        assert row.score == 0 and row.feedback_en == [vocab.ADVICE["en"]["empty"]]
        assert row.summary_en == vocab.EMPTY_RESUME_SUMMARY["en"]


def test_resume_rules(spark):
    row = score(spark, "Experience in Python, SQL and pytorch; designed and built things. c++ power bi")
    assert row.sections_found == ["experience"] and row.sections_score == 5
    assert row.detected_skills == ["Python", "PyTorch", "SQL"]
    assert (row.verbs_score, row.skills_score, row.metrics_score, row.length_score) == (4, 12, 0, 5)
    assert row.feedback_en[0] == "Add explicit headings for missing sections: Education, Skills, Contact."
    assert len(row.feedback_en) == len(row.feedback_ar) == 4
    assert row.summary_en is None


def test_resume_full_marks(spark):
    body = ("experience education skills contact " + " ".join(vocab.ACTION_VERBS[:12])
            + " python sql aws docker spark 1k 2k 3k 4k 5k " + "word " * 300)
    row = score(spark, body)
    assert row.score == 100
    assert row.feedback_en == [vocab.ADVICE["en"]["fine"], vocab.ADVICE["en"]["extra"]]


@pytest.mark.parametrize("raw, want", [
    ('text {"summary_en": "a", "summary_ar": "b",} end', ("a", "b")),
    ('{"summary_en": ["x", " y "], "summary_ar": 5}', ("- x\n- y", "5")),
    ("summary_en: 'p' then summary_ar: 'q'", ("p", "q")),
    ("{'summary_en': ['p', 'q']}", ("- p\n- q", "")), ("nothing", ("", "")), (None, (None, None))])
def test_reply_salvage(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "raw string").withColumn("v", replies.parsed(F.col("raw")))
    got = df.select(*[replies.text_field(F.col("raw"), F.col("v"), f) for f in ("summary_en", "summary_ar")]).first()
    assert tuple(got) == want


def test_split_list(one):
    assert one(text.split_list, " SQL, ,Python,") == ["sql", "python"]
