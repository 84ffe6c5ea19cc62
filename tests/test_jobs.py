"""Sources, stores, the refresh chain and streams."""

import glob
import io
import json
import re
import zipfile
from datetime import datetime

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from laborlens import vocab
from laborlens.operators import ingest, skills
from laborlens.operators.store import Store
from laborlens.plans import refresh
from laborlens.session import scratch_root, slices
from laborlens.sources import api, board, feeds, resumes
from laborlens.streaming import ingest as streams

NOW = datetime(2026, 3, 31)
FEED = ("title string, description string, company string, location string, job_url string, min_amount double, "
        "max_amount double, job_type string, date_posted string, searched_location string")


def feed_rows(spark, n=40, start=0):
    words = ["python and sql with docker", "java spark aws", "communication and agile teamwork", "python pandas numpy"]
    data = [(f"{'Senior ' if i % 3 == 0 else ''}Developer {i}", f"{words[i % 4]} text {i % 9}", f"Firm {i % 6}", "Cairo, Egypt",
             f"https://x.example.org/{i}", 1000.0 + i, 2000.0 + i, "fulltime", f"2026-03-{10 + i % 20}", "Saudi Arabia")
            for i in range(start, start + n)]
    return spark.createDataFrame(data, FEED)


def test_api_pages(spark, tmp_path):
    folder = tmp_path / "country=gb"
    folder.mkdir()
    page = {"results": [{"id": "7", "title": "Remote dev", "company": {"display_name": "Acme"}, "created": "2026-03-01T00:00:00Z"},
                        {"id": "8"}]}
    (folder / "1.json").write_text(json.dumps(page) + "\n{broken\n")
    raw, bad = api.read_api_pages(spark, str(tmp_path))
    rows = {r.source_id: r for r in api.normalise_api(raw).collect()}
    assert bad.count() == 1 and set(rows) == {"7", "8"}
    assert (rows["7"].company, rows["7"].country, rows["7"].job_type) == ("Acme", "United Kingdom", "remote")
    assert rows["7"].posted_at == datetime(2026, 3, 1) and (rows["8"].company, rows["8"].title) == ("Unknown", "")


def test_feed_files(spark, tmp_path):
    feed_rows(spark).drop("date_posted").write.parquet(str(tmp_path / "f"))
    raw = feeds.read_feed(spark, str(tmp_path / "f"))
    rows = feeds.ingest_feeds({"bayt": raw, "google_jobs": raw})
    got = {(r.source, r.country) for r in rows.select("source", "country").distinct().collect()}
    assert got == {("bayt", "Saudi Arabia"), ("google_jobs", "Arabia")} and rows.where("posted_at IS NULL").count() == 80


CARDS = """<html><body>
<div class="css-1" data-jobid="1"><h2><a href="/jobs/p/1"> Data <b>Dev</b></a></h2><a href="/company/a">Acme &amp; Co</a>
 <span class="x-location">Cairo<br></span><span class="tag">Remote</span><span class="type">Part time</span></div>
<div class="css-1" data-jobid="2"><a href="https://o.example.org/jobs/p/2">Ops</a><script>var a = "</div>";</script></div>
<div class="css-1" data-jobid="3"><a href="/other">no</a></div></body></html>"""
PLAIN = '<article><p><a href="/jobs/p/9">Nine</a></p><a href="/jobs/p/9">Nine again</a></article>'


def test_board_cards(spark):
    pages = spark.createDataFrame([(1, CARDS), (2, PLAIN), (3, None)], "page_id long, html string")
    cards = board.search_cards(pages)
    rows = {(r.page_id, r.card_no): r for r in cards.collect()}
    assert set(rows) == {(1, 0), (1, 1), (2, 0)}
    first = rows[1, 0]
    assert (first.title, first.company, first.location, first.tags) == ("DataDev", "Acme & Co", "Cairo", "Remote Part time")
    assert first.url == vocab.BOARD_BASE_URL + "/jobs/p/1" and rows[1, 1].url == "https://o.example.org/jobs/p/2"
    assert (rows[1, 1].company, rows[1, 1].location) == ("Unknown", "Egypt")
    posting = board.board_postings(cards).where("title = 'DataDev'").first()
    assert (posting.job_type, posting.contract_type, posting.description) == ("remote", "part-time", "Remote Part time")


def test_board_details(spark):
    html = '<div class="job-description"><p>Long</p> text <i>here</i></div><span>5,000 - 9,000 EGP</span>'
    pages = spark.createDataFrame([(1, html), (2, "<section>a" + "b" * 4000 + "</section>"), (3, "")], "page_id long, html string")
    rows = {r.page_id: r for r in board.page_details(pages).collect()}
    assert (rows[1].description, rows[1].salary_min, rows[1].salary_max) == ("Long text here", 5000, 9000)
    assert len(rows[2].description) == 4001 and rows[3].description == "" and rows[3].salary_min is None


def docx(*paragraphs):
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r><w:r><w:t>!</w:t></w:r></w:p>" for p in paragraphs)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body>{body}<w:p/></w:body></w:document>')
    return buffer.getvalue()


def test_resume_files(spark, tmp_path):
    (tmp_path / "a.DOCX").write_bytes(docx("one", "two"))
    (tmp_path / "b.docx").write_bytes(b"not a zip")
    (tmp_path / "c.txt").write_bytes(b"plain \xff text")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    files = resumes.read_resume_files(spark, str(tmp_path))
    texts = {r.path[-5:]: r.text for r in resumes.extract_text(files, pdf_text=lambda b: "pdf words").collect()}
    assert texts == {".DOCX": "one!\ntwo!", ".docx": "", "c.txt": "plain  text", "d.pdf": "pdf words"}
    good, bad = resumes.split_uploads(files)
    assert good.count() == 3 and bad.first().reject_reason == vocab.UPLOAD_REASONS["extension"]


def test_store_commits(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    one = store.commit(replace={"a": spark.range(3)}, append={"b": spark.range(1)})
    store.commit(append={"b": spark.range(2)}, note="n")
    assert store.read("a").count() == 3 and store.read("b").count() == 3 and store.committed("n")
    assert store.read("b", one).count() == 1
    try:        # a failing write changes nothing
        store.commit(replace={"a": spark.range(9), "b": spark.range(1).select(F.raise_error(F.lit("no")))})
    except Exception:
        pass
    assert store.read("a").count() == 3
    store.restore(one)
    assert store.read("b").count() == 1
    store.export(str(tmp_path / "backup"))
    store.commit(replace={"a": spark.range(0)})
    store.load_backup(str(tmp_path / "backup"), ["a"])
    assert store.read("a").count() == 3
    store.compact("a")
    calls = []
    for _ in range(2):
        store.read_or_compute("g", lambda: calls.append(1) or spark.range(2))
    assert calls == [1]


def test_refresh_chain(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    rows = feeds.ingest_feeds({"bayt": feed_rows(spark), "indeed": feed_rows(spark, 20, 30)})
    refresh.store_batch(store, rows, [F.col("source")], NOW)
    refresh.store_batch(store, rows, [F.col("source")], NOW)
    stored = store.read("postings")
    assert stored.count() == 60 == stored.select("posting_id").distinct().count()
    assert store.read("companies").count() == 6
    outcome = refresh.refresh_all(store, NOW)
    assert outcome == dict.fromkeys(outcome), outcome
    assert {r[0] for r in store.read("seniority_breakdown").select("seniority").collect()} == {"senior", "mid"}
    assert store.read("posting_vectors").count() == 60
    assert store.read("cluster_points").count() == 60
    names = {r.name for r in store.read("skill_trends").collect()}
    assert {"python", "sql", "spark", "agile"} <= names
    later = datetime(2026, 4, 20)
    refresh.refresh_index(store, later)
    left = store.read("posting_vectors").count()
    assert 0 < left < 60 and left == stored.where("posted_at >= '2026-03-21'").count()
    # a failing step does not stop the others
    broken = refresh.refresh_all(store, NOW, embed=lambda df, c: df.select("missing"))
    assert broken["gold"] is None and broken["skills"] is None


def test_summaries(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    refresh.store_batch(store, feeds.ingest_feeds({"bayt": feed_rows(spark)}), [F.col("source")], NOW)

    def answer(texts):
        return pd.Series(['{"summary_en": "e", "summary_ar": "a"}' if "sql" in t else "no" for t in texts])
    streams.backfill_summaries(store, answer, NOW, limit=40)
    view = refresh.with_summaries(store)
    assert view.where("summary_en = 'e'").count() == 10 and view.count() == 40
    streams.reset_summaries(store)
    assert refresh.with_summaries(store).where("summary_en IS NOT NULL").count() == 0


def test_stream_equals_batch(spark, tmp_path):
    raw = feed_rows(spark, 60)
    for i in range(3):                       # overlapping pulls in separate files
        raw.where(f"job_url >= 'https://x.example.org/{i}'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "s"))
    stream = streams.landed_stream(spark, str(tmp_path / "in"), raw.schema, files_per_trigger=1)

    def normalise(df):
        rows = feeds.ingest_feeds({"bayt": df.select(*raw.columns)})
        return rows.withColumn("arrived_at", F.lit(0)).withColumn("file", F.lit(""))
    for _ in range(2):                       # a restart continues after the last batch
        job = streams.ingest_stream(stream, store, str(tmp_path / "c"), order=("source_id",), normalise=normalise)
        job.awaitTermination()
    batch = ingest.first_wins(ingest.accept(feeds.ingest_feeds({"bayt": raw}))[0], [F.col("source_id")])
    columns = ["source_id", "title", "salary_min", "posted_at"]
    left, right = store.read("postings").select(columns), batch.select(columns)
    assert left.count() == right.count() == 60 and left.exceptAll(right).isEmpty()
    assert store.history().where("note LIKE 'ingest:%'").count() == 3


def test_stream_prefilter(spark, tmp_path):
    raw = feed_rows(spark, 30).select(F.col("job_url").alias("source_id"))
    for _ in range(2):
        raw.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.drop_repeats(streams.landed_stream(spark, str(tmp_path / "in"), raw.schema))
    job = (stream.writeStream.format("memory").queryName("prefiltered").trigger(availableNow=True)
           .option("checkpointLocation", str(tmp_path / "c")).start())
    job.awaitTermination()
    assert spark.table("prefiltered").count() == 30


def test_stream_keeps_the_first_arrival_by_default(spark, tmp_path):
    for pull in range(3):
        (spark.createDataFrame([(k, f"{k} {pull}") for k in "abc"[:pull + 1]], "source_id string, title string")
         .coalesce(1).write.parquet(str(tmp_path / "in" / str(pull))))
    stream = streams.landed_stream(spark, str(tmp_path / "in" / "*"), "source_id string, title string", files_per_trigger=1)
    store = Store(spark, str(tmp_path / "s"))
    streams.ingest_stream(stream, store, str(tmp_path / "c")).awaitTermination()
    assert {r.title for r in store.read("postings").collect()} == {"a 0", "b 1", "c 2"}


def test_damaged_files_give_a_reason(spark):
    import io
    import zipfile
    whole = io.BytesIO()
    with zipfile.ZipFile(whole, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("word/document.xml", "<w:document xmlns:w='http://schemas.openxmlformats.org/"
                         "wordprocessingml/2006/main'><w:p><w:t>text here</w:t></w:p></w:document>" * 1)
    broken = bytearray(whole.getvalue())
    broken[60:75] = b"\xff" * 15
    locked = bytearray(whole.getvalue())
    locked[6] |= 1                                    # the flag of an encrypted entry, in both headers
    locked[locked.rindex(b"PK\x01\x02") + 8] |= 1
    files = spark.createDataFrame([("a.docx", bytearray(whole.getvalue())), ("b.docx", broken), ("c.docx", locked), ("d.docx", None),
                                   ("e.txt", bytearray(b"plain"))], "path string, content binary")
    found = {r.path: (r.text, r.reason) for r in resumes.extract_text(files).collect()}
    assert found["a.docx"] == ("text here", None) and found["e.txt"] == ("plain", None)
    assert all(found[p][0] == "" and found[p][1] for p in ("b.docx", "c.docx", "d.docx"))


def test_missing_shared_folder_is_reported():
    from laborlens import session

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077"})()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_root(Session())


def test_texts_come_in_slices_bounded_by_bytes():
    batch = pa.record_batch({"k": list(range(6)), "text": ["a" * 9, None, "b" * 9, "c" * 99, "", "d"]})
    got = list(slices(iter([batch]), "text", 20))
    assert [b.column("k").to_pylist() for b in got] == [[0, 1, 2], [3], [4, 5]]


def test_summaries_and_pages_are_made_slice_by_slice(spark):
    """The model and the parser see a few MB at once, however many rows an Arrow batch holds."""
    def told(texts):
        assert texts.str.len().sum() <= 4 << 20
        return '{"summary_en": "' + texts.str.len().astype(str) + '", "summary_ar": ""}'
    rows = spark.range(0, 12, 1, 1).selectExpr("id posting_id", "repeat('x', 1000000) description")
    assert {r.summary_en for r in streams.summarise_rows(rows, told).collect()} == {"1000000"}


def test_known_keys_meet_no_whole_rows(spark, tmp_path):
    """A pull without new keys reads no text; one with some adds those, and all rows without a key."""
    store = Store(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([("a", "t", "x"), (None, "t", "y")], "source_id string, title string, description string")
    refresh.store_batch(store, rows, ["description"])
    old = ingest.unseen(rows.where("source_id = 'a'"), store.read("postings"))
    assert "Join" not in old._jdf.queryExecution().optimizedPlan().toString()
    refresh.store_batch(store, rows.unionByName(rows.selectExpr("'b' source_id", "title", "description")), ["description"])
    got = sorted((r.source_id or "", r.description) for r in store.read("postings").collect())
    assert got == [("", "y"), ("", "y"), ("a", "x"), ("b", "x")]


def test_each_pull_is_one_micro_batch(spark, tmp_path):
    """A pull of several files is one batch of the stream, so a store gets three commits."""
    (spark.range(40).selectExpr("id event_id", "'c' event_type", "id user_id").repartition(5)
     .write.parquet(str(tmp_path / "events.parquet")))
    before = set(glob.glob(scratch_root(spark) + "/arrivals-*"))
    assert entry.queries()["stream_ingest_first_wins"](spark, str(tmp_path)).count() == 40
    made, = set(glob.glob(scratch_root(spark) + "/arrivals-*")) - before
    assert Store(spark, f"{made}/store").history().count() == 3


def test_texts_are_saved_once_by_ingest_and_once_by_skills(spark, tmp_path, monkeypatch):
    saved, kept = [], ingest.cut_lineage

    def recorded(df, name):
        saved.append(set(df.columns))
        return kept(df, name)

    for module in (ingest, refresh, skills):
        monkeypatch.setattr(module, "cut_lineage", recorded)
    store = Store(spark, str(tmp_path / "store"))
    refresh.store_batch(store, feeds.ingest_feeds({"bayt": feed_rows(spark)}), [F.col("source")], NOW)
    refresh.refresh_skills(store)
    assert not [c for c in saved if "description" in c]
    assert len([c for c in saved if "clean" in c]) == 1
    assert "company" not in store.read("postings").columns
    assert refresh.with_companies(store).where("company IS NULL").isEmpty()


@pytest.mark.parametrize("most", [0, 8 << 20])
def test_first_arrivals_are_those_of_first_wins(spark, monkeypatch, most):
    monkeypatch.setattr(ingest, "KEY_BYTES", most)
    data = [("a", 2, "x"), ("a", 1, "y"), ("b", 1, "z"), (None, 1, "n"), (None, 1, "n"), ("c", 3, "p"), ("c", 1, None), ("", 1, "e")]
    df = spark.createDataFrame(data, "source_id string, at int, title string")
    rows = sorted(ingest.first_arrivals(df, [F.col("at")]).collect(), key=str)
    assert rows == sorted(ingest.first_wins(df, [F.col("at")]).collect(), key=str) and len(rows) == 6
    alone = df.where("source_id IN ('b', '')")
    assert sorted(ingest.first_arrivals(alone, [F.col("at")]).collect()) == sorted(alone.collect())


def test_weights_are_shuffled_once_for_the_scores(spark):
    texts = spark.createDataFrame([(i % 9, f"python sql w{i % 4} python") for i in range(40)], "posting_id long, clean string")
    found = spark.createDataFrame([(i, "python") for i in range(9)] + [(1, "python sql"), (77, "r")], "posting_id long, skill string")
    weights = skills.tfidf(texts)
    best = {(r.posting_id, r.term): r.weight for r in weights.collect()}
    scored = skills.skill_scores(found, weights)
    expected = {(r.posting_id, r.skill): max([best.get((r.posting_id, w), 0.0) for w in r.skill.split()]) for r in found.collect()}
    assert {(r.posting_id, r.skill): r.score for r in scored.collect()} == pytest.approx(expected)
    # the counts by key, and the skills that meet them
    plan = scored._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("hashpartitioning(posting_id") == 2 and not re.search(r"hashpartitioning\(posting_id#\w+, term", plan)
