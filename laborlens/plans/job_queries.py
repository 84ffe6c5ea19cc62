"""Registered queries that run whole jobs: models, stores, streams."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from laborlens import vocab
from laborlens.functions.text import clean_words
from laborlens.operators import aggregates, clusters, ingest, salary, vectors
from laborlens.operators.store import Store
from laborlens.plans import refresh
from laborlens.plans.ingest_queries import SENIORITY_CASE, _CANONICAL, _feed_sql, _raw_feed
from laborlens.plans.skill_queries import documents
from laborlens.plans.tables import POSTINGS, as_of, postings, query, table
from laborlens.session import cut_lineage, scratch_path, spread
from laborlens.sources import feeds
from laborlens.streaming import ingest as streams

# --- salary model -----------------------------------------------------------------------

# titles of the supplied orders carry no level, so the description names it
_WORDING = {"lead": "head of unit", "senior": "sr. role", "mid": "intermediate", "junior": "graduate"}


def _described(spark, d):
    words = F.create_map(*[F.lit(x) for kv in _WORDING.items() for x in kv])
    return postings(spark, d).withColumn("description", F.try_element_at(words, F.col("seniority")))


_DESCRIBED = f"""
described AS (SELECT *, CASE seniority {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _WORDING.items())} END AS description FROM postings),
leveled AS (SELECT *, {SENIORITY_CASE} AS level, {_CANONICAL} AS canonical
            FROM (SELECT *, lower(title || ' ' || coalesce(description, '')) AS x FROM described))"""


@query("salary_features", f"""
WITH {POSTINGS}, {_DESCRIBED}
SELECT posting_id, level, CASE level WHEN 'junior' THEN 0 WHEN 'lead' THEN 1 WHEN 'mid' THEN 2 ELSE 3 END AS seniority_code,
       CASE WHEN job_type IN ('remote', 'hybrid') THEN 1 ELSE 0 END AS has_remote,
       CASE WHEN contract_type = 'internship' THEN 1 ELSE 0 END AS is_internship, canonical,
       CASE WHEN canonical = 'United States' THEN 1 ELSE 0 END AS is_us
FROM leveled
""")
def salary_features(spark, d):
    return salary.salary_features(_described(spark, d)).select(
        "posting_id", "level", "seniority_code", "has_remote", "is_internship", "canonical", "is_us")


@query("salary_training_frame", f"""
WITH {POSTINGS}, {_DESCRIBED}
SELECT posting_id, round(CASE WHEN canonical = 'United Kingdom' THEN salary_min / 0.8 ELSE salary_min END, 4) AS salary_min,
       round(CASE WHEN canonical = 'United Kingdom' THEN salary_max / 0.8 ELSE salary_max END, 4) AS salary_max
FROM leveled WHERE salary_min > 0 AND salary_max > 0 AND salary_min < 500000 AND salary_max < 500000
""")
def salary_training_frame(spark, d):
    frame = salary.training_frame(_described(spark, d))
    return frame.select("posting_id", F.round("salary_min", 4).alias("salary_min"),
                        F.round("salary_max", 4).alias("salary_max"))


@query("salary_eval")
def salary_eval(spark, d):
    """Both regressors trained on four fifths, scored on the rest."""
    frame = salary.training_frame(_described(spark, d))
    return salary.evaluate(salary.train(frame), frame)


@query("salary_predict")
def salary_predict(spark, d):
    """Local salary ranges for every posting by a model trained on them."""
    rows = _described(spark, d)
    models = salary.train(salary.training_frame(rows))
    return salary.predict(models, rows).select("posting_id", "predicted_min", "predicted_max",
                                               "predicted_period", "currency", "symbol")


@query("salary_enrich", f"""
WITH {POSTINGS}
SELECT posting_id, salary_min, salary_max, CASE WHEN salary_max IS NULL THEN 1000.0::DOUBLE END AS predicted_min,
       CASE WHEN salary_max IS NULL THEN 2000.0::DOUBLE END AS predicted_max,
       CASE WHEN salary_max IS NULL THEN 'annual' END AS predicted_period
FROM postings
""")
def salary_enrich(spark, d):
    """Enrichment with a fixed predictor in the model's place."""
    def fixed(df):
        return (df.withColumn("predicted_min", F.lit(1000.0)).withColumn("predicted_max", F.lit(2000.0))
                .withColumn("predicted_period", F.lit("annual")))
    rows = postings(spark, d, False, False).select("posting_id", "salary_min", "salary_max")
    return salary.enrich(rows, fixed)


@query("prediction_scores", """
WITH p AS (SELECT extendedprice AS y, avg(extendedprice) OVER (PARTITION BY q) AS p
           FROM (SELECT l_extendedprice AS extendedprice, l_quantity AS q FROM lineitem))
SELECT round(avg(abs(y - p)), 3) AS mae, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)), 6) AS r2,
       count(*) AS rows FROM p
""")
def prediction_scores(spark, d):
    """MAE and R² of predicting each price by the mean of its quantity."""
    lines = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y"), "l_quantity")
    means = lines.groupBy("l_quantity").agg(F.avg("y").alias("p"))
    scores = aggregates.regression_scores(lines.join(means, "l_quantity"), "y", "p")
    return scores.select(F.round("mae", 3).alias("mae"), F.round("r2", 6).alias("r2"), "rows")


# --- clusters ---------------------------------------------------------------------------

@query("clusters")
def cluster_counts(spark, d):
    """Sizes of the description clusters, with their term labels."""
    return clusters.cluster_sizes(clusters.cluster_texts(documents(spark, d, clean_words)))


@query("cluster_projection")
def cluster_projection(spark, d):
    """Two-dimensional positions of all descriptions with their cluster."""
    clustered = clusters.cluster_texts(documents(spark, d, clean_words))
    return clusters.project(clustered).select("posting_id", "x", "y", "cluster")


# --- stores -----------------------------------------------------------------------------

@query("ingest_store", f"""
WITH arriving AS ({' UNION ALL '.join(_feed_sql(s) for s in vocab.FEED_LOCATIONS)}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY description, country, salary_min NULLS FIRST) AS n FROM arriving)
SELECT source_id, title, company, country, job_type, contract_type, salary_min, salary_max, source, posted_at
FROM numbered WHERE n = 1
""")
def ingest_store(spark, d):
    """All feeds into a store, twice: the second pull adds nothing."""
    store = Store(spark, scratch_path(spark, "store"))
    rows = feeds.ingest_feeds({site: _raw_feed(spark, d, site) for site in vocab.FEED_LOCATIONS})
    order = [F.col(c).asc() for c in ("description", "country", "salary_min")]
    for _ in range(2):
        refresh.store_batch(store, rows, order)
    return refresh.with_companies(store).select(
        "source_id", "title", "company", "country", "job_type", "contract_type", "salary_min",
        "salary_max", "source", "posted_at")


@query("refresh_gold", f"""
WITH arriving AS ({' UNION ALL '.join(_feed_sql(s) for s in vocab.FEED_LOCATIONS)}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY description, country, salary_min NULLS FIRST) AS n FROM arriving),
leveled AS (SELECT {SENIORITY_CASE} AS seniority FROM (SELECT lower(title || ' ' || description) AS x FROM numbered WHERE n = 1))
SELECT seniority, count(*) AS count FROM leveled GROUP BY 1
""")
def refresh_gold(spark, d):
    """Ingest, skills, seniority and gold tables on a store; one of the gold tables."""
    store = Store(spark, scratch_path(spark, "store"))
    rows = feeds.ingest_feeds({site: _raw_feed(spark, d, site) for site in vocab.FEED_LOCATIONS})
    day = datetime(2024, 1, 10)
    refresh.store_batch(store, rows, [F.col(c).asc() for c in ("description", "country", "salary_min")], day)
    refresh.refresh_skills(store)
    refresh.refresh_seniority(store)
    refresh.refresh_gold(store, day)
    return store.read("seniority_breakdown")


@query("schema_evolution", """
SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier
""")
def schema_evolution(spark, d):
    """An append with an added column: older rows read as NULL."""
    store = Store(spark, scratch_path(spark, "store"))
    older = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    newer = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                                               F.col("c_mktsegment").alias("segment"))
    store.commit(append={"people": older})
    store.commit(append={"people": newer})
    return store.read("people")


@query("snapshot_restore", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def snapshot_restore(spark, d):
    """A table is overwritten, then the earlier commit is restored."""
    store = Store(spark, scratch_path(spark, "store"))
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    first = store.commit(replace={"people": rows})
    store.commit(replace={"people": ingest.reset_columns(rows, ["s_name"])})
    store.restore(first)
    return store.read("people")


@query("gold_read_through", """
SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1
""")
def gold_read_through(spark, d):
    """A gold table is computed when missing and read on the next call."""
    store = Store(spark, scratch_path(spark, "store"))

    def compute():
        return table(spark, d, "documents").groupBy("source").agg(
            F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
    store.read_or_compute("by_source", compute)
    return store.read_or_compute("by_source", compute)


@query("index_incremental", f"""
WITH {POSTINGS} SELECT posting_id FROM fresh
""")
def index_incremental(spark, d):
    """Index as of an earlier day, then prune and add as of the newest day."""
    newest = as_of(spark, d)
    earlier = newest - F.expr("INTERVAL 20 DAYS")
    rows = postings(spark, d, False, False)
    documents_ = rows.select("posting_id", F.concat_ws(" ", "job_type", "contract_type").alias("document"),
                             "job_type", "posted_at", "scraped_at").withColumn("meta", F.struct("job_type"))
    none = documents_.limit(0)
    first = cut_lineage(vectors.index_additions(documents_, none, earlier, reindex=True), "index")
    kept = vectors.prune_expired(first, rows, newest)
    added = vectors.index_additions(documents_, first, newest)
    return kept.unionByName(added).select("posting_id")


# --- streams ----------------------------------------------------------------------------

@query("stream_dedup_final", """
SELECT event_id, user_id, event_type, value FROM events
""")
def stream_dedup_final(spark, d):
    """Events arrive twice as a stream; the stored table holds each once."""
    schema = table(spark, d, "events").schema
    # a glob, as the source may be one file or a folder of files
    stream = (streams.landed_stream(spark, f"{d.rstrip('/')}/event[s].parquet", schema)
              .withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))))
    root = scratch_path(spark, "stream")
    job = streams.stored_first(stream, f"{root}/table", f"{root}/checkpoint",
                               ["arrived_at", "copy"], "event_id")
    job.awaitTermination()
    return spark.read.parquet(f"{root}/table").select("event_id", "user_id", "event_type", "value")


@query("stream_ingest_first_wins", """
SELECT 'e' || event_id AS source_id, event_type || ' 0' AS title, user_id::DOUBLE AS salary_min FROM events
""")
def stream_ingest_first_wins(spark, d):
    """Copies of postings that differ land in three pulls; the store keeps what arrived first.

    Every pull holds all keys again with another title and pay, and is a micro-batch of its own.
    """
    root = scratch_path(spark, "arrivals")
    events = table(spark, d, "events")
    for pull in range(3):
        rows = events.select(F.concat(F.lit("e"), "event_id").alias("source_id"),
                             F.concat("event_type", F.lit(f" {pull}")).alias("title"),
                             (F.col("user_id") + pull).cast("double").alias("salary_min"))
        rows.write.mode("append").parquet(f"{root}/landed/{pull}")
    files = spark.read.parquet(f"{root}/landed/0").select("_metadata.file_path").distinct().count()     # the same in each pull
    stream = streams.landed_stream(spark, f"{root}/landed/*", "source_id string, title string, salary_min double",
                                   files_per_trigger=max(1, files))
    store = Store(spark, f"{root}/store")
    streams.ingest_stream(stream, store, f"{root}/checkpoint").awaitTermination()
    return store.read("postings").select("source_id", "title", "salary_min")


@query("summaries_written", """
SELECT doc_id AS posting_id, 'text of ' || length(trim(text)) || ' characters' AS summary_en,
       '- ' || length(trim(text)) AS summary_ar FROM documents
""")
def summaries_written(spark, d):
    """Summaries of all whole texts by a plugged-in function that states their length."""
    return _summaries(spark, d)


@query("summaries_cut", """
SELECT doc_id AS posting_id, 'text of ' || least(3000, length(trim(text))) || ' characters' AS summary_en,
       '- ' || least(3000, length(trim(text))) AS summary_ar FROM documents
""")
def summaries_cut(spark, d):
    """The same for a model that takes 3,000 characters: here the cut is the feature."""
    return _summaries(spark, d, 3000)


def _summaries(spark, d, chars=None):
    def summarise(texts):
        return ('{"summary_en": "text of ' + texts.str.len().astype(str) + ' characters", "summary_ar": ["'
                + texts.str.len().astype(str) + '",]}')
    docs = spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    rows = docs.select(F.col("doc_id").alias("posting_id"), F.col("text").alias("description"))
    return streams.summarise_rows(rows, summarise, chars)
