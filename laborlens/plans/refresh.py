"""The chain that follows each ingest, on a store: skills, seniority, model, index, gold."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlens.functions import detect, labels
from laborlens.functions.text import clean_text, clean_words
from laborlens.operators import aggregates, clusters, filters, ingest, salary, skills, vectors
from laborlens.operators.store import Store
from laborlens.schema import STORED, SUMMARY, conform
from laborlens.session import cut_lineage

log = logging.getLogger(__name__)


def store_batch(store: Store, arriving: DataFrame, order, scraped_at=None, note: str = "") -> None:
    """First-wins ingest of one batch: postings and companies appear together.

    The seniority is read from the text here, so that no later step rewrites the rows for it.
    """
    rows, _ = ingest.accept(arriving)
    if store.exists("postings"):
        # keys are compared first, so a pull that brings nothing new sends no whole rows
        rows = ingest.unseen(rows, store.read("postings"))
    base = 0
    if store.exists("postings"):
        base = (store.read("postings").agg(F.max("posting_id")).first()[0] or 0) + 1
    scraped = filters.as_column(scraped_at)
    new = (ingest.first_arrivals(rows, order)
           .withColumn("posting_id", F.monotonically_increasing_id() + F.lit(base))
           .withColumn("company_id", ingest.company_id(F.col("company")))
           .withColumn("seniority", detect.seniority(F.col("title"), F.col("description")))
           .withColumn("scraped_at", scraped)
           .withColumn("ingest_date", scraped.cast("date")))
    # rows are written once, with the companies' names beside them, which the table's schema leaves out
    staged = store.stage("postings", conform(new, STORED, keep=["company"]), STORED)
    names = store.spark.read.schema("company string").parquet(staged.folder).withColumnRenamed("company", "name")
    known = (store.read("companies") if store.exists("companies")
             else names.limit(0).withColumn("company_id", F.lit(0).cast("long")))
    companies = (ingest.new_dimension_rows(names, known, "name")
                 .withColumn("company_id", ingest.company_id(F.col("name"))))
    store.commit(append={"postings": staged, "companies": companies}, note=note)


def refresh_skills(store: Store) -> None:
    """Skills of all postings with their TF-IDF scores; replaces equal keys, keeps the rest."""
    texts = store.read("postings").select("posting_id", clean_text(F.col("description")).alias("clean"))
    texts = cut_lineage(texts, "clean")                         # read for the skills and for the weights
    found = cut_lineage(skills.match_skills(texts), "found")    # read for the scores and for the names
    weights = skills.tfidf(texts, stopwords=skills.english_stopwords(), saved=True)
    scored = skills.skill_scores(found, weights)
    if store.exists("posting_skills"):
        scored = ingest.replace_rows(store.read("posting_skills"), scored, ["posting_id", "skill"])
    lexicon = skills.lexicon_table(store.spark).withColumnRenamed("skill", "name")
    used = lexicon.join(found.select(F.col("skill").alias("name")).distinct(), "name", "left_semi")
    if store.exists("skills"):
        used = ingest.get_or_create(used, store.read("skills"), "name")
    store.commit(replace={"posting_skills": scored, "skills": used}, note="skills")


def refresh_seniority(store: Store) -> None:
    """Label rows that came without a level; rewrites the table only if there are any."""
    rows = store.read("postings")
    if rows.where("seniority IS NULL").isEmpty():
        return
    level = detect.fill_seniority(F.col("seniority"), F.col("title"), F.col("description"))
    store.commit(replace={"postings": rows.withColumn("seniority", level)}, note="seniority")


def refresh_model(store: Store, path: str | None = None) -> None:
    """Retrain when enough salaries are labelled."""
    rows = with_companies(store)
    if path and salary.retrain_due(rows):
        salary.train(salary.training_frame(rows)).save(path)


def with_companies(store: Store) -> DataFrame:
    """Postings with their company name."""
    companies = store.read("companies").withColumnRenamed("name", "company")
    return store.read("postings").join(companies, "company_id", "left")


def with_summaries(store: Store) -> DataFrame:
    """Postings with the last summaries written for them."""
    postings = store.read("postings")
    if store.exists("summaries"):
        written = ingest.last_wins(store.read("summaries"), ["posting_id"], [F.desc("written_at")])
    else:
        written = store.spark.createDataFrame([], SUMMARY)
    return postings.join(written.drop("written_at"), "posting_id", "left")


def posting_documents(postings: DataFrame, posting_skills: DataFrame) -> DataFrame:
    """(posting_id, document, meta, posted_at, scraped_at) from postings with company names."""
    rows = postings.join(skills.skills_per_posting(posting_skills), "posting_id", "left")
    fields = ("title", "company", "location", "country", "job_type", "contract_type", "seniority",
              "salary_min", "salary_max", "skills", "description")
    document = labels.posting_document(*[F.col(c) for c in fields])
    meta = labels.posting_meta(*[F.col(c) for c in ("country", "job_type", "seniority", "contract_type")])
    return rows.select("posting_id", document.alias("document"), meta.alias("meta"),
                       "posted_at", "scraped_at")


def refresh_index(store: Store, as_of=None, embed=vectors.hashing_embed, reindex: bool = False) -> None:
    """Prune what expired, then add fresh postings that are not indexed."""
    postings = with_companies(store)
    documents = posting_documents(postings, store.read("posting_skills"))
    if store.exists("posting_vectors") and not reindex:
        index = store.read("posting_vectors")
        kept = vectors.prune_expired(index, postings, as_of)
        added = vectors.index_additions(documents, index, as_of, embed=embed)
        store.commit(replace={"posting_vectors": kept.unionByName(added)}, note="index")
    else:
        empty = store.spark.createDataFrame([], "posting_id long")
        added = vectors.index_additions(documents, empty, as_of, reindex=True, embed=embed)
        store.commit(replace={"posting_vectors": added}, note="index")


def gold_tables(store: Store, as_of=None) -> dict[str, DataFrame]:
    """The dashboard tables; all but the clusters are plain lazy plans."""
    postings = store.read("postings")
    fresh = filters.fresh(postings, as_of)
    found, names = store.read("posting_skills"), store.read("skills")
    texts = fresh.select("posting_id", clean_words(F.col("description")).alias("clean"))
    return {
        "term_report": skills.term_report(texts),
        "skill_trends": skills.skill_demand(found, names, 25, fresh),
        "cooccurrence": skills.cooccurrence(found, 12, fresh),
        "salary_by_country": aggregates.salary_by_country(postings, as_of),
        "seniority_breakdown": aggregates.seniority_breakdown(postings, as_of),
        "salary_by_seniority": aggregates.salary_by_seniority(postings, as_of),
    }


def refresh_gold(store: Store, as_of=None) -> None:
    store.commit(replace=gold_tables(store, as_of), note="gold")


def refresh_clusters(store: Store, as_of=None) -> None:
    texts = (filters.fresh(store.read("postings"), as_of)
             .select("posting_id", clean_words(F.col("description")).alias("clean")))
    clustered = clusters.cluster_texts(texts)
    if clustered is not None:
        points = clusters.project(clustered).select("posting_id", "x", "y", "cluster")
        store.commit(replace={"cluster_points": points, "cluster_sizes": clusters.cluster_sizes(clustered)},
                     note="clusters")


def refresh_all(store: Store, as_of=None, model_path: str | None = None,
                embed=vectors.hashing_embed) -> dict[str, str | None]:
    """Run every step; a failing one is reported and does not stop the others."""
    steps = {
        "skills": lambda: refresh_skills(store),
        "seniority": lambda: refresh_seniority(store),
        "model": lambda: refresh_model(store, model_path),
        "index": lambda: refresh_index(store, as_of, embed),
        "gold": lambda: refresh_gold(store, as_of),
        "clusters": lambda: refresh_clusters(store, as_of),
    }
    outcome = {}
    for name, step in steps.items():
        try:
            step()
            outcome[name] = None
        except Exception as error:
            log.exception("refresh step %s failed", name)
            outcome[name] = str(error)
    return outcome
