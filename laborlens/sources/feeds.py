"""Tabular scraper feeds and their union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laborlens import vocab
from laborlens.functions import detect, labels, money
from laborlens.schema import ARRIVING, FEED_ROW, conform


def read_feed(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A landed feed; missing columns come as NULL, a ``searched_location`` is kept."""
    options = {"header": "true"} if fmt == "csv" else {"mergeSchema": "true"}
    raw = spark.read.format(fmt).options(**options).load(path)
    keep = [F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c)
            for c in FEED_ROW.names]
    searched = [c for c in raw.columns if c == "searched_location"]
    return raw.select(*keep, *searched)


def override_country(raw: DataFrame, site: str) -> DataFrame:
    """The country of a feed row is the location that was searched, or its last word."""
    searched = F.col("searched_location")
    country = detect.last_word(searched) if site in vocab.LAST_WORD_FEEDS else searched
    return raw.withColumn("country", country).drop("searched_location")


def normalise_feed(raw: DataFrame, site: str) -> DataFrame:
    """Feed rows to arriving postings."""
    def text(name):
        value = F.coalesce(F.col(name), F.lit(""))
        return F.when(value == "NaN", "").otherwise(value).alias(name)   # a missing number

    texts = ("title", "company", "location", "country", "job_url", "description", "job_type")
    rows = raw.select(*[text(c) for c in texts], "date_posted",
                      money.amount_pair(F.col("min_amount"), F.col("max_amount")).alias("pay"))
    out = rows.select(
        labels.source_id(site, F.col("job_url"), *[F.col(c) for c in ("title", "company", "location")])
        .alias("source_id"),
        "title",
        labels.or_default(F.col("company"), vocab.UNKNOWN_COMPANY).alias("company"),
        "location",
        F.when(F.col("country") != "", F.col("country"))
        .otherwise(detect.country_of_location(F.col("location"))).alias("country"),
        detect.feed_work_mode(F.col("job_type"), F.col("title")).alias("job_type"),
        detect.feed_contract(F.col("job_type"), F.col("title")).alias("contract_type"),
        "pay.salary_min", "pay.salary_max",
        F.col("description").alias("description"),
        F.lit(site).alias("source"),
        F.col("job_url").alias("source_url"),
        labels.parse_time(F.col("date_posted")).alias("posted_at"),
    )
    return conform(out, ARRIVING)


def union_feeds(frames) -> DataFrame:
    """All feeds as one frame; columns a feed lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def ingest_feeds(raw_by_site: dict[str, DataFrame]) -> DataFrame:
    """Normalise each site's raw rows and unite them."""
    def one(site, raw):
        if "searched_location" in raw.columns:
            raw = override_country(raw, site)
        return normalise_feed(raw, site)
    return union_feeds([one(site, raw) for site, raw in raw_by_site.items()])
