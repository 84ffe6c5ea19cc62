"""Paged JSON results of a jobs API, read from landed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laborlens import vocab
from laborlens.functions.detect import work_mode
from laborlens.functions.labels import parse_time
from laborlens.schema import API_POSTING

PAGE = T.StructType([
    T.StructField("results", T.ArrayType(API_POSTING)),
    T.StructField("_corrupt_record", T.StringType()),
])


def read_api_pages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Landed pages below ``country=<code>/`` folders, one JSON page per line.

    Returns the single results with their country code, and the pages that did not parse.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    pages = spark.read.text(path).select("country", F.from_json("value", PAGE, options).alias("p"))
    good = (pages.where(F.col("p._corrupt_record").isNull())
            .select("country", F.explode("p.results").alias("r")).select("country", "r.*"))
    bad = pages.where(F.col("p._corrupt_record").isNotNull()).select("country", "p._corrupt_record")
    return good, bad


def country_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in vocab.API_COUNTRY_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, code), F.upper(code))


def normalise_api(raw: DataFrame, country: Column | None = None) -> DataFrame:
    """API results to arriving postings. The contract type is left to the store's default."""
    title = F.coalesce("title", F.lit(""))
    description = F.coalesce("description", F.lit(""))
    return raw.select(
        F.col("id").alias("source_id"),
        title.alias("title"),
        F.coalesce("company.display_name", F.lit(vocab.UNKNOWN_COMPANY)).alias("company"),
        F.coalesce("location.display_name", F.lit("")).alias("location"),
        country_name(F.col("country") if country is None else country).alias("country"),
        work_mode(title, description).alias("job_type"),
        "salary_min", "salary_max",
        description.alias("description"),
        F.lit(vocab.API_SOURCE).alias("source"),
        F.coalesce("redirect_url", F.lit("")).alias("source_url"),
        parse_time(F.col("created")).alias("posted_at"),
    )
