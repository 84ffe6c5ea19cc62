"""Dashboard and report aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from laborlens import vocab
from laborlens.functions import money
from laborlens.operators.filters import fresh, present


def kpi_block(postings: DataFrame, as_of=None, approximate: bool = False) -> DataFrame:
    """One row of dashboard figures over fresh postings, and the last scrape of all.

    The counts read only the fresh part of the table; the last scrape is a one-column scan.
    """
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    last = postings.agg(F.max("scraped_at")).scalar()
    return fresh(postings, as_of).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("job_type") == "remote").alias("remote"),
        F.count_if(F.col("contract_type") == "internship").alias("internships"),
        distinct("company_id").alias("companies"),
        distinct("country").alias("countries"),
        F.count_if(F.col("source") == vocab.SOCIAL_SOURCE).alias("social_posts"),
    ).withColumn("last_updated", last)


def distinct_values(postings: DataFrame, column: str, as_of=None) -> DataFrame:
    """Sorted distinct non-NULL values of fresh postings."""
    return (fresh(postings, as_of).where(F.col(column).isNotNull())
            .select(column).distinct().orderBy(column))


def filter_options(postings: DataFrame, as_of=None) -> DataFrame:
    """Values for the country and seniority filters, from one scan."""
    pairs = F.array(*[F.struct(F.lit(c).alias("filter"), F.col(c).alias("value"))
                      for c in ("country", "seniority")])
    return (fresh(postings, as_of).select(F.inline(pairs)).where("value IS NOT NULL")
            .distinct().orderBy("filter", "value"))


def seniority_breakdown(postings: DataFrame, as_of=None) -> DataFrame:
    return (fresh(postings, as_of).where(F.col("seniority").isNotNull())
            .groupBy("seniority").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), "seniority"))


def _report_salary(postings: DataFrame, key: str, as_of) -> DataFrame:
    """Mean dollar salaries by key, half-even to whole numbers, highest first."""
    country = F.col("country")
    return (fresh(postings, as_of)
            .where(F.col("salary_min").isNotNull() & F.col(key).isNotNull())
            .groupBy(key)
            .agg(F.bround(F.avg(money.report_usd(F.col("salary_min"), country)), 0).alias("avg_min"),
                 F.bround(F.avg(money.report_usd(F.col("salary_max"), country)), 0).alias("avg_max"),
                 F.count("salary_min").alias("job_count"))
            .orderBy(F.desc_nulls_last("avg_max"), key))


def salary_by_seniority(postings: DataFrame, as_of=None) -> DataFrame:
    return _report_salary(postings, "seniority", as_of)


def salary_by_country(postings: DataFrame, as_of=None) -> DataFrame:
    return _report_salary(postings, "country", as_of)


def salary_stats(postings: DataFrame) -> DataFrame:
    """Mean salaries by country and work mode over all postings; NULL groups kept."""
    return (postings.where(F.col("salary_min").isNotNull())
            .groupBy("country", "job_type")
            .agg(F.round(F.avg("salary_min"), 0).alias("avg_min"),
                 F.round(F.avg("salary_max"), 0).alias("avg_max"),
                 F.count(F.lit(1)).alias("job_count"))
            .orderBy(F.desc_nulls_last("avg_max"), "country", "job_type"))


def contract_counts(postings: DataFrame, as_of=None) -> DataFrame:
    return (fresh(postings, as_of).groupBy("contract_type")
            .agg(F.count(F.lit(1)).alias("count")))


def percent(part: Column, whole: Column, places: int = 1) -> Column:
    return F.when(whole > 0, F.round(part * 100 / whole, places)).otherwise(0.0)


def contract_share(postings: DataFrame, as_of=None) -> DataFrame:
    """Contract counts with their share of all fresh postings."""
    counts = contract_counts(postings, as_of)
    total = fresh(postings, as_of).agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("pct", percent(F.col("count"), total))


def top_countries(postings: DataFrame, as_of=None, limit: int = 6) -> DataFrame:
    """Countries with most fresh postings and their size against the first.

    The window without key runs over the ``limit`` rows of the report.
    """
    counts = (fresh(postings, as_of).where(present("country")).groupBy("country")
              .agg(F.count(F.lit(1)).alias("cnt"))
              .orderBy(F.desc("cnt"), "country").limit(limit))
    return counts.withColumn("pct", percent(F.col("cnt"), F.max("cnt").over(W.partitionBy())))


def percent_of_first(report: DataFrame, count: str = "job_count") -> DataFrame:
    """Whole percentage of the largest count of a top-k report."""
    share = F.col(count) * 100 / F.max(count).over(W.partitionBy())
    return report.withColumn("pct", F.floor(share).cast("int"))


def summary_progress(postings: DataFrame) -> DataFrame:
    done = F.count_if(present("summary_en"))
    total = F.count(F.lit(1))
    return postings.agg(total.alias("total"), done.alias("summarised"),
                        F.when(total > 0, F.floor(done * 100 / total)).otherwise(0)
                        .cast("int").alias("progress"))


def labelled_salaries(postings: DataFrame) -> int:
    """How many postings carry a salary; one number, used to decide on retraining."""
    return postings.where(F.col("salary_min").isNotNull()).count()


def regression_scores(predictions: DataFrame, label: str, prediction: str) -> DataFrame:
    """MAE and R² in one pass over the rows, from sums of errors and of squares."""
    y, p = F.col(label), F.col(prediction)
    return predictions.agg(
        F.avg(F.abs(y - p)).alias("mae"),
        (1 - F.sum((y - p) * (y - p)) / (F.var_pop(y) * F.count(y))).alias("r2"),
        F.count(F.lit(1)).alias("rows"))
