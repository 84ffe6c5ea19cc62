"""Row selection: freshness, request filters, search, validity, backfill candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laborlens.functions.text import fold_ascii

FRESH_DAYS = 30


def as_column(as_of) -> Column:
    """A Column, datetime or text time; the current time by default."""
    if as_of is None:
        return F.current_timestamp().cast("timestamp_ntz")
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp_ntz")


def cutoff(as_of=None, days: int = FRESH_DAYS) -> Column:
    return as_column(as_of) - F.make_dt_interval(F.lit(days))


def is_fresh(as_of=None, days: int = FRESH_DAYS, posted: str = "posted_at",
             scraped: str = "scraped_at") -> Column:
    """posted_at, or scraped_at where that is NULL, is at most ``days`` old.

    Written on the plain columns, so that both comparisons reach the Parquet scan.
    """
    since = cutoff(as_of, days)
    p, s = F.col(posted), F.col(scraped)
    return (p >= since) | (p.isNull() & (s >= since))


def is_expired(as_of=None, days: int = FRESH_DAYS, posted: str = "posted_at",
               scraped: str = "scraped_at") -> Column:
    """Older than ``days``; a posting without any time is neither fresh nor expired."""
    since = cutoff(as_of, days)
    p, s = F.col(posted), F.col(scraped)
    return (p < since) | (p.isNull() & (s < since))


def fresh(postings: DataFrame, as_of=None, days: int = FRESH_DAYS) -> DataFrame:
    return postings.where(is_fresh(as_of, days))


def request_filter(country=None, job_type=None, contract_type=None, seniority=None) -> Column:
    """Conjunction of the filters that are set; None, '' and 'all' mean no filter."""
    def given(value):
        return value not in (None, "", "all")

    terms = []
    if given(country):
        terms.append(F.lower("country") == country.lower())
    for name, value in (("job_type", job_type), ("contract_type", contract_type),
                        ("seniority", seniority)):
        if given(value):
            terms.append(F.col(name) == value)
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def request_match(prefix: str = "want_") -> Column:
    """The same for filters held in columns, one request per row."""
    def free(want):
        return F.coalesce(want, F.lit("")).isin("", "all")

    country = F.col(prefix + "country")
    terms = [free(country) | (F.lower("country") == F.lower(country))]
    for name in ("job_type", "contract_type", "seniority"):
        want = F.col(prefix + name)
        terms.append(free(want) | (F.col(name) == want))
    return reduce(lambda a, b: a & b, terms)


def matches_query(query: str | None, columns=("title", "company"),
                  raw_pattern: bool = False) -> Column:
    """Any column contains the trimmed, lower-cased query; case-blind for ASCII only.

    ``raw_pattern`` lets ``%`` and ``_`` in the query act as wildcards.
    """
    text = (query or "").strip().lower()
    if not text:
        return F.lit(True)

    def hit(name):
        folded = fold_ascii(F.col(name))
        if raw_pattern:
            return folded.like("%" + text.replace("\\", "\\\\") + "%")
        return folded.contains(text)
    return reduce(lambda a, b: a | b, [F.coalesce(hit(c), F.lit(False)) for c in columns])


def present(*names: str) -> Column:
    """All named text columns are neither NULL nor ''."""
    return reduce(lambda a, b: a & b, [F.col(n).isNotNull() & (F.col(n) != "") for n in names])


def in_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in another frame."""
    return df.join(ids.select(key), key, "left_semi")


def check_required(df: DataFrame, **messages: str) -> DataFrame:
    """Add ``error``: the message of the first required field that is NULL, '' or an empty list."""
    error = F.lit(None).cast("string")
    for name, message in reversed(messages.items()):
        kind = df.schema[name].dataType.typeName()
        column = F.col(name)
        empty = (F.coalesce(F.size(column), F.lit(0)) <= 0 if kind == "array"
                 else F.coalesce(column.cast("string"), F.lit("")) == "")
        error = F.when(empty, message).otherwise(error)
    return df.withColumn("error", error)


def lacks_summary() -> Column:
    return (F.coalesce("summary_en", F.lit("")) == "") | (F.coalesce("summary_ar", F.lit("")) == "")


def backfill_candidates(postings: DataFrame, as_of=None, limit: int | None = None) -> DataFrame:
    """Fresh postings with a description but without both summaries, newest first; all or ``limit``."""
    found = (fresh(postings, as_of).where(lacks_summary() & present("description"))
            .orderBy(F.coalesce("posted_at", "scraped_at").desc(), "posting_id"))
    return found if limit is None else found.limit(limit)


def training_rows(postings: DataFrame, ceiling: float = 500_000) -> DataFrame:
    low, high = F.col("salary_min"), F.col("salary_max")
    return postings.where((low > 0) & (high > 0) & (low < ceiling) & (high < ceiling))
