"""Schemas of the engine's tables and helpers that bring frames to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT, WHOLE, NUMBER, TIME = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampNTZType()

POSTING_DEFAULTS = {"job_type": "onsite", "contract_type": "full-time", "source": "adzuna"}


def _columns(names: str, kind: T.DataType) -> list[T.StructField]:
    return [T.StructField(name, kind) for name in names.split()]


_NAMED = T.StructType(_columns("display_name", TEXT))

API_POSTING = T.StructType(
    _columns("id title description", TEXT) + _columns("company location", _NAMED)
    + _columns("salary_min salary_max", NUMBER) + _columns("redirect_url created", TEXT))

FEED_ROW = T.StructType(_columns(
    "title description company location country job_url min_amount max_amount job_type date_posted",
    TEXT))

# a posting as the feeds deliver it, before it is stored
ARRIVING = T.StructType(
    _columns("source_id title company location country job_type contract_type", TEXT)
    + _columns("salary_min salary_max", NUMBER)
    + _columns("description source source_url raw_post_text", TEXT) + _columns("posted_at", TIME))

STORED = T.StructType(
    _columns("posting_id", WHOLE) + [f for f in ARRIVING.fields if f.name != "company"]
    + _columns("company_id", WHOLE) + _columns("seniority", TEXT) + _columns("scraped_at", TIME)
    + _columns("ingest_date", T.DateType()))

# summaries come later and row by row, so they are kept beside the wide posting rows
SUMMARY = T.StructType(
    _columns("posting_id", WHOLE) + _columns("summary_en summary_ar", TEXT)
    + _columns("written_at", TIME))

CARD = T.StructType(
    _columns("page_id", WHOLE) + _columns("card_no", T.IntegerType())
    + _columns("title company location tags url", TEXT))

DETAIL = T.StructType(_columns("page_id", WHOLE) + _columns("description salary_text", TEXT))


def conform(df: DataFrame, schema: T.StructType, defaults: dict | None = None, keep=()) -> DataFrame:
    """Add what is missing (a default only where the column is absent), cast, order columns; ``keep`` follow."""
    defaults = defaults or {}
    present = set(df.columns)

    def column(field):
        source = F.col(field.name) if field.name in present else F.lit(defaults.get(field.name))
        return source.cast(field.dataType).alias(field.name)

    return df.select(*[column(f) for f in schema.fields], *keep)
