"""Dictionary lookups with a fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laborlens import vocab
from laborlens.functions.detect import canonical_country


def label_table(spark: SparkSession, rows=vocab.LABEL_ROWS) -> DataFrame:
    return spark.createDataFrame(list(rows), "lang string, key string, label string")


def translate(df: DataFrame, labels: DataFrame, key: str, lang: str = "en",
              out: str = "label", fallback: str = "en") -> DataFrame:
    """Add the key's label in a language; the key itself where there is none.

    A language without any labels falls back to another as a whole.
    """
    known = labels.where(F.col("lang") == lang)
    if lang != fallback and known.isEmpty():
        known = labels.where(F.col("lang") == fallback)
    known = known.select(F.col("key").alias("_key"), F.col("label").alias("_label"))
    return (df.join(known, F.col(key) == F.col("_key"), "left")
            .withColumn(out, F.coalesce("_label", key)).drop("_key", "_label"))


def fx_table(spark: SparkSession, rows=vocab.FX_ROWS) -> DataFrame:
    return spark.createDataFrame(
        list(rows), "fx_country string, currency string, symbol string, scale double, rate double")


def with_fx(df: DataFrame, fx: DataFrame, country: str = "country") -> DataFrame:
    """Add the currency row of the canonical country; every country has one or the default."""
    return (df.withColumn("canonical", canonical_country(F.col(country)))
            .join(fx, F.col("canonical") == F.col("fx_country"), "left").drop("fx_country"))
