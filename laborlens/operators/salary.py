"""Salary features, model training, prediction and enrichment."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlens.functions import detect, money
from laborlens.operators.aggregates import labelled_salaries, regression_scores
from laborlens.operators.filters import training_rows
from laborlens.operators.lookup import fx_table, with_fx
from laborlens.session import cut_lineage

SENIORITY_CODES = {"junior": 0, "lead": 1, "mid": 2, "senior": 3}    # alphabetical
FEATURES = ("seniority_code", "has_remote", "is_internship", "is_us")
RETRAIN_FROM = 50


def salary_features(postings: DataFrame) -> DataFrame:
    """Add seniority read from the text, its code, the flags and the canonical country."""
    level = detect.seniority(F.col("title"), F.col("description"))
    code = F.lit(0)
    for name, number in SENIORITY_CODES.items():
        code = F.when(F.col("level") == name, number).otherwise(code)
    return (postings.withColumn("level", level).withColumn("seniority_code", code)
            .withColumn("has_remote", detect.has_remote(F.col("job_type")))
            .withColumn("is_internship", detect.is_internship(F.col("contract_type")))
            .withColumn("canonical", detect.canonical_country(F.col("country")))
            .withColumn("is_us", F.when(F.col("canonical") == "United States", 1).otherwise(0)))


@dataclass
class SalaryModels:
    low: PipelineModel
    high: PipelineModel

    def save(self, path: str) -> None:
        self.low.write().overwrite().save(f"{path}/min")
        self.high.write().overwrite().save(f"{path}/max")

    @classmethod
    def load(cls, path: str) -> SalaryModels:
        return cls(PipelineModel.load(f"{path}/min"), PipelineModel.load(f"{path}/max"))


def training_frame(postings: DataFrame, key: str = "posting_id") -> DataFrame:
    """Usable labelled rows in dollars with ``is_test`` set on a stable fifth of them."""
    rows = salary_features(training_rows(postings))
    for name in ("salary_min", "salary_max"):
        rows = rows.withColumn(name, money.training_usd(F.col(name), F.col("canonical")))
    return rows.withColumn("is_test", F.pmod(F.xxhash64(F.lit(42), F.col(key)), F.lit(5)) == 0)


def train(frame: DataFrame, trees: int = 100, rate: float = 0.05, depth: int = 5,
          seed: int = 42) -> SalaryModels:
    """Two boosted-tree regressors on the training rows.

    Squared-error trees see rows with equal features only through their count and mean, and
    the four features have few combinations, so each combination is one weighted row: the
    data are aggregated once and the boosting rounds run on that small table.
    """
    grouped = (frame.where(~F.col("is_test")).groupBy(*FEATURES)
               .agg(F.avg("salary_min").alias("salary_min"), F.avg("salary_max").alias("salary_max"),
                    F.count(F.lit(1)).cast("double").alias("weight"))
               .coalesce(1).persist())

    def fit(label):
        return Pipeline(stages=[
            VectorAssembler(inputCols=list(FEATURES), outputCol="features"),
            GBTRegressor(featuresCol="features", labelCol=label, predictionCol=f"usd_{label}",
                         weightCol="weight", maxIter=trees, stepSize=rate, maxDepth=depth,
                         seed=seed, maxMemoryInMB=64),
        ]).fit(grouped)
    with ThreadPoolExecutor(2) as pool:     # many short jobs each, so both run at a time
        low, high = pool.map(inheritable_thread_target(grouped.sparkSession)(fit),
                             ("salary_min", "salary_max"))
    grouped.unpersist()
    return SalaryModels(low, high)


def raw_predictions(models: SalaryModels, rows: DataFrame) -> DataFrame:
    """Add usd_salary_min and usd_salary_max.

    The trees see each combination of the features once; the few predictions are then joined.
    """
    combinations = rows.select(*FEATURES).distinct()
    high = models.high.transform(models.low.transform(combinations).drop("features"))
    predicted = cut_lineage(high.select(*[F.col(c).alias(f"_{c}") for c in FEATURES], "usd_salary_min", "usd_salary_max"),
                            "predicted")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in FEATURES])
    return rows.join(predicted, same).drop(*[f"_{c}" for c in FEATURES])


def evaluate(models: SalaryModels, frame: DataFrame) -> DataFrame:
    """(target, mae, r2, rows) on the held-out rows."""
    held = raw_predictions(models, frame.where("is_test"))
    return (regression_scores(held, "salary_min", "usd_salary_min")
            .withColumn("target", F.lit("salary_min"))
            .unionByName(regression_scores(held, "salary_max", "usd_salary_max")
                         .withColumn("target", F.lit("salary_max"))))


def to_local(predicted: DataFrame, fx: DataFrame | None = None) -> DataFrame:
    """Add predicted_min, predicted_max, predicted_period, currency and symbol."""
    rows = with_fx(predicted, fx_table(predicted.sparkSession) if fx is None else fx)
    pay = money.local_salary(F.col("usd_salary_min"), F.col("usd_salary_max"), F.col("canonical"),
                             F.col("scale"), F.col("rate"))
    return (rows.withColumn("_pay", pay)
            .withColumn("predicted_min", F.col("_pay.salary_min"))
            .withColumn("predicted_max", F.col("_pay.salary_max"))
            .withColumn("predicted_period", F.col("_pay.period"))
            .drop("_pay", "scale", "rate", "usd_salary_min", "usd_salary_max"))


def predict(models: SalaryModels, postings: DataFrame) -> DataFrame:
    """Salary range in local money for every row."""
    return to_local(raw_predictions(models, salary_features(postings)))


def enrich(postings: DataFrame, predictor) -> DataFrame:
    """Predictions only where a salary bound is missing; real values stay as they are.

    ``predictor(df)`` adds predicted_min, predicted_max and predicted_period.
    """
    rows = (postings.withColumn("salary_min", money.number_or_null(F.col("salary_min")))
            .withColumn("salary_max", money.number_or_null(F.col("salary_max"))))
    missing = F.col("salary_min").isNull() | F.col("salary_max").isNull()
    extra = ("predicted_min", "predicted_max", "predicted_period")
    guessed = predictor(rows.where(missing)).select(*rows.columns, *extra)
    return guessed.unionByName(rows.where(~missing), allowMissingColumns=True)


def retrain_due(postings: DataFrame, at_least: int = RETRAIN_FROM) -> bool:
    return labelled_salaries(postings) >= at_least
