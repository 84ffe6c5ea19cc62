"""From raw documents to encoded training data: one stage after the other, each over all rows that are left."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laborlens.llm import bpe, decontaminate, simhash, similar, suffix, toxicity
from laborlens.llm.common import Scratch, table
from laborlens.llm.queries import severity_grades

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model does not reject."""
    model = toxicity.train(docs, severity_grades(table(spark, sf_dir, "labels")))
    return toxicity.severity(docs.select(COLUMNS), model).where("not rejected").select(COLUMNS)


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of texts that share at least 0.8 of their 5-word shingles: one with the smallest id.

    A class of rows without an id keeps one of them; NULL texts and texts without words are one class.
    """
    return similar.first_copies(docs.select(COLUMNS)).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of op2's fingerprints: less than the stage, which is drop_similar."""
    classes = simhash.near_duplicates(docs)
    kept = classes.where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document, or the text before, has; a text of nothing else goes."""
    clean = suffix.clean_texts(docs.select(COLUMNS), also=("lang", "source"))
    left = clean.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item."""
    hits = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(hits, "doc_id", "left_anti").select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its ids and how many there are."""
    ids = bpe.encode(docs.select(COLUMNS), public_tokenizers.path("byte_bpe_50k.json"))
    return ids.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_similar),
          ("repeated_passages", cut_repeats), ("benchmark_decontamination", drop_contaminated), ("bpe_encoding", encode)]
#: Hashes, models and encodings are beyond SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is a table that the next stage reads."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
