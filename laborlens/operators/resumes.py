"""Résumé jobs that combine scoring with skills and recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlens import vocab
from laborlens.functions import resume
from laborlens.functions.text import string_array, words
from laborlens.operators.recommend import recommend


def score_resumes(resumes: DataFrame, text: str = "text", **word_lists) -> DataFrame:
    """Scores, found sections and detected skills of every résumé."""
    return resume.add_scores(resumes, text, **word_lists)


def with_feedback(scored: DataFrame, languages=("en", "ar")) -> DataFrame:
    """Advice lists in each language, and the fixed summary of an empty résumé."""
    for lang in languages:
        scored = (scored.withColumn(f"feedback_{lang}", resume.feedback(lang))
                  .withColumn(f"summary_{lang}",
                              F.when(F.col("score") == 0, vocab.EMPTY_RESUME_SUMMARY[lang])))
    return scored


def detected_skills(resumes: DataFrame, text: str = "text", skills=vocab.RESUME_SKILLS) -> DataFrame:
    """(resume_id, skills): known skill words of each résumé, lower case."""
    found = F.array_intersect(words(F.coalesce(F.col(text), F.lit(""))),
                              string_array(sorted(set(skills))))
    return resumes.select("resume_id", F.array_sort(found).alias("skills"))


def skill_gap(detected: DataFrame, demand: DataFrame) -> DataFrame:
    """(resume_id, missing): skills in demand that a résumé lacks, lower case, most wanted first.

    ``demand`` is a top-k report; its names become one array, read once as a scalar.
    """
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("job_count")).alias("n"), "name")))
    wanted = demand.agg(F.transform(ranked, lambda x: F.lower(x["name"])).alias("names")).scalar()
    missing = F.array_except(wanted, F.transform("skills", F.lower))
    return detected.select("resume_id", missing.alias("missing"))


def match_resumes(detected: DataFrame, posting_skills: DataFrame, postings: DataFrame,
                  top_n: int = 8) -> DataFrame:
    """Recommendations for the detected skills of each résumé."""
    users = detected.select(F.col("resume_id").alias("user_id"), "skills")
    return recommend(users, posting_skills, postings, top_n).withColumnRenamed("user_id", "resume_id")


def recommend_from_text(resumes: DataFrame, posting_skills: DataFrame, postings: DataFrame, text: str = "text",
                        skills=vocab.RESUME_SKILLS, top_n: int = 8) -> DataFrame:
    """From résumé texts to postings in one job: skills are detected in the whole text, then matched.

    A résumé without text or without a skill that a posting has gets no rows; résumés with equal skills
    are scored once.
    """
    detected = detected_skills(resumes, text, skills).where(F.size("skills") > 0)
    return match_resumes(detected, posting_skills, postings, top_n)
