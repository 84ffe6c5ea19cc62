"""Résumé scoring by rule, as Column expressions over the whole text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from laborlens import vocab
from laborlens.functions.text import WORD, string_array, words

SECTIONS = tuple(vocab.SECTION_WORDS)
_SIGNS = "".join(re.escape(s) for s in vocab.METRIC_SIGNS)
# a sign counts only when a word character follows it, a unit only when none does
METRIC = (rf"(?<!{WORD})\p{{Nd}}+(?:\.\p{{Nd}}+)?[\s\p{{Z}}]*"
          rf"(?:[{_SIGNS}](?={WORD})|(?:{'|'.join(vocab.METRIC_UNITS)})(?!{WORD}))")


def is_empty(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit("")).rlike(r"^\s*$")


def found_sections(text: Column) -> Column:
    low = F.lower(text)
    hits = [F.when(low.rlike("|".join(vocab.SECTION_WORDS[name])), F.lit(name))
            for name in SECTIONS]
    return F.array_compact(F.array(*hits))


def missing_sections(found: Column) -> Column:
    return F.array_except(string_array(SECTIONS), found)


def metric_count(text: Column) -> Column:
    return F.regexp_count(F.lower(text), F.lit(METRIC))


def length_points(word_count: Column) -> Column:
    return (F.when(word_count.between(300, 900), 20)
            .when(word_count.between(150, 299), 12)
            .when(word_count.between(901, 1300), 15).otherwise(5))


def display_skill(skill: Column) -> Column:
    special = F.create_map(*[F.lit(x) for pair in vocab.SPECIAL_CASE_SKILLS.items() for x in pair])
    capitalised = F.concat(F.upper(F.substring(skill, 1, 1)), F.lower(F.substr(skill, F.lit(2))))
    return (F.when(skill.isin(*vocab.UPPERCASE_SKILLS), F.upper(skill))
            .otherwise(F.coalesce(F.try_element_at(special, skill), capitalised)))


def add_scores(df, text: str = "text", verbs=vocab.ACTION_VERBS, skills=vocab.RESUME_SKILLS):
    """Add the counts, the five part scores and the total; 0 for an empty text."""
    col = F.col(text)

    def capped(count, each):
        return F.least(F.lit(20), count * each)

    vocabulary = string_array(sorted(set(verbs) | set(skills)))
    # tokenise once, then keep only the known words, so that later steps see short arrays
    tokens = words(F.coalesce(col, F.lit("")))
    out = (df
           .withColumn("_tokens", tokens)
           .withColumn("word_count", F.size("_tokens"))
           .withColumn("_known", F.array_intersect("_tokens", vocabulary))
           .drop("_tokens")
           .withColumn("sections_found", found_sections(F.coalesce(col, F.lit(""))))
           .withColumn("sections_missing", missing_sections(F.col("sections_found")))
           .withColumn("verb_count",
                       F.size(F.array_intersect("_known", string_array(sorted(set(verbs))))))
           .withColumn("metric_count", metric_count(F.coalesce(col, F.lit(""))))
           .withColumn("detected",
                       F.array_sort(F.array_intersect("_known", string_array(sorted(set(skills))))))
           .drop("_known")
           .withColumn("_empty", is_empty(col)))
    parts = {
        "sections_score": F.size("sections_found") * 5,
        "verbs_score": capped(F.col("verb_count"), 2),
        "metrics_score": capped(F.col("metric_count"), 4),
        "skills_score": capped(F.size("detected"), 4),
        "length_score": length_points(F.col("word_count")),
    }
    for name, value in parts.items():
        out = out.withColumn(name, F.when(F.col("_empty"), 0).otherwise(value))
    total = sum(F.col(name) for name in parts)
    return (out.withColumn("score", total)
            .withColumn("detected_skills", F.transform("detected", display_skill))
            .drop("_empty"))


def feedback(lang: str = "en") -> Column:
    """Advice for a row that went through ``add_scores``."""
    advice = vocab.ADVICE[lang]
    missing = F.col("sections_missing")
    if lang == "ar":
        names = F.create_map(*[F.lit(x) for kv in vocab.SECTION_NAMES_AR.items() for x in kv])
        shown = F.transform(missing, lambda s: F.element_at(names, s))
    else:
        shown = F.transform(missing, F.initcap)
    before, after = advice["sections"].split("{sections}")
    listed = F.concat(F.lit(before), F.array_join(shown, vocab.SECTION_JOINER[lang]), F.lit(after))
    rules = F.array_compact(F.array(
        F.when(F.size(missing) > 0, listed),
        F.when(F.col("verbs_score") < 12, advice["verbs"]),
        F.when(F.col("metrics_score") < 12, advice["metrics"]),
        F.when(F.col("skills_score") < 12, advice["skills"]),
        F.when(F.col("word_count") < 250, advice["short"])
        .when(F.col("word_count") > 1100, advice["long"]),
    ))
    tips = F.when(F.size(rules) == 0, F.array(F.lit(advice["fine"]))).otherwise(rules)
    tips = F.when(F.size(tips) < 3, F.array_append(tips, F.lit(advice["extra"]))).otherwise(tips)
    return F.when(F.col("score") == 0, F.array(F.lit(advice["empty"]))).otherwise(tips)
