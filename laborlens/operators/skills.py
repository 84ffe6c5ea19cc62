"""Skill extraction, TF-IDF weights, demand and co-occurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from laborlens import vocab
from laborlens.functions.text import (
    ANY_RUN, ASCII_RUN, terms, with_bigrams,
)
from laborlens.operators import automaton, heavy
from laborlens.session import cut_lineage

LEXICON_BYTES = 16 << 20        # a lexicon table up to this size is sent to every task
MATRIX_ROWS = 250_000           # rows that one task makes wide rows of


def english_stopwords(extra=()) -> list[str]:
    return sorted(set(vocab.ENGLISH_STOPWORDS) | set(extra))


def lexicon_table(spark: SparkSession, skills=vocab.SKILL_LEXICON,
                  categories=vocab.SKILL_CATEGORY) -> DataFrame:
    return spark.createDataFrame([(s, categories.get(s)) for s in skills],
                                 "skill string, category string")


# --- lexicon match ----------------------------------------------------------------------

def match_skills(texts: DataFrame, skills=vocab.SKILL_LEXICON, key: str = "posting_id",
                 clean: str = "clean", boundary: str = "faithful") -> DataFrame:
    """(key, skill) for every lexicon skill in the cleaned text; no shuffle.

    One automaton of all skills reads each text once, whatever their number. With
    ``boundary='token'`` a skill such as 'c++' or 'c#' also counts before a blank.
    """
    return automaton.match(texts, list(skills), key, clean, boundary)


def match_skill_table(texts: DataFrame, lexicon: DataFrame, key: str = "posting_id",
                      clean: str = "clean", boundary: str = "faithful") -> DataFrame:
    """The same for a lexicon that is a table.

    Its size is counted first: up to LEXICON_BYTES it goes to the tasks as automata, and no text
    is shuffled. Beyond that it is joined: a match contains each of the skill's runs as a full run
    of the text, so the join is on one anchor run; multi-run skills then test their pattern.
    """
    size = lexicon.agg(F.sum(F.octet_length("skill"))).first()[0] or 0
    if size <= LEXICON_BYTES:
        return match_skills(texts, [r["skill"] for r in lexicon.select("skill").distinct().collect() if r["skill"]],
                            key, clean, boundary)
    return join_skill_table(texts, lexicon, key, clean, boundary)


def join_skill_table(texts: DataFrame, lexicon: DataFrame, key: str = "posting_id",
                     clean: str = "clean", boundary: str = "faithful") -> DataFrame:
    """(key, skill) by an equi-join with a lexicon of any size."""
    runs = F.array_distinct(F.regexp_extract_all(F.col(clean), F.lit(f"({ANY_RUN})"), F.lit(1)))
    skill = F.col("skill")
    own = F.regexp_extract_all(skill, F.lit(f"({ASCII_RUN})"), F.lit(1))
    longest = F.array_sort(F.transform(own, lambda r: F.struct((-F.length(r)).alias("n"), r.alias("run"))))
    edge = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_+#])"
    left, right = edge if boundary == "token" else (r"\b", r"\b")
    anchored = lexicon.select(
        "skill",
        F.coalesce(F.get(longest, 0)["run"], skill).alias("run"),
        (~skill.rlike(f"^{ASCII_RUN}$")).alias("odd"),
        F.concat(F.lit(left + r"\Q"), skill, F.lit(r"\E" + right)).alias("pattern"))
    hits = texts.select(key, F.explode(runs).alias("run")).join(anchored, "run").drop("run")
    hits = cut_lineage(hits, "lexicon-hits")        # few rows, read for both kinds
    plain = hits.where("NOT odd").select(key, "skill")
    checked = (hits.where("odd").join(texts.select(key, clean), key)
               .where(F.regexp_like(F.col(clean), F.col("pattern"))).select(key, "skill"))
    return plain.unionByName(checked)


# --- TF-IDF -----------------------------------------------------------------------------

def text_terms(clean: str = "clean", bigrams: bool = True, stopwords=None):
    """Terms of a cleaned text in order: tokens without stop words, then their bigrams."""
    tokens = terms(F.col(clean))
    if stopwords:
        tokens = F.filter(tokens, lambda t: ~t.isin(*stopwords))
    return with_bigrams(tokens) if bigrams else tokens


def token_lists(texts: DataFrame, clean: str, *columns: str) -> DataFrame:
    """The given columns and the cleaned texts as ``clean``, cleaned once and saved for the passes that make tokens of them."""
    return cut_lineage(texts.select(*columns, F.col(clean).alias("clean")), "cleaned")


def count_vocabulary(lists: DataFrame, max_features: int, bigrams: bool, stopwords) -> DataFrame:
    """(term, ctf, df) by counting every term; partial sums run before the shuffle."""
    lists, tokens = lists.select(terms(F.col("clean")).alias("tokens")), F.col("tokens")
    if stopwords:
        tokens = F.filter(tokens, lambda t: ~t.isin(*stopwords))
    listed = with_bigrams(tokens) if bigrams else tokens
    uses = F.transform(listed, lambda t: F.struct(t.alias("term"), F.lit(0).alias("first")))
    firsts = F.transform(F.array_distinct(listed),
                         lambda t: F.struct(t.alias("term"), F.lit(1).alias("first")))
    counted = (lists.select(F.inline(F.concat(uses, firsts))).groupBy("term")
               .agg(F.sum(1 - F.col("first")).alias("ctf"), F.sum("first").alias("df")))
    return counted.orderBy(F.desc("ctf"), "term").limit(max_features)


def ranked_terms(lists: DataFrame, max_features: int, bigrams: bool, stopwords,
                 key: str | None = None) -> tuple[DataFrame, DataFrame, int]:
    """The vocabulary (term, ctf, df), counts of a set of terms that holds it ([key,] term, tf), and the number of texts.

    Bounded summaries name the candidates and only these are counted. Where the summaries prove no
    short list (all terms about equally frequent), every term is counted; both ways are exact.
    """
    stop = list(stopwords or ())
    wanted, texts = heavy.candidates(lists, max_features, bigrams, stop)
    if wanted is None:
        kept = cut_lineage(count_vocabulary(lists, max_features, bigrams, stop), "vocabulary")
        return kept, heavy.count_terms(lists, [r["term"] for r in kept.collect()], stop, key), texts
    counts = heavy.count_terms(lists, wanted, stop, key)
    if key:
        counts = cut_lineage(counts, "counts")
    kept = (counts.groupBy("term").agg(F.sum("tf").alias("ctf"), F.count(F.lit(1)).alias("df"))
            .orderBy(F.desc("ctf"), "term").limit(max_features))
    return kept, counts, texts


def vocabulary(texts: DataFrame, clean: str = "clean", max_features: int = 500,
               bigrams: bool = True, stopwords=None) -> DataFrame:
    """(term, ctf, df) of the most frequent terms; ties by term. A text that is NULL has none."""
    return ranked_terms(token_lists(texts, clean), max_features, bigrams, stopwords)[0]


def tfidf(texts: DataFrame, key: str = "posting_id", clean: str = "clean",
          max_features: int = 500, bigrams: bool = True, stopwords=None, saved: bool = False) -> DataFrame:
    """(key, term, weight): tf · (ln((1+n)/(1+df)) + 1), rows scaled to length one.

    Only counts of candidate terms leave the tasks that read the tokens; the vocabulary side of
    the join has at most ``max_features`` rows, so it is sent to the tasks and the counts are shuffled once, by key.
    Texts with equal keys are one text. ``saved`` texts are read as they are, not saved again.
    """
    lists = texts.select(key, F.col(clean).alias("clean")) if saved else token_lists(texts, clean, key)
    kept, counts, n = ranked_terms(lists, max_features, bigrams, stopwords, key)
    idf = kept.select("term", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf"))
    counts = (counts.join(F.broadcast(idf), "term").repartition(key).groupBy(key, "term", "idf").agg(F.sum("tf").alias("tf"))
              .withColumn("raw", F.col("tf") * F.col("idf")))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy(key)))
    return counts.select(key, "term", (F.col("raw") / norm).alias("weight"))


def skill_scores(found: DataFrame, weights: DataFrame, key: str = "posting_id") -> DataFrame:
    """(key, skill, score): the best weight among the skill's words, 0 without any.

    A text's weights meet its skills as one list, so they stay where ``tfidf`` has dealt them by key.
    """
    lists = weights.groupBy(key).agg(F.collect_list(F.struct("term", "weight")).alias("weights"))
    words = found.select(key, "skill", F.split("skill", r"\s+").alias("words"))
    own = F.filter("weights", lambda w: F.array_contains("words", w["term"]))
    return (words.join(lists, key, "left")
            .groupBy(key, "skill")
            .agg(F.coalesce(F.max(F.array_max(F.transform(own, lambda w: w["weight"]))), F.lit(0.0)).alias("score")))


# --- demand and co-occurrence -----------------------------------------------------------

def restrict(posting_skills: DataFrame, fresh_postings: DataFrame | None) -> DataFrame:
    """Rows of fresh postings only; the semi-join also runs below an aggregation."""
    if fresh_postings is None:
        return posting_skills
    return posting_skills.join(fresh_postings.select("posting_id"), "posting_id", "left_semi")


def skill_demand(posting_skills: DataFrame, skills: DataFrame, limit: int = 25,
                 fresh_postings: DataFrame | None = None) -> DataFrame:
    """(name, category, job_count) of the skills most asked for.

    Counting comes first, so the dimension join sees one row per skill.
    """
    counts = (restrict(posting_skills, fresh_postings).groupBy("skill")
              .agg(F.count(F.lit(1)).alias("job_count")))
    return (counts.join(skills, counts.skill == skills.name)
            .select("name", "category", "job_count")
            .orderBy(F.desc("job_count"), "name").limit(limit))


def cooccurrence(posting_skills: DataFrame, top_n: int = 15,
                 fresh_postings: DataFrame | None = None) -> DataFrame:
    """(skill_a, skill_b, together) for the top skills: symmetric, zero diagonal.

    No pairs are formed per posting. Postings with the same set of top skills are counted
    first; each distinct set then adds its count to ``top_n`` columns of one row per skill.
    """
    rows = restrict(posting_skills, fresh_postings)
    ranked = (rows.groupBy("skill").agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.desc("n"), "skill").limit(top_n)
              .select("skill", F.row_number().over(W.orderBy(F.desc("n"), "skill")).alias("rank")))
    sets = (rows.join(ranked, "skill").groupBy("posting_id")
            .agg(F.sort_array(F.collect_set("rank")).alias("ranks"))
            .groupBy("ranks").agg(F.count(F.lit(1)).alias("postings")))

    def beside(j):
        both = F.array_contains("ranks", F.lit(j)) & (F.col("rank") != j)
        return F.sum(F.when(both, F.col("postings")).otherwise(0)).alias(f"c{j}")

    matrix = (sets.select("ranks", "postings", F.explode("ranks").alias("rank"))
              .groupBy("rank").agg(*[beside(j) for j in range(1, top_n + 1)]))
    cells = F.explode(F.array(*[F.struct(F.lit(j).alias("other"), F.col(f"c{j}").alias("together"))
                                for j in range(1, top_n + 1)])).alias("cell")
    left = ranked.select("rank", F.col("skill").alias("skill_a"))
    right = ranked.select(F.col("rank").alias("other"), F.col("skill").alias("skill_b"))
    return (matrix.select("rank", cells).select("rank", "cell.*")
            .join(left, "rank").join(right, "other")
            .select("skill_a", "skill_b", "together"))


def skills_per_posting(posting_skills: DataFrame) -> DataFrame:
    """(posting_id, skills): names in order, joined by ', '."""
    return (posting_skills.groupBy("posting_id")
            .agg(F.array_join(F.sort_array(F.collect_set("skill")), ", ").alias("skills")))


def skill_matrix(posting_skills: DataFrame, columns) -> DataFrame:
    """Export shape: one row per posting, one column per given skill, mean score or 0.

    Each task turns about MATRIX_ROWS rows into wide ones, so what it holds does not grow with the table.
    """
    rows = cut_lineage(posting_skills.select("posting_id", "skill", "score"), "matrix-rows")
    parts = 1 + rows.count() // MATRIX_ROWS         # the count is read from the files' footers
    return (rows.repartition(parts, "posting_id").groupBy("posting_id").pivot("skill", list(columns))
            .agg(F.avg("score")).na.fill(0.0))


def term_report(texts: DataFrame, clean: str = "clean", limit: int = 120,
                extra=vocab.REPORT_STOPWORDS) -> DataFrame:
    """(term, freq) of the most frequent single tokens outside the stop words; tasks send counts of words, not tokens."""
    counts = heavy.count_words(texts.select(F.col(clean).alias("clean")), english_stopwords(extra))
    return counts.groupBy("term").agg(F.sum("tf").alias("freq")).orderBy(F.desc("freq"), "term").limit(limit)
