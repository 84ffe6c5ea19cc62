"""Registered queries: text cleaning, lexicon match, TF-IDF, demand, recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from laborlens import vocab
from laborlens.functions.labels import match_tier
from laborlens.functions.text import clean_text, clean_words
from laborlens.operators import aggregates, filters, recommend, skills
from laborlens.plans.tables import (
    POSTINGS, SKILLS, USERS, as_of, posting_skills, postings, query, skill_names, table, users,
)
from laborlens.session import spread

# the supplied texts hold invented prose, so frequent words stand in for skills beside the
# real lexicon; one has two words and two have other characters
WORD_SKILLS = vocab.SKILL_LEXICON + ("the", "of", "and", "in the", "de la", "der", "la.", "on-")
STOP = tuple(skills.english_stopwords())
_STOP_SQL = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP)


def _clean_sql(kept):
    return (f"lower(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g'), "
            f"'[^{kept}]', ' ', 'g'), '\\s+', ' ', 'g')))")


CLEAN = _clean_sql(r"a-zA-Z0-9#+./\- ")
CLEAN_WORDS = _clean_sql("a-zA-Z0-9+# ")


def documents(spark, d, cleaner=clean_text):
    """(posting_id, clean) of every document, whole texts."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return docs.select(F.col("doc_id").alias("posting_id"), cleaner(F.col("text")).alias("clean"))


@query("clean_text", f"SELECT doc_id AS posting_id, md5({CLEAN}) AS digest, md5({CLEAN_WORDS}) AS words FROM documents")
def clean_text_query(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    text = F.col("text")
    return docs.select(F.col("doc_id").alias("posting_id"), F.md5(clean_text(text)).alias("digest"),
                       F.md5(clean_words(text)).alias("words"))


def _escaped(skill):
    return "".join("\\" + c if c in "+.#-/" else c for c in skill).replace("'", "''")


_LEXICON = ", ".join(f"('{s}', '\\b{_escaped(s)}\\b')" for s in WORD_SKILLS)


_LEXICON_MATCH = f"""
WITH t AS (SELECT doc_id AS posting_id, {CLEAN} AS clean FROM documents),
lexicon(skill, pattern) AS (VALUES {_LEXICON})
SELECT posting_id, skill FROM t JOIN lexicon ON regexp_matches(clean, pattern)
"""


@query("lexicon_match", _LEXICON_MATCH)
def lexicon_match(spark, d):
    return skills.match_skills(documents(spark, d), WORD_SKILLS)


@query("lexicon_table_match", _LEXICON_MATCH)
def lexicon_table_match(spark, d):
    lexicon = skills.lexicon_table(spark, WORD_SKILLS).select("skill")
    return skills.match_skill_table(documents(spark, d), lexicon)


@query("skill_categories", f"""
WITH found AS ({_LEXICON_MATCH}),
categories(skill, category) AS (VALUES {", ".join(str(kv) for kv in vocab.SKILL_CATEGORY.items())})
SELECT found.skill, category, count(*) AS postings FROM found LEFT JOIN categories c ON c.skill = found.skill
GROUP BY 1, 2
""")
def skill_categories(spark, d):
    counts = lexicon_match(spark, d).groupBy("skill").agg(F.count(F.lit(1)).alias("postings"))
    lexicon = skills.lexicon_table(spark, WORD_SKILLS)
    return counts.join(lexicon, "skill").select("skill", "category", "postings")


# bigrams are formed after the stop words are gone
_TERMS = f"""
toks AS (SELECT doc_id AS posting_id, list_filter(regexp_extract_all({{clean}}, '[A-Za-z0-9_]{{{{2,}}}}'),
                lambda x: x NOT IN ({_STOP_SQL})) AS t FROM documents),
grams AS (SELECT posting_id, unnest(list_concat(t, list_transform(range(1, greatest(len(t), 1)),
                 lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM toks)"""
TERMS = _TERMS.format(clean=CLEAN).replace("{{", "{").replace("}}", "}")
TFIDF = f"""{TERMS},
tf AS (SELECT posting_id, term, count(*) AS tf FROM grams GROUP BY 1, 2),
vocabulary AS (SELECT term, sum(tf)::BIGINT AS ctf, count(*) AS df FROM tf GROUP BY 1 ORDER BY ctf DESC, term LIMIT 500),
raw AS (SELECT posting_id, term, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w
        FROM tf JOIN vocabulary USING (term)),
weights AS (SELECT posting_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY posting_id)) AS weight FROM raw)"""


@query("vocabulary", f"WITH {TFIDF} SELECT term, ctf, df FROM vocabulary")
def vocabulary(spark, d):
    return skills.vocabulary(documents(spark, d), stopwords=STOP)


@query("tfidf_terms", f"WITH {TFIDF} SELECT posting_id, term, round(weight, 4) AS weight FROM weights")
def tfidf_terms(spark, d):
    weights = skills.tfidf(documents(spark, d), stopwords=STOP)
    return weights.withColumn("weight", F.round("weight", 4))


_WORDS = WORD_SKILLS + ("er", "on in", "tion")
_WORDS_SQL = ", ".join(f"('{s}', '\\b{_escaped(s)}\\b')" for s in _WORDS)


@query("skill_scores", f"""
WITH {TFIDF},
t AS (SELECT doc_id AS posting_id, {CLEAN} AS clean FROM documents),
lexicon(skill, pattern) AS (VALUES {_WORDS_SQL}),
found AS (SELECT posting_id, skill, unnest(string_split(skill, ' ')) AS term
          FROM t JOIN lexicon ON regexp_matches(clean, pattern))
SELECT f.posting_id, f.skill, round(coalesce(max(w.weight), 0), 4) AS score
FROM found f LEFT JOIN weights w ON w.posting_id = f.posting_id AND w.term = f.term GROUP BY 1, 2
""")
def skill_scores(spark, d):
    texts = documents(spark, d)
    scored = skills.skill_scores(skills.match_skills(texts, _WORDS), skills.tfidf(texts, stopwords=STOP))
    return scored.withColumn("score", F.round("score", 4))


@query("term_frequency", f"""
WITH t AS (SELECT unnest(regexp_extract_all({CLEAN_WORDS}, '[A-Za-z0-9_]{{2,}}')) AS term FROM documents)
SELECT term, count(*) AS freq FROM t
WHERE term NOT IN ({", ".join("'" + w.replace("'", "''") + "'" for w in skills.english_stopwords(vocab.REPORT_STOPWORDS))})
GROUP BY 1 ORDER BY freq DESC, term LIMIT 120
""")
def term_frequency(spark, d):
    return skills.term_report(documents(spark, d, clean_words))


# --- demand and co-occurrence -----------------------------------------------------------

def _fresh_ids(spark, d):
    return filters.fresh(postings(spark, d, False, False), as_of(spark, d)).select("posting_id")


@query("skill_trends", f"""
WITH {POSTINGS}, {SKILLS}
SELECT name, category, count(*) AS job_count
FROM posting_skills JOIN skill_names ON skill = name JOIN fresh USING (posting_id)
GROUP BY 1, 2 ORDER BY job_count DESC, name LIMIT 25
""")
def skill_trends(spark, d):
    return skills.skill_demand(posting_skills(spark, d), skill_names(spark, d), 25, _fresh_ids(spark, d))


@query("skill_demand", f"""
WITH {SKILLS},
top AS (SELECT name, category, count(*) AS job_count FROM posting_skills JOIN skill_names ON skill = name
        GROUP BY 1, 2 ORDER BY job_count DESC, name LIMIT 20)
SELECT name, category, job_count, CAST(floor(job_count * 100 / max(job_count) OVER ()) AS INTEGER) AS pct FROM top
""")
def skill_demand(spark, d):
    report = skills.skill_demand(posting_skills(spark, d), skill_names(spark, d), 20)
    return aggregates.percent_of_first(report)


_COOC = """
top AS (SELECT skill FROM rows GROUP BY 1 ORDER BY count(*) DESC, skill LIMIT {n}),
kept AS (SELECT posting_id, skill FROM rows JOIN top USING (skill)),
pairs AS (SELECT a.skill AS skill_a, b.skill AS skill_b, count(*) AS n
          FROM kept a JOIN kept b ON a.posting_id = b.posting_id AND a.skill <> b.skill GROUP BY 1, 2)
SELECT a.skill AS skill_a, b.skill AS skill_b, coalesce(n, 0) AS together
FROM top a CROSS JOIN top b LEFT JOIN pairs ON skill_a = a.skill AND skill_b = b.skill
"""


@query("skill_cooccurrence", f"WITH {SKILLS}, rows AS (SELECT * FROM posting_skills), {_COOC.format(n=15)}")
def skill_cooccurrence(spark, d):
    return skills.cooccurrence(posting_skills(spark, d), 15)


@query("skill_cooccurrence_fresh", f"""
WITH {POSTINGS}, {SKILLS}, rows AS (SELECT * FROM posting_skills SEMI JOIN fresh USING (posting_id)), {_COOC.format(n=12)}
""")
def skill_cooccurrence_fresh(spark, d):
    return skills.cooccurrence(posting_skills(spark, d), 12, _fresh_ids(spark, d))


# every skill name of the table
_COLUMNS = tuple(f"{kind} {thing}" for kind in ("blue", "cold", "hot", "large", "new", "old", "red", "small")
                 for thing in ("anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget"))


@query("skill_matrix", f"""
WITH {SKILLS}
SELECT posting_id, {", ".join(f'''coalesce(avg(CASE WHEN skill = '{c}' THEN score END), 0) AS "{c}"''' for c in _COLUMNS)}
FROM posting_skills GROUP BY 1
""")
def skill_matrix(spark, d):
    return skills.skill_matrix(posting_skills(spark, d, skills.MATRIX_ROWS), _COLUMNS)


@query("skills_per_posting", f"""
WITH {POSTINGS}, {SKILLS}
SELECT posting_id, string_agg(skill, ', ' ORDER BY skill) AS skills
FROM fresh LEFT JOIN posting_skills USING (posting_id) GROUP BY 1
""")
def skills_per_posting(spark, d):
    ids = _fresh_ids(spark, d)
    listed = skills.skills_per_posting(skills.restrict(posting_skills(spark, d), ids))
    return ids.join(listed, "posting_id", "left")


# --- recommendations --------------------------------------------------------------------

def nearest_sql(ask: str, top_n: int, where: str = "TRUE") -> str:
    """Recommendation CTEs over ``ask`` (user_id, skill): over-fetch, filter, cut."""
    return f"""
matrix AS (SELECT s.posting_id, s.skill, s.score,
                  sqrt(sum(s.score * s.score) OVER (PARTITION BY s.posting_id)) AS norm
           FROM posting_skills s SEMI JOIN fresh USING (posting_id)),
known AS (SELECT DISTINCT user_id, m.skill FROM {ask} a
          JOIN (SELECT DISTINCT skill FROM matrix) m ON lower(m.skill) = lower(a.skill)),
sized AS (SELECT user_id, skill, count(*) OVER (PARTITION BY user_id) AS m FROM known),
scored AS (SELECT user_id, posting_id, sum(CASE WHEN norm > 0 THEN score / norm ELSE 0 END) / sqrt(any_value(m)) AS score
           FROM sized JOIN matrix USING (skill) GROUP BY 1, 2),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, posting_id) AS n
                        FROM scored) WHERE n <= {top_n * 20}),
best AS (SELECT user_id, posting_id, round(score, 3) AS match_score,
                row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, posting_id) AS rank
         FROM near JOIN fresh USING (posting_id) WHERE {where})
"""


@query("recommend_by_skills", f"""
WITH {POSTINGS}, {SKILLS}, {USERS}, {nearest_sql('user_skills', 5)}
SELECT user_id, posting_id, match_score, rank,
       CASE WHEN floor(match_score * 100) >= 70 THEN 'high' WHEN floor(match_score * 100) >= 40 THEN 'medium'
            ELSE 'low' END AS tier, title, company
FROM best JOIN postings USING (posting_id) WHERE rank <= 5
""")
def recommend_by_skills(spark, d):
    rows = postings(spark, d, country=False)
    found = recommend.recommend(users(spark, d), posting_skills(spark, d), _fresh_ids(spark, d), 5)
    found = found.withColumn("rank", F.col("rank").cast("long"))
    found = found.withColumn("tier", match_tier(F.col("match_score")))
    return recommend.with_details(found, rows, ["title", "company"])


_WANT_MODE = "CASE WHEN user_id % 3 = 0 THEN 'remote' WHEN user_id % 3 = 1 THEN 'all' END"
_WANT_COUNTRY = "CASE WHEN user_id % 4 = 0 THEN 'uK' END"
_FILTER = f"""coalesce({_WANT_MODE}, 'all') IN ('all', job_type)
  AND ({_WANT_COUNTRY} IS NULL OR lower(country) = lower({_WANT_COUNTRY}))"""


def _asking_users(spark, d):
    uid = F.col("user_id")
    return (users(spark, d)
            .withColumn("want_job_type", F.when(uid % 3 == 0, "remote").when(uid % 3 == 1, "all"))
            .withColumn("want_country", F.when(uid % 4 == 0, "uK")))


def _fresh_postings(spark, d):
    return (filters.fresh(postings(spark, d), as_of(spark, d))
            .select("posting_id", "country", "job_type", "contract_type", "seniority"))


@query("recommend_batch_filtered", f"""
WITH {POSTINGS}, {SKILLS}, {USERS}, {nearest_sql('user_skills', 4, _FILTER)}
SELECT user_id, posting_id, match_score, rank FROM best WHERE rank <= 4
""")
def recommend_batch_filtered(spark, d):
    found = recommend.recommend(_asking_users(spark, d), posting_skills(spark, d),
                                _fresh_postings(spark, d), 4)
    return found.withColumn("rank", F.col("rank").cast("long"))


@query("recommend_prefiltered", f"""
WITH {POSTINGS}, {SKILLS}, {USERS}, {nearest_sql('user_skills', 1000000)},
allowed AS (SELECT b.user_id, b.posting_id, b.match_score,
                   row_number() OVER (PARTITION BY b.user_id ORDER BY b.rank) AS rank
            FROM best b JOIN fresh USING (posting_id) WHERE {_FILTER})
SELECT user_id, posting_id, match_score, rank FROM allowed WHERE rank <= 4
""")
def recommend_prefiltered(spark, d):
    found = recommend.recommend(_asking_users(spark, d), posting_skills(spark, d),
                                _fresh_postings(spark, d), 4, prefilter=True)
    return found.withColumn("rank", F.col("rank").cast("long"))
