"""Registered queries: résumés, model replies, documents, pages, vectors, conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from laborlens import vocab
from laborlens.functions import labels, replies, resume
from laborlens.functions.text import clean_text
from laborlens.operators import filters, resumes, skills, vectors
from laborlens.plans.ingest_queries import _pick, _pick_sql
from laborlens.plans.refresh import posting_documents
from laborlens.plans.skill_queries import CLEAN, _escaped, _fresh_ids, nearest_sql
from laborlens.plans.tables import (
    POSTINGS, SKILLS, as_of, posting_skills, postings, query, skill_names, table,
)
from laborlens.session import spread
from laborlens.sources import board

# the supplied prose has no résumé words, so each text gets a varied tail of them
_TAILS = (
    " Experience and education. Designed, developed and deployed 3 tools for 40k users in 5 years. Python SQL AWS Docker Spark pytorch",
    " Skills: python, r. Email me. Managed a team.", " University degree 2019, led 12 million usd budget, 30 x faster 7 years 8 k",
    " Built and automated c++ and power bi reports. Phone, address. 2x 3x 4x", "",
)


def _resumes(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text", "n_chars"), "doc_id")
    tail = _pick(F.col("doc_id"), *_TAILS)
    text = F.when(F.col("doc_id") % 50 == 0, "  ").otherwise(F.concat("text", tail))
    return docs.select(F.col("doc_id").alias("resume_id"), text.alias("text"))


def _list_sql(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_METRIC_SQL = (r"\b\d+(?:\.\d+)?\s*(?:%|\+|\$|£|usd|gbp|years|million|k|x)\b")
_SHOWN = "CASE " + " ".join(
    [f"WHEN s IN ({', '.join(repr(x) for x in vocab.UPPERCASE_SKILLS)}) THEN upper(s)"]
    + [f"WHEN s = '{k}' THEN '{v}'" for k, v in vocab.SPECIAL_CASE_SKILLS.items()]) \
    + " ELSE upper(s[1]) || lower(s[2:]) END"
_SECTIONS_SQL = "list_filter([" + ", ".join(
    f"CASE WHEN regexp_matches(x, '{'|'.join(v)}') THEN '{k}' END" for k, v in vocab.SECTION_WORDS.items()
) + "], lambda s: s IS NOT NULL)"

RESUME_PARTS = f"""
resumes AS (SELECT doc_id AS resume_id, CASE WHEN doc_id % 50 = 0 THEN '  '
                   ELSE text || {_pick_sql('doc_id', *_TAILS)} END AS text FROM documents),
lowered AS (SELECT resume_id, lower(text) AS x, trim(text) = '' AS empty FROM resumes),
counted AS (
  SELECT *, regexp_extract_all(x, '[\\p{{L}}\\p{{N}}_]+') AS w, {_SECTIONS_SQL} AS found,
         len(regexp_extract_all(x, '{_METRIC_SQL}')) AS metric_count FROM lowered),
parts AS (
  SELECT resume_id, empty, found, metric_count, len(w) AS word_count,
         len(list_intersect(list_distinct(w), {_list_sql(vocab.ACTION_VERBS)})) AS verb_count,
         list_sort(list_intersect(list_distinct(w), {_list_sql(vocab.RESUME_SKILLS)})) AS detected
  FROM counted)"""
RESUMES = f"""{RESUME_PARTS},
scores AS (
  SELECT *, CASE WHEN empty THEN 0 ELSE len(found) * 5 END AS sections_score,
         CASE WHEN empty THEN 0 ELSE least(20, verb_count * 2) END AS verbs_score,
         CASE WHEN empty THEN 0 ELSE least(20, metric_count * 4) END AS metrics_score,
         CASE WHEN empty THEN 0 ELSE least(20, len(detected) * 4) END AS skills_score,
         CASE WHEN empty THEN 0 WHEN word_count BETWEEN 300 AND 900 THEN 20
              WHEN word_count BETWEEN 150 AND 299 THEN 12
              WHEN word_count BETWEEN 901 AND 1300 THEN 15 ELSE 5 END AS length_score
  FROM parts),
scored AS (SELECT *, sections_score + verbs_score + metrics_score + skills_score + length_score AS score FROM scores)"""

_SCORES = ["sections_score", "verbs_score", "metrics_score", "skills_score", "length_score", "score"]


@query("resume_score", f"""
WITH {RESUMES}
SELECT resume_id, {", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in _SCORES)},
       CAST(word_count AS INTEGER) AS word_count, array_to_string(found, ',') AS found,
       array_to_string(list_transform(detected, lambda s: {_SHOWN}), ',') AS shown_skills,
       CASE WHEN score >= 75 THEN 'high' WHEN score >= 45 THEN 'mid' ELSE 'low' END AS tier
FROM scored
""")
def resume_score(spark, d):
    scored = resumes.score_resumes(_resumes(spark, d))
    return scored.select("resume_id", *[F.col(c).cast("int") for c in _SCORES], "word_count",
                         F.array_join("sections_found", ",").alias("found"),
                         F.array_join("detected_skills", ",").alias("shown_skills"),
                         labels.resume_tier(F.col("score")).alias("tier"))


def _tips_sql(lang):
    a = {k: v.replace("'", "''") for k, v in vocab.ADVICE[lang].items()}
    before, after = a["sections"].split("{sections}")
    joiner = vocab.SECTION_JOINER[lang]
    name = ("upper(s[1]) || s[2:]" if lang == "en" else
            "CASE s " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vocab.SECTION_NAMES_AR.items()) + " END")
    missing = f"list_filter({_list_sql(resume.SECTIONS)}, lambda s: NOT list_contains(found, s))"
    rules = f"""list_filter([
      CASE WHEN len({missing}) > 0 THEN '{before}' || array_to_string(list_transform({missing}, lambda s: {name}), '{joiner}') || '{after}' END,
      CASE WHEN verbs_score < 12 THEN '{a["verbs"]}' END, CASE WHEN metrics_score < 12 THEN '{a["metrics"]}' END,
      CASE WHEN skills_score < 12 THEN '{a["skills"]}' END,
      CASE WHEN word_count < 250 THEN '{a["short"]}' WHEN word_count > 1100 THEN '{a["long"]}' END
    ], lambda s: s IS NOT NULL)"""
    some = f"CASE WHEN len({rules}) = 0 THEN ['{a['fine']}'] ELSE {rules} END"
    return f"""CASE WHEN empty THEN '{a["empty"]}' ELSE array_to_string(
      {some} || CASE WHEN len({some}) < 3 THEN ['{a["extra"]}'] ELSE CAST([] AS VARCHAR[]) END, chr(10)) END"""


@query("resume_feedback", f"""
WITH {RESUMES}
SELECT resume_id, {_tips_sql('en')} AS tips_en, {_tips_sql('ar')} AS tips_ar FROM scored
""")
def resume_feedback(spark, d):
    told = resumes.with_feedback(resumes.score_resumes(_resumes(spark, d)))
    return told.select("resume_id", F.array_join("feedback_en", "\n").alias("tips_en"),
                       F.array_join("feedback_ar", "\n").alias("tips_ar"))


# skill names of the supplied parts, split into words, are what a résumé can mention
_NAMES = ("red widget", "blue ring", "hot bolt", "small ring", "red bolt", "hot plate")


def _detected(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    names = F.array_compact(F.array(*[F.when(F.col("n_chars") % (i + 2) == 0, F.lit(n))
                                      for i, n in enumerate(_NAMES)]))
    return docs.select(F.col("doc_id").alias("resume_id"), names.alias("skills"))


_DETECTED = "detected AS (SELECT doc_id AS resume_id, list_filter([" + ", ".join(
    f"CASE WHEN n_chars % {i + 2} = 0 THEN '{n}' END" for i, n in enumerate(_NAMES)
) + "], lambda s: s IS NOT NULL) AS skills FROM documents)"


@query("skill_gap", f"""
WITH {SKILLS}, {_DETECTED},
top AS (SELECT skill AS name, count(*) AS n FROM posting_skills GROUP BY 1 ORDER BY n DESC, name LIMIT 10),
wanted AS (SELECT list(name ORDER BY n DESC, name) AS names FROM top)
SELECT resume_id, array_to_string(list_filter(names, lambda s: NOT list_contains(skills, s)), ',') AS missing
FROM detected, wanted
""")
def skill_gap(spark, d):
    demand = skills.skill_demand(posting_skills(spark, d), skill_names(spark, d), 10)
    gap = resumes.skill_gap(_detected(spark, d), demand)
    return gap.select("resume_id", F.array_join("missing", ",").alias("missing"))


@query("detected_skills", f"""
WITH {RESUMES} SELECT resume_id, array_to_string(detected, ',') AS skills FROM parts
""")
def detected_skills(spark, d):
    found = resumes.detected_skills(_resumes(spark, d))
    return found.select("resume_id", F.array_join("skills", ",").alias("skills"))


@query("resume_to_postings", f"""
WITH {POSTINGS}, {SKILLS}, {_DETECTED},
asks AS (SELECT resume_id AS user_id, unnest(skills) AS skill FROM detected),
{nearest_sql('asks', 8)}
SELECT user_id AS resume_id, posting_id, match_score, rank FROM best WHERE rank <= 8
""")
def resume_to_postings(spark, d):
    found = resumes.match_resumes(_detected(spark, d), posting_skills(spark, d), _fresh_ids(spark, d))
    return found.withColumn("rank", F.col("rank").cast("long"))


_TEXT_LEXICON = ", ".join(f"('{x}', '\\b{_escaped(x)}\\b')" for x in vocab.SKILL_LEXICON)


@query("resume_text_to_postings", f"""
WITH {RESUME_PARTS},
cleaned AS (SELECT resume_id AS posting_id, {CLEAN} AS clean FROM resumes),
lexicon(skill, pattern) AS (VALUES {_TEXT_LEXICON}),
posting_skills AS (SELECT posting_id, skill, 1.0::DOUBLE AS score FROM cleaned JOIN lexicon ON regexp_matches(clean, pattern)),
fresh AS (SELECT posting_id FROM cleaned),
asks AS (SELECT resume_id AS user_id, unnest(detected) AS skill FROM parts),
{nearest_sql('asks', 8)}
SELECT user_id AS resume_id, posting_id, match_score, rank FROM best WHERE rank <= 8
""")
def resume_text_to_postings(spark, d):
    """Both sides from text: each document is a résumé and, cleaned and matched with the lexicon, a posting."""
    texts = _resumes(spark, d)
    cleaned = texts.select(F.col("resume_id").alias("posting_id"), clean_text(F.col("text")).alias("clean"))
    wanted = skills.match_skills(cleaned).withColumn("score", F.lit(1.0))
    found = resumes.recommend_from_text(texts, wanted, cleaned.select("posting_id"))
    return found.withColumn("rank", F.col("rank").cast("long"))


# --- model replies ----------------------------------------------------------------------

@query("reply_salvage", f"""
WITH t AS (SELECT conv_id, turn, trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')) AS a,
                  upper(trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'))) AS b FROM conversations)
SELECT conv_id, turn,
       CASE (conv_id + turn) % 6 WHEN 2 THEN '- ' || CASE WHEN a = '' THEN 'q' ELSE a END || chr(10) || '- x'
            WHEN 5 THEN '' ELSE a END AS summary_en,
       CASE (conv_id + turn) % 6 WHEN 4 THEN '' WHEN 5 THEN '' ELSE b END AS summary_ar,
       CASE WHEN (conv_id + turn) % 6 IN (0, 1) THEN 'SQL,Go' ELSE '' END AS missing
FROM t
""")
def reply_salvage(spark, d):
    rows = table(spark, d, "conversations")
    a = F.trim(F.regexp_replace("text", "[^A-Za-z]+", " "))
    b = F.upper(a)
    one = F.when(a == "", "q").otherwise(a)
    case = (F.col("conv_id") + F.col("turn")) % 6
    good = F.concat(F.lit('```json {"summary_en": "'), a, F.lit('", "summary_ar": " '), b, F.lit('"'))
    raw = (F.when(case == 0, F.concat(good, F.lit(', "missing_skills": ["SQL", "Go"]} ```')))
           .when(case == 1, F.concat(good, F.lit(', "missing_skills": ["SQL", "Go", ], }')))
           .when(case == 2, F.concat(F.lit('{"summary_en": [" '), one, F.lit(' ", "", "x"], "summary_ar": "'), b, F.lit('"}')))
           .when(case == 3, F.concat(F.lit("summary_en: '"), a, F.lit("' and summary_ar: '"), b, F.lit("' end")))
           .when(case == 4, F.concat(F.lit('{"summary_en": "'), a, F.lit('"}')))
           .otherwise(F.concat(F.lit("Sorry, "), a)))
    rows = rows.select("conv_id", "turn", raw.alias("raw")).withColumn("v", replies.parsed(F.col("raw")))
    raw, v = F.col("raw"), F.col("v")
    return rows.select("conv_id", "turn", replies.text_field(raw, v, "summary_en").alias("summary_en"),
                       replies.text_field(raw, v, "summary_ar").alias("summary_ar"),
                       F.array_join(replies.list_field(raw, v, "missing_skills"), ",").alias("missing"))


# --- documents --------------------------------------------------------------------------

_DOCUMENT = """
'Title: ' || coalesce(title, '') || chr(10) || 'Company: ' || coalesce(company, 'Unknown') || chr(10)
|| 'Location: Unknown, ' || coalesce(country, 'Unknown') || chr(10)
|| 'Workplace Type: ' || coalesce(job_type, 'onsite') || chr(10)
|| 'Contract Type: ' || coalesce(contract_type, 'full-time') || chr(10)
|| 'Seniority: ' || coalesce(seniority, 'mid') || chr(10)
|| 'Salary Range: £' || printf('%.0f', salary_min)
|| CASE WHEN salary_max IS NOT NULL AND salary_max <> salary_min THEN ' - £' || printf('%.0f', salary_max) ELSE '' END
|| chr(10) || 'Required Skills: ' || coalesce(skills, 'None') || chr(10) || 'Description: '"""
_LISTED = f"""
WITH {POSTINGS}, {SKILLS},
listed AS (SELECT f.*, l.skills FROM fresh f LEFT JOIN (
  SELECT posting_id, string_agg(skill, ', ' ORDER BY skill) AS skills FROM posting_skills GROUP BY 1) l USING (posting_id))"""


def _documents(spark, d):
    rows = (filters.fresh(postings(spark, d), as_of(spark, d))
            .withColumn("location", F.lit(None).cast("string"))
            .withColumn("description", F.lit(None).cast("string")))
    return posting_documents(rows, skills.restrict(posting_skills(spark, d), rows))


@query("posting_document", f"""{_LISTED}
SELECT posting_id, {_DOCUMENT} AS document, coalesce(country, 'unknown') AS country,
       coalesce(job_type, 'onsite') AS job_type, coalesce(seniority, 'mid') AS seniority,
       coalesce(contract_type, 'full-time') AS contract_type FROM listed
""")
def posting_document(spark, d):
    return _documents(spark, d).select("posting_id", "document", "meta.*")


@query("index_new_only", f"""{_LISTED}
SELECT posting_id, md5({_DOCUMENT}) AS digest FROM listed WHERE posting_id NOT IN (SELECT vec_id FROM embeddings)
""")
def index_new_only(spark, d):
    index = table(spark, d, "embeddings").select(F.col("vec_id").alias("posting_id"))
    added = vectors.not_indexed(_documents(spark, d), index)
    return added.select("posting_id", F.md5("document").alias("digest"))


@query("index_prune", f"""
WITH {POSTINGS}
SELECT vec_id AS posting_id, label FROM embeddings WHERE vec_id NOT IN (
  SELECT posting_id FROM postings
  WHERE coalesce(posted_at, scraped_at) < (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY)
""")
def index_prune(spark, d):
    index = table(spark, d, "embeddings").select(F.col("vec_id").alias("posting_id"), "label")
    return vectors.prune_expired(index, postings(spark, d, False, False), as_of(spark, d))


@query("hashed_index")
def hashed_index(spark, d):
    """Default embeddings of all fresh posting documents, as index rows."""
    documents = _documents(spark, d)
    added = vectors.index_additions(documents, documents.limit(0), as_of(spark, d), reindex=True)
    length = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x * x)
    return added.select("posting_id", F.size("embedding").alias("dims"), F.round(length, 4).alias("length"),
                        "document", "meta.country")


# --- pages ------------------------------------------------------------------------------

@query("page_links", """
WITH l AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS links FROM pages)
SELECT page_id, CAST(i - 1 AS INTEGER) AS link_no, links[i] AS href,
       CASE WHEN starts_with(links[i], '/') THEN 'https://wuzzuf.net' || links[i] ELSE links[i] END AS url
FROM l, unnest(range(1, len(links) + 1)) r(i)
""")
def page_links(spark, d):
    pages = spread(table(spark, d, "pages").select("page_id", "html"), "page_id")
    links = board.page_links(pages)
    return links.withColumn("url", board.absolute_url(F.col("href")))


_LINK = '<li><a href="/([^"]*)">([^<]*)</a></li>'


@query("page_cards", f"""
WITH l AS (SELECT page_id, regexp_extract_all(html, '{_LINK}', 1) AS hrefs,
                  regexp_extract_all(html, '{_LINK}', 2) AS names FROM pages)
SELECT page_id, CAST(i - 1 AS INTEGER) AS card_no, trim(names[i]) AS title, 'Unknown' AS company,
       'Egypt' AS location, 'https://wuzzuf.net/jobs/p/' || hrefs[i] AS url,
       'wuzzuf_' || left(sha1(unhex('{vocab.URL_NAMESPACE_HEX}') || encode('https://wuzzuf.net/jobs/p/' || hrefs[i])), 12) AS source_id
FROM l, unnest(range(1, len(hrefs) + 1)) r(i)
""")
def page_cards(spark, d):
    """The menu links of the supplied pages dressed as job links, one card each."""
    pages = spread(table(spark, d, "pages").select("page_id", "html"), "page_id")
    dressed = F.regexp_replace("html", _LINK, '<li><div><a href="/jobs/p/$1">$2</a></div></li>')
    cards = board.search_cards(pages.withColumn("html", dressed))
    return cards.select("page_id", "card_no", "title", "company", "location", "url",
                        labels.source_id(vocab.BOARD_SITE, F.col("url")).alias("source_id"))


@query("page_details")
def page_details(spark, d):
    """Description and salary of the supplied pages; their body stands for the section."""
    pages = spread(table(spark, d, "pages").select("page_id", "html"), "page_id")
    return board.page_details(pages, fallbacks=("section", "article"))


# --- vectors ----------------------------------------------------------------------------

def _prototypes(spark, d):
    """One query vector per label: the mean of its embeddings. Labels are a small closed set."""
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return (e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
            .groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("p"))
            .select(F.col("label").cast("long").alias("query_id"),
                    F.transform("p", lambda v: v["x"]).alias("embedding")))


def _nearest(spark, d, k=4):
    corpus = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    return vectors.vector_topk(_prototypes(spark, d), corpus, k)


NEAREST = """
cells AS (SELECT label, vec_id, i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, unnest(range(1, len(embedding) + 1)) r(i)),
means AS (SELECT label, i, avg(x) AS x FROM cells GROUP BY 1, 2),
prototypes AS (SELECT label, list(x ORDER BY i) AS p FROM means GROUP BY 1),
distances AS (SELECT CAST(p.label AS BIGINT) AS query_id, vec_id AS item_id,
                     round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), p.p), 9) AS distance
              FROM embeddings, prototypes p),
nearest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS rank
                           FROM distances) WHERE rank <= 4)"""


@query("vector_topk", f"WITH {NEAREST} SELECT query_id, item_id, round(distance, 5) AS distance, rank FROM nearest")
def vector_topk(spark, d):
    near = _nearest(spark, d)
    return near.select("query_id", "item_id", F.round("distance", 5).alias("distance"),
                       F.col("rank").cast("long").alias("rank"))


@query("question_search")
def question_search(spark, d):
    """The benchmark items asked as questions of all documents, both with the default embedding."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    documents = spread(table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text"), "item_id")
    return vectors.search_questions(asked, vectors.hashing_embed(documents, "text"))


# --- conversations ----------------------------------------------------------------------

@query("chat_history_tail", """
SELECT conv_id, turn, role, text FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 6
""")
def chat_history_tail(spark, d):
    return vectors.history_tail(table(spark, d, "conversations"))


@query("context_assembly", f"""
WITH {NEAREST},
asked AS (SELECT conv_id, turn, text FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role = 'user') WHERE n = 1),
blocks AS (SELECT query_id, rank, '--- Matching Vacancy #' || rank || ' (Semantic Match Score: '
                  || CAST(round(1 - distance, 2) AS VARCHAR) || ') ---' || chr(10) || text || chr(10) AS block
           FROM nearest JOIN documents ON doc_id = item_id WHERE distance < 0.65),
contexts AS (SELECT query_id, string_agg(block, chr(10) ORDER BY rank) AS context FROM blocks GROUP BY 1),
earlier AS (SELECT c.conv_id, c.turn, c.role, c.text,
                   row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn DESC) AS n
            FROM conversations c JOIN asked a ON c.conv_id = a.conv_id AND c.turn < a.turn),
tails AS (SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history FROM earlier WHERE n <= 6 GROUP BY 1)
SELECT a.conv_id, coalesce(context, 'No active vacancy context matches this query.') AS context,
       coalesce(history, '') AS history, a.text AS message
FROM asked a LEFT JOIN contexts ON query_id = a.conv_id % 16 LEFT JOIN tails t ON t.conv_id = a.conv_id
""")
def context_assembly(spark, d):
    turns = table(spark, d, "conversations")
    asked = (turns.where("role = 'user'").groupBy("conv_id")
             .agg(F.max(F.struct("turn", "text")).alias("last"))
             .select("conv_id", F.col("last.turn").alias("at"), F.col("last.text").alias("message"),
                     (F.col("conv_id") % 16).alias("query_id")))
    before = turns.join(asked.select("conv_id", "at"), "conv_id").where("turn < at").drop("at")
    documents = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"),
                                                    F.col("text").alias("document"))
    contexts = vectors.context_blocks(_nearest(spark, d), documents, below=0.65)
    return vectors.prompt_rows(asked, contexts, before)
