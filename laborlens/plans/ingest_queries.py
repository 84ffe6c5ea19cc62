"""Registered queries: feed normalisation, write semantics, detection rules, money."""

from __future__ import annotations

from pyspark.sql import functions as F

from laborlens import vocab
from laborlens.functions import detect, labels, money
from laborlens.functions.text import split_list
from laborlens.operators import filters, ingest, lookup
from laborlens.plans.tables import POSTINGS, SKILLS, postings, posting_skills, query, table
from laborlens.schema import API_POSTING
from laborlens.session import spread
from laborlens.sources import api, feeds, resumes


def _pick(number, *values):
    """The value at number modulo count; None for NULL."""
    out = None
    for i, v in enumerate(values[:-1]):
        out = (F if out is None else out).when(number % len(values) == i, F.lit(v))
    return out.otherwise(F.lit(values[-1]))


def _pick_sql(number, *values):
    def lit(v):
        return "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    whens = " ".join(f"WHEN {number} % {len(values)} = {i} THEN {lit(v)}"
                     for i, v in enumerate(values[:-1]))
    return f"CASE {whens} ELSE {lit(values[-1])} END"


# --- API results ------------------------------------------------------------------------

_CODES = ("gb", "us", "eg", "fr", "in")
_WORK = ("Fully Remote team", "hybrid or remote", "Hybrid week", "in the office")
_COUNTRY_CASE = "CASE code " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in vocab.API_COUNTRY_NAMES.items()) + " ELSE upper(code) END"


@query("normalise_api", f"""
WITH raw AS (
  SELECT event_id, user_id, value, ts, {_pick_sql('event_id', *_CODES)} AS code,
         CASE WHEN event_id % 7 <> 0 THEN event_type END AS title,
         {_pick_sql('user_id', *_WORK)} || ' ' || json_extract_string(props, '$.k') AS description
  FROM events
)
SELECT CAST(event_id AS VARCHAR) AS source_id, coalesce(title, '') AS title,
       CASE WHEN user_id % 4 = 0 THEN 'Unknown' ELSE 'Company ' || user_id END AS company,
       CASE WHEN user_id % 5 = 0 THEN '' ELSE 'Town ' || user_id END AS location,
       {_COUNTRY_CASE} AS country,
       CASE WHEN contains(lower(coalesce(title, '') || ' ' || description), 'remote') THEN 'remote'
            WHEN contains(lower(coalesce(title, '') || ' ' || description), 'hybrid') THEN 'hybrid'
            ELSE 'onsite' END AS job_type,
       value AS salary_min, NULL::DOUBLE AS salary_max, description, 'adzuna' AS source,
       '' AS source_url,
       CASE WHEN event_id % 9 <> 0 THEN ts END AS posted_at
FROM raw
""")
def normalise_api(spark, d):
    e = table(spark, d, "events")
    uid, eid = F.col("user_id"), F.col("event_id")
    k = F.from_json("props", "k string")["k"]
    body = F.to_json(F.struct(
        eid.cast("string").alias("id"),
        F.when(eid % 7 != 0, F.col("event_type")).alias("title"),
        F.concat_ws(" ", _pick(uid, *_WORK), k).alias("description"),
        F.when(uid % 4 != 0, F.struct(F.concat(F.lit("Company "), uid).alias("display_name"))).alias("company"),
        F.when(uid % 5 != 0, F.struct(F.concat(F.lit("Town "), uid).alias("display_name"))).alias("location"),
        F.col("value").alias("salary_min"),
        F.when(eid % 9 != 0, F.col("ts").cast("string")).otherwise("soon").alias("created")))
    raw = (e.select(_pick(eid, *_CODES).alias("country"), F.from_json(body, API_POSTING).alias("r"))
           .select("country", "r.*"))
    return api.normalise_api(raw)


# --- tabular feeds ----------------------------------------------------------------------

_TYPES = ("fulltime, remote", "parttime", "contract", "hybrid internship", None)
_TITLES = ("Data analyst", "Remote engineer", "International sales", "NaN", "Intern")
_PLACES = ("Cairo, Egypt", "Riyadh", "Dubai , UAE ", None)
_AMOUNTS = ("5000", "", "NaN", "7500.5", "0", "12,000", None)
_DATES = ("2024-01-05", "2024-01-06T10:00:00Z", "nan", None)


def _raw_feed(spark, d, site):
    docs = spread(table(spark, d, "documents"), "doc_id")
    key = F.col("doc_id")
    return docs.select(
        _pick(key, *_TITLES).alias("title"), F.col("text").alias("description"),
        F.when(key % 6 != 0, F.col("source")).alias("company"), _pick(key, *_PLACES).alias("location"),
        _pick(key, *vocab.FEED_LOCATIONS[site]).alias("searched_location"),
        F.when(key % 8 != 0, F.concat(F.lit("https://jobs.example.org/"), key)).alias("job_url"),
        _pick(key, *_AMOUNTS).alias("min_amount"), _pick(key + 2, *_AMOUNTS).alias("max_amount"),
        _pick(key, *_TYPES).alias("job_type"), _pick(key, *_DATES).alias("date_posted"))


def _feed_sql(site):
    amount = "TRY_CAST(nullif(nullif({0}, ''), 'NaN') AS DOUBLE)"
    lo, hi = amount.format("lo"), amount.format("hi")
    bad = ("((coalesce(lo, '') NOT IN ('', 'NaN') AND TRY_CAST(lo AS DOUBLE) IS NULL) OR "
           "(coalesce(hi, '') NOT IN ('', 'NaN') AND TRY_CAST(hi AS DOUBLE) IS NULL))")
    country = "split_part(searched, ' ', -1)" if site in vocab.LAST_WORD_FEEDS else "searched"
    name = "CASE WHEN url <> '' THEN url ELSE concat_ws(chr(1), title, coalesce(company, ''), location) END"
    return f"""
SELECT '{site}_' || left(sha1(unhex('{vocab.URL_NAMESPACE_HEX}') || encode({name})), 12) AS source_id,
       title, coalesce(nullif(company, ''), 'Unknown') AS company, location, {country} AS country,
       CASE WHEN contains(jt, 'remote') OR contains(lower(title), 'remote') THEN 'remote'
            WHEN contains(jt, 'hybrid') THEN 'hybrid' ELSE 'onsite' END AS job_type,
       CASE WHEN contains(jt, 'internship') OR contains(lower(title), 'intern') THEN 'internship'
            WHEN contains(jt, 'part') THEN 'part-time' WHEN contains(jt, 'contract') THEN 'contract'
            ELSE 'full-time' END AS contract_type,
       CASE WHEN {bad} THEN NULL ELSE nullif({lo}, 0) END AS salary_min,
       CASE WHEN {bad} THEN NULL ELSE nullif({hi}, 0) END AS salary_max,
       text AS description, '{site}' AS source, url AS source_url,
       NULL::VARCHAR AS raw_post_text,
       CASE day WHEN '2024-01-05' THEN TIMESTAMP '2024-01-05' WHEN 'nan' THEN NULL
                WHEN '2024-01-06T10:00:00Z' THEN TIMESTAMP '2024-01-06 10:00:00' END AS posted_at
FROM (
  SELECT text, CASE WHEN doc_id % 6 <> 0 THEN source END AS company,
         coalesce(nullif({_pick_sql('doc_id', *_TITLES)}, 'NaN'), '') AS title,
         coalesce({_pick_sql('doc_id', *_PLACES)}, '') AS location,
         {_pick_sql('doc_id', *vocab.FEED_LOCATIONS[site])} AS searched,
         CASE WHEN doc_id % 8 <> 0 THEN 'https://jobs.example.org/' || doc_id ELSE '' END AS url,
         {_pick_sql('doc_id', *_AMOUNTS)} AS lo, {_pick_sql('(doc_id + 2)', *_AMOUNTS)} AS hi,
         coalesce({_pick_sql('doc_id', *_TYPES)}, '') AS jt, {_pick_sql('doc_id', *_DATES)} AS day
  FROM documents
)"""


@query("normalise_feed", _feed_sql("bayt"))
def normalise_feed(spark, d):
    raw = _raw_feed(spark, d, "bayt")
    return feeds.normalise_feed(feeds.override_country(raw, "bayt"), "bayt")


@query("union_feeds", f"""
SELECT source, country, job_type, count(*) AS postings, count(DISTINCT source_id) AS ids,
       round(sum(salary_min), 2) AS low, sum(length(description)) AS chars
FROM ({' UNION ALL '.join(_feed_sql(s) for s in vocab.FEED_LOCATIONS)}) GROUP BY 1, 2, 3
""")
def union_feeds(spark, d):
    rows = feeds.ingest_feeds({site: _raw_feed(spark, d, site) for site in vocab.FEED_LOCATIONS})
    return rows.groupBy("source", "country", "job_type").agg(
        F.count(F.lit(1)).alias("postings"), F.count_distinct("source_id").alias("ids"),
        F.round(F.sum("salary_min"), 2).alias("low"), F.sum(F.length("description")).alias("chars"))


@query("location_country", f"""
SELECT doc_id, trim(split_part({_pick_sql('doc_id', *_PLACES)}, ',', -1)) AS country FROM documents
""")
def location_country(spark, d):
    place = _pick(F.col("doc_id"), *_PLACES)
    return table(spark, d, "documents").select("doc_id", detect.country_of_location(place).alias("country"))


@query("upload_guard", """
WITH f AS (SELECT doc_id, n_chars * 1500 AS bytes,
                  CASE doc_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'DOCX' WHEN 2 THEN 'txt' ELSE 'doc' END AS ext
           FROM documents)
SELECT doc_id, CASE WHEN lower(ext) NOT IN ('pdf', 'docx')
                    THEN 'Invalid file extension. Only PDF and DOCX files are allowed.'
                    WHEN bytes > 5242880 THEN 'File is too large. Maximum size allowed is 5MB.' END AS reject_reason
FROM f
""")
def upload_guard(spark, d):
    ext = _pick(F.col("doc_id"), "pdf", "DOCX", "txt", "doc")
    files = table(spark, d, "documents").select(
        "doc_id", F.concat(F.lit("/in/cv."), F.col("doc_id"), F.lit("."), ext).alias("path"),
        (F.col("n_chars") * 1500).alias("length"))
    return resumes.guard_uploads(files).select("doc_id", "reject_reason")


@query("required_fields", """
SELECT conv_id, turn, CASE WHEN turn % 3 = 0 OR text IS NULL OR text = '' THEN 'message is required'
                           WHEN turn % 4 = 1 THEN 'skills list required' END AS error
FROM conversations
""")
def required_fields(spark, d):
    rows = table(spark, d, "conversations").select(
        "conv_id", "turn", F.when(F.col("turn") % 3 != 0, F.col("text")).alias("message"),
        F.when(F.col("turn") % 4 != 1, F.array("role")).otherwise(F.array().cast("array<string>")).alias("skills"))
    checked = filters.check_required(rows, message="message is required", skills="skills list required")
    return checked.select("conv_id", "turn", "error")


# --- write semantics --------------------------------------------------------------------

_ARRIVALS = """
arrivals AS (
  SELECT CASE WHEN event_id % 17 <> 0 THEN CAST(event_id AS VARCHAR) END AS source_id,
         CASE WHEN event_id % 13 <> 0 THEN event_type END AS title,
         CASE WHEN user_id % 4 <> 0 THEN 'Company ' || user_id END AS company, copy, value + copy AS salary_min
  FROM events, (VALUES (0), (1)) c(copy)
)"""


def _arrivals(spark, d):
    e = table(spark, d, "events")
    rows = e.select(
        F.when(F.col("event_id") % 17 != 0, F.col("event_id").cast("string")).alias("source_id"),
        F.when(F.col("event_id") % 13 != 0, F.col("event_type")).alias("title"),
        F.when(F.col("user_id") % 4 != 0, F.concat(F.lit("Company "), "user_id")).alias("company"), "value")
    copies = F.explode(F.array(F.lit(0), F.lit(1)))
    return (rows.withColumn("copy", copies)
            .withColumn("salary_min", F.col("value") + F.col("copy")).drop("value"))


@query("dedup_first_wins", f"""
WITH {_ARRIVALS},
ok AS (SELECT *, coalesce(company, 'Unknown') AS shown FROM arrivals WHERE title IS NOT NULL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY salary_min) AS n FROM ok)
SELECT source_id, title, shown AS company, salary_min, 'onsite' AS job_type, 'full-time' AS contract_type,
       'adzuna' AS source
FROM numbered WHERE source_id IS NULL OR n = 1
""")
def dedup_first_wins(spark, d):
    rows, _ = ingest.accept(_arrivals(spark, d).drop("copy"))
    kept = ingest.first_wins(rows, [F.asc("salary_min")])
    return kept.select("source_id", "title", "company", "salary_min", "job_type", "contract_type", "source")


@query("ingest_counts", f"""
WITH {_ARRIVALS},
ok AS (SELECT * FROM arrivals WHERE title IS NOT NULL
       AND (source_id IS NULL OR CAST(source_id AS BIGINT) % 5 <> 0))
SELECT (SELECT count(*) FROM arrivals) AS arrived,
       (SELECT count(DISTINCT source_id) + count_if(source_id IS NULL) FROM ok) AS inserted,
       (SELECT count(*) FROM arrivals WHERE title IS NULL) AS rejected,
       (SELECT count(*) FROM arrivals WHERE title IS NOT NULL)
         - (SELECT count(DISTINCT source_id) + count_if(source_id IS NULL) FROM ok) AS duplicate
""")
def ingest_counts(spark, d):
    arriving = _arrivals(spark, d)
    rows, rejected = ingest.accept(arriving.drop("copy"))
    batch = ingest.first_wins(rows, [F.asc("salary_min")])
    stored = (table(spark, d, "events").where("event_id % 5 = 0")
              .select(F.col("event_id").cast("string").alias("source_id")))
    return ingest.ingest_counts(arriving, ingest.not_stored(batch, stored), rejected)


@query("insert_new_only", """
SELECT CAST(o_orderkey AS VARCHAR) AS source_id, o_totalprice AS salary_min FROM orders
WHERE o_orderkey NOT IN (SELECT event_id FROM events)
""")
def insert_new_only(spark, d):
    batch = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("source_id"),
                                             F.col("o_totalprice").alias("salary_min"))
    stored = table(spark, d, "events").select(F.col("event_id").cast("string").alias("source_id"))
    return ingest.not_stored(batch, stored)


@query("dimension_upsert", """
WITH old AS (SELECT s_name AS name, 'first feed' AS category FROM supplier),
new AS (SELECT DISTINCT replace(c_name, 'Customer', 'Supplier') AS name FROM customer)
SELECT name, category FROM old
UNION ALL SELECT name, NULL FROM new WHERE name NOT IN (SELECT name FROM old)
""")
def dimension_upsert(spark, d):
    old = table(spark, d, "supplier").select(F.col("s_name").alias("name"),
                                             F.lit("first feed").alias("category"))
    names = (table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "right")
             .select(F.replace("c_name", F.lit("Customer"), F.lit("Supplier")).alias("name")))
    return ingest.get_or_create(names, old, "name")


@query("replace_last_wins", f"""
WITH {SKILLS},
changed AS (
  SELECT l_orderkey AS posting_id, p_name AS skill, max(l_discount) AS score
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY 1, 2
)
SELECT s.posting_id, s.skill, coalesce(c.score, s.score) AS score
FROM posting_skills s LEFT JOIN changed c ON s.posting_id = c.posting_id AND s.skill = c.skill
""")
def replace_last_wins(spark, d):
    parts = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("skill"))
    lines = table(spark, d, "lineitem").where("l_returnflag = 'R'")
    scored = (lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
              .select(F.col("l_orderkey").alias("posting_id"), "skill", F.col("l_discount").alias("score")))
    changed = ingest.last_wins(scored, ["posting_id", "skill"], [F.desc("score")])
    return ingest.replace_rows(posting_skills(spark, d), changed, ["posting_id", "skill"])


@query("update_summaries", """
SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'good' ELSE d.lang END AS summary_en, d.source AS summary_ar
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def update_summaries(spark, d):
    stored = table(spark, d, "documents").select("doc_id", F.col("lang").alias("summary_en"),
                                                 F.col("source").alias("summary_ar"))
    updates = table(spark, d, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, "good").alias("summary_en"),
        F.lit(None).cast("string").alias("summary_ar"))
    return ingest.update_columns(stored, updates, "doc_id", ["summary_en", "summary_ar"])


@query("reset_summaries", "SELECT doc_id, NULL::VARCHAR AS lang, source FROM documents")
def reset_summaries(spark, d):
    return ingest.reset_columns(table(spark, d, "documents").select("doc_id", "lang", "source"), ["lang"])


@query("stable_source_id", f"""
SELECT page_id, 'site_' || left(sha1(unhex('{vocab.URL_NAMESPACE_HEX}') || encode(url)), 12) AS source_id FROM pages
""")
def stable_source_id(spark, d):
    return table(spark, d, "pages").select("page_id", labels.source_id("site", F.col("url")).alias("source_id"))


# --- detection rules --------------------------------------------------------------------

_NOTES = ("work from home", "WFH possible", "a hybrid team", "Remote first", "on site",
          "part-time", "part time remote", "freelance", "contract based", "international team")


@query("detect_work_mode", f"""
WITH t AS (SELECT doc_id, lower(coalesce(lang, '') || ' ' || text || ' ' || {_pick_sql('doc_id', *_NOTES)}) AS x,
                  lower({_pick_sql('doc_id', *_NOTES)}) AS k FROM documents)
SELECT doc_id, CASE WHEN contains(x, 'remote') THEN 'remote' WHEN contains(x, 'hybrid') THEN 'hybrid'
                    ELSE 'onsite' END AS api_mode,
       CASE WHEN contains(x, 'remote') OR contains(x, 'work from home') OR contains(x, 'wfh') THEN 'remote'
            WHEN contains(x, 'hybrid') THEN 'hybrid' ELSE 'onsite' END AS board_mode,
       CASE WHEN contains(k, 'remote') THEN 'remote' WHEN contains(k, 'hybrid') THEN 'hybrid'
            ELSE 'onsite' END AS feed_mode
FROM t
""")
def detect_work_mode(spark, d):
    docs = spread(table(spark, d, "documents"), "doc_id")
    note = _pick(F.col("doc_id"), *_NOTES)
    body = F.concat_ws(" ", "text", note)
    return docs.select("doc_id", detect.work_mode(F.col("lang"), body).alias("api_mode"),
                       detect.board_work_mode(F.concat_ws(" ", "lang", body)).alias("board_mode"),
                       detect.feed_work_mode(note, F.col("lang")).alias("feed_mode"))


@query("detect_contract", f"""
WITH t AS (SELECT doc_id, lower(text || ' ' || {_pick_sql('doc_id', *_NOTES)}) AS x,
                  lower({_pick_sql('doc_id', *_NOTES)}) AS k FROM documents)
SELECT doc_id, CASE WHEN contains(x, 'intern') THEN 'internship'
                    WHEN contains(x, 'part time') OR contains(x, 'part-time') THEN 'part-time'
                    WHEN contains(x, 'freelance') OR contains(x, 'contract') THEN 'contract'
                    ELSE 'full-time' END AS board_contract,
       CASE WHEN contains(k, 'internship') THEN 'internship' WHEN contains(k, 'part') THEN 'part-time'
            WHEN contains(k, 'contract') THEN 'contract' ELSE 'full-time' END AS feed_contract
FROM t
""")
def detect_contract(spark, d):
    docs = spread(table(spark, d, "documents"), "doc_id")
    note = _pick(F.col("doc_id"), *_NOTES)
    return docs.select("doc_id", detect.board_contract(F.concat_ws(" ", "text", note)).alias("board_contract"),
                       detect.feed_contract(note, F.col("lang")).alias("feed_contract"))


_LEVELS = ("head of sales", "reports to the manager", "Sr. developer", "staff engineer", "leader",
           "3+ years", "3+years", "mid-level", "entry-level", "entry level", "fresh start",
           "0-2 years", "plain words", None)
_B, _E = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
SENIORITY_CASE = rf"""CASE
  WHEN regexp_matches(x, '{_B}(?:lead|head of|principal|director|manager|executive|chief){_E}') THEN 'lead'
  WHEN regexp_matches(x, '{_B}(?:senior|sr|lead|staff|architect|principal){_E}') THEN 'senior'
  WHEN regexp_matches(x, '{_B}(?:mid(?:[-\s]level)?|intermediate|experienced){_E}')
    OR regexp_matches(x, '{_B}[345]\+[\p{{L}}\p{{N}}_]') THEN 'mid'
  WHEN regexp_matches(x, '{_B}(?:junior|jr|entry\s?level|graduate|fresh|intern|0-2|0-1){_E}') THEN 'junior'
  ELSE 'mid' END"""


@query("detect_seniority", f"""
WITH t AS (SELECT doc_id, source, lower(coalesce({_pick_sql('doc_id', *_LEVELS)}, '') || ' ' || text) AS x FROM documents)
SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN source ELSE {SENIORITY_CASE} END AS seniority,
       CASE WHEN contains(x, 'senior') OR contains(x, 'lead') OR contains(x, 'principal') OR contains(x, 'staff')
              OR contains(x, 'head of') THEN 'senior'
            WHEN contains(x, 'junior') OR contains(x, 'entry') OR contains(x, 'graduate') OR contains(x, 'fresh')
              OR contains(x, 'intern') THEN 'junior' ELSE 'mid' END AS coarse
FROM t
""")
def detect_seniority(spark, d):
    docs = spread(table(spark, d, "documents"), "doc_id")
    title, text = _pick(F.col("doc_id"), *_LEVELS), F.col("text")
    current = F.when(F.col("doc_id") % 10 == 0, F.col("source"))
    return docs.select("doc_id", detect.fill_seniority(current, title, text).alias("seniority"),
                       detect.coarse_seniority(title, text).alias("coarse"))


# --- money and countries ----------------------------------------------------------------

@query("parse_salary_text", r"""
WITH t AS (SELECT l_orderkey, l_linenumber,
                  CASE (l_orderkey + l_linenumber) % 5
                    WHEN 0 THEN format('{:,}', CAST(l_extendedprice AS BIGINT)) || ' - ' || format('{:,}', CAST(l_extendedprice * 2 AS BIGINT)) || ' EGP'
                    WHEN 1 THEN 'salary ' || CAST(l_quantity AS INTEGER)
                    WHEN 2 THEN '٥٠٠٠ - ' || CAST(l_extendedprice AS BIGINT)
                    WHEN 3 THEN 'from ' || CAST(CAST(l_quantity AS INTEGER) * 10 AS VARCHAR) || ' a month' END AS x
           FROM lineitem),
n AS (SELECT *, list_filter(list_transform(regexp_extract_all(replace(translate(coalesce(x, ''), '٠١٢٣٤٥٦٧٨٩', '0123456789'), ',', ''), '[0-9]+'),
                  lambda v: CAST(v AS DOUBLE)), lambda v: v > 100) AS nums FROM t)
SELECT l_orderkey, l_linenumber, nums[1] AS salary_min, nums[2] AS salary_max FROM n
""")
def parse_salary_text(spark, d):
    line = table(spark, d, "lineitem")
    price, amount = F.col("l_extendedprice"), F.col("l_quantity").cast("int")
    case = (F.col("l_orderkey") + F.col("l_linenumber")) % 5

    def whole(col):
        return F.bround(col, 0).cast("long")
    text = (F.when(case == 0, F.concat(F.format_number(whole(price), 0), F.lit(" - "),
                                       F.format_number(whole(price * 2), 0), F.lit(" EGP")))
            .when(case == 1, F.concat(F.lit("salary "), amount))
            .when(case == 2, F.concat(F.lit("٥٠٠٠ - "), whole(price)))
            .when(case == 3, F.concat(F.lit("from "), amount * 10, F.lit(" a month"))))
    pay = money.parse_salary(text)
    return line.select("l_orderkey", "l_linenumber", pay["salary_min"].alias("salary_min"),
                       pay["salary_max"].alias("salary_max"))


_CANONICAL = """CASE
  WHEN coalesce(country, '') = '' THEN 'default'
  WHEN contains(lower(country), 'united kingdom') OR lower(trim(country)) IN ('gb', 'uk') THEN 'United Kingdom'
  WHEN contains(lower(country), 'united states') OR lower(trim(country)) IN ('us', 'usa') THEN 'United States'
  WHEN contains(lower(country), 'egypt') OR lower(trim(country)) = 'eg' THEN 'Egypt'
  WHEN contains(lower(country), 'uae') OR contains(lower(country), 'united arab emirates') OR lower(trim(country)) = 'ae' THEN 'United Arab Emirates'
  WHEN contains(lower(country), 'saudi') OR lower(trim(country)) = 'sa' THEN 'Saudi Arabia'
  WHEN contains(lower(country), 'kuwait') OR lower(trim(country)) = 'kw' THEN 'Kuwait'
  ELSE 'default' END"""
_FX = ", ".join(str(row) for row in vocab.FX_ROWS)


@query("country_canonical", f"WITH {POSTINGS} SELECT posting_id, country, {_CANONICAL} AS canonical FROM postings")
def country_canonical(spark, d):
    return postings(spark, d).select("posting_id", "country",
                                     detect.canonical_country(F.col("country")).alias("canonical"))


@query("fx_convert", f"""
WITH {POSTINGS}, fx(fx_country, currency, symbol, scale, rate) AS (VALUES {_FX}),
c AS (SELECT *, {_CANONICAL} AS canonical FROM postings),
l AS (SELECT posting_id, currency, symbol, canonical,
             coalesce(salary_max, salary_min) * scale * rate / CASE WHEN canonical = 'Egypt' THEN 12 ELSE 1 END AS a,
             salary_min * scale * rate / CASE WHEN canonical = 'Egypt' THEN 12 ELSE 1 END AS b
      FROM c JOIN fx ON canonical = fx_country)
SELECT posting_id, currency, symbol, round_even(least(a, b), 0) AS salary_min,
       round_even(greatest(a, b), 0) AS salary_max,
       CASE WHEN canonical = 'Egypt' THEN 'monthly' ELSE 'annual' END AS period
FROM l
""")
def fx_convert(spark, d):
    rows = lookup.with_fx(postings(spark, d), lookup.fx_table(spark))
    # bounds given in the wrong order on purpose
    pay = money.local_salary(F.coalesce("salary_max", "salary_min"), F.col("salary_min"),
                             F.col("canonical"), F.col("scale"), F.col("rate"))
    return rows.select("posting_id", "currency", "symbol", pay.alias("p")).select(
        "posting_id", "currency", "symbol", "p.salary_min", "p.salary_max", "p.period")


@query("salary_values", f"""
SELECT doc_id, TRY_CAST(nullif(nullif(trim({_pick_sql('doc_id', *_AMOUNTS)}), ''), 'NaN') AS DOUBLE) AS amount FROM documents
""")
def salary_values(spark, d):
    amount = money.number_or_null(_pick(F.col("doc_id"), *_AMOUNTS))
    return table(spark, d, "documents").select("doc_id", amount.alias("amount"))


@query("split_skills", """
SELECT page_id, array_to_string(list_filter(list_transform(string_split(url || ', , B ,a', ','),
       lambda x: lower(trim(x))), lambda x: x <> ''), '|') AS skills FROM pages
""")
def split_skills(spark, d):
    text = F.concat("url", F.lit(", , B ,a"))
    return table(spark, d, "pages").select("page_id", F.array_join(split_list(text), "|").alias("skills"))
