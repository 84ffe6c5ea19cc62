"""Registered queries: search, pages and dashboard aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from laborlens import vocab
from laborlens.functions import labels, money
from laborlens.operators import aggregates, filters, lookup, ranks, search
from laborlens.plans.tables import POSTINGS, as_of, postings, query, table

_CARD = "posting_id, title, company, country, job_type, contract_type, seniority, salary_min, salary_max"
_NEWEST = "coalesce(posted_at, scraped_at) DESC, posting_id"
CARD = [c.strip() for c in _CARD.split(",")]


@query("posting_search", f"""
WITH {POSTINGS}
SELECT {_CARD} FROM fresh
WHERE contains(lower(title), 'high') AND job_type = 'remote' ORDER BY {_NEWEST}
""")
def posting_search(spark, d):
    found = search.search_postings(postings(spark, d), " HIGH ", as_of(spark, d), job_type="remote",
                                   country="all", seniority="")
    return found.select(*CARD)


@query("posting_search_company", f"""
WITH {POSTINGS}
SELECT {_CARD} FROM fresh
WHERE (lower(title) LIKE '%customer%1_5%' OR lower(company) LIKE '%customer%1_5%')
  AND contract_type = 'contract' ORDER BY {_NEWEST}
""")
def posting_search_company(spark, d):
    found = search.search_postings(postings(spark, d), "customer%1_5", as_of(spark, d),
                                   raw_pattern=True, contract_type="contract")
    return found.select(*CARD)


def _page_sql(page: str) -> str:
    return f"""
WITH {POSTINGS},
paged AS (
  SELECT *, row_number() OVER (ORDER BY {_NEWEST}) AS row_no, count(*) OVER () AS total_rows FROM fresh
),
sized AS (SELECT *, greatest(1, CAST(ceil(total_rows / 21.0) AS INTEGER)) AS total_pages FROM paged)
SELECT posting_id, title, row_no, CAST(ceil(row_no / 21.0) AS INTEGER) AS page, total_rows, total_pages,
       array_to_string(range(greatest(1, CAST(ceil(row_no / 21.0) AS INTEGER) - 2),
                             least(total_pages, CAST(ceil(row_no / 21.0) AS INTEGER) + 2) + 1), ',') AS shown
FROM sized WHERE CAST(ceil(row_no / 21.0) AS INTEGER) = least(total_pages, {page})
"""


def _page(spark, d, page):
    hits = search.search_postings(postings(spark, d, country=False).withColumn("country", F.lit(None)),
                                  None, as_of(spark, d))
    page = search.page_of(hits, page)
    return page.select("posting_id", "title", F.col("row_no").cast("long"), "page", "total_rows",
                       "total_pages", F.array_join("page_range", ",").alias("shown"))


@query("posting_page", _page_sql("3"))
def posting_page(spark, d):
    return _page(spark, d, 3)


@query("posting_page_before_first", _page_sql("1"))
def posting_page_before_first(spark, d):
    """Page 0 is the first."""
    return _page(spark, d, 0)


@query("posting_page_far", _page_sql("30"))
def posting_page_far(spark, d):
    """A page beyond row 500, or the last where there are fewer."""
    return _page(spark, d, 30)


@query("posting_page_past_end", _page_sql("1000000"))
def posting_page_past_end(spark, d):
    """A page past the end is the last."""
    return _page(spark, d, 1_000_000)


@query("posting_row_numbers", f"""
WITH {POSTINGS}
SELECT posting_id, row_number() OVER (ORDER BY {_NEWEST}) AS row_no FROM fresh
""")
def posting_row_numbers(spark, d):
    """The number of every fresh posting, newest first."""
    rows = filters.fresh(postings(spark, d, company=False, country=False), as_of(spark, d))
    return ranks.numbered(search.page_directory(rows)).select("posting_id", "row_no")


@query("posting_pages", f"""
WITH {POSTINGS},
placed AS (SELECT posting_id, row_number() OVER (ORDER BY {_NEWEST}) AS row_no, count(*) OVER () AS n FROM fresh),
asked AS (SELECT page, least(page, (SELECT CAST(ceil(max(n) / 21.0) AS INTEGER) FROM placed)) AS shown
          FROM (VALUES (1), (2), (30), (1000000)) AS p(page))
SELECT page AS asked, posting_id, row_no FROM asked JOIN placed ON CAST(ceil(row_no / 21.0) AS INTEGER) = shown
""")
def posting_pages(spark, d):
    """First, second, far and last page from one directory."""
    rows = filters.fresh(postings(spark, d, company=False, country=False), as_of(spark, d))
    found = search.page_directory(rows)
    pages = [search.page_rows(found, p).select(F.lit(p).alias("asked"), "posting_id", "row_no") for p in (1, 2, 30, 1_000_000)]
    return reduce(DataFrame.unionByName, pages)


@query("offset_page", f"""
WITH {POSTINGS}
SELECT posting_id, job_type FROM fresh ORDER BY {_NEWEST}
LIMIT 21 OFFSET (SELECT greatest(0, least(3, ceil(count(*) / 21)) - 1) * 21 FROM fresh)
""")
def offset_page(spark, d):
    """The third page, or the last where there are fewer."""
    rows = filters.fresh(postings(spark, d, company=False, country=False), as_of(spark, d))
    return search.offset_page(rows, 3).select("posting_id", "job_type")


@query("salary_sorted_page", f"""
WITH {POSTINGS},
page AS (SELECT * FROM fresh ORDER BY {_NEWEST} LIMIT 21 OFFSET 21),
keyed AS (
  SELECT posting_id, coalesce(nullif(CASE WHEN salary_max IS NULL THEN salary_min * 1.5 END, 0),
                              nullif(salary_max, 0), 0) AS sort_key FROM page
)
SELECT posting_id, round(sort_key, 2) AS sort_key,
       row_number() OVER (ORDER BY sort_key DESC, posting_id) AS place FROM keyed
""")
def salary_sorted_page(spark, d):
    rows = (postings(spark, d, company=False, country=False)
            .withColumn("predicted_max", F.when(F.col("salary_max").isNull(), F.col("salary_min") * 1.5))
            .withColumn("predicted_min", F.lit(None).cast("double")))
    hits = filters.fresh(rows, as_of(spark, d)).orderBy(*search.newest_first())
    page = search.salary_sorted_page(hits, 2)
    key = money.high_sort_key(F.col("predicted_max"), F.col("salary_max"))
    # the page's own order, numbered: at most one page of rows in the window
    return page.select("posting_id", F.round(key, 2).alias("sort_key"),
                       F.row_number().over(W.orderBy(key.desc(), "posting_id")).cast("long").alias("place"))


@query("kpi_block", f"""
WITH {POSTINGS}
SELECT count(*) AS total, count_if(job_type = 'remote') AS remote,
       count_if(contract_type = 'internship') AS internships,
       count(DISTINCT company_id) AS companies, count(DISTINCT country) AS countries,
       count_if(source = 'social') AS social_posts,
       (SELECT max(scraped_at) FROM postings) AS last_updated
FROM fresh
""")
def kpi_block(spark, d):
    return aggregates.kpi_block(postings(spark, d), as_of(spark, d))


@query("filter_options", f"""
WITH {POSTINGS}
SELECT DISTINCT 'country' AS filter, country AS value FROM fresh WHERE country IS NOT NULL
UNION ALL
SELECT DISTINCT 'seniority', seniority FROM fresh WHERE seniority IS NOT NULL
""")
def filter_options(spark, d):
    return aggregates.filter_options(postings(spark, d), as_of(spark, d))


@query("seniority_breakdown", f"""
WITH {POSTINGS}
SELECT seniority, count(*) AS count FROM fresh WHERE seniority IS NOT NULL GROUP BY 1
""")
def seniority_breakdown(spark, d):
    return aggregates.seniority_breakdown(postings(spark, d, False, False), as_of(spark, d))


def _salary_sql(key):
    usd = "CASE WHEN lower(country) IN ('united kingdom', 'gb', 'uk') THEN {c} * 1.25 ELSE {c} END"
    return f"""
WITH {POSTINGS}
SELECT {key}, round_even(avg({usd.format(c='salary_min')}), 0) AS avg_min,
       round_even(avg({usd.format(c='salary_max')}), 0) AS avg_max, count(salary_min) AS job_count
FROM fresh WHERE salary_min IS NOT NULL AND {key} IS NOT NULL GROUP BY 1
"""


@query("salary_by_seniority", _salary_sql("seniority"))
def salary_by_seniority(spark, d):
    return aggregates.salary_by_seniority(postings(spark, d), as_of(spark, d))


@query("salary_by_country", _salary_sql("country"))
def salary_by_country(spark, d):
    return aggregates.salary_by_country(postings(spark, d), as_of(spark, d))


@query("salary_stats_2d", f"""
WITH {POSTINGS}
SELECT country, job_type, round(avg(salary_min), 0) AS avg_min, round(avg(salary_max), 0) AS avg_max,
       count(*) AS job_count
FROM postings WHERE salary_min IS NOT NULL GROUP BY 1, 2
""")
def salary_stats_2d(spark, d):
    return aggregates.salary_stats(postings(spark, d))


@query("contract_share", f"""
WITH {POSTINGS}
SELECT contract_type, count(*) AS count,
       round(count(*) * 100 / (SELECT count(*) FROM fresh), 1) AS pct FROM fresh GROUP BY 1
""")
def contract_share(spark, d):
    return aggregates.contract_share(postings(spark, d, False, False), as_of(spark, d))


@query("top_countries_share", f"""
WITH {POSTINGS},
top AS (SELECT country, count(*) AS cnt FROM fresh WHERE country IS NOT NULL AND country <> ''
        GROUP BY 1 ORDER BY cnt DESC, country LIMIT 6)
SELECT country, cnt, round(cnt * 100 / max(cnt) OVER (), 1) AS pct FROM top
""")
def top_countries_share(spark, d):
    return aggregates.top_countries(postings(spark, d), as_of(spark, d))


_SUMMARIES = """
summaries AS (
  SELECT *, CASE WHEN posting_id % 3 = 0 THEN 'done' WHEN posting_id % 3 = 1 THEN '' END AS summary_en,
         CASE WHEN posting_id % 6 < 4 THEN 'ready' END AS summary_ar,
         CASE WHEN posting_id % 10 <> 0 THEN title END AS description FROM {source}
)"""


def _with_summaries(rows):
    key = F.col("posting_id")
    return (rows.withColumn("summary_en", F.when(key % 3 == 0, "done").when(key % 3 == 1, ""))
            .withColumn("summary_ar", F.when(key % 6 < 4, "ready"))
            .withColumn("description", F.when(key % 10 != 0, F.col("title"))))


@query("backfill_candidates", f"""
WITH {POSTINGS}, {_SUMMARIES.format(source='fresh')}
SELECT posting_id, description FROM summaries
WHERE (coalesce(summary_en, '') = '' OR coalesce(summary_ar, '') = '')
  AND description IS NOT NULL AND description <> ''
ORDER BY {_NEWEST}
""")
def backfill_candidates(spark, d):
    rows = _with_summaries(postings(spark, d, country=False))
    return filters.backfill_candidates(rows, as_of(spark, d)).select("posting_id", "description")


@query("summary_progress", f"""
WITH {POSTINGS}, {_SUMMARIES.format(source='postings')}
SELECT count(*) AS total, count_if(summary_en IS NOT NULL AND summary_en <> '') AS summarised,
       CAST(floor(count_if(summary_en IS NOT NULL AND summary_en <> '') * 100 / count(*)) AS INTEGER) AS progress
FROM summaries
""")
def summary_progress(spark, d):
    rows = postings(spark, d, False, False).withColumn("title", F.lit(""))
    return aggregates.summary_progress(_with_summaries(rows))


@query("labelled_salaries", "SELECT count(o_totalprice) AS labelled, count(o_totalprice) >= 50 AS retrain FROM orders")
def labelled_salaries(spark, d):
    rows = postings(spark, d, False, False)
    n = F.count("salary_min")
    return rows.agg(n.alias("labelled"), (n >= 50).alias("retrain"))


@query("training_rows", f"""
WITH {POSTINGS}
SELECT posting_id, salary_min, salary_max FROM postings
WHERE salary_min > 0 AND salary_max > 0 AND salary_min < 500000 AND salary_max < 500000
""")
def training_rows(spark, d):
    return (filters.training_rows(postings(spark, d, False, False))
            .select("posting_id", "salary_min", "salary_max"))


@query("expired_postings", f"""
WITH {POSTINGS}
SELECT posting_id FROM postings
WHERE coalesce(posted_at, scraped_at) < (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY
""")
def expired_postings(spark, d):
    return postings(spark, d, False, False).where(filters.is_expired(as_of(spark, d))).select("posting_id")


@query("fetch_by_ids", f"""
WITH {POSTINGS}
SELECT posting_id, title, company FROM postings WHERE posting_id IN (SELECT vec_id FROM embeddings)
""")
def fetch_by_ids(spark, d):
    wanted = table(spark, d, "embeddings").select(F.col("vec_id").alias("posting_id"))
    found = filters.in_ids(postings(spark, d, country=False), wanted, "posting_id")
    return found.select("posting_id", "title", "company")


@query("label_lookup", f"""
WITH {POSTINGS},
labels(lang, key, label) AS (VALUES {", ".join(str(row) for row in vocab.LABEL_ROWS)})
SELECT posting_id, contract_type, coalesce(l.label, contract_type) AS label
FROM postings LEFT JOIN labels l ON l.lang = 'ar' AND l.key = contract_type
""")
def label_lookup(spark, d):
    rows = postings(spark, d, False, False).select("posting_id", "contract_type")
    return lookup.translate(rows, lookup.label_table(spark), "contract_type", "ar")


@query("age_label", """
WITH t AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'bad' ELSE CAST(ts AS VARCHAR) END AS day,
                  (SELECT CAST(max(ts) AS DATE) FROM events) AS today FROM events),
a AS (SELECT event_id, greatest(date_diff('day', TRY_CAST(left(day, 10) AS DATE), today), 0) AS days,
             TRY_CAST(left(day, 10) AS DATE) AS ok FROM t)
SELECT event_id,
       CASE WHEN ok IS NULL THEN '' WHEN days = 0 THEN 'today' WHEN days = 1 THEN 'yesterday'
            ELSE days || ' days ago' END AS age_en,
       CASE WHEN ok IS NULL THEN '' WHEN days = 0 THEN 'النهاردة' WHEN days = 1 THEN 'إمبارح'
            WHEN days = 2 THEN 'من يومين' WHEN days <= 10 THEN 'من ' || days || ' أيام'
            ELSE 'من ' || days || ' يوم' END AS age_ar
FROM a
""")
def age_label(spark, d):
    e = table(spark, d, "events")
    today = e.agg(F.max("ts").cast("date")).scalar()
    day = F.when(F.col("event_id") % 9 == 0, "bad").otherwise(F.col("ts").cast("string"))
    return e.select("event_id", labels.age_label(day, today).alias("age_en"),
                    labels.age_label(day, today, "ar").alias("age_ar"))


@query("salary_label", f"""
WITH {POSTINGS},
p AS (
  SELECT posting_id, country, CASE WHEN posting_id % 4 <> 0 THEN salary_min ELSE 0 END AS lo,
         CASE WHEN posting_id % 4 < 2 THEN NULL ELSE salary_max END AS hi,
         CASE WHEN posting_id % 8 = 0 THEN salary_min END AS pl,
         CASE WHEN posting_id % 16 = 0 THEN salary_min * 2 END AS ph,
         CASE WHEN country = 'Egypt' THEN 'mo' ELSE 'yr' END AS unit,
         CASE WHEN lower(country) IN ('us', 'usa', 'united states') THEN '$'
              WHEN lower(country) IN ('eg', 'egypt') THEN 'E£' ELSE '£' END AS s
  FROM postings
),
m AS (SELECT *, s || format('{{:,}}', CAST(round_even(nullif(lo, 0), 0) AS BIGINT)) AS lot,
             s || format('{{:,}}', CAST(round_even(nullif(hi, 0), 0) AS BIGINT)) AS hit,
             s || format('{{:,}}', CAST(round_even(nullif(pl, 0), 0) AS BIGINT)) AS plt,
             s || format('{{:,}}', CAST(round_even(nullif(ph, 0), 0) AS BIGINT)) AS pht FROM p)
SELECT posting_id,
       CASE WHEN lot IS NOT NULL OR hit IS NOT NULL THEN concat_ws('–', lot, hit)
            WHEN plt IS NOT NULL OR pht IS NOT NULL THEN concat_ws('–', plt, pht) || '/' || unit || ' (ML Predicted)'
            ELSE 'ML Predicted' END AS label
FROM m
""")
def salary_label(spark, d):
    rows, key, low = postings(spark, d), F.col("posting_id"), F.col("salary_min")
    period = F.when(F.col("country") == "Egypt", "monthly").otherwise("annual")
    label = money.salary_label(
        F.col("country"), F.when(key % 4 != 0, low).otherwise(0.0),
        F.when(key % 4 >= 2, F.col("salary_max")),
        F.when(key % 8 == 0, low), F.when(key % 16 == 0, low * 2), period)
    return rows.select("posting_id", label.alias("label"))
