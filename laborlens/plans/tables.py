"""The supplied star-schema tables seen as the engine's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTRY: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a callable (spark, sf_dir) -> DataFrame, with the SQL that must equal it."""
    def keep(fn):
        REGISTRY[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


# --- postings: orders with customer and nation ------------------------------------------

PRIORITY_CONTRACT = {"1-URGENT": "full-time", "2-HIGH": "part-time", "3-MEDIUM": "internship",
                     "4-NOT SPECIFIED": "contract"}
PRIORITY_SENIORITY = {"1-URGENT": "lead", "2-HIGH": "senior", "3-MEDIUM": "mid",
                      "4-NOT SPECIFIED": "junior"}
STATUS_MODE = {"O": "onsite", "F": "remote", "P": "hybrid"}
NATION_COUNTRY = {"NATION_0": "UK", "NATION_1": "usa", "NATION_2": "Egypt",
                  "NATION_3": "Dubai, UAE", "NATION_4": "Saudi", "NATION_5": "kw"}
NULL_NATION = "NATION_6"


def _mapped(col: Column, values: dict) -> Column:
    out = None
    for key, value in values.items():
        out = (F if out is None else out).when(col == key, value)
    return out


def _case(col: str, values: dict) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


def postings(spark: SparkSession, d: str, company: bool = True, country: bool = True) -> DataFrame:
    """Orders as postings; the joins for company and country only where asked for."""
    o = table(spark, d, "orders")
    key, priority = F.col("o_orderkey"), F.col("o_orderpriority")
    rows = o.select(
        key.alias("posting_id"), key.cast("string").alias("source_id"),
        F.col("o_custkey").alias("company_id"),
        _mapped(F.col("o_orderstatus"), STATUS_MODE).alias("job_type"),
        _mapped(priority, PRIORITY_CONTRACT).alias("contract_type"),
        _mapped(priority, PRIORITY_SENIORITY).alias("seniority"),
        F.col("o_totalprice").alias("salary_min"),
        F.when(key % 5 != 0, F.col("o_totalprice") * 1.2).alias("salary_max"),
        F.when(key % 11 != 0, F.col("o_orderdate")).alias("posted_at"),
        F.col("o_orderdate").alias("scraped_at"),
        F.when(key % 7 == 0, "social").otherwise("adzuna").alias("source"),
        priority.alias("_priority"))
    if not (company or country):
        return rows.drop("_priority")
    c = table(spark, d, "customer")
    rows = rows.join(c.select(F.col("c_custkey").alias("company_id"), F.col("c_name").alias("company"),
                              "c_mktsegment", "c_nationkey"), "company_id", "left")
    rows = rows.withColumn("title", F.concat_ws(" ", "_priority", "c_mktsegment"))
    if country:
        n = table(spark, d, "nation")
        name = F.col("n_name")
        shown = F.when(name != NULL_NATION, F.coalesce(_mapped(name, NATION_COUNTRY), name))
        rows = rows.join(n.select(F.col("n_nationkey").alias("c_nationkey"), shown.alias("country")),
                         "c_nationkey", "left")
    return rows.drop("_priority", "c_mktsegment", "c_nationkey")


POSTINGS = f"""
postings AS (
  SELECT o_orderkey AS posting_id, CAST(o_orderkey AS VARCHAR) AS source_id,
         o_custkey AS company_id, c_name AS company,
         concat_ws(' ', o_orderpriority, c_mktsegment) AS title,
         CASE WHEN n_name = '{NULL_NATION}' THEN NULL
              ELSE coalesce({_case('n_name', NATION_COUNTRY)}, n_name) END AS country,
         {_case('o_orderstatus', STATUS_MODE)} AS job_type,
         {_case('o_orderpriority', PRIORITY_CONTRACT)} AS contract_type,
         {_case('o_orderpriority', PRIORITY_SENIORITY)} AS seniority,
         o_totalprice AS salary_min,
         CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice * 1.2 END AS salary_max,
         CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS posted_at,
         o_orderdate AS scraped_at,
         CASE WHEN o_orderkey % 7 = 0 THEN 'social' ELSE 'adzuna' END AS source
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
              LEFT JOIN nation ON c_nationkey = n_nationkey
),
fresh AS (
  SELECT * FROM postings
  WHERE coalesce(posted_at, scraped_at) >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY
)"""


def as_of(spark: SparkSession, d: str) -> Column:
    """The newest order date, as a scalar subquery."""
    return table(spark, d, "orders").agg(F.max("o_orderdate")).scalar()


# --- skills: parts ordered ---------------------------------------------------------------

def skill_names(spark: SparkSession, d: str) -> DataFrame:
    return (table(spark, d, "part").groupBy(F.col("p_name").alias("name"))
            .agg(F.min("p_type").alias("category")))


def posting_skills(spark: SparkSession, d: str, lines_per_task: int | None = None) -> DataFrame:
    """The parts of each order; with ``lines_per_task`` as many tasks group them as the lines ask for."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("posting_id"),
                                               "l_partkey", "l_quantity")
    parts = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("skill"))
    ordered = lines.join(parts, lines.l_partkey == parts.p_partkey)
    if lines_per_task:
        ordered = ordered.repartition(1 + lines.count() // lines_per_task, "posting_id")
    return (ordered.groupBy("posting_id", "skill").agg((F.max("l_quantity") / 50).alias("score")))


SKILLS = """
skill_names AS (SELECT p_name AS name, min(p_type) AS category FROM part GROUP BY p_name),
posting_skills AS (
  SELECT l_orderkey AS posting_id, p_name AS skill, max(l_quantity) / 50 AS score
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2
)"""


def users(spark: SparkSession, d: str) -> DataFrame:
    """Customers as users: the skills are the parts of all their orders."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, d, "part").select("p_partkey", "p_name")
    return (lines.join(o, lines.l_orderkey == o.o_orderkey)
            .join(parts, lines.l_partkey == parts.p_partkey)
            .groupBy(F.col("o_custkey").alias("user_id"))
            .agg(F.collect_set("p_name").alias("skills")))


USERS = """
user_skills AS (
  SELECT DISTINCT o_custkey AS user_id, p_name AS skill
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
)"""
