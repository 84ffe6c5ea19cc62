"""URL filter: a blocked Bloom filter passes possible hits to an exact hash join. DataFrame functions only.

Rules (host, path) and listed URLs are both entries of one filter. A URL asks for its own canonical
form and for every (parent host, start of path) that a rule could have; only candidates whose bits
are all set reach the join with the entries themselves, which removes the false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laborlens.llm.common import lower_ascii

ROWS_PER_BLOCK = 16      # entries of a 256-bit block: about 0.1 % false positives
LANES = 4
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#'; '' for NULL or without '://'."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")))


def url_path(url: Column) -> Column:
    """After the host up to '?' or '#'; '' for NULL or without '://'."""
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def _bit(lane: int) -> str:
    """SQL of the one bit that ``key`` sets in a lane; its hash differs from the one that picks the block."""
    return f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(key, 1), {6 * lane}) & 63 as int))"


def bloom_filter(entries: DataFrame, blocks: int) -> DataFrame:
    """block, lane0..lane3 of the entries' keys. A row for each block in use, never larger than the list."""
    return (entries.select("key").distinct().withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
            .groupBy("block").agg(*[F.bit_or(F.expr(_bit(i))).alias(f"lane{i}") for i in range(LANES)]))


def url_filter(pages: DataFrame, rules: DataFrame, listed: DataFrame, url: str = "url") -> DataFrame:
    """Each row of ``pages`` with host, path, rule and verdict (clashing columns are replaced).

    rules: host, path, verdict ('allow' or 'block'); a rule fits its host and subdomains if the path
    starts with the rule's; the longest host + path wins, then the longer host. listed: url; a URL
    whose canonical form (host + path) is listed is blocked unless a rule decides. All else is allowed.
    NULL URLs or those without '://' have empty host and path and are allowed. Repeated rows each get
    the verdict; empty tables give empty results or 'allow'. Rules or listed URLs that are NULL count as none.
    """
    ours = pages.drop("host", "path", "rule", "verdict") \
        .withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    wanted = rules.where("host is not null and path is not null and verdict is not null").select(
        F.concat(F.lit("rule "), "host", F.lit(" "), "path").alias("key"), F.concat("host", "path").alias("rule"),
        F.col("verdict").alias("rule_verdict"), F.length("host").alias("host_length"),
        F.length("path").alias("path_length"))
    known = listed.select(url_host(F.col("url")).alias("h"), url_path(F.col("url")).alias("p")).where("h <> ''").select(
        F.concat(F.lit("url "), "h", "p").alias("key")).distinct().select(
        "key", F.lit(None).cast("string").alias("rule"), F.lit("block").alias("rule_verdict"),
        F.lit(0).alias("host_length"), F.lit(0).alias("path_length"))
    entries = wanted.unionByName(known)
    shape = entries.agg(F.count("*").alias("n"), F.array_sort(F.collect_set(
        F.when(F.col("rule").isNotNull(), F.col("path_length")))).alias("cuts")).first()   # cuts: path lengths of rules
    blocks = max(1, -(-shape["n"] // ROWS_PER_BLOCK))
    filter_ = bloom_filter(entries, blocks)

    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)),
                          lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in shape["cuts"]]),
                      lambda s: s.isNotNull()) if shape["cuts"] else F.array().cast("array<string>")
    asked = F.concat(F.array(F.concat(F.lit("url "), "host", "path")), F.flatten(F.transform(
        parents, lambda h: F.transform(starts, lambda s: F.concat(F.lit("rule "), h, F.lit(" "), s)))))
    possible = (ours.where("host <> ''").select("host", "path").distinct()
                .select("host", "path", F.explode(asked).alias("key"))
                .withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
                .join(filter_, "block")
                .where(" and ".join(f"(lane{i} & {_bit(i)}) <> 0" for i in range(LANES)))
                .select("host", "path", "key"))
    verdicts = (possible.join(entries, "key").groupBy("host", "path").agg(F.max(F.struct(
        (F.col("host_length") + F.col("path_length")).alias("length"), "host_length", "rule", "rule_verdict")).alias("best")))
    return (ours.join(verdicts, ["host", "path"], "left")
            .withColumns({"rule": F.col("best.rule"), "verdict": F.coalesce("best.rule_verdict", F.lit("allow"))})
            .drop("best"))
