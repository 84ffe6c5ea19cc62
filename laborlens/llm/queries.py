"""The registered queries opN_<name> over whole tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laborlens.llm import (bpe, decontaminate, huffman, maxent, rotated, simhash, spelling, suffix, topk, toxicity, url_filter,
                           warc, whitening)
from laborlens.llm.common import Scratch, table

#: The rules of the URL query: host, path, verdict.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]
END_ID = 2


def severity_grades(labels: DataFrame) -> DataFrame:
    """doc_id, grade: 0 not toxic, 1 toxic, 2 toxic and of low quality."""
    return labels.select("doc_id", (F.col("toxic") + F.col("toxic") * (1 - F.col("quality"))).alias("grade"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, severity_grades(table(spark, sf_dir, "labels")))
    return toxicity.severity(docs.select("doc_id", "text"), model).drop("text")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(table(spark, sf_dir, "documents"))


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.report(suffix.remove_repeats(table(spark, sf_dir, "documents")))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
           where embedding is not null and len(embedding) > 0
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
           from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
select query_id, cast(rank as integer) as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored) where rank <= 5
"""


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def listed_urls(pages: DataFrame) -> DataFrame:
    """The list of the query: the URLs of hosts whose first label says spam."""
    return pages.where(url_filter.url_host(F.col("url")).startswith("spam")).select("url").distinct()


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.url_filter(pages, rules, listed_urls(pages)).select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = r"""
with u as (select page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                  coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') as path from pages),
rules(h, p, v) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                          ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
listed as (select distinct host || path as url from u where host like 'spam%'),
best as (select page_id, arg_max(h || p, length(h || p)) as rule, arg_max(v, length(h || p)) as v
         from u join rules on (host = h or host like '%.' || h) and starts_with(path, p) group by page_id)
select u.page_id, host, path, rule, coalesce(v, case when listed.url is not null then 'block' else 'allow' end) as verdict
from u left join best using (page_id) left join listed on listed.url = host || path
"""


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.encode(docs, path), path)


def op9_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.id_file_report(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_ID)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "warc").path("archives")
    warc.write_archives(table(spark, sf_dir, "pages"), path, record="html")
    return warc.resolve_archives(warc.read_archives(spark, path).drop("url", "payload")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as h from pages),
d as (select *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + cast((('0x' || substr(h, 1 + 5 * (i // 4), 5))::bigint // (1 << (5 * (3 - i % 4)))) % 32 as bigint), 1)), '')
        as payload_digest, min(page_id) over (partition by h) as original from p)
select page_id, payload_bytes, payload_digest, case when page_id = original then 'response' else 'revisit' end as record_type,
       case when page_id <> original then original end as refers_to from d
"""


def op11_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotated.near_vectors(table(spark, sf_dir, "embeddings"))


OP11_SQL = """
with recursive v as (
  select vec_id, label, embedding::double[] as v from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
          where list_cosine_similarity(a.v, b.v) >= 0.93),
reach(a, b) as (select vec_id, vec_id from embeddings union select r.a, links.b from reach r join links on r.b = links.a),
component as (select a as vec_id, min(b) as component_id from reach group by a)
select vec_id, count(links.b) as n_links, any_value(component_id) as component_id, vec_id = any_value(component_id) as kept
from component left join links on links.a = vec_id group by vec_id
"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents")))


OP12_SQL = """
with recursive codes as (
  select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k:
              case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t from range(256) r(i)),
runs as (select doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as times
         from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as run from documents)
         where length(run) >= 7 group by all),
raw as (select *, hex(encode(doc_id || ':' || run)) as x from runs),
hashed as (select run, times, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(len(x) // 2),
             lambda i: ('0x' || substr(x, cast(2 * i + 1 as int), 2))::bigint)),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::bigint) as h from raw, codes),
cut as (select case when h % 31 = 0 then substr(run, 1, cast(h % length(run) as int)) || substr(run, cast(h % length(run) as int) + 2)
               else run end as word, times from hashed),
words as (select word, cast(sum(times) as bigint) as n from cut where length(word) >= 7 group by word having sum(times) >= 2),
less as (select word, unnest(list_transform(range(length(word) + 1), lambda i: {'at': i, 'rest': case when i = 0 then word
           else substr(word, 1, cast(i - 1 as int)) || substr(word, cast(i + 1 as int)) end}), recursive := true) from words),
near as (select distinct a.word, b.word as other from less a join less b on a.rest = b.rest and a.word <> b.word
         where a.at = b.at or a.at = 0 or b.at = 0),
best as (select near.word, count(*) as n_near, arg_min(other, (-n, other)) as other, max(n) as other_n
         from near join words on words.word = other group by near.word),
formed as (select w.word, n, coalesce(n_near, 0) as n_near, case when other_n >= 10 * n then other end as form,
                  case when other_n >= 10 * n then other_n end as form_n from words w left join best using (word)),
follow(word, root) as (select word, word from formed
                       union all select f.word, g.form from follow f join formed g on g.word = f.root where g.form is not null),
ends as (select follow.word, root from follow join formed on formed.word = root where form is null)
select word, form, root, n, n_near, form_n from formed join ends using (word)
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracles() -> dict[str, str]:
    return {"op5_top_k": OP5_SQL, "op7_url_filter": OP7_SQL, "op10_warc": OP10_SQL,
            "op11_rotated_codes": OP11_SQL, "op12_spelling_variants": OP12_SQL}
