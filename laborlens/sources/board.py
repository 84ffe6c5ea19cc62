"""HTML job board: search pages to cards, detail pages to descriptions.

The element tree needs Python, so the two parsers run as ``mapInArrow`` over slices of
Arrow batches; links alone are extracted JVM-side by pattern.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from laborlens import vocab
from laborlens.functions import detect, labels, money
from laborlens.functions.text import truncate
from laborlens.schema import ARRIVING, CARD, DETAIL, conform
from laborlens.session import slices
from laborlens.sources.markup import parse

LINK_PART = "/jobs/p/"
_SALARY_HINT = re.compile("EGP|salary|راتب", re.I)


def page_links(pages: DataFrame, html: str = "html", link_part: str = "") -> DataFrame:
    """One row per link of a page, in order, by pattern."""
    links = F.regexp_extract_all(F.col(html), F.lit(r'href="([^"]+)"'), F.lit(1))
    out = pages.select("page_id", F.posexplode(links).alias("link_no", "href"))
    return out.where(F.col("href").contains(link_part)) if link_part else out


def absolute_url(href: Column, base: str = vocab.BOARD_BASE_URL) -> Column:
    return F.when(href.startswith("/"), F.concat(F.lit(base), href)).otherwise(href)


def _cards(root, link_part):
    """Card elements of a search page, by the first rule that finds any."""
    rules = (
        lambda n: n.tag == "div" and n.has_class("css-") and "data-jobid" in n.attrs,
        lambda n: n.tag == "article" and "data-jobid" in n.attrs,
        lambda n: "job-card-component" in n.attrs.get("class", "").split(),
    )
    for rule in rules:
        found = root.all(rule)
        if found:
            return found
    parents = [a.ancestor("div", "article") for a in root.all(lambda n: _is_link(n, link_part))]
    return list({id(p): p for p in parents if p is not None}.values())


def _is_link(node, part):
    return node.tag == "a" and part in node.attrs.get("href", "")


def _either(card, *tests):
    return next((hit for test in tests if (hit := card.first(test)) is not None), None)


def _card_rows(html, link_part, base):
    for card in _cards(parse(html), link_part):
        link = card.first(lambda n: _is_link(n, link_part))
        if link is None:
            continue
        company = _either(card, lambda n: _is_link(n, "/company/"), lambda n: n.has_class("company"))
        place = _either(card, lambda n: n.has_class("location"), lambda n: n.has_class("city"))
        tags = card.all(lambda n: any(n.has_class(c) for c in ("tag", "type", "label")))
        href = link.attrs["href"]
        yield (link.text(),
               vocab.UNKNOWN_COMPANY if company is None else company.text(),
               vocab.BOARD_COUNTRY if place is None else place.text(),
               " ".join(t.text() for t in tags),
               base + href if href.startswith("/") else href)


def search_cards(pages: DataFrame, link_part: str = LINK_PART,
                 base: str = vocab.BOARD_BASE_URL) -> DataFrame:
    """Search result pages (page_id, html) to one row per card."""
    def run(batches):
        for batch in slices(batches, "html"):
            rows = [(pid, no, *card)
                    for pid, html in zip(*(c.to_pylist() for c in batch.columns))
                    for no, card in enumerate(_card_rows(html, link_part, base))]
            yield _table(rows, CARD)
    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, CARD)


def _table(rows, schema):
    """Rows as one Arrow batch of a Spark schema."""
    return pa.RecordBatch.from_pylist([dict(zip(schema.names, row)) for row in rows], to_arrow_schema(schema))


def _detail_row(html, fallbacks):
    root = parse(html)
    tests = [lambda n: n.has_class("description"), lambda n: n.has_class("details")]
    tests += [lambda n, tag=tag: n.tag == tag for tag in fallbacks]
    block = _either(root, *tests)
    hint = next((p for p in root.pieces() if _SALARY_HINT.search(p)), None)
    return ("" if block is None else block.text(" "), hint)


def page_details(pages: DataFrame, fallbacks=("section",), chars: int | None = None) -> DataFrame:
    """Detail pages (page_id, html) to description (whole unless ``chars``), salary_min and salary_max."""
    def run(batches):
        for batch in slices(batches, "html"):
            rows = [(pid, *_detail_row(html, fallbacks))
                    for pid, html in zip(*(c.to_pylist() for c in batch.columns))]
            yield _table(rows, DETAIL)
    found = pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, DETAIL)
    pay = money.parse_salary(F.col("salary_text"))
    return found.select("page_id",
                        truncate(F.col("description"), chars).alias("description"),
                        pay["salary_min"].alias("salary_min"), pay["salary_max"].alias("salary_max"))


def board_postings(cards: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """Cards with their details (keyed by ``url``) to arriving postings."""
    if details is None:
        joined = (cards.withColumn("description", F.lit(None).cast("string"))
                  .withColumn("salary_min", F.lit(None).cast("double"))
                  .withColumn("salary_max", F.lit(None).cast("double")))
    else:
        joined = cards.join(details, "url", "left")
    text = F.concat_ws(" ", "tags", F.coalesce("description", F.lit("")))
    out = joined.select(
        labels.source_id(vocab.BOARD_SITE, F.col("url"), F.col("title"), F.col("company"))
        .alias("source_id"),
        "title", "company", "location",
        F.lit(vocab.BOARD_COUNTRY).alias("country"),
        detect.board_work_mode(text).alias("job_type"),
        detect.board_contract(text).alias("contract_type"),
        "salary_min", "salary_max",
        F.coalesce("description", "tags").alias("description"),
        F.lit(vocab.BOARD_SITE).alias("source"),
        F.col("url").alias("source_url"),
    )
    return conform(out, ARRIVING)
