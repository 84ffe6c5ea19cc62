"""Posting search, pagination and salary order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlens.functions import money
from laborlens.operators import ranks
from laborlens.operators.filters import fresh, matches_query, request_filter

PER_PAGE = 21


def newest_first():
    return [F.coalesce("posted_at", "scraped_at").desc(), F.col("posting_id").asc()]


def search_postings(postings: DataFrame, query: str | None = None, as_of=None,
                    limit: int | None = None, raw_pattern: bool = False, **filters) -> DataFrame:
    """Fresh postings (with their company name) under the request filters, newest first; all or ``limit``."""
    found = (fresh(postings, as_of)
            .where(request_filter(**filters))
            .where(matches_query(query, raw_pattern=raw_pattern))
            .orderBy(*newest_first()))
    return found if limit is None else found.limit(limit)


def page_directory(results: DataFrame) -> ranks.Directory:
    """Any number of pages, newest first, from one evaluation of the result."""
    return ranks.directory(results, newest_first())


def clamp_page(rows: int, page: int, per_page: int = PER_PAGE) -> tuple[int, int]:
    """The asked page moved into 1..pages, and the number of pages (1 at least)."""
    pages = max(1, -(-rows // per_page))
    return min(max(1, page), pages), pages


def page_rows(found: ranks.Directory, page: int, per_page: int = PER_PAGE) -> DataFrame:
    """The nearest page's rows in order, with their numbers; reads the ranges that hold them."""
    page = clamp_page(found.total, page, per_page)[0]
    return ranks.between(found, (page - 1) * per_page + 1, page * per_page).orderBy("row_no")


def offset_page(results: DataFrame | ranks.Directory, page: int, per_page: int = PER_PAGE) -> DataFrame:
    """One page of a result or its directory; a page before the first or past the last is the nearest."""
    found = results if isinstance(results, ranks.Directory) else page_directory(results)
    return page_rows(found, page, per_page).drop("row_no")


def page_of(results: DataFrame | ranks.Directory, page: int, per_page: int = PER_PAGE) -> DataFrame:
    """The asked page, moved into 1..total_pages, with row numbers, totals and the pages shown around it.

    Numbers and totals come from the directory, which is made once for as many pages as are asked for.
    """
    found = results if isinstance(results, ranks.Directory) else page_directory(results)
    page, pages = clamp_page(found.total, page, per_page)
    return (page_rows(found, page, per_page)
            .withColumns({"page": F.lit(page), "total_rows": F.lit(found.total).cast("long"), "total_pages": F.lit(pages),
                          "page_range": F.sequence(F.lit(max(1, page - 2)), F.lit(min(pages, page + 2)))}))


def salary_order(order: str = "salary_high") -> list:
    """By predicted, else real salary; rows without either come last."""
    if order == "salary_high":
        key = money.high_sort_key(F.col("predicted_max"), F.col("salary_max")).desc()
    else:
        key = money.low_sort_key(F.col("predicted_min"), F.col("salary_min")).asc()
    return [key, *newest_first()]


def salary_sort(results: DataFrame, order: str = "salary_high") -> DataFrame:
    return results.orderBy(*salary_order(order))


def salary_sorted_page(results: DataFrame, page: int, order: str = "salary_high",
                       scope: str = "page", per_page: int = PER_PAGE) -> DataFrame:
    """A page in salary order: within the page only, or over the whole result."""
    if scope == "page":
        return salary_sort(page_of(results, page, per_page), order)
    return offset_page(ranks.directory(results, salary_order(order)), page, per_page)
