"""Row numbers and pages from the directory against plain sorting."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from laborlens.operators import ranks, search

RNG = random.Random(3)
DAY = datetime.datetime(2024, 1, 1)


def rows_of(n):
    """Ties in every key but the id, NULL dates, one date on a third of all rows."""
    def date():
        return RNG.choice([None, DAY, DAY + datetime.timedelta(days=RNG.randint(0, 40))])
    return [(i, date(), date()) for i in RNG.sample(range(10 * n + 1), n)]


def newest(rows):
    def key(r):
        at = r[1] or r[2]
        return (at is None, -(at or DAY).timestamp(), r[0])
    return sorted(rows, key=key)


@pytest.fixture
def frame(spark):
    def make(rows):
        return spark.createDataFrame(rows, "posting_id long, posted_at timestamp, scraped_at timestamp").repartition(7)
    return make


@pytest.mark.parametrize("n", [0, 1, 20, 400])
def test_numbers_equal_sorting(frame, n):
    rows = rows_of(n)
    want = {r[0]: i for i, r in enumerate(newest(rows), 1)}
    found = search.page_directory(frame(rows))
    assert found.total == n
    assert {r.posting_id: r.row_no for r in ranks.numbered(found).collect()} == want
    for first, last in ((1, 1), (5, 30), (1, n), (n, n + 9), (n + 1, n + 5), (0, 0)):
        got = {r.posting_id: r.row_no for r in ranks.between(found, first, last).collect()}
        assert got == {k: v for k, v in want.items() if first <= v <= last}


def test_pages_from_one_directory(frame):
    rows = rows_of(150)
    want = [r[0] for r in newest(rows)]
    found = search.page_directory(frame(rows))
    for asked, page in ((-3, 1), (1, 1), (2, 2), (8, 8), (99, 8)):
        got = [r.posting_id for r in search.page_of(found, asked).collect()]
        assert got == want[(page - 1) * 21:page * 21] == [r.posting_id for r in search.offset_page(found, asked).collect()]


def test_a_page_reads_its_ranges_only(spark, frame):
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = search.page_directory(frame(rows_of(400)))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    assert len(found.starts) > 1
    page = search.page_rows(found, 1)
    files = page.select(F.input_file_name().alias("f")).distinct().count()
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert files == 1 and "PartitionFilters: [isnotnull(_part" in plan or "PartitionFilters: [_part" in plan
    assert "Window" not in plan and "Window" not in ranks.numbered(found)._jdf.queryExecution().executedPlan().toString()
