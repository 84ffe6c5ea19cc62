"""A rank directory: an ordered result saved once in ranges, so that any row number is reached without another sort."""

from __future__ import annotations

from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlens.session import scratch_path

PART, PLACE = "_part", "_place"
LOW_BITS = 33                # of Spark's increasing id: the place in its partition


class Directory(NamedTuple):
    rows: DataFrame          # the result with the range and the place in it of each row
    starts: dict[int, int]   # rows before each range; one entry a range that has rows
    total: int


def directory(results: DataFrame, order: list) -> Directory:
    """Sort by ranges, save, and count each range; ``order`` must tell all rows apart for numbers that do not vary.

    The result is evaluated for the save alone (and by Spark's sample of the order's keys). The driver sees one
    number for each range, of which there are at most as many as shuffle partitions.
    """
    path = scratch_path(results.sparkSession, "ranks")
    at = F.monotonically_increasing_id()
    placed = (results.orderBy(*order).withColumn("_at", at)
              .withColumns({PART: F.shiftright("_at", LOW_BITS).cast("int"),
                            PLACE: F.col("_at").bitwiseAND(F.lit((1 << LOW_BITS) - 1))}).drop("_at"))
    placed.write.partitionBy(PART).parquet(path)
    columns = [c for c in placed.columns if c != PART] + [PART]
    rows = results.sparkSession.read.schema(placed.select(*columns).schema).parquet(path)
    counts = sorted((r[PART], r["count"]) for r in rows.groupBy(PART).count().collect())
    ends = list(accumulate((n for _, n in counts), initial=0))
    return Directory(rows, {part: before for (part, _), before in zip(counts, ends)}, ends[-1])


def _numbered(rows: DataFrame, starts: dict[int, int], name: str) -> DataFrame:
    lift = rows.sparkSession.createDataFrame(list(starts.items()), f"{PART} int, _before long")
    return rows.join(lift, PART).withColumn(name, F.col("_before") + F.col(PLACE) + 1).drop(PART, PLACE, "_before")


def numbered(found: Directory, name: str = "row_no") -> DataFrame:
    """All rows with their number from 1, without a sort or a window."""
    return _numbered(found.rows, found.starts, name)


def between(found: Directory, first: int, last: int, name: str = "row_no") -> DataFrame:
    """Rows number ``first`` to ``last`` (from 1, both included); only the ranges that hold them are read."""
    parts = sorted(found.starts)
    after = [found.starts[p] for p in parts[1:]] + [found.total]
    held = [p for p, end in zip(parts, after) if found.starts[p] < last and end >= first]
    rows = found.rows.where(F.col(PART).isin(held)) if held else found.rows.where(F.lit(False))
    return _numbered(rows, {p: found.starts[p] for p in held}, name).where(F.col(name).between(first, last))
