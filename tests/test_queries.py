"""Every registered query against its SQL at the smallest scale."""

import pytest
from compare import compare, duck

import __spark_entry__ as entry

SLOW = {"salary_eval", "salary_predict", "clusters", "cluster_projection"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 80


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, con, sf_dir, name):
    difference = compare(entry.queries()[name](spark, sf_dir), con, entry.oracle_sql()[name])
    # the smallest scale has few fresh postings, so a filtered result may be empty on both sides
    assert difference in (None, "no rows to compare")


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - SLOW))
def test_has_rows(spark, sf_dir, name):
    assert entry.queries()[name](spark, sf_dir).limit(1).count() == 1


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
