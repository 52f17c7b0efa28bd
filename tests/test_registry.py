"""Every registered query against its SQL counterpart on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
import check  # noqa: E402

from slicegrad.registry import jobs  # noqa: E402


@pytest.fixture(scope="module")
def connection(sf_dir):
    return check.connect(sf_dir)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    without = set(jobs.all_queries()) - set(entry.oracle_sql())
    assert all(name.startswith("baseline_") for name in without)


def test_entry(spark):
    assert entry.entry(spark).columns == ["feature", "k", "w"]


@pytest.mark.parametrize("name", sorted(jobs.all_queries()))
def test_query(spark, connection, sf_dir, name):
    good, note = check.compare(spark, connection, sf_dir, name)
    assert good, note
