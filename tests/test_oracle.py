"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import importlib.util
import os

import pytest

from tests.oracle import connect, differences
from wrenchlake.querybook.book import all_queries

QUERIES = {q.name: q for q in all_queries()}


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql is not None])
def test_matches_sql(name, spark, con, small):
    q = QUERIES[name]
    assert differences(q.run(spark, small), con, q.sql) is None


def test_names_are_unique():
    assert len(QUERIES) == len(all_queries())


def test_entry_points(spark):
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
    spec = importlib.util.spec_from_file_location("spark_entry", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert module.entry(spark).count() > 0
    assert set(module.oracle_sql()) <= set(module.queries())
