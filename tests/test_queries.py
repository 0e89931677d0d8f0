"""Every registered query against its SQL at the smallest scale."""

import pytest
from check import compare

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, name):
    verdict = compare(spark, SF, name, queries()[name], oracle_sql().get(name))
    assert verdict.startswith(("ok", "rows-only")), verdict


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


def test_checks_belong_to_queries():
    assert set(oracle_sql()) <= set(queries())
