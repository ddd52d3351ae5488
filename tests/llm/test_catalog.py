"""Registered queries that SQL can express, against their twins; the others have tests of their own."""

import pytest

import __spark_entry__ as entry
from paragauge.llm import catalog
from tests.compare import check, duck


@pytest.mark.parametrize("name", list(catalog.ORACLE))
def test_query(spark, sf_dir, name):
    good, note = check(spark, duck(sf_dir), catalog.QUERIES[name], catalog.ORACLE[name], sf_dir)
    assert good, note


def test_all_are_registered():
    names = [next(q for q in entry.queries() if q.startswith(f"op{n}_")) for n in range(1, 11)]
    assert set(names) == set(catalog.QUERIES) and "pipeline" in entry.queries()
    assert set(catalog.ORACLE) <= set(entry.oracle_sql())
