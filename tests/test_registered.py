"""Every registered query against its DuckDB twin on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from paragauge.catalog.oracle import ORACLE  # noqa: E402
from paragauge.catalog.queries import QUERIES  # noqa: E402
from tests.compare import check, duck  # noqa: E402

@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf_dir, name):
    good, note = check(spark, con, entry.queries()[name], entry.oracle_sql().get(name), sf_dir)
    assert good, note


def test_entry(spark):
    assert entry.entry(spark).columns == ["model", "accuracy", "meteor", "bleu_1", "rouge_l"]
