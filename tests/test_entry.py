"""Every registered query against its SQL in another engine."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.compare import duck_rows, spark_rows

ORACLES = entry.oracle_sql()


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, sf_dir, name):
    columns, got = spark_rows(entry.queries()[name](spark, sf_dir))
    assert got
    if name in ORACLES:
        assert (columns, got) == duck_rows(sf_dir, ORACLES[name])
