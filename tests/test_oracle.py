"""Every operator against its SQL oracle."""

from __future__ import annotations

import pytest

import __spark_entry__ as driver
from tests.compare import connect, oracle_rows, spark_rows
from wakeline.plans import inventory, oracle

# The training-data queries have tests of their own.
QUERIES, ORACLE = inventory.queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def con(data_folder):
    return connect(data_folder)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


def test_driver_offers_every_query():
    assert set(QUERIES) <= set(driver.queries())
    assert set(ORACLE) <= set(driver.oracle_sql())


def test_every_inventory_id_is_covered():
    ids = (
        [f"P{n}" for n in range(1, 7)]
        + [f"T{n}" for n in range(1, 8)]
        + [f"R{n}" for n in range(1, 9)]
        + [f"S{n}" for n in range(1, 4)]
        + [f"W{n}" for n in range(1, 5)]
        + [f"L{n}" for n in range(1, 5)]
        + [f"A{n}" for n in range(1, 3)]
        + [f"C{n}" for n in range(1, 6)]
        + [f"N{n}" for n in range(1, 5)]
        + [f"U{n}" for n in range(1, 4)]
        + [f"F{n}" for n in range(1, 6)]
        + [f"D{n}" for n in range(1, 9)]
    )
    assert {name.split("_")[0] for name in QUERIES} == set(ids)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, con, data_folder, name):
    columns, rows = spark_rows(QUERIES[name](spark, data_folder))
    expected_columns, expected = oracle_rows(con, ORACLE[name])
    assert columns == expected_columns
    assert len(rows) == len(expected)
    assert rows == expected
    assert rows


def test_entry_runs(spark):
    assert driver.entry(spark).limit(1).collect()
