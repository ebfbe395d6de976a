"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry
from checks.compare import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    verdict, _, _ = compare(spark, duck, SF, name, QUERIES[name], ORACLE.get(name))
    assert verdict in ("ok", "rows only")


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_coverage_of_plans_that_the_plan_table_lacks(spark, tmp_path):
    """Half of the plans are unknown, so shares lie between 0 and 100; they have the places of the SQL."""
    for table in Path(SF).glob("*.parquet"):
        if table.stem != "supplier":
            (tmp_path / table.name).symlink_to(table)
    con = connect(SF)
    con.execute(f"COPY (SELECT * FROM supplier WHERE s_suppkey % 2 = 0) TO '{tmp_path}/supplier.parquet' (FORMAT parquet)")
    name = "savings_plan_coverage"
    verdict, _, _ = compare(spark, connect(str(tmp_path)), str(tmp_path), name, QUERIES[name], ORACLE[name])
    assert verdict == "ok"
