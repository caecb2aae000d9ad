"""Every registered job against its SQL in DuckDB, on the smallest data set."""

import pytest

import __spark_entry__ as entry
from tools.check_oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
JOBS, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(JOBS))
def test_job_matches_sql(spark, db, name):
    problem, _ = compare(spark, db, FOLDER, name, JOBS[name], ORACLE.get(name))
    assert not problem, problem


def test_every_oracle_has_a_job():
    assert set(ORACLE) <= set(JOBS)


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns[:2] == ["competitor_id", "competitor_name"] and frame.count() > 0
