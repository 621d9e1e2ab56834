"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from ratingspark.workload.check import connect, difference

SLOW = {"tune_study", "study_resume", "ablation_table", "eval_variants"}  # covered by their parts and by ablation_study
NAMES = sorted(set(entry.queries()) - SLOW)


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, duck, name):
    ours = entry.queries()[name](spark, sf).toPandas()
    assert len(ours) > 0
    sql = entry.oracle_sql().get(name)
    if sql is not None:
        assert difference(ours, duck.execute(sql).df()) is None


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 5
