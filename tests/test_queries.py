"""Every registered query against its SQL, and what its plan may not contain."""

import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries
from workload import ORACLE, QUERIES

NAMES = list(QUERIES)
SQL = ORACLE
# Queries that fit several models are covered by test_training.
SLOW = {
    "train_per_site",
    "cross_site_validate_models",
    "ensemble_test_models",
    "score_new_records",
    "score_new_records_stream",
    "model_persist",
    "cross_validate",
    "train_logistic_regression",
    "train_decision_tree",
    "train_gbt",
    "train_random_forest",
    "train_linear_svm",
    "train_naive_bayes",
}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return check.connect(sf_dir)


@pytest.mark.parametrize("name", [n for n in NAMES if n not in SLOW])
def test_query(spark, duck, sf_dir, name):
    df = queries()[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for forbidden in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert forbidden not in plan
    if name in SQL:
        assert check.compare(df, duck.sql(SQL[name])) is None
    else:
        assert df.count() > 0


def test_every_query_has_sql():
    assert set(NAMES) == set(SQL)


def test_all_are_registered():
    assert set(NAMES) <= set(queries()) and set(SQL) <= set(oracle_sql())


def test_entry(spark):
    df = entry(spark)
    assert df.columns[0] == "pid"
    assert df.count() > 0
