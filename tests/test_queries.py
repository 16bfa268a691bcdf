"""Every registered query against its SQL over the whole tables."""

import pytest

import __spark_entry__ as entry
from workload.check import compare

QUERIES, SQL = entry.queries(), entry.oracle_sql()
# Fits of hundreds of trees take minutes: test_training.py covers training with small models, and
# `workload/check.py` compares these queries too.
LONG = {"k7_random_forest", "k8_extra_trees", "k9_gradient_boosting", "k10_histogram_boosting",
        "k14_cross_validation", "k15_train_models", "k18_adaptive_model", "i10_score_customers_adaptive"}
RELATIONAL = [name for name in QUERIES if name in SQL and name not in LONG]


@pytest.mark.parametrize("name", RELATIONAL)
def test_query_equals_sql(spark, duck, sf, name):
    ok, rows, message, _ = compare(spark, duck, sf, QUERIES[name], SQL[name])
    assert ok, message
    assert rows > 0 or name.startswith(("d", "r3", "e5"))


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 3


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
