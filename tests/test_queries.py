"""Every query against its SQL; the others by what must hold of them."""

import pytest
from compare import connect, spark_rows, sql_rows

from tidemark.plans import queries as Q


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    assert spark_rows(Q.QUERIES[name](spark, sf_dir)) == sql_rows(duck, Q.ORACLE_SQL[name])


def test_entry_gives_policies(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert {r.policy for r in rows} <= {"limit", "label", "none"} and sum(r.n for r in rows) == 87


def test_queries_without_sql_run(spark, sf_dir):
    for name in sorted(set(Q.QUERIES) - set(Q.ORACLE_SQL) - {"cv_logreg_auc", "rbf_machine_nested", "one_class_machine"}):
        assert Q.QUERIES[name](spark, sf_dir).count() > 0, name


def test_cross_validation_tells_classes_apart(spark, sf_dir):
    row = Q.QUERIES["cv_logreg_auc"](spark, sf_dir).first()
    assert row.auc_mean > 0.95 and row.acc_mean > 0.85


def test_machines_on_random_features(spark, sf_dir):
    row = Q.QUERIES["rbf_machine_nested"](spark, sf_dir).first()
    assert row.rows == 500 and row.auc > 0.95 and row.acc > 0.85 and row.ece < 0.15
    row = Q.QUERIES["one_class_machine"](spark, sf_dir).first()
    assert row.auc > 0.95 and abs(row.beyond - 0.1) < 0.01 and row.acc >= 0.7
