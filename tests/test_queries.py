import re

import pytest
from conftest import DATA, same_rows

from vigil import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()
FAST = sorted(set(ORACLES) - {"gaussian_nb", "evaluate_classifier", "knn_classify"})


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 25
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", FAST)
def test_against_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, f"{DATA}/sf0.001"), duck.sql(ORACLES[name]))


@pytest.mark.parametrize("name", [
    "historical_baseline", "historical_hotspots", "pattern_risk", "outcome_grid", "value_shares", "entry_defaults", "threat_growth", "validate_incidents", "process_incidents",
])
def test_plans_have_no_product_of_data(spark, name):
    """Nested-loop joins only against a broadcast of one row or a fixed list, and incident rows never in one partition."""
    plan = QUERIES[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    for line in re.findall(r".*Exchange SinglePartition.*\n.*", plan):
        assert re.search("Aggregate|Project|Sort|Window|HashAggregate|LocalLimit|Exchange", line.split("\n")[1]), line
        assert "FileScan" not in line.split("\n")[1]


def test_the_forest_scores_every_incident(spark):
    out = QUERIES["score_isolation_forest"](spark, f"{DATA}/sf0.001").persist()
    lines = spark.read.parquet(f"{DATA}/sf0.001/lineitem.parquet").count()
    assert out.count() == lines == out.select("incident_id").distinct().count()
    assert out.filter("is_anomaly is null or anomaly_score is null").count() == 0
    assert 0.04 < out.filter("is_anomaly").count() / lines < 0.06
    out.unpersist()
