import pytest
from conftest import DATA, same_rows
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from vigil.plans.oracle import with_history, with_incoming
from vigil.sources.incidents import HISTORY, INCOMING, ensure_columns, history, incoming, scan_incidents


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_incident_ids_are_unique(spark, sf):
    ids = history(spark, f"{DATA}/{sf}", ["incident_id"])
    assert ids.count() == ids.distinct().count() == spark.read.parquet(f"{DATA}/{sf}/lineitem.parquet").count()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_joins_neither_lose_nor_repeat_rows(spark, sf):
    assert history(spark, f"{DATA}/{sf}").count() == history(spark, f"{DATA}/{sf}", ["incident_id"]).count()


def test_a_view_joins_only_what_it_needs(spark):
    plan = history(spark, f"{DATA}/sf0.001", ["crime_type", "estimated_loss"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "o_orderkey" not in plan


def test_history_columns(spark, duck):
    texts = [c for c in HISTORY if c not in ("latitude", "longitude")]
    df = history(spark, f"{DATA}/sf0.001", texts).withColumns({"occurred_date": F.col("occurred_date").cast("string"), "investigation_hours": F.col("investigation_hours")})
    sql = ", ".join(f"{c}::varchar as {c}" if c == "occurred_date" else c for c in texts)
    same_rows(df, duck.sql(with_history(f"select {sql} from inc")))


def test_incoming_columns(spark, duck):
    df = incoming(spark, f"{DATA}/sf0.001").withColumn("submitted_at", F.date_format("submitted_at", "yyyy-MM-dd HH:mm:ss"))
    sql = ", ".join("strftime(submitted_at, '%Y-%m-%d %H:%M:%S') as submitted_at" if c == "submitted_at" else c for c in INCOMING)
    same_rows(df, duck.sql(with_incoming(f"select {sql} from raw")))


def test_scan_takes_the_first_path_with_rows(spark, tmp_path):
    schema = StructType().add("incident_id", StringType()).add("district", StringType())
    (tmp_path / "empty.csv").write_text("incident_id,district\n")
    (tmp_path / "full.csv").write_text("incident_id,district\nINC-1,North\nINC-2,\n")
    paths = [str(tmp_path / x) for x in ("missing.csv", "empty.csv", "full.csv")]
    assert [tuple(r) for r in scan_incidents(spark, paths, schema).collect()] == [("INC-1", "North"), ("INC-2", None)]
    with pytest.raises(FileNotFoundError):
        scan_incidents(spark, paths[:2], schema)


def test_ensure_columns(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert ensure_columns(df, {"a": F.lit(9), "b": F.lit("x")}).collect()[0].asDict() == {"a": 1, "b": "x"}
    with pytest.raises(ValueError):
        ensure_columns(df, {}, ["c"])
