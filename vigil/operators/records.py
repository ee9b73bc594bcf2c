"""Incident, assessment and alert tables: building, listing, checking, storing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.expr import stable_id
from vigil.sources.store import store

ISO = "yyyy-MM-dd'T'HH:mm:ss"


def assessments(scored: DataFrame) -> DataFrame:
    """The assessment record of scored incidents; the reasons become JSON text."""
    return scored.select(
        stable_id("RISK", F.col("incident_id")).alias("assessment_id"), "incident_id",
        F.col("historical_risk"), "dynamic_risk", "risk_level", F.to_json("reasons").alias("reasons"),
        F.coalesce("is_anomaly", F.lit(False)).alias("anomaly_flag"), "anomaly_score", F.col("submitted_at").alias("created_at"),
    )


def decode_reasons(x: Column) -> Column:
    """A JSON list of texts as an array; other text is its only element, null and empty give an empty array."""
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(x, F.lit("")) == "", none).otherwise(F.coalesce(F.from_json(x, "array<string>"), F.array(x)))


def newest(df: DataFrame, time: str, n: int, **equal: str | None) -> DataFrame:
    """The ``n`` newest rows, equal times by id, among those that match."""
    for column, value in equal.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    key = [c for c in ("incident_id", "assessment_id", "alert_id") if c in df.columns][0]
    return df.orderBy(F.col(time).desc(), key).limit(n)


def with_assessments(incidents: DataFrame, assessed: DataFrame) -> DataFrame:
    """Each incident with all its assessments, oldest first, as an array."""
    nested = assessed.groupBy("incident_id").agg(
        F.sort_array(F.collect_list(F.struct("created_at", "assessment_id", "dynamic_risk", "risk_level"))).alias("assessments")
    ).withColumnRenamed("incident_id", "_id")
    return incidents.join(nested, F.col("incident_id") == F.col("_id"), "left").drop("_id")


def recent(df: DataFrame, as_of: Column, days: int = 7, date: str = "occurred_date") -> DataFrame:
    """Rows of the last ``days`` days; rows without a valid date are not recent."""
    return df.filter(F.col(date) >= F.date_sub(as_of, days))


def public_record(df: DataFrame) -> DataFrame:
    """Times as ISO text, the rest as it is."""
    times = [c for c, kind in df.dtypes if kind.startswith("timestamp")]
    return df.withColumns({c: F.date_format(c, ISO) for c in times}) if times else df


def mark_processed(incidents: DataFrame, assessed: DataFrame) -> DataFrame:
    """Received incidents that have an assessment become Processed."""
    done = assessed.select(F.col("incident_id").alias("_id"), F.lit(True).alias("_done")).distinct()
    out = incidents.join(done, F.col("incident_id") == F.col("_id"), "left")
    status = F.when(F.coalesce("_done", F.lit(False)) & (F.col("status") == "Received"), "Processed").otherwise(F.col("status"))
    return out.withColumn("status", status).drop("_id", "_done")


def apply_defaults(df: DataFrame) -> DataFrame:
    """Defaults of the incident table for absent values."""
    defaults = {
        "weapon_used": F.lit("Unknown"), "domestic_related": F.lit("No"), "gang_related": F.lit("No"),
        "property_damage": F.lit("No"), "estimated_loss": F.lit("0"),
    }
    return df.withColumns({c: F.coalesce(F.col(c), v) for c, v in defaults.items()})


def constraint_audit(incidents: DataFrame, assessed: DataFrame, lengths: dict[str, int], required: list[str]) -> DataFrame:
    """Broken rules with the number of rows: required values, unique ids, references, lengths."""
    rules = [F.struct(F.lit(f"{c} not null").alias("rule"), F.count_if(F.col(c).isNull()).alias("violations")) for c in required]
    rules += [F.struct(F.lit(f"{c} at most {n}").alias("rule"), F.count_if(F.length(c) > n).alias("violations")) for c, n in lengths.items()]
    rows = incidents.agg(F.array(*rules).alias("r")).select(F.inline("r"))
    twice = incidents.groupBy("incident_id").agg((F.count(F.lit(1)) - 1).alias("more")).agg(F.coalesce(F.sum("more"), F.lit(0)).alias("violations"))
    orphans = assessed.join(incidents.select("incident_id").distinct(), "incident_id", "left_anti").agg(F.count(F.lit(1)).alias("violations"))
    return rows.unionByName(twice.select(F.lit("incident_id unique").alias("rule"), "violations")).unionByName(
        orphans.select(F.lit("assessment has its incident").alias("rule"), "violations")
    )


def delete_incidents(incidents: DataFrame, assessed: DataFrame, alerts: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without the incidents of ``ids`` and their assessments; their alerts stay, without the incident's id."""
    gone = ids.select("incident_id").distinct()
    mark = gone.select(F.col("incident_id").alias("_id"))
    kept = alerts.join(mark, F.col("incident_id") == F.col("_id"), "left")
    kept = kept.withColumn("incident_id", F.when(F.col("_id").isNull(), F.col("incident_id"))).drop("_id")
    return incidents.join(gone, "incident_id", "left_anti"), assessed.join(gone, "incident_id", "left_anti"), kept


def store_incidents(records: DataFrame, path: str, run: str) -> bool:
    """Adds the records by month of their arrival, once per run."""
    return store(records, path, run, "submitted_at")


def store_assessments(records: DataFrame, path: str, run: str) -> bool:
    return store(records, path, run)


def store_alerts(records: DataFrame, path: str, run: str) -> bool:
    return store(records, path, run)
