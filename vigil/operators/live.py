"""The whole chain from arriving incidents to records, assessments, recommendations and alerts."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.expr import date_of
from vigil.operators.anomaly import IncidentForest, incident_forest, score_records
from vigil.operators.cleaning import (
    GIVEN_FLAGS, coverage_bounds, incident_record, valid_domains, validate_basic, within_coverage,
)
from vigil.operators.hotspots import activity, daily_counts, emerging_from
from vigil.operators.records import assessments
from vigil.operators.risk import baseline_lookup, dynamic_risk, historical_baseline, recommend_priority, risk_alerts
from vigil.shared import written


class Knowledge(NamedTuple):
    """What the history says, computed once for a batch or a stream; nothing reads the history itself after that."""

    history: DataFrame
    domains: DataFrame
    bounds: DataFrame
    baseline: DataFrame
    activity: DataFrame
    anomalies: IncidentForest | None


def knowledge(history: DataFrame, anomalies: bool = True) -> Knowledge:
    """``anomalies=False`` trains no forest, for arriving rows that bring their flags.

    With a forest the history is stored first: it is read some ten times.
    """
    if anomalies:
        history = written(history, "history")
    small = valid_domains(history), coverage_bounds(history), historical_baseline(history), activity(history)
    if not anomalies:
        return Knowledge(history, *small, None)
    small = [written(df, name) for df, name in zip(small, ("domains", "bounds", "baseline", "activity"), strict=True)]
    return Knowledge(history, *small, None if history.isEmpty() else incident_forest(history))


class Processed(NamedTuple):
    rejected: DataFrame
    incidents: DataFrame
    assessments: DataFrame
    recommendations: DataFrame
    alerts: DataFrame


def arrived_counts(arrived: DataFrame) -> DataFrame:
    """(day, location, n) of arriving rows, whose dates are texts."""
    return daily_counts(arrived.select("district", date_of(F.col("occurred_date")).alias("occurred_date")))


def _recorded(known: Knowledge, checked: DataFrame) -> DataFrame:
    return within_coverage(incident_record(checked.filter("valid")), known.bounds)


def _rated(known: Knowledge, records: DataFrame, daily: DataFrame, window_days: int) -> DataFrame:
    emerging = emerging_from(known.activity, daily, window_days).select(F.col("location").alias("_location"), "ratio")
    based = baseline_lookup(_flagged(known, records.filter("in_coverage")), known.baseline)
    return dynamic_risk(based.join(emerging, F.col("district") == F.col("_location"), "left").drop("_location"))


def _daily(arrived: DataFrame) -> DataFrame:
    """``arrived_counts``, stored: they are read twice, and stored counts are known to be small."""
    return written(arrived_counts(arrived), "daily")


def _checked(known: Knowledge, arrived: DataFrame) -> DataFrame:
    """The arrived rows with what is wrong with them. The files they come in may be few, so they are dealt out, once, before
    they are checked and go down the trees, which is most of the work."""
    dealt = arrived.repartition(2 * arrived.sparkSession.sparkContext.defaultParallelism, "incident_id")
    return validate_basic(dealt, known.domains)


def scored(known: Knowledge, arrived: DataFrame, window_days: int = 14, recent: DataFrame | None = None) -> DataFrame:
    """Valid incidents within the coverage with their dynamic risk.

    Flags of an anomaly come from the forest of the history, unless the arriving rows have ``is_anomaly``.
    ``recent`` has the daily counts that recent activity is taken from, those of the arrived rows by default.
    """
    records = _recorded(known, _checked(known, arrived))
    return _rated(known, records, _daily(arrived) if recent is None else recent, window_days)


def _flagged(known: Knowledge, records: DataFrame) -> DataFrame:
    if "is_anomaly" in records.columns:
        return records if "anomaly_score" in records.columns else records.withColumn("anomaly_score", F.lit(None).cast("double"))
    records = records.drop("anomaly_score")
    if known.anomalies is not None:
        return score_records(records, known.anomalies)
    if not known.history.isEmpty():
        raise ValueError("neither a forest nor flags of anomalies")
    return records.withColumns({c: F.lit(None).cast(kind) for c, kind in GIVEN_FLAGS.items()})  # no record is valid then


def process_incidents(known: Knowledge, arrived: DataFrame, window_days: int = 14, recent: DataFrame | None = None) -> Processed:
    """All results of a batch, which is checked, recorded and rated once. Incidents outside the coverage are stored as
    received, without an assessment."""
    checked = written(_checked(known, arrived), "checked")
    records = written(_recorded(known, checked), "records")
    rated = written(_rated(known, records, _daily(checked) if recent is None else recent, window_days), "rated")
    status = F.when(F.col("in_coverage"), "Processed").otherwise("Received")
    return Processed(
        checked.filter("not valid").select("incident_id", "errors"), records.drop(*GIVEN_FLAGS).withColumn("status", status),
        assessments(rated), recommend_priority(rated), risk_alerts(rated),
    )
