"""Incidents as a file stream: validated, scored and stored batch by batch, with the results of the batch job.

Every sink is a folder of Parquet files. A batch writes into a subfolder of its own number and replaces it when it is
tried again. Ids that have come are keyed state of the query, so each incident, assessment and alert is stored once.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from vigil.functions.expr import date_of
from vigil.operators.live import Knowledge, arrived_counts, process_incidents
from vigil.streaming.folded import Folded


def stream_incidents(spark: SparkSession, folder: str, schema: StructType, fmt: str = "json") -> DataFrame:
    """The arriving incidents of a folder of files."""
    return spark.readStream.schema(schema).format(fmt).load(folder)


def stored(spark: SparkSession, path: str, schema: StructType | None = None, before: int | None = None) -> DataFrame | None:
    """What a sink holds, without the batch ``before`` and later ones; None if nothing was stored yet."""
    try:
        df = spark.read.option("basePath", path).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    return df if before is None else df.filter(F.col("batch") < before)


def _put(df: DataFrame, path: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def first_only(arriving: DataFrame, key: str = "incident_id") -> DataFrame:
    """One row per id of a stream, however long ago the first one came: the ids are keyed state of the query.

    A batch looks up its own ids only. Of repeats in the same batch one stays.
    """
    return arriving.dropDuplicates([key])


def _daily(spark: SparkSession, folder: str, newest: bool) -> Folded:
    return Folded(spark, folder, ["day", "location"], "n", "day date, location string, n bigint", newest)


def start_pipeline(arriving: DataFrame, known: Knowledge, folder: str, checkpoint: str, window_days: int = 14) -> StreamingQuery:
    """Runs over all files that are there, then ends: folders arrived, rejected, incidents, assessments, recommendations, alerts.

    The recent activity of a batch is that of all incidents stored so far and its own, from counts per day and district
    (folder daily). A batch reads neither the history nor what earlier batches stored of incidents.
    """
    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        _put(batch, f"{folder}/arrived", number)
        mine = spark.read.schema(batch.schema).parquet(f"{folder}/arrived/batch={number}")
        daily = _daily(spark, f"{folder}/daily", newest=False)
        daily.put(arrived_counts(mine), number)
        done = process_incidents(known, mine, window_days, recent=daily.upto(number))
        for name in done._fields:
            _put(getattr(done, name), f"{folder}/{name}", number)

    query = first_only(arriving).writeStream.foreachBatch(one)
    return query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_daily_counts(arriving: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Counts per day and district, kept for all days, so that late rows still count; a batch writes those that it changed."""
    counted = arriving.select(date_of(F.col("occurred_date")).alias("day"), F.col("district").alias("location"))
    counted = counted.filter("day is not null and location is not null").groupBy("day", "location").agg(F.count(F.lit(1)).alias("n"))

    def one(batch: DataFrame, number: int) -> None:
        _daily(batch.sparkSession, folder, newest=True).put(batch, number)

    query = counted.writeStream.outputMode("update").foreachBatch(one)
    return query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recent_counts(spark: SparkSession, folder: str, days: int) -> DataFrame:
    """From the daily counts: rows per district in the ``days`` days up to the newest."""
    daily = _daily(spark, folder, newest=True).upto()
    since = daily.agg(F.date_sub(F.max("day"), days - 1).alias("since"))
    return daily.crossJoin(F.broadcast(since)).filter("day >= since").groupBy(F.col("location").alias("district")).agg(F.sum("n").alias("recent_count"))
