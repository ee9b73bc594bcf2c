"""One-sentence findings on reports of (key, value) rows; equal values go by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _top(df: DataFrame, *more: Column) -> DataFrame:
    """One row: top, top_value, low, low_value, total, mean."""
    largest = F.min_by("key", F.struct((-F.col("value")).alias("v"), "key"))
    least = F.min_by("key", F.struct(F.col("value").alias("v"), "key"))
    return df.agg(
        largest.alias("top"), F.max("value").alias("top_value"), least.alias("low"), F.min("value").alias("low_value"),
        F.sum("value").alias("total"), F.avg("value").alias("mean"), *more,
    )


def _percent(part: Column, of: Column) -> Column:
    return F.coalesce(F.rint(F.try_divide(part * 100.0, of)), F.lit(0.0)).cast("long")


def _text(df: DataFrame, form: str, *columns: Column | str) -> DataFrame:
    return df.select(F.format_string(form, *columns).alias("insight"))


def crime_by_district(df: DataFrame) -> DataFrame:
    above = _percent(F.col("top_value") - F.col("mean"), F.col("mean"))
    return _text(_top(df), "%s has the most incidents: %d, %d%% above the mean.", "top", F.col("top_value").cast("long"), above)


def time_pattern(df: DataFrame) -> DataFrame:
    return _text(_top(df), "Most incidents at %s: %d; fewest at %s.", "top", F.col("top_value").cast("long"), "low")


def weapon_dist(df: DataFrame) -> DataFrame:
    return _text(_top(df), "%s leads with %d%% of the incidents.", "top", _percent(F.col("top_value"), F.col("total")))


def arrest_by_day(df: DataFrame) -> DataFrame:
    return _text(_top(df), "Resolved most on %s (%.1f%%), least on %s (%.1f%%).", "top", "top_value", "low", "low_value")


def seasonal(df: DataFrame) -> DataFrame:
    swing = _percent(F.col("top_value") - F.col("low_value"), F.col("low_value"))
    return _text(_top(df), "Peak in %s (%d), calm in %s: %d%% apart.", "top", F.col("top_value").cast("long"), "low", swing)


def loss_by_crime(df: DataFrame) -> DataFrame:
    return _text(_top(df), "%s costs most: %d on average.", "top", F.rint("top_value").cast("long"))


def evidence(df: DataFrame) -> DataFrame:
    """From one row with with_evidence, without_evidence and lift."""
    return _text(df, "Resolved with evidence: %.1f%%, without: %.1f%%, a gap of %.1f.", "with_evidence", "without_evidence", "lift")


def victim_profile(df: DataFrame) -> DataFrame:
    """From incidents: the most frequent gender and age group."""
    usual = df.agg(F.mode("victim_gender", deterministic=True).alias("g"), F.mode("victim_age_group", deterministic=True).alias("a"))
    return _text(usual, "Most affected: %s, %s.", "g", "a")


def monthly(df: DataFrame) -> DataFrame:
    swing = _percent(F.col("top_value") - F.col("low_value"), F.greatest("low_value", F.lit(1)))
    return _text(_top(df), "Peak in %s (%d), trough in %s (%d): a swing of %d%%.", "top", F.col("top_value").cast("long"), "low", F.col("low_value").cast("long"), swing)


def gang(df: DataFrame) -> DataFrame:
    return _text(_top(df), "%s has %d%% of the gang incidents.", "top", _percent(F.col("top_value"), F.col("total")))


def hotspot(df: DataFrame) -> DataFrame:
    """From zones (zone, district, n): the largest."""
    return _text(df.orderBy(F.col("n").desc(), "zone").limit(1), "Zone %d in %s is densest: %d incidents.", "zone", "district", "n")
