"""Historical and emerging hotspots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.constants import HOTSPOT_BOUNDS, HOTSPOT_SHARES, NO_HISTORY_RATIO, NO_WEAPON
from vigil.functions.expr import clamp, has_weapon, level, rounded
from vigil.operators.risk import normalized, share_of


def historical_hotspots(df: DataFrame, by: str = "district") -> DataFrame:
    """Per place (rows without one are a group): counts, rates and the hotspot score with its level."""
    stats = df.groupBy(F.col(by).alias("location")).agg(
        F.count(F.lit(1)).alias("incident_count"), F.count_if(F.col("crime_severity") == "Felony").alias("felony_count"),
        share_of(F.col("crime_severity") == "Felony").alias("felony_rate"),
        share_of(has_weapon(F.col("weapon_used"), NO_WEAPON)).alias("weapon_rate"), F.avg("estimated_loss").alias("average_loss"),
    )
    signals = {"frequency": "incident_count", "felony": "felony_rate", "weapon": "weapon_rate", "loss": "average_loss"}
    score = sum((F.col(f"n_{signals[k]}") * v for k, v in HOTSPOT_SHARES.items()), F.lit(0.0))
    out = normalized(stats, list(signals.values())).withColumn("hotspot_score", rounded(clamp(score)))
    return out.select(
        "location", "incident_count", "felony_count", *[rounded(F.col(c), 6).alias(c) for c in ("felony_rate", "weapon_rate", "average_loss")],
        "hotspot_score", level(F.col("hotspot_score"), HOTSPOT_BOUNDS).alias("hotspot_level"),
    )


def activity(history: DataFrame, by: str = "district") -> DataFrame:
    """(location, old_n, first, last): dated rows per place and their days; rows without a place count for the span only.

    Activities of parts of a history merge by sum, least and largest.
    """
    past = history.filter("occurred_date is not null")
    return past.groupBy(F.col(by).alias("location")).agg(
        F.count(F.lit(1)).alias("old_n"), F.min("occurred_date").alias("first"), F.max("occurred_date").alias("last")
    )


def daily_counts(incoming: DataFrame, by: str = "district") -> DataFrame:
    """(day, location, n) of the dated rows, a null place included; counts of parts merge by sum."""
    dated = incoming.filter("occurred_date is not null")
    return dated.groupBy(F.col("occurred_date").alias("day"), F.col(by).alias("location")).agg(F.count(F.lit(1)).alias("n"))


def emerging_from(past: DataFrame, daily: DataFrame, window_days: int = 7) -> DataFrame:
    """``emerging_hotspots`` of an ``activity`` and ``daily_counts``; the latter may have several rows per day and place."""
    span = past.agg((F.datediff(F.max("last"), F.min("first")) + 1).alias("span"))
    old = past.filter("location is not null").groupBy("location").agg(F.sum("old_n").alias("old_n"))
    newest = daily.agg(F.date_sub(F.max("day"), window_days - 1).alias("since"))
    new = daily.crossJoin(F.broadcast(newest)).filter("day >= since and location is not null")
    new = new.groupBy("location").agg(F.sum("n").alias("recent_count"))
    df = old.join(new, "location", "full").crossJoin(F.broadcast(span)).withColumns({
        "recent_count": F.coalesce("recent_count", F.lit(0)), "old_n": F.coalesce("old_n", F.lit(0)),
    })
    df = df.withColumns({
        "recent_rate": F.col("recent_count") / window_days, "old_rate": F.coalesce(F.try_divide("old_n", "span"), F.lit(0.0)),
    })
    ratio = F.when(F.col("old_rate") > 0, F.try_divide("recent_rate", "old_rate")).when(F.col("recent_count") > 0, NO_HISTORY_RATIO).otherwise(1.0)
    df = df.withColumn("exact", ratio)
    trend = F.when(F.col("exact") > 1.05, "increasing").when(F.col("exact") < 0.95, "decreasing").otherwise("stable")
    return df.select(
        "location", "recent_count", rounded(F.col("recent_rate"), 4).alias("recent_rate"), rounded(F.col("old_rate"), 4).alias("historical_rate"),
        rounded(F.col("exact"), 2).alias("ratio"), ((F.col("exact") >= 1.5) & (F.col("recent_count") > 0)).alias("is_emerging"), trend.alias("trend"),
    )


def emerging_hotspots(history: DataFrame, incoming: DataFrame, window_days: int = 7, by: str = "district") -> DataFrame:
    """Recent against historical daily rate per place; the window ends with the newest incoming day.

    A place without history has the fixed high ratio, one with neither 1; emerging means half more than usual.
    """
    return emerging_from(activity(history, by), daily_counts(incoming, by), window_days)


def early_warnings(emerging: DataFrame) -> DataFrame:
    severity = F.when(F.col("ratio") >= 3, "CRITICAL").when(F.col("ratio") >= 2, "HIGH").otherwise("MODERATE")
    text = F.concat(F.col("location"), F.lit(": "), F.format_string("%.2f", "ratio"), F.lit(" times the usual activity"))
    return emerging.filter("is_emerging").select("location", "ratio", severity.alias("severity"), text.alias("message"))


def hotspot_summary(history: DataFrame, incoming: DataFrame, window_days: int = 7) -> DataFrame:
    """Hotspots, emerging places and warnings in one table, told apart by ``part``."""
    emerging = emerging_hotspots(history, incoming, window_days)
    hot = historical_hotspots(history).select(F.lit("hotspot").alias("part"), "location", F.col("hotspot_score").alias("value"), F.col("hotspot_level").alias("level"))
    up = emerging.select(F.lit("emerging").alias("part"), "location", F.col("ratio").alias("value"), F.col("trend").alias("level"))
    warn = early_warnings(emerging).select(F.lit("warning").alias("part"), "location", F.col("ratio").alias("value"), F.col("severity").alias("level"))
    return hot.unionByName(up).unionByName(warn)


def hotspot_lookup(hotspots: DataFrame, places: list[str]) -> DataFrame:
    return hotspots.filter(F.col("location").isin(places))


def hotspot_priority(hotspots: DataFrame, emerging: DataFrame) -> DataFrame:
    """Hotspot score and recent ratio in one score."""
    ratio = emerging.select(F.col("location").alias("_location"), F.col("ratio"))
    out = hotspots.join(ratio, F.col("location") == F.col("_location"), "left").withColumn("ratio", F.coalesce("ratio", F.lit(1.0)))
    score = F.col("hotspot_score") * 0.7 + F.least("ratio", F.lit(3.0)) / 3 * 30
    return out.select("location", "hotspot_score", "ratio", rounded(clamp(score)).alias("priority_score"))
