"""District baselines, the risk of an incident, recommendations, alerts and patrol units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.constants import LEVELS, NO_BASELINE, NO_WEAPON, NO_WEAPON_INCOMING, RISK_SHARES, UNIT_WEIGHTS
from vigil.functions.expr import ACTIONS, by_level, clamp, has_weapon, is_yes, level, rounded, severity_weight, stable_id


def share_of(condition: Column) -> Column:
    """The part of a group's rows that meet a condition; null counts as no."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def normalized(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``n_<column>``: 0 to 1 between the least and the largest value, 0.5 if all are equal; null counts as 0."""
    df = df.withColumns({f"_{c}": F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in columns})
    ends = df.agg(*[f(f"_{c}").alias(f"_{name}_{c}") for c in columns for name, f in (("lo", F.min), ("hi", F.max))])
    out = df.crossJoin(F.broadcast(ends))
    for c in columns:
        span = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        out = out.withColumn(f"n_{c}", F.when(span < 1e-9, 0.5).otherwise((F.col(f"_{c}") - F.col(f"_lo_{c}")) / span))
    return out.drop(*[f"_{c}" for c in columns], *ends.columns)


def historical_baseline(df: DataFrame) -> DataFrame:
    """Per district (rows without one are a group): counts, rates and the historical risk from 0 to 100."""
    dated = df.filter("occurred_date is not null")
    span = dated.agg(F.greatest(F.datediff(F.max("occurred_date"), F.min("occurred_date")), F.lit(1)).alias("_span"))
    stats = dated.groupBy("district").agg(
        F.count(F.lit(1)).alias("incident_count"), share_of(F.col("crime_severity") == "Felony").alias("felony_share"),
        share_of(has_weapon(F.col("weapon_used"), NO_WEAPON)).alias("weapon_rate"),
        share_of(is_yes(F.col("domestic_related"))).alias("domestic_rate"),
        share_of(is_yes(F.col("gang_related"))).alias("gang_rate"), F.avg("estimated_loss").alias("avg_loss"),
    )
    stats = stats.crossJoin(F.broadcast(span)).withColumn("daily_rate", F.col("incident_count") / F.col("_span")).drop("_span")
    signals = {
        "frequency": "daily_rate", "felony": "felony_share", "weapon": "weapon_rate", "domestic": "domestic_rate",
        "gang": "gang_rate", "loss": "avg_loss",
    }
    out = normalized(stats, list(signals.values()))
    score = sum((F.col(f"n_{signals[k]}") * v for k, v in RISK_SHARES.items()), F.lit(0.0))
    rates = ["daily_rate", "felony_share", "weapon_rate", "domestic_rate", "gang_rate", "avg_loss"]
    return out.select(
        "district", "incident_count", *[rounded(F.col(c), 6).alias(c) for c in rates],
        rounded(clamp(score), 1).alias("historical_risk"),
    )


def baseline_lookup(df: DataFrame, baseline: DataFrame) -> DataFrame:
    """``df`` with the ``historical_risk`` of its district, the default where there is none."""
    known = baseline.select(F.col("district").alias("_district"), F.col("historical_risk"))
    out = df.join(known, df["district"] == F.col("_district"), "left").drop("_district")
    return out.withColumn("historical_risk", F.coalesce("historical_risk", F.lit(NO_BASELINE)))


def area_baselines(df: DataFrame) -> DataFrame:
    """District, number of incidents, mean severity weight and baseline risk."""
    weight = df.groupBy("district").agg(rounded(F.avg(severity_weight(F.col("crime_severity"))), 6).alias("avg_severity_score"))
    weight = weight.withColumnRenamed("district", "_district")
    base = historical_baseline(df)
    return base.join(weight, F.col("district").eqNullSafe(F.col("_district"))).select(
        "district", F.col("incident_count").alias("historical_incident_count"), "avg_severity_score",
        F.col("historical_risk").alias("baseline_risk"),
    )


def dynamic_risk(df: DataFrame) -> DataFrame:
    """``df`` (with historical_risk, ratio, is_anomaly, anomaly_score) with dynamic_risk, risk_level and reasons."""
    base = F.coalesce("historical_risk", F.lit(NO_BASELINE))
    weight = severity_weight(F.coalesce("crime_severity", F.lit("Misdemeanor")))
    armed = has_weapon(F.trim("weapon_used"), NO_WEAPON_INCOMING)
    ratio = F.coalesce("ratio", F.lit(1.0))
    anomaly = F.coalesce("is_anomaly", F.lit(False))
    domestic, gang = is_yes(F.col("domestic_related")), is_yes(F.col("gang_related"))
    score = (
        base * 0.5 + weight * 15 + F.when(armed, 10).otherwise(0) + F.when(domestic, 4).otherwise(0)
        + F.when(gang, 4).otherwise(0) + F.when(ratio > 1, F.least((ratio - 1) * 20, F.lit(30.0))).otherwise(0.0)
        + F.when(anomaly, 12).otherwise(0)
    )
    out = df.withColumn("dynamic_risk", rounded(clamp(score), 1)).withColumn("risk_level", level(F.col("dynamic_risk")))
    one = lambda x: F.format_string("%.1f", rounded(x, 1))
    parts = [
        F.concat(F.lit("District baseline "), one(base)),
        F.when(weight >= 0.8, F.lit("Severity raises the score")).when(weight >= 0.5, F.lit("Severity adds to the score")),
        F.when(armed, F.concat(F.lit("Weapon: "), F.col("weapon_used"))),
        F.when(domestic, F.lit("Domestic case")),
        F.when(gang, F.lit("Gang case")),
        F.when(ratio > 1, F.concat(F.lit("Recent activity "), one(ratio), F.lit(" times the usual"))),
        F.when(anomaly & F.col("anomaly_score").isNull(), F.lit("Unusual profile"))
        .when(anomaly, F.concat(F.lit("Unusual profile, score "), F.format_string("%.3f", rounded(F.col("anomaly_score"), 3)))),
        F.concat(F.lit("Risk "), one(F.col("dynamic_risk")), F.lit(" of 100, "), F.col("risk_level")),
    ]
    return out.withColumn("reasons", F.filter(F.array(*parts), F.isnotnull))


FOCUS = {"LOW": "Routine", "MODERATE": "Attention", "HIGH": "Patrol priority", "CRITICAL": "Emergency priority"}


def recommend_priority(df: DataFrame) -> DataFrame:
    """Area, level, focus, action and the leading reason; support for a human decision, nothing else."""
    known = F.when(F.col("risk_level").isin(LEVELS), F.col("risk_level")).otherwise("LOW")
    n = F.size("reasons")
    reason = F.when(n > 1, F.element_at("reasons", F.when(n > 1, n - 1).otherwise(1))).when(n == 1, F.element_at("reasons", 1))
    return df.select(
        "incident_id", F.col("district").alias("area"), F.col("risk_level").alias("priority"),
        by_level(known, FOCUS).alias("focus"), by_level(known, ACTIONS).alias("action"),
        F.coalesce(reason, F.lit("Current assessment")).alias("reason"), F.lit(True).alias("decision_support_only"),
    )


def priority_areas(areas: DataFrame, at_least: str = "HIGH", column: str = "risk_level") -> DataFrame:
    """Areas at that level or above; an unknown level counts as the lowest."""
    rank = lambda x: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, LEVELS)), x), F.lit(0)), F.lit(1))
    return areas.filter(rank(F.col(column)) >= rank(F.lit(at_least)))


def risk_alerts(df: DataFrame) -> DataFrame:
    """An open alert for each incident of level HIGH or CRITICAL."""
    place = F.concat(F.coalesce("district", F.lit("None")), F.lit(" / "), F.coalesce(F.nullif("neighborhood", F.lit("")), F.lit("N/A")))
    return df.filter(F.col("risk_level").isin("HIGH", "CRITICAL")).select(
        stable_id("ALT", F.col("incident_id")).alias("alert_id"), "incident_id", place.alias("location"),
        F.when(F.col("risk_level") == "CRITICAL", "Risk Escalation").otherwise("Elevated Risk").alias("alert_type"),
        "risk_level", F.concat("risk_level", F.lit(" risk: "), "crime_type", F.lit(" in "), F.coalesce("district", F.lit("None"))).alias("message"),
        by_level(F.col("risk_level"), ACTIONS).alias("recommendation"), F.lit("Open").alias("status"),
        F.col("submitted_at").alias("created_at"),
    )


def allocate_patrols(areas: DataFrame, total_units: int, run: str = "run_id") -> DataFrame:
    """Units per area (run, area, risk_level, score) of each run.

    Floor shares by the level's weight; at least one each if there are as many units as areas. Units left go to the
    largest remainders, units too many come off the smallest ones, one a round, while an area has more than one.
    """
    weight = F.lit(UNIT_WEIGHTS["LOW"])
    for name, value in UNIT_WEIGHTS.items():
        weight = F.when(F.col("risk_level") == name, F.lit(value)).otherwise(weight)
    whole = Window.partitionBy(run)
    enough = F.count(F.lit(1)).over(whole) <= total_units
    df = areas.withColumn("weight", weight).withColumn("exact", F.col("weight") / F.sum("weight").over(whole) * total_units)
    df = df.withColumns({"part": F.floor("exact"), "enough": enough}).withColumn("remainder", F.col("exact") - F.col("part"))
    df = df.withColumn("units", F.when(F.col("enough"), F.greatest("part", F.lit(1))).otherwise(F.col("part")))
    df = df.withColumn("over", F.sum("units").over(whole) - total_units)
    down = F.row_number().over(Window.partitionBy(run).orderBy(F.col("remainder").desc(), F.col("score").desc(), "area"))
    df = df.withColumn("units", F.col("units") + F.when((F.col("over") < 0) & (down <= -F.col("over")), 1).otherwise(0))
    # the k-th unit that an area can lose, in rounds over the areas from the smallest remainder on
    lose = F.sequence(F.lit(1), F.least(F.col("units") - 1, F.col("over")).cast("int"))
    slots = df.filter("over > 0 and units > 1").select(run, "area", "over", "remainder", "score", F.explode(lose).alias("round"))
    order = Window.partitionBy(run).orderBy("round", "remainder", "score", F.col("area").desc())
    lost = slots.withColumn("place", F.row_number().over(order)).filter("place <= over").groupBy(run, "area").agg(F.count(F.lit(1)).alias("lost"))
    return df.join(lost, [run, "area"], "left").select(
        run, "area", "risk_level", "score", "weight", (F.col("units") - F.coalesce("lost", F.lit(0))).cast("long").alias("units"),
        F.lit(True).alias("decision_support_only"),
    )


def resource_allocation(baseline: DataFrame, recent: DataFrame, total_units: int) -> DataFrame:
    """Units per district from its baseline and its recent incidents.

    One unit each, then more by score in the order of the score until they are spent, the rest in turns; there are more
    units than asked for if there are more districts. All recent incidents count.
    """
    n = recent.filter("district is not null").groupBy("district").agg(F.count(F.lit(1)).alias("recent_count"))
    df = baseline.filter("district is not null").join(n, "district", "left").withColumn("recent_count", F.coalesce("recent_count", F.lit(0)))
    raw = F.col("historical_risk") + F.least(2 * F.col("recent_count"), F.lit(20))
    df = df.withColumns({"risk_level": level(raw), "score": rounded(raw)})
    order = Window.partitionBy().orderBy(F.col("score").desc(), F.col("recent_count").desc(), "district")
    whole = Window.partitionBy()
    df = df.withColumns({
        "place": F.row_number().over(order), "areas": F.count(F.lit(1)).over(whole),
        "want": F.greatest(F.rint(F.col("score") / 25) - 1, F.lit(0.0)).cast("long"),
    })
    spare = F.greatest(F.lit(total_units) - F.col("areas"), F.lit(0))
    before = F.coalesce(F.sum("want").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = df.withColumn("extra", F.greatest(F.least("want", spare - before), F.lit(0)))
    left = spare - F.sum("extra").over(whole)
    turn = F.floor(left / F.col("areas")) + F.when(F.col("place") <= left % F.col("areas"), 1).otherwise(0)
    return df.select(
        "district", "score", "risk_level", "recent_count", (1 + F.col("extra") + turn).cast("long").alias("units"),
        F.lit(True).alias("decision_support_only"),
    )


def area_score_fallback(df: DataFrame) -> DataFrame:
    """Score from the district's share of all rows alone."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    n = df.filter("district is not null").groupBy("district").agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(total)).select(
        "district", rounded(F.least(F.lit(100.0), F.col("n") / F.col("total") * 700.0)).alias("score")
    )
