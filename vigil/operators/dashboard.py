"""The reports on the history. Each takes incidents (and settings) and returns one table.

A report that the user narrows by crime type, district or season is returned for all values at once, or takes them as
arguments; a filter on the result or on the incidents reaches the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.constants import FIXED_WEAPONS, MONTHS, PATTERN_BOUNDS, WEEKDAYS
from vigil.functions.expr import draw, level, rounded
from vigil.operators.aggregates import best, counts, marked, mean, modes, shares, yes_rate, yes_rate_of_all
from vigil.ordered import quantile


def narrowed(df: DataFrame, **equal: str | None) -> DataFrame:
    """Rows that equal the given values; None means all."""
    for column, value in equal.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


def month_number(x: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, MONTHS)), x).cast("int")


def weekday_number(x: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, WEEKDAYS)), x).cast("int")


def months(df: DataFrame) -> DataFrame:
    """The twelve months, as a table."""
    return df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, MONTHS))).alias("month"))


def calendar_order(df: DataFrame) -> DataFrame:
    """Rows per month and weekday with their numbers in the calendar."""
    n = counts(df, "month", "day_of_week")
    return n.withColumns({"month_no": month_number(F.col("month")), "day_no": weekday_number(F.col("day_of_week"))})


def loss_stats(df: DataFrame) -> DataFrame:
    loss = "estimated_loss"
    return df.filter("crime_type is not null").groupBy("crime_type").agg(
        mean(loss).alias("mean"), F.min(loss).alias("min"), F.max(loss).alias("max"),
        rounded(F.stddev_samp(loss), 2).alias("std"),
    )


def over_months(n: DataFrame, name: str) -> DataFrame:
    """(name, month, n) with a row for every month, 0 where there is none."""
    grid = n.select(name).distinct().crossJoin(F.broadcast(months(n)))
    return grid.join(n, [name, "month"], "left").select(name, "month", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def month_crime(df: DataFrame) -> DataFrame:
    return over_months(counts(df, "crime_type", "month"), "crime_type")


def district_month_pivot(df: DataFrame) -> DataFrame:
    """A column per month."""
    return df.filter("district is not null").groupBy("district").agg(
        *[F.count_if(F.col("month") == m).alias(m.lower()) for m in MONTHS]
    )


def month_crime_pivot(df: DataFrame) -> DataFrame:
    """Month by crime type with the calendar's number; long, since crime types are data."""
    return month_crime(df).withColumn("month_no", month_number(F.col("month")))


def pattern_risk(df: DataFrame, gang_predicted: Column) -> DataFrame:
    """Per crime, district, time and weapon: share of the area's rows at that time, raised for gangs and weapons."""
    pattern = counts(df, "crime_type", "district", "time_category")
    area = counts(df, "district", "time_category").withColumnRenamed("n", "area")
    weapons = counts(df, "crime_type", "district", "time_category", "weapon_used").drop("n")
    score = rounded(F.least(F.col("n") / F.col("area") * 100.0 * 3.0, F.lit(100.0)))
    score = F.when(gang_predicted, F.least(score + 20, F.lit(100.0))).otherwise(score)
    armed = F.col("weapon_used").isin("Firearm", "Knife")
    score = F.when(armed, F.least(score + 15, F.lit(100.0))).otherwise(score)
    return (
        weapons.join(pattern, ["crime_type", "district", "time_category"]).join(area, ["district", "time_category"])
        .withColumn("risk", rounded(score))
        .select("crime_type", "district", "time_category", "weapon_used", "risk", level(F.col("risk"), PATTERN_BOUNDS).alias("risk_level"))
    )


def loss_range(df: DataFrame, crimes: list[str]) -> DataFrame:
    """Least (not below 0), mean and largest loss of the wanted crime types; 0 for one without rows."""
    wanted = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, crimes))).alias("crime_type"))
    stats = loss_stats(df)
    zero = F.lit(0.0)
    return wanted.join(stats, "crime_type", "left").select(
        "crime_type", F.coalesce(F.greatest(F.lit(0), F.col("min")).cast("double"), zero).alias("loss_min"),
        F.coalesce("mean", zero).alias("loss_mean"), F.coalesce(F.col("max").cast("double"), zero).alias("loss_max"),
    )


def arrest_gap(df: DataFrame) -> DataFrame:
    """Per crime, district and time: cases, resolved ones, their percentage, and its distance from the city's."""
    city = df.agg(yes_rate("arrest_made").alias("city_rate"))
    combos = df.groupBy("crime_type", "district", "time_category").agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(F.col("arrest_made") == "Yes").alias("resolved"),
        F.coalesce(yes_rate("arrest_made"), F.lit(0.0)).alias("rate"),
    )
    return combos.crossJoin(F.broadcast(city)).withColumn("gap", rounded(F.col("rate") - F.col("city_rate")))


def modal_profile(df: DataFrame) -> DataFrame:
    return modes(df, ["crime_type", "district"], ["crime_severity", "weapon_used", "time_category", "premises_type"])


def top_threat(df: DataFrame) -> DataFrame:
    """Per district the crime type of which it has the largest part of the city's cases."""
    here = counts(df, "district", "crime_type")
    city = here.groupBy("crime_type").agg(F.sum("n").alias("city"))
    share = here.join(city, "crime_type").select("district", "crime_type", rounded(100.0 * F.col("n") / F.col("city")).alias("share"))
    return best(share, "share", ["crime_type"], ["district"])


def gang_share(df: DataFrame) -> DataFrame:
    return shares(df, "gang_related")


def avg_victims_by_crime(df: DataFrame) -> DataFrame:
    out = df.groupBy("crime_type").agg(mean("victim_count").alias("avg_victims"))
    return marked(out, "avg_victims", ["crime_type"], "highest", "lowest")


def gang_weapon(df: DataFrame) -> DataFrame:
    """Gang flag by weapon, and the weapon most used by gangs."""
    n = counts(df, "gang_related", "weapon_used")
    usual = df.filter("gang_related = 'Yes'").agg(F.mode("weapon_used", deterministic=True).alias("gang_weapon"))
    return n.crossJoin(F.broadcast(usual))


def value_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """Shares of the values of several columns: field, value, n, share."""
    out = None
    for c in columns:
        part = shares(df, c).select(F.lit(c).alias("field"), F.col(c).alias("value"), "n", "share")
        out = part if out is None else out.unionByName(part)
    return out


def bounded_sample(df: DataFrame, n: int) -> DataFrame:
    """``n`` rows drawn by a hash of the row key, the same ones each time."""
    return df.withColumn("draw", draw("row_key")).orderBy("draw", "incident_id").limit(n).select("incident_id", "draw")


def geo_density(df: DataFrame, digits: int = 2) -> DataFrame:
    """Points per cell of the rounded grid, with the centre of all points."""
    there = df.filter("latitude is not null and longitude is not null")
    centre = there.agg(rounded(F.avg("latitude"), 5).alias("centre_lat"), rounded(F.avg("longitude"), 5).alias("centre_lon"))
    cells = there.groupBy(
        F.floor(F.col("latitude") * 10**digits + 0.5).alias("lat_cell"), F.floor(F.col("longitude") * 10**digits + 0.5).alias("lon_cell")
    ).agg(F.count(F.lit(1)).alias("n"))
    return cells.crossJoin(F.broadcast(centre))


def crime_by_district(df: DataFrame) -> DataFrame:
    return counts(df, "crime_type", "district")


def action_list(df: DataFrame, gang_predicted: Column) -> DataFrame:
    """Every action that the level, gangs and weapon ask for, with its place in the list."""
    rated = pattern_risk(df, gang_predicted)
    urgent = F.col("risk_level").isin("CRITICAL", "HIGH")
    armed = F.col("weapon_used").isin("Firearm", "Knife")
    wanted = [
        (urgent, "send a rapid response unit"),
        (urgent, "raise the number of patrols"),
        (~urgent, "keep the usual patrols"),
        (gang_predicted, "inform the gang unit"),
        (gang_predicted, "compare with known groups"),
        (armed, "send armed officers"),
        (armed & gang_predicted, "prepare for armed groups"),
        (F.lit(True), "collect evidence at the scene"),
        (F.lit(True), "interview witnesses"),
    ]
    actions = F.filter(F.array(*[F.when(when, F.lit(text)) for when, text in wanted]), F.isnotnull)
    return rated.select(
        "crime_type", "district", "time_category", "weapon_used", F.posexplode(actions).alias("place", "action")
    )


def district_priority(df: DataFrame) -> DataFrame:
    return counts(df, "district", "priority_level")


def threat_growth(df: DataFrame, k: int = 3) -> DataFrame:
    """Cases of the last three months against the first six, per crime type; the ``k`` rising and falling most."""
    number = month_number(F.col("month"))
    n = df.filter("crime_type is not null").groupBy("crime_type").agg(
        F.count_if(number >= 10).alias("late"), F.count_if(number <= 6).alias("early")
    )
    growth = rounded((F.col("late") - F.col("early")) * 100.0 / F.when(F.col("early") == 0, 1).otherwise(F.col("early")))
    grown = n.withColumn("growth", growth)
    up = best(grown, "growth", ["crime_type"], k=k).withColumn("direction", F.lit("rising"))
    down = best(grown, "growth", ["crime_type"], highest=False, k=k).withColumn("direction", F.lit("falling"))
    return up.unionByName(down)


def monthly_flow(df: DataFrame, crimes: list[str]) -> DataFrame:
    return month_crime(df.filter(F.col("crime_type").isin(crimes)))


def monthly_totals(df: DataFrame) -> DataFrame:
    n = months(df).join(counts(df, "month"), "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n"))
    return marked(n.withColumn("month_no", month_number(F.col("month"))), "n", ["month_no"], "peak", "trough")


def district_month_long(df: DataFrame) -> DataFrame:
    return over_months(counts(df, "district", "month"), "district").withColumn("month_no", month_number(F.col("month")))


def district_totals(df: DataFrame) -> DataFrame:
    return counts(df, "district")


def month_compare(df: DataFrame, one: str, other: str) -> DataFrame:
    """Cases of two months per crime type."""
    n = df.filter("crime_type is not null").groupBy("crime_type").agg(
        F.count_if(F.col("month") == one).alias("n_one"), F.count_if(F.col("month") == other).alias("n_other")
    ).withColumn("change", F.col("n_other") - F.col("n_one"))
    direction = F.when(F.col("change") > 0, "up").when(F.col("change") < 0, "down").otherwise("same")
    return marked(n.withColumn("direction", direction), "change", ["crime_type"], "largest_rise", "largest_fall")


def season_crime(df: DataFrame) -> DataFrame:
    n = counts(df, "season", "crime_type")
    return n.withColumn("season_total", F.sum("n").over(Window.partitionBy("season")))


def season_loss(df: DataFrame) -> DataFrame:
    return marked(df.groupBy("season").agg(mean("estimated_loss").alias("avg_loss")), "avg_loss", ["season"], "worst", "mildest")


def district_season(df: DataFrame) -> DataFrame:
    n = counts(df, "district", "season")
    return marked(n, "n", ["district", "season"], "largest", "smallest").drop("smallest")


def holiday_counts(df: DataFrame) -> DataFrame:
    n = counts(df, "is_holiday", "crime_type")
    return n.withColumn("label", F.when(F.col("is_holiday") == "Yes", "Holiday").otherwise("Normal day"))


def holiday_resolution(df: DataFrame) -> DataFrame:
    """Resolved share on holidays and on other days, and their difference."""
    return df.agg(
        *[
            rounded(F.try_divide(
                100.0 * F.count_if((F.col("arrest_made") == "Yes") & (F.col("is_holiday") == flag)),
                F.count_if(F.col("arrest_made").isNotNull() & (F.col("is_holiday") == flag)),
            )).alias(name)
            for flag, name in (("Yes", "holiday_rate"), ("No", "normal_rate"))
        ]
    ).withColumn("difference", rounded(F.col("holiday_rate") - F.col("normal_rate")))


def holiday_ratio(df: DataFrame) -> DataFrame:
    """Holiday cases per case of other days; null where there is none of the latter."""
    yes, no = (F.count_if(F.col("is_holiday") == x) for x in ("Yes", "No"))
    return df.filter("crime_type is not null").groupBy("crime_type").agg(
        yes.alias("holiday"), no.alias("normal"), rounded(F.try_divide(yes.cast("double"), no), 3).alias("ratio")
    )


def priority_severity(df: DataFrame) -> DataFrame:
    return counts(df, "priority_level", "crime_severity")


def severity_share_by_priority(df: DataFrame) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy("priority_level"))
    return priority_severity(df).withColumn("share", rounded(100.0 * F.col("n") / total))


def resolution_by(df: DataFrame, by: str) -> DataFrame:
    """Yes percentage of arrests per value, the best and the worst marked."""
    out = df.filter(F.col(by).isNotNull()).groupBy(by).agg(yes_rate("arrest_made").alias("rate"))
    return marked(out, "rate", [by], "best", "worst")


def target_profile(df: DataFrame) -> DataFrame:
    profile = ["victim_gender", "suspect_gender", "victim_age_group", "suspect_age_group", "premises_type"]
    cases = df.groupBy("crime_type").agg(
        F.count_if(F.col("arrest_made") == "Yes").alias("resolved"), F.count(F.lit(1)).alias("cases")
    )
    text = F.concat_ws("/", "resolved", "cases")
    return modes(df, ["crime_type"], profile).join(cases.select("crime_type", text.alias("resolved_text")), "crime_type")


def crime_composition(df: DataFrame) -> DataFrame:
    """District by crime type, with the district's total and whether it is the busiest."""
    n = counts(df, "district", "crime_type")
    totals = marked(n.groupBy("district").agg(F.sum("n").alias("total")), "total", ["district"], "busiest", "calmest")
    return n.join(totals.drop("calmest"), "district")


def evidence_resolution(df: DataFrame) -> DataFrame:
    """Resolved share with and without evidence, and the lift."""
    def rate(flag: str) -> Column:
        return rounded(F.try_divide(
            100.0 * F.count_if((F.col("arrest_made") == "Yes") & (F.col("evidence_collected") == flag)),
            F.count_if(F.col("arrest_made").isNotNull() & (F.col("evidence_collected") == flag)),
        ))

    return df.agg(rate("Yes").alias("with_evidence"), rate("No").alias("without_evidence")).withColumn(
        "lift", rounded(F.col("with_evidence") - F.col("without_evidence"))
    )


def outcome_grid(df: DataFrame, min_rows: int = 5) -> DataFrame:
    """Resolved and evidence percentage per district and crime, and the district's plain means of its cells.

    All cells are returned; those of at most ``min_rows`` rows are flagged and stay out of ``rate_mean``.
    """
    cells = df.filter("district is not null and crime_type is not null").groupBy("district", "crime_type").agg(
        F.count(F.lit(1)).alias("n"), yes_rate_of_all("arrest_made").alias("rate"),
        yes_rate_of_all("evidence_collected").alias("evidence"),
    ).withColumn("enough_rows", F.col("n") > min_rows)
    here = Window.partitionBy("district")
    return cells.withColumns({
        "rate_mean": rounded(F.avg(F.when(F.col("enough_rows"), F.col("rate"))).over(here), 2),
        "rate_mean_all": rounded(F.avg("rate").over(here), 2),
    })


def arrest_rate_by_crime(df: DataFrame) -> DataFrame:
    return df.filter("crime_type is not null").groupBy("crime_type").agg(yes_rate_of_all("arrest_made").alias("rate"))


def timing_peaks(df: DataFrame) -> DataFrame:
    rates = df.groupBy("crime_type").agg(yes_rate("arrest_made").alias("rate"))
    return modes(df, ["crime_type"], ["time_category", "day_of_week", "season"]).join(rates, "crime_type")


def time_counts(df: DataFrame) -> DataFrame:
    return counts(df, "time_category")


def day_time_matrix(df: DataFrame) -> DataFrame:
    n = counts(df, "day_of_week", "time_category").withColumn("day_no", weekday_number(F.col("day_of_week")))
    return marked(n, "n", ["day_no", "time_category"], "peak", "least").drop("least")


def day_counts(df: DataFrame) -> DataFrame:
    n = counts(df, "day_of_week").withColumn("day_no", weekday_number(F.col("day_of_week")))
    return marked(n, "n", ["day_no"], "peak", "least").drop("least")


def time_severity(df: DataFrame) -> DataFrame:
    return counts(df, "time_category", "crime_severity")


def day_arrest(df: DataFrame) -> DataFrame:
    """Weekday by outcome, with the weekday's resolved percentage."""
    n = counts(df, "day_of_week", "arrest_made")
    return n.join(df.groupBy("day_of_week").agg(yes_rate("arrest_made").alias("rate")), "day_of_week")


def severity_mix_by_time(df: DataFrame, severities: list[str]) -> DataFrame:
    """Percentage of each severity within a time of day; 0 where there is none."""
    n = counts(df, "time_category", "crime_severity")
    grid = n.select("time_category").distinct().withColumn("crime_severity", F.explode(F.array(*map(F.lit, severities))))
    full = grid.join(n, ["time_category", "crime_severity"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy("time_category"))
    return full.withColumn("share", rounded(F.try_divide(100.0 * F.col("n"), total)))


def district_compare_monthly(df: DataFrame, districts: list[str]) -> DataFrame:
    return counts(df.filter(F.col("district").isin(districts)), "district", "month")


def district_rank(df: DataFrame, districts: list[str]) -> DataFrame:
    """Cases, resolved text, mean loss and main crime of the chosen districts."""
    return df.filter(F.col("district").isin(districts)).groupBy("district").agg(
        F.count(F.lit(1)).alias("total"),
        F.format_string("%d (%.1f%%)", F.count_if(F.col("arrest_made") == "Yes"), F.coalesce(yes_rate("arrest_made"), F.lit(0.0))).alias("resolved_text"),
        mean("estimated_loss", 0).cast("long").alias("avg_loss"),
        F.mode("crime_type", deterministic=True).alias("main_crime"),
    )


def avg_loss_by(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(mean("estimated_loss").alias("avg_loss"))


def avg_loss_by_district(df: DataFrame) -> DataFrame:
    """Mean loss per district, and how many times the lowest the highest is."""
    out = avg_loss_by(df, "district")
    ends = out.agg(F.max("avg_loss").alias("top"), F.min("avg_loss").alias("low"))
    ratio = ends.select(rounded(F.col("top") / F.greatest(F.col("low"), F.lit(1.0)), 2).alias("top_to_low"))
    return out.crossJoin(F.broadcast(ratio))


def loss_grid(df: DataFrame) -> DataFrame:
    return marked(avg_loss_by(df, "district", "crime_type"), "avg_loss", ["district", "crime_type"], "largest", "least").drop("least")


def district_resolution(df: DataFrame) -> DataFrame:
    out = df.filter("district is not null").groupBy("district").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("arrest_made") == "Yes").alias("resolved"),
        yes_rate("arrest_made").alias("rate"),
    ).withColumn("unresolved", F.col("total") - F.col("resolved"))
    return marked(out, "rate", ["district"], "best", "worst")


def gang_by_district(df: DataFrame) -> DataFrame:
    """Gang cases per district and their percentage of the city's."""
    return shares(df.filter("gang_related = 'Yes'"), "district")


def weapon_by_district(df: DataFrame) -> DataFrame:
    return marked(counts(df, "district", "weapon_used"), "n", ["district", "weapon_used"], "largest", "least").drop("least")


def report_source_arrest(df: DataFrame) -> DataFrame:
    return counts(df, "reported_by", "arrest_made")


def directives(df: DataFrame, gang_predicted: Column) -> DataFrame:
    """Seven directives per district with a priority; the one on gangs depends on the prediction."""
    threat = top_threat(df)
    peak = modes(df, ["district"], ["time_category"])
    gang = df.groupBy("district").agg(F.max(gang_predicted).alias("gang"))
    lines = [
        (1, F.lit(1), F.format_string("More patrols against %s (%.1f%% of its cases) at %s hours", "crime_type", "share", "time_category_mode")),
        (2, F.lit(1), F.lit("Collect evidence at every scene")),
        (3, F.when(F.col("gang"), 1).otherwise(2), F.concat(F.lit("Gang unit: involvement "), F.when(F.col("gang"), "expected").otherwise("possible"), F.lit(" in "), F.col("district"))),
        (4, F.lit(2), F.lit("Move units before the peak season")),
        (5, F.lit(2), F.lit("Strengthen weekend and night shifts")),
        (6, F.lit(2), F.concat(F.lit("Build reporting channels in "), F.col("district"))),
        (7, F.lit(3), F.lit("Align patrol zones with the density of cases")),
    ]
    rows = F.array(*[F.struct(F.lit(i).alias("place"), p.cast("int").alias("priority"), t.alias("directive")) for i, p, t in lines])
    return threat.join(peak, "district").join(gang, "district").select("district", F.inline(rows))


def record_counts(df: DataFrame, **equal: str | None) -> DataFrame:
    """Rows in all, and rows that match."""
    match = F.lit(True)
    for column, value in equal.items():
        if value is not None:
            match = match & (F.col(column) == value)
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(match).alias("matching"))


def entry_defaults(df: DataFrame) -> DataFrame:
    """What a form for a new incident starts with: per crime the usual category, and the middle of the coordinates."""
    middle = quantile(df, "latitude", 0.5, "mid_lat").crossJoin(F.broadcast(quantile(df, "longitude", 0.5, "mid_lon")))
    usual = modes(df.filter("crime_type is not null"), ["crime_type"], ["crime_category"])
    fixed = F.array(*map(F.lit, FIXED_WEAPONS))
    more = df.select("weapon_used").filter("weapon_used is not null").distinct().agg(F.collect_set("weapon_used").alias("w"))
    weapons = more.select(F.concat_ws(",", F.concat(fixed, F.sort_array(F.array_except("w", fixed)))).alias("weapons"))
    out = usual.crossJoin(F.broadcast(middle)).crossJoin(F.broadcast(weapons))
    return out.withColumns({"mid_lat": rounded(F.col("mid_lat"), 6), "mid_lon": rounded(F.col("mid_lon"), 6)})
