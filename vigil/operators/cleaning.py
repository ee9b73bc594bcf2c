"""Checking and normalising incoming incidents."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.constants import REQUIRED_FIELDS, SEVERITIES, YES_NO_FIELDS
from vigil.functions.expr import clean_value, number, safe_float, safe_int, valid_date, valid_time
from vigil.ordered import dense_codes
from vigil.shared import written


def _blank(x: Column) -> Column:
    return x.isNull() | (F.trim(x) == "")


def valid_domains(history: DataFrame) -> DataFrame:
    """The known crime types and districts: field, value."""
    parts = [
        history.select(F.lit(c).alias("field"), F.col(c).alias("value")).filter("value is not null").distinct()
        for c in ("crime_type", "district")
    ]
    return parts[0].unionByName(parts[1])


def _known(df: DataFrame, domains: DataFrame, field: str, trimmed: bool) -> DataFrame:
    """Adds the boolean _known_<field>."""
    values = domains.filter(F.col("field") == field).select(F.col("value").alias("_value"), F.lit(True).alias(f"_known_{field}"))
    x = F.trim(field) if trimmed else F.col(field)
    out = df.join(values, x == F.col("_value"), "left").drop("_value")
    return out.withColumn(f"_known_{field}", F.coalesce(f"_known_{field}", F.lit(False)))


def _errors(rules: list[tuple[Column, str]]) -> Column:
    return F.filter(F.array(*[F.when(broken, F.lit(code)) for broken, code in rules]), F.isnotnull)


def validate_incidents(df: DataFrame, domains: DataFrame) -> DataFrame:
    """``df`` with ``valid`` and ``errors``, the codes of the broken rules.

    If a required field is missing, only that is reported. An absent flag breaks nothing, an empty one does.
    """
    df = _known(_known(df, domains, "crime_type", True), domains, "district", True)
    missing = _errors([(_blank(F.col(c)), f"{c} missing") for c in REQUIRED_FIELDS])
    lat, lon, loss = number(F.col("latitude")), number(F.col("longitude")), number(F.col("estimated_loss"))
    rest = _errors([
        (~F.col("_known_crime_type"), "crime_type unknown"),
        (~_blank(F.col("district")) & ~F.col("_known_district"), "district unknown"),
        (lat.isNull(), "latitude not a number"),
        (lon.isNull(), "longitude not a number"),
        (~lat.between(-90, 90), "latitude out of range"),
        (~lon.between(-180, 180), "longitude out of range"),
        (~valid_date(F.col("occurred_date")), "occurred_date malformed"),
        (~valid_time(F.col("occurred_time")), "occurred_time malformed"),
        (~F.trim("crime_severity").isin(SEVERITIES), "crime_severity unknown"),
        *[(~F.lower(F.trim(c)).isin("yes", "no"), f"{c} not yes or no") for c in YES_NO_FIELDS],
        (loss < 0, "estimated_loss negative"),
        (loss.isNull(), "estimated_loss not a number"),
    ])
    errors = F.when(F.size(missing) > 0, missing).otherwise(rest)
    return df.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0).drop("_known_crime_type", "_known_district")


def validate_basic(df: DataFrame, domains: DataFrame) -> DataFrame:
    """The shorter rules of the live path, all of them reported."""
    df = _known(_known(df, domains, "crime_type", False), domains, "district", False)
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    fields = ["crime_type", "crime_category", "crime_severity", "occurred_date", "occurred_time"]
    numbers = number(F.col("latitude")).isNull() | number(F.col("longitude")).isNull()
    errors = _errors([
        *[(empty(c), f"{c} missing") for c in fields],
        (~F.col("_known_crime_type"), "crime_type not in the history"),
        (~empty("district") & ~F.col("_known_district"), "district not in the history"),
        (numbers, "coordinates not numbers"),
    ])
    return df.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0).drop("_known_crime_type", "_known_district")


def _or(c: str, default: str) -> Column:
    return F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(default)).otherwise(F.col(c))


def normalize_incidents(df: DataFrame) -> DataFrame:
    """Trimmed texts, numbers for the numeric columns, and defaults for absent or empty ones."""
    empty = F.lit("")
    return df.select(
        "incident_id",
        *[F.trim(F.coalesce(F.col(c), empty)).alias(c) for c in ("crime_type", "crime_category", "crime_severity")],
        F.trim("district").alias("district"), F.trim("neighborhood").alias("neighborhood"),
        safe_float(F.col("latitude")).alias("latitude"), safe_float(F.col("longitude")).alias("longitude"),
        safe_int(F.col("estimated_loss")).alias("estimated_loss"), _or("weapon_used", "Unknown").alias("weapon_used"),
        *[_or(c, "No").alias(c) for c in YES_NO_FIELDS],
    )


#: Columns of an anomaly found elsewhere that arriving rows may have.
GIVEN_FLAGS = {"is_anomaly": "boolean", "anomaly_score": "double"}


def incident_record(df: DataFrame, source: str = "batch") -> DataFrame:
    """The record that is stored: defaults for absent values, the loss cut to a whole number.

    Flags of an anomaly that came with the rows are kept beside it.
    """
    def given(c: str, default: str) -> Column:
        return F.coalesce(F.col(c), F.lit(default)).alias(c)

    return df.select(
        "incident_id", given("crime_type", "Unknown"), given("crime_category", "Unknown"),
        given("crime_severity", "Misdemeanor"), "district", "neighborhood",
        safe_float(F.col("latitude")).alias("latitude"), safe_float(F.col("longitude")).alias("longitude"),
        given("occurred_date", ""), "occurred_time", given("weapon_used", "Unknown"),
        *[given(c, "No") for c in YES_NO_FIELDS], safe_int(F.col("estimated_loss")).alias("estimated_loss"),
        F.lit("Low").alias("priority_level"), F.lit(source).alias("source"), F.lit("Received").alias("status"), "submitted_at",
        *[F.col(c).try_cast(kind).alias(c) for c, kind in GIVEN_FLAGS.items() if c in df.columns],
    )


def coverage_bounds(history: DataFrame) -> DataFrame:
    """One row: the least and largest coordinates, 0 if there are none."""
    return history.agg(*[
        F.coalesce(f(c), F.lit(0.0)).alias(f"{name}_{c}")
        for c in ("latitude", "longitude") for name, f in (("min", F.min), ("max", F.max))
    ])


def within_coverage(df: DataFrame, bounds: DataFrame) -> DataFrame:
    """``df`` with ``in_coverage``: coordinates that are numbers and lie within the bounds, the bounds included."""
    inside = F.lit(True)
    for c in ("latitude", "longitude"):
        x = number(F.col(c)) if df.schema[c].dataType.simpleString() == "string" else F.col(c)
        inside = inside & x.between(F.col(f"min_{c}"), F.col(f"max_{c}"))
    out = df.crossJoin(F.broadcast(bounds)).withColumn("in_coverage", F.coalesce(inside, F.lit(False)))
    return out.drop(*bounds.columns)


def location_column(columns: list[str]) -> str:
    """The first place column that is there."""
    for c in ("district", "neighborhood", "location"):
        if c in columns:
            return c
    raise ValueError("no column of places")


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): the cleaned values and ``Unknown``, numbered in ascending order."""
    values = df.select(clean_value(F.col(column)).alias("value"))
    unknown = df.sparkSession.range(1).select(F.lit("Unknown").alias("value"))
    return dense_codes(values.unionByName(unknown), "value", "code")


def stored_codes(df: DataFrame, columns: list[str]) -> dict[str, DataFrame]:
    """The ``label_codes`` of every column as a stored table, from one job over the columns of a stored table.

    Being stored, their size is known when they are joined, so small ones go to the rows and the rows stay in place. Values
    are cleaned once they are distinct.
    """
    if not columns:
        return {}
    codes = written(_numbered(_values(df, columns), columns), "codes")
    return {c: codes.filter(F.col("column") == c).drop("column") for c in columns}


def _values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, given, value): the distinct values of the columns as they stand, and cleaned."""
    parts = [df.select(F.col(c).alias("given")).distinct().select(F.lit(c).alias("column"), "given", clean_value(F.col("given")).alias("value")) for c in columns]
    return functools.reduce(DataFrame.unionByName, parts)


def _numbered(values: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, code) of the cleaned values and ``Unknown``."""
    unknown = F.array(*[F.struct(F.lit(c).alias("column"), F.lit("Unknown").alias("value")) for c in columns])
    found = values.sparkSession.range(1).select(F.inline(unknown)).unionByName(values.select("column", "value"))
    return dense_codes(found, "value", "code", ["column"])


def stored_codes_of_values(df: DataFrame, columns: list[str]) -> tuple[dict[str, DataFrame], dict[str, DataFrame], dict[str, int]]:
    """``stored_codes``; the same by the values as they stand in ``df``, null left out; and the code of ``Unknown`` by column.

    Of the codes only those of ``Unknown``, one a column, come to the driver.
    """
    values = written(_values(df, columns), "values")
    codes = written(_numbered(values, columns), "codes")
    given = written(values.filter("given is not null").join(codes, ["column", "value"]).select("column", F.col("given").alias("value"), "code"), "given")
    unknown = {r["column"]: r["code"] for r in codes.filter("value = 'Unknown'").collect()}
    of = lambda table: {c: table.filter(F.col("column") == c).select("value", "code") for c in columns}
    return of(codes), of(given), unknown


def label_encode(df: DataFrame, codes: DataFrame, column: str) -> DataFrame:
    """``df`` with ``<column>_code``; values that weren't there when the codes were made have that of ``Unknown``."""
    known = codes.withColumnsRenamed({"value": "_value", "code": "_code"})
    unknown = codes.filter("value = 'Unknown'").select(F.col("code").alias("_unknown"))
    out = df.join(known, clean_value(F.col(column)) == F.col("_value"), "left").crossJoin(F.broadcast(unknown))
    return out.withColumn(f"{column}_code", F.coalesce("_code", "_unknown").cast("long")).drop("_value", "_code", "_unknown")


def forward_fill(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """Nulls take the last value before them in the order of a unique column, over the whole table.

    Rows are range-partitioned by the order, filled within a partition, and the partitions' last values are carried on
    over a table with a row per partition.
    """
    from pyspark.sql import Window

    spread = df.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id())
    upto = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = spread.withColumns({c: F.last(c, ignorenulls=True).over(upto) for c in columns})
    ends = spread.groupBy("_part").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_part", *[F.last(c, ignorenulls=True).over(earlier).alias(f"_c_{c}") for c in columns])
    out = local.join(carried, "_part").withColumns({c: F.coalesce(F.col(c), F.col(f"_c_{c}")) for c in columns})
    return out.select(*df.columns)
