"""The few aggregations that most reports are made of.

All group first and rank or divide the groups afterwards, so that no window sees incident rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.expr import rounded


def counts(df: DataFrame, *by: str) -> DataFrame:
    """Rows per combination; rows with a null in it are left out."""
    for c in by:
        df = df.filter(F.col(c).isNotNull())
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def yes_rate(flag: str, digits: int = 1) -> Column:
    """Percentage of Yes among the rows that say anything."""
    return rounded(F.try_divide(F.lit(100.0) * F.count_if(F.col(flag) == "Yes"), F.count(flag)), digits)


def yes_rate_of_all(flag: str, digits: int = 1) -> Column:
    """Percentage of Yes among all rows."""
    return rounded(F.try_divide(F.lit(100.0) * F.count_if(F.col(flag) == "Yes"), F.count(F.lit(1))), digits)


def mean(column: str, digits: int = 2) -> Column:
    return rounded(F.avg(column), digits)


def modes(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """The most frequent value of each column per group, the smallest of equals; nulls don't count."""
    return df.groupBy(*by).agg(*[F.mode(c, deterministic=True).alias(f"{c}_mode") for c in columns])


def shares(df: DataFrame, column: str, digits: int = 1) -> DataFrame:
    """Value, rows and percentage of the rows with a value."""
    n = counts(df, column)
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select(
        column, "n", rounded(F.lit(100.0) * F.col("n") / F.col("total"), digits).alias("share")
    )


def best(df: DataFrame, value: str, name: list[str], by: list[str] = (), highest: bool = True, k: int = 1) -> DataFrame:
    """The ``k`` rows with the highest (lowest) value of each group, equal ones by name; for aggregated rows."""
    order = F.col(value).desc_nulls_last() if highest else F.col(value).asc_nulls_last()
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(order, *name))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def marked(df: DataFrame, value: str, name: list[str], top: str, low: str) -> DataFrame:
    """Two flags for the highest and the lowest of aggregated rows."""
    up = F.row_number().over(Window.partitionBy().orderBy(F.col(value).desc_nulls_last(), *name))
    down = F.row_number().over(Window.partitionBy().orderBy(F.col(value).asc_nulls_last(), *name))
    return df.withColumns({top: up == 1, low: down == 1})
