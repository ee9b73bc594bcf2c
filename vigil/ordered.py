"""Ranks and running sums over a whole order without putting a large group into one task.

Rows are dealt into buckets along the order; per-bucket totals are summed over the (few) buckets, and a window
inside each bucket does the rest. With about sqrt(n) buckets both windows stay near sqrt(n) rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(
    df: DataFrame, group: list[str], bucket: str, order: list[Column], value: str, start: str, rank: str
) -> DataFrame:
    """Adds ``start`` (sum of ``value`` over the group's earlier rows) and ``rank`` (their number).

    ``bucket`` is an integer column that grows with the order, bounded in rows; groups may be null.
    """
    keys = [*group, bucket]
    totals = df.groupBy(*keys).agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *[F.col(k).alias(f"_t_{k}") for k in keys],
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_sum_before"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
    )
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_t_{k}"))
    inside = Window.partitionBy(*keys).orderBy(*order)
    local = df.withColumns({
        "_local": F.coalesce(F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_row": F.row_number().over(inside) - 1,
    })
    return (
        local.join(totals, on)
        .withColumns({start: F.col("_sum_before") + F.col("_local"), rank: F.col("_rows_before") + F.col("_row")})
        .drop("_local", "_row", "_sum_before", "_rows_before", *[f"_t_{k}" for k in keys])
    )


def dense_codes(df: DataFrame, key: str, code: str, by: list[str] = ()) -> DataFrame:
    """Distinct values of ``key`` numbered 0, 1, ... in ascending order (nulls first), range-partitioned, no single task.

    With ``by``, whose columns hold no null, each group has numbers of its own.
    """
    spread = df.select(*by, key).distinct().repartitionByRange(*[F.col(c) for c in (*by, key)]).withColumn("_part", F.spark_partition_id())
    counts = spread.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*by, "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(key)) - 1
    return spread.withColumn("_row", local).join(counts, [*by, "_part"]).select(*by, key, (F.col("_before") + F.col("_row")).alias(code))


def quantile(df: DataFrame, column: str, share: float, name: str) -> DataFrame:
    """One row: the value at that share of the sorted non-null rows, interpolated, from counts per value."""
    n = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    spread = n.repartitionByRange(F.col(column)).withColumn("_part", F.spark_partition_id())
    parts = spread.groupBy("_part").agg(F.sum("_n").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(Window.partitionBy()).alias("_all")
    )
    upto = F.sum("_n").over(Window.partitionBy("_part").orderBy(column))
    placed = spread.withColumn("_upto", upto).join(parts, "_part").withColumn("_last", F.col("_before") + F.col("_upto") - 1)
    at = (F.col("_all") - 1) * F.lit(float(share))
    placed = placed.select(column, "_last", (F.col("_last") - F.col("_n") + 1).alias("_first"), at.alias("_at"))
    low, high = F.floor("_at"), F.ceil("_at")
    value = lambda rank: F.max(F.when(rank.between(F.col("_first"), F.col("_last")), F.col(column).cast("double")))
    both = placed.agg(value(low).alias("_low"), value(high).alias("_high"), F.max(F.col("_at") - low).alias("_part"))
    return both.select((F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")).alias(name))


def quantile_by_step(df: DataFrame, column: str, share: float, name: str, step: float) -> DataFrame:
    """``quantile`` of finite doubles: rows are counted per multiple of ``step``, and only those of the one or two multiples
    that hold the place are put in order. ``df`` is read twice.

    A range of values of many thousand steps or fewer and rows spread over it keep both windows small.
    """
    rows = df.filter(F.col(column).isNotNull()).select(F.col(column), F.floor(F.col(column) / step).alias("_step"))
    steps = rows.groupBy("_step").agg(F.count(F.lit(1)).alias("_rows"))
    steps = steps.withColumns({"_upto": F.sum("_rows").over(Window.orderBy("_step")), "_all": F.sum("_rows").over(Window.partitionBy())})
    at = (F.col("_all") - 1) * F.lit(float(share))
    steps = steps.select(F.col("_step").alias("_held"), (F.col("_upto") - F.col("_rows")).alias("_before"), "_upto", at.alias("_at"))
    low, high = F.floor("_at"), F.ceil("_at")
    holds = lambda rank: (rank >= F.col("_before")) & (rank < F.col("_upto"))
    held = steps.filter(holds(low) | holds(high)).drop("_upto")
    few = rows.join(F.broadcast(held), F.col("_step") == F.col("_held")).groupBy("_step", "_before", "_at", column).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_step").orderBy(column))
    placed = few.withColumn("_last", F.col("_before") + upto - 1).withColumn("_first", F.col("_last") - F.col("_n") + 1)
    value = lambda rank: F.max(F.when(rank.between(F.col("_first"), F.col("_last")), F.col(column)))
    both = placed.agg(value(low).alias("_low"), value(high).alias("_high"), F.max(F.col("_at") - low).alias("_part"))
    return both.select((F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")).alias(name))
