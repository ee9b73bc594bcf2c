"""Density clusters of places, and groups of districts by profile."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.graph import components
from vigil.ordered import dense_codes
from vigil.shared import written


def _angle(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance in radians of coordinates in radians."""
    a = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    return 2 * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def _touching(boxes: DataFrame, pairs: DataFrame, eps: float, cos_low: float, cos_high: float) -> DataFrame:
    """The pairs (a, b) of cells that hold points no farther apart than ``eps``.

    ``boxes``: (cell, lat, lon, y, x), points with their place in the cell from 0 to 1. Cells are halved again and again,
    and only pairs of parts whose nearest and farthest possible distance lie on both sides of ``eps`` are looked at in
    the next round, so points are never paired with each other.
    """
    def span(low1: str, high1: str, low2: str, high2: str) -> tuple[Column, Column]:
        gap = F.greatest(F.lit(0.0), F.col(low2) - F.col(high1), F.col(low1) - F.col(high2))
        return gap, F.greatest(F.col(high2) - F.col(low1), F.col(high1) - F.col(low2))

    def distance(dlat: Column, dlon: Column, cos: float) -> Column:
        return 2 * F.asin(F.least(F.lit(1.0), F.sqrt(F.pow(F.sin(dlat / 2), 2) + cos * cos * F.pow(F.sin(dlon / 2), 2))))

    linked, depth = None, 0
    open_pairs = pairs.select("a", "b", F.lit(0).cast("long").alias("qa"), F.lit(0).cast("long").alias("qb"))
    while True:
        cut = 1 << depth
        part = F.floor(F.least(F.col("y") * cut, F.lit(cut - 1.0))) * cut + F.floor(F.least(F.col("x") * cut, F.lit(cut - 1.0)))
        half = max(cut // 2, 1)
        up = F.floor(F.least(F.col("y") * half, F.lit(half - 1.0))) * half + F.floor(F.least(F.col("x") * half, F.lit(half - 1.0)))
        level = boxes.groupBy("cell", part.cast("long").alias("q"), (up if depth else F.lit(0)).cast("long").alias("up")).agg(
            F.min("lat").alias("lat0"), F.max("lat").alias("lat1"), F.min("lon").alias("lon0"), F.max("lon").alias("lon1")
        )
        left = level.select(*[F.col(c).alias(f"{c}_a") for c in level.columns])
        right = level.select(*[F.col(c).alias(f"{c}_b") for c in level.columns])
        met = open_pairs.join(left, (F.col("a") == F.col("cell_a")) & (F.col("qa") == F.col("up_a")))
        met = met.join(right, (F.col("b") == F.col("cell_b")) & (F.col("qb") == F.col("up_b")))
        lat_gap, lat_span = span("lat0_a", "lat1_a", "lat0_b", "lat1_b")
        lon_gap, lon_span = span("lon0_a", "lon1_a", "lon0_b", "lon1_b")
        single = (F.col("lat0_a") == F.col("lat1_a")) & (F.col("lon0_a") == F.col("lon1_a")) & (F.col("lat0_b") == F.col("lat1_b")) & (F.col("lon0_b") == F.col("lon1_b"))
        exact = _angle(F.col("lat0_a"), F.col("lon0_a"), F.col("lat0_b"), F.col("lon0_b"))
        near = F.when(single, exact).otherwise(distance(lat_gap, lon_gap, cos_low))
        far = F.when(single, exact).otherwise(distance(lat_span, lon_span, cos_high))
        met = written(met.select("a", "b", F.col("q_a").alias("qa"), F.col("q_b").alias("qb"), near.alias("near"), far.alias("far")), "boxes")
        now = met.filter(F.col("far") <= eps).select("a", "b").distinct()
        linked = written(now if linked is None else linked.unionByName(now), "linked")
        open_pairs = met.filter((F.col("near") <= eps) & (F.col("far") > eps)).join(linked, ["a", "b"], "left_anti").select("a", "b", "qa", "qb")
        open_pairs = written(open_pairs, "open")
        if open_pairs.isEmpty():
            return linked
        depth += 1


def dbscan(df: DataFrame, eps: float, min_points: int = 5, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """(lat, lon, n, cluster) of the distinct places: density clusters on the sphere, ``eps`` in radians, noise -1.

    Rows on one place count as so many points, a point itself included. Cells are so small that a full one holds core
    points only; sparse cells hold fewer than ``min_points`` rows, which bounds their comparisons. A border place goes
    to the cluster with the lowest number.
    """
    there = df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    points = there.groupBy(F.col(lat).alias("lat_deg"), F.col(lon).alias("lon_deg")).agg(F.count(F.lit(1)).alias("n"))
    points = written(points.withColumns({"lat": F.radians("lat_deg"), "lon": F.radians("lon_deg")}), "points")
    ends = points.agg(F.min("lat"), F.max("lat"), F.min(F.abs("lat")), F.max(F.abs("lat")), F.min("lon")).first()
    empty = points.select("lat_deg", "lon_deg", "n").withColumn("cluster", F.lit(-1).cast("long")).limit(0)
    if ends[0] is None:
        return empty
    cos_high, cos_low = math.cos(ends[2]), max(math.cos(ends[3]), 1e-6)
    high, wide = eps / math.sqrt(2) * 0.999999, eps / math.sqrt(2) * 0.999999 / cos_high
    reach_y = math.ceil(eps / high)
    reach_x = math.ceil(2 * math.asin(min(1.0, math.sin(min(eps, math.pi) / 2) / cos_low)) / wide)
    row, column = (F.col("lat") - ends[0]) / high, (F.col("lon") - ends[4]) / wide
    width = 1 << 31
    placed = points.withColumns({"cy": F.floor(row), "cx": F.floor(column)}).withColumns({
        "cell": F.col("cy") * width + F.col("cx"), "y": row - F.floor(row), "x": column - F.floor(column),
    })
    weights = placed.groupBy("cell").agg(F.sum("n").alias("weight"), F.min("cy").alias("ccy"), F.min("cx").alias("ccx"))
    weights = written(weights.withColumn("full", F.col("weight") >= min_points), "cells")
    placed = written(placed.join(weights.select("cell", "full"), "cell"), "placed")
    shifts = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(-reach_y, reach_y + 1) for dx in range(-reach_x, reach_x + 1)])
    around = lambda df: df.withColumn("_s", F.explode(shifts)).withColumn("near_cell", (F.col("cy") + F.col("_s.dy")) * width + F.col("cx") + F.col("_s.dx"))
    other = placed.select(F.col("cell").alias("near_cell"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.col("n").alias("n2"), F.col("lat_deg").alias("lat_deg2"), F.col("lon_deg").alias("lon_deg2"))
    within = _angle(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")) <= eps
    sparse = around(placed.filter("not full")).join(other, "near_cell").filter(within)
    reached = sparse.groupBy("lat_deg", "lon_deg").agg(F.sum("n2").alias("reach"))
    core = placed.join(reached.withColumnsRenamed({"lat_deg": "_a", "lon_deg": "_b"}), (F.col("lat_deg") == F.col("_a")) & (F.col("lon_deg") == F.col("_b")), "left")
    core = written(core.withColumn("core", F.col("full") | (F.coalesce("reach", F.lit(0)) >= min_points)).drop("_a", "_b", "reach"), "core")
    boxes = core.filter("core").select("cell", "lat", "lon", "y", "x")
    cells = core.filter("core").select("cell", "cy", "cx").distinct()
    pairs = around(cells).join(cells.select(F.col("cell").alias("near_cell")), "near_cell").filter("cell < near_cell")
    pairs = written(pairs.select(F.col("cell").alias("a"), F.col("near_cell").alias("b")), "pairs")
    joined = components(_touching(boxes, pairs, eps, cos_low, cos_high))
    labels = cells.select("cell").join(joined, F.col("cell") == F.col("id"), "left").select("cell", F.coalesce("component", "cell").alias("component"))
    labels = written(labels, "labels")
    numbers = dense_codes(labels, "component", "cluster")
    labels = written(labels.join(numbers, "component").select("cell", "cluster"), "clusters")
    cores = core.filter("core").join(labels, "cell").select("lat_deg", "lon_deg", "n", "cluster")
    rest = core.filter("not core")
    core_points = core.filter("core").join(labels, "cell").select(F.col("cell").alias("near_cell"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), "cluster")
    border = around(rest).join(core_points, "near_cell").filter(within).groupBy("lat_deg", "lon_deg").agg(F.min("cluster").alias("cluster"))
    border = border.withColumnsRenamed({"lat_deg": "_a", "lon_deg": "_b"})
    rest = rest.join(border, (F.col("lat_deg") == F.col("_a")) & (F.col("lon_deg") == F.col("_b")), "left")
    rest = rest.select("lat_deg", "lon_deg", "n", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
    return cores.unionByName(rest)


def _ward(x: np.ndarray, groups: int) -> np.ndarray:
    """Merges the two clusters whose union adds least to the sum of squares, until ``groups`` are left."""
    members = [[i] for i in range(len(x))]
    centres = [row for row in x]
    while len(members) > groups:
        sizes = np.array([len(m) for m in members], float)
        c = np.array(centres)
        cost = ((c[:, None, :] - c[None, :, :]) ** 2).sum(axis=2) * (sizes[:, None] * sizes[None, :]) / (sizes[:, None] + sizes[None, :])
        cost[np.tril_indices(len(c))] = np.inf
        i, j = np.unravel_index(np.argmin(cost), cost.shape)
        centres[i] = (c[i] * sizes[i] + c[j] * sizes[j]) / (sizes[i] + sizes[j])
        members[i] = members[i] + members[j]
        del members[j], centres[j]
    out = np.empty(len(x), int)
    for g, m in enumerate(sorted(members, key=min)):
        out[m] = g
    return out


def district_groups(df: DataFrame, features: list[str], groups: int = 3, by: str = "district", most: int = 2000) -> DataFrame:
    """(district, group): Ward clusters of the districts' mean features.

    The profiles are one row per district; more than ``most`` of them are refused, since all are compared in one task.
    """
    profiles = written(df.filter(F.col(by).isNotNull()).groupBy(F.col(by).alias("district")).agg(*[F.avg(c).alias(c) for c in features]), "profiles")
    if profiles.count() > most:
        raise ValueError(f"more than {most} groups to compare")

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("district")
        return pd.DataFrame({"district": rows["district"].to_numpy(), "group": _ward(rows[features].to_numpy(float), groups)})

    return profiles.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(merge, "district string, group long")


def group_members(df: DataFrame, groups: DataFrame) -> DataFrame:
    """Per group its districts' names, their number and their incidents."""
    totals = df.filter("district is not null").groupBy("district").agg(F.count(F.lit(1)).alias("n"))
    return totals.join(groups, "district", "left").groupBy("group").agg(
        F.concat_ws(", ", F.sort_array(F.collect_list("district"))).alias("districts"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("n")
    )


def zone_summary(zoned: DataFrame) -> DataFrame:
    """Per zone: incidents, main crime, main district, mean severity code."""
    return zoned.groupBy("zone").agg(
        F.count(F.lit(1)).alias("n"), F.mode("crime_type", deterministic=True).alias("main_crime"),
        F.mode("district", deterministic=True).alias("district"), F.round(F.avg("crime_severity_code"), 4).alias("severity"),
    )


def dbscan_summary(df: DataFrame, clustered: DataFrame) -> DataFrame:
    """Clusters, noise rows, the largest cluster and its main district; no cluster is an answer too."""
    rows = df.join(clustered.select("lat_deg", "lon_deg", "cluster"), (F.col("latitude") == F.col("lat_deg")) & (F.col("longitude") == F.col("lon_deg")))
    per = rows.filter("cluster >= 0").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.mode("district", deterministic=True).alias("district"))
    top = F.min_by(F.struct("cluster", "n", "district"), F.struct((-F.col("n")).alias("v"), "cluster"))
    noise = rows.agg(F.count_if(F.col("cluster") < 0).alias("noise"))
    one = per.agg(F.count(F.lit(1)).alias("clusters"), top.alias("top"))
    return one.crossJoin(F.broadcast(noise)).select(
        "clusters", "noise", F.col("top.cluster").alias("largest"), F.col("top.n").alias("largest_n"), F.col("top.district").alias("largest_district")
    )
