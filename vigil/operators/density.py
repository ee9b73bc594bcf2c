"""Density clusters in scaled feature space of any dimension (Euclidean distance)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.graph import components
from vigil.ordered import dense_codes
from vigil.shared import written


def neighbouring_cells(cells: DataFrame, width: int) -> DataFrame:
    """(a, b): the pairs of cells (cell: its whole coordinates as an array) that may hold points within the reach, itself included.

    A cell's side is the reach over the square root of ``width`` dimensions. Pairs grow by a dimension at a time: an
    offset leaves a gap of its whole cells in between, and pairs whose squared gaps exceed the reach are dropped at once,
    so neither the offsets of all dimensions nor the empty cells are ever listed.
    """
    reach = math.isqrt(width) + 1
    pairs = cells.sparkSession.range(1).select(F.array().cast("array<long>").alias("a"), F.array().cast("array<long>").alias("b"), F.lit(0).cast("long").alias("gap"))
    for at in range(width):
        known = cells.select(F.slice("cell", 1, at).alias("stem"), F.get("cell", F.lit(at)).alias("value")).distinct()
        left = pairs.join(known.select(F.col("stem").alias("a"), F.col("value").alias("from")), "a")
        left = left.withColumn("offset", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
        between = F.greatest(F.abs("offset") - 1, F.lit(0))
        left = left.withColumns({"gap": F.col("gap") + between * between, "to": F.col("from") + F.col("offset")}).filter(F.col("gap") <= width)
        met = left.join(known.select(F.col("stem").alias("b"), F.col("value").alias("to")), ["b", "to"])
        pairs = met.select(F.concat("a", F.array("from")).alias("a"), F.concat("b", F.array("to")).alias("b"), "gap")
        pairs = written(pairs, "cell-pairs")
    return pairs.select("a", "b")


def _boxes(points: DataFrame, names: list[str], depth: int) -> DataFrame:
    """(cell, box, above, extent and number of points) of the cells' parts after ``depth`` halvings of every side."""
    def part(level: int) -> Column:
        cut = float(1 << level)
        return F.array(*[F.floor(F.least(F.col(f"y_{c}") * cut, F.lit(cut - 1))) for c in names])

    above = part(depth - 1) if depth else F.array().cast("array<long>")
    return points.groupBy("cell", part(depth).alias("box"), above.alias("above")).agg(
        F.sum("n").alias("n"), *[f(f"x_{c}").alias(f"{f.__name__}_{c}") for c in names for f in (F.min, F.max)]
    )


def _distances(names: list[str], a: str = "a", b: str = "b") -> tuple[Column, Column]:
    """The squares of the least and the largest distance of two boxes by their extents."""
    low = lambda c, s: F.col(f"min_{c}_{s}")
    high = lambda c, s: F.col(f"max_{c}_{s}")
    gaps = [F.greatest(F.lit(0.0), low(c, b) - high(c, a), low(c, a) - high(c, b)) for c in names]
    spans = [F.greatest(high(c, b) - low(c, a), high(c, a) - low(c, b)) for c in names]
    return sum((g * g for g in gaps), F.lit(0.0)), sum((s * s for s in spans), F.lit(0.0))


def _side(df: DataFrame, names: list[str], side: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{c}_{side}") for c in ("cell", "box", "above", "n", *[f"{f}_{x}" for x in names for f in ("min", "max")])])


def touching(left: DataFrame, right: DataFrame, pairs: DataFrame, names: list[str], eps: float) -> DataFrame:
    """The pairs (a, b) of cells of which a point of a and one of b are no farther apart than ``eps``.

    Points: (cell, n, x_.., y_..: the place in the cell from 0 to 1). Cells are halved in all dimensions again and again;
    only parts whose least and largest distance lie on both sides of ``eps`` are looked at in the next round, and a pair
    that is found is done.
    """
    linked, depth, none = None, 0, F.array().cast("array<long>")
    open_pairs = pairs.select("a", "b", none.alias("box_of_a"), none.alias("box_of_b"))
    least, most = _distances(names)
    while True:
        met = open_pairs.join(
            _side(_boxes(left, names, depth), names, "a"), (F.col("a") == F.col("cell_a")) & (F.col("box_of_a") == F.col("above_a"))
        ).join(_side(_boxes(right, names, depth), names, "b"), (F.col("b") == F.col("cell_b")) & (F.col("box_of_b") == F.col("above_b")))
        met = met.filter(least <= eps * eps).select("a", "b", "box_a", "box_b", (most <= eps * eps).alias("within"))
        met = written(met, "boxes")
        now = met.filter("within").select("a", "b").distinct()
        linked = written(now if linked is None else linked.unionByName(now), "linked")
        rest = met.filter("not within").join(linked, ["a", "b"], "left_anti")
        open_pairs = written(rest.select("a", "b", F.col("box_a").alias("box_of_a"), F.col("box_b").alias("box_of_b")), "open")
        if open_pairs.isEmpty():
            return linked
        depth += 1


def _points_around(points: DataFrame, others: DataFrame, pairs: DataFrame, names: list[str], eps: float, enough: int) -> DataFrame:
    """(id, reach): for each point the number of others within ``eps``, or some number of at least ``enough``.

    Parts of neighbouring cells that lie within the reach as a whole count at once; a point with enough is done.
    """
    depth, total = 0, None
    own = [F.col(f"x_{c}").alias(f"{f}_{c}_a") for c in names for f in ("min", "max")]
    open_boxes = points.join(pairs.select(F.col("a").alias("cell"), "b"), "cell").select("id", "b", F.array().cast("array<long>").alias("box"), *own)
    least, most = _distances(names)
    while True:
        parts = _side(_boxes(others, names, depth), names, "b")
        met = open_boxes.join(parts, (F.col("b") == F.col("cell_b")) & (F.col("box") == F.col("above_b"))).filter(least <= eps * eps)
        met = met.select("id", "b", "box_b", "n_b", (most <= eps * eps).alias("within"), *[f"{f}_{c}_a" for c in names for f in ("min", "max")])
        met = written(met, "met")
        inside = met.filter("within").groupBy("id").agg(F.sum("n_b").alias("reach"))
        total = inside if total is None else total.unionByName(inside).groupBy("id").agg(F.sum("reach").alias("reach"))
        total = written(total, "reach")
        rest = met.filter("not within").join(total.filter(F.col("reach") >= enough), "id", "left_anti")
        open_boxes = written(rest.drop("n_b", "within").withColumnRenamed("box_b", "box"), "open")
        if open_boxes.isEmpty():
            return total
        depth += 1


def density_clusters(df: DataFrame, columns: list[str], eps: float = 0.5, min_points: int = 5) -> DataFrame:
    """(columns, n, cluster) of the distinct points: density clusters of the Euclidean distance, noise -1.

    Rows on one point count as so many points, a point itself included; rows with a null, or no number, have none. A cell
    is so small that ``min_points`` rows in it are core points; the others' neighbours are counted by parts of cells, and
    whether cells touch is decided by parts as well, so points are never paired. A border point goes to the cluster
    with the lowest number.
    """
    there = df
    for c in columns:
        there = there.filter(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    points = there.groupBy(*[(F.col(c).cast("double") + 0.0).alias(c) for c in columns]).agg(F.count(F.lit(1)).alias("n"))
    points = written(points.withColumn("id", F.monotonically_increasing_id()), "points")
    names = [str(i) for i in range(len(columns))]
    low = points.agg(*[F.min(c) for c in columns]).first()
    result = [*columns, "n", "cluster"]
    if low[0] is None:
        return points.withColumn("cluster", F.lit(-1).cast("long")).select(*result)
    side = eps / math.sqrt(len(columns)) * 0.999999
    at = {i: (F.col(c) - v) / side for i, c, v in zip(names, columns, low, strict=True)}
    placed = points.select(
        "id", "n", *columns, F.array(*[F.floor(x) for x in at.values()]).alias("cell"), *[F.col(c).alias(f"x_{i}") for i, c in zip(names, columns)],
        *[(x - F.floor(x)).alias(f"y_{i}") for i, x in at.items()],
    )
    weights = placed.groupBy("cell").agg((F.sum("n") >= min_points).alias("full"))
    placed = written(placed.join(weights, "cell"), "placed")
    pairs = neighbouring_cells(placed.select("cell").distinct(), len(columns))
    reached = _points_around(placed.filter("not full"), placed, pairs, names, eps, min_points)
    core = placed.join(reached, "id", "left").withColumn("core", F.col("full") | (F.coalesce("reach", F.lit(0)) >= min_points)).drop("reach")
    core = written(core, "core")
    cores = core.filter("core")
    cells = written(cores.select("cell").distinct(), "core-cells")
    near = pairs.filter("a < b").join(cells.withColumnRenamed("cell", "a"), "a", "left_semi").join(cells.withColumnRenamed("cell", "b"), "b", "left_semi")
    joined = components(touching(cores, cores, written(near, "near"), names, eps))
    labels = cells.join(joined, F.col("cell") == F.col("id"), "left").select("cell", F.coalesce("component", "cell").alias("component"))
    labels = written(labels, "labels")
    numbers = dense_codes(labels, "component", "cluster")
    labels = written(labels.join(numbers, "component").select("cell", "cluster"), "clusters")
    # A point that is no core is a cell of its own, named by its number behind the cell.
    rest = written(core.filter("not core").withColumns({"home": F.col("cell"), "cell": F.concat("cell", F.array("id"))}), "rest")
    around = rest.join(pairs, F.col("home") == F.col("a")).join(cells.withColumnRenamed("cell", "b"), "b", "left_semi").select(F.col("cell").alias("a"), "b")
    border = touching(rest, cores, written(around, "around"), names, eps).join(labels.withColumnRenamed("cell", "b"), "b")
    border = border.groupBy(F.col("a").alias("cell")).agg(F.min("cluster").alias("cluster"))
    rest = rest.join(border, "cell", "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1)))
    return cores.join(labels, "cell").select(*result).unionByName(rest.select(*result))
