"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.shared import written


def components(edges: DataFrame) -> DataFrame:
    """(id, component: smallest id reachable) of every id in ``edges`` (a, b), by alternating large and small stars.

    The number of rounds grows with the logarithm of the longest chain; only whether anything changed is read back.
    """
    edges = written(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges"
    )
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.filter("a != b").distinct(), "large")
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).filter("a != b")
        small = written(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "small")
        done = small.count() == edges.count() and small.join(edges, ["a", "b"], "left_anti").isEmpty()
        edges = small
        if done:
            roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
