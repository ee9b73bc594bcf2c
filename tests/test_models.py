"""Models held against brute force on small tables, and against their own definition on the given ones."""

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from vigil import registry
from vigil.operators import anomaly, cleaning, clusters, learning, live
from vigil.plans.risk import CHAIN_COLUMNS
from vigil.sources.incidents import history

QUERIES = registry.queries()
SF = f"{DATA}/sf0.001"


def cart(x, y, depth):
    """The leaf's (yes, no) of each row, by the same rule over all splits."""
    out = [None] * len(x)

    def grow(rows, level):
        yes, no = int(y[rows].sum()), int((1 - y[rows]).sum())
        best = None
        if level < depth and yes and no:
            for f in range(x.shape[1]):
                values = np.unique(x[rows, f])
                for a, b in zip(values, values[1:]):
                    left = y[rows][x[rows, f] <= a]
                    ly, ln = int(left.sum()), int((1 - left).sum())
                    ry, rn = yes - ly, no - ln
                    score = (ly * ly + ln * ln) / (ly + ln) + (ry * ry + rn * rn) / (ry + rn)
                    if best is None or score > best[0]:
                        best = (score, f, (a + b) / 2)
        if best is None:
            for r in rows:
                out[r] = (yes, no)
            return
        inside = x[rows, best[1]] <= best[2]
        grow(rows[inside], level + 1)
        grow(rows[~inside], level + 1)

    grow(np.arange(len(x)), 0)
    return out


@pytest.mark.parametrize("depth", [1, 3, 15])
def test_tree_against_brute_force(spark, depth):
    rng = np.random.default_rng(depth)
    x = np.stack([rng.integers(0, 6, 250), rng.integers(0, 3, 250) * 2, rng.integers(0, 9, 250)], axis=1)
    y = ((x[:, 0] > 2) ^ (x[:, 2] == 4) ^ (rng.random(250) < 0.15)).astype(int)
    df = spark.createDataFrame([(i, *map(int, r), "Yes" if v else "No") for i, (r, v) in enumerate(zip(x, y))], "i int, a int, b int, c int, y string")
    out = {r.i: (r.prediction, r.confidence) for r in learning.decision_tree(df, df, ["a", "b", "c"], "y", depth).collect()}
    for i, (yes, no) in enumerate(cart(x, y, depth)):
        assert out[i] == ("Yes" if yes > no else "No", pytest.approx(100 * max(yes, no) / (yes + no), abs=0.051))


def test_tree_places_unknown_vectors(spark):
    train = spark.createDataFrame([(0, "No"), (10, "Yes"), (10, "Yes")], "a int, y string")
    rows = spark.createDataFrame([(-5,), (4,), (5,), (6,), (99,), (None,)], "a int")
    out = {r.a: r.prediction for r in learning.decision_tree(train, rows, ["a"], "y").collect()}
    assert out == {-5: "No", 4: "No", 5: "No", 6: "Yes", 99: "Yes", None: None}


def test_zones_have_the_nearest_centre_and_the_least_cost(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(-6, 6, (300, 2))  # no clear clusters, so that starts end differently
    df = spark.createDataFrame([(float(a), float(b)) for a, b in x] + [(None, 1.0)], "a double, b double")
    points = df.dropna().withColumn("w", F.lit(1)).persist()
    several = learning.kmeans_centres(points, ["a", "b"], "w", 5, 8, 42, 100)
    assert len(several) == 8 and several[0][0] == min(c for c, _ in several) < max(c for c, _ in several)
    for cost, centres in several:
        squared = ((x[:, None, :] - np.array(centres)[None]) ** 2).sum(axis=2)
        assert cost == pytest.approx(squared.min(axis=1).sum())
        near = squared.argmin(axis=1)
        assert all(np.allclose(x[near == k].mean(axis=0), c, atol=1e-6) for k, c in enumerate(centres))  # no step would move them
    zones = learning.kmeans_zones(df, ["a", "b"], 5, starts=8).collect()
    assert [r.zone for r in zones if r.a is None] == [-1]
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    by = {(r.a, r.b): r.zone for r in zones if r.a is not None}
    label = np.array([by[tuple(map(float, p))] for p in x])
    centres = np.array([z[label == k].mean(axis=0) for k in range(5)])
    assert (((z[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1) == label).all()


def test_zones_of_few_points(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (5.0,)], "a double")
    assert sorted(r.zone for r in learning.kmeans_zones(df, ["a"], 5).collect()) == [0, 0, 1]
    assert {r.zone for r in learning.kmeans_zones(spark.createDataFrame([(None,)], "a double"), ["a"]).collect()} == {-1}


def test_zone_summary_and_its_finding(spark):
    zoned = QUERIES["kmeans_zones"](spark, SF).persist()
    total = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert zoned.count() == total and {r.zone for r in zoned.select("zone").distinct().collect()} == set(range(5))
    sizes = {r.zone: r["count"] for r in zoned.groupBy("zone").count().collect()}
    summary = {r.zone: r.n for r in QUERIES["zone_summary"](spark, SF).collect()}
    assert summary == sizes
    text = " ".join(str(v) for v in QUERIES["insight_hotspot"](spark, SF).first())
    assert str(max(sizes.values())) in text.replace(",", "")


def test_regression_leaves_nothing_along_its_features(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    x[:, 2] = 4
    y = 3 + 2 * x[:, 0] - x[:, 1] + rng.normal(size=400)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, y double")
    out, weights = learning.linear_regression(df, df, ["a", "b", "c"], "y")
    rest = np.array([(r.a, r.b, r.y - r.prediction) for r in out.collect()])
    assert abs(rest[:, 2].mean()) < 1e-3 and np.abs(rest[:, :2].T @ rest[:, 2] / 400).max() < 1e-3
    z = (x[:, :2] - x[:, :2].mean(axis=0)) / x[:, :2].std(axis=0)
    assert weights["c"] == 0 and [weights["a"], weights["b"]] == pytest.approx(np.linalg.lstsq(z, y - y.mean())[0].tolist())
    same, _ = learning.linear_regression(df.withColumn("a2", F.col("a") * 2), df.withColumn("a2", F.col("a") * 2), ["a", "a2", "b"], "y")
    assert same.join(out.select("y", F.col("prediction").alias("p")), "y").filter("abs(prediction - p) > 0.001").count() == 0
    assert learning.linear_regression(df.limit(0), df, ["a"], "y")[0].filter("prediction is not null").count() == 0


def test_naive_bayes_needs_no_shuffle_of_rows(spark):
    plan = QUERIES["gaussian_nb"](spark, SF)
    rows = plan.select("incident_id").count()
    assert rows == plan.select("incident_id").distinct().count()
    model = spark.createDataFrame([("No", 0.5, 0.0, 1.0), ("Yes", 0.5, 3.0, 1.0)], "label string, prior double, mean_x double, var_x double")
    df = spark.createDataFrame([(i, i / 10) for i in range(40)], "k int, x double")
    out = learning.predict_nb(df, model, ["x"], "k")
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in text
    assert all((r.prediction == "Yes") == (r.k >= 15) for r in out.collect())


def test_every_row_is_as_likely_in_a_tree(spark):
    df = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 2).cast("double").alias("a"))
    taken = {}
    real, seen = anomaly.written, []
    try:
        anomaly.written = lambda d, name, *x: seen.append(out := real(d, name, *x)) or out
        anomaly.train_isolation_forest(df, ["a"], "k", trees=120, sample=128)
    finally:
        anomaly.written = real
    drawn = seen[-2]
    per_tree = [r["count"] for r in drawn.groupBy("tree").count().collect()]
    assert len(per_tree) == 120 and min(per_tree) >= 128 and 240 < np.mean(per_tree) < 275  # share is 256 of 3000
    for r in drawn.groupBy("_key").count().collect():
        taken[r["_key"]] = r["count"]
    counts = np.array([taken.get(k, 0) for k in range(3000)])
    expected = 120 * 256 / 3000
    assert abs(counts.mean() - expected) < 0.4
    assert counts.var() == pytest.approx(expected * (1 - 256 / 3000), rel=0.15)  # as of independent draws
    by_tree = np.array(per_tree)
    assert by_tree.std() < 3 * np.sqrt(256)


def test_briefing_has_a_row_per_pattern(spark):
    out = QUERIES["briefing"](spark, SF).persist()
    keys = ["crime_type", "district", "time_category", "weapon_used"]
    assert out.count() == out.select(*keys).distinct().count() > 0
    assert out.filter("risk not between 0 and 100 or gang not in ('Yes', 'No') or gang_confidence not between 50 and 100").count() == 0
    assert out.filter("arrest_chance not between 0 and 1").count() == 0


def test_cluster_summary_counts(spark):
    rows = [(40.0, -74.0, "A")] * 30 + [(40.5, -74.5, "B")] * 50 + [(50.0, 10.0, "C")]
    df = spark.createDataFrame(rows, "latitude double, longitude double, district string")
    out = clusters.dbscan_summary(df, clusters.dbscan(df, 0.0001, 10)).first()
    assert (out.clusters, out.noise, out.largest_n, out.largest_district) == (2, 1, 50, "B")
    none = clusters.dbscan_summary(df, clusters.dbscan(df, 0.0001, 1000)).first()
    assert (none.clusters, none.noise, none.largest) == (0, 81, None)


def test_nearest_rows_with_a_far_outlier(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 40, (200, 3))
    x[0] = (10**6, 5, 5)
    y = rng.random(200) < 0.5
    asked = np.concatenate([x[:60], rng.integers(-20, 60, (60, 3)), [[10**6 - 7, 0, 0], [500_000, 3, 3]]])
    train = spark.createDataFrame([(*map(int, r), bool(v)) for r, v in zip(x, y)], "a int, b int, c int, y boolean")
    out = {(r.a, r.b, r.c): r.probability for r in learning.knn_probability(
        train, spark.createDataFrame([tuple(map(int, r)) for r in asked], "a int, b int, c int"), ["a", "b", "c"], F.col("y")).collect()}
    assert len(out) == len(np.unique(asked, axis=0))
    for q in asked:
        squared = ((x - q) ** 2).sum(axis=1)
        votes = found = 0
        for d in np.unique(squared):
            tied = y[squared == d]
            votes += min(len(tied), max(5 - found, 0)) * tied.mean()
            found += len(tied)
        assert out[tuple(map(int, q))] == pytest.approx(votes / 5, abs=1e-6)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_codes_go_to_the_rows_and_no_row_moves(spark):
    rows = [(i, "ab c"[i % 4], None if i % 3 else "x", i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a string, b string, n int").repartition(3)
    out = learning.prepare_features(df, ["a", "b"], ["n"])
    plan = _plan(out)
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan and "Window" not in plan  # neither for codes nor for joins
    a = {"Unknown": 0, "a": 1, "b": 2, "c": 3}
    b = {"Unknown": 0, "x": 1}
    assert {r.id: (r.a_code, r.b_code, r.n) for r in out.collect()} == {
        i: (a[x.strip() or "Unknown"], b[y or "Unknown"], float(n)) for i, x, y, n in rows}


def test_codes_of_several_columns_are_those_of_each(spark):
    df = spark.createDataFrame([("b", "10"), (" z", "9"), (None, "nan"), ("b", "")], "c string, d string")
    several = cleaning.stored_codes(df, ["c", "d"])
    for c in ("c", "d"):
        assert sorted(several[c].collect()) == sorted(cleaning.label_codes(df, c).collect())
    assert cleaning.stored_codes(df, []) == {}


def test_the_tree_goes_to_the_rows(spark):
    df = spark.createDataFrame([(i, i % 5, "Yes" if i % 5 > 2 else "No") for i in range(60)], "id long, a long, y string")
    out = learning.decision_tree(df, df, ["a"], "y")
    assert "Exchange hashpartitioning" not in _plan(out) and "SortMergeJoin" not in _plan(out)
    assert all(r.prediction == r.y for r in out.collect())


def test_points_of_zones_are_spread_and_passes_bring_sums(spark, monkeypatch):
    stored = {}
    kept = learning.written
    monkeypatch.setattr(learning, "written", lambda df, name: stored.setdefault(name, kept(df, name)))
    df = spark.createDataFrame([(float(i % 37), float(i % 41)) for i in range(1517)], "a double, b double")
    learning.kmeans_zones(df, ["a", "b"], 5, starts=3).count()
    assert len(stored["points"].inputFiles()) > 1  # one file would be one task in every pass
    assert stored["points"].count() == 1517


def test_zones_where_a_column_is_no_number(spark):
    df = spark.createDataFrame([(float(i % 7), float("nan") if i == 3 else 1.0) for i in range(20)], "a double, b double")
    assert {r.zone for r in learning.kmeans_zones(df, ["a", "b"], 3).collect()} == {0}


def test_paths_are_those_of_a_walk_down_each_tree():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3)).round(1)
    trees = [np.array(anomaly._grow(x[rng.choice(300, 40)], rng, 6), float) for _ in range(9)] + [np.array(anomaly._grow(x[:1], rng, 6), float)]
    x[::9, 1], x[1::9, 0], x[2::9, 2] = np.nan, np.inf, -np.inf

    def walk(row, tree, at=0):
        feature, threshold, left, right, path = tree[at]
        return path if feature < 0 else walk(row, tree, int(left if row[int(feature)] <= threshold else right))

    even = [anomaly._even(t, anomaly._depth_of(t)) for t in trees]
    assert anomaly._path_lengths(x.T.copy(), even) == pytest.approx([sum(walk(r, t) for t in trees) for r in x])


def test_the_history_of_the_chain_is_read_once(spark, monkeypatch):
    stored = []
    kept = live.written
    monkeypatch.setattr(live, "written", lambda df, name: stored.append(name) or kept(df, name))
    rows = history(spark, SF, CHAIN_COLUMNS)
    known = live.knowledge(rows)
    assert stored[0] == "history" and "Join" not in _plan(known.history)
    assert known.history.count() == rows.count()
