import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.functions import expr as e
from vigil.graph import components
from vigil.operators import anomaly, cleaning, clusters, dashboard, hotspots, learning, records, risk
from vigil.ordered import dense_codes, quantile, quantile_by_step, running_sum

INCIDENT = "district string, occurred_date date, crime_severity string, weapon_used string, domestic_related string, gang_related string, estimated_loss int"


def incidents(spark, rows):
    return spark.createDataFrame(rows, INCIDENT)


def one(spark, kind, value, f):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("text, value", [
    ("1d", None), ("1_000", 1000.0), (" 1e3 ", 1000.0), ("nan", None), ("", None), (None, None), ("-.5", -0.5), ("5.", 5.0), ("1__0", None), ("+7", 7.0),
])
def test_numbers(spark, text, value):
    assert one(spark, "string", text, e.number) == value


@pytest.mark.parametrize("text, whole", [("12.9", 12), ("-12.9", -12), ("x", 0), ("1e30", 0)])
def test_whole_numbers(spark, text, whole):
    assert one(spark, "string", text, e.safe_int) == whole


@pytest.mark.parametrize("text, ok", [("2024-1-5", True), ("2024-02-30", False), ("2024-02-29", True), ("05/01/2024", False), (None, False), ("2024-13-01", False)])
def test_dates(spark, text, ok):
    assert one(spark, "string", text, e.valid_date) is ok


@pytest.mark.parametrize("text, ok, part", [
    ("24:00", False, "Unknown"), ("7:5", True, "Morning"), ("23:59", True, "Night"), ("", False, "Unknown"), (None, False, "Unknown"), ("12:00", True, "Afternoon"), ("20:59", True, "Evening"),
])
def test_times(spark, text, ok, part):
    assert one(spark, "string", text, e.valid_time) is ok and one(spark, "string", text, e.time_period) == part


@pytest.mark.parametrize("x, score", [(float("nan"), 0.0), (None, 0.0), (-3.0, 0.0), (130.0, 100.0), (55.5, 55.5)])
def test_clamp(spark, x, score):
    assert one(spark, "double", x, e.clamp) == score


def test_levels(spark):
    scores = [34.9, 35.0, 54.9, 55.0, 74.9, 75.0]
    out = spark.createDataFrame([(s,) for s in scores], "s double").select(e.level(F.col("s")).alias("l")).collect()
    assert [r.l for r in out] == ["LOW", "MODERATE", "MODERATE", "HIGH", "HIGH", "CRITICAL"]


def test_baseline_edges(spark):
    d = date(2024, 1, 1)
    assert risk.historical_baseline(incidents(spark, [])).count() == 0
    assert risk.historical_baseline(incidents(spark, [("A", None, "Felony", None, "Yes", "No", 5)])).count() == 0
    same = risk.historical_baseline(incidents(spark, [("A", d, "Felony", "Knife", "Yes", "No", 5), ("A", d, "Felony", "none", "No", "No", 7)])).first()
    assert same.historical_risk == 50.0 and same.daily_rate == 2.0 and same.weapon_rate == 0.5
    with_null = risk.historical_baseline(incidents(spark, [(None, d, "Felony", None, None, None, None), ("A", d, "Infraction", "Knife", "no", "YES", 9)]))
    assert {r.district: r.gang_rate for r in with_null.collect()} == {None: 0.0, "A": 1.0}


def test_emerging_edges(spark):
    old = spark.createDataFrame([("A", date(2024, 1, 1)), ("A", date(2024, 1, 10)), ("B", date(2024, 1, 2)), (None, date(2024, 1, 2))], "district string, occurred_date date")
    new = spark.createDataFrame([("A", date(2024, 2, 1)), ("C", date(2024, 2, 7)), (None, date(2024, 2, 7)), ("A", date(2024, 1, 31)), ("B", None)], "district string, occurred_date date")
    out = {r.location: r for r in hotspots.emerging_hotspots(old, new).collect()}
    assert set(out) == {"A", "B", "C"}
    assert out["C"].ratio == 99.0 and out["C"].is_emerging and out["B"].ratio == 0.0 and not out["B"].is_emerging
    assert out["A"].recent_count == 1 and out["A"].ratio == pytest.approx(round(1 / 7 / 0.2, 2))
    nothing = hotspots.emerging_hotspots(old.limit(0), new.limit(0))
    assert nothing.count() == 0
    first = {r.location: r.severity for r in hotspots.early_warnings(hotspots.emerging_hotspots(old, new)).collect()}
    assert first == {"C": "CRITICAL"}


def loop_allocation(areas, units):
    weights = {"CRITICAL": 4.0, "HIGH": 3.0, "MODERATE": 2.0, "LOW": 1.0}
    total = sum(weights[l] for _, l, _ in areas)
    exact = {a: weights[l] / total * units for a, l, _ in areas}
    given = {a: int(x) for a, x in exact.items()}
    if units >= len(areas):
        given = {a: max(1, n) for a, n in given.items()}
    score = {a: s for a, _, s in areas}
    rest = {a: exact[a] - int(exact[a]) for a in exact}
    up = sorted(given, key=lambda a: (-rest[a], -score[a], a))
    left = units - sum(given.values())
    for a in up[: max(left, 0)]:
        given[a] += 1
    down = sorted(given, key=lambda a: (rest[a], score[a], [-ord(c) for c in a]))
    while left < 0:
        for a in down:
            if left < 0 and given[a] > 1:
                given[a] -= 1
                left += 1
        if all(given[a] <= 1 for a in given):
            break
    return given


def test_allocation_against_the_loop(spark):
    rng, rows, cases = random.Random(2), [], {}
    for units in (1, 4, 9, 23, 50):
        for run in range(30):
            areas = [(f"d{i:02}", rng.choice(["LOW", "MODERATE", "HIGH", "CRITICAL"]), float(rng.randrange(100))) for i in range(rng.randrange(1, 16))]
            cases[units, f"{units}-{run}"] = areas
            rows += [(f"{units}-{run}", a, l, s, units) for a, l, s in areas]
    df = spark.createDataFrame(rows, "run_id string, area string, risk_level string, score double, units_all int")
    for units in (1, 4, 9, 23, 50):
        out = {}
        for r in risk.allocate_patrols(df.filter(F.col("units_all") == units).drop("units_all"), units).collect():
            out.setdefault(r.run_id, {})[r.area] = r.units
        for run, got in out.items():
            assert got == loop_allocation(cases[units, run], units), (units, run)


def loop_resources(base, counts, units):
    raw = {a: b + min(2 * counts.get(a, 0), 20) for a, b in base.items()}
    score = {a: round(x, 1) for a, x in raw.items()}
    order = sorted(base, key=lambda a: (-score[a], -counts.get(a, 0), a))
    given, left = {a: 1 for a in order}, max(units - len(order), 0)
    for a in order:
        more = min(max(0, round(score[a] / 25) - 1), left)
        given[a] += more
        left -= more
    for k in range(left):
        given[order[k % len(order)]] += 1
    return given


@pytest.mark.parametrize("units", [1, 7, 12, 40])
def test_resources_against_the_loop(spark, units):
    rng = random.Random(units)
    base = {f"d{i}": float(rng.randrange(0, 100)) for i in range(9)}
    counts = {f"d{i}": rng.randrange(0, 15) for i in range(0, 9, 2)}
    baseline = spark.createDataFrame(list(base.items()), "district string, historical_risk double")
    recent = spark.createDataFrame([(d,) for d, n in counts.items() for _ in range(n)], "district string")
    assert {r.district: r.units for r in risk.resource_allocation(baseline, recent, units).collect()} == loop_resources(base, counts, units)


def test_forward_fill_over_partitions(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, None, None, f"v{i}"])) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, v string").repartition(7)
    expected, last = {}, None
    for k, v in rows:
        last = v if v is not None else last
        expected[k] = last
    assert {r.k: r.v for r in cleaning.forward_fill(df, "k", ["v"]).collect()} == expected


def test_ordered_helpers(spark):
    rng = random.Random(6)
    values = [rng.randrange(40) for _ in range(500)]
    df = spark.createDataFrame([(i, v, v % 3 if v % 5 else None) for i, v in enumerate(values)], "i long, v long, g int").repartition(5)
    assert {r.v: r.c for r in dense_codes(df, "v", "c").collect()} == {v: i for i, v in enumerate(sorted(set(values)))}
    for share in (0.0, 0.05, 0.5, 1.0):
        assert quantile(df, "v", share, "q").first().q == pytest.approx(np.quantile(values, share))
    out = running_sum(df.withColumn("b", F.floor(F.col("i") / 50)), ["g"], "b", [F.col("i")], "v", "start", "rank").collect()
    seen = {}
    for r in sorted(out, key=lambda r: r.i):
        total, n = seen.get(r.g, (0, 0))
        assert (r.start, r["rank"]) == (total, n)
        seen[r.g] = (total + r.v, n + 1)
    assert len(out) == len(values)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (200, 200)]
    out = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}


def test_validation_stops_at_missing_fields(spark):
    fields = "incident_id crime_type crime_category crime_severity district latitude longitude occurred_date occurred_time domestic_related gang_related property_damage estimated_loss".split()
    good = ["1", "Theft", "c", "Felony", "North", "1", "2", "2024-01-02", "10:00", "Yes", None, "no", "5"]
    bad = ["2", "Arson", "c", "Grave", "Mars", "x", "-200", "2024-02-30", "24:00", "maybe", "", "Y", "-1"]
    missing = ["3", " ", "c", "Grave", "Mars", None, "2", "2024-02-30", "24:00", "maybe", "", "Y", "-1"]
    df = spark.createDataFrame([good, bad, missing], ", ".join(f"{f} string" for f in fields))
    domains = spark.createDataFrame([("crime_type", "Theft"), ("district", "North")], "field string, value string")
    out = {r.incident_id: r.errors for r in cleaning.validate_incidents(df, domains).collect()}
    assert out["1"] == [] and out["3"] == ["crime_type missing", "latitude missing"] and len(out["2"]) == 11
    assert cleaning.validate_incidents(df.limit(0), domains).count() == 0


def test_unseen_labels_are_unknown(spark):
    codes = cleaning.label_codes(spark.createDataFrame([("b",), ("z",), (None,), ("b",)], "c string"), "c")
    assert {r["value"]: r.code for r in codes.collect()} == {"Unknown": 0, "b": 1, "z": 2}
    out = cleaning.label_encode(spark.createDataFrame([("z",), ("new",), (None,)], "c string"), codes, "c")
    assert sorted(r.c_code for r in out.collect()) == [0, 0, 2]


def test_neighbours_share_tied_votes(spark):
    train = spark.createDataFrame([(0, 0, "Yes")] * 3 + [(0, 0, "No")] * 5 + [(4, 0, "Yes")] * 9, "a int, b int, y string")
    queries = spark.createDataFrame([(0, 0), (4, 1), (2, 0), (9, 9)], "a int, b int")
    out = {(r.a, r.b): r.probability for r in learning.knn_probability(train, queries, ["a", "b"], F.col("y") == "Yes").collect()}
    assert out[0, 0] == pytest.approx(3 / 8) and out[4, 1] == 1.0 and out[2, 0] == pytest.approx(12 / 17, abs=1e-5) and out[9, 9] == 1.0


def test_constant_feature_has_no_influence(spark):
    df = spark.createDataFrame([(1, i, "Yes" if i > 2 else "No") for i in range(6)], "same int, up int, y string")
    out = {r.feature: r.strength for r in learning.arrest_factors(df, ["same", "up"], F.col("y") == "Yes").collect()}
    assert out["same"] == 0.0 and out["up"] == pytest.approx(0.8783, abs=1e-4)


def test_regression_finds_the_line(spark):
    rng = np.random.default_rng(0)
    rows = [(float(x), float(z), float(3 * x - 2 * z + 5)) for x, z in rng.normal(size=(200, 2))]
    df = spark.createDataFrame(rows, "x double, z double, y double")
    out, _ = learning.linear_regression(df, df, ["x", "z"], "y")
    assert out.agg(F.max(F.abs(F.col("y") - F.col("prediction")))).first()[0] < 1e-3
    assert [r.feature for r in learning.drivers(df, ["x", "z"], "y").orderBy(F.desc("weight")).collect()] == ["x", "z"]


def brute_dbscan(points, eps, least):
    p = np.radians(np.array([x[:2] for x in points]))
    n = np.array([x[2] for x in points])
    a = np.sin((p[:, None, 0] - p[None, :, 0]) / 2) ** 2 + np.cos(p[:, None, 0]) * np.cos(p[None, :, 0]) * np.sin((p[:, None, 1] - p[None, :, 1]) / 2) ** 2
    near = 2 * np.arcsin(np.sqrt(a)) <= eps
    core = near @ n >= least
    label = np.where(core, np.arange(len(n)), -1)
    while True:
        new = np.array([min([label[j] for j in np.flatnonzero(near[i] & core)], default=-1) if core[i] else -1 for i in range(len(n))])
        if (new == label).all():
            break
        label = new
    reach = [{label[j] for j in np.flatnonzero(near[i] & core)} for i in range(len(n))]
    return core, label, reach


def test_density_clusters_against_brute_force(spark):
    rng = np.random.default_rng(8)
    centres = [(40.0, -74.0), (40.05, -74.0), (40.0, -73.9), (61.0, 10.0)]
    points = [(round(float(a + x), 4), round(float(b + y), 4)) for a, b in centres for x, y in rng.normal(scale=0.008, size=(90, 2))]
    points += [(round(float(x), 4), round(float(y), 4)) for x, y in zip(rng.uniform(39.8, 40.2, 30), rng.uniform(-74.2, -73.8, 30), strict=True)]
    rows = points + points[:20]
    counted = sorted({p: rows.count(p) for p in rows}.items())
    flat = [(a, b, n) for (a, b), n in counted]
    for eps, least in ((0.00005, 5), (0.0001, 8), (0.0003, 5)):
        core, label, reach = brute_dbscan(flat, eps, least)
        out = {(r.lat_deg, r.lon_deg): r.cluster for r in clusters.dbscan(spark.createDataFrame(rows, "latitude double, longitude double"), eps, least).collect()}
        ours = [out[a, b] for a, b, _ in flat]
        names = {}
        for i in np.flatnonzero(core):
            assert names.setdefault(label[i], ours[i]) == ours[i]
        assert len(set(names.values())) == len(names)
        for i in np.flatnonzero(~core):
            assert ours[i] == min([names[x] for x in reach[i]], default=-1)
    assert clusters.dbscan(spark.createDataFrame([], "latitude double, longitude double"), 0.1).count() == 0


def test_ward_joins_what_is_close(spark):
    df = spark.createDataFrame([(f"d{i}", float(v)) for i, v in enumerate([0, 0.1, 5, 5.2, 20, 20.1])], "district string, x double")
    out = {r.district: r.group for r in clusters.district_groups(df, ["x"], 3).collect()}
    assert out["d0"] == out["d1"] != out["d2"] == out["d3"] != out["d4"] == out["d5"]
    with pytest.raises(ValueError):
        clusters.district_groups(df, ["x"], 3, most=5)


def test_forest_flags_what_stands_apart(spark):
    rng = np.random.default_rng(1)
    rows = [(i, *map(float, v)) for i, v in enumerate(rng.normal(size=(2000, 2)))] + [(5000, 9.0, -9.0)]
    df = spark.createDataFrame(rows, "k long, a double, b double")
    out = {r.k: r for r in anomaly.score_isolation_forest(df, df, ["a", "b"], "k", trees=60).collect()}
    assert out[5000].is_anomaly and out[5000].anomaly_score > np.median([r.anomaly_score for r in out.values()])
    assert 0.03 < np.mean([r.is_anomaly for r in out.values()]) < 0.06
    assert anomaly.anomaly_summary(df.limit(0).withColumn("is_anomaly", F.lit(True))).first().rate == 0.0


def test_forest_draws_uniformly(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") % 97).cast("double").alias("a"))
    nodes = anomaly.train_isolation_forest(df, ["a"], "k", trees=40)
    leaves = nodes.filter("feature < 0").groupBy("tree").count()
    assert nodes.select("tree").distinct().count() == 40 and leaves.count() == 40


def test_decoding(spark):
    texts = spark.createDataFrame([('["a"]',), ("not json",), ("",), (None,), ("[]",)], "x string")
    assert [r.y for r in texts.select(records.decode_reasons(F.col("x")).alias("y")).collect()] == [["a"], ["not json"], [], [], []]


def test_month_reports_are_filled(spark):
    df = spark.createDataFrame([("T", "May"), ("T", "May"), ("U", "June")], "crime_type string, month string")
    out = {(r.crime_type, r.month): r.n for r in dashboard.month_crime(df).collect()}
    assert len(out) == 24 and out["T", "May"] == 2 and out["U", "May"] == 0


def walked(x, tree):
    """The path of one row, node by node."""
    node = 0
    while tree[node][0] >= 0:
        feature, threshold, left, right, _path = tree[node]
        v = x[int(feature)]
        node = int(right if np.isnan(v) or v > threshold else left)
    return tree[node][4]


@pytest.mark.parametrize("sample, depth", [(256, 8), (40, 6), (2000, 11), (1, 1)])
def test_paths_are_those_of_the_trees(sample, depth):
    """Rows on a threshold go left, no number goes right, trees differ in depth, and row counts are no multiple of a word."""
    rng = np.random.default_rng(5)
    data = lambda n: np.stack([rng.integers(0, 3, n), rng.integers(0, 40, n), np.round(rng.normal(size=n), 1), np.full(n, 7), rng.normal(size=n)]).astype(float)
    trees = [anomaly._grow(data(sample if k % 5 else 3).T, np.random.default_rng(k), depth) for k in range(12)]
    tables = [np.array(t, float) for t in trees]
    ways = anomaly._ways([anomaly._even(t, anomaly._depth_of(t)) for t in tables], 5)
    for n in (0, 1, 63, 64, 65, 500):
        x = data(n)
        if n > 60:
            x[1, ::7], x[4, 5], x[4, 6], x[2, 3] = np.nan, np.inf, -np.inf, np.nan
            for i, (f, t) in enumerate([(f, t) for f, t, *_ in trees[1] if f >= 0][:50]):
                x[f, i] = t
        expected = np.zeros(n)
        for t in trees:
            expected += np.array([walked(x[:, i], t) for i in range(n)])
        assert (anomaly._path_lengths(x, ways) == expected).all()


def test_a_rated_history_goes_down_the_trees_once(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(f"i{i}", f"t{v % 5}", None if v % 7 == 0 else f"d{v % 3}", float(v)) for i, v in enumerate(rng.integers(0, 1000, 3000))]
    history = spark.createDataFrame([*rows, *rows[:40]], "incident_id string, crime_type string, district string, estimated_loss double").persist()
    sent = []
    scores = anomaly.path_scores
    monkeypatch.setattr(anomaly, "path_scores", lambda df, *x: sent.append(df.count()) or scores(df, *x))
    out = anomaly.rated_history(history, ("crime_type",), trees=20)
    assert out.columns == ["incident_id", "is_anomaly", "anomaly_score", "crime_type"] and out.count() == 3040
    again = anomaly.forest_scores(*(lambda known: (anomaly._coded_history(history, "incident_id")[0], known.forest))(anomaly.incident_forest(history, trees=20)))
    key = lambda df: sorted((r.incident_id, r.is_anomaly, r.anomaly_score) for r in df.collect())
    assert key(out) == key(again)
    whole = anomaly._coded_history(history, "incident_id")[0]
    assert key(anomaly.score_isolation_forest(whole, whole, anomaly.FEATURES, "incident_id", trees=20)) == key(out)
    assert sent == [3040] * 4  # rated_history: once; incident_forest and forest_scores; score_isolation_forest: once
    plan = scores(whole, anomaly.train_isolation_forest(whole, anomaly.FEATURES, "incident_id", trees=2), anomaly.FEATURES)
    plan = plan._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan
    history.unpersist()


@pytest.mark.parametrize("step", [2.0**-16, 50.0])
def test_quantile_by_step_is_the_quantile(spark, step):
    rng = np.random.default_rng(6)
    for values in (list(rng.normal(size=701)), [0.5] * 9 + [-0.25], [1.0], list(np.round(rng.normal(size=300), 1)), [1.0, 2.0]):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        for share in (0.0, 0.05, 1.0):
            assert quantile_by_step(df, "v", share, "q", step).first().q == pytest.approx(np.quantile(values, share), abs=1e-12)
    assert quantile_by_step(df.limit(0), "v", 0.5, "q", step).first().q is None


def test_values_of_a_history_have_their_codes_as_they_stand(spark):
    """Each row's code is that of its cleaned value, without cleaning it or pairing it with that of ``Unknown`` again."""
    given = ["  a ", "a", None, "", " ", "nan", "NaN", "Unknown", "b", "B"]
    history = spark.createDataFrame([(f"i{i}", v, float(i)) for i, v in enumerate([*given, *given])], "incident_id string, district string, estimated_loss double")
    history = history.withColumns({c: F.col("district") for c in anomaly.CATEGORIES} | {"latitude": F.lit(1.0), "longitude": F.lit(1.0)})
    train, codes, unknown = anomaly._coded_history(history, "incident_id")
    expected = cleaning.label_encode(history, codes["district"], "district")
    assert {r.incident_id: r.district_code for r in train.collect()} == {r.incident_id: r.district_code for r in expected.collect()}
    assert train.count() == 20 and dict(train.dtypes)["district_code"] == "bigint"
    assert unknown["district"] == codes["district"].filter("value = 'Unknown'").first().code
    plan = train._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "trim(" not in plan
    arriving = spark.createDataFrame([(f"i{i}", v, float(i)) for i, v in enumerate([" b ", "c", None])], "incident_id string, district string, estimated_loss double")
    arriving = arriving.withColumns({c: F.lit(None).cast("string") for c in anomaly.CATEGORIES if c != "district"} | {"latitude": F.lit(1.0), "longitude": F.lit(1.0)})
    of = {r.value: r.code for r in codes["district"].collect()}
    found = {r.incident_id: r.district_code for r in anomaly.coded(arriving, codes, unknown).collect()}
    assert found == {"i0": of["b"], "i1": of["Unknown"], "i2": of["Unknown"]}


def test_line_items_are_joined_once_for_orders_customers_and_nations(spark):
    """The most rows must not be shuffled once more for the customers."""
    from vigil.sources.incidents import history

    plan = history(spark, "/root/testdata/sf0.001", ["district", "crime_type"])._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    (at,) = [i for i, line in enumerate(plan) if "Join Inner" in line and "c_custkey" in line]
    below = plan[at + 1:]
    end = next((i for i, line in enumerate(below) if depth(line) <= depth(plan[at])), len(below))
    assert not any("l_orderkey" in line for line in below[:end])
