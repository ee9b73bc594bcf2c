"""Models and anomalies as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.constants import PATTERN_BOUNDS
from vigil.functions.expr import draw, level
from vigil.operators import anomaly as a
from vigil.operators import clusters as c
from vigil.operators import insights
from vigil.operators import learning as m
from vigil.operators.aggregates import modes
from vigil.operators.density import density_clusters
from vigil.operators.dashboard import arrest_gap, loss_stats, pattern_risk, top_threat
from vigil.plans.oracle import mean, modes_cte, rnd, with_history
from vigil.shared import written
from vigil.sources.incidents import history

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
CODED = ["crime_type", "district", "time_category", "weapon_used", "crime_severity"]
CODES = [f"{x}_code" for x in CODED]
DRAW = "((row_key % 2147483647) * 48271 + 11) % 2147483647"


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def _codes_sql(columns: list[str]) -> str:
    """CTEs for the codes and ``f``: the history with a code per column, and the split."""
    clean = "coalesce({}, 'Unknown')"
    ctes = [f"c_{x} as (select v, row_number() over (order by v) - 1 as {x}_code from (select {clean.format(x)} as v from inc union select 'Unknown'))" for x in columns]
    joins = " ".join(f"join c_{x} on c_{x}.v = {clean.format(x)}" for x in columns)
    return ",\n".join([*ctes, f"f as (select inc.*, {', '.join(f'{x}_code' for x in columns)}, {DRAW} % 10 < 8 as is_train from inc {joins})"])


def _features(spark, sf_dir, more: tuple = ("arrest_made",)):
    rows = history(spark, sf_dir, list(dict.fromkeys(["incident_id", "row_key", *CODED, *more])))
    return m.split_train_test(m.prepare_features(rows, CODED))


F_SQL = _codes_sql(CODED)
_add("prepare_features", lambda spark, sf_dir: m.prepare_features(history(spark, sf_dir, ["incident_id", *CODED, "estimated_loss", "victim_count"]), CODED, ["estimated_loss", "victim_count"]).select(
    "incident_id", *CODES, "estimated_loss", "victim_count"),
    with_history(f"select incident_id, {', '.join(CODES)}, estimated_loss::double as estimated_loss, victim_count::double as victim_count from f", F_SQL))
_add("standard_scale", lambda spark, sf_dir: m.standard_scale(history(spark, sf_dir, ["incident_id", "estimated_loss", "victim_count"]).withColumn("same", F.lit(3)), ["estimated_loss", "victim_count", "same"]).select(
    "incident_id", *[(F.rint(F.col(f"z_{x}") * 1e5) / 1e5).alias(f"z_{x}") for x in ("estimated_loss", "victim_count", "same")]),
    with_history("select incident_id, " + ", ".join(
        f"round_even(({x} - avg({x}) over ()) / stddev_pop({x}) over () * 1e5, 0) / 1e5 as z_{x}" for x in ("estimated_loss", "victim_count")) + ", 0.0::double as z_same from inc"))
_add("split_train_test", lambda spark, sf_dir: m.split_train_test(history(spark, sf_dir, ["incident_id", "row_key"])).select("incident_id", "is_train"),
     with_history(f"select incident_id, {DRAW} % 10 < 8 as is_train from inc"))


def _nb(spark, sf_dir):
    f = _features(spark, sf_dir).filter("arrest_made is not null")
    model = m.gaussian_nb(f.filter("is_train"), CODES, "arrest_made")
    test = f.filter("not is_train")
    return test, m.predict_nb(test, model, CODES, "incident_id")


_LOGS = " + ".join(f"(-0.5e0 * ln(2 * pi() * var_{x}) - pow({x} - mean_{x}, 2) / (2 * var_{x}))" for x in CODES)
NB_SQL = f"""{F_SQL},
known as (select * from f where arrest_made is not null),
nb as (select arrest_made as label, count(*)::double / (select count(*) from known where is_train) as prior, {', '.join(f'avg({x}) as mean_{x}' for x in CODES)},
  {', '.join(f"var_pop({x}) + (select greatest({', '.join(f'var_pop({y})' for y in CODES)}) from known where is_train) * 1e-9 as var_{x}" for x in CODES)}
  from known where is_train group by arrest_made),
j as (select incident_id, arrest_made, label, ln(prior) + {_LOGS} as score from known, nb where not is_train),
predicted as (select incident_id, arrest_made, arg_max(label, score) as prediction, {rnd('1 / sum(exp(score - top))', 4)} as probability
  from (select *, max(score) over (partition by incident_id) as top from j) group by all)"""
_add("gaussian_nb", lambda spark, sf_dir: _nb(spark, sf_dir)[1].select("incident_id", "prediction", F.round("probability", 3).alias("probability")),
     with_history("select incident_id, prediction, round(probability, 3) as probability from predicted", NB_SQL))
_add("evaluate_classifier", lambda spark, sf_dir: (lambda t: m.accuracy(t[0].select("incident_id", "arrest_made").join(t[1], "incident_id"), "arrest_made", "prediction"))(_nb(spark, sf_dir)),
     with_history(f"select count(*) as n, {rnd('avg(case when arrest_made = prediction then 100.0e0 else 0 end)', 2)} as accuracy from predicted", NB_SQL))


def _knn(spark, sf_dir):
    f = _features(spark, sf_dir).filter("arrest_made is not null")
    return m.knn_probability(f.filter("is_train"), f.filter("not is_train"), CODES, F.col("arrest_made") == "Yes")


_add("knn_classify", _knn, with_history(f"""
select {', '.join(CODES)}, {rnd('sum(least(n, greatest(5 - before, 0)) * yes / n) / 5.0e0', 6)} as probability from (
  select *, coalesce(sum(n) over (partition by {', '.join(CODES)} order by dist rows between unbounded preceding and 1 preceding), 0) as before from (
    select {', '.join(f'q.{x} as {x}' for x in CODES)}, {' + '.join(f'(p.{x} - q.{x}) * (p.{x} - q.{x})' for x in CODES)} as dist, sum(p.n)::double as n, sum(p.yes)::double as yes
    from (select distinct {', '.join(CODES)} from f where not is_train and arrest_made is not null) q,
      (select {', '.join(CODES)}, count(*) as n, count(*) filter (arrest_made = 'Yes') as yes from f where is_train and arrest_made is not null group by all) p
    where {' and '.join(f'abs(p.{x} - q.{x}) <= 6' for x in CODES)} group by all))
where before < 5 group by {', '.join(CODES)}""", F_SQL))
_add("evaluate_regression", lambda spark, sf_dir: (lambda h: m.regression_error(
    h.join(loss_stats(h).select("crime_type", "mean"), "crime_type"), "estimated_loss", "mean"))(history(spark, sf_dir, ["crime_type", "estimated_loss"])),
    with_history(f"""select {rnd('avg(pow(estimated_loss - m, 2))', 2)} as mse, {rnd('sqrt(avg(pow(estimated_loss - m, 2)))', 4)} as rmse
from inc join (select crime_type, {mean('estimated_loss')} as m from inc group by all) using (crime_type)"""))
_add("arrest_factors", lambda spark, sf_dir: m.arrest_factors(_features(spark, sf_dir).filter("arrest_made is not null"), CODES, F.col("arrest_made") == "Yes"),
     with_history(" union all ".join(
         f"select '{x}' as feature, {rnd(f'''abs(corr({x}, case when arrest_made = 'Yes' then 1.0e0 else 0 end))''', 4)} as strength from f where arrest_made is not null" for x in CODES), F_SQL))

GANG = ["crime_type", "district", "time_category", "weapon_used"]


def _gang_tree(spark, sf_dir, more: tuple = ()):
    f = _features(spark, sf_dir, ("gang_related", "arrest_made", *more))
    return m.decision_tree(f.filter("is_train"), f, [f"{x}_code" for x in GANG], "gang_related")


_add("decision_tree", lambda spark, sf_dir: _gang_tree(spark, sf_dir).select("incident_id", "prediction", "confidence"))


def _zones(spark, sf_dir):
    rows = history(spark, sf_dir, ["incident_id", "crime_type", "crime_severity", "district", "latitude", "longitude"])
    return m.kmeans_zones(m.prepare_features(rows, ["crime_type", "crime_severity"]), ["latitude", "longitude", "crime_type_code", "crime_severity_code"])


_add("kmeans_zones", lambda spark, sf_dir: _zones(spark, sf_dir).select("incident_id", "zone"))
_add("zone_summary", lambda spark, sf_dir: c.zone_summary(_zones(spark, sf_dir)))
_add("insight_hotspot", lambda spark, sf_dir: insights.hotspot(c.zone_summary(_zones(spark, sf_dir))))


def _places(spark, sf_dir):
    return history(spark, sf_dir, ["district", "latitude", "longitude"])


EPS = 0.00012  # radians; several clusters on the given tables
_add("dbscan_hotspots", lambda spark, sf_dir: c.dbscan(_places(spark, sf_dir), EPS, 100))
_add("dbscan_summary", lambda spark, sf_dir: (lambda h: c.dbscan_summary(h, c.dbscan(h, EPS, 100)))(_places(spark, sf_dir)))


SCALED = ["latitude", "longitude", "crime_type_code", "crime_severity_code"]


def _scaled(spark, sf_dir):
    """Places, types and severities with mean 0 and deviation 1."""
    rows = history(spark, sf_dir, ["incident_id", "crime_type", "crime_severity", "district", "latitude", "longitude"])
    return m.standard_scale(m.prepare_features(rows, ["crime_type", "crime_severity"]), SCALED)


def _dense(spark, sf_dir):
    scaled, z = _scaled(spark, sf_dir), [f"z_{x}" for x in SCALED]
    found = density_clusters(scaled, z, eps=0.5, min_points=5)
    return scaled.join(found.drop("n"), z).select("incident_id", "cluster")


_add("dbscan_scaled", _dense)


def _groups(spark, sf_dir):
    return c.district_groups(_features(spark, sf_dir), ["crime_type_code", "time_category_code", "weapon_used_code", "crime_severity_code"])


_add("district_groups", _groups)
_add("district_group_members", lambda spark, sf_dir: c.group_members(history(spark, sf_dir, ["district"]), _groups(spark, sf_dir)))


def _loss(spark, sf_dir):
    f = _features(spark, sf_dir, ("estimated_loss", "victim_count", "suspect_count"))
    return m.linear_regression(f.filter("is_train"), f.filter("not is_train"), [*CODES, "victim_count", "suspect_count"], "estimated_loss")[0]


def _solved(features: list[str], label: str, source: str) -> str:
    """CTEs down to ``weights`` (w: list): the normal equations of the scaled features, solved column by column."""
    n = len(features)
    z = ", ".join(f"coalesce(({x} - avg({x}) over ()) / nullif(stddev_pop({x}) over (), 0), 0)" for x in features)
    return f"""
scaled as (select [{z}, {label} - avg({label}) over ()] as z from {source}),
cells as (select i, j, avg(z[i] * z[j]) as v from scaled, range(1, {n + 1}) a(i), range(1, {n + 2}) b(j) group by i, j),
lines as (select i, list(v order by j) as line from cells group by i),
solve as (
  select 1 as p, list(line order by i) as m from lines
  union all
  select p + 1, list_transform(m, lambda line, i: case when i = p then list_transform(line, lambda v: v / m[p][p])
    else list_transform(line, lambda v, j: v - line[p] / m[p][p] * m[p][j]) end) from solve where p <= {n}),
weights as (select list_transform(m, lambda line: line[{n + 1}]) as w from solve where p = {n + 1})"""


LOSS_FEATURES = [*CODES, "victim_count", "suspect_count"]
DRIVER_FEATURES = ["crime_type_code", "crime_severity_code", "victim_count", "suspect_count"]
_GUESS = " + ".join(
    f"(o.{x} - s.m_{x}) / s.s_{x} * w[{i}]" for i, x in enumerate(LOSS_FEATURES, 1))
_add("loss_regression", lambda spark, sf_dir: m.regression_error(_loss(spark, sf_dir), "estimated_loss", "prediction"),
     with_history(f"""select {rnd('avg(pow(estimated_loss - guess, 2))', 2)} as mse, {rnd('sqrt(avg(pow(estimated_loss - guess, 2)))', 4)} as rmse
from (select o.estimated_loss, {rnd(f's.m_y + {_GUESS}', 4)} as guess from f o, weights,
  (select avg(estimated_loss) as m_y, {', '.join(f'avg({x}) as m_{x}, stddev_pop({x}) as s_{x}' for x in LOSS_FEATURES)} from f where is_train) s
  where not o.is_train)""", F_SQL, _solved(LOSS_FEATURES, "estimated_loss", "f where is_train").strip()).replace("with inc_base", "with recursive inc_base", 1))
_add("investigation_drivers", lambda spark, sf_dir: m.drivers(
    _features(spark, sf_dir, ("investigation_hours", "victim_count", "suspect_count")), DRIVER_FEATURES, "investigation_hours"),
    with_history(" union all ".join(f"select '{x}' as feature, {rnd(f'abs(w[{i}])', 4)} as weight from weights" for i, x in enumerate(DRIVER_FEATURES, 1)),
                 F_SQL, _solved(DRIVER_FEATURES, "investigation_hours", "f").strip()).replace("with inc_base", "with recursive inc_base", 1))


def _briefing(spark, sf_dir):
    """Per crime, district, time and weapon: rating with the tree's prediction, chance of an arrest, gap, loss, main threat."""
    f = written(_gang_tree(spark, sf_dir, ("estimated_loss",)), "briefing")
    combo = f.filter("weapon_used is not null").groupBy(*GANG).agg(
        F.max("prediction").alias("gang"), F.max("confidence").alias("gang_confidence"),
        F.mode("crime_severity_code", deterministic=True).alias("crime_severity_code"),
        *[F.max(f"{x}_code").alias(f"{x}_code") for x in GANG],
    )
    chance = m.knn_probability(f.filter("is_train and arrest_made is not null"), combo, CODES, F.col("arrest_made") == "Yes")
    combo = combo.join(chance.withColumnRenamed("probability", "arrest_chance"), CODES).drop(*CODES)
    rated = pattern_risk(f, F.lit(False)).drop("risk_level").join(combo, GANG)
    risk = F.when(F.col("gang") == "Yes", F.least(F.col("risk") + 20, F.lit(100.0))).otherwise(F.col("risk"))
    rated = rated.withColumn("risk", risk).withColumn("risk_level", level(F.col("risk"), PATTERN_BOUNDS))
    gap = arrest_gap(f).select("crime_type", "district", "time_category", "cases", "resolved", "rate", "gap")
    threat = top_threat(f).select("district", F.col("crime_type").alias("top_threat"), F.col("share").alias("top_threat_share"))
    loss = loss_stats(f).select("crime_type", "mean", "min", "max")
    return (
        rated.join(gap, ["crime_type", "district", "time_category"]).join(threat, "district")
        .join(modes(f, ["district"], ["time_category"]), "district").join(loss, "crime_type")
    )


_add("briefing", _briefing)

# Anomalies.
A_COLUMNS = ["incident_id", "row_key", *a.CATEGORIES, *a.NUMBERS]


def _anomaly_rows(spark, sf_dir):
    return a.anomaly_features(history(spark, sf_dir, A_COLUMNS))


def _scored(spark, sf_dir, *kept: str, trees: int = 200):
    return a.rated_history(written(history(spark, sf_dir, ["incident_id", *a.CATEGORIES, *a.NUMBERS]), "history"), kept, trees=trees)


_add("anomaly_features", lambda spark, sf_dir: _anomaly_rows(spark, sf_dir).select("incident_id", *[f"{x}_code" for x in a.CATEGORIES], "estimated_loss"),
     with_history(f"select incident_id, {', '.join(f'{x}_code' for x in a.CATEGORIES)}, estimated_loss::double as estimated_loss from f", _codes_sql(a.CATEGORIES)))
_add("train_isolation_forest", lambda spark, sf_dir: a.train_isolation_forest(_anomaly_rows(spark, sf_dir), a.FEATURES, "incident_id"))
for _name in ("score_isolation_forest", "historical_anomalies"):
    _add(_name, lambda spark, sf_dir: _scored(spark, sf_dir))
_add("score_incidents_detailed", lambda spark, sf_dir: _scored(spark, sf_dir, "crime_severity", "crime_type", "district"))


def _flagged(spark, sf_dir):
    """The history with a flag and a score made from the key, to hold the texts and sums against SQL."""
    rows = history(spark, sf_dir, ["incident_id", "row_key", "crime_severity", "weapon_used", "district", "gang_related"])
    score = F.pmod(draw("row_key"), F.lit(1000)) / 1000
    return rows.withColumns({"is_anomaly": draw("row_key") % 1000 < 50, "anomaly_score": score})


_FLAG = f"({DRAW}) % 1000 < 50"
_add("anomaly_explanation", lambda spark, sf_dir: _flagged(spark, sf_dir).select("incident_id", a.anomaly_explanation(F.col("is_anomaly"), F.col("anomaly_score")).alias("explanation")),
     with_history(f"""select incident_id, concat_ws(' ', case when {_FLAG} then 'Unusual for the history.' else 'Within the usual range.' end,
  case when crime_severity = 'Felony' then 'Severity is high.' end, case when weapon_used <> 'None' then 'Weapon: ' || weapon_used || '.' end,
  'District ' || district || '.', case when gang_related = 'Yes' then 'Gang case.' end, 'Score ' || printf('%.3f', (({DRAW}) % 1000) / 1000.0e0) || '.') as explanation from inc"""))
_add("anomaly_summary", lambda spark, sf_dir: a.anomaly_summary(_flagged(spark, sf_dir)),
     with_history(f"select count(*) as total, count(*) filter ({_FLAG}) as anomalies, {rnd(f'(count(*) filter ({_FLAG}))::double / count(*)', 4)} as rate from inc"))
