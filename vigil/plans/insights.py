"""The findings as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators import dashboard as d
from vigil.operators import insights as i
from vigil.operators.aggregates import mean, yes_rate
from vigil.plans import oracle as o
from vigil.sources.incidents import history

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _kv(df: DataFrame, key: str, value: str = "n") -> DataFrame:
    return df.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(value).alias("value"))


def _add(kind: str, columns: str, rows, text, keyed_sql: str | None, sql: str) -> None:
    QUERIES[f"insight_{kind}"] = lambda spark, sf_dir: text(rows(history(spark, sf_dir, columns.split())))
    ctes = [] if keyed_sql is None else [f"kv as ({keyed_sql})", """
t as (select first(key order by value desc, key) as top, max(value) as top_value, first(key order by value, key) as low, min(value) as low_value,
  sum(value) as total, avg(value) as mean from kv)"""]
    ORACLES[f"insight_{kind}"] = o.with_history(f"select {sql} as insight from {'t' if keyed_sql else 'inc'}", *ctes)


def _n(column: str, where: str = "true") -> str:
    return f"select {column} as key, count(*) as value from inc where {column} is not null and {where} group by all"


PCT = "coalesce(round_even({}, 0), 0)::bigint"
_add("crime_by_district", "district", lambda h: _kv(d.counts(h, "district"), "district"), i.crime_by_district, _n("district"),
     f"top || ' has the most incidents: ' || top_value || ', ' || {PCT.format('(top_value - mean) * 100.0e0 / mean')} || '% above the mean.'")
_add("time_pattern", "time_category", lambda h: _kv(d.counts(h, "time_category"), "time_category"), i.time_pattern, _n("time_category"),
     "'Most incidents at ' || top || ': ' || top_value || '; fewest at ' || low || '.'")
_add("weapon_dist", "weapon_used", lambda h: _kv(d.counts(h, "weapon_used"), "weapon_used"), i.weapon_dist, _n("weapon_used"),
     f"top || ' leads with ' || {PCT.format('top_value * 100.0e0 / total')} || '% of the incidents.'")
_add("arrest_by_day", "day_of_week arrest_made", lambda h: _kv(h.groupBy("day_of_week").agg(yes_rate("arrest_made").alias("n")), "day_of_week"), i.arrest_by_day,
     f"select day_of_week as key, {o.rate()} as value from inc group by all",
     "'Resolved most on ' || top || ' (' || printf('%.1f', top_value) || '%), least on ' || low || ' (' || printf('%.1f', low_value) || '%).'")
_add("seasonal", "season", lambda h: _kv(d.counts(h, "season"), "season"), i.seasonal, _n("season"),
     f"'Peak in ' || top || ' (' || top_value || '), calm in ' || low || ': ' || {PCT.format('(top_value - low_value) * 100.0e0 / low_value')} || '% apart.'")
_add("loss_by_crime", "crime_type estimated_loss", lambda h: _kv(h.groupBy("crime_type").agg(mean("estimated_loss").alias("n")), "crime_type"), i.loss_by_crime,
     f"select crime_type as key, {o.mean('estimated_loss')} as value from inc group by all", "top || ' costs most: ' || round_even(top_value, 0)::bigint || ' on average.'")
_add("evidence", "evidence_collected arrest_made", d.evidence_resolution, i.evidence, None,
     f"""first('Resolved with evidence: ' || printf('%.1f', w) || '%, without: ' || printf('%.1f', n) || '%, a gap of ' || printf('%.1f', {o.rnd('w - n')}) || '.')""")
ORACLES["insight_evidence"] = o.with_history(
    f"""select 'Resolved with evidence: ' || printf('%.1f', w) || '%, without: ' || printf('%.1f', n) || '%, a gap of ' || printf('%.1f', {o.rnd('w - n')}) || '.' as insight
from (select (select {o.rate()} from inc where evidence_collected = 'Yes') as w, (select {o.rate()} from inc where evidence_collected = 'No') as n)""")
_add("victim_profile", "victim_gender victim_age_group", lambda h: h, i.victim_profile, None, "''")
ORACLES["insight_victim_profile"] = o.with_history("""select 'Most affected: ' || (select victim_gender from inc group by 1 order by count(*) desc, 1 limit 1)
  || ', ' || (select victim_age_group from inc group by 1 order by count(*) desc, 1 limit 1) || '.' as insight""")
_add("monthly", "month", lambda h: _kv(d.counts(h, "month"), "month"), i.monthly, _n("month"),
     f"'Peak in ' || top || ' (' || top_value || '), trough in ' || low || ' (' || low_value || '): a swing of ' || {PCT.format('(top_value - low_value) * 100.0e0 / greatest(low_value, 1)')} || '%.'")
_add("gang", "gang_related district", lambda h: _kv(d.counts(h.filter("gang_related = 'Yes'"), "district"), "district"), i.gang, _n("district", "gang_related = 'Yes'"),
     f"top || ' has ' || {PCT.format('top_value * 100.0e0 / total')} || '% of the gang incidents.'")
