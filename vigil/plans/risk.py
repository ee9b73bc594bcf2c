"""Risk, hotspots, allocation and records as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.constants import SEVERITIES
from vigil.functions.expr import date_of, is_yes, level
from vigil.operators import hotspots as h
from vigil.operators import live, records
from vigil.operators.cleaning import incident_record
from vigil.operators import risk as r
from vigil.plans.cleaning import ACTION_SQL, RECORD_SQL, _BASIC, _BOUNDS, _KNOWN_TABLES, _list
from vigil.plans.oracle import ARMED, BASELINE_CTE, day, minmax, num, risk_level, rnd, share, weight, with_history, with_incoming
from vigil.shared import new_folder, written
from vigil.sources import store
from vigil.sources.incidents import ensure_columns, history, incoming, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
RISK_COLUMNS = ["district", "occurred_date", "crime_severity", "weapon_used", "domestic_related", "gang_related", "estimated_loss"]
CHAIN_COLUMNS = [*RISK_COLUMNS, "crime_type", "latitude", "longitude", "incident_id", "crime_category", "time_category"]


def _add(name: str, query, sql: str) -> None:
    QUERIES[name], ORACLES[name] = query, sql


def _baseline(spark, sf_dir):
    return r.historical_baseline(history(spark, sf_dir, RISK_COLUMNS))


_add("historical_baseline", _baseline, with_history("select * from baseline", BASELINE_CTE.strip()))
_add("minmax_normalize", lambda spark, sf_dir: r.normalized(
    history(spark, sf_dir, ["district", "estimated_loss"]).groupBy("district").agg(F.count(F.lit(1)).alias("n"), F.sum("estimated_loss").alias("loss")), ["n", "loss"]
).select("district", "n", "loss", F.round("n_n", 9).alias("n_n"), F.round("n_loss", 9).alias("n_loss")),
    with_history(f"select *, round({minmax('n')}, 9) as n_n, round({minmax('loss')}, 9) as n_loss from (select district, count(*) as n, sum(estimated_loss)::bigint as loss from inc group by all)"))
_add("baseline_lookup", lambda spark, sf_dir: r.baseline_lookup(incoming(spark, sf_dir).select("incident_id", "district"), _baseline(spark, sf_dir)),
     with_incoming("""select incident_id, raw.district, coalesce(historical_risk, 30.0)::double as historical_risk from raw left join baseline using (district)""", BASELINE_CTE.strip(), history=True))
_add("area_baselines", lambda spark, sf_dir: r.area_baselines(history(spark, sf_dir, RISK_COLUMNS)), with_history(f"""
select district, incident_count as historical_incident_count, avg_severity_score, historical_risk as baseline_risk from baseline
join (select district, {rnd(f"avg({weight('crime_severity')})", 6)} as avg_severity_score from inc group by all) using (district)""", BASELINE_CTE.strip()))
_add("area_score_fallback", lambda spark, sf_dir: r.area_score_fallback(history(spark, sf_dir, ["district"])), with_history(
    f"select district, {rnd('least(100, count(*)::double / (select count(*) from inc) * 700.0e0)')} as score from inc group by district"))
_add("priority_areas", lambda spark, sf_dir: r.priority_areas(_baseline(spark, sf_dir).withColumn("risk_level", level(F.col("historical_risk"))), "MODERATE").select(
    "district", "historical_risk", "risk_level"), with_history(
    f"select district, historical_risk, {risk_level('historical_risk')} as risk_level from baseline where historical_risk >= 35", BASELINE_CTE.strip()))

HOT_CTE = f"""hot_stats as (
  select district as location, count(*) as incident_count, count(*) filter (crime_severity = 'Felony') as felony_count,
    {share("crime_severity = 'Felony'")} as felony_rate, {share(ARMED)} as weapon_rate, avg(estimated_loss) as average_loss from inc group by district),
hot as (select location, incident_count, felony_count, {rnd('felony_rate', 6)} as felony_rate, {rnd('weapon_rate', 6)} as weapon_rate,
  {rnd('average_loss', 6)} as average_loss, hotspot_score, {risk_level('hotspot_score', (25, 50, 75))} as hotspot_level from (
  select *, {rnd("greatest(0, least(100, " + " + ".join(f"{minmax(c)} * {k}" for c, k in (("incident_count", 50), ("felony_rate", 20), ("weapon_rate", 15), ("average_loss", 15))) + "))")} as hotspot_score from hot_stats))"""


def _emerging_cte(days: int) -> str:
    return f"""dated as (select trim(district) as place, district, {day('occurred_date')} as d from raw),
old as (select district as location, count(*) as old_n from inc group by all),
new as (select district as location, count(*) as recent_count from dated where d >= (select max(d) from dated) - {days - 1} and district is not null group by all),
rates as (select location, coalesce(recent_count, 0) as recent_count, coalesce(recent_count, 0)::double / {days} as recent_rate,
  coalesce(old_n, 0)::double / (select max(occurred_date) - min(occurred_date) + 1 from inc) as old_rate from old full join new using (location)),
ratios as (select *, case when old_rate > 0 then recent_rate / old_rate when recent_count > 0 then 99.0e0 else 1.0e0 end as exact from rates),
emerging as (select location, recent_count, {rnd('recent_rate', 4)} as recent_rate, {rnd('old_rate', 4)} as historical_rate, {rnd('exact', 2)} as ratio,
  exact >= 1.5 and recent_count > 0 as is_emerging, case when exact > 1.05 then 'increasing' when exact < 0.95 then 'decreasing' else 'stable' end as trend from ratios)"""


WARNINGS_SQL = """select location, ratio, case when ratio >= 3 then 'CRITICAL' when ratio >= 2 then 'HIGH' else 'MODERATE' end as severity,
  location || ': ' || printf('%.2f', ratio) || ' times the usual activity' as message from emerging where is_emerging"""


def _dated(spark, sf_dir):
    return incoming(spark, sf_dir).select("district", date_of(F.col("occurred_date")).alias("occurred_date"))


def _hot(spark, sf_dir):
    return h.historical_hotspots(history(spark, sf_dir, RISK_COLUMNS))


def _emerging(spark, sf_dir, days=7):
    return h.emerging_hotspots(history(spark, sf_dir, ["district", "occurred_date"]), _dated(spark, sf_dir), days)


_add("historical_hotspots", _hot, with_history("select * from hot", HOT_CTE))
_add("hotspot_level", lambda spark, sf_dir: _hot(spark, sf_dir).select("location", "hotspot_level"), with_history("select location, hotspot_level from hot", HOT_CTE))
_add("emerging_hotspots", _emerging, with_incoming("select * from emerging", _emerging_cte(7), history=True))
_add("early_warnings", lambda spark, sf_dir: h.early_warnings(_emerging(spark, sf_dir)), with_incoming(WARNINGS_SQL, _emerging_cte(7), history=True))
_add("hotspot_summary", lambda spark, sf_dir: h.hotspot_summary(history(spark, sf_dir, RISK_COLUMNS), _dated(spark, sf_dir)), with_incoming(f"""
select 'hotspot' as part, location, hotspot_score as value, hotspot_level as level from hot
union all select 'emerging', location, ratio, trend from emerging
union all select 'warning', location, ratio, severity from ({WARNINGS_SQL})""", HOT_CTE, _emerging_cte(7), history=True))
_add("hotspot_lookup", lambda spark, sf_dir: h.hotspot_lookup(_hot(spark, sf_dir), ["NATION_4", "NATION_9"]), with_history("select * from hot where location in ('NATION_4', 'NATION_9')", HOT_CTE))
_add("hotspot_priority", lambda spark, sf_dir: h.hotspot_priority(_hot(spark, sf_dir), _emerging(spark, sf_dir)), with_incoming(f"""
select location, hotspot_score, coalesce(ratio, 1.0)::double as ratio, {rnd('greatest(0, least(100, hotspot_score * 0.7e0 + least(coalesce(ratio, 1.0), 3.0e0) / 3 * 30))')} as priority_score
from hot left join emerging using (location)""", HOT_CTE, _emerging_cte(7), history=True))

# The whole chain over the incoming incidents, of which one in twenty comes flagged, some of these without a score.
FLAGS_SQL = """substr(incident_id, 6)::bigint % 20 = 7 as is_anomaly,
    case when substr(incident_id, 6)::bigint % 60 <> 7 then (substr(incident_id, 6)::bigint % 1000) / 1000.0e0 end as anomaly_score"""
CHAIN_CTES = (
    BASELINE_CTE.strip(), _emerging_cte(14), _KNOWN_TABLES.format("raw.crime_type", "raw.district"),
    f"checked as (select *, {_list(_BASIC)} as errors from known)",
    f"""records as (select r.*, coalesce(latitude between min_latitude and max_latitude and longitude between min_longitude and max_longitude, false) as in_coverage
  from ({RECORD_SQL.replace('from raw', 'from checked where len(errors) = 0')}) r, ({_BOUNDS}))""",
    f"""scores as (select records.*, coalesce(historical_risk, 30.0)::double as historical_risk, ratio, {weight('crime_severity')} as sw,
    lower(trim(weapon_used)) not in ('', 'unknown', 'none', 'no', 'nan', 'false') as armed, lower(domestic_related) = 'yes' as domestic, lower(gang_related) = 'yes' as gang, {FLAGS_SQL}
  from records left join baseline using (district) left join emerging on location = district where in_coverage),
scored as (select *, {risk_level('dynamic_risk')} as risk_level from (select *, {rnd('''greatest(0, least(100, historical_risk * 0.5e0 + sw * 15 + case when armed then 10 else 0 end
    + case when domestic then 4 else 0 end + case when gang then 4 else 0 end + case when coalesce(ratio, 1) > 1 then least((ratio - 1) * 20, 30.0e0) else 0 end
    + case when is_anomaly then 12 else 0 end))''')} as dynamic_risk from scores)),
reasoned as (select *, list_filter(['District baseline ' || printf('%.1f', historical_risk),
    case when sw >= 0.8 then 'Severity raises the score' when sw >= 0.5 then 'Severity adds to the score' end,
    case when armed then 'Weapon: ' || weapon_used end, case when domestic then 'Domestic case' end, case when gang then 'Gang case' end,
    case when coalesce(ratio, 1) > 1 then 'Recent activity ' || printf('%.1f', {rnd('ratio')}) || ' times the usual' end,
    case when is_anomaly then coalesce('Unusual profile, score ' || printf('%.3f', anomaly_score), 'Unusual profile') end,
    'Risk ' || printf('%.1f', dynamic_risk) || ' of 100, ' || risk_level], lambda x: x is not null) as reasons from scored)""",
)


def _chain(sql: str) -> str:
    return with_incoming(sql, *CHAIN_CTES, history=True)


def _flagged(spark, sf_dir):
    score = F.when(F.col("event_id") % 60 != 7, F.col("event_id") % 1000 / 1000)
    return incoming(spark, sf_dir).withColumns({"is_anomaly": F.col("event_id") % 20 == 7, "anomaly_score": score})


def _add_chain(name: str, of, sql: str) -> None:
    """Registers ``of`` of the knowledge and the arriving rows twice.

    SQL can't grow the forest: under ``name`` the rows arrive with flags made from their number, as the SQL has them. The
    chain with the anomaly step is ``<name>_forest``, without SQL.
    """
    _add(name, lambda spark, sf_dir: of(live.knowledge(history(spark, sf_dir, CHAIN_COLUMNS), anomalies=False), _flagged(spark, sf_dir)), _chain(sql))
    QUERIES[f"{name}_forest"] = lambda spark, sf_dir: of(live.knowledge(history(spark, sf_dir, CHAIN_COLUMNS)), incoming(spark, sf_dir))


def _part(name: str):
    return lambda *x: getattr(live.process_incidents(*x), name)


_ASSESS = """'RISK-' || upper(md5(incident_id)) as assessment_id, incident_id, historical_risk, dynamic_risk, risk_level,
  '[' || array_to_string(list_transform(reasons, lambda x: '"' || x || '"'), ',') || ']' as reasons, is_anomaly as anomaly_flag, anomaly_score, submitted_at as created_at"""
_ALERT = """'ALT-' || upper(md5(incident_id)) as alert_id, incident_id, coalesce(district, 'None') || ' / ' || coalesce(nullif(neighborhood, ''), 'N/A') as location,
  case risk_level when 'CRITICAL' then 'Risk Escalation' else 'Elevated Risk' end as alert_type, risk_level,
  risk_level || ' risk: ' || crime_type || ' in ' || coalesce(district, 'None') as message, {} as recommendation, 'Open' as status, submitted_at as created_at
  from scored where risk_level in ('HIGH', 'CRITICAL')""".format(ACTION_SQL.format("risk_level"))
_add_chain("dynamic_risk", lambda *x: live.scored(*x).select("incident_id", "historical_risk", "ratio", "dynamic_risk", "risk_level"),
     "select incident_id, historical_risk, ratio, dynamic_risk, risk_level from scored")
_add_chain("risk_reasons", lambda *x: live.scored(*x).select("incident_id", F.posexplode("reasons").alias("place", "reason")),
     "select incident_id, unnest(range(len(reasons)))::int as place, unnest(reasons) as reason from reasoned")
_add_chain("recommend_priority", _part("recommendations"), f"""
select incident_id, district as area, risk_level as priority,
  case risk_level when 'MODERATE' then 'Attention' when 'HIGH' then 'Patrol priority' when 'CRITICAL' then 'Emergency priority' else 'Routine' end as focus,
  {ACTION_SQL.format('risk_level')} as action, reasons[len(reasons) - 1] as reason, true as decision_support_only from reasoned""")
_add_chain("risk_alerts", _part("alerts"), f"select {_ALERT}")
_add_chain("sink_assessments", lambda *x: records.assessments(live.scored(*x)), f"select {_ASSESS} from reasoned")
QUERIES["sink_assessments_forest"] = lambda spark, sf_dir: records.assessments(
    live.scored(live.knowledge(history(spark, sf_dir, CHAIN_COLUMNS)), incoming(spark, sf_dir)))
_add_chain("process_incidents", lambda *x: (lambda p: p.incidents.select("incident_id", "status", "in_coverage").join(
    p.assessments.select("incident_id", "dynamic_risk", "risk_level"), "incident_id", "left").unionByName(
    p.rejected.select("incident_id", F.lit("Rejected").alias("status")), allowMissingColumns=True))(live.process_incidents(*x)),
    """select incident_id, case when in_coverage then 'Processed' else 'Received' end as status, in_coverage, dynamic_risk, risk_level
  from records left join (select incident_id, dynamic_risk, risk_level from scored) using (incident_id)
  union all select incident_id, 'Rejected', null, null, null from checked where len(errors) > 0""")
_add_chain("list_assessments", lambda *x: records.newest(_part("assessments")(*x), "created_at", 50, risk_level="HIGH").select("assessment_id", "incident_id", "dynamic_risk"),
     "select 'RISK-' || upper(md5(incident_id)) as assessment_id, incident_id, dynamic_risk from scored where risk_level = 'HIGH' order by submitted_at desc, 1 limit 50")
_add_chain("list_alerts", lambda *x: records.newest(_part("alerts")(*x), "created_at", 40, status="Open").select("alert_id", "alert_type", "message"),
     f"select alert_id, alert_type, message from (select {_ALERT}) order by created_at desc, alert_id limit 40")
_add_chain("incident_with_assessments", lambda *x: (lambda p: records.with_assessments(p.incidents, p.assessments).select(
    "incident_id", F.coalesce(F.size("assessments"), F.lit(0)).alias("n"), F.col("assessments")[0]["risk_level"].alias("first_level")))(
    live.process_incidents(*x)),
    "select incident_id, case when risk_level is null then 0 else 1 end::int as n, risk_level as first_level from records left join (select incident_id, risk_level from scored) using (incident_id)")
_add_chain("mark_processed", lambda *x: (lambda p: records.mark_processed(p.incidents.withColumn("status", F.lit("Received")), p.assessments).select("incident_id", "status"))(
    live.process_incidents(*x)),
    "select incident_id, case when in_coverage then 'Processed' else 'Received' end as status from records")
_add("recent_incidents", lambda spark, sf_dir: records.newest(incoming(spark, sf_dir).select("incident_id", "crime_type", "submitted_at"), "submitted_at", 50).select("incident_id", "crime_type"),
     with_incoming("select incident_id, crime_type from raw order by submitted_at desc, incident_id limit 50"))
_add("recent_cutoff", lambda spark, sf_dir: records.recent(
    incoming(spark, sf_dir).select("incident_id", date_of(F.col("occurred_date")).alias("occurred_date")), F.lit("2024-01-30").cast("date"), 7).select("incident_id"),
    with_incoming(f"select incident_id from raw where ({day('occurred_date')}) >= date '2024-01-30' - 7"))
_add("decode_reasons", lambda spark, sf_dir: incoming(spark, sf_dir).select("incident_id", records.decode_reasons(F.col("reasons")).alias("r")).select(
    "incident_id", F.size("r").alias("n"), F.array_join("r", "|").alias("joined")),
    with_incoming("""select incident_id, len(r)::int as n, array_to_string(r, '|') as joined from (
  select incident_id, case when coalesce(reasons, '') = '' then [] when json_valid(reasons) then from_json(reasons, '["VARCHAR"]') else [reasons] end as r from raw)"""))
_add("public_record", lambda spark, sf_dir: records.public_record(incoming(spark, sf_dir).select("incident_id", "crime_type", "submitted_at")),
     with_incoming("select incident_id, crime_type, strftime(submitted_at, '%Y-%m-%dT%H:%M:%S') as submitted_at from raw"))
_add("apply_defaults", lambda spark, sf_dir: records.apply_defaults(incoming(spark, sf_dir)).select(
    "incident_id", "weapon_used", "domestic_related", "gang_related", "property_damage", "estimated_loss"), with_incoming("""
select incident_id, coalesce(weapon_used, 'Unknown') as weapon_used, coalesce(domestic_related, 'No') as domestic_related, coalesce(gang_related, 'No') as gang_related,
  coalesce(property_damage, 'No') as property_damage, coalesce(estimated_loss, '0') as estimated_loss from raw"""))
_add("ensure_columns", lambda spark, sf_dir: ensure_columns(
    history(spark, sf_dir, ["incident_id", "crime_type"]), {"weapon_used": F.lit("Unknown"), "estimated_loss": F.lit(0)}, ["incident_id"]),
    with_history("select incident_id, crime_type, 'Unknown' as weapon_used, 0 as estimated_loss from inc"))
_add("scan_incidents", lambda spark, sf_dir: __import__("vigil.sources.incidents", fromlist=["x"]).scan_incidents(
    spark, [f"{sf_dir}/missing.parquet", f"{sf_dir}/lineitem.parquet"], table(spark, sf_dir, "lineitem").schema).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n")),
    "select l_returnflag, count(*) as n from lineitem group by all")
_LONG = {"crime_type": 6, "district": 8, "neighborhood": 7}
_NEED = ["crime_type", "crime_category", "crime_severity", "occurred_date", "occurred_time"]


def _audit(spark, sf_dir):
    arrived = incoming(spark, sf_dir)
    twice = arrived.unionByName(arrived.filter("event_id % 41 = 0"))
    assessed = arrived.filter("event_id % 3 = 0").select(F.when(F.col("event_id") % 2 == 0, F.concat("incident_id", F.lit("X"))).otherwise(F.col("incident_id")).alias("incident_id"))
    return records.constraint_audit(twice, assessed, _LONG, _NEED)


_add("constraint_audit", _audit, with_incoming(" union all ".join(
    [f"select '{x} not null' as rule, count(*) filter ({x} is null) as violations from twice" for x in _NEED]
    + [f"select '{x} at most {n}', count(*) filter (length({x}) > {n}) from twice" for x, n in _LONG.items()]
    + ["select 'incident_id unique', count(*) - count(distinct incident_id) from twice",
       "select 'assessment has its incident', count(*) from raw where event_id % 3 = 0 and event_id % 2 = 0"]),
    "twice as (select * from raw union all select * from raw where event_id % 41 = 0)"))


def _deleted(spark, sf_dir):
    arrived = incoming(spark, sf_dir).select("incident_id", "event_id")
    assessed = arrived.filter("event_id % 2 = 0").select("incident_id")
    alerts = arrived.filter("event_id % 5 = 0").select(F.concat(F.lit("A"), "event_id").alias("alert_id"), "incident_id")
    a, b, c = records.delete_incidents(arrived, assessed, alerts, arrived.filter("event_id % 10 = 0"))
    return a.select(F.lit("incident").alias("part"), F.col("incident_id").alias("id"), "incident_id").unionByName(
        b.select(F.lit("assessment").alias("part"), F.col("incident_id").alias("id"), "incident_id")).unionByName(
        c.select(F.lit("alert").alias("part"), F.col("alert_id").alias("id"), "incident_id"))


_add("delete_incidents", _deleted, with_incoming("""
select 'incident' as part, incident_id as id, incident_id from raw where event_id % 10 <> 0
union all select 'assessment', incident_id, incident_id from raw where event_id % 2 = 0 and event_id % 10 <> 0
union all select 'alert', 'A' || event_id, case when event_id % 10 <> 0 then incident_id end from raw where event_id % 5 = 0"""))


def _runs(spark, sf_dir):
    """A run per month of the history: the month's districts with their scores."""
    rows = history(spark, sf_dir, ["district", "month", "crime_severity", "gang_related"])
    score = F.rint((F.count_if(F.col("crime_severity") == "Felony") * 60 + F.count_if(is_yes(F.col("gang_related"))) * 40) / F.count(F.lit(1)) * 10) / 10
    areas = rows.groupBy(F.col("month").alias("run_id"), F.col("district").alias("area")).agg(score.alias("score"))
    return areas.withColumn("risk_level", level(F.col("score")))


QUERIES["allocate_patrols"] = lambda spark, sf_dir: r.allocate_patrols(_runs(spark, sf_dir), 60).drop("weight")
ORACLES["allocate_patrols"] = with_history("select run_id, area, risk_level, score, u - coalesce(lost, 0) as units, true as decision_support_only from given left join lost using (run_id, area)",
    f"""areas as (select *, {risk_level('score')} as risk_level from (select month as run_id, district as area,
  round_even((count(*) filter (crime_severity = 'Felony') * 60 + count(*) filter (gang_related = 'Yes') * 40)::double / count(*) * 10, 0) / 10 as score from inc group by all)),
shared as (select *, w / sum(w) over (partition by run_id) * 60 as exact, count(*) over (partition by run_id) as n
  from (select *, case risk_level when 'CRITICAL' then 4.0e0 when 'HIGH' then 3.0e0 when 'MODERATE' then 2.0e0 else 1.0e0 end as w from areas)),
based as (select *, exact - floor(exact) as remainder, case when n <= 60 then greatest(floor(exact), 1) else floor(exact) end::bigint as b from shared),
placed as (select *, (sum(b) over (partition by run_id) - 60)::bigint as too_many, row_number() over (partition by run_id order by remainder desc, score desc, area) as k from based),
given as (select *, b + case when too_many < 0 and k <= -too_many then 1 else 0 end as u from placed),
lost as (select run_id, area, count(*) as lost from (select *, row_number() over (partition by run_id order by turn, remainder, score, area desc) as p
  from (select *, unnest(range(1, least(b - 1, too_many) + 1)) as turn from given where too_many > 0 and b > 1)) where p <= too_many group by all)""")


def _allocated(spark, sf_dir):
    recent = records.recent(_dated(spark, sf_dir), F.lit("2024-01-30").cast("date"), 7)
    return r.resource_allocation(_baseline(spark, sf_dir), recent, 60)


_add("resource_allocation", _allocated, with_incoming(f"""
select district, score, risk_level, recent_count, 1 + extra + left_over // areas + case when place <= left_over % areas then 1 else 0 end as units, true as decision_support_only
from (select *, greatest(60 - areas, 0) - sum(extra) over () as left_over from (
  select *, greatest(least(want, greatest(60 - areas, 0) - coalesce(sum(want) over (order by place rows between unbounded preceding and 1 preceding), 0)), 0) as extra from (
    select *, row_number() over (order by score desc, recent_count desc, district) as place, count(*) over () as areas, greatest(round_even(score / 25, 0) - 1, 0)::bigint as want from (
      select *, {rnd('full_score')} as score, {risk_level('full_score')} as risk_level from (
        select district, coalesce(c, 0) as recent_count, historical_risk + least(2 * coalesce(c, 0), 20) as full_score from baseline
        left join (select district, count(*) as c from raw where ({day('occurred_date')}) >= date '2024-01-30' - 7 group by all) using (district))))))""",
    BASELINE_CTE.strip(), history=True))


def _stored(spark, rows, put, by_month=False):
    """``rows`` through a table of files: a run that is tried again, a second run, and an attempt that was never committed."""
    path = new_folder(spark, "table")
    later = F.pmod(F.xxhash64("incident_id"), F.lit(2)) == 1
    rows = written(rows, "rows")
    put(rows.filter(~later), path, "first")
    put(rows.filter(~later), path, "first")
    put(rows.filter(later), path, "second")
    abandoned = rows.withColumns({"run": F.lit("second"), "attempt": F.lit("abandoned")})
    parts = ["month_part", "run", "attempt"] if by_month else ["run", "attempt"]
    if by_month:
        abandoned = abandoned.withColumn("month_part", F.date_format("submitted_at", "yyyy-MM"))
    abandoned.write.partitionBy(*parts).mode("append").parquet(f"{path}/data")
    return store.read(spark, path, rows.schema, by_month)


_add("sink_incidents", lambda spark, sf_dir: _stored(spark, incident_record(incoming(spark, sf_dir)), records.store_incidents, True).drop("run"),
     with_incoming(f"select *, strftime(submitted_at::timestamp, '%Y-%m') as month_part from ({RECORD_SQL})"))
_add("sink_alerts", lambda spark, sf_dir: _stored(spark, live.process_incidents(
    live.knowledge(history(spark, sf_dir, CHAIN_COLUMNS), anomalies=False), _flagged(spark, sf_dir)).alerts, records.store_alerts).drop("run"),
    _chain(f"select {_ALERT}"))
