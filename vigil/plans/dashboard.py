"""The dashboard reports as registered queries on the history."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigil.constants import MONTHS, SEVERITIES
from vigil.operators import dashboard as d
from vigil.plans.oracle import flags, mean, modes_cte, rate, rate_all, rnd, with_history
from vigil.sources.incidents import history

CRIMES = ["PROMO", "SMALL"]
DISTRICTS = ["NATION_1", "NATION_2", "NATION_3"]
GANG_SQL = "coalesce(time_category = 'Night' and weapon_used = 'Firearm', false)"


def _gang() -> Column:
    """A stand-in for a model's prediction of gang involvement."""
    return F.coalesce((F.col("time_category") == "Night") & (F.col("weapon_used") == "Firearm"), F.lit(False))


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(name: str, columns: str, report, sql: str, *ctes: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: report(history(spark, sf_dir, columns.split()))
    ORACLES[name] = with_history(sql, *ctes)


def _counts(name: str, report, *by: str) -> None:
    keys = ", ".join(by)
    there = " and ".join(f"{c} is not null" for c in by)
    _add(name, " ".join(by), report, f"select {keys}, count(*) as n from inc where {there} group by {keys}")


MONTH_LIST = "(values " + ", ".join(f"('{m}', {i})" for i, m in enumerate(MONTHS, 1)) + ") as months(month, month_no)"
COUNT = "count(*) as n"


def _pattern_sql(tail: str) -> str:
    return f"""
    select crime_type, district, time_category, weapon_used, {rnd("risk3")} as risk from (
      select *, case when weapon_used in ('Firearm', 'Knife') then least(risk2 + 15, 100) else risk2 end as risk3 from (
        select *, case when {GANG_SQL} then least(risk1 + 20, 100) else risk1 end as risk2 from (
          select w.*, {rnd("least(p.n::double / a.n * 100.0e0 * 3.0e0, 100.0e0)")} as risk1
          from (select distinct crime_type, district, time_category, weapon_used from inc where weapon_used is not null) w
          join (select crime_type, district, time_category, {COUNT} from inc group by all) p using (crime_type, district, time_category)
          join (select district, time_category, {COUNT} from inc group by all) a using (district, time_category)))){tail}"""


LEVEL70 = "case when risk < 25 then 'LOW' when risk < 45 then 'MODERATE' when risk < 70 then 'HIGH' else 'CRITICAL' end"

_add("loss_stats", "crime_type estimated_loss", d.loss_stats, f"""
select crime_type, {mean('estimated_loss')} as mean, min(estimated_loss) as min, max(estimated_loss) as max,
  {rnd('stddev_samp(estimated_loss)', 2)} as std from inc group by crime_type""")
_month_crime = f"""
select crime_type, month, coalesce(n, 0) as n {{more}} from (select distinct crime_type from inc) cross join {MONTH_LIST}
left join (select crime_type, month, {COUNT} from inc group by all) using (crime_type, month)"""
_add("month_crime", "crime_type month", d.month_crime, _month_crime.format(more=""))
_add("month_crime_pivot", "crime_type month", d.month_crime_pivot, _month_crime.format(more=", month_no"))
_add("district_month_pivot", "district month", d.district_month_pivot, "select district, " + ", ".join(
    f"count(*) filter (month = '{m}') as {m.lower()}" for m in MONTHS) + " from inc group by district")
_add("pattern_risk", "crime_type district time_category weapon_used", lambda h: d.pattern_risk(h, _gang()),
     f"select *, {LEVEL70} as risk_level from ({_pattern_sql('')})")
_add("loss_range", "crime_type estimated_loss", lambda h: d.loss_range(h, ["PROMO", "LARGE", "ARSON"]), f"""
select crime_type, coalesce(greatest(0, min(estimated_loss)), 0)::double as loss_min, coalesce({mean('estimated_loss')}, 0) as loss_mean,
  coalesce(max(estimated_loss), 0)::double as loss_max
from (values ('PROMO'), ('LARGE'), ('ARSON')) as w(crime_type) left join inc using (crime_type) group by crime_type""")
_add("arrest_gap", "crime_type district time_category arrest_made", d.arrest_gap, f"""
select *, {rnd('rate - city_rate')} as gap from (
  select crime_type, district, time_category, count(*) as cases, count(*) filter (arrest_made = 'Yes') as resolved,
    coalesce({rate()}, 0) as rate from inc group by all), (select {rate()} as city_rate from inc)""")
_PROFILE = ["crime_severity", "weapon_used", "time_category", "premises_type"]
_add("modal_profile", "crime_type district crime_severity weapon_used time_category premises_type", d.modal_profile,
     "select * from m", modes_cte("m", "crime_type, district", _PROFILE))
_THREAT = f"""select district, crime_type, share from (
  select *, row_number() over (partition by district order by share desc, crime_type) as k from (
    select district, crime_type, {rnd('100.0e0 * n / sum(n) over (partition by crime_type)')} as share
    from (select district, crime_type, {COUNT} from inc group by all))) where k = 1"""
_add("top_threat", "district crime_type", d.top_threat, _THREAT)


def _shares_sql(column: str, where: str = "true") -> str:
    return f"""select {column}, n, {rnd('100.0e0 * n / sum(n) over ()')} as share
    from (select {column}, {COUNT} from inc where {column} is not null and {where} group by all)"""


_add("gang_share", "gang_related", d.gang_share, _shares_sql("gang_related"))
_add("avg_victims_by_crime", "crime_type victim_count", d.avg_victims_by_crime, f"""
select *, {flags('avg_victims', 'crime_type', 'highest', 'lowest')}
from (select crime_type, {mean('victim_count')} as avg_victims from inc group by all)""")
_add("gang_weapon", "gang_related weapon_used", d.gang_weapon, f"""
select * from (select gang_related, weapon_used, {COUNT} from inc where weapon_used is not null group by all),
  (select weapon_used as gang_weapon from inc where gang_related = 'Yes' and weapon_used is not null group by 1 order by count(*) desc, 1 limit 1)""")
_FIELDS = ["weapon_used", "crime_severity", "victim_gender", "suspect_gender", "victim_age_group", "suspect_age_group", "time_category"]
_add("value_shares", " ".join(_FIELDS), lambda h: d.value_shares(h, _FIELDS), " union all ".join(
    f"select '{c}' as field, {c} as value, n, share from ({_shares_sql(c)})" for c in _FIELDS))
_add("bounded_sample", "incident_id row_key", lambda h: d.bounded_sample(h, 100), """
select incident_id, ((row_key % 2147483647) * 48271 + 11) % 2147483647 as draw from inc order by draw, incident_id limit 100""")
_add("geo_density", "latitude longitude", d.geo_density, f"""
select * from (select floor(latitude * 100 + 0.5)::bigint as lat_cell, floor(longitude * 100 + 0.5)::bigint as lon_cell, {COUNT} from inc group by all),
  (select {rnd('avg(latitude)', 5)} as centre_lat, {rnd('avg(longitude)', 5)} as centre_lon from inc)""")
_counts("crime_by_district", d.crime_by_district, "crime_type", "district")
_add("action_list", "crime_type district time_category weapon_used", lambda h: d.action_list(h, _gang()), f"""
select crime_type, district, time_category, weapon_used, unnest(range(len(a)))::int as place, unnest(a) as action from (
  select *, list_filter([
    case when u then 'send a rapid response unit' end, case when u then 'raise the number of patrols' end,
    case when not u then 'keep the usual patrols' end, case when {GANG_SQL} then 'inform the gang unit' end,
    case when {GANG_SQL} then 'compare with known groups' end, case when weapon_used in ('Firearm', 'Knife') then 'send armed officers' end,
    case when weapon_used in ('Firearm', 'Knife') and {GANG_SQL} then 'prepare for armed groups' end,
    'collect evidence at the scene', 'interview witnesses'], lambda x: x is not null) as a
  from (select *, {LEVEL70} in ('CRITICAL', 'HIGH') as u from ({_pattern_sql('')})))""")
_counts("district_priority", d.district_priority, "district", "priority_level")
_GROWTH = f"""g as (select crime_type, late, early, {rnd('(late - early) * 100.0e0 / case when early = 0 then 1 else early end')} as growth
  from (select crime_type, count(*) filter (month_no >= 10) as late, count(*) filter (month_no <= 6) as early from inc group by all))"""
_add("threat_growth", "crime_type month", d.threat_growth, """
select * from (select *, 'rising' as direction from g order by growth desc, crime_type limit 3)
union all select * from (select *, 'falling' as direction from g order by growth, crime_type limit 3)""", _GROWTH)
_add("monthly_flow", "crime_type month", lambda h: d.monthly_flow(h, CRIMES), f"""
select crime_type, month, coalesce(n, 0) as n from (values ('PROMO'), ('SMALL')) as c(crime_type) cross join {MONTH_LIST}
left join (select crime_type, month, {COUNT} from inc group by all) using (crime_type, month)""")
_add("monthly_totals", "month", d.monthly_totals, f"""
select *, {flags('n', 'month_no', 'peak', 'trough')} from (
  select month, month_no, count(inc.incident_id) as n from {MONTH_LIST} left join inc using (month, month_no) group by all)""")
_add("district_month_long", "district month", d.district_month_long, f"""
select district, month, month_no, coalesce(n, 0) as n from (select distinct district from inc) cross join {MONTH_LIST}
left join (select district, month, {COUNT} from inc group by all) using (district, month)""")
_counts("district_totals", d.district_totals, "district")
_add("month_compare", "crime_type month", lambda h: d.month_compare(h, "March", "October"), f"""
select *, {flags('change', 'crime_type', 'largest_rise', 'largest_fall')} from (
  select *, n_other - n_one as change, case when n_other > n_one then 'up' when n_other < n_one then 'down' else 'same' end as direction
  from (select crime_type, count(*) filter (month_no = 3) as n_one, count(*) filter (month_no = 10) as n_other from inc group by all))""")
_add("season_crime", "season crime_type", d.season_crime, f"""
select *, sum(n) over (partition by season)::bigint as season_total from (select season, crime_type, {COUNT} from inc group by all)""")
_add("season_loss", "season estimated_loss", d.season_loss, f"""
select *, {flags('avg_loss', 'season', 'worst', 'mildest')} from (select season, {mean('estimated_loss')} as avg_loss from inc group by all)""")
_add("district_season", "district season", d.district_season, f"""
select *, {flags('n', 'district, season', 'largest', None)} from (select district, season, {COUNT} from inc group by all)""")
_add("holiday_counts", "is_holiday crime_type", d.holiday_counts, f"""
select is_holiday, crime_type, {COUNT}, case is_holiday when 'Yes' then 'Holiday' else 'Normal day' end as label from inc group by all""")
_add("holiday_resolution", "is_holiday arrest_made", d.holiday_resolution, f"""
select *, {rnd('holiday_rate - normal_rate')} as difference from (
  select (select {rate()} from inc where is_holiday = 'Yes') as holiday_rate, (select {rate()} from inc where is_holiday = 'No') as normal_rate)""")
_add("holiday_ratio", "is_holiday crime_type", d.holiday_ratio, f"""
select *, {rnd('holiday::double / nullif(normal, 0)', 3)} as ratio from (
  select crime_type, count(*) filter (is_holiday = 'Yes') as holiday, count(*) filter (is_holiday = 'No') as normal from inc group by all)""")
_counts("priority_severity", d.priority_severity, "priority_level", "crime_severity")
_add("severity_share_by_priority", "priority_level crime_severity", d.severity_share_by_priority, f"""
select *, {rnd('100.0e0 * n / sum(n) over (partition by priority_level)')} as share
from (select priority_level, crime_severity, {COUNT} from inc group by all)""")
_add("priority_resolution", "priority_level arrest_made", lambda h: d.resolution_by(h, "priority_level"), f"""
select *, {flags('rate', 'priority_level', 'best', 'worst')} from (select priority_level, {rate()} as rate from inc group by all)""")
_TARGET = ["victim_gender", "suspect_gender", "victim_age_group", "suspect_age_group", "premises_type"]
_add("target_profile", "crime_type arrest_made " + " ".join(_TARGET), d.target_profile, """
select m.*, resolved_text from m join (
  select crime_type, count(*) filter (arrest_made = 'Yes') || '/' || count(*) as resolved_text from inc group by all) using (crime_type)""",
     modes_cte("m", "crime_type", _TARGET))
_counts("victim_gender_crime", lambda h: d.counts(h, "victim_gender", "crime_type"), "victim_gender", "crime_type")
_add("crime_composition", "district crime_type", d.crime_composition, f"""
select c.*, t.total, t.busiest from (select district, crime_type, {COUNT} from inc group by all) c join (
  select *, {flags('total', 'district', 'busiest', None)} from (select district, count(*) as total from inc group by all)) t using (district)""")
_add("evidence_resolution", "evidence_collected arrest_made", d.evidence_resolution, f"""
select *, {rnd('with_evidence - without_evidence')} as lift from (
  select (select {rate()} from inc where evidence_collected = 'Yes') as with_evidence,
    (select {rate()} from inc where evidence_collected = 'No') as without_evidence)""")
_add("outcome_grid", "district crime_type arrest_made evidence_collected", d.outcome_grid, f"""
select *, {rnd('avg(rate) filter (enough_rows) over (partition by district)', 2)} as rate_mean,
  {rnd('avg(rate) over (partition by district)', 2)} as rate_mean_all from (
  select district, crime_type, {COUNT}, {rate_all()} as rate, {rate_all('evidence_collected')} as evidence, count(*) > 5 as enough_rows
  from inc group by district, crime_type)""")
_add("arrest_rate_by_crime", "crime_type arrest_made", d.arrest_rate_by_crime, f"select crime_type, {rate_all()} as rate from inc group by all")
_add("timing_peaks", "crime_type time_category day_of_week season arrest_made", d.timing_peaks,
     f"select m.*, rate from m join (select crime_type, {rate()} as rate from inc group by all) using (crime_type)",
     modes_cte("m", "crime_type", ["time_category", "day_of_week", "season"]))
_counts("time_counts", d.time_counts, "time_category")
_add("day_time_matrix", "day_of_week time_category", d.day_time_matrix, f"""
select *, {flags('n', 'day_no, time_category', 'peak', None)} from (select day_of_week, time_category, day_no, {COUNT} from inc group by all)""")
_add("day_counts", "day_of_week", d.day_counts, f"""
select *, {flags('n', 'day_no', 'peak', None)} from (select day_of_week, day_no, {COUNT} from inc group by all)""")
_counts("time_severity", d.time_severity, "time_category", "crime_severity")
_add("day_arrest", "day_of_week arrest_made", d.day_arrest, f"""
select a.*, rate from (select day_of_week, arrest_made, {COUNT} from inc where arrest_made is not null group by all) a
join (select day_of_week, {rate()} as rate from inc group by all) using (day_of_week)""")
_add("severity_mix_by_time", "time_category crime_severity", lambda h: d.severity_mix_by_time(h, [*SEVERITIES, "Grave"]), f"""
select *, {rnd('100.0e0 * n / sum(n) over (partition by time_category)')} as share from (
  select time_category, crime_severity, coalesce(n, 0) as n from (select distinct time_category from inc) cross join
    (values ('Infraction'), ('Misdemeanor'), ('Felony'), ('Grave')) as s(crime_severity)
  left join (select time_category, crime_severity, {COUNT} from inc group by all) using (time_category, crime_severity))""")
_add("district_compare_monthly", "district month", lambda h: d.district_compare_monthly(h, DISTRICTS), f"""
select district, month, {COUNT} from inc where district in ('NATION_1', 'NATION_2', 'NATION_3') group by all""")
_add("district_rank", "district arrest_made estimated_loss crime_type", lambda h: d.district_rank(h, DISTRICTS), f"""
select district, total, resolved || ' (' || printf('%.1f', rate) || '%)' as resolved_text, avg_loss, crime_type_mode as main_crime from (
  select district, count(*) as total, count(*) filter (arrest_made = 'Yes') as resolved, coalesce({rate()}, 0) as rate,
    ({mean('estimated_loss', 0)})::bigint as avg_loss from inc where district in ('NATION_1', 'NATION_2', 'NATION_3') group by all)
join m using (district)""", modes_cte("m", "district", ["crime_type"]))
_add("avg_loss_by_crime", "crime_type estimated_loss", lambda h: d.avg_loss_by(h, "crime_type"),
     f"select crime_type, {mean('estimated_loss')} as avg_loss from inc group by all")
_add("avg_loss_by_district", "district estimated_loss", d.avg_loss_by_district, f"""
select *, {rnd('max(avg_loss) over () / greatest(min(avg_loss) over (), 1)', 2)} as top_to_low
from (select district, {mean('estimated_loss')} as avg_loss from inc group by all)""")
_add("loss_grid", "district crime_type estimated_loss", d.loss_grid, f"""
select *, {flags('avg_loss', 'district, crime_type', 'largest', None)}
from (select district, crime_type, {mean('estimated_loss')} as avg_loss from inc group by all)""")
_add("district_resolution", "district arrest_made", d.district_resolution, f"""
select *, total - resolved as unresolved, {flags('rate', 'district', 'best', 'worst')} from (
  select district, count(*) as total, count(*) filter (arrest_made = 'Yes') as resolved, {rate()} as rate from inc group by all)""")
_add("gang_by_district", "gang_related district", d.gang_by_district, _shares_sql("district", "gang_related = 'Yes'"))
_add("weapon_by_district", "district weapon_used", d.weapon_by_district, f"""
select *, {flags('n', 'district, weapon_used', 'largest', None)}
from (select district, weapon_used, {COUNT} from inc where weapon_used is not null group by all)""")
_counts("report_source_arrest", d.report_source_arrest, "reported_by", "arrest_made")
_add("report_source_rate", "reported_by arrest_made", lambda h: d.resolution_by(h, "reported_by"), f"""
select *, {flags('rate', 'reported_by', 'best', 'worst')} from (select reported_by, {rate()} as rate from inc group by all)""")
_add("directives", "district crime_type time_category weapon_used", lambda h: d.directives(h, _gang()), f"""
select district, x.place::int as place, x.priority::int as priority, x.directive as directive from (
  select district, unnest([
    {{place: 1, priority: 1, directive: 'More patrols against ' || crime_type || ' (' || printf('%.1f', share) || '% of its cases) at ' || time_category_mode || ' hours'}},
    {{place: 2, priority: 1, directive: 'Collect evidence at every scene'}},
    {{place: 3, priority: case when gang then 1 else 2 end, directive: 'Gang unit: involvement ' || case when gang then 'expected' else 'possible' end || ' in ' || district}},
    {{place: 4, priority: 2, directive: 'Move units before the peak season'}},
    {{place: 5, priority: 2, directive: 'Strengthen weekend and night shifts'}},
    {{place: 6, priority: 2, directive: 'Build reporting channels in ' || district}},
    {{place: 7, priority: 3, directive: 'Align patrol zones with the density of cases'}}]) as x
  from ({_THREAT}) join m using (district) join (select district, bool_or({GANG_SQL}) as gang from inc group by all) using (district))""",
     modes_cte("m", "district", ["time_category"]))
_add("entry_defaults", "crime_type crime_category latitude longitude weapon_used", d.entry_defaults, f"""
select m.*, {rnd('mid_lat', 6)} as mid_lat, {rnd('mid_lon', 6)} as mid_lon, 'None,Firearm,Knife,Blunt Object' as weapons
from m, (select quantile_cont(latitude, 0.5) as mid_lat, quantile_cont(longitude, 0.5) as mid_lon from inc)""",
     modes_cte("m", "crime_type", ["crime_category"]))
_add("record_counts", "incident_id crime_type district", lambda h: d.record_counts(h, crime_type="PROMO", district="NATION_1"), """
select count(*) as total, count(*) filter (crime_type = 'PROMO' and district = 'NATION_1') as matching from inc""")
_add("calendar_order", "month day_of_week", d.calendar_order, f"select month, day_of_week, month_no, day_no, {COUNT} from inc group by all")
