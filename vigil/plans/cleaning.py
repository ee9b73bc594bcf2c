"""Cleaning and checking as registered queries on the incoming incidents."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions import expr as e
from vigil.operators import cleaning as c
from vigil.plans.oracle import day, is_time, num, risk_level, rnd, weight, with_history, with_incoming
from vigil.sources.incidents import history, incoming

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query, sql: str) -> None:
    QUERIES[name], ORACLES[name] = query, sql


def _column(name: str, column: str, f, sql: str, alias: str = "result") -> None:
    """A query that applies an expression to one column."""
    _add(name, lambda spark, sf_dir: incoming(spark, sf_dir).select("incident_id", f(F.col(column)).alias(alias)),
         with_incoming(f"select incident_id, {sql} as {alias} from raw"))


def _domains(spark, sf_dir):
    return c.valid_domains(history(spark, sf_dir, ["crime_type", "district"]))


def _score():
    return e.safe_float(F.col("estimated_loss")) * 1.5 - 20


SCORE_SQL = f"(coalesce({num('estimated_loss')}, 0) * 1.5e0 - 20)"
CLAMPED = f"greatest(0, least(100, {SCORE_SQL}))"
ACTION_SQL = "(case {} when 'MODERATE' then 'Watch the area more closely' when 'HIGH' then 'Send additional patrols' when 'CRITICAL' then 'Send units now and inform the commander' else 'Keep routine patrols' end)"

_column("clean_value", "neighborhood", e.clean_value, "case when neighborhood is null or trim(neighborhood) = '' then 'Unknown' else trim(neighborhood) end")
_column("safe_float", "latitude", e.safe_float, f"coalesce({num('latitude')}, 0.0)::double")
_column("safe_int", "estimated_loss", e.safe_int, f"coalesce(trunc({num('estimated_loss')}), 0)::bigint")
_column("coerce_numeric", "longitude", lambda x: e.safe_float(x, -1.0), f"coalesce({num('longitude')}, -1.0)::double")
_column("coerce_date", "occurred_date", lambda x: e.date_of(x).cast("string"), f"({day('occurred_date')})::varchar")
_column("valid_date", "occurred_date", e.valid_date, f"({day('occurred_date')}) is not null")
_column("valid_time", "occurred_time", e.valid_time, is_time("occurred_time"))
_column("time_period", "occurred_time", e.time_period, f"""case when not {is_time('occurred_time')} then 'Unknown'
  when try_cast(split_part(occurred_time, ':', 1) as int) between 5 and 11 then 'Morning' when try_cast(split_part(occurred_time, ':', 1) as int) between 12 and 16 then 'Afternoon'
  when try_cast(split_part(occurred_time, ':', 1) as int) between 17 and 20 then 'Evening' else 'Night' end""")
_column("severity_weight", "crime_severity", e.severity_weight, weight("crime_severity"))
_column("clamp_score", "incident_id", lambda _: e.clamp(_score()), f"{CLAMPED}::double")
_column("risk_level", "incident_id", lambda _: e.level(_score()), risk_level(SCORE_SQL))
_column("recommended_action", "incident_id", lambda _: e.by_level(F.lower(e.level(_score())), e.ACTIONS), ACTION_SQL.format(risk_level(SCORE_SQL)))
_add("risk_display", lambda spark, sf_dir: incoming(spark, sf_dir).withColumn("risk_level", e.level(_score())).select(
    "incident_id", "risk_level", e.by_level(F.col("risk_level"), e.LABELS).alias("label"), e.by_level(F.col("risk_level"), e.ICONS).alias("icon")),
    with_incoming(f"""select incident_id, l as risk_level, upper(left(l, 1)) || lower(substr(l, 2)) || ' risk' as label,
  case l when 'LOW' then 'green' when 'MODERATE' then 'yellow' when 'HIGH' then 'orange' else 'red' end as icon
  from (select incident_id, {risk_level(SCORE_SQL)} as l from raw)"""))
_add("risk_summary", lambda spark, sf_dir: incoming(spark, sf_dir).withColumn("score", e.rounded(e.clamp(_score()))).select(
    "incident_id", "score", e.level(F.col("score")).alias("risk_level"), e.by_level(e.level(F.col("score")), e.LABELS).alias("label"),
    e.by_level(e.level(F.col("score")), e.ACTIONS).alias("action")),
    with_incoming(f"""select incident_id, score, l as risk_level, upper(left(l, 1)) || lower(substr(l, 2)) || ' risk' as label, {ACTION_SQL.format('l')} as action
  from (select *, {risk_level('score')} as l from (select incident_id, {rnd(CLAMPED)} as score from raw))"""))
_add("stable_ids", lambda spark, sf_dir: incoming(spark, sf_dir).select(
    "incident_id", e.stable_id("RISK", F.col("incident_id")).alias("risk_id"), e.stable_id("ALT", F.col("incident_id"), F.col("submitted_at").cast("date").cast("string")).alias("alert_id")),
    with_incoming("""select incident_id, 'RISK-' || upper(md5(incident_id)) as risk_id,
  'ALT-' || upper(md5(incident_id || '|' || submitted_at::date::varchar)) as alert_id from raw"""))
_add("location_column", lambda spark, sf_dir: (lambda df: df.groupBy(F.col(c.location_column(df.columns)).alias("place")).agg(F.count(F.lit(1)).alias("n")))(
    history(spark, sf_dir, ["neighborhood", "crime_type"])), with_history("select neighborhood as place, count(*) as n from inc group by all"))
_add("valid_domains", _domains, with_history("""
select distinct 'crime_type' as field, crime_type as value from inc union all select distinct 'district', district from inc"""))

_REQUIRED = ["crime_type", "crime_category", "crime_severity", "latitude", "longitude", "occurred_date", "occurred_time"]
_KNOWN_TABLES = """types as (select distinct crime_type as t from inc), places as (select distinct district as p from inc),
known as (select raw.*, t is not null as known_type, p is not null as known_district from raw left join types on t = {0} left join places on p = {1})"""


def _list(rules: list[tuple[str, str]]) -> str:
    return "list_filter([" + ", ".join(f"case when {when} then '{code}' end" for when, code in rules) + "], lambda x: x is not null)"


_RULES = [
    ("not known_type", "crime_type unknown"), ("coalesce(trim(district), '') <> '' and not known_district", "district unknown"),
    (f"({num('latitude')}) is null", "latitude not a number"), (f"({num('longitude')}) is null", "longitude not a number"),
    (f"({num('latitude')}) not between -90 and 90", "latitude out of range"), (f"({num('longitude')}) not between -180 and 180", "longitude out of range"),
    (f"({day('occurred_date')}) is null", "occurred_date malformed"), (f"not {is_time('occurred_time')}", "occurred_time malformed"),
    ("trim(crime_severity) not in ('Infraction', 'Misdemeanor', 'Felony')", "crime_severity unknown"),
    *[(f"lower(trim({x})) not in ('yes', 'no')", f"{x} not yes or no") for x in ("domestic_related", "gang_related", "property_damage")],
    (f"({num('estimated_loss')}) < 0", "estimated_loss negative"), (f"({num('estimated_loss')}) is null", "estimated_loss not a number"),
]
VALIDATED_SQL = f"""checked as (select *, case when len(missing) > 0 then missing else {_list(_RULES)} end as errors
  from (select *, {_list([(f"coalesce(trim({x}), '') = ''", f"{x} missing") for x in _REQUIRED])} as missing from known))"""
_add("validate_incidents", lambda spark, sf_dir: c.validate_incidents(incoming(spark, sf_dir), _domains(spark, sf_dir)).select(
    "incident_id", "valid", F.concat_ws("; ", "errors").alias("errors")),
    with_incoming("select incident_id, len(errors) = 0 as valid, array_to_string(errors, '; ') as errors from checked",
                  _KNOWN_TABLES.format("trim(raw.crime_type)", "trim(raw.district)"), VALIDATED_SQL, history=True))
_BASIC = [(f"coalesce({x}, '') = ''", f"{x} missing") for x in ("crime_type", "crime_category", "crime_severity", "occurred_date", "occurred_time")] + [
    ("not known_type", "crime_type not in the history"), ("coalesce(district, '') <> '' and not known_district", "district not in the history"),
    (f"({num('latitude')}) is null or ({num('longitude')}) is null", "coordinates not numbers")]
_add("validate_basic", lambda spark, sf_dir: c.validate_basic(incoming(spark, sf_dir), _domains(spark, sf_dir)).select(
    "incident_id", "valid", F.concat_ws("; ", "errors").alias("errors")),
    with_incoming(f"select incident_id, len(errors) = 0 as valid, array_to_string(errors, '; ') as errors from (select *, {_list(_BASIC)} as errors from known)",
                  _KNOWN_TABLES.format("raw.crime_type", "raw.district"), history=True))
_add("normalize_incidents", lambda spark, sf_dir: c.normalize_incidents(incoming(spark, sf_dir)), with_incoming(f"""
select incident_id, trim(coalesce(crime_type, '')) as crime_type, trim(coalesce(crime_category, '')) as crime_category,
  trim(coalesce(crime_severity, '')) as crime_severity, trim(district) as district, trim(neighborhood) as neighborhood,
  coalesce({num('latitude')}, 0)::double as latitude, coalesce({num('longitude')}, 0)::double as longitude,
  coalesce(trunc({num('estimated_loss')}), 0)::bigint as estimated_loss, coalesce(nullif(weapon_used, ''), 'Unknown') as weapon_used,
  coalesce(nullif(domestic_related, ''), 'No') as domestic_related, coalesce(nullif(gang_related, ''), 'No') as gang_related,
  coalesce(nullif(property_damage, ''), 'No') as property_damage from raw"""))
RECORD_SQL = f"""select incident_id, coalesce(crime_type, 'Unknown') as crime_type, coalesce(crime_category, 'Unknown') as crime_category,
  coalesce(crime_severity, 'Misdemeanor') as crime_severity, district, neighborhood, coalesce({num('latitude')}, 0)::double as latitude,
  coalesce({num('longitude')}, 0)::double as longitude, coalesce(occurred_date, '') as occurred_date, occurred_time,
  coalesce(weapon_used, 'Unknown') as weapon_used, coalesce(domestic_related, 'No') as domestic_related, coalesce(gang_related, 'No') as gang_related,
  coalesce(property_damage, 'No') as property_damage, coalesce(trunc({num('estimated_loss')}), 0)::bigint as estimated_loss,
  'Low' as priority_level, 'batch' as source, 'Received' as status, submitted_at from raw"""
_add("incident_record", lambda spark, sf_dir: c.incident_record(incoming(spark, sf_dir)), with_incoming(RECORD_SQL))
_BOUNDS = "select min(latitude) as min_latitude, max(latitude) as max_latitude, min(longitude) as min_longitude, max(longitude) as max_longitude from inc"
_add("coverage_bounds", lambda spark, sf_dir: c.coverage_bounds(history(spark, sf_dir, ["latitude", "longitude"])), with_history(_BOUNDS))
_add("within_coverage", lambda spark, sf_dir: c.within_coverage(
    incoming(spark, sf_dir), c.coverage_bounds(history(spark, sf_dir, ["latitude", "longitude"]))).select("incident_id", "in_coverage"),
    with_incoming(f"""select incident_id, coalesce(({num('latitude')}) between min_latitude and max_latitude
  and ({num('longitude')}) between min_longitude and max_longitude, false) as in_coverage from raw, ({_BOUNDS})""", history=True))
_add("label_encode", lambda spark, sf_dir: c.label_encode(
    incoming(spark, sf_dir), c.label_codes(history(spark, sf_dir, ["district"]), "district"), "district").select("incident_id", "district_code"),
    with_incoming("""select incident_id, coalesce(code, (select code from codes where v = 'Unknown')) as district_code
  from raw left join codes on v = case when coalesce(trim(district), '') = '' then 'Unknown' else trim(district) end""",
                  "codes as (select v, row_number() over (order by v) - 1 as code from (select distinct district as v from inc union select 'Unknown'))", history=True))
_add("forward_fill", lambda spark, sf_dir: c.forward_fill(
    incoming(spark, sf_dir).select("event_id", "incident_id", "weapon_used", "district"), "event_id", ["weapon_used", "district"]),
    with_incoming("""select event_id, incident_id, last_value(weapon_used ignore nulls) over w as weapon_used, last_value(district ignore nulls) over w as district
  from raw window w as (order by event_id rows between unbounded preceding and current row)"""))
