"""The two incident views in DuckDB SQL, written apart from the Spark ones, and small SQL helpers."""

from __future__ import annotations

HISTORY_SQL = """
inc_base as (
  select *, (l_orderkey * 7 + l_linenumber * 61 + l_partkey * 13) % 1440 as mi, l_shipdate::date as d
  from lineitem join part on p_partkey = l_partkey join orders on o_orderkey = l_orderkey
  join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey),
inc as (
  select 'INC-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_quantity::int || '-'
      || round_even(l_extendedprice * 100, 0)::bigint || '-' || strftime(d, '%Y%m%d') as incident_id,
    p_type as crime_type, p_brand as crime_category,
    case when l_returnflag = 'R' then 'Felony' when l_returnflag = 'A' then 'Misdemeanor' else 'Infraction' end as crime_severity,
    n_name as district, c_mktsegment as neighborhood,
    40.0e0 + n_nationkey * 0.01e0 + (l_partkey % 100) * 0.0005e0 as latitude,
    -74.0e0 + n_regionkey * 0.02e0 + (l_suppkey % 50) * 0.0005e0 as longitude,
    d as occurred_date, lpad((mi // 60)::varchar, 2, '0') || ':' || lpad((mi % 60)::varchar, 2, '0') as occurred_time,
    case when mi >= 1260 or mi < 300 then 'Night' when mi < 720 then 'Morning' when mi < 1020 then 'Afternoon' else 'Evening' end as time_category,
    monthname(d) as month, month(d) as month_no, dayname(d) as day_of_week, isodow(d) as day_no,
    case month(d) % 12 // 3 when 0 then 'Winter' when 1 then 'Spring' when 2 then 'Summer' else 'Autumn' end as season,
    case left(o_orderpriority, 1) when '1' then 'Firearm' when '2' then 'Knife' when '3' then 'Blunt Object' when '5' then 'None' end as weapon_used,
    case when left(o_orderpriority, 1) in ('1', '2') then 'High' when left(o_orderpriority, 1) = '3' then 'Medium' else 'Low' end as priority_level,
    case when l_tax >= 0.04e0 then 'Yes' else 'No' end as domestic_related,
    case when l_linestatus = 'O' then 'Yes' else 'No' end as gang_related,
    case when l_discount >= 0.05e0 then 'Yes' else 'No' end as property_damage,
    case when l_suppkey % 11 = 0 then null when o_orderstatus = 'F' then 'Yes' when o_orderstatus = 'P' and l_partkey % 3 = 0 then 'Yes' else 'No' end as arrest_made,
    case when l_quantity > 25 then 'Yes' else 'No' end as evidence_collected,
    case when day(d) = 1 or day(d) = 25 then 'Yes' else 'No' end as is_holiday,
    trunc(l_extendedprice)::int as estimated_loss, l_linenumber as victim_count, p_size % 5 as suspect_count,
    l_quantity as investigation_hours,
    case c_mktsegment when 'AUTOMOBILE' then 'Patrol' when 'BUILDING' then 'Victim' when 'FURNITURE' then 'Witness'
      when 'HOUSEHOLD' then 'Neighbour' else 'Camera' end as reported_by,
    case l_suppkey % 4 when 0 then 'Street' when 1 then 'Residence' when 2 then 'Shop' else 'Park' end as premises_type,
    case when l_linenumber % 2 = 0 then 'Female' else 'Male' end as victim_gender,
    case l_partkey % 3 when 0 then 'Female' when 1 then 'Male' else 'Unknown' end as suspect_gender,
    case when p_size <= 15 then 'Under 25' when p_size <= 35 then '25-40' else 'Over 40' end as victim_age_group,
    case when l_quantity <= 15 then 'Under 25' when l_quantity <= 35 then '25-40' else 'Over 40' end as suspect_age_group,
    case l_suppkey % 3 when 0 then 'Clear' when 1 then 'Rain' else 'Fog' end as weather,
    case when l_partkey % 50 = 0 then 'Yes' else 'No' end as hate_crime,
    case when l_partkey % 2 = 1 then 'Yes' else 'No' end as video_footage,
    l_orderkey * 1000003 + l_linenumber * 10007 + l_partkey * 101 + l_suppkey as row_key
  from inc_base)"""


def with_history(sql: str, *ctes: str) -> str:
    return "with " + ",\n".join([HISTORY_SQL.strip(), *ctes]) + "\n" + sql


def rnd(x: str, digits: int = 1) -> str:
    return f"round_even(({x}) * {10**digits}, 0) / {10**digits}"


def rate(flag: str = "arrest_made") -> str:
    return rnd(f"100.0e0 * count(*) filter ({flag} = 'Yes') / nullif(count({flag}), 0)")


def rate_all(flag: str = "arrest_made") -> str:
    return rnd(f"100.0e0 * count(*) filter ({flag} = 'Yes') / count(*)")


def mean(x: str, digits: int = 2) -> str:
    return rnd(f"avg({x})", digits)


def flags(value: str, names: str, top: str, low: str | None) -> str:
    out = f"row_number() over (order by {value} desc, {names}) = 1 as {top}"
    return out + (f", row_number() over (order by {value}, {names}) = 1 as {low}" if low else "")


def modes_cte(name: str, by: str, columns: list[str], source: str = "inc") -> str:
    """A CTE with the most frequent value of each column per group, the smallest of equals."""
    long = " union all ".join(f"select {by}, '{c}' as c, {c}::varchar as v from {source}" for c in columns)
    picks = ", ".join(f"max(v) filter (c = '{c}') as {c}_mode" for c in columns)
    return (
        f"{name} as (select {by}, {picks} from (select {by}, c, v, row_number() over (partition by {by}, c order by count(*) desc, v) as k "
        f"from ({long}) where v is not null group by {by}, c, v) where k = 1 group by {by})"
    )


def _faults(good: str, bad: str, by: int) -> str:
    """``bad``: 'remainder=SQL text; ...'."""
    return f"case event_id % {by} " + " ".join("when {} then {}".format(*x.strip().split("=", 1)) for x in bad.split(";")) + f" else {good} end"


INCOMING_SQL = f"""
raw as (
  select 'INC-E' || event_id as incident_id,
    {_faults("case event_type when 'click' then 'PROMO' when 'view' then 'ECONOMY' when 'error' then 'MEDIUM' when 'signup' then 'SMALL' else 'LARGE' end", "3='  PROMO '; 5='ARSON'; 7=''; 11=null", 97)} as crime_type,
    {_faults("'Brand#' || event_id % 5", "13=null; 17='   '", 89)} as crime_category,
    {_faults("case event_type when 'error' then 'Felony' when 'purchase' then 'Misdemeanor' else 'Infraction' end", "2='Grave'; 19=' Felony '; 23=null", 83)} as crime_severity,
    {_faults("'NATION_' || user_id % 25", "4=null; 6=''; 8='ATLANTIS'; 10='  NATION_3'", 79)} as district,
    {_faults("'Block ' || user_id % 7", "1=null; 2='  '", 73)} as neighborhood,
    {_faults("(40.0e0 + (user_id % 25) * 0.01e0 + case when (props->>'k')::int >= 95 then 10 else 0 end)::varchar", "9='north'; 12='95.5'; 14='nan'; 15=null; 16='1_000'", 101)} as latitude,
    {_faults("(-74.0e0 + (user_id % 5) * 0.02e0)::varchar", "18='-190'; 20='1d'; 21=''", 103)} as longitude,
    {_faults("strftime(ts, '%Y-%m-%d')", "22='2024-02-30'; 24='2024-1-5'; 25='05/01/2024'; 26=null", 107)} as occurred_date,
    {_faults("strftime(ts, '%H:%M')", "27='24:00'; 28='7:5'; 29='noon'; 30=''", 109)} as occurred_time,
    {_faults("case event_id % 4 when 0 then 'Firearm' when 1 then 'None' when 2 then 'Knife' else 'Unknown' end", "31=null; 32=' false '", 71)} as weapon_used,
    {_faults("case when event_id % 3 = 0 then 'Yes' else 'No' end", "33='maybe'; 34=' yes '; 35=null", 67)} as domestic_related,
    {_faults("case when event_id % 5 = 0 then 'Yes' else 'No' end", "36='Y'; 37='YES'", 61)} as gang_related,
    {_faults("case when event_id % 7 = 0 then 'Yes' else 'No' end", "38=''; 39=null", 59)} as property_damage,
    {_faults("value::varchar", "40='-5'; 41='lots'; 42=null; 43=' 1e3 '; 44='12.9'", 53)} as estimated_loss,
    case event_id % 6 when 0 then null when 1 then '' when 2 then '["a","b"]' when 3 then 'not json' when 4 then '[]' else '["k' || event_id % 10 || '"]' end as reasons,
    ts as submitted_at, event_id
  from events)"""

_NUMBER_SQL = r"'^\s*[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?\s*$'"


def num(x: str) -> str:
    return f"case when regexp_matches({x}, {_NUMBER_SQL}) then replace(trim({x}), '_', '')::double end"


def day(x: str) -> str:
    return rf"case when regexp_matches({x}, '^\d{{4}}-\d{{1,2}}-\d{{1,2}}$') then try_cast({x} as date) end"


def is_time(x: str) -> str:
    return rf"coalesce(regexp_matches({x}, '^(2[0-3]|[01]?\d):[0-5]?\d$'), false)"


def weight(x: str) -> str:
    return f"(case {x} when 'Infraction' then 0.2e0 when 'Misdemeanor' then 0.5e0 when 'Felony' then 1.0e0 when 'Low' then 0.2e0 when 'Medium' then 0.5e0 when 'High' then 0.8e0 when 'Critical' then 1.0e0 else 0.5e0 end)"


def risk_level(x: str, bounds: tuple = (35, 55, 75)) -> str:
    return f"(case when {x} < {bounds[0]} then 'LOW' when {x} < {bounds[1]} then 'MODERATE' when {x} < {bounds[2]} then 'HIGH' else 'CRITICAL' end)"


def minmax(x: str) -> str:
    return f"(case when max({x}) over () - min({x}) over () < 1e-9 then 0.5e0 else ({x} - min({x}) over ()) / (max({x}) over () - min({x}) over ()) end)"


ARMED = "lower(coalesce(weapon_used, 'Unknown')) not in ('unknown', 'none', 'no', '', 'nan')"


def share(condition: str) -> str:
    return f"avg(case when {condition} then 1.0e0 else 0.0e0 end)"


BASELINE_CTE = f"""
base_stats as (
  select district, count(*) as incident_count, count(*)::double / (select greatest(max(occurred_date) - min(occurred_date), 1) from inc) as daily_rate,
    {share("crime_severity = 'Felony'")} as felony_share, {share(ARMED)} as weapon_rate, {share("lower(domestic_related) = 'yes'")} as domestic_rate,
    {share("lower(gang_related) = 'yes'")} as gang_rate, avg(estimated_loss) as avg_loss from inc where occurred_date is not null group by district),
baseline as (
  select district, incident_count, {", ".join(f"round_even({c} * 1000000, 0) / 1000000 as {c}" for c in ("daily_rate", "felony_share", "weapon_rate", "domestic_rate", "gang_rate", "avg_loss"))},
    historical_risk from (select *, {rnd("greatest(0, least(100, " + " + ".join(f"{minmax(c)} * {k}" for c, k in (("daily_rate", 35), ("felony_share", 25), ("weapon_rate", 15), ("domestic_rate", 10), ("gang_rate", 10), ("avg_loss", 5))) + "))")} as historical_risk from base_stats))"""


def with_incoming(sql: str, *ctes: str, history: bool = False) -> str:
    parts = [*([HISTORY_SQL.strip()] if history else []), INCOMING_SQL.strip(), *ctes]
    return "with " + ",\n".join(parts) + "\n" + sql
