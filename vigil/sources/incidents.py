"""Incidents: reading files, and the two views on the given tables.

The history takes one row per line item, the incoming incidents one per event. A view joins only the tables that the
wanted columns need; the joins neither lose nor repeat rows as long as every key of a line item, order and customer has
its row, which is the views' precondition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MINUTE = "(l_orderkey * 7 + l_linenumber * 61 + l_partkey * 13) % 1440"
_DATE = "cast(l_shipdate as date)"

#: Column of the history: Spark SQL, and the tables beside lineitem that it reads.
HISTORY: dict[str, tuple[str, tuple[str, ...]]] = {
    "incident_id": (
        "concat_ws('-', 'INC', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as int), "
        f"cast(rint(l_extendedprice * 100) as bigint), date_format({_DATE}, 'yyyyMMdd'))", (),
    ),
    "crime_type": ("p_type", ("part",)),
    "crime_category": ("p_brand", ("part",)),
    "crime_severity": ("case l_returnflag when 'R' then 'Felony' when 'A' then 'Misdemeanor' else 'Infraction' end", ()),
    "district": ("n_name", ("nation",)),
    "neighborhood": ("c_mktsegment", ("customer",)),
    "latitude": ("40.0D + n_nationkey * 0.01D + (l_partkey % 100) * 0.0005D", ("nation",)),
    "longitude": ("-74.0D + n_regionkey * 0.02D + (l_suppkey % 50) * 0.0005D", ("nation",)),
    "occurred_date": (_DATE, ()),
    "occurred_time": (f"concat(lpad(cast(floor({MINUTE} / 60) as string), 2, '0'), ':', lpad(cast({MINUTE} % 60 as string), 2, '0'))", ()),
    "time_category": (
        f"case when {MINUTE} between 300 and 719 then 'Morning' when {MINUTE} between 720 and 1019 then 'Afternoon' "
        f"when {MINUTE} between 1020 and 1259 then 'Evening' else 'Night' end", (),
    ),
    "month": (f"date_format({_DATE}, 'MMMM')", ()),
    "day_of_week": (f"date_format({_DATE}, 'EEEE')", ()),
    "season": (
        f"case when month({_DATE}) in (12, 1, 2) then 'Winter' when month({_DATE}) <= 5 then 'Spring' "
        f"when month({_DATE}) <= 8 then 'Summer' else 'Autumn' end", (),
    ),
    "weapon_used": (
        "case substr(o_orderpriority, 1, 1) when '1' then 'Firearm' when '2' then 'Knife' when '3' then 'Blunt Object' "
        "when '5' then 'None' end", ("orders",),
    ),
    "priority_level": ("case when substr(o_orderpriority, 1, 1) in ('1', '2') then 'High' when substr(o_orderpriority, 1, 1) = '3' then 'Medium' else 'Low' end", ("orders",)),
    "domestic_related": ("if(l_tax >= 0.04D, 'Yes', 'No')", ()),
    "gang_related": ("if(l_linestatus = 'O', 'Yes', 'No')", ()),
    "property_damage": ("if(l_discount >= 0.05D, 'Yes', 'No')", ()),
    "arrest_made": (
        "case when l_suppkey % 11 = 0 then null when o_orderstatus = 'F' or (o_orderstatus = 'P' and l_partkey % 3 = 0) then 'Yes' else 'No' end",
        ("orders",),
    ),
    "evidence_collected": ("if(l_quantity > 25, 'Yes', 'No')", ()),
    "is_holiday": (f"if(day({_DATE}) in (1, 25), 'Yes', 'No')", ()),
    "estimated_loss": ("cast(l_extendedprice as int)", ()),
    "victim_count": ("l_linenumber", ()),
    "suspect_count": ("p_size % 5", ("part",)),
    "investigation_hours": ("l_quantity", ()),
    "reported_by": (
        "case c_mktsegment when 'AUTOMOBILE' then 'Patrol' when 'BUILDING' then 'Victim' when 'FURNITURE' then 'Witness' "
        "when 'HOUSEHOLD' then 'Neighbour' else 'Camera' end", ("customer",),
    ),
    "premises_type": ("case l_suppkey % 4 when 0 then 'Street' when 1 then 'Residence' when 2 then 'Shop' else 'Park' end", ()),
    "victim_gender": ("case l_linenumber % 2 when 0 then 'Female' else 'Male' end", ()),
    "suspect_gender": ("case l_partkey % 3 when 0 then 'Female' when 1 then 'Male' else 'Unknown' end", ()),
    "victim_age_group": ("case when p_size <= 15 then 'Under 25' when p_size <= 35 then '25-40' else 'Over 40' end", ("part",)),
    "suspect_age_group": ("case when l_quantity <= 15 then 'Under 25' when l_quantity <= 35 then '25-40' else 'Over 40' end", ()),
    "weather": ("case l_suppkey % 3 when 0 then 'Clear' when 1 then 'Rain' else 'Fog' end", ()),
    "hate_crime": ("if(l_partkey % 50 = 0, 'Yes', 'No')", ()),
    "video_footage": ("if(l_partkey % 2 = 1, 'Yes', 'No')", ()),
    # a dense integer key of a row, for seeded splits and samples
    "row_key": ("l_orderkey * 1000003 + l_linenumber * 10007 + l_partkey * 101 + l_suppkey", ()),
}
#: What must be joined before a table can be.
_NEEDS = {"part": (), "orders": (), "customer": ("orders",), "nation": ("orders", "customer")}
_ON = {
    "part": ("l_partkey", "p_partkey"), "orders": ("l_orderkey", "o_orderkey"),
    "customer": ("o_custkey", "c_custkey"), "nation": ("c_nationkey", "n_nationkey"),
}
#: Tables that are joined with each other first, so that the line items, the most rows, are shuffled once for each chain.
_CHAINS = (("part",), ("orders", "customer", "nation"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def history(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """The historical incidents with the wanted columns (all by default)."""
    columns = list(HISTORY) if columns is None else columns
    wanted = {t for c in columns for t in HISTORY[c][1]}
    wanted |= {t for w in wanted for t in _NEEDS[w]}
    df = table(spark, sf_dir, "lineitem")
    for first, *others in _CHAINS:
        if first in wanted:
            side = table(spark, sf_dir, first)
            for name in others:
                if name in wanted:
                    side = side.join(table(spark, sf_dir, name), F.col(_ON[name][0]) == F.col(_ON[name][1]))
            df = df.join(side, F.col(_ON[first][0]) == F.col(_ON[first][1]))
    return df.select(*[F.expr(HISTORY[c][0]).alias(c) for c in columns])


def _dirty(good: str, bad: dict[int, str], by: int) -> str:
    """``good``, but the given text in rows whose event_id has that remainder."""
    return f"case event_id % {by} " + " ".join(f"when {r} then {v}" for r, v in bad.items()) + f" else {good} end"


#: Columns of the incoming incidents: text as it arrives, with faults by row number.
INCOMING: dict[str, str] = {
    "incident_id": "concat('INC-E', event_id)",
    "crime_type": _dirty(
        "case event_type when 'click' then 'PROMO' when 'view' then 'ECONOMY' when 'error' then 'MEDIUM' when 'signup' then 'SMALL' else 'LARGE' end",
        {3: "'  PROMO '", 5: "'ARSON'", 7: "''", 11: "null"}, 97,
    ),
    "crime_category": _dirty("concat('Brand#', event_id % 5)", {13: "null", 17: "'   '"}, 89),
    "crime_severity": _dirty("case event_type when 'error' then 'Felony' when 'purchase' then 'Misdemeanor' else 'Infraction' end", {2: "'Grave'", 19: "' Felony '", 23: "null"}, 83),
    "district": _dirty("concat('NATION_', user_id % 25)", {4: "null", 6: "''", 8: "'ATLANTIS'", 10: "'  NATION_3'"}, 79),
    "neighborhood": _dirty("concat('Block ', user_id % 7)", {1: "null", 2: "'  '"}, 73),
    "latitude": _dirty("cast(40.0D + (user_id % 25) * 0.01D + if(cast(get_json_object(props, '$.k') as int) >= 95, 10, 0) as string)", {9: "'north'", 12: "'95.5'", 14: "'nan'", 15: "null", 16: "'1_000'"}, 101),
    "longitude": _dirty("cast(-74.0D + (user_id % 5) * 0.02D as string)", {18: "'-190'", 20: "'1d'", 21: "''"}, 103),
    "occurred_date": _dirty("date_format(ts, 'yyyy-MM-dd')", {22: "'2024-02-30'", 24: "'2024-1-5'", 25: "'05/01/2024'", 26: "null"}, 107),
    "occurred_time": _dirty("date_format(ts, 'HH:mm')", {27: "'24:00'", 28: "'7:5'", 29: "'noon'", 30: "''"}, 109),
    "weapon_used": _dirty("case event_id % 4 when 0 then 'Firearm' when 1 then 'None' when 2 then 'Knife' else 'Unknown' end", {31: "null", 32: "' false '"}, 71),
    "domestic_related": _dirty("if(event_id % 3 = 0, 'Yes', 'No')", {33: "'maybe'", 34: "' yes '", 35: "null"}, 67),
    "gang_related": _dirty("if(event_id % 5 = 0, 'Yes', 'No')", {36: "'Y'", 37: "'YES'"}, 61),
    "property_damage": _dirty("if(event_id % 7 = 0, 'Yes', 'No')", {38: "''", 39: "null"}, 59),
    "estimated_loss": _dirty("cast(value as string)", {40: "'-5'", 41: "'lots'", 42: "null", 43: "' 1e3 '", 44: "'12.9'"}, 53),
    "reasons": "case event_id % 6 when 0 then null when 1 then '' when 2 then '[\"a\",\"b\"]' when 3 then 'not json' when 4 then '[]' else concat('[\"k', event_id % 10, '\"]') end",
    "submitted_at": "ts",
    "event_id": "event_id",
}


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The incoming incidents as they arrive."""
    return table(spark, sf_dir, "events").select(*[F.expr(e).alias(c) for c, e in INCOMING.items()])


def scan_incidents(spark: SparkSession, paths: list[str], schema: StructType | None = None, fmt: str | None = None) -> DataFrame:
    """The first path of the list that exists and holds rows, as CSV with a header or as Parquet.

    ``fmt`` is taken from the path's ending where it isn't given. Fails if no path can be read.
    """
    from pyspark.errors import AnalysisException

    for path in paths:
        kind = fmt or ("csv" if path.rstrip("/").endswith((".csv", ".csv.gz")) else "parquet")
        reader = spark.read.schema(schema) if schema else spark.read
        try:
            df = reader.option("header", True).format(kind).load(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                continue
            raise
        if not df.isEmpty():
            return df
    raise FileNotFoundError(f"no incidents in any of {paths}")


def ensure_columns(df: DataFrame, defaults: dict[str, Column], required: list[str] = ()) -> DataFrame:
    """Adds the columns that are missing; fails if a required one is."""
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df.withColumns({c: v for c, v in defaults.items() if c not in df.columns}) if set(defaults) - set(df.columns) else df
