"""Cleaning, checking and rating values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigil.constants import DEFAULT_SEVERITY_WEIGHT, LEVELS, RISK_BOUNDS, SEVERITY_WEIGHTS

_NUMBER = r"^\s*[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?\s*$"


def rounded(x: Column, digits: int = 1) -> Column:
    """Half-even on the scaled value."""
    return F.rint(x * 10**digits) / 10**digits


def clean_value(x: Column) -> Column:
    """Trimmed text; null, NaN and blank are ``Unknown``."""
    text = F.trim(x)
    return F.when(x.isNull() | (text == "") | (F.lower(text) == "nan"), F.lit("Unknown")).otherwise(text)


def number(x: Column) -> Column:
    """A text as a double: plain and exponent notation, digits grouped by underscores; anything else is null."""
    return F.when(x.rlike(_NUMBER), F.regexp_replace(F.trim(x), "_", "").try_cast("double"))


def safe_float(x: Column, default: float = 0.0) -> Column:
    return F.coalesce(number(x), F.lit(float(default)))


def safe_int(x: Column, default: int = 0) -> Column:
    """Truncated towards zero."""
    value = number(x)
    return F.coalesce(F.when(F.abs(value) < 2.0**63, value.try_cast("bigint")), F.lit(default).cast("bigint"))


def date_of(x: Column) -> Column:
    """``YYYY-MM-DD``, one-digit month and day too; null if there is no such day."""
    return F.when(x.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_timestamp(x, F.lit("y-M-d")).cast("date"))


def valid_date(x: Column) -> Column:
    return date_of(x).isNotNull()


def valid_time(x: Column) -> Column:
    return F.coalesce(x.rlike(r"^(2[0-3]|[01]?\d):[0-5]?\d$"), F.lit(False))


def severity_weight(x: Column) -> Column:
    weight = F.lit(DEFAULT_SEVERITY_WEIGHT)
    for name, value in SEVERITY_WEIGHTS.items():
        weight = F.when(x == name, F.lit(value)).otherwise(weight)
    return weight


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """Null and NaN are 0 before the bounds apply."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))))


def level(score: Column, bounds: dict[str, float] = RISK_BOUNDS) -> Column:
    out = F.lit(LEVELS[-1])
    for name in reversed(list(bounds)):
        out = F.when(score < bounds[name], F.lit(name)).otherwise(out)
    return out


def time_period(x: Column) -> Column:
    hour = F.split(x, ":")[0].try_cast("int")
    part = (
        F.when(hour.between(5, 11), "Morning").when(hour.between(12, 16), "Afternoon")
        .when(hour.between(17, 20), "Evening").otherwise("Night")
    )
    return F.when(valid_time(x), part).otherwise("Unknown")


#: What is shown and advised for each level.
ACTIONS = {
    "LOW": "Keep routine patrols",
    "MODERATE": "Watch the area more closely",
    "HIGH": "Send additional patrols",
    "CRITICAL": "Send units now and inform the commander",
}
LABELS = {"LOW": "Low risk", "MODERATE": "Moderate risk", "HIGH": "High risk", "CRITICAL": "Critical risk"}
ICONS = {"LOW": "green", "MODERATE": "yellow", "HIGH": "orange", "CRITICAL": "red"}


def by_level(x: Column, texts: dict[str, str]) -> Column:
    """The text of a level, in any case of letters; unknown levels have that of LOW."""
    out = F.lit(texts["LOW"])
    for name, text in texts.items():
        out = F.when(F.upper(x) == name, F.lit(text)).otherwise(out)
    return out


def stable_id(prefix: str, *keys: Column) -> Column:
    """An id that a retry gives again: the prefix and the full hash of the keys."""
    return F.concat(F.lit(prefix + "-"), F.upper(F.md5(F.concat_ws("|", *keys))))


def is_yes(x: Column) -> Column:
    return F.coalesce(F.lower(x) == "yes", F.lit(False))


def has_weapon(x: Column, none: list[str]) -> Column:
    return ~F.lower(F.coalesce(x, F.lit("Unknown"))).isin(none)


def draw(key: str) -> Column:
    """A number below 2^31 - 1 that depends on the row's key only."""
    return F.pmod(F.pmod(F.col(key), F.lit(2147483647)) * 48271 + 11, F.lit(2147483647))
