"""Fixed values that define the results."""

MONTHS = [
    "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December",
]
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

# Upper bounds of the risk levels: below the bound has the level, above the last is CRITICAL.
RISK_BOUNDS = {"LOW": 35.0, "MODERATE": 55.0, "HIGH": 75.0}
HOTSPOT_BOUNDS = {"LOW": 25.0, "MODERATE": 50.0, "HIGH": 75.0}
PATTERN_BOUNDS = {"LOW": 25.0, "MODERATE": 45.0, "HIGH": 70.0}
LEVELS = ["LOW", "MODERATE", "HIGH", "CRITICAL"]

SEVERITY_WEIGHTS = {
    "Infraction": 0.2, "Misdemeanor": 0.5, "Felony": 1.0, "Low": 0.2, "Medium": 0.5, "High": 0.8, "Critical": 1.0,
}
DEFAULT_SEVERITY_WEIGHT = 0.5
UNIT_WEIGHTS = {"CRITICAL": 4.0, "HIGH": 3.0, "MODERATE": 2.0, "LOW": 1.0}

# Shares of the historical risk score and of the hotspot score.
RISK_SHARES = {"frequency": 35, "felony": 25, "weapon": 15, "domestic": 10, "gang": 10, "loss": 5}
HOTSPOT_SHARES = {"frequency": 50, "felony": 20, "weapon": 15, "loss": 15}
NO_BASELINE = 30.0
NO_HISTORY_RATIO = 99.0

# Texts of a weapon column that mean none: in the history, and for an incoming incident.
NO_WEAPON = ["unknown", "none", "no", "", "nan"]
NO_WEAPON_INCOMING = ["", "unknown", "none", "no", "nan", "false"]

REQUIRED_FIELDS = [
    "crime_type", "crime_category", "crime_severity", "latitude", "longitude", "occurred_date", "occurred_time",
]
SEVERITIES = ["Infraction", "Misdemeanor", "Felony"]
YES_NO_FIELDS = ["domestic_related", "gang_related", "property_damage"]
FIXED_WEAPONS = ["None", "Firearm", "Knife", "Blunt Object"]
