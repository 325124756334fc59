"""Column types of the booking tables and the fixed values every module shares."""

from __future__ import annotations

from pyspark.sql import types as T

_INT, _DBL, _STR, _DATE = T.IntegerType(), T.DoubleType(), T.StringType(), T.DateType()

# ---- fixed values: column names and types in file order, defaults, names, bins ----

#: The 32 columns of a raw booking export, in file order.
RAW_TYPES: dict[str, T.DataType] = {
    "hotel": _STR,
    "is_canceled": _INT,
    "lead_time": _INT,
    "arrival_date_year": _INT,
    "arrival_date_month": _STR,
    "arrival_date_week_number": _INT,
    "arrival_date_day_of_month": _INT,
    "stays_in_weekend_nights": _INT,
    "stays_in_week_nights": _INT,
    "adults": _INT,
    "children": _INT,
    "babies": _INT,
    "meal": _STR,
    "country": _STR,
    "market_segment": _STR,
    "distribution_channel": _STR,
    "is_repeated_guest": _INT,
    "previous_cancellations": _INT,
    "previous_bookings_not_canceled": _INT,
    "reserved_room_type": _STR,
    "assigned_room_type": _STR,
    "booking_changes": _INT,
    "deposit_type": _STR,
    "agent": _STR,
    "company": _STR,
    "days_in_waiting_list": _INT,
    "customer_type": _STR,
    "adr": _DBL,
    "required_car_parking_spaces": _INT,
    "total_of_special_requests": _INT,
    "reservation_status": _STR,
    "reservation_status_date": _DATE,
}

#: The four columns the clean-up adds.
DERIVED_TYPES: dict[str, T.DataType] = {
    "total_nights": _INT,
    "arrival_month_num": _INT,
    "arrival_date": _DATE,
    "revenue": _DBL,
}


def booking_schema(derived: bool = True) -> T.StructType:
    """Schema of the booking table, with or without the derived columns."""
    types = {**RAW_TYPES, **(DERIVED_TYPES if derived else {})}
    return T.StructType([T.StructField(name, kind) for name, kind in types.items()])


#: Stored insight tables and their columns.
INSIGHT_SCHEMAS: dict[str, str] = {
    "revenue_insights": "month string, year int, revenue double",
    "cancellation_insights": "location string, cancellations bigint",
    "average_adr_insight": "average_adr double",
    "top_booking_countries": "country string, count bigint",
    "cancellation_by_date": "date date, count bigint",
    "cancellations_per_date": "date date, count bigint",
}


#: English month names in calendar order; the position is the month number.
MONTHS = (
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
)

#: Field values that mean "missing" in a CSV file.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

#: Columns given a default before the median fill.
FILL_DEFAULTS: dict[str, object] = {
    "children": 0,
    "country": "unknown",
    "agent": "unknown",
    "company": "unknown",
}

#: Defaults used where rows are shown or rendered.
DISPLAY_DEFAULTS: dict[str, str] = {"country": "Unknown", "meal": "Undefined/SC"}

#: Inputs of the cancellation model.
CANCELLATION_FEATURES = (
    "lead_time", "adr", "booking_changes", "total_of_special_requests", "total_nights",
    "previous_cancellations", "previous_bookings_not_canceled", "days_in_waiting_list",
)

#: Columns of the correlation report.
CORRELATION_COLUMNS = (
    "lead_time", "adr", "booking_changes", "total_of_special_requests", "total_nights",
    "previous_cancellations", "previous_bookings_not_canceled", "days_in_waiting_list",
    "is_canceled", "revenue",
)

#: Lead-time bins: right-closed edges (the last bin is open) and their labels.
LEAD_TIME_EDGES = (0, 7, 14, 30, 60, 90, 180)
LEAD_TIME_LABELS = (
    "0-7 days", "8-14 days", "15-30 days", "31-60 days",
    "61-90 days", "91-180 days", "180+ days",
)

#: ISO-3 codes with a display name; other codes are shown as they are.
COUNTRY_NAMES: dict[str, str] = {
    "PRT": "Portugal", "GBR": "United Kingdom", "ESP": "Spain", "FRA": "France",
    "DEU": "Germany", "ITA": "Italy", "USA": "United States", "NLD": "Netherlands",
    "BEL": "Belgium", "BRA": "Brazil", "IRL": "Ireland", "CHN": "China",
    "IND": "India", "AUS": "Australia", "CAN": "Canada", "RUS": "Russia",
    "POL": "Poland", "CHE": "Switzerland", "AUT": "Austria", "SWE": "Sweden",
    "DNK": "Denmark", "NOR": "Norway", "FIN": "Finland", "SVK": "Slovakia",
    "CZE": "Czech Republic", "HUN": "Hungary", "JPN": "Japan", "MEX": "Mexico",
    "KOR": "South Korea", "TUR": "Turkey", "ARG": "Argentina", "NZL": "New Zealand",
    "ZAF": "South Africa", "EGY": "Egypt", "ARE": "United Arab Emirates", "SAU": "Saudi Arabia",
    "ISR": "Israel", "THA": "Thailand", "PHL": "Philippines", "SGP": "Singapore",
    "KWT": "Kuwait", "QAT": "Qatar", "BHR": "Bahrain", "OMN": "Oman",
    "LKA": "Sri Lanka", "PAK": "Pakistan", "UGA": "Uganda", "KEN": "Kenya",
    "GHA": "Ghana", "NGA": "Nigeria", "ZMB": "Zambia", "TZA": "Tanzania",
    "ETH": "Ethiopia", "COL": "Colombia", "PER": "Peru", "VEN": "Venezuela",
    "BOL": "Bolivia", "ECU": "Ecuador", "CHL": "Chile", "PRY": "Paraguay",
    "URY": "Uruguay", "SUR": "Suriname", "GUY": "Guyana", "BFA": "Burkina Faso",
    "MLI": "Mali", "NER": "Niger", "TGO": "Togo", "BEN": "Benin",
    "MOZ": "Mozambique", "ZWE": "Zimbabwe",
}
