"""DuckDB SQL with the same result as each registered query.

Written independently of the operators; only the booking view, the country names and
the month names are shared. Texts and patterns are spelt out here a second time.
"""

from __future__ import annotations

from roomledger.schema import COUNTRY_NAMES, CORRELATION_COLUMNS, LEAD_TIME_EDGES, LEAD_TIME_LABELS, MONTHS, RAW_TYPES
from roomledger.sources.star import BOOKING_COLUMNS

from .inputs import DIRT, EXPORTS, QUESTION_FORMS

ORACLES: dict[str, str] = {}

# ---- expected texts and patterns -------------------------------------------------

MONTH_YEAR_PATTERN = (
    "(january|jan|february|feb|march|mar|april|apr|may|june|jun|july|jul|august|aug|september|sep|october|oct"
    "|november|nov|december|dec)[ \\t\\n\\r\\f\\v]+([0-9]{4})"
)
DATE_PATTERN = "([0-9]{4}-[0-9]{2}-[0-9]{2})"
ASK_FOR_MONTH = "For revenue, please specify the full month and year (e.g., 'total revenue for July 2017')."
ASK_FOR_DATE = "Please specify the date for cancellations in YYYY-MM-DD format."
TOP_LOCATIONS = "Top 5 locations with highest booking cancellations:\n"
TOP_DATES = "Top 5 dates with the most cancellations:\n"
TOP_COUNTRIES = "Top 5 countries with the most bookings:\n"
NO_CONTEXT = "I couldn't find relevant information in the dataset to answer that question."
NO_GENERATION = "The LLaMA model could not generate an answer based on the provided context."
PROMPT_START = (
    "Use the following context extracted from hotel booking data to answer the question. Provide a concise answer based *only* on "
    "the context given. Do not add information not present in the context. If the context doesn't contain the answer, say so."
    "\n\nContext:\n"
)



def text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("'", "''") + "'"


_VIEW = "SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in BOOKING_COLUMNS.items()) + (
    " FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
    " JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey"
)
_MONTH_NUM = "CASE {} " + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(MONTHS, 1)) + " END"
_FACTS = """SELECT *, (arrival_date_year || '-' || lpad(CAST(month(arrival_date) AS VARCHAR), 2, '0')) AS month_year,
  CAST(year(arrival_date) AS INT) AS year, (year(arrival_date) || 'Q' || quarter(arrival_date)) AS quarter,
  arrival_date_month AS arrival_month_name,
  revenue / CASE WHEN total_guests = 0 THEN 1 ELSE total_guests END AS revenue_per_guest
FROM (SELECT *, adr * total_nights AS revenue FROM (
  SELECT *, stays_in_weekend_nights + stays_in_week_nights AS total_nights,
    adults + coalesce(children, 0) + coalesce(babies, 0) AS total_guests FROM bookings))"""
_NAMES = "SELECT * FROM (VALUES " + ", ".join(f"('{c}', {text(n)})" for c, n in COUNTRY_NAMES.items()) + ") v(code, name)"
_EXPORT = {
    i: "SELECT " + ", ".join(f"{DIRT.get(c, c)} AS {c}" for c in BOOKING_COLUMNS if c != "arrival_date")
    + f" FROM bookings WHERE {where}"
    for i, where in EXPORTS.items()
}
_CTES = {
    "bookings": _VIEW,
    "f": _FACTS,
    "names": _NAMES,
    "raw1": _EXPORT[1],
    "raw2": _EXPORT[2],
    "shown": "SELECT * REPLACE (coalesce(country, 'Unknown') AS country) FROM f",
}


#: Steps that several others read, or that a plan would otherwise compute again for each row.
_COSTLY = {"routed", "docs", "open_questions", "asked_texts", "dv", "qv", "near", "places", "prompts", "rev", "per", "l5", "d5", "c5"}


def oracle(name: str, sql: str, **ctes: str) -> None:
    """Register SQL; the shared views it mentions, and ``ctes``, go in front."""
    import re

    body = " ".join([sql, *ctes.values()])
    needed: list[str] = []

    def need(cte: str) -> None:
        for other in _CTES:
            if other != cte and other not in needed and re.search(rf"\b(FROM|JOIN) {other}\b", _CTES[cte]):
                need(other)
        if cte not in needed:
            needed.append(cte)

    for cte in _CTES:
        if re.search(rf"\b(FROM|JOIN) {cte}\b", body):
            need(cte)
    parts = [f"{c} AS ({_CTES[c]})" for c in needed]
    parts += [f"{c} AS {'MATERIALIZED ' if c in _COSTLY else ''}({s})" for c, s in ctes.items()]
    ORACLES[name] = ("WITH " + ", ".join(parts) + " " if parts else "") + sql


def tally(cols: str, source: str) -> str:
    return f"SELECT {cols}, count(*) AS n FROM {source} GROUP BY ALL"


# ---- sources ----------------------------------------------------------------

_SUMS = [c for c, t in RAW_TYPES.items() if t.typeName() in ("integer", "double") and c != "arrival_date_year"]
_TEXTS = [c for c, t in RAW_TYPES.items() if t.typeName() == "string" and c != "hotel"]
_PROFILE = (
    "SELECT hotel, arrival_date_year, count(*) AS n, "
    + ", ".join(f"CAST(sum({c}) AS {'DOUBLE' if c == 'adr' else 'BIGINT'}) AS {c}" for c in _SUMS)
    + ", "
    + ", ".join(f"CAST(sum(length({c})) AS BIGINT) AS {c}" for c in _TEXTS)
    + ", min(reservation_status_date) AS first_status, max(reservation_status_date) AS last_status,"
    " count(arrival_date) AS arrivals FROM bookings GROUP BY ALL"
)
oracle("bookings_source", _PROFILE)
oracle("csv_round_trip", _PROFILE)
oracle(
    "clustered_write",
    "SELECT hotel, CAST(month(arrival_date) AS INT) AS arrival_month_num, count(*) AS n,"
    " CAST(sum(total_nights) AS BIGINT) AS nights, sum(revenue) AS revenue FROM f"
    " WHERE arrival_date BETWEEN DATE '1997-03-01' AND DATE '1998-02-28' GROUP BY ALL",
)
oracle(
    "country_map_file",
    "SELECT country, count(*) AS bookings, coalesce(any_value(name), country, 'unknown') AS country_name"
    " FROM bookings LEFT JOIN names ON country = code GROUP BY country",
)
_CANCEL_LOC = (
    "SELECT country AS location, count(*) AS cancellations FROM bookings WHERE is_canceled = 1"
    " GROUP BY country ORDER BY cancellations DESC, country NULLS FIRST LIMIT {}"
)
_TOP_COUNTRY = (
    'SELECT country, count(*) AS "count" FROM bookings GROUP BY country'
    ' ORDER BY "count" DESC, country NULLS FIRST LIMIT {}'
)
_PER_DATE = (
    'SELECT reservation_status_date AS "date", count(*) AS "count" FROM bookings'
    " WHERE is_canceled = 1 GROUP BY reservation_status_date"
)
_TOP_DATE = _PER_DATE + ' ORDER BY "count" DESC, "date" NULLS FIRST LIMIT {}'
_REVENUE = (
    "SELECT arrival_date_month AS month, arrival_date_year AS year,"
    " sum(adr * (stays_in_weekend_nights + stays_in_week_nights)) AS revenue FROM bookings GROUP BY ALL"
)
oracle(
    "stored_insights",
    "SELECT 'revenue_insights' AS insight, month || ' ' || year AS label, revenue AS value FROM rev"
    " UNION ALL SELECT 'cancellation_insights', location, CAST(cancellations AS DOUBLE) FROM loc"
    " UNION ALL SELECT 'top_booking_countries', country, CAST(\"count\" AS DOUBLE) FROM cou"
    " UNION ALL SELECT 'cancellation_by_date', CAST(\"date\" AS VARCHAR), CAST(\"count\" AS DOUBLE) FROM dat"
    " UNION ALL SELECT 'cancellations_per_date', CAST(\"date\" AS VARCHAR), CAST(\"count\" AS DOUBLE) FROM per",
    rev=_REVENUE, loc=_CANCEL_LOC.format(10), cou=_TOP_COUNTRY.format(10), dat=_TOP_DATE.format(10), per=_PER_DATE,
)
oracle("stored_first_row", "SELECT round(avg(adr), 6) AS average_adr FROM bookings")

# ---- clean-up -----------------------------------------------------------------

_FILLED = (
    "SELECT * REPLACE (trim(hotel) AS hotel, coalesce(children, 0) AS children, coalesce(country, 'unknown') AS country,"
    " coalesce(agent, 'unknown') AS agent, coalesce(company, 'unknown') AS company,"
    " coalesce(adr, (SELECT median(adr) FROM {0})) AS adr) FROM {0}"
)
oracle("stripped_column_names", tally("meal", "raw1"))
oracle("stripped_strings", tally("trim(hotel) AS hotel, deposit_type", "raw1"))
oracle(
    "filled_defaults",
    tally("coalesce(children, 0) AS children, coalesce(country, 'unknown') AS country,"
          " coalesce(agent, 'unknown') AS agent, coalesce(company, 'unknown') AS company", "raw2"),
)
oracle(
    "filled_medians",
    tally("coalesce(adr, (SELECT quantile_cont(adr, 0.5) FROM raw1)) AS adr, coalesce(children, 0) AS children", "raw1"),
)
oracle(
    "rows_with_values",
    tally("country, company",
          "bookings WHERE country IS NOT NULL OR company IS NOT NULL OR adr IS NOT NULL"),
)
_NULLS = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls FROM bookings" for c in BOOKING_COLUMNS
)
oracle("null_summary", f"SELECT * FROM ({_NULLS}) ORDER BY nulls DESC, column_name LIMIT 10")
oracle("missing_columns", f"SELECT * FROM ({_NULLS}) WHERE nulls > 0")
oracle("missing_total", f"SELECT CAST(sum(nulls) AS BIGINT) AS missing FROM ({_NULLS})")
oracle("truncated_ints", tally("adults, children, babies, CAST(trunc(adr) AS INT) AS adr", "bookings"))
oracle(
    "parsed_dates",
    tally("TRY_CAST(reservation_status_date AS DATE) AS reservation_status_date", "raw1"),
)
oracle(
    "coerced_ints",
    tally("coalesce(children, 0) AS children, coalesce(TRY_CAST(agent AS INT), 0) AS agent,"
          " coalesce(TRY_CAST(company AS INT), 0) AS company", "raw1"),
)
oracle("display_defaults", tally("coalesce(country, 'Unknown') AS country, meal", "bookings"))
oracle(
    "total_nights",
    "SELECT stays_in_weekend_nights, stays_in_week_nights, total_nights, count(*) AS n, 'plain' AS variant FROM f"
    " GROUP BY ALL UNION ALL SELECT stays_in_weekend_nights, wk, stays_in_weekend_nights + coalesce(wk, 0),"
    " count(*), 'null safe' FROM (SELECT *, CASE WHEN children IS NOT NULL THEN stays_in_week_nights END AS wk FROM f)"
    " GROUP BY ALL",
)
oracle(
    "revenue",
    "SELECT adr, total_nights, revenue, count(*) AS n, 'plain' AS variant FROM f GROUP BY ALL UNION ALL"
    " SELECT coalesce(adr, 0) AS adr, total_nights, coalesce(adr, 0) * total_nights, count(*), 'null safe' FROM f"
    " GROUP BY ALL",
)
oracle(
    "month_numbers",
    tally("arrival_date_month, CAST(month(arrival_date) AS INT) AS arrival_month_num", "bookings"),
)
oracle(
    "arrival_dates",
    "SELECT TRY_CAST(arrival_date_year || '-' || " + _MONTH_NUM.format("arrival_date_month")
    + " || '-' || arrival_date_day_of_month AS DATE) AS arrival_date, count(*) AS n FROM raw2 GROUP BY 1",
)
oracle(
    "calendar_columns",
    tally("strftime(arrival_date, '%Y-%m') AS month_year, CAST(year(arrival_date) AS INT) AS year, quarter,"
          " monthname(arrival_date) AS arrival_month_name", "f"),
)
oracle("total_guests", tally("adults, children, babies, total_guests", "f"))
oracle(
    "revenue_per",
    "SELECT hotel, total_guests, sum(revenue) AS per_booking, round(sum(revenue_per_guest), 3) AS per_guest"
    " FROM f GROUP BY ALL",
)
oracle(
    "country_names",
    "SELECT country, coalesce(name, country, 'unknown') AS country_name, count(*) AS n"
    " FROM bookings LEFT JOIN names ON country = code GROUP BY ALL",
)
_MERGED = "SELECT * FROM c1 UNION SELECT * FROM c2"
oracle(
    "preprocessed",
    "SELECT hotel, arrival_month_num, country, reservation_status, count(*) AS n, CAST(sum(total_nights) AS BIGINT) AS nights,"
    " CAST(sum(children) AS BIGINT) AS children, sum(adr) AS adr, sum(adr * total_nights) AS revenue,"
    " count(arrival_date) AS arrivals, count(status_date) AS status_dates, min(arrival_date) AS first_arrival,"
    " max(status_date) AS last_status,"
    " CAST(sum(length(agent) + length(company) + length(meal)) AS BIGINT) AS letters"
    " FROM cleaned WHERE total_nights > 0 AND adr < 500 GROUP BY ALL",
    c1=_FILLED.format("raw1"), c2=_FILLED.format("raw2"), merged=_MERGED,
    cleaned=(
        "SELECT *, TRY_CAST(arrival_date_year || '-' || arrival_month_num || '-' || arrival_date_day_of_month AS DATE)"
        " AS arrival_date FROM (SELECT *, " + _MONTH_NUM.format("arrival_date_month") + " AS arrival_month_num,"
        " stays_in_weekend_nights + stays_in_week_nights AS total_nights,"
        " TRY_CAST(reservation_status_date AS DATE) AS status_date FROM merged)"
    ),
)
oracle(
    "unpivoted_nights",
    "SELECT hotel, stay_type, nights, count(*) AS n FROM ("
    "SELECT hotel, 'stays_in_weekend_nights' AS stay_type, stays_in_weekend_nights AS nights FROM bookings UNION ALL"
    " SELECT hotel, 'stays_in_week_nights', stays_in_week_nights FROM bookings) GROUP BY ALL",
)
oracle("available_columns", tally("meal, adults", "bookings"))
oracle(
    "preview",
    "SELECT arrival_date, adr, lead_time, hotel FROM bookings WHERE adr IS NOT NULL"
    " ORDER BY arrival_date, adr, lead_time, hotel LIMIT 5",
)
oracle(
    "stage_counts",
    "SELECT 1 AS step, 'file 1' AS stage, (SELECT count(*) FROM raw1) AS rows UNION ALL"
    " SELECT 2, 'file 2', (SELECT count(*) FROM raw2) UNION ALL"
    " SELECT 3, 'union', (SELECT count(*) FROM raw1) + (SELECT count(*) FROM raw2) UNION ALL"
    " SELECT 4, 'deduplicated', (SELECT count(*) FROM merged) UNION ALL"
    " SELECT 5, 'with nights', (SELECT count(*) FROM merged WHERE stays_in_weekend_nights + stays_in_week_nights > 0)"
    " UNION ALL SELECT 6, 'below rate limit', (SELECT count(*) FROM merged"
    " WHERE stays_in_weekend_nights + stays_in_week_nights > 0 AND adr < 500)",
    c1=_FILLED.format("raw1"), c2=_FILLED.format("raw2"), merged=_MERGED,
)
ORACLES["observed_stage_counts"] = ORACLES["stage_counts"]
oracle(
    "union_of_exports",
    "SELECT hotel, company, count(*) AS n FROM (SELECT hotel, company FROM raw1 UNION ALL"
    " SELECT hotel, NULL FROM raw2) GROUP BY ALL",
)
oracle(
    "distinct_rows",
    "SELECT hotel, is_canceled, country, count(*) AS n FROM (SELECT * FROM raw1 UNION SELECT * FROM raw2) GROUP BY ALL",
)

# ---- filters --------------------------------------------------------------------


def _summary(where: str, source: str = "bookings") -> str:
    return f"SELECT hotel, customer_type, count(*) AS n, sum(adr) AS adr FROM {source} {where} GROUP BY ALL"


oracle("date_range", _summary("WHERE arrival_date BETWEEN DATE '1996-07-01' AND DATE '1997-06-30'"))
oracle(
    "listed_values",
    "SELECT *, 'listed' AS variant FROM (" + _summary("WHERE customer_type IN ('Group', 'Contract')")
    + ") UNION ALL SELECT *, 'empty list' FROM (" + _summary("") + ")",
)
oracle(
    "dashboard_rows",
    _summary("WHERE arrival_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND hotel = 'City Hotel'"
             " AND customer_type IN ('Group', 'Transient')"),
)
oracle("dashboard_no_match", _summary("WHERE arrival_date BETWEEN DATE '1980-01-01' AND DATE '1980-12-31'"))
oracle("positive_nights", _summary("WHERE total_nights > 0", "f"))
oracle("adr_below", _summary("WHERE adr < 500"))
oracle("adr_open_range", _summary("WHERE adr > 0 AND adr < 500"))
oracle("canceled_rows", _summary("WHERE is_canceled = 1"))
oracle("complete_rows", _summary("WHERE adr IS NOT NULL AND children IS NOT NULL AND country IS NOT NULL"))
oracle("known_countries", _summary("WHERE country IS NOT NULL"))
oracle("date_bounds", "SELECT min(arrival_date) AS min_date, max(arrival_date) AS max_date FROM bookings")
oracle(
    "filter_choices",
    "SELECT DISTINCT 'hotel' AS column_name, hotel AS value FROM bookings UNION ALL"
    " SELECT DISTINCT 'customer_type', customer_type FROM bookings",
)

# ---- joins ----------------------------------------------------------------------

_TOP10 = (
    "SELECT country FROM {} WHERE country IS NOT NULL GROUP BY country ORDER BY count(*) DESC, country LIMIT 10"
)
oracle(
    "top_country_rows",
    "SELECT country, customer_type, count(*) AS bookings FROM bookings"
    f" WHERE country IN ({_TOP10.format('bookings')}) GROUP BY ALL",
)
oracle(
    "frequent_arrival_rows",
    "SELECT arrival_date, hotel, count(*) AS n FROM bookings WHERE arrival_date IN"
    " (SELECT arrival_date FROM bookings GROUP BY 1 HAVING count(*) > 20) GROUP BY ALL",
)

oracle(
    "frequent_country_rows",
    "SELECT country, customer_type, count(*) AS n FROM bookings WHERE country IN"
    " (SELECT country FROM bookings GROUP BY 1 HAVING count(*) > 20) GROUP BY ALL",
)

# ---- insights -------------------------------------------------------------------

oracle("revenue_insights", _REVENUE)
oracle("cancellation_insights", _CANCEL_LOC.format(10))
oracle("average_adr_insight", "SELECT round(avg(adr), 6) AS average_adr FROM bookings")
oracle("top_booking_countries", _TOP_COUNTRY.format(10))
oracle("cancellation_by_date", _TOP_DATE.format(10))
oracle("cancellations_per_date", _PER_DATE)
_INSIGHTS = {
    "rev": _REVENUE, "loc": _CANCEL_LOC.format(10), "cou": _TOP_COUNTRY.format(10), "dat": _TOP_DATE.format(10),
    "avg_adr": "SELECT avg(adr) AS average_adr FROM bookings", "per": _PER_DATE,
}
_REPORT = {k: v for k, v in _INSIGHTS.items() if k != "per"}
oracle(
    "analytics_report",
    "SELECT 'revenue_trends' AS section, CAST(row_number() OVER (ORDER BY year, " + _MONTH_NUM.format("month")
    + ") AS INT) AS rank, month || ' ' || year AS label, format('{:,.2f}', revenue) AS value FROM rev UNION ALL"
    " SELECT 'top_cancellation_locations', CAST(row_number() OVER (ORDER BY cancellations DESC, location NULLS FIRST) AS INT),"
    " location, CAST(cancellations AS VARCHAR) FROM loc UNION ALL"
    " SELECT 'average_adr', 1, NULL, format('{:.2f}', average_adr) FROM avg_adr UNION ALL"
    " SELECT 'top_booking_countries', CAST(row_number() OVER (ORDER BY \"count\" DESC, country NULLS FIRST) AS INT),"
    " country, CAST(\"count\" AS VARCHAR) FROM cou UNION ALL"
    " SELECT 'top_cancellation_dates', CAST(row_number() OVER (ORDER BY \"count\" DESC, \"date\" NULLS FIRST) AS INT),"
    " CAST(\"date\" AS VARCHAR), CAST(\"count\" AS VARCHAR) FROM dat",
    **_REPORT,
)
oracle(
    "analytics_json",
    "SELECT CAST(to_json({"
    "'revenue_trends': (SELECT list({'month': month, 'year': year, 'revenue': format('{:,.2f}', revenue)} ORDER BY year, "
    + _MONTH_NUM.format("month") + ") FROM rev),"
    " 'top_cancellation_locations': (SELECT list({'location': location, 'cancellations': cancellations}"
    " ORDER BY cancellations DESC, location NULLS FIRST) FROM loc),"
    " 'average_adr': (SELECT format('{:.2f}', average_adr) FROM avg_adr),"
    " 'top_booking_countries': (SELECT list({'country': country, 'count': \"count\"}"
    " ORDER BY \"count\" DESC, country NULLS FIRST) FROM cou),"
    " 'top_cancellation_dates': (SELECT list({'date': \"date\", 'count': \"count\"}"
    " ORDER BY \"count\" DESC, \"date\" NULLS FIRST) FROM dat)}) AS VARCHAR) AS report",
    **_REPORT,
)

# ---- reports --------------------------------------------------------------------

_RATE = "round(avg(is_canceled) * 100, 6) AS cancel_rate"
oracle(
    "overview_metrics",
    f"SELECT count(*) AS bookings, sum(revenue) AS revenue, round(avg(adr), 6) AS average_adr, {_RATE} FROM f",
)
oracle(
    "bookings_by_column",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS bookings FROM f GROUP BY {c}"
        for c in ("hotel", "is_canceled", "reservation_status", "customer_type", "reserved_room_type",
                  "market_segment", "distribution_channel")
    ),
)


def _share(col: str) -> str:
    return (
        f"SELECT {col}, count(*) AS bookings, round(count(*) * 100.0::DOUBLE / (SELECT count({col}) FROM f), 6) AS share"
        f" FROM f WHERE {col} IS NOT NULL GROUP BY {col}"
    )


oracle("status_share", _share("reservation_status"))
oracle("segment_share", _share("market_segment"))
oracle("monthly_bookings", "SELECT month_year, count(*) AS booking_count FROM f GROUP BY 1")
_MONTHS = "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{m}')" for i, m in enumerate(MONTHS, 1)) + ") v(month_num, name)"
oracle(
    "bookings_per_month_name",
    "SELECT month_num, name AS arrival_date_month, count(arrival_date_month) AS bookings"
    " FROM months LEFT JOIN bookings ON name = arrival_date_month GROUP BY ALL",
    months=_MONTHS,
)
oracle(
    "revenue_by_period",
    "SELECT 'monthly' AS level, month_year AS period, sum(revenue) AS revenue FROM f GROUP BY ALL UNION ALL"
    " SELECT 'quarterly', quarter, sum(revenue) FROM f GROUP BY ALL UNION ALL"
    " SELECT 'yearly', CAST(year AS VARCHAR), sum(revenue) FROM f GROUP BY ALL",
)
oracle("revenue_by_hotel", "SELECT hotel, sum(revenue) AS revenue FROM f GROUP BY 1")
oracle("adr_by_month", "SELECT month_year, round(avg(adr), 6) AS adr FROM f GROUP BY 1")
oracle(
    "segment_channel_revenue",
    "SELECT market_segment, distribution_channel, sum(revenue) AS revenue FROM f GROUP BY ALL",
)
oracle(
    "segment_channel_pivot",
    "SELECT market_segment, "
    + ", ".join(
        f'sum(CASE WHEN distribution_channel = \'{c}\' THEN revenue END) AS "{c}"'
        for c in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")
    )
    + ", sum(CASE WHEN distribution_channel NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED') THEN revenue END) AS other"
    + " FROM f GROUP BY 1",
)
oracle(
    "revenue_means",
    "SELECT sum(revenue) AS revenue, round(avg(revenue), 6) AS revenue_per_booking,"
    " round(avg(revenue_per_guest), 6) AS revenue_per_guest FROM f",
)
oracle(
    "cancellation_metrics",
    f"SELECT {_RATE}, CAST(sum(is_canceled) AS BIGINT) AS cancellations,"
    " round(avg(lead_time) FILTER (WHERE is_canceled = 1), 6) AS lead_time_canceled FROM f",
)
oracle(
    "cancel_rate_by_column",
    " UNION ALL ".join(
        f"SELECT '{label}' AS column_name, {c} AS value, {_RATE} FROM f GROUP BY {c}"
        for label, c in (("hotel", "hotel"), ("customer_type", "customer_type"), ("deposit_type", "deposit_type"),
                         ("hotel, checked flag", "hotel"))
    ),
)
oracle(
    "cancel_rate_top_booked",
    f"SELECT country, {_RATE} FROM f WHERE country IN ({_TOP10.format('f')}) GROUP BY 1",
)
oracle(
    "top_cancel_rate_countries",
    "SELECT country, bookings, round(rate, 6) AS cancel_rate FROM (SELECT country, count(*) AS bookings,"
    " avg(is_canceled) * 100 AS rate FROM shown GROUP BY 1 HAVING count(*) > 100 ORDER BY rate DESC, country LIMIT 10)",
)
oracle(
    "cancel_rate_over_20_bookings",
    "SELECT country, bookings, round(rate, 6) AS cancel_rate FROM (SELECT country, count(*) AS bookings,"
    " avg(is_canceled) * 100 AS rate FROM shown GROUP BY 1 HAVING count(*) > 20 ORDER BY rate DESC, country LIMIT 10)",
)
oracle(
    "cancel_rate_of_hotels",
    "SELECT hotel, round(avg(is_canceled) * 100, 6) AS plain, round(avg(is_canceled) * 100, 6) AS cancel_rate FROM f"
    " WHERE hotel IS NOT NULL GROUP BY 1",
)
oracle(
    "top_countries",
    "SELECT country, count(*) AS booking_count FROM shown GROUP BY 1 ORDER BY booking_count DESC, country LIMIT 10",
)
oracle(
    "top_named_countries",
    "SELECT coalesce(name, country) AS country_name, count(*) AS bookings FROM shown LEFT JOIN names ON country = code"
    " WHERE country <> 'Unknown' GROUP BY 1 ORDER BY bookings DESC, country_name LIMIT 10",
)
oracle(
    "mean_revenue_top_countries",
    "SELECT country, round(avg(revenue), 6) AS revenue FROM shown"
    f" WHERE country IN ({_TOP10.format('shown')}) GROUP BY 1",
)
oracle(
    "country_summary",
    f"SELECT country, count(is_canceled) AS bookings, sum(revenue) AS revenue, {_RATE} FROM shown GROUP BY 1",
)
oracle(
    "mean_by_column",
    " UNION ALL ".join(
        f"SELECT '{k}/{m}' AS report, {k} AS value, round(avg({m}), 6) AS mean FROM f GROUP BY {k}"
        for k, m in (("customer_type", "adr"), ("customer_type", "total_of_special_requests"),
                     ("customer_type", "lead_time"), ("market_segment", "revenue"), ("distribution_channel", "revenue"))
    ),
)
oracle("avg_stay", "SELECT round(avg(total_nights), 6) AS average_nights FROM f")
oracle(
    "room_crosstab",
    "SELECT reserved_room_type, "
    + ", ".join(
        f'count(*) FILTER (WHERE assigned_room_type = \'{r}\') AS "{r}"'
        for r in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
    )
    + " FROM f GROUP BY 1",
)
oracle(
    "booking_changes_impact",
    "SELECT booking_changes, round(avg(is_canceled), 6) AS cancel_fraction, round(avg(revenue), 6) AS revenue"
    " FROM f GROUP BY 1",
)
oracle(
    "seasonal_revenue",
    "SELECT month_num, name AS arrival_month_name, round(avg(revenue), 6) AS revenue"
    " FROM months LEFT JOIN f ON name = arrival_month_name GROUP BY ALL",
    months=_MONTHS,
)
oracle(
    "top_agents",
    "SELECT coalesce(agent, 'unknown') AS agent, count(*) AS booking_count FROM f GROUP BY 1"
    " ORDER BY booking_count DESC, 1 LIMIT 10",
)
oracle(
    "agent_stats",
    f"SELECT agent, sum(revenue) AS revenue, {_RATE} FROM f WHERE agent IS NOT NULL GROUP BY 1"
    " ORDER BY sum(revenue) DESC, agent LIMIT 10",
)
oracle(
    "top_companies",
    "SELECT coalesce(company, 'unknown') AS company, count(*) AS bookings FROM f GROUP BY 1"
    " ORDER BY bookings DESC, 1 LIMIT 10",
)
oracle(
    "waitlist_vs_cancel",
    "SELECT days_in_waiting_list, round(avg(is_canceled), 6) AS cancel_fraction FROM f GROUP BY 1",
)
oracle(
    "stay_vs_revenue",
    "SELECT total_nights, round(avg(revenue), 6) AS revenue FROM f WHERE total_nights <= 5 GROUP BY 1",
)
_DECILES = "SELECT " + ", ".join(f"quantile_cont(adr, {i / 10}) AS e{i}" for i in range(11)) + " FROM f"
_BIN = "greatest(" + " + ".join(f"CAST(e{i} < adr AS INT)" for i in range(11)) + " - 1, 0)"
oracle(
    "price_sensitivity",
    f"SELECT {_BIN} AS adr_bin, round(avg(adr), 6) AS adr, {_RATE} FROM f, edges WHERE adr IS NOT NULL GROUP BY 1",
    edges=_DECILES,
)


def _cut(first: str) -> str:
    arms = []
    for i, label in enumerate(LEAD_TIME_LABELS):
        low = f"lead_time {first if i == 0 else '>'} {LEAD_TIME_EDGES[i]}"
        high = f" AND lead_time <= {LEAD_TIME_EDGES[i + 1]}" if i + 1 < len(LEAD_TIME_EDGES) else ""
        arms.append(f"WHEN {low}{high} THEN '{label}'")
    return "CASE " + " ".join(arms) + " END"


oracle(
    "lead_time_bins",
    f"SELECT bin_order, label AS lead_time_bin, round(avg(revenue), 6) AS revenue, {_RATE} FROM bins"
    f" LEFT JOIN (SELECT *, {_cut('>')} AS b FROM f) ON label = b GROUP BY ALL",
    bins="SELECT * FROM (VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(LEAD_TIME_LABELS)) + ") v(bin_order, label)",
)
oracle(
    "revenue_yoy",
    "SELECT a.level, a.year, a.month_num, a.revenue, b.revenue AS previous, a.revenue - b.revenue AS change,"
    " round((a.revenue - b.revenue) * 100 / b.revenue, 6) AS change_percent FROM sums a LEFT JOIN sums b"
    " ON a.level = b.level AND a.year = b.year + 1 AND a.month_num IS NOT DISTINCT FROM b.month_num",
    sums="SELECT 'month' AS level, year, CAST(month(arrival_date) AS INT) AS month_num, sum(revenue) AS revenue FROM f"
    " GROUP BY ALL UNION ALL SELECT 'year', year, NULL, sum(revenue) FROM f GROUP BY ALL",
)
oracle(
    "adr_by_room_season",
    "SELECT reserved_room_type, CAST(quarter(arrival_date) AS INT) AS season, round(avg(adr), 6) AS adr FROM f GROUP BY ALL",
)
oracle("cancel_rate_by_period", f"SELECT month_year, {_RATE} FROM f GROUP BY 1")
oracle("revenue_by_room", "SELECT reserved_room_type, sum(revenue) AS revenue FROM f GROUP BY 1")
oracle(
    "canceled_revenue_impact",
    "SELECT market_segment, sum(revenue) AS revenue, sum(revenue) FILTER (WHERE is_canceled = 1) AS canceled_revenue,"
    " round(sum(revenue) FILTER (WHERE is_canceled = 1) * 100 / sum(revenue), 6) AS canceled_percent FROM f GROUP BY 1",
)
oracle(
    "waitlist_metrics",
    "SELECT days_in_waiting_list > 0 AS waited, count(*) AS bookings,"
    f" round(avg(days_in_waiting_list), 6) AS average_wait, {_RATE} FROM f GROUP BY 1",
)
oracle(
    "occupancy_by_date",
    'SELECT CAST(d AS DATE) AS "date", count(*) AS rooms_in_use FROM (SELECT unnest(generate_series(arrival_date,'
    " arrival_date + CAST(total_nights - 1 AS INT), INTERVAL 1 DAY)) AS d FROM f"
    " WHERE is_canceled = 0 AND total_nights > 0) GROUP BY 1",
)

# ---- statistics -------------------------------------------------------------------


def _histogram(measure: str, where: str) -> str:
    edge = "(lo + {} * ((hi - lo) / 50.0::DOUBLE))"
    return (
        f"SELECT '{measure}' AS measure, CAST(b AS INT) AS bin, round({edge.format('b')}, 6) AS bin_start,"
        f" round({edge.format('(b + 1)')}, 6) AS bin_end, count({measure}) AS n"
        f" FROM (SELECT CAST(min({measure}) AS DOUBLE) AS lo, CAST(max({measure}) AS DOUBLE) AS hi FROM f {where})"
        f" CROSS JOIN range(50) r(b) LEFT JOIN (SELECT {measure} FROM f {where})"
        f" ON {measure} >= {edge.format('b')} AND ({measure} < {edge.format('(b + 1)')} OR b = 49)"
        " GROUP BY b, lo, hi"
    )


oracle(
    "histograms",
    " UNION ALL ".join(
        "(" + _histogram(m, w) + ")"
        for m, w in (("lead_time", ""), ("days_in_waiting_list", ""), ("adr", "WHERE adr > 0 AND adr < 500"))
    ),
)
oracle(
    "quantile_codes",
    f"SELECT adr, CASE WHEN adr IS NOT NULL THEN {_BIN} END AS adr_bin, count(*) AS n FROM f, edges GROUP BY ALL",
    edges=_DECILES,
)
oracle(
    "rate_quantiles",
    "SELECT hotel, meal, count(adr) AS n, "
    + ", ".join(f"round(quantile_cont(adr, {p}), 6) AS q{i}" for i, p in enumerate((0.01, 0.25, 0.5, 0.75, 0.999)))
    + " FROM f GROUP BY ALL",
)
oracle(
    "cut_codes",
    f"SELECT lead_time, {_cut('>')} AS lead_time_bin, count(*) AS n, 'literal' AS variant FROM f GROUP BY ALL UNION ALL"
    f" SELECT lead_time, {_cut('>=')}, count(*), 'lowest' FROM f GROUP BY ALL",
)


def _box(rows: str) -> str:
    return (
        "SELECT key, count(*) AS n, min(q1) AS q1, min(median) AS median, min(q3) AS q3,"
        " CAST(min(v) FILTER (WHERE inside) AS DOUBLE) AS whisker_low,"
        " CAST(max(v) FILTER (WHERE inside) AS DOUBLE) AS whisker_high,"
        " count(*) FILTER (WHERE NOT inside) AS outliers FROM (SELECT *, v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside"
        f" FROM ({rows}) JOIN (SELECT key, quantile_cont(v, 0.25)::DOUBLE AS q1, quantile_cont(v, 0.5)::DOUBLE AS median,"
        f" quantile_cont(v, 0.75)::DOUBLE AS q3 FROM ({rows}) GROUP BY key) USING (key)) GROUP BY key"
    )


oracle(
    "box_statistics",
    _box("SELECT CAST(is_canceled AS VARCHAR) AS key, CAST(lead_time AS DOUBLE) AS v FROM f") + " UNION ALL "
    + _box("SELECT 'stays_in_weekend_nights' AS key, CAST(stays_in_weekend_nights AS DOUBLE) AS v FROM f UNION ALL"
           " SELECT 'stays_in_week_nights', CAST(stays_in_week_nights AS DOUBLE) FROM f"),
)


def _kde(measure: str, where: str) -> str:
    return (
        f"SELECT '{measure}' AS measure, CAST(p AS INT) AS point, round(lo + p * (hi - lo) / 199, 8) AS x,"
        " round(sum(w * exp(-0.5 * ((lo + p * (hi - lo) / 199 - v) / h) ** 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 8) AS density"
        f" FROM (SELECT min({measure})::DOUBLE AS lo, max({measure})::DOUBLE AS hi, count({measure}) AS n,"
        f" stddev_samp({measure}) * power(count({measure}), -0.2) AS h FROM f {where})"
        f" CROSS JOIN range(200) r(p) CROSS JOIN (SELECT {measure}::DOUBLE AS v, count(*) AS w FROM f {where} GROUP BY 1)"
        " GROUP BY p, lo, hi"
    )


oracle(
    "densities",
    "(" + _kde("lead_time", "WHERE lead_time IS NOT NULL") + ") UNION ALL ("
    + _kde("adr", "WHERE adr > 0 AND adr < 500") + ")",
)
_CORR = [*CORRELATION_COLUMNS, "constant"]
oracle(
    "correlations",
    " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, "
        + ("CAST(NULL AS DOUBLE) AS corr" if "constant" in (a, b) else f"round(corr({a}, {b}), 6) AS corr FROM f")
        for a in _CORR
        for b in _CORR
    ),
)

oracle(
    "planted_importance",
    "SELECT 8 AS features, 1.0::DOUBLE AS total, 'lead_time' AS first, true AS none_negative, report"
    " FROM (VALUES ('forest'), ('guarded')) v(report) WHERE (SELECT count(DISTINCT is_canceled) FROM f) = 2"
    " UNION ALL SELECT 0, 0.0, 'not enough rows', true, 'few'",
)

# ---- text and vectors ---------------------------------------------------------------

_VIEWED = (
    "SELECT * REPLACE (coalesce(children, 0) AS children, coalesce(country, 'Unknown') AS country,"
    " coalesce(TRY_CAST(agent AS INT), 0) AS agent, coalesce(TRY_CAST(company AS INT), 0) AS company,"
    " coalesce(adr, 0.0::DOUBLE) AS adr, coalesce(adr, 0.0::DOUBLE) * total_nights AS revenue) FROM f"
)


_TEXT_ROWS = """SELECT format('Hotel: {}. Canceled: {}. Lead time: {} days. Arrival: {}-{}-{} (Week {}). '
    || 'Stay: {} weeknights, {} weekend nights. Guests: {} adults, {} children, {} babies. Meal: {}. Country: {}. '
    || 'Market segment: {}, Channel: {}. Repeated guest: {}. '
    || 'Previous cancellations: {}, Previous bookings not canceled: {}. Room reserved: {}, Assigned: {}. '
    || 'Booking changes: {}. Deposit type: {}. Agent: {}, Company: {}. Waiting list days: {}. Customer type: {}. ADR: {}. '
    || 'Parking spaces: {}. Special requests: {}. Reservation status: {} on {}. Total nights: {}. Revenue: {}.',
    hotel, CASE is_canceled WHEN '1' THEN 'Yes' ELSE 'No' END, lead_time, arrival_date_day_of_month, arrival_date_month,
    arrival_date_year, arrival_date_week_number, stays_in_week_nights, stays_in_weekend_nights, adults, children, babies, meal,
    coalesce(name, country), market_segment, distribution_channel, CASE is_repeated_guest WHEN '1' THEN 'Yes' ELSE 'No' END,
    previous_cancellations, previous_bookings_not_canceled, reserved_room_type, assigned_room_type, booking_changes,
    deposit_type, agent, company, days_in_waiting_list, customer_type, adr, required_car_parking_spaces,
    total_of_special_requests, reservation_status, reservation_status_date, total_nights, revenue) AS text
  FROM (SELECT coalesce(CAST(COLUMNS(*) AS VARCHAR), 'unknown') FROM viewed) LEFT JOIN names ON country = code"""
oracle(
    "booking_texts",
    "SELECT md5(text) AS doc_id, CAST(length(text) AS INT) AS n_chars, substr(text, 500, 60) AS tail FROM texts",
    viewed=_VIEWED, texts=_TEXT_ROWS,
)
oracle(
    "display_numbers",
    "SELECT revenue, format('{:,.2f}', revenue / 7) AS money, format('{:.2f}', revenue * 1000 / 8) AS plain,"
    " CAST(revenue * 54321 AS VARCHAR) AS large, CAST(revenue / 2097152 AS VARCHAR) AS small"
    " FROM (SELECT DISTINCT revenue FROM f WHERE revenue IS NOT NULL)",
)


def _spots(rows: str, key: str) -> str:
    """Signed word counts per (key, dimension)."""
    return (
        f"SELECT {key}, CAST(('0x' || substr(m, 1, 8))::BIGINT % 64 AS INT) AS dim,"
        " sum(CASE WHEN substr(m, 9, 1) < '8' THEN 1 ELSE -1 END)::DOUBLE AS s"
        f" FROM (SELECT {key}, md5(word) AS m FROM (SELECT {key},"
        f" unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS word FROM ({rows}))) GROUP BY ALL"
    )


def _weights(rows: str, key: str) -> str:
    return (
        f"SELECT {key}, dim, round(CAST(CAST(s / sqrt(sum(s * s) OVER (PARTITION BY {key})) AS FLOAT) AS DOUBLE), 5) AS weight"
        f" FROM ({_spots(rows, key)}) QUALIFY s <> 0"
    )


oracle("document_vectors", _weights("SELECT doc_id, text FROM documents", "doc_id"))
oracle(
    "cached_vectors",
    _weights("SELECT conv_id || '/' || turn AS doc_id, text FROM conversations", "doc_id"),
)
oracle(
    "nearest_to_label_centres",
    "SELECT query_id, CAST(rank AS INT) AS rank, vec_id, round(d, 6) AS dist2 FROM (SELECT *,"
    " row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM (SELECT c.label AS query_id, vec_id,"
    " round(list_sum(list_transform(list_zip(c.v, list_transform(e.embedding, lambda x: x::DOUBLE)), lambda z: (z[1] - z[2]) ** 2)), 9) AS d"
    " FROM centres c CROSS JOIN embeddings e)) WHERE rank <= 5",
    centres="SELECT label, list(x ORDER BY dim) AS v FROM (SELECT label, dim, avg(x::DOUBLE) AS x FROM (SELECT label,"
    " unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings) GROUP BY ALL) GROUP BY label",
)
oracle(
    "vector_check",
    "SELECT corpus_rows, query_rows, least(lo, own) AS min_dim, greatest(hi, own) AS max_dim, status, \"case\" FROM ("
    "SELECT count(*) AS corpus_rows, CAST(min(len(embedding)) AS INT) AS lo, CAST(max(len(embedding)) AS INT) AS hi FROM embeddings)"
    " CROSS JOIN (SELECT n AS query_rows, 64 AS own, CASE WHEN n = 0 THEN 'empty' WHEN d = 64 THEN 'ok' ELSE 'dimension mismatch' END"
    " AS status, 'same' AS \"case\" FROM turns, dims UNION ALL SELECT n, 32, CASE WHEN d = 32 THEN 'ok' ELSE 'dimension mismatch' END,"
    " 'shorter' FROM turns, dims UNION ALL SELECT 0, NULL, 'empty', 'none')",
    turns="SELECT count(*) AS n FROM conversations", dims="SELECT max(len(embedding)) AS d FROM embeddings",
)


def _question_form(prefix: str, keys: list[str], parts: list[str]) -> str:
    q_id = " || '/' || ".join([text(prefix), *keys])
    words = " || ".join(p if p in keys else text(p) for p in parts)
    known = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    return f"SELECT DISTINCT {q_id} AS q_id, {words} AS question FROM bookings WHERE {known}"


_HEAD, _SEP = text(PROMPT_START), text("\n---\n")


def _vectors(spots: str, key: str) -> str:
    """Unit vectors as fixed-size arrays."""
    entry = ", ".join(f"coalesce(max(w) FILTER (WHERE dim = {i}), 0)" for i in range(64))
    return (
        f"SELECT {key}, [{entry}]::DOUBLE[64] AS v FROM (SELECT {key}, dim,"
        f" CAST(CAST(s / coalesce(nullif(sqrt(sum(s * s) OVER (PARTITION BY {key})), 0), 1) AS FLOAT) AS DOUBLE) AS w FROM ({spots})) GROUP BY {key}"
    )


oracle(
    "prompts_without_context",
    "SELECT conv_id, turn, CASE WHEN role = 'assistant' AND length(text) > 0 THEN md5("
    f"{_HEAD} || text || chr(10) || chr(10) || 'Question: ' || text || chr(10) || chr(10) || 'Answer:') END AS prompt,"
    f" CASE WHEN role <> 'assistant' OR length(text) = 0 THEN {text(NO_CONTEXT)} END AS answer FROM conversations",
)
oracle(
    "extracted_answers",
    "SELECT conv_id, turn, CASE WHEN answer = '' THEN " + text(NO_GENERATION) + " ELSE answer END AS answer FROM ("
    "SELECT conv_id, turn, CASE WHEN turn > 1 THEN '' ELSE regexp_replace(last, '^\\s+|\\s+$', '', 'g') END AS answer"
    " FROM (SELECT *, CASE WHEN contains(text, 'Answer:') THEN split_part(text, 'Answer:', -1) ELSE text END AS last"
    " FROM conversations))",
)

# ---- questions ------------------------------------------------------------------------

_ASKED = (
    "SELECT 'chat/' || conv_id || '/' || turn AS q_id, text AS question FROM conversations WHERE role = 'user'"
    + "".join(" UNION ALL " + _question_form(*form) for form in QUESTION_FORMS)
)
_HAS = "contains(lower(question), '{}')".format
_MONTH_PATTERN = text(MONTH_YEAR_PATTERN)
_SHORT = f"substr(regexp_extract(lower(question), {_MONTH_PATTERN}, 1), 1, 3)"
_ROUTED = (
    "SELECT *, CASE WHEN route = 'revenue' THEN CASE " + _SHORT + " "
    + " ".join(f"WHEN '{m[:3].lower()}' THEN '{m}'" for m in MONTHS)
    + f" END END AS month, CASE WHEN route = 'revenue' THEN TRY_CAST(regexp_extract(lower(question), {_MONTH_PATTERN}, 2) AS INT)"
    f" END AS year, CASE WHEN route = 'cancel_on_date' THEN nullif(regexp_extract(question, {text(DATE_PATTERN)}, 1), '') END"
    " AS date_text FROM (SELECT *, CASE"
    f" WHEN {_HAS('total revenue')} THEN 'revenue'"
    f" WHEN {_HAS('highest booking cancellations')} AND ({_HAS('location')} OR {_HAS('country')}) THEN 'cancel_location'"
    f" WHEN {_HAS('average price')} OR {_HAS('average adr')} THEN 'avg_adr'"
    f" WHEN {_HAS('most cancellations')} AND ({_HAS('date')} OR {_HAS('when')}) THEN 'cancel_dates'"
    f" WHEN {_HAS('cancellations on')} THEN 'cancel_on_date'"
    f" WHEN {_HAS('most bookings')} AND {_HAS('country')} THEN 'top_countries'"
    " ELSE 'rag' END AS route FROM asked)"
)


def _prompts(texts: str) -> dict[str, str]:
    """CTEs that end in ``prompts``: the five nearest texts of every question on the rag route, copies counted."""
    return {
        "asked": _ASKED, "routed": _ROUTED,
        "docs": f"SELECT md5(text) AS doc_id, text, count(*) AS copies FROM ({texts}) WHERE text IS NOT NULL GROUP BY text",
        "open_questions": "SELECT q_id, question FROM routed WHERE route = 'rag'",
        "dv": _vectors(_spots("SELECT doc_id, text FROM docs", "doc_id"), "doc_id"),
        "asked_texts": "SELECT DISTINCT md5(coalesce(question, '')) AS t_id, question AS text FROM open_questions",
        "worded": _vectors(_spots("SELECT t_id, text FROM asked_texts", "t_id"), "t_id"),
        "qv": "SELECT t_id, coalesce(v, [0.0 for i in range(64)]::DOUBLE[64]) AS v FROM asked_texts LEFT JOIN worded USING (t_id)",
        "near": "SELECT t_id, doc_id, copies, rank, sum(copies) OVER (PARTITION BY t_id ORDER BY rank) - copies AS before FROM"
        " (SELECT t_id, doc_id, row_number() OVER (PARTITION BY t_id ORDER BY d, doc_id) AS rank FROM"
        " (SELECT t_id, doc_id, round(array_distance(qv.v, dv.v) ** 2, 9) AS d FROM qv CROSS JOIN dv)"
        " QUALIFY rank <= 5) JOIN docs USING (doc_id)",
        "places": "SELECT t_id, doc_id, rank, unnest(range(least(copies, 5 - before)::BIGINT)) AS copy FROM near WHERE before < 5",
        "contexts": f"SELECT t_id, string_agg(text, {_SEP} ORDER BY rank, copy) AS context FROM places JOIN docs USING (doc_id) GROUP BY t_id",
        "prompts": f"SELECT q_id, {_HEAD} || context || chr(10) || chr(10) || 'Question: '"
        " || question || chr(10) || chr(10) || 'Answer:' AS prompt, CAST(NULL AS VARCHAR) AS answer"
        " FROM open_questions JOIN contexts ON t_id = md5(coalesce(question, ''))",
    }


oracle("prompts_for_questions", "SELECT q_id, prompt, answer FROM prompts", viewed=_VIEWED, texts=_TEXT_ROWS, **_prompts("SELECT text FROM texts"))
oracle(
    "prompts_with_repeated_texts", "SELECT q_id, prompt, answer FROM prompts",
    **_prompts("SELECT 'A ' || customer_type || ' guest at the ' || hotel || ' with meal ' || meal AS text FROM bookings"),
)
oracle(
    "nearest_documents",
    "SELECT query_id, CAST(rank AS INT) AS rank, vec_id, round(d, 6) AS dist2 FROM (SELECT *,"
    " row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM (SELECT e.vec_id AS query_id, v.doc_id AS vec_id,"
    " round(array_distance(e.embedding::DOUBLE[64], v.v) ** 2, 9) AS d FROM embeddings e CROSS JOIN dv v)) WHERE rank <= 3",
    worded=_vectors(_spots("SELECT doc_id, text FROM documents", "doc_id"), "doc_id"),
    dv="SELECT doc_id, coalesce(v, [0.0 for i in range(64)]::DOUBLE[64]) AS v FROM documents LEFT JOIN worded USING (doc_id)",
)
oracle(
    "nearest_embeddings",
    "SELECT query_id, CAST(rank AS INT) AS rank, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank"
    " FROM (SELECT a.vec_id AS query_id, b.vec_id, round(array_distance(a.e, b.e) ** 2, 9) AS d FROM es a CROSS JOIN es b)) WHERE rank <= 5",
    es="SELECT vec_id, embedding::DOUBLE[64] AS e FROM embeddings",
)
oracle("cells_skip_pairs", "SELECT count(*) AS n_vectors, true AS fewer FROM documents")
oracle(
    "approximate_recall",
    "SELECT k::INTEGER AS k, (SELECT count(*) FROM documents) * least(k, (SELECT count(*) FROM documents)) AS n_neighbours, true AS enough"
    " FROM (VALUES (1), (5), (10)) t(k)",
)
oracle("question_routes", "SELECT q_id, route, month, year, date_text FROM routed", asked=_ASKED, routed=_ROUTED)
oracle(
    "revenue_answers",
    f"SELECT q_id, CASE WHEN r.month IS NULL THEN {text(ASK_FOR_MONTH)}"
    " WHEN revenue IS NULL THEN 'No revenue data found for ' || r.month || ' ' || r.year || '.'"
    " ELSE 'Total revenue for ' || r.month || ' ' || r.year || ' was ' || format('{:,.2f}', revenue) || '.' END AS answer"
    " FROM routed r LEFT JOIN rev ON r.month = rev.month AND r.year = rev.year WHERE route = 'revenue'",
    asked=_ASKED, routed=_ROUTED, rev=_REVENUE,
)


def _top_lines(label: str, count: str, unit: str, head: str) -> str:
    line = f"'- ' || coalesce(CAST({label} AS VARCHAR), 'None') || ': ' || {count} || ' {unit}'"
    return f"SELECT {text(head)} || string_agg({line}, chr(10) ORDER BY {count} DESC, {label} NULLS FIRST) AS answer FROM five"


for _name, _route, _lines, _five in (
    ("cancel_location_answers", "cancel_location",
     _top_lines("location", "cancellations", "cancellations", TOP_LOCATIONS), _CANCEL_LOC.format(5)),
    ("cancel_date_answers", "cancel_dates",
     _top_lines('"date"', '"count"', "cancellations", TOP_DATES), _TOP_DATE.format(5)),
    ("top_country_answers", "top_countries",
     _top_lines("country", '"count"', "bookings", TOP_COUNTRIES), _TOP_COUNTRY.format(5)),
    ("average_adr_answers", "avg_adr",
     "SELECT 'The overall average daily rate (ADR) across all bookings is approximately ' || format('{:.2f}', adr)"
     " || '.' AS answer FROM five", "SELECT avg(adr) AS adr FROM bookings"),
):
    oracle(
        _name, f"SELECT q_id, answer FROM routed CROSS JOIN best WHERE route = '{_route}'",
        asked=_ASKED, routed=_ROUTED, five=_five, best=_lines,
    )
oracle(
    "cancellations_on_date_answers",
    f"SELECT q_id, CASE WHEN date_text IS NULL THEN {text(ASK_FOR_DATE)} WHEN \"count\" IS NULL THEN"
    " 'No cancellation data found for the specific date ' || date_text || '.' ELSE"
    " \"count\" || ' bookings were canceled on ' || date_text || '.' END AS answer FROM routed LEFT JOIN per"
    " ON date_text = CAST(\"date\" AS VARCHAR) WHERE route = 'cancel_on_date'",
    asked=_ASKED, routed=_ROUTED, per=_PER_DATE,
)
oracle(
    "questions_left_for_retrieval",
    "SELECT q_id, question, CAST(NULL AS VARCHAR) AS answer FROM routed WHERE route = 'rag'",
    asked=_ASKED, routed=_ROUTED,
)
oracle(
    "all_answers",
    f"SELECT r.q_id, route, prompt, CASE route WHEN 'revenue' THEN CASE WHEN r.month IS NULL THEN {text(ASK_FOR_MONTH)}"
    " WHEN revenue IS NULL THEN 'No revenue data found for ' || r.month || ' ' || r.year || '.'"
    " ELSE 'Total revenue for ' || r.month || ' ' || r.year || ' was ' || format('{:,.2f}', revenue) || '.' END"
    " WHEN 'cancel_location' THEN (SELECT answer FROM a1) WHEN 'cancel_dates' THEN (SELECT answer FROM a2)"
    " WHEN 'top_countries' THEN (SELECT answer FROM a3) WHEN 'avg_adr' THEN (SELECT answer FROM a4)"
    f" WHEN 'cancel_on_date' THEN CASE WHEN date_text IS NULL THEN {text(ASK_FOR_DATE)} WHEN \"count\" IS NULL THEN"
    " 'No cancellation data found for the specific date ' || date_text || '.' ELSE"
    " \"count\" || ' bookings were canceled on ' || date_text || '.' END END AS answer"
    " FROM routed r LEFT JOIN rev ON r.month = rev.month AND r.year = rev.year"
    " LEFT JOIN per ON date_text = CAST(\"date\" AS VARCHAR) LEFT JOIN prompts p ON p.q_id = r.q_id",
    viewed=_VIEWED, texts=_TEXT_ROWS, **_prompts("SELECT text FROM texts"), rev=_REVENUE, per=_PER_DATE,
    l5=_CANCEL_LOC.format(5), d5=_TOP_DATE.format(5), c5=_TOP_COUNTRY.format(5),
    a1=_top_lines("location", "cancellations", "cancellations", TOP_LOCATIONS).replace("FROM five", "FROM l5"),
    a2=_top_lines('"date"', '"count"', "cancellations", TOP_DATES).replace("FROM five", "FROM d5"),
    a3=_top_lines("country", '"count"', "bookings", TOP_COUNTRIES).replace("FROM five", "FROM c5"),
    a4="SELECT 'The overall average daily rate (ADR) across all bookings is approximately ' || format('{:.2f}', avg(adr))"
    " || '.' AS answer FROM bookings",
)
