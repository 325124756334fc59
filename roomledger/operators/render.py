"""Bookings as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import or_unknown, python_float, yes_no
from .features import normalize_country

# Sentence layout (fixed values): a column in braces is the value as text, and
# one with ``?`` is a Yes/No flag.
SENTENCES = (
    "Hotel: {hotel}. ",
    "Canceled: {is_canceled?}. ",
    "Lead time: {lead_time} days. ",
    "Arrival: {arrival_date_day_of_month}-{arrival_date_month}-{arrival_date_year} ",
    "(Week {arrival_date_week_number}). ",
    "Stay: {stays_in_week_nights} weeknights, {stays_in_weekend_nights} weekend nights. ",
    "Guests: {adults} adults, {children} children, {babies} babies. ",
    "Meal: {meal}. ",
    "Country: {country_name}. ",
    "Market segment: {market_segment}, Channel: {distribution_channel}. ",
    "Repeated guest: {is_repeated_guest?}. ",
    "Previous cancellations: {previous_cancellations}, ",
    "Previous bookings not canceled: {previous_bookings_not_canceled}. ",
    "Room reserved: {reserved_room_type}, Assigned: {assigned_room_type}. ",
    "Booking changes: {booking_changes}. ",
    "Deposit type: {deposit_type}. ",
    "Agent: {agent}, Company: {company}. ",
    "Waiting list days: {days_in_waiting_list}. ",
    "Customer type: {customer_type}. ",
    "ADR: {adr}. ",
    "Parking spaces: {required_car_parking_spaces}. ",
    "Special requests: {total_of_special_requests}. ",
    "Reservation status: {reservation_status} on {reservation_status_date}. ",
    "Total nights: {total_nights}. ",
    "Revenue: {revenue}.",
)


def bookings_to_text(df: DataFrame, countries: DataFrame, output: str = "text") -> DataFrame:
    """Add one line of text per booking, built from column expressions only."""
    named = normalize_country(df, countries)
    doubles = {f.name for f in named.schema if isinstance(f.dataType, T.DoubleType)}
    pieces = []
    for part in "".join(SENTENCES).replace("}", "{").split("{"):
        pieces.append(part)
    columns = []
    for i, piece in enumerate(pieces):
        if i % 2 == 0:
            columns.append(F.lit(piece))
        elif piece.endswith("?"):
            columns.append(yes_no(F.col(piece[:-1])))
        elif piece in doubles:
            columns.append(or_unknown(python_float(F.col(piece))))
        else:
            columns.append(or_unknown(F.col(piece)))
    return named.withColumn(output, F.concat(*columns)).drop("country_name")
