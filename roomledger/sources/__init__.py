"""Readers and writers."""

from .bookings import read_bookings, read_bookings_csv, write_bookings, write_bucketed
from .country import country_dimension, read_country_map
from .insights import insight_exists, read_insight, write_insight
from .star import read_bookings_tables

__all__ = [
    "country_dimension", "insight_exists", "read_bookings", "read_bookings_csv",
    "read_bookings_tables", "read_country_map", "read_insight", "write_bookings",
    "write_bucketed", "write_insight",
]
