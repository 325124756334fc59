"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: All whitespace characters (fixed values).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(col: Column) -> Column:
    """Remove all leading and trailing whitespace (plain ``trim`` removes spaces only)."""
    return F.trim(col, F.lit(WHITESPACE))


def or_unknown(col: Column) -> Column:
    """The value as text, ``unknown`` when it is null."""
    return F.coalesce(col.cast("string"), F.lit("unknown"))


def yes_no(col: Column) -> Column:
    """``Yes`` only for a flag equal to 1; null counts as ``No``."""
    return F.when(col == 1, F.lit("Yes")).otherwise(F.lit("No"))
