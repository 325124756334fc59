"""Column expressions: text, numbers and calendar."""

from .calendar import arrival_date, month_name, month_number, month_year, quarter_label, two_digits
from .numbers import clean_number, integer_or_zero, money, plain_money, python_float, ratio
from .text import or_unknown, strip, yes_no

__all__ = [
    "arrival_date", "clean_number", "integer_or_zero", "money", "month_name", "month_number",
    "month_year", "or_unknown", "plain_money", "python_float", "quarter_label", "ratio",
    "strip", "two_digits", "yes_no",
]
