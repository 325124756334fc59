import pytest
from conftest import values
from pyspark.sql import functions as F

from roomledger import functions as fn
from roomledger.functions.text import WHITESPACE


def test_whitespace_is_what_python_strips():
    assert set(WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_strip_removes_every_kind_of_whitespace(rows):
    texts = ["  a b ", "\t\na ", "　x y ", "", " ", "plain", None]
    df = rows("s string", *[(t,) for t in texts])
    assert values(df.select(fn.strip(F.col("s")))) == [(t.strip() if t is not None else None,) for t in texts]


FLOATS = [
    0.0, 1.0, 100.25, 1234567.0, 9999999.0, 1e7, 12345678.9, 123456789.12345678, 1.5e15, 9.5e15,
    1e16, 1.2345e20, 1e300, 0.001, 0.00099999, 0.00012, 0.0001, 0.00009, 1e-5, 1.5e-10, -2.5e9, -0.0005, 0.1, 2 / 3,
]


def test_float_text_equals_repr(rows):
    df = rows("x double", *[(x,) for x in FLOATS])
    assert values(df.select(fn.python_float(F.col("x")))) == [(repr(x),) for x in FLOATS]


@pytest.mark.parametrize("x, text", [(0.125, "0.12"), (1234567.891, "1,234,567.89"), (-1234.5, "-1,234.50"), (2.675, "2.67")])
def test_money_rounds_like_a_format_string(rows, x, text):
    assert f"{x:,.2f}" == text
    row = values(rows("x double", (x,)).select(fn.money(F.col("x")), fn.plain_money(F.col("x"))))
    assert row == [(text, f"{x:.2f}")]


def test_numbers_are_coerced(rows):
    df = rows("s string", ("7",), ("9.7",), ("-3.9",), ("unknown",), ("NaN",), ("",), (None,))
    assert values(df.select(fn.integer_or_zero(F.col("s")))) == [(7,), (9,), (-3,), (0,), (0,), (0,), (0,)]
    assert values(df.select(fn.clean_number(F.col("s"))))[3:] == [(None,)] * 4


def test_month_numbers_and_impossible_dates(rows):
    df = rows("m string, y int, d int", ("January", 2017, 31), ("February", 2017, 30), ("Smarch", 2017, 1),
              (None, 2017, 1), ("December", None, 1))
    month = fn.month_number(F.col("m"))
    got = values(df.select(month, fn.arrival_date(F.col("y"), month, F.col("d")).cast("string")))
    assert got == [(1, "2017-01-31"), (2, None), (None, None), (None, None), (12, None)]


def test_calendar_labels(rows):
    df = rows("d string", ("2017-07-04",), ("2016-01-31",), (None,)).select(F.col("d").cast("date").alias("d"))
    d = F.col("d")
    got = values(df.select(fn.month_year(d), fn.quarter_label(d), fn.month_name(d)))
    assert got == [("2017-07", "2017Q3", "July"), ("2016-01", "2016Q1", "January"), (None, None, None)]


def test_two_digits(rows):
    from roomledger.functions import two_digits

    df = rows("n int", (7,), (12,), (0,), (None,))
    assert [r[0] for r in df.select(two_digits(F.col("n"))).collect()] == ["07", "12", "00", None]
