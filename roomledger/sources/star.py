"""Bookings from an order star schema (lineitem, orders, customer, part)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import stored

#: The columns read from each table; declared, so that no file is opened for its schema.
TABLES: dict[str, str] = {
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz, "
        "o_orderpriority string"
    ),
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "part": "p_partkey bigint, p_type string, p_size int",
}

#: Booking column -> SQL over the joined tables.
BOOKING_COLUMNS: dict[str, str] = {
    "hotel": "CASE WHEN l_suppkey % 3 = 0 THEN 'Resort Hotel' ELSE 'City Hotel' END",
    "is_canceled": "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END",
    "lead_time": "CAST((l_orderkey * 7 + l_linenumber * 13) % 400 AS INT)",
    "arrival_date_year": "CAST(year(l_shipdate) AS INT)",
    "arrival_date_month": (
        "CASE month(l_shipdate) WHEN 1 THEN 'January' WHEN 2 THEN 'February' WHEN 3 THEN 'March' "
        "WHEN 4 THEN 'April' WHEN 5 THEN 'May' WHEN 6 THEN 'June' WHEN 7 THEN 'July' WHEN 8 THEN 'August' "
        "WHEN 9 THEN 'September' WHEN 10 THEN 'October' WHEN 11 THEN 'November' ELSE 'December' END"
    ),
    "arrival_date_week_number": "CAST(weekofyear(l_shipdate) AS INT)",
    "arrival_date_day_of_month": "CAST(day(l_shipdate) AS INT)",
    "stays_in_weekend_nights": "CAST(l_linenumber % 3 AS INT)",
    "stays_in_week_nights": "CAST(CAST(l_quantity AS INT) % 6 AS INT)",
    "adults": "CAST(l_linenumber % 4 AS INT)",
    "children": "CAST(CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE l_partkey % 3 END AS INT)",
    "babies": "CAST(CASE WHEN l_partkey % 29 = 0 THEN 1 ELSE 0 END AS INT)",
    "meal": (
        "CASE l_partkey % 5 WHEN 0 THEN 'BB' WHEN 1 THEN 'HB' WHEN 2 THEN 'FB' WHEN 3 THEN 'SC' "
        "ELSE 'Undefined' END"
    ),
    "country": (
        "CASE WHEN o_custkey % 41 = 0 THEN NULL ELSE CASE c_nationkey WHEN 0 THEN 'PRT' WHEN 1 THEN 'GBR' "
        "WHEN 2 THEN 'ESP' WHEN 3 THEN 'FRA' WHEN 4 THEN 'DEU' WHEN 5 THEN 'ITA' WHEN 6 THEN 'USA' "
        "WHEN 7 THEN 'NLD' WHEN 8 THEN 'BEL' WHEN 9 THEN 'BRA' WHEN 10 THEN 'IRL' WHEN 11 THEN 'CHN' "
        "WHEN 12 THEN 'PRT' WHEN 13 THEN 'PRT' WHEN 14 THEN 'GBR' WHEN 15 THEN 'XXA' ELSE 'XXB' END END"
    ),
    "market_segment": "c_mktsegment",
    "distribution_channel": "o_orderpriority",
    "is_repeated_guest": "CAST(CASE WHEN o_custkey % 10 = 0 THEN 1 ELSE 0 END AS INT)",
    "previous_cancellations": "CAST(CASE WHEN l_suppkey % 7 = 0 THEN l_suppkey % 3 ELSE 0 END AS INT)",
    "previous_bookings_not_canceled": "CAST(o_custkey % 5 AS INT)",
    "reserved_room_type": "p_type",
    "assigned_room_type": "CASE WHEN l_linestatus = 'O' THEN p_type ELSE 'STANDARD' END",
    "booking_changes": "CAST(l_linenumber - 1 AS INT)",
    "deposit_type": (
        "CASE o_orderstatus WHEN 'O' THEN 'No Deposit' WHEN 'F' THEN 'Non Refund' ELSE 'Refundable' END"
    ),
    "agent": "CASE WHEN l_suppkey % 13 = 0 THEN NULL ELSE CAST(l_suppkey AS VARCHAR(20)) END",
    "company": "CASE WHEN l_partkey % 11 <> 0 THEN NULL ELSE CAST(l_partkey % 50 AS VARCHAR(20)) END",
    "days_in_waiting_list": "CAST(CASE WHEN l_orderkey % 5 = 0 THEN l_orderkey % 60 ELSE 0 END AS INT)",
    "customer_type": (
        "CASE o_orderkey % 4 WHEN 0 THEN 'Contract' WHEN 1 THEN 'Group' WHEN 2 THEN 'Transient' "
        "ELSE 'Transient-Party' END"
    ),
    "adr": (
        "CASE WHEN l_partkey % 37 = 0 THEN NULL ELSE CAST(floor(l_extendedprice / 200) AS DOUBLE) "
        "+ CAST(l_linenumber % 4 AS DOUBLE) / 4 END"
    ),
    "required_car_parking_spaces": "CAST(CASE WHEN l_suppkey % 9 = 0 THEN 1 ELSE 0 END AS INT)",
    "total_of_special_requests": "CAST(p_size % 6 AS INT)",
    "reservation_status": (
        "CASE WHEN l_returnflag <> 'R' THEN 'Check-Out' WHEN l_linenumber = 7 THEN 'No-Show' "
        "ELSE 'Canceled' END"
    ),
    "reservation_status_date": "CAST(o_orderdate AS DATE)",
    "arrival_date": "CAST(l_shipdate AS DATE)",
}


def _with_a_part(lines: DataFrame, parts: DataFrame) -> DataFrame:
    """The rows of ``lines`` joined with ``parts``, without the columns of the parts.

    Different keys are compared instead of rows: lines whose key has no part are left out,
    and lines whose key has several meet them. All other lines stay where they are.
    """
    used = lines.select("l_partkey").where("l_partkey IS NOT NULL").distinct()
    counts = parts.groupBy("p_partkey").agg(F.count("*").alias("n"))
    odd = used.join(counts, used.l_partkey == counts.p_partkey, "left").where("n IS NULL OR n > 1").select("l_partkey", "n")
    odd = stored(odd, "odd-keys")
    rows = lines.where("l_partkey IS NOT NULL").join(odd.select("l_partkey"), "l_partkey", "left_anti")
    if odd.where("n > 1").isEmpty():
        return rows
    several = parts.join(odd.where("n > 1"), parts.p_partkey == odd.l_partkey, "left_semi").select("p_partkey")
    return rows.unionByName(lines.join(several, lines.l_partkey == several.p_partkey).drop("p_partkey"))


def read_bookings_tables(
    spark: SparkSession, directory: str, min_partitions: int | None = None, columns: Sequence[str] | None = None
) -> DataFrame:
    """One booking per line item, with its order, customer and part.

    With ``columns``, only these; if none of them comes from the part, lines are not
    shuffled by its key.

    The joins carry no hints: Catalyst broadcasts a dimension while it is small,
    and otherwise sort-merges with adaptive splitting of skewed keys. Line items
    that come in fewer than ``min_partitions`` splits are dealt out first, for
    work that costs more than this shuffle; large inputs have splits enough.
    """

    def table(name: str) -> DataFrame:
        return spark.read.schema(TABLES[name]).parquet(f"{directory.rstrip('/')}/{name}.parquet")

    lines, orders, customers, parts = map(table, TABLES)
    if min_partitions is not None and lines.rdd.getNumPartitions() < min_partitions:
        lines = lines.repartition(min_partitions)
    # customers meet the orders, which are fewer than the lines, so lines are shuffled for two keys, not three
    placed = orders.join(customers, orders.o_custkey == customers.c_custkey)
    wanted = {name: BOOKING_COLUMNS[name] for name in columns or BOOKING_COLUMNS}
    if any(re.search(r"\bp_", sql) for sql in wanted.values()):
        joined = lines.join(placed, lines.l_orderkey == orders.o_orderkey).join(parts, lines.l_partkey == parts.p_partkey)
    else:
        lines = _with_a_part(lines, parts)
        joined = lines.join(placed, lines.l_orderkey == orders.o_orderkey)
    return joined.selectExpr(*[f"{sql} AS {name}" for name, sql in wanted.items()])
