"""Inputs of the registered queries, all derived from the given tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomledger.operators.features import report_frame
from roomledger.operators.render import bookings_to_text
from roomledger.operators.vectors import embed
from roomledger.plans.cleaning import question_view
from roomledger.plans.questions import different_texts, question_prompts
from roomledger.scratch import stored
from roomledger.sources import country_dimension, read_bookings_tables

#: Padding, impossible days and bad dates put into the raw exports.
DIRT = {
    "hotel": "CASE WHEN lead_time % 19 = 0 THEN concat('  ', hotel, ' ') ELSE hotel END",
    "arrival_date_day_of_month": (
        "CASE WHEN lead_time % 61 = 0 THEN 31 ELSE arrival_date_day_of_month END"
    ),
    "reservation_status_date": (
        "CASE WHEN lead_time % 53 = 0 THEN 'not-a-date' ELSE CAST(reservation_status_date AS VARCHAR(20)) END"
    ),
}

#: Which bookings each raw export holds; both hold the canceled ones.
EXPORTS = {
    1: "hotel = 'City Hotel' OR is_canceled = 1",
    2: "hotel = 'Resort Hotel' OR is_canceled = 1",
}

#: One question per row of a grouped table: (id prefix, group columns, text parts).
QUESTION_FORMS = [
    ("revenue", ["arrival_date_month", "arrival_date_year"],
     ["What was the total revenue for ", "arrival_date_month", " ", "arrival_date_year", "?"]),
    ("month", ["arrival_date_month"],
     ["What was the Total Revenue in ", "arrival_date_month", "?"]),
    ("next", ["arrival_date_year"],
     ["total revenue for jan ", "arrival_date_year", "0"]),
    ("place", ["country"],
     ["Which country besides ", "country", " had the highest booking cancellations?"]),
    ("rate", ["hotel"],
     ["What is the average ADR at the ", "hotel", "?"]),
    ("peak", ["customer_type"],
     ["Which date had the most cancellations for ", "customer_type", " guests?"]),
    ("day", ["reservation_status_date"],
     ["How many cancellations on ", "reservation_status_date", "?"]),
    ("were", ["arrival_date_year"],
     ["Were there cancellations on days of ", "arrival_date_year", "?"]),
    ("origin", ["market_segment"],
     ["From which country come the most bookings in ", "market_segment", "?"]),
    ("meal", ["hotel", "customer_type", "meal"],
     ["Tell me about ", "customer_type", " bookings with meal ", "meal", " at the ", "hotel", "."]),
]

#: What the insights read of a booking.
MEASURED = ["is_canceled", "stays_in_weekend_nights", "stays_in_week_nights", "adr", "arrival_date_year", "arrival_date_month",
            "country", "reservation_status_date"]


class Inputs:
    """Frames over one directory of test tables, built on first use."""

    def __init__(self, spark: SparkSession, directory: str) -> None:
        self.spark, self.directory = spark, directory

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory.rstrip('/')}/{name}.parquet")

    @cached_property
    def bookings(self) -> DataFrame:
        return read_bookings_tables(self.spark, self.directory)

    @cached_property
    def asked(self) -> DataFrame:
        """What insights and questions read of the bookings, joined once and stored."""
        columns = dict.fromkeys([*MEASURED, *(c for _, keys, _ in QUESTION_FORMS for c in keys)])
        return stored(read_bookings_tables(self.spark, self.directory, columns=list(columns)), "asked")

    @cached_property
    def spread(self) -> DataFrame:
        """The bookings in at least one part per core, for costly work per row."""
        cores = self.spark.sparkContext.defaultParallelism
        return read_bookings_tables(self.spark, self.directory, min_partitions=cores)

    @cached_property
    def facts(self) -> DataFrame:
        return report_frame(self.bookings)

    @cached_property
    def countries(self) -> DataFrame:
        return country_dimension(self.spark)

    @cached_property
    def exports(self) -> list[DataFrame]:
        """Both raw exports, from bookings that are joined once and stored: each is read several times."""
        bookings = stored(self.spread.drop("arrival_date"), "bookings")
        return [self.export(number, bookings) for number in EXPORTS]

    def export(self, number: int, bookings: DataFrame | None = None) -> DataFrame:
        """A raw export: the 32 raw columns, dirty, one name padded."""
        rows = (self.spread if bookings is None else bookings).where(EXPORTS[number]).drop("arrival_date")
        rows = rows.selectExpr(*[f"{DIRT.get(c, c)} AS {c}" for c in rows.columns])
        return rows.withColumnRenamed("meal", " meal ")

    @cached_property
    def texts(self) -> DataFrame:
        """Every booking as text, keyed by the digest of the text."""
        text = bookings_to_text(question_view(self.spread), self.countries).select("text")
        return text.select(F.md5("text").alias("doc_id"), "text")

    @cached_property
    def questions(self) -> DataFrame:
        """Questions about the bookings, and every user turn of the conversations."""
        turns = self.table("conversations").where(F.col("role") == "user")
        asked = turns.select(F.concat_ws("/", F.lit("chat"), "conv_id", "turn").alias("q_id"),
                             F.col("text").alias("question"))
        for prefix, keys, parts in QUESTION_FORMS:
            asked = asked.unionByName(self.question_form(prefix, keys, parts))
        return stored(asked, "questions")

    @cached_property
    def question_groups(self) -> DataFrame:
        """The groups of all question forms, from one pass over the bookings: ``(form_keys, keys)``."""
        sets = list(dict.fromkeys(tuple(keys) for _, keys, _ in QUESTION_FORMS))
        columns = list(dict.fromkeys(c for keys in sets for c in keys))
        bits = {sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in keys): "/".join(keys) for keys in sets}
        form_keys = F.coalesce(*[F.when(F.grouping_id() == b, name) for b, name in bits.items()])
        groups = self.asked.groupingSets([[F.col(c) for c in keys] for keys in sets], *columns)
        return stored(groups.agg(form_keys.alias("form_keys")), "question-groups")

    def question_form(self, prefix: str, keys: list[str], parts: list[str]) -> DataFrame:
        groups = self.question_groups.where(F.col("form_keys") == "/".join(keys)).select(*keys).dropna()
        text = F.concat(*[F.col(p).cast("string") if p in keys else F.lit(p) for p in parts])
        return groups.select(F.concat_ws("/", F.lit(prefix), *keys).alias("q_id"), text.alias("question"))

    @cached_property
    def prompts(self) -> DataFrame:
        """Prompts for every question that is left for retrieval, over all bookings as texts."""
        texts = stored(different_texts(self.texts), "texts")
        corpus = stored(embed(texts).withColumnRenamed("doc_id", "vec_id"), "vectors")
        return question_prompts(self.questions, corpus, texts)
