"""Batches of questions: routed to an insight, or to retrieved context."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import money, plain_money, strip
from ..operators.joins import fetch_rows, lookup_insight
from ..operators.reports import top
from ..operators.vectors import Encoder, embed, hashing_encoder, knn
from ..schema import MONTHS

# ---- fixed values: patterns, answer texts and the prompt ---------------------

MONTH_YEAR_PATTERN = (
    r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?"
    r"|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\s+(\d{4})"
)
DATE_PATTERN = r"(\d{4}-\d{2}-\d{2})"

ASK_FOR_MONTH = "For revenue, please specify the full month and year (e.g., 'total revenue for July 2017')."
ASK_FOR_DATE = "Please specify the date for cancellations in YYYY-MM-DD format."
TOP_LOCATIONS = "Top 5 locations with highest booking cancellations:\n"
TOP_DATES = "Top 5 dates with the most cancellations:\n"
TOP_COUNTRIES = "Top 5 countries with the most bookings:\n"
NO_LOCATIONS = "No cancellation data by location found."
NO_DATES = "No cancellation data by date found."
NO_COUNTRIES = "Could not retrieve top booking countries."
NO_ADR = "Average ADR data not found."
NO_CONTEXT = "I couldn't find relevant information in the dataset to answer that question."
NO_GENERATION = "The LLaMA model could not generate an answer based on the provided context."
CONTEXT_SEPARATOR = "\n---\n"
PROMPT_HEAD = (
    "Use the following context extracted from hotel booking data to answer the question. "
    "Provide a concise answer based *only* on the context given. "
    "Do not add information not present in the context. "
    "If the context doesn't contain the answer, say so."
)


#: Routes in the order their rules are tried.
ROUTES = ("revenue", "cancel_location", "avg_adr", "cancel_dates", "cancel_on_date", "top_countries", "rag")


# ---- routing ------------------------------------------------------------------


def route_questions(questions: DataFrame, col: str = "question") -> DataFrame:
    """Add the ``route`` of each question and the month, year or date it names.

    The rules are tried in order on the lower-case text and the first hit wins.
    """
    text = F.lower(col)

    def has(*words: str) -> Column:
        found = text.contains(words[0])
        for word in words[1:]:
            found = found | text.contains(word)
        return found

    route = (
        F.when(has("total revenue"), "revenue")
        .when(has("highest booking cancellations") & has("location", "country"), "cancel_location")
        .when(has("average price", "average adr"), "avg_adr")
        .when(has("most cancellations") & has("date", "when"), "cancel_dates")
        .when(has("cancellations on"), "cancel_on_date")
        .when(has("most bookings") & has("country"), "top_countries")
        .otherwise("rag")
    )
    short = F.substring(F.regexp_extract(text, MONTH_YEAR_PATTERN, 1), 1, 3)
    month = F.lit(None).cast("string")
    for name in MONTHS:
        month = F.when(short == name[:3].lower(), name).otherwise(month)
    year = F.regexp_extract(text, MONTH_YEAR_PATTERN, 2).try_cast("int")
    date = F.nullif(F.regexp_extract(col, DATE_PATTERN, 1), F.lit(""))
    return questions.withColumn("route", route).withColumns(
        {
            "month": F.when(F.col("route") == "revenue", month),
            "year": F.when(F.col("route") == "revenue", year),
            "date_text": F.when(F.col("route") == "cancel_on_date", date),
        }
    )


# ---- answers from insights ------------------------------------------------------


def _revenue_answer(routed: DataFrame, insights: dict[str, DataFrame]) -> tuple[DataFrame, Column]:
    revenue = insights["revenue_insights"].select("month", "year", F.col("revenue").alias("_revenue"))
    joined = lookup_insight(routed, revenue, ["month", "year"])
    period = F.concat_ws(" ", F.col("month"), F.col("year").cast("string"))
    known = F.concat(F.lit("Total revenue for "), period, F.lit(" was "), money(F.col("_revenue")), F.lit("."))
    none = F.concat(F.lit("No revenue data found for "), period, F.lit("."))
    answer = F.when(F.col("month").isNull(), ASK_FOR_MONTH).otherwise(F.coalesce(known, none))
    return joined, answer


def _date_answer(routed: DataFrame, insights: dict[str, DataFrame]) -> tuple[DataFrame, Column]:
    dates = insights["cancellations_per_date"].select(
        F.col("date").cast("string").alias("date_text"), F.col("count").alias("_count")
    )
    joined = lookup_insight(routed, dates.where(F.col("date_text").isNotNull()), ["date_text"])
    known = F.concat(
        F.col("_count").cast("string"), F.lit(" bookings were canceled on "), F.col("date_text"), F.lit(".")
    )
    none = F.concat(F.lit("No cancellation data found for the specific date "), F.col("date_text"), F.lit("."))
    answer = F.when(F.col("date_text").isNull(), ASK_FOR_DATE).otherwise(F.coalesce(known, none))
    return joined, answer


def _top_five(table: DataFrame, label: str, count: str, unit: str, head: str, none: str) -> Column:
    """The five largest rows of a table as one text, as a scalar subquery."""
    best = top(table, count, label, 5)
    line = F.concat(
        F.lit("- "), F.coalesce(F.col(label).cast("string"), F.lit("None")),
        F.lit(": "), F.col(count).cast("string"), F.lit(f" {unit}"),
    )
    # negated count first, then the label with a missing one leading, as in ``top``
    entries = best.select(F.struct((-F.col(count)).alias("a"), F.col(label).alias("b"), line.alias("line")).alias("e"))
    lines = F.transform(F.sort_array(F.collect_list("e")), lambda e: e["line"])
    text = F.when(F.size(lines) > 0, F.concat(F.lit(head), F.array_join(lines, "\n"))).otherwise(none)
    return entries.agg(text.alias("text")).scalar()


def _average_answer(table: DataFrame) -> Column:
    """The mean daily rate as a sentence."""
    adr = plain_money(table.limit(1).select("average_adr").scalar())
    sentence = F.concat(
        F.lit("The overall average daily rate (ADR) across all bookings is approximately "), adr, F.lit(".")
    )
    return F.coalesce(sentence, F.lit(NO_ADR))


def answer_from_insights(
    questions: DataFrame, insights: dict[str, DataFrame], routes: Sequence[str] | None = None
) -> DataFrame:
    """Route the questions and answer those that an insight covers.

    Adds ``route`` and ``answer``; the answer is null on the ``rag`` route. Month
    and date lookups are equi joins, the other answers are scalar subqueries.
    With ``routes``, only these questions are kept and only their insights read.
    """
    columns, wanted = questions.columns, list(routes or ROUTES)
    routed = route_questions(questions)
    if routes is not None:
        routed = routed.where(F.col("route").isin(wanted))
    answer = F.lit(None).cast("string")
    if "revenue" in wanted:
        routed, text = _revenue_answer(routed, insights)
        answer = F.when(F.col("route") == "revenue", text).otherwise(answer)
    if "cancel_on_date" in wanted:
        routed, text = _date_answer(routed, insights)
        answer = F.when(F.col("route") == "cancel_on_date", text).otherwise(answer)
    fixed = {
        "cancel_location": lambda: _top_five(
            insights["cancellation_insights"], "location", "cancellations", "cancellations",
            TOP_LOCATIONS, NO_LOCATIONS,
        ),
        "avg_adr": lambda: _average_answer(insights["average_adr_insight"]),
        "cancel_dates": lambda: _top_five(
            insights["cancellation_by_date"], "date", "count", "cancellations", TOP_DATES, NO_DATES
        ),
        "top_countries": lambda: _top_five(
            insights["top_booking_countries"], "country", "count", "bookings", TOP_COUNTRIES, NO_COUNTRIES
        ),
    }
    for route, text in fixed.items():
        if route in wanted:
            answer = F.when(F.col("route") == route, text()).otherwise(answer)
    return routed.select(*columns, "route", answer.alias("answer"))


# ---- context, prompt, generated answer -------------------------------------------


def retrieve_context(neighbours: DataFrame, texts: DataFrame, k: int = 5) -> DataFrame:
    """Texts of the neighbours in rank order, ``k`` at most: ``(query_id, context)``.

    ``texts`` has ``(doc_id, text)`` and may have ``copies``. A text that occurs
    several times, as rows or by ``copies``, fills as many places as it occurs;
    it is gathered once with its number of copies.
    """
    if "copies" not in texts.columns:
        texts = texts.withColumn("copies", F.lit(1))
    neighbours = neighbours.groupBy("query_id", "vec_id").agg(F.min("rank").alias("rank"))
    rows = fetch_rows(neighbours, texts.select("doc_id", "text", "copies"), "doc_id")
    places = rows.groupBy("query_id", "rank").agg(F.min("text").alias("text"), F.sum("copies").alias("copies"))
    before = F.sum("copies").over(Window.partitionBy("query_id").orderBy("rank")) - F.col("copies")
    places = places.withColumn("n", F.least(F.col("copies"), k - before).cast("int")).where("n > 0")
    ordered = F.sort_array(F.collect_list(F.struct("rank", F.array_repeat("text", F.col("n")).alias("texts"))))
    joined = F.array_join(F.flatten(F.transform(ordered, lambda r: r["texts"])), CONTEXT_SEPARATOR)
    return places.groupBy("query_id").agg(joined.alias("context"))


def different_texts(texts: DataFrame) -> DataFrame:
    """One row per different text: ``(doc_id, text, copies)``.

    ``doc_id`` is the digest of the text; copies are counted before the shuffle, so
    a text that fills a third of the rows arrives as one row per task.
    """
    counted = texts.where(F.col("text").isNotNull()).groupBy("text").agg(F.count("*").alias("copies"))
    return counted.select(F.md5("text").alias("doc_id"), "text", "copies")


def build_prompts(df: DataFrame, question: str = "question", context: str = "context") -> DataFrame:
    """Add ``prompt``, or a fixed ``answer`` where there is no context."""
    found = F.coalesce(F.length(context), F.lit(0)) > 0
    prompt = F.concat(
        F.lit(PROMPT_HEAD + "\n\nContext:\n"), F.col(context),
        F.lit("\n\nQuestion: "), F.col(question), F.lit("\n\nAnswer:"),
    )
    return df.withColumns(
        {"prompt": F.when(found, prompt), "answer": F.when(~found, F.lit(NO_CONTEXT))}
    )


def extract_answer(df: DataFrame, generated: str = "generated", prompt: str = "prompt") -> DataFrame:
    """Add ``answer``: what follows the last ``Answer:``, else the text without the prompt."""
    text = F.col(generated)
    after = F.when(text.contains("Answer:"), F.substring_index(text, "Answer:", -1)).otherwise(
        F.replace(text, F.col(prompt), F.lit(""))
    )
    clean = strip(after)
    return df.withColumn("answer", F.when(F.length(clean) > 0, clean).otherwise(F.lit(NO_GENERATION)))


def question_prompts(
    questions: DataFrame,
    corpus: DataFrame,
    texts: DataFrame,
    k: int = 5,
    make_encoder: Callable[[], Encoder] = hashing_encoder,
    block: int = 4096,
) -> DataFrame:
    """Prompts for the ``rag`` questions: ``(q_id, question, context, prompt, answer)``.

    ``corpus`` has ``(vec_id, embedding)``, ``texts`` the same ids as ``doc_id``; see
    ``different_texts`` for texts that repeat. Every question that no rule answers
    comes here, whatever its form.
    """
    asked = route_questions(questions).where(F.col("route") == "rag").select("q_id", "question")
    vectors = embed(asked, "q_id", "question", make_encoder)
    near = knn(vectors, corpus, k, query_id="q_id", block=block)
    context = retrieve_context(near, texts, k).withColumnRenamed("query_id", "q_id")
    return build_prompts(asked.join(context, "q_id", "left"))


def answer_all(questions: DataFrame, insights: dict[str, DataFrame], prompts: DataFrame) -> DataFrame:
    """Every question with its route and an answer, or the prompt that asks for one.

    ``prompts`` comes from ``question_prompts``; its fixed answer stands where there is
    no context.
    """
    answered = answer_from_insights(questions, insights)
    given = prompts.select("q_id", "prompt", F.col("answer").alias("_fixed"))
    found = answered.join(given, "q_id", "left")
    return found.select(*answered.columns[:-1], F.coalesce("answer", "_fixed").alias("answer"), "prompt")
