import pytest
from conftest import values
from pyspark.sql import functions as F

from roomledger.operators.render import bookings_to_text
from roomledger.plans import questions as Q
from roomledger.sources import country_dimension

SAMPLES = {
    "What was the total revenue for July 2017?": "revenue",
    "Which country had the highest booking cancellations?": "cancel_location",
    "What is the average ADR?": "avg_adr",
    "Which date had the most cancellations?": "cancel_dates",
    "How many cancellations were on 2015-07-06?": "rag",
    "Which country made the most bookings?": "top_countries",
    "Tell me about bookings from Portugal (PRT).": "rag",
    "Were there any bookings with babies from Great Britain?": "rag",
    "What are the different meal types offered?": "rag",
    "Invalid query check?": "rag",
    "AVERAGE PRICE and total revenue": "revenue",
    "cancellations on 2016-01-01": "cancel_on_date",
}


@pytest.fixture
def insights(rows):
    dates = rows("date string, count bigint", ("2016-01-01", 7), (None, 9)).withColumn("date", F.col("date").cast("date"))
    return {
        "revenue_insights": rows("month string, year int, revenue double", ("July", 2017, 1234567.125), ("May", 2016, None)),
        "cancellation_insights": rows("location string, cancellations bigint", *[(c, n) for c, n in zip("GFEDCBA", [1, 2, 3, 4, 5, 6, 6])], (None, 6)),
        "average_adr_insight": rows("average_adr double", (1234.565,)),
        "top_booking_countries": rows("country string, count bigint", ("PRT", 3), ("ESP", 3)),
        "cancellation_by_date": dates,
        "cancellations_per_date": dates,
    }


def answers(rows, insights, *texts):
    df = Q.answer_from_insights(rows("question string", *[(t,) for t in texts]), insights)
    return {r.question: r.answer for r in df.collect()}


def test_routes_in_order(rows):
    df = Q.route_questions(rows("question string", *[(q,) for q in SAMPLES]))
    assert {r.question: r.route for r in df.collect()} == SAMPLES


def test_revenue_answers(rows, insights):
    got = answers(rows, insights, "Total revenue, jul 2017?", "total revenue in sept 2017", "total revenue of May  2016",
                  "total revenue for september 2019", "total revenue please")
    assert got["Total revenue, jul 2017?"] == "Total revenue for July 2017 was 1,234,567.12."
    assert got["total revenue in sept 2017"] == Q.ASK_FOR_MONTH  # "sep" must be followed by a space or "tember"
    assert got["total revenue of May  2016"] == "No revenue data found for May 2016."
    assert got["total revenue for september 2019"] == "No revenue data found for September 2019."
    assert got["total revenue please"] == Q.ASK_FOR_MONTH


def test_lists_dates_and_average(rows, insights):
    got = answers(rows, insights, "highest booking cancellations by country", "average price", "cancellations on 2016-01-01",
                  "cancellations on 2016-01-02", "cancellations on monday", "when were most cancellations", "country with most bookings")
    assert got["highest booking cancellations by country"] == (
        Q.TOP_LOCATIONS + "- None: 6 cancellations\n- A: 6 cancellations\n- B: 6 cancellations\n- C: 5 cancellations\n- D: 4 cancellations")
    assert got["average price"].endswith(f"approximately {1234.565:.2f}.")
    assert got["cancellations on 2016-01-01"] == "7 bookings were canceled on 2016-01-01."
    assert got["cancellations on 2016-01-02"] == "No cancellation data found for the specific date 2016-01-02."
    assert got["cancellations on monday"] == Q.ASK_FOR_DATE
    assert got["when were most cancellations"] == Q.TOP_DATES + "- None: 9 cancellations\n- 2016-01-01: 7 cancellations"
    assert got["country with most bookings"] == Q.TOP_COUNTRIES + "- ESP: 3 bookings\n- PRT: 3 bookings"


def test_empty_insights(rows, insights):
    empty = {name: df.limit(0) for name, df in insights.items()}
    got = answers(rows, empty, "highest booking cancellations by country", "average adr", "when were most cancellations", "country with most bookings")
    assert list(got.values()) == [Q.NO_LOCATIONS, Q.NO_ADR, Q.NO_DATES, Q.NO_COUNTRIES]


def test_routes_can_be_chosen(rows, insights):
    df = Q.answer_from_insights(rows("question string", *[(q,) for q in SAMPLES]), insights, ["avg_adr"])
    assert [r.route for r in df.collect()] == ["avg_adr"]


def test_context_prompt_and_answer(rows):
    near = rows("query_id string, rank int, vec_id bigint, dist2 double", ("a", 2, 5, 0.2), ("a", 1, 7, 0.1), ("a", 3, 99, 0.3))
    texts = rows("doc_id bigint, text string", (5, "five"), (7, "seven"))
    assert values(Q.retrieve_context(near, texts)) == [("a", "seven\n---\nfive")]
    assert values(Q.retrieve_context(near, texts, 1)) == [("a", "seven")]
    asked = rows("question string, context string", ("why?", "c"), ("how?", None), ("who?", ""))
    got = Q.build_prompts(asked).collect()
    assert got[0].prompt == Q.PROMPT_HEAD + "\n\nContext:\nc\n\nQuestion: why?\n\nAnswer:" and got[0].answer is None
    assert [r.answer for r in got[1:]] == [Q.NO_CONTEXT] * 2
    made = rows("generated string, prompt string", ("P Answer: x Answer:\n y \n", "P"), ("Pz ", "P"), ("P Answer: ", "P"), ("P", "P"))
    assert [r.answer for r in Q.extract_answer(made).collect()] == ["y", "z", Q.NO_GENERATION, Q.NO_GENERATION]


def test_whole_retrieval(rows):
    from roomledger.operators.vectors import embed

    texts = rows("doc_id bigint, text string", (1, "meal BB at the beach"), (2, "room with a view"), (3, "meal HB in town"))
    asked = rows("q_id string, question string", ("m", "which meal is BB"), ("t", "average adr?"))
    corpus = embed(texts).withColumnRenamed("doc_id", "vec_id")
    got = Q.question_prompts(asked, corpus, texts, k=1).collect()
    assert len(got) == 1 and got[0].q_id == "m" and got[0].context == "meal BB at the beach" and got[0].prompt.endswith("Answer:")


def test_a_context_has_at_most_k_texts(rows):
    from roomledger.operators.vectors import embed

    texts = rows("text string", *[("meal BB at the beach",)] * 30, ("meal BB in town",), ("a view",))
    asked = rows("q_id string, question string", ("m", "meal BB at the beach?"), ("t", "in town"))
    different = Q.different_texts(texts)
    assert sorted(r.copies for r in different.collect()) == [1, 1, 30]
    corpus = embed(different).withColumnRenamed("doc_id", "vec_id")
    got = {r.q_id: r.context.split(Q.CONTEXT_SEPARATOR) for r in Q.question_prompts(asked, corpus, different).collect()}
    assert got["m"] == ["meal BB at the beach"] * 5
    assert got["t"] == ["meal BB in town"] + ["meal BB at the beach"] * 4 or len(got["t"]) == 5
    # the same with repeated rows and ids on both sides
    repeated = texts.selectExpr("md5(text) AS doc_id", "text")
    vectors = embed(repeated).withColumnRenamed("doc_id", "vec_id")
    again = {r.q_id: r.context.split(Q.CONTEXT_SEPARATOR) for r in Q.question_prompts(asked, vectors, repeated).collect()}
    assert again["m"] == got["m"] and len(again["t"]) == 5


def test_text_of_a_booking(spark, rows):
    df = rows(
        "hotel string, is_canceled int, lead_time int, arrival_date_year int, arrival_date_month string, arrival_date_week_number int, "
        "arrival_date_day_of_month int, stays_in_weekend_nights int, stays_in_week_nights int, adults int, children int, babies int, meal string, "
        "country string, market_segment string, distribution_channel string, is_repeated_guest int, previous_cancellations int, "
        "previous_bookings_not_canceled int, reserved_room_type string, assigned_room_type string, booking_changes int, deposit_type string, "
        "agent int, company int, days_in_waiting_list int, customer_type string, adr double, required_car_parking_spaces int, "
        "total_of_special_requests int, reservation_status string, reservation_status_date string, total_nights int, revenue double",
        ("City Hotel", 1, 5, 2017, "July", 27, 4, 2, 1, 2, 0, None, "BB", "PRT", "Direct", "Direct", 0, 0, 3, "A", "B", 1, "No Deposit",
         9, 0, 0, "Transient", 75.5, 0, 1, "Canceled", "2017-07-01", 3, 12345678.25),
    )
    assert bookings_to_text(df, country_dimension(spark)).first().text == (
        "Hotel: City Hotel. Canceled: Yes. Lead time: 5 days. Arrival: 4-July-2017 (Week 27). Stay: 1 weeknights, 2 weekend nights. "
        "Guests: 2 adults, 0 children, unknown babies. Meal: BB. Country: Portugal. Market segment: Direct, Channel: Direct. "
        "Repeated guest: No. Previous cancellations: 0, Previous bookings not canceled: 3. Room reserved: A, Assigned: B. "
        "Booking changes: 1. Deposit type: No Deposit. Agent: 9, Company: 0. Waiting list days: 0. Customer type: Transient. "
        "ADR: 75.5. Parking spaces: 0. Special requests: 1. Reservation status: Canceled on 2017-07-01. Total nights: 3. Revenue: 12345678.25."
    )
