"""Text operators, intents, citations and prompts."""

import datetime as dt
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from profilum.fixed_values import PRESET_QUESTIONS, STOP_WORDS, WORD_PUNCTUATION
from profilum.functions import text
from profilum.functions.chunking import chunk_bounds, chunk_sizes
from profilum.functions.columns import currency, number_text
from profilum.functions.documents import product_text
from profilum.operators import documents, retrieval, sentiment
from profilum.operators.sessions import sessionize


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .?!\n", max_size=900), st.integers(51, 90), st.integers(0, 0) | st.integers(1, 3))
def test_chunk_properties(whole, tokens, overlap):
    size, shared = 4 * tokens, 4 * overlap
    if shared and shared >= size - 200:
        return
    bounds = list(chunk_bounds(whole, size, shared))
    assert bounds[0][0] == 0 and max(end for _, end in bounds) == len(whole)
    for (start, end), (following, _) in zip(bounds, bounds[1:]):
        assert start < following <= end and (end == len(whole) or following == end - shared)
    assert all(end - start <= size for start, end in bounds)


def test_chunk_at_its_size():
    assert list(chunk_bounds("x" * 40, 40, 0)) == [(0, 40)]
    assert list(chunk_bounds("x" * 41, 40, 0)) == [(0, 40), (40, 41)]
    assert list(chunk_bounds("x" * 30 + "." + "y" * 20, 40, 0)) == [(0, 31), (31, 51)]
    with pytest.raises(ValueError):
        chunk_sizes(60, 60)


def test_sanitize(spark):
    samples = ["  a \t b  c\n", "x\x00y", "", None, "z" * 12, "\x1cq\x85"]
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string")
    found = [row[0] for row in frame.orderBy("i").select(text.sanitize(F.col("s"), 10)).collect()]

    def expected(value):
        value = " ".join((value or "").split()).replace("\x00", "")
        return (value[:10] + "..." if len(value) > 10 else value).strip()

    assert found == [expected(s) for s in samples]


def test_keywords_against_counting(spark):
    texts = ["The green, green GRASS of 'home' home. green? tree tree tall", "", "these those would", 'Échelle échelle (échelle) "naïve" naïve; zebra']
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    found = {}
    for row in documents.document_keywords(frame, limit=3).orderBy("doc_id", "rank").collect():
        found.setdefault(row.doc_id, []).append(row.keyword)
    for i, whole in enumerate(texts):
        words = [w.strip(WORD_PUNCTUATION) for w in whole.lower().split()]
        counts = Counter(w for w in words if len(w) > 3 and w not in STOP_WORDS)
        assert found.get(i, []) == [w for w, _ in counts.most_common(3)]


def test_keywords_of_single_rows_do_not_move(spark):
    """Rows whose key is there once are counted where they lie; rows of one key are counted together."""
    rows = [(1, "Beta beta gamma. (gamma) delta"), (2, "zeta zeta the with tiny"), (3, None), (4, " \n "), (5, "Éclair éclair 🙂🙂🙂🙂 -word- word's word")]
    more = [*rows, (2, "eta, theta theta zeta"), (None, "lone lone pair"), (None, "pair pair pair"), (6, "quiet")]

    def counted(some):
        found = {}
        for key, whole in some:
            for place, raw in enumerate(re.split(r"\s+", (whole or "").lower())):
                word = raw.strip(WORD_PUNCTUATION)
                if len(word) > 3 and word not in STOP_WORDS:
                    count, first = found.setdefault(key, {}).get(word, (0, place))
                    found[key][word] = (count + 1, min(first, place))
        ranked = {key: sorted(words.items(), key=lambda item: (-item[1][0], item[1][1]))[:3] for key, words in found.items()}
        return {(key, word, count, rank) for key, words in ranked.items() for rank, (word, (count, _)) in enumerate(words, 1)}

    single = documents.document_keywords(spark.createDataFrame(rows, "doc_id bigint, text string"), limit=3)
    assert "Exchange" not in single._jdf.queryExecution().executedPlan().toString()
    both = documents.document_keywords(spark.createDataFrame(more, "doc_id bigint, text string").repartition(3), limit=3)
    assert set(map(tuple, single.collect())) == counted(rows) and single.dtypes == both.dtypes
    assert set(map(tuple, both.collect())) == counted(more)


def test_token_limits(spark):
    frame = spark.createDataFrame([("x" * 8,), ("x" * 9,)], "s string")
    rows = frame.select(text.token_estimate(F.col("s")), text.truncate_to_tokens(F.col("s"), 2)).collect()
    assert [tuple(row) for row in rows] == [(2, "x" * 8), (2, "x" * 8 + "...")]


def test_email_prefix_match(spark):
    frame = spark.createDataFrame([("a@b.co", True), ("a@b.c", False), ("a@b.com and more", True), (" a@b.com", False), (None, False)], "e string, ok boolean")
    assert all(row[0] == row.ok for row in frame.select(text.valid_email(F.col("e")), "ok").collect())
    quality = documents.email_quality(frame.select(F.col("e").alias("email"), F.lit("all").alias("acquisition_channel"))).first()
    assert (quality.valid_emails, quality.invalid_emails, quality.missing_emails) == (2, 2, 1)


@pytest.mark.parametrize(
    "question, known, wanted",
    [
        ("Suggest a ticket", True, "product_recommendation"), ("Any complaint?", False, "support_history"), ("Will they LEAVE", False, "churn_analysis"),
        ("Who is this", True, "customer_info"), ("Who is this", False, "general"), ("hello", True, "general"),
    ],
)
def test_intents(spark, question, known, wanted):
    frame = spark.createDataFrame([(question, known)], "q string, k boolean")
    assert frame.select(text.intent(F.col("q"), F.col("k"))).first()[0] == wanted


def test_citations(spark):
    answers = spark.createDataFrame(
        [("a", "q", "x [Source 2] y [Source 1][Source 2] [Source 0] [Source 3] [source 1] [Source 99999999999]"), ("b", "q", "none"), ("c", "other", "[Source 1]")],
        "answer_id string, query_id string, answer_text string",
    )
    sources = spark.createDataFrame(
        [("q", n, f"d{n}", "product", None, "c" * 300, 0.5, {"k": "v"}) for n in (1, 2)],
        "query_id string, source_no int, doc_id string, source_type string, title string, content string, similarity_score double, metadata map<string,string>",
    )
    found = retrieval.extract_citations(answers, sources).orderBy("source_id").collect()
    assert [(row.answer_id, row.source_id, row.doc_id, row.title, len(row.snippet)) for row in found] == [("a", 1, "d1", "", 200), ("a", 2, "d2", "", 200)]
    literal = retrieval.cited_literally(answers, sources).select("answer_id", "source_id").collect()
    assert sorted(map(tuple, literal)) == [("a", 1), ("a", 2)]


def test_prompt_text(spark):
    profile = spark.createDataFrame(
        [(7, "Ann@x.org", None, None, "VIP", "High Risk", 1234567.891, 3, 0.5, None, 2, 1, 0.0, dt.datetime(2020, 1, 2))],
        "customer_id bigint, email string, first_name string, last_name string, customer_segment string, churn_risk string, lifetime_value double, total_orders bigint, avg_order_value double, days_since_last_purchase int, total_tickets bigint, open_tickets bigint, avg_satisfaction_score double, customer_since timestamp_ntz",
    )
    queries = spark.createDataFrame([("q", "Why?", "ann@X.org"), ("r", "How?", None)], "query_id string, query_text string, customer_email string")
    sources = spark.createDataFrame(
        [("q", 2, "product", "", "body", 0.31251, None), ("q", 1, "support_ticket", "Broken", "b" * 900, 0.987, dt.datetime(2021, 5, 6, 7, 8, 9))],
        "query_id string, source_no int, source_type string, title string, content string, similarity_score double, created_at timestamp_ntz",
    )
    prompts = {row.query_id: row for row in retrieval.build_prompts(queries, profile, sources).collect()}
    whole = prompts["q"].prompt
    assert (
        "\nCUSTOMER PROFILE:\n- Name: Unknown\n- Email: Ann@x.org\n- Customer ID: 7\n- Segment: VIP\n- Lifetime Value: $1,234,567.89\n- Total Orders: 3\n- Average Order Value: $0.50\n"
        "- Days Since Last Purchase: None\n- Total Support Tickets: 2\n- Open Support Tickets: 1\n- Satisfaction Score: N/A/5.0\n- Churn Risk: High Risk\n- Health Score: 75/100\n- Customer Since: 2020-01-02 00:00:00\n"
    ) in whole
    assert "\n[Source 1] (Support Ticket, Relevance: 98.7%)\nTitle: Broken\nDate: 2021-05-06 07:08:09\nContent: " + "b" * 800 + "\n\n[Source 2] (Product, Relevance: 31.3%)\nContent: body\n\nUSER QUERY: Why?\n" in whole
    assert "CUSTOMER PROFILE" not in prompts["r"].prompt and "HISTORICAL" not in prompts["r"].prompt and prompts["r"].num_sources == 0
    short = retrieval.build_prompts_budgeted(queries, profile, sources, max_tokens=10).filter("query_id = 'q'").first().prompt
    assert len(short) == 40
    budgeted = retrieval.build_prompts_budgeted(queries, profile, sources).filter("query_id = 'q'").first().prompt
    assert "[Source 2] (product, relevance: 31.25%)\nbody" in budgeted and "- Days Since Last Purchase: N/A" in budgeted


def test_preset_intents(spark):
    found = {row.preset: row.intent for row in retrieval.preset_questions(spark).collect()}
    assert set(found) == set(PRESET_QUESTIONS)
    assert found["executive_summary"] == "churn_analysis" and found["churn_risk"] == "product_recommendation"


def test_recommendations_from_json(spark):
    good = '[{"product_id": "p", "product_name": "n", "description": "d", "price": 1.5, "category": "c", "relevance_score": 0.5, "reason": "r"}]'
    rows = retrieval.parse_recommendations(spark.createDataFrame([(good,), ("no json",)], "answer_text string")).collect()
    assert rows[0].recommendations[0].price == 1.5 and not rows[0].parse_failed
    assert rows[1].parse_failed


def test_document_texts(spark):
    frame = spark.createDataFrame([("n", None, None, 20.0), (None, "c", "d", 1.0), ("n", "c", "d", None)], "product_name string, category string, description string, price double")
    assert [row[0] for row in frame.select(product_text()).collect()] == ["Product: n\nCategory: General\nDescription: \nPrice: $20.00", None, None]
    numbers = [0.5, -0.0009999999999999432, 1e-05, 1.5e-07, 0.0, 20.0]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double")
    assert [row[0] for row in frame.orderBy("i").select(number_text(F.col("x"))).collect()] == [str(x) for x in numbers]
    assert frame.filter("i = 5").select(currency("x")).first()[0] == "$20.00"


def test_quiet_customer_keeps_its_context(spark):
    noise = spark.range(3000).select(
        F.concat(F.lit("n"), F.col("id").cast("string")).alias("interaction_id"), F.lit("loud").alias("customer_id"),
        F.expr("timestampadd(SECOND, cast(id as int), timestamp_ntz'2024-01-30 00:00:00')").alias("timestamp"),
        F.lit("web").alias("channel"), F.lit(0.5).alias("sentiment_score"), F.lit("loud 1").alias("content"),
    )
    quiet = spark.createDataFrame([("k1", "1", dt.datetime(2024, 1, 5), "web", -0.25, "hi"), ("k0", "1", dt.datetime(2023, 10, 1), "web", 1.0, "old")], "interaction_id string, customer_id string, timestamp timestamp_ntz, channel string, sentiment_score double, content string")
    context = sentiment.combined_context(noise.unionByName(quiet), "2024-01-31")
    found = {}
    for row in context.collect():
        found.setdefault(row.customer_id, []).append((row.source_no, row.doc_id))
    assert sorted(found["1"]) == [(1, "SENTIMENT_SUMMARY"), (2, "k1")]
    assert [no for no, _ in sorted(found["loud"])] == [1, 2, 3, 4, 5, 6] and sorted(found["loud"])[1][1] == "n2999"


def test_sessions_against_a_plain_scan(spark):
    import random

    random.seed(3)
    start = dt.datetime(2024, 1, 1)
    events = [(user, start + dt.timedelta(seconds=random.choice([0, 600, 1799, 1800, 1801, 3600]) * i // 2)) for user in ("a", "b") for i in range(60)]
    events += [("edge", start), ("edge", start + dt.timedelta(minutes=30)), ("edge", start + dt.timedelta(minutes=60, microseconds=1))]
    frame = spark.createDataFrame(events, "user_id string, event_timestamp timestamp_ntz").repartition(4)
    expected = []
    for user in {user for user, _ in events}:
        times = sorted(at for name, at in events if name == user)
        groups = [[times[0]]]
        for at in times[1:]:
            if at - groups[-1][-1] > dt.timedelta(minutes=30):
                groups.append([])
            groups[-1].append(at)
        expected += [(user, number, group[0], group[-1], len(group)) for number, group in enumerate(groups, 1)]
    found = [tuple(row) for row in sessionize(frame).select("user_id", "session_no", "session_start", "session_end", "events").collect()]
    assert sorted(found) == sorted(expected)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab.?!", max_size=400), st.integers(1, 60), st.integers(0, 59))
def test_small_chunks_move_forward(whole, tokens, overlap):
    if overlap >= tokens:
        return
    size, shared = chunk_sizes(tokens, overlap)
    bounds = list(chunk_bounds(whole, size, shared))
    assert bounds[0][0] == 0 and max(end for _, end in bounds) == len(whole)
    assert all(start < following <= end for (start, end), (following, _) in zip(bounds, bounds[1:]))


def test_found_ids_leave_in_bounded_batches():
    """A batch whose texts hold every id does not come back as one batch of all pairs."""
    import pyarrow as pa

    from profilum.operators import sentiment

    ids = [str(number) for number in range(100)]
    batch = pa.RecordBatch.from_pydict({"interaction_id": list(range(300)), "content": [" ".join(ids)] * 299 + [None]})
    found = list(sentiment.containing([batch], ids))
    assert sum(part.num_rows for part in found) == 299 * 100 and max(part.num_rows for part in found) <= sentiment.HITS
    assert {(row["interaction_id"], row["wanted_id"]) for part in found for row in part.to_pylist()} == {(row, one) for row in range(299) for one in ids}


def test_embedder_forgets_rare_words(monkeypatch):
    """Places are kept for a bounded number of words, and the others get the same vector."""
    from profilum.functions import embedders

    monkeypatch.setattr(embedders, "REMEMBERED", 3)
    embed, texts = embedders.hashing_embedder(8), ["a b c d e f", "f e d c b a"]
    first, second = embed(texts)
    assert (first == second).all() and len(embed.__closure__) and max(len(cell.cell_contents) for place in embed.__closure__ if callable(place.cell_contents) and getattr(place.cell_contents, "__closure__", None) for cell in place.cell_contents.__closure__ if isinstance(cell.cell_contents, dict)) == 3
