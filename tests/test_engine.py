"""The engine object on the smallest tables, end to end with the hashing embedder."""

import pytest
from pyspark.sql import functions as F

from profilum.engine import Engine
from profilum.functions.embedders import hashing_embedder
from profilum.operators import embedding
from profilum.session import fresh_path
from profilum.sources import model, store
from profilum.sources.store import write_version

FOLDER = "/root/testdata/sf0.001"
KNOWN = "Customer000000003@example.com"


@pytest.fixture(scope="module")
def engine(spark):
    embed = hashing_embedder(32)
    documents = [
        write_version(embedding.embed_table(table, key, embed, "hash", "2001-08-02 00:00:00", mode="full").table, "documents")
        for table, key in ((model.tickets_embedded(spark, FOLDER), "ticket_id"), (model.products_embedded(spark, FOLDER), "product_id"))
    ]
    return Engine(model.tables(spark, FOLDER), model.AS_OF, *documents, interactions=model.interactions(spark, FOLDER), embedder=embed, threshold=0.05)


def test_lookups(engine):
    assert engine.top_customers(3).count() == 3
    assert engine.customer_context(KNOWN).first().customer_id == 3
    assert engine.customer_context("nobody@example.com").first().customer_id is None
    assert engine.similar_customers("customer00000000@x").count() == 5
    assert engine.suggestions(KNOWN).count() == 0 and engine.suggestions("customer00000000@x").count() == 3
    assert engine.compare(KNOWN, "customer000000004@example.com").first().right_id == 4


def test_search_finds_the_same_text(engine):
    ticket = engine.tickets.orderBy(F.length("full_text").desc()).first()
    best = engine.search_tickets(ticket.full_text).orderBy("rank").first()
    assert best.similarity_score == pytest.approx(1.0) and best.content == ticket.full_text[:1000]
    owned = engine.search_tickets(ticket.full_text, ticket.customer_email).collect()
    assert {row.metadata["customer_email"] for row in owned} == {ticket.customer_email}


def test_question_to_citation(engine, spark):
    prompts, sources = engine.prompts("Suggest a product: red widget, small ring", KNOWN)
    text = prompts.first().prompt
    assert "CUSTOMER PROFILE" in text and "[Source 1] (Product, Relevance:" in text
    answers = spark.createDataFrame([("a", "1", "see [Source 1] and [Source 99]")], "answer_id string, query_id string, answer_text string")
    assert [row.source_id for row in engine.citations(answers, sources).collect()] == [1]


def test_empty_question_has_a_reason(engine, spark):
    asked = engine.questions(spark.createDataFrame([("q", "  ", None), ("r", None, None)], "query_id string, query_text string, customer_email string"))
    assert {(row.query_vector, row.no_vector_reason) for row in asked.collect()} == {(None, "empty text")}


def test_whole_table_calls(engine):
    assert engine.preset_prompts().count() == 4 * engine.profiles().count()
    assert engine.sentiment().count() == engine.interaction_context().count()
    assert engine.sentiment(0).count() == 1


def test_presets_of_one_customer(engine):
    """One customer's prompts are the same as its rows in the batch."""
    batch = {row.preset: row.prompt for row in engine.preset_prompts().filter(F.col("prompt").contains(KNOWN.lower())).collect()}
    single = [engine.analyze_churn_risk(KNOWN), engine.recommend_products(KNOWN), engine.summarize_support_history(KNOWN), engine.customer_summary(KNOWN)]
    rows = [row for frame in single for row in frame.collect()]
    assert len(rows) == 4 and {row.preset: row.prompt for row in rows} == batch
    gift = engine.recommend_products(KNOWN, "for a birthday gift", 3).first().prompt
    assert "Recommend 3 products" in gift and "\n- Additional context: for a birthday gift\n\nFor each" in gift
    assert engine.analyze_churn_risk("nobody@example.com").count() == 0


def test_compare_prompt_names_both(engine):
    other = engine.profiles().filter(F.col("email") != KNOWN.lower()).orderBy("customer_id").first().email
    prompt = engine.compare_prompts(KNOWN, other).first().prompt
    assert prompt.count("CUSTOMER PROFILE") == 2 and KNOWN.lower() in prompt and other in prompt
    assert engine.compare_prompts(KNOWN, "nobody@example.com").count() == 0


def test_response_records(engine, spark):
    rows = [("a", "see [Source 1] and [Source 99]", False, None), ("b", "[{}] [Source 1]", True, None), ("c", "", False, "out of time")]
    answers = spark.createDataFrame([(key, "1", text, structured, error, "m") for key, text, structured, error in rows], "answer_id string, query_id string, answer_text string, structured boolean, error string, model_used string")
    found = {row.answer_id: row for row in engine.responses(answers, "Suggest a product: red widget, small ring", KNOWN).collect()}
    assert [citation.source_id for citation in found["a"].citations] == [1] and not found["b"].citations and not found["c"].citations
    assert found["c"].answer.endswith("error: out of time") and found["c"].metadata.error == "out of time" and found["a"].metadata.model_used == "m"
    assert found["a"].customer_context.email == KNOWN.lower() and found["a"].metadata.num_sources > 0
    bare = engine.responses(answers, "Suggest a product", KNOWN, include_context=False).collect()
    assert all(row.customer_context is None for row in bare)


def test_embedding_job_goes_on_where_it_stopped(engine, spark):
    root = fresh_path(spark, "job")
    texts = [(key, "some words that are long enough" if key else "short", None) for key in range(6)]
    store.commit(spark.createDataFrame(texts, "ticket_id bigint, full_text string, embedding array<double>"), root)
    done = [engine.embedding_job(root, "ticket_id", "m", limit=2).first() for _ in range(4)]
    assert [row.rows_with_embeddings for row in done] == [2, 4, 5, 5] and [row.version for row in done] == [2, 3, 4, 5]
    assert store.version(spark, root, 1).filter("embedding IS NOT NULL").count() == 0
    assert engine.embedding_stats().count() == 2


def test_index_of_the_square_root(engine):
    index = engine.ticket_index()
    count = engine.tickets.filter(F.col("embedding").isNotNull()).count()
    assert len(index.centres) <= round(count**0.5) + 1
