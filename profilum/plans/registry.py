"""Every named query: a callable from a session and a table folder to a DataFrame.

Array columns leave as joined texts and similarities with six digits, so that results of different
engines compare by value.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from profilum import schemas
from profilum.fixed_values import PRESET_QUESTIONS, PRODUCT_LISTS, TICKET_LISTS
from profilum.functions import policies, scoring
from profilum.functions.embedders import HASHING_MODEL, hashing_embedder
from profilum.operators import customers as people
from profilum.operators import documents as corpus
from profilum.operators import embedding, kept, metrics, retrieval, rollups, search, sentiment, sessions
from profilum.operators.profile import customer_profile
from profilum.session import fresh_path, steady_unions
from profilum.sources import checked, files, landing, model, store
from profilum.sources.buckets import BucketTable
from profilum.streaming import current, upkeep

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
DIMENSION = 64


def query(function: Query) -> Query:
    @wraps(function)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        steady_unions(spark)
        return function(spark, folder)

    QUERIES[function.__name__] = run
    return run


def _joined(column: str) -> Column:
    return F.array_join(column, ", ").alias(column)


def _score() -> Column:
    return F.round("similarity_score", 6).alias("similarity_score")


def _profile(spark: SparkSession, folder: str, policy: str = "simple") -> DataFrame:
    return customer_profile(model.tables(spark, folder), model.AS_OF, policy)


# Profile and its metrics


@query
def customer_360(spark, folder):
    return _profile(spark, folder).withColumns({"visited_pages": F.array_join("visited_pages", ", "), "purchased_product_ids": F.array_join("purchased_product_ids", ", ")})


@query
def purchase_metrics_incremental(spark, folder):
    """Order metrics out of kept partials, after two landings of which the second repeats the first."""
    orders = model.orders(spark, folder)
    root = fresh_path(spark, "partials")
    table = BucketTable.create(orders.filter(F.pmod(F.xxhash64("order_id"), F.lit(3)) > 0), fresh_path(spark, "facts"), "order_id")
    kept.refresh(table, root, kept.purchases())
    return kept.purchase_metrics(kept.refresh(table.insert_missing(orders), root, kept.purchases()))


def _rich(spark, folder, policy):
    lists = {name: F.array_join(name, ", ") for name in ("visited_pages", "acquisition_sources", "purchased_product_ids")}
    return _profile(spark, folder, policy).withColumns(lists)


@query
def customer_360_rfm(spark, folder):
    return _rich(spark, folder, "rfm_and")


@query
def customer_360_rfm_or(spark, folder):
    return _rich(spark, folder, "rfm_or")


@query
def purchase_metrics(spark, folder):
    return metrics.purchase_metrics(model.orders(spark, folder))


@query
def support_metrics(spark, folder):
    return metrics.support_metrics(model.tickets(spark, folder))


@query
def web_metrics(spark, folder):
    return metrics.web_metrics(model.events(spark, folder)).withColumn("visited_pages", F.array_join("visited_pages", ", "))


@query
def ticket_status_counts(spark, folder):
    return metrics.ticket_status_counts(model.tickets(spark, folder))


@query
def resolution_hours(spark, folder):
    return metrics.resolution_hours(model.tickets(spark, folder))


@query
def ticket_tag_counts(spark, folder):
    return metrics.ticket_tag_counts(model.tickets(spark, folder))


@query
def recent_pages(spark, folder):
    return metrics.visited_pages(model.events(spark, folder), by="recent").select("user_id", _joined("visited_pages"))


@query
def preferred_payment_methods(spark, folder):
    return metrics.preferred_payment_methods(model.orders(spark, folder))


@query
def acquisition_sources(spark, folder):
    return metrics.acquisition_sources(model.events(spark, folder)).select("user_id", _joined("acquisition_sources"))


@query
def orders_left_grouped(spark, folder):
    return metrics.orders_left_grouped(model.customers(spark, folder), model.orders(spark, folder))


@query
def recent_orders(spark, folder):
    rows = metrics.recent_rows(model.orders(spark, folder), "customer_id", "order_date", "order_id", 3)
    return model.with_items(spark, folder, rows).select("customer_id", "rank", "order_id", "order_date", F.col("total_amount").cast("double").alias("total_amount"), "status", "num_items")


@query
def recent_tickets(spark, folder):
    rows = metrics.recent_rows(model.tickets(spark, folder), "customer_id", "created_at", "ticket_id", 3)
    return rows.select("customer_id", "rank", "ticket_id", "created_at", "subject", "status", "priority", "satisfaction_rating")


# Roll-ups


@query
def churn_risk_summary(spark, folder):
    return rollups.churn_risk_summary(_profile(spark, folder))


@query
def customer_segments(spark, folder):
    return rollups.customer_segments(_profile(spark, folder))


@query
def view_health_check(spark, folder):
    return rollups.view_health_check(_profile(spark, folder))


@query
def dataset_summary(spark, folder):
    return rollups.dataset_summary({
        "customers": model.customers(spark, folder),
        "products": model.products(spark, folder),
        "orders": model.orders(spark, folder),
        "tickets": model.tickets(spark, folder),
        "events": model.events(spark, folder),
    })


@query
def kpi_tiles(spark, folder):
    return rollups.kpi_tiles(_profile(spark, folder))


@query
def daily_trends(spark, folder):
    return rollups.daily_trends(_profile(spark, folder), "1995-01-01", model.AS_OF)


@query
def customer_timeline(spark, folder):
    return rollups.customer_timeline(model.customers(spark, folder), model.orders(spark, folder), model.tickets(spark, folder), "2001-07-20")


@query
def embedding_stats(spark, folder):
    return rollups.embedding_stats({"support_tickets": model.tickets_embedded(spark, folder), "product_catalog": model.products_embedded(spark, folder)})


@query
def embedding_dim_audit(spark, folder):
    return rollups.embedding_dim_audit({"support_tickets": model.tickets_embedded(spark, folder), "product_catalog": model.products_embedded(spark, folder)}, DIMENSION)


# Segments, risk and scores


@query
def segments_rfm(spark, folder):
    return _profile(spark, folder, "rfm_and").select("customer_id", "total_orders", "lifetime_value", "customer_segment")


@query
def churn_policies(spark, folder):
    days, tickets = F.col("days_since_last_purchase"), F.col("open_tickets")
    risks = [policies.churn(policy, days, tickets).alias(policy) for policy in policies.POLICIES]
    return _profile(spark, folder).select("customer_id", "days_since_last_purchase", "open_tickets", *risks)


@query
def health_score_mean(spark, folder):
    return _profile(spark, folder).select("customer_id", scoring.health_mean().alias("health_score"))


@query
def health_score_detailed(spark, folder):
    scored = _profile(spark, folder).select("customer_id", *[column.alias(name) for name, column in scoring.health_detailed().items()])
    return scored.withColumns({name: F.array_join(name, ", ") for name in ("risk_factors", "positive_factors")})


@query
def health_score_deduction(spark, folder):
    return _profile(spark, folder).select("customer_id", scoring.health_deduction().alias("health_score"))


@query
def churn_probability(spark, folder):
    return _profile(spark, folder).select("customer_id", scoring.churn_probability().alias("churn_probability"))


# Listings, lookups and comparisons


@query
def customer_lookup(spark, folder):
    asked = model.user_queries(spark, folder, vectors=False).select("query_id", F.upper("customer_email").alias("email")).filter(F.col("email").isNotNull())
    profile = customer_profile(model.tables(spark, folder), model.AS_OF, only=asked)
    found = people.customer_lookup(asked, profile)
    return found.select("query_id", "requested_email", "customer_id", "name", "customer_segment", "churn_risk", "lifetime_value", "total_orders", "open_tickets")


@query
def similar_customers(spark, folder):
    typo = F.concat(F.substring("customer_email", 1, 16), F.lit("@example.com"))
    asked = model.user_queries(spark, folder, vectors=False).filter(F.col("customer_email").isNotNull()).select("query_id", typo.alias("email"))
    return people.similar_customers(asked, _profile(spark, folder))


@query
def lookup_suggestions(spark, folder):
    typo = F.concat(F.substring("customer_email", 1, 16), F.lit("@example.com"))
    asked = model.user_queries(spark, folder, vectors=False).filter(F.col("customer_email").isNotNull())
    half = asked.select("query_id", F.when(F.col("turn") == 0, typo).otherwise(F.col("customer_email")).alias("email"))
    return people.lookup_suggestions(half, _profile(spark, folder))


@query
def top_customers(spark, folder):
    return people.top_customers(_profile(spark, folder))


@query
def high_risk_customers(spark, folder):
    return people.high_risk_customers(_profile(spark, folder))


@query
def leaderboard(spark, folder):
    return people.leaderboard(_profile(spark, folder))


@query
def ltv_percentile(spark, folder):
    return people.value_percentile(_profile(spark, folder))


@query
def compare_customers(spark, folder):
    pairs = model.customers(spark, folder).select(F.col("customer_id").alias("left_id"), (F.col("customer_id") + 1).alias("right_id"))
    return people.compare_customers(pairs, _profile(spark, folder))


@query
def normalize_segments(spark, folder):
    profile = _profile(spark, folder)
    variant = F.col("customer_id") % 4

    def spelled(column: str) -> Column:
        upper = F.upper(F.replace(F.col(column), F.lit(" "), F.lit("_")))
        return F.when(variant == 0, F.col(column)).when(variant == 1, upper).when(variant == 2, F.lower(F.split(F.col(column), " ")[0])).otherwise("unheard of")

    raw = profile.select("customer_id", spelled("customer_segment").alias("raw_segment"), spelled("churn_risk").alias("raw_risk"))
    return raw.withColumns({"segment": people.normalize_segment(F.col("raw_segment")), "churn_risk": people.normalize_churn(F.col("raw_risk"))})


@query
def recency_buckets(spark, folder):
    return people.recency_buckets(_profile(spark, folder), f"{model.AS_OF} 12:00:00")


# Sources and the document store


@query
def ingest_orders_typed(spark, folder):
    out = fresh_path(spark, "orders-csv")
    written = model.with_items(spark, folder, model.orders(spark, folder)).select(
        "order_id", "customer_id", "customer_email", "order_date", "status", F.col("total_amount").cast("double").alias("total_amount"),
        "num_items", F.lit(None).cast("string").alias("shipping_address"), "payment_method",
    )
    files.write_csv(written, out)
    schema = schemas.ORDERS.replace("order_date timestamp", "order_date timestamp_ntz")
    return files.read_csv(spark, out, schema)


@query
def partition_pruned_tickets(spark, folder):
    path = fresh_path(spark, "tickets")
    store.write_partitioned(model.tickets_embedded(spark, folder), path)
    stored = spark.read.parquet(path).filter(F.col("created_date").between(F.lit("2001-02-01").cast("date"), F.lit("2001-03-31").cast("date")))
    return stored.groupBy("created_date", "status").agg(F.count("*").alias("tickets"), F.count("embedding").alias("embedded"), F.sum(F.length("full_text")).alias("chars"))


@query
def clustered_ticket_lookup(spark, folder):
    """Tickets of the address that has most of them, read from the clustered table."""
    path = fresh_path(spark, "tickets")
    store.write_clustered(model.tickets_embedded(spark, folder), path, "ticket_id")
    stored = spark.read.parquet(path)
    busiest = stored.filter(F.col("customer_email").isNotNull()).groupBy("customer_email").count().orderBy(F.desc("count"), "customer_email").first()
    wanted = F.col("customer_email") == (busiest.customer_email if busiest else None)
    return stored.filter(wanted).select("ticket_id", "customer_email", "status", "created_date", F.length("full_text").alias("chars"))


@query
def merge_insert_new_tickets(spark, folder):
    source = model.tickets_embedded(spark, folder).drop("embedding").withColumn("origin", F.lit("arrived"))
    labelled = model.read_table(spark, folder, "labels").select(F.col("doc_id").alias("ticket_id"))
    known = source.join(labelled, "ticket_id", "left_semi").withColumns({"status": F.lit("archived"), "origin": F.lit("known")})
    table = BucketTable.create(known, fresh_path(spark, "tickets"), "ticket_id").insert_missing(source)
    return table.rows().select("ticket_id", "customer_email", "status", "origin", F.length("full_text").alias("chars"))


@query
def merge_insert_new_products(spark, folder):
    source = model.products_embedded(spark, folder)
    known = source.filter(F.col("embedding").isNotNull()).drop("embedding").withColumn("category", F.lit("kept"))
    return store.merge_insert(known, source.drop("embedding"), "product_id").select("product_id", "product_name", "category", "price", "full_text")


@query
def merge_update_embeddings(spark, folder):
    vectors = model.read_table(spark, folder, "embeddings").select((F.col("vec_id") * 2).alias("ticket_id"), "embedding")
    stamp = F.lit("2001-08-02 00:00:00").cast("timestamp_ntz")
    current = vectors.withColumns({"embedding_model": F.lit("second"), "embedded_at": stamp})
    older = vectors.select("ticket_id", F.reverse("embedding").alias("embedding")).withColumns({"embedding_model": F.lit("first"), "embedded_at": stamp - F.expr("INTERVAL 1 DAY")})
    empty = {"embedding_model": F.lit(None).cast("string"), "embedded_at": F.lit(None).cast("timestamp_ntz")}
    table = BucketTable.create(model.tickets_embedded(spark, folder).withColumns(empty), fresh_path(spark, "tickets"), "ticket_id")
    merged = table.update(current.unionByName(older), ["embedding", "embedding_model", "embedded_at"], [F.col("embedded_at").desc()])
    first = F.try_element_at("embedding", F.lit(1)).cast("double")
    return merged.rows().select("ticket_id", F.round(first, 6).alias("first_component"), "embedding_model", "embedded_at")


@query
def incremental_load(spark, folder):
    tickets = model.tickets(spark, folder).select("ticket_id", "customer_email", "status", "created_at")
    labels = model.read_table(spark, folder, "labels").select(F.col("doc_id").alias("ticket_id"), "toxic")
    earlier = tickets.join(labels.filter(F.col("toxic") == 0), "ticket_id", "left_semi").withColumn("landing", F.lit("first"))
    later = tickets.join(labels, "ticket_id", "left_semi").withColumn("landing", F.lit("second"))
    everything = tickets.withColumn("landing", F.lit("third"))
    empty = spark.createDataFrame([], everything.schema)
    return landing.incremental_load(empty, [earlier, later, everything], "ticket_id")


@query
def embedding_backlog(spark, folder):
    waiting = embedding.embedding_backlog(model.tickets_embedded(spark, folder))
    return waiting.select(F.col("ticket_id").alias("doc_id"), F.col("full_text").alias("content"))


def _vector_figures(table: DataFrame, key: str) -> DataFrame:
    vector = F.col("embedding")
    absolute = F.aggregate(vector, F.lit(0.0), lambda total, x: total + F.abs(x))
    signed = F.aggregate(vector, F.lit(0.0), lambda total, x: total + x)
    return table.select(
        key, F.size(F.filter(vector, lambda x: x != 0)).alias("slots"), F.round(absolute, 6).alias("absolute_sum"), F.round(signed, 6).alias("signed_sum"), "embedding_model"
    )


@query
def embedding_backfill(spark, folder):
    run = embedding.embed_table(model.tickets_embedded(spark, folder), "ticket_id", hashing_embedder(DIMENSION), HASHING_MODEL, f"{model.AS_OF} 00:00:00")
    return _vector_figures(run.table, "ticket_id")


@query
def embedding_job(spark, folder):
    """Coverage of a stored table as loaded, after a run over its backlog, and after a second run that finds nothing new."""
    root = fresh_path(spark, "ticket-table")
    store.commit(model.tickets_embedded(spark, folder), root)
    for _ in range(2):
        embedding.embedding_job(spark, root, "ticket_id", hashing_embedder(DIMENSION), HASHING_MODEL, f"{model.AS_OF} 00:00:00")
    versions = [store.version(spark, root, number).select(F.lit(number).alias("number"), "embedding") for number in (1, 2, 3)]
    together = versions[0].select("number", F.col("embedding").isNotNull().alias("done"))
    for stored in versions[1:]:
        together = together.unionByName(stored.select("number", F.col("embedding").isNotNull().alias("done")))
    return together.groupBy("number").agg(F.count("*").alias("total_rows"), F.count_if("done").alias("rows_with_embeddings"))


@query
def product_table(spark, folder):
    """The product documents, written as a table and read again."""
    root = fresh_path(spark, "product-table")
    store.commit(model.products_embedded(spark, folder), root)
    stored = store.current(spark, root)
    return stored.select("product_id", "product_name", "category", "price", "full_text", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dimension"))


@query
def reembed_full(spark, folder):
    run = embedding.embed_table(model.tickets_embedded(spark, folder), "ticket_id", hashing_embedder(DIMENSION), HASHING_MODEL, f"{model.AS_OF} 00:00:00", mode="full")
    return _vector_figures(run.table, "ticket_id")


# Documents


@query
def ticket_documents(spark, folder):
    return model.tickets_embedded(spark, folder).select("ticket_id", "full_text")


@query
def product_documents(spark, folder):
    return model.products_embedded(spark, folder).select("product_id", "full_text")


@query
def interaction_documents(spark, folder):
    return sentiment.interaction_documents(model.interactions(spark, folder)).select("interaction_id", "customer_id", "content")


@query
def chunk_documents(spark, folder):
    return corpus.chunk_documents(model.documents(spark, folder), max_tokens=256, overlap=32)


@query
def sanitize_corpus(spark, folder):
    return corpus.sanitize_corpus(model.documents(spark, folder)).select("doc_id", "clean_text")


@query
def document_keywords(spark, folder):
    return corpus.document_keywords(model.documents(spark, folder))


@query
def token_budget(spark, folder):
    return corpus.token_budget(model.documents(spark, folder))


@query
def email_quality(spark, folder):
    return corpus.email_quality(model.customers(spark, folder))


@query
def constraint_violations(spark, folder):
    profile = _profile(spark, folder)
    detailed = profile.select(*[column.alias(name) for name, column in scoring.health_detailed().items()])
    hits = search.top_k(model.user_queries(spark, folder), model.tickets_embedded(spark, folder), "ticket_id")
    return (
        corpus.constraint_violations(profile, corpus.PROFILE_RULES)
        .unionByName(corpus.constraint_violations(detailed, corpus.SCORE_RULES))
        .unionByName(corpus.constraint_violations(hits, corpus.HIT_RULES))
    )


LOAD_RULES = {"amount >= 0": "total_amount >= 0", "customer known": "customer_id IS NOT NULL", "dated": "order_date < DATE '2001-06-01'"}


def _checked_orders(spark, folder) -> checked.Load:
    """Orders of which some are spoiled: every seventh amount is negative, every eleventh customer is missing."""
    amount, customer = F.col("total_amount"), F.col("customer_id")
    spoiled = model.orders(spark, folder).withColumns({
        "total_amount": F.when(F.col("order_id") % 7 == 0, -1 - amount).otherwise(amount), "customer_id": F.when(F.col("order_id") % 11 != 0, customer),
    })
    return checked.checked_load(spoiled, fresh_path(spark, "checked"), LOAD_RULES, bound=0.5)


@query
def checked_load(spark, folder):
    """Accepted and refused rows of a load, the latter with the rules they break."""
    load = _checked_orders(spark, folder)
    columns = ["order_id", "customer_id", F.col("total_amount").cast("double").alias("total_amount")]
    refused = load.refused(spark).select(*columns, F.array_join(checked.BROKEN, ", ").alias("broken_rules"))
    return load.accepted(spark).select(*columns, F.lit("").alias("broken_rules")).unionByName(refused)


@query
def checked_load_report(spark, folder):
    """Counts per rule, taken while the rows were written."""
    return _checked_orders(spark, folder).report(spark)


# Sentiment


@query
def recent_interactions(spark, folder):
    return sentiment.recent_interactions(model.interactions(spark, folder), model.EVENTS_AS_OF).drop("metadata")


@query
def daily_sentiment(spark, folder):
    return sentiment.daily_sentiment(model.interactions(spark, folder), model.EVENTS_AS_OF)


@query
def sentiment_trend(spark, folder):
    return sentiment.sentiment_trend(sentiment.daily_sentiment(model.interactions(spark, folder), model.EVENTS_AS_OF), model.EVENTS_AS_OF)


@query
def customer_docs(spark, folder):
    customer = F.regexp_extract("customer_email", "customer([0-9]+)", 1).cast("bigint")
    asking = model.user_queries(spark, folder, vectors=False).filter(F.col("customer_email").isNotNull()).select(customer.alias("customer_id"))
    return sentiment.customer_docs(sentiment.interaction_documents(model.interactions(spark, folder)), asking).select("interaction_id", "customer_id", "content")


@query
def customer_docs_containing(spark, folder):
    asking = model.user_queries(spark, folder, vectors=False).filter(F.col("customer_email").isNotNull()).select(F.regexp_extract("customer_email", "customer([0-9]+)", 1).cast("bigint").alias("customer_id"))
    return sentiment.docs_containing(sentiment.interaction_documents(model.interactions(spark, folder)), asking).select("interaction_id", "wanted_id")


@query
def combined_context(spark, folder):
    return sentiment.combined_context(model.interactions(spark, folder), model.EVENTS_AS_OF)


@query
def context_blocks(spark, folder):
    return sentiment.context_blocks(sentiment.combined_context(model.interactions(spark, folder), model.EVENTS_AS_OF))


@query
def sentiment_prompts(spark, folder):
    return sentiment.sentiment_prompts(sentiment.daily_sentiment(model.interactions(spark, folder), model.EVENTS_AS_OF))


@query
def analyst_prompts(spark, folder):
    customer = F.regexp_extract("customer_email", "customer([0-9]+)", 1).cast("bigint")
    questions = model.user_queries(spark, folder, vectors=False).filter(F.col("customer_email").isNotNull()).select("query_id", "query_text", customer.alias("customer_id"))
    blocks = sentiment.context_blocks(sentiment.combined_context(model.interactions(spark, folder), model.EVENTS_AS_OF))
    return sentiment.analyst_prompts(questions, blocks)


@query
def interaction_records(spark, folder):
    customer = F.regexp_extract("customer_email", "customer([0-9]+)", 1).cast("bigint")
    asked = model.user_queries(spark, folder, vectors=False).filter(F.col("customer_email").isNotNull()).select("query_id", "query_text", customer.alias("customer_id"))
    interactions = model.interactions(spark, folder)
    trends = sentiment.sentiment_trend(sentiment.daily_sentiment(interactions, model.EVENTS_AS_OF), model.EVENTS_AS_OF)
    records = sentiment.interaction_records(model.answers(spark, folder).join(asked, "query_id"), trends, sentiment.combined_context(interactions, model.EVENTS_AS_OF))
    cited = F.array_join(F.transform("citations", lambda c: F.concat(c["source_id"].cast("string"), F.lit("="), c["doc_id"])), ", ")
    return records.select(
        "answer_id", "customer_id", "query", "final_answer", cited.alias("citations"), "sentiment_report.trend", "sentiment_report.latest_avg_sentiment",
        "metadata.sources_used", "metadata.response_time_ms", "status",
    )


@query
def sessionize(spark, folder):
    return sessions.sessionize(model.events(spark, folder))


# Search


def _hits(found: DataFrame) -> DataFrame:
    return found.select("query_id", "rank", "doc_id", "source_type", _score(), "title", "content")


@query
def ticket_search(spark, folder):
    return _hits(search.search_tickets(model.user_queries(spark, folder), model.tickets_embedded(spark, folder)))


@query
def ticket_search_customer(spark, folder):
    return _hits(search.search_customer_tickets(model.user_queries(spark, folder), model.tickets_embedded(spark, folder)))


@query
def product_search(spark, folder):
    return _hits(search.search_products(model.user_queries(spark, folder), model.products_embedded(spark, folder)))


@query
def batch_search(spark, folder):
    """Every stored vector as a query against every ticket, in split parts on both sides."""
    queries = model.read_table(spark, folder, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), F.col("vec_id").alias("exclude_id"))
    hits = search.top_k(queries, model.tickets_embedded(spark, folder), "ticket_id", k=10, broadcast_queries=0)
    return hits.select("query_id", "rank", "ticket_id", _score())


ANN_PROBES = 75


def _ticket_index(spark, folder) -> search.ListIndex:
    return search.build_index(model.tickets_embedded(spark, folder), "ticket_id", centres=model.centre_vectors(spark, folder, TICKET_LISTS))


@query
def ann_search(spark, folder):
    """Search in the nearest lists around given centres."""
    index = _ticket_index(spark, folder)
    return search.search_index(model.user_queries(spark, folder), index, probes=ANN_PROBES).select("query_id", "rank", "ticket_id", _score())


@query
def ann_recall(spark, folder):
    """Share of the exact hits that :func:`ann_search` finds, and share of the documents it looks at."""
    index, asked = _ticket_index(spark, folder), store.write_version(model.user_queries(spark, folder), "questions")
    # Opened anew, as a later run of a service would.
    index = search.open_index(index.path, index.key, index.centres)
    exact = search.top_k(asked, model.tickets_embedded(spark, folder), "ticket_id")
    shares = search.recall(exact, search.search_index(asked, index, probes=ANN_PROBES), "ticket_id")
    read = search.probed_rows(asked, index, ANN_PROBES).select(F.round(F.col("rows_probed") / F.col("rows_in_all_lists"), 6)).scalar()
    return shares.select(F.round("recall", 6).alias("recall"), "exact_hits", F.lit(TICKET_LISTS).alias("lists"), F.lit(ANN_PROBES).alias("probes"), read.alias("share_read"))


@query
def ann_search_exhaustive(spark, folder):
    index = search.build_index(model.products_embedded(spark, folder), "product_id", PRODUCT_LISTS)
    return search.search_index(model.user_queries(spark, folder), index, probes=PRODUCT_LISTS).select("query_id", "rank", "product_id", _score())


@query
def retrieval_quality(spark, folder):
    vectors = model.read_table(spark, folder, "embeddings")
    queries = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), F.col("vec_id").alias("exclude_id"))
    hits = search.top_k(queries, vectors, "vec_id")
    return search.label_agreement(hits, vectors, "vec_id")


# Retrieval


def _asked(spark, folder) -> DataFrame:
    return retrieval.query_intents(model.user_queries(spark, folder), model.customers(spark, folder).select("email"))


def _stored_questions(spark, folder) -> DataFrame:
    """Questions with their intents, written once: several searches and the prompts read them."""
    return store.write_version(_asked(spark, folder), "questions")


def _sources(spark, folder, asked: DataFrame) -> DataFrame:
    return retrieval.retrieve_context(asked, model.tickets_embedded(spark, folder), model.products_embedded(spark, folder), model.THRESHOLD)


@query
def query_intent(spark, folder):
    return _asked(spark, folder).select("query_id", "customer_known", "intent")


@query
def retrieve_context(spark, folder):
    found = _sources(spark, folder, _stored_questions(spark, folder))
    return found.select("query_id", "source_no", "source_type", "doc_id", _score(), "title", "content")


def _asking_profiles(spark, folder, asked: DataFrame) -> DataFrame:
    """The profiles of the customers that questions name."""
    only = asked.filter(F.col("customer_email").isNotNull()).select(F.col("customer_email").alias("email"))
    return customer_profile(model.tables(spark, folder), model.AS_OF, only=only)


@query
def build_prompts(spark, folder):
    asked = _stored_questions(spark, folder)
    return retrieval.build_prompts(asked, _asking_profiles(spark, folder, asked), _sources(spark, folder, asked))


@query
def build_prompts_budgeted(spark, folder):
    asked = _stored_questions(spark, folder)
    return retrieval.build_prompts_budgeted(asked, _asking_profiles(spark, folder, asked), _sources(spark, folder, asked))


@query
def extract_citations(spark, folder):
    found = retrieval.extract_citations(model.answers(spark, folder), _sources(spark, folder, _stored_questions(spark, folder)))
    return found.select("answer_id", "source_id", "doc_id", "source_type", "title", "snippet", _score())


@query
def cited_literally(spark, folder):
    return retrieval.cited_literally(model.answers(spark, folder), _sources(spark, folder, _stored_questions(spark, folder)))


@query
def response_records(spark, folder):
    asked = _stored_questions(spark, folder)
    sources = store.write_version(_sources(spark, folder, asked), "sources")
    records = retrieval.response_records(model.answers(spark, folder), asked, _asking_profiles(spark, folder, asked), sources)
    cited = F.array_join(F.transform("citations", lambda c: F.concat(c["source_id"].cast("string"), F.lit("="), c["doc_id"])), ", ")
    return records.select(
        "answer_id", "query_id", "query", "answer", cited.alias("citations"), F.col("metadata.intent").alias("intent"), F.col("metadata.num_sources").alias("num_sources"),
        "metadata.model_used", "metadata.response_time_ms", F.col("metadata.timestamp").alias("answered_at"), "metadata.error",
        "customer_context.customer_id", "customer_context.name", "customer_context.segment", "customer_context.health_score",
    )


@query
def parsed_recommendations(spark, folder):
    """Answers that hold JSON, broken JSON or none, one per part."""
    item = F.struct(F.col("p_partkey").cast("string").alias("product_id"), F.col("p_name").alias("product_name"), F.col("p_retailprice").alias("price"), F.lit("it fits").alias("reason"), F.lit("part.png").alias("image_url"))
    json = F.to_json(F.array(item, item))
    text = F.when(F.col("p_partkey") % 3 == 0, json).when(F.col("p_partkey") % 3 == 1, F.expr("left(to_json(array(struct(p_partkey))), 5)")).otherwise("None today.")
    parsed = retrieval.parse_recommendations(model.read_table(spark, folder, "part").select(F.col("p_partkey").alias("answer_id"), text.alias("answer_text")))
    first = F.get("recommendations", F.lit(0))
    return parsed.select("answer_id", "parse_failed", F.when(~F.col("parse_failed"), F.size("recommendations")).alias("recommendations"), first["product_name"].alias("product_name"), first["price"].alias("price"), first["reason"].alias("reason"), first["image_url"].alias("image_url"))


@query
def preset_prompts(spark, folder):
    """Prompts by length and digest. The n-th preset is asked with the mean of all stored vectors of label n."""
    profile = store.write_version(_profile(spark, folder).select(*retrieval.PROFILE_COLUMNS), "profiles")
    vectors = model.label_vectors(spark, folder, sorted(PRESET_QUESTIONS)).withColumnRenamed("name", "preset")
    found = retrieval.preset_prompts(vectors, profile, model.tickets_embedded(spark, folder), model.products_embedded(spark, folder), 0.15)
    return found.select("customer_id", "preset", "intent", "num_sources", F.length("prompt").alias("prompt_chars"), F.sha2("prompt", 256).alias("prompt_sha256"))


@query
def compare_prompts(spark, folder):
    """Each customer next to the one with the following id."""
    profile = store.write_version(_profile(spark, folder).select(*retrieval.PROFILE_COLUMNS), "profiles")
    pairs = profile.select(F.col("customer_id").alias("left_id"), (F.col("customer_id") + 1).alias("right_id"))
    asked = retrieval.compare_questions(pairs, profile).withColumn("query_id", F.col("left_id"))
    questions = store.write_version(model.with_stored_vector(spark, folder, asked, F.col("left_id")).drop("exclude_id"), "pairs")
    sources = retrieval.retrieve_context(questions, model.tickets_embedded(spark, folder), model.products_embedded(spark, folder), 0.0)
    return retrieval.compare_prompts(questions, profile, sources)


@query
def recommend_products(spark, folder):
    lines = model.read_table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"))
    products = model.products_embedded(spark, folder)
    # Written once: the search counts the customers before it splits them.
    vectors = store.write_version(retrieval.purchase_vectors(model.orders(spark, folder), lines, products), "purchase-vectors")
    found = retrieval.recommend_products(vectors, products)
    return found.select("customer_id", "rank", "product_id", "product_name", "description", "price", "category", F.round("relevance_score", 6).alias("relevance_score"))


# Streams


EVENT_COLUMNS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _landed_events(spark, folder) -> DataFrame:
    return upkeep.landed_files(spark, f"{folder}/events.parquet", EVENT_COLUMNS)


def _streamed(spark, name: str) -> tuple[str, str]:
    return fresh_path(spark, name), fresh_path(spark, f"{name}-progress")


@query
def stream_incremental_load(spark, folder):
    target, progress = _streamed(spark, "loaded")
    upkeep.insert_new_rows(_landed_events(spark, folder), target, progress, "event_id")
    return upkeep.inserted_rows(spark, target, EVENT_COLUMNS)


def _web_activity(spark, folder) -> str:
    target, progress = _streamed(spark, "web")
    timed = _landed_events(spark, folder).select(
        "event_id", "user_id", F.concat(F.col("user_id").cast("string"), F.lit("-"), F.to_date("ts").cast("string")).alias("session_id"),
        F.concat(F.lit("/"), F.col("event_type")).alias("page_path"), F.col("ts").alias("event_timestamp"),
    )
    upkeep.web_activity(timed, target, progress)
    return target


@query
def stream_web_metrics(spark, folder):
    """Days closed by the watermark."""
    return upkeep.daily_web_metrics(spark, _web_activity(spark, folder)).withColumn("last_visit", F.col("last_visit").cast("timestamp_ntz"))


@query
def stream_user_metrics(spark, folder):
    """Days closed by the watermark."""
    found = upkeep.user_web_metrics(spark, _web_activity(spark, folder))
    return found.withColumns({"last_visit": F.col("last_visit").cast("timestamp_ntz"), "visited_pages": F.array_join("visited_pages", ", ")})


@query
def stream_current_metrics(spark, folder):
    """All events landed so far, out of the state per user."""
    target, progress = _streamed(spark, "current")
    timed = _landed_events(spark, folder).select(
        "event_id", "user_id", F.concat(F.col("user_id").cast("string"), F.lit("-"), F.to_date("ts").cast("string")).alias("session_id"),
        F.concat(F.lit("/"), F.col("event_type")).alias("page_path"), F.col("ts").alias("event_timestamp"),
    )
    current.user_metrics(timed, target, progress)
    found = current.current_user_metrics(spark, target)
    return found.withColumns({"last_visit": F.col("last_visit").cast("timestamp_ntz"), "visited_pages": F.array_join("visited_pages", ", ")})


@query
def stream_daily_sentiment(spark, folder):
    """Days closed by the watermark."""
    target, progress = _streamed(spark, "sentiment")
    score = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("value") - 50.0) / 50.0))
    upkeep.daily_sentiment(_landed_events(spark, folder).select(F.col("user_id").alias("customer_id"), F.col("ts").alias("timestamp"), score.alias("sentiment_score")), target, progress)
    return upkeep.written(spark, target, upkeep.DAILY_SENTIMENT)


@query
def stream_sentiment_trend(spark, folder):
    """Trends over all days closed by the watermark, out of kept sums."""
    root, progress = _streamed(spark, "trends")
    score = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("value") - 50.0) / 50.0))
    rows = _landed_events(spark, folder).select(F.col("user_id").alias("customer_id"), F.col("ts").alias("timestamp"), score.alias("sentiment_score"))
    return sentiment.trend_of_sums(upkeep.sentiment_trends(rows, root, progress).rows())


@query
def stream_sessions(spark, folder):
    """Sessions closed by the watermark."""
    target, progress = _streamed(spark, "sessions")
    upkeep.sessions(_landed_events(spark, folder).select("user_id", F.col("ts").alias("event_timestamp")), target, progress)
    found = upkeep.written(spark, target, upkeep.SESSIONS)
    return found.withColumns({name: F.col(name).cast("timestamp_ntz") for name in ("session_start", "session_end")})
