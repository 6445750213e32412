"""The customer model over the test tables.

Every derived column is a plain expression over the parquet columns, so filters and column
pruning reach the scan. A column nobody selects costs nothing: the joins that supply it are on
unique keys and the optimizer drops them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from profilum.functions.documents import product_text, ticket_text
from profilum.functions.vectors import unit_rows

AS_OF = "2001-08-02"
EVENTS_AS_OF = "2024-01-31"
THRESHOLD = 0.3


@dataclass(frozen=True)
class Tables:
    """Source tables of the profile. ``unique_ids`` states that order, ticket and event ids are
    primary keys, which the insert-only merge of the store guarantees; distinct counts of ids are
    then plain counts and need no shuffle of their own."""

    customers: DataFrame
    orders: DataFrame
    tickets: DataFrame
    events: DataFrame
    unique_ids: bool = False


def email_of(customer: Column) -> Column:
    return F.concat(F.lit("customer"), F.lpad(customer.cast("string"), 9, "0"), F.lit("@example.com"))


_SCHEMAS: dict[tuple[str, str], StructType] = {}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder. Its schema is taken from the file once per application; later reads
    start no job of their own."""
    path = f"{folder}/{name}.parquet"
    known = (spark.sparkContext.applicationId, path)
    if known not in _SCHEMAS:
        _SCHEMAS[known] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[known]).parquet(path)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents")


def customers(spark: SparkSession, folder: str) -> DataFrame:
    customer = read_table(spark, folder, "customer")
    since = read_table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").alias("customer_since"))
    region = read_table(spark, folder, "region").select("r_regionkey", "r_name")
    nation = read_table(spark, folder, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    # Grouped, so that the key is known to be unique and an unused join can be dropped.
    channel = nation.groupBy(F.col("n_nationkey").alias("c_nationkey")).agg(F.max("r_name").alias("r_name"))
    return (
        customer.join(since, "c_custkey", "left")
        .join(channel, "c_nationkey", "left")
        .select(
            F.col("c_custkey").alias("customer_id"),
            email_of(F.col("c_custkey")).alias("email"),
            F.lit("Customer").alias("first_name"),
            F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("last_name"),
            F.lit(None).cast("string").alias("phone"),
            F.lit(None).cast("string").alias("company"),
            F.col("c_mktsegment").alias("industry"),
            "customer_since",
            F.col("r_name").alias("acquisition_channel"),
            F.lit("Active").alias("account_status"),
        )
    )


def orders(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        email_of(F.col("o_custkey")).alias("customer_email"),
        F.col("o_orderdate").alias("order_date"),
        F.col("o_orderstatus").alias("status"),
        (F.col("o_totalprice").cast("decimal(18,2)") * F.expr("0.002BD")).cast("decimal(22,5)").alias("total_amount"),
        F.col("o_orderpriority").alias("payment_method"),
    )


def with_items(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    """Orders with their number of lines. Take the orders that are needed first."""
    lines = read_table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.count("*").alias("num_items"))
    return rows.join(lines, "order_id", "left").withColumn("num_items", F.coalesce("num_items", F.lit(0)))


def tickets(spark: SparkSession, folder: str) -> DataFrame:
    doc = F.col("doc_id")
    state = F.expr("(doc_id div 11) % 3")
    priority = F.expr("doc_id % 5")
    solved = state == 2
    hours = F.when(solved, F.lit(1) + doc % 72)
    customer = F.expr("(doc_id * 7919) % (100 + 100 * (doc_id % 11))")
    created = F.expr("timestampadd(HOUR, cast(doc_id % 5000 as int), timestamp_ntz'2001-01-01 00:00:00')")
    resolved = F.expr(
        "case when (doc_id div 11) % 3 = 2 then timestampadd(HOUR, cast(doc_id % 5000 + 1 + doc_id % 72 as int), timestamp_ntz'2001-01-01 00:00:00') end"
    )
    return documents(spark, folder).select(
        doc.alias("ticket_id"),
        customer.alias("customer_id"),
        email_of(customer).alias("customer_email"),
        F.substring("text", 1, 40).alias("subject"),
        F.col("text").alias("description"),
        F.when(state == 0, "open").when(state == 1, "pending").otherwise("solved").alias("status"),
        F.when(priority < 2, "low").when(priority < 4, "medium").otherwise("high").alias("priority"),
        created.alias("created_at"),
        resolved.alias("updated_at"),
        resolved.alias("resolved_at"),
        hours.alias("resolution_time_hours"),
        F.when(solved, F.lit(1) + doc % 5).alias("satisfaction_rating"),
        F.concat_ws("|", "lang", "source").alias("tags"),
    )


def events(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "events").select(
        "event_id",
        "user_id",
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.to_date("ts").cast("string")).alias("session_id"),
        "event_type",
        F.concat(F.lit("/"), F.col("event_type")).alias("page_path"),
        F.col("ts").alias("event_timestamp"),
        F.col("event_type").alias("traffic_source"),
    )


def interactions(spark: SparkSession, folder: str) -> DataFrame:
    score = (F.col("value") - F.lit(50.0)) / F.lit(50.0)
    return read_table(spark, folder, "events").select(
        F.col("event_id").alias("interaction_id"),
        F.col("user_id").alias("customer_id"),
        F.col("ts").alias("timestamp"),
        F.col("event_type").alias("channel"),
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score)).alias("sentiment_score"),
        F.col("props").alias("content"),
        F.from_json("props", "map<string,string>").alias("metadata"),
    )


def products(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.concat("p_brand", F.lit(" "), "p_type").alias("description"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("price"),
    )


def _vectors(spark: SparkSession, folder: str, key: str) -> DataFrame:
    return read_table(spark, folder, "embeddings").select(F.col("vec_id").alias(key), "embedding")


def tickets_embedded(spark: SparkSession, folder: str) -> DataFrame:
    """Ticket documents; a document without a vector has NULL there and forms the backlog."""
    documents = tickets(spark, folder).select(
        "ticket_id", "customer_id", "customer_email", "subject", "description", "status", "priority",
        "created_at", "updated_at",
        F.col("satisfaction_rating").alias("satisfaction_score"),
        ticket_text().alias("full_text"),
    )
    return documents.join(_vectors(spark, folder, "ticket_id"), "ticket_id", "left")


def products_embedded(spark: SparkSession, folder: str) -> DataFrame:
    documents = products(spark, folder).withColumn("full_text", product_text())
    return documents.join(_vectors(spark, folder, "product_id"), "product_id", "left")


def user_queries(spark: SparkSession, folder: str, vectors: bool = True) -> DataFrame:
    """User turns as questions. A stored vector stands in for the embedder; the row it came from
    is named in ``exclude_id`` so that a search does not return it."""
    conv = F.col("conv_id")
    prefix = (
        F.when(conv % 5 == 0, "Recommend a product. ").when(conv % 5 == 1, "Open support ticket. ")
        .when(conv % 5 == 2, "Churn and retention. ").when(conv % 5 == 3, "Profile, please. ").otherwise("")
    )
    customer = F.expr("(conv_id * 7919) % (100 + 100 * (conv_id % 11))")
    turns = read_table(spark, folder, "conversations").filter(F.col("role") == "user").select(
        F.concat(conv.cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("query_id"),
        "conv_id",
        "turn",
        F.concat(prefix, F.col("text")).alias("query_text"),
        F.when(conv % 7 != 6, email_of(customer)).alias("customer_email"),
    )
    if not vectors:
        return turns
    return with_stored_vector(spark, folder, turns, conv)


def with_stored_vector(spark: SparkSession, folder: str, rows: DataFrame, number: Column) -> DataFrame:
    """Rows with the stored vector that lies at ``number`` modulo the count of vectors, and its id as ``exclude_id``."""
    stored = read_table(spark, folder, "embeddings")
    count = stored.select(F.count("*")).scalar()
    vectors = stored.select(F.col("vec_id").alias("exclude_id"), F.col("embedding").alias("query_vector"))
    return rows.withColumn("exclude_id", F.try_mod(number, count)).join(vectors, "exclude_id", "left")


def label_vectors(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """A vector for each name: the mean of all stored vectors with its number as label."""
    stored = read_table(spark, folder, "embeddings").filter(F.col("embedding").isNotNull() & F.col("label").between(0, len(names) - 1))
    means = stored.select("label", array_to_vector(F.col("embedding").cast("array<double>")).alias("vector")).groupBy("label")
    name = F.element_at(F.array(*map(F.lit, names)), F.col("label") + 1)
    return means.agg(vector_to_array(Summarizer.mean(F.col("vector"))).alias("query_vector")).select(name.alias("name"), "query_vector")


def centre_vectors(spark: SparkSession, folder: str, lists: int) -> np.ndarray:
    """Given centres for a list index: ``lists`` stored vectors at even distances, scaled to length one."""
    stored = read_table(spark, folder, "embeddings").filter(F.col("embedding").isNotNull())
    step = F.greatest(F.lit(1), F.floor(stored.select(F.count("*")).scalar() / lists))
    chosen = stored.filter(F.col("vec_id") % step == 0).orderBy("vec_id").limit(lists).select("embedding")
    return unit_rows([row.embedding for row in chosen.collect()])


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """Assistant turns with citations appended; each answers the user turn just before it. Some stand for
    structured answers and some for failed ones."""
    conv, turn = F.col("conv_id"), F.col("turn")
    cited = F.concat(
        F.col("text"), F.lit(" [Source "), (F.lit(1) + turn % 7).cast("string"), F.lit("]"),
        F.when(turn % 2 == 0, " [Source 1]").otherwise(""),
    )
    return read_table(spark, folder, "conversations").filter(F.col("role") == "assistant").select(
        F.concat(F.col("conv_id").cast("string"), F.lit("-"), (turn - 1).cast("string")).alias("query_id"),
        F.concat(F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string")).alias("answer_id"),
        cited.alias("answer_text"),
        (conv % 9 == 4).alias("structured"),
        F.when(conv % 23 == 7, "the model took too long").alias("error"),
        F.lit("answer-model").alias("model_used"),
        F.expr("timestampadd(HOUR, cast(turn as int), timestamp_ntz'2001-08-02 00:00:00')").alias("answered_at"),
        (F.lit(100) + 10 * turn).alias("response_time_ms"),
    )


def tables(spark: SparkSession, folder: str) -> Tables:
    return Tables(
        customers=customers(spark, folder),
        orders=orders(spark, folder),
        tickets=tickets(spark, folder),
        events=events(spark, folder),
    )
