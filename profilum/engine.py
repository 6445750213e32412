"""One object over a set of tables, for callers that ask about single customers or questions.

Every method takes one value or a table of them and returns a DataFrame. Methods that need a table more
than once (questions, prompts, presets, comparisons) write it to the shared folder when called; the others
are lazy.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilum.fixed_values import SIMILARITY_THRESHOLD
from profilum.functions.embedders import Embedder, hashing_embedder
from profilum.operators import customers, embedding, retrieval, rollups, search, sentiment
from profilum.operators.profile import customer_profile
from profilum.sources.model import Tables
from profilum.sources.store import write_version


@dataclass
class Engine:
    """``tickets`` and ``products`` are document tables with vectors of ``embedder``."""

    tables: Tables
    as_of: str
    tickets: DataFrame
    products: DataFrame
    interactions: DataFrame | None = None
    policy: str = "simple"
    embedder: Embedder = field(default_factory=hashing_embedder)
    threshold: float = SIMILARITY_THRESHOLD

    @property
    def spark(self):
        return self.tickets.sparkSession

    def profiles(self, emails: DataFrame | str | None = None) -> DataFrame:
        """Profiles of all customers, or of the given addresses only."""
        only = None if emails is None else self._table(emails, "email")
        return customer_profile(self.tables, self.as_of, self.policy, only)

    def _table(self, value: DataFrame | str, column: str) -> DataFrame:
        return self.spark.createDataFrame([(value,)], f"{column} string") if isinstance(value, str) else value

    def _asked(self, emails: DataFrame | str) -> DataFrame:
        return self._table(emails, "email").select(F.col("email").alias("query_id"), "email")

    def top_customers(self, limit: int = 100) -> DataFrame:
        return customers.top_customers(self.profiles(), limit)

    def similar_customers(self, emails: DataFrame | str, limit: int = 5) -> DataFrame:
        return customers.similar_customers(self._asked(emails), self.profiles(), limit)

    def suggestions(self, emails: DataFrame | str) -> DataFrame:
        """Similar customers for the addresses that are unknown."""
        return customers.lookup_suggestions(self._asked(emails), self.profiles())

    def customer_context(self, emails: DataFrame | str) -> DataFrame:
        return customers.customer_lookup(self._asked(emails), self.profiles(emails))

    def questions(self, texts: DataFrame | str, email: str | None = None) -> DataFrame:
        """Questions with vectors and intents, written once. A table has ``query_id``, ``query_text`` and
        ``customer_email``."""
        if isinstance(texts, str):
            texts = self.spark.createDataFrame([("1", texts, email)], "query_id string, query_text string, customer_email string")
        known = self.tables.customers.filter(F.col("email").isNotNull()).select("email")
        return write_version(retrieval.query_intents(embedding.embed_queries(texts, self.embedder), known), "questions")

    def search_tickets(self, texts: DataFrame | str, email: str | None = None, k: int = 5) -> DataFrame:
        asked = self.questions(texts, email)
        anyone = search.search_tickets(asked.filter(F.col("customer_email").isNull()), self.tickets, k)
        return anyone.unionByName(search.search_customer_tickets(asked, self.tickets, k))

    def search_products(self, texts: DataFrame | str, k: int = 5) -> DataFrame:
        return search.search_products(self.questions(texts), self.products, k)

    def prompts(self, texts: DataFrame | str, email: str | None = None, budgeted: bool = False) -> tuple[DataFrame, DataFrame]:
        """Prompts to send to an answer model, and the numbered sources they quote."""
        asked = self.questions(texts, email)
        sources = write_version(retrieval.retrieve_context(asked, self.tickets, self.products, self.threshold), "sources")
        profile = self.profiles(asked.filter(F.col("customer_email").isNotNull()).select(F.col("customer_email").alias("email")))
        build = retrieval.build_prompts_budgeted if budgeted else retrieval.build_prompts
        return build(asked, profile, sources), sources

    def citations(self, answers: DataFrame, sources: DataFrame) -> DataFrame:
        """Sources cited by answers; ``answers`` has ``answer_id``, ``query_id`` and ``answer_text``."""
        return retrieval.extract_citations(answers, sources)

    def responses(self, answers: DataFrame, texts: DataFrame | str, email: str | None = None, include_context: bool = True) -> DataFrame:
        """The whole record of each answer to the questions: citations, metadata and a summary of the customer.

        ``answers`` is what :func:`retrieval.response_records` takes; a single question has the id ``1``.
        """
        asked = self.questions(texts, email)
        sources = write_version(retrieval.retrieve_context(asked, self.tickets, self.products, self.threshold), "sources")
        profile = self.profiles(asked.filter(F.col("customer_email").isNotNull()).select(F.col("customer_email").alias("email")))
        return retrieval.response_records(answers, asked, profile, sources, include_context)

    def embedding_job(self, root: str, key: str, model: str, limit: int | None = None, mode: str = "backlog") -> DataFrame:
        """Embed the current version of the table stored under ``root``, commit it and report its coverage."""
        return embedding.embedding_job(self.spark, root, key, self.embedder, model, f"{self.as_of} 00:00:00", mode, limit)

    def embedding_stats(self) -> DataFrame:
        return rollups.embedding_stats({"support_tickets": self.tickets, "product_catalog": self.products})

    def ticket_index(self, lists: int | None = None) -> search.ListIndex:
        return search.build_index(self.tickets, "ticket_id", lists)

    def preset_prompts(self, emails: DataFrame | str | None = None, presets: list[str] | None = None, context: str = "", count: int = 5) -> DataFrame:
        """Preset questions, all of them by default, for every customer or for the given addresses."""
        asked = retrieval.preset_questions(self.spark, context, count).withColumn("query_id", F.col("preset"))
        vectors = write_version(embedding.embed_queries(asked, self.embedder).select("preset", "query_vector"), "presets")
        profile = write_version(self.profiles(emails).select(*retrieval.PROFILE_COLUMNS), "profiles")
        return retrieval.preset_prompts(vectors, profile, self.tickets, self.products, self.threshold, presets, context, count)

    def analyze_churn_risk(self, emails: DataFrame | str) -> DataFrame:
        return self.preset_prompts(emails, ["churn_risk"])

    def recommend_products(self, emails: DataFrame | str, context: str = "", count: int = 5) -> DataFrame:
        return self.preset_prompts(emails, ["recommend_products"], context, count)

    def summarize_support_history(self, emails: DataFrame | str) -> DataFrame:
        return self.preset_prompts(emails, ["support_history"])

    def customer_summary(self, emails: DataFrame | str) -> DataFrame:
        return self.preset_prompts(emails, ["executive_summary"])

    def compare_prompts(self, first: str, second: str) -> DataFrame:
        """The prompt that compares two customers; no row if one of them is unknown."""
        pair, profile = self._pair(first, second)
        asked = retrieval.compare_questions(pair, profile).withColumn("query_id", F.lit("1"))
        questions = write_version(embedding.embed_queries(asked, self.embedder), "questions")
        sources = retrieval.retrieve_context(questions, self.tickets, self.products, self.threshold)
        return retrieval.compare_prompts(questions, profile, sources)

    def _pair(self, first: str, second: str) -> tuple[DataFrame, DataFrame]:
        """The ids of two addresses as one row, and both profiles."""
        pair = self.spark.createDataFrame([(first, second)], "a string, b string")
        emails = pair.select(F.explode(F.array("a", "b")).alias("email"))
        profile = write_version(self.profiles(emails), "pair")
        ids = profile.select(F.lower("email").alias("address"), "customer_id")
        pairs = (
            pair.join(ids.select(F.col("address").alias("left_address"), F.col("customer_id").alias("left_id")), F.lower("a") == F.col("left_address"))
            .join(ids.select(F.col("address").alias("right_address"), F.col("customer_id").alias("right_id")), F.lower("b") == F.col("right_address"))
            .select("left_id", "right_id")
        )
        return pairs, profile

    def compare(self, first: str, second: str) -> DataFrame:
        """Two customers side by side."""
        return customers.compare_customers(*self._pair(first, second))

    def _interactions(self, customer_id=None) -> DataFrame:
        return self.interactions if customer_id is None else self.interactions.filter(F.col("customer_id") == customer_id)

    def sentiment(self, customer_id=None) -> DataFrame:
        """Latest sentiment and trend per customer."""
        return sentiment.sentiment_trend(sentiment.daily_sentiment(self._interactions(customer_id), self.as_of), self.as_of)

    def analyst_prompts(self, questions: DataFrame) -> DataFrame:
        """Prompts about the interactions of customers; ``questions`` has ``query_id``, ``query_text`` and
        ``customer_id``."""
        return sentiment.analyst_prompts(questions, self.interaction_context())

    def interaction_context(self, customer_id=None) -> DataFrame:
        """The sentiment summary and newest interactions of each customer as one text."""
        return sentiment.context_blocks(sentiment.combined_context(self._interactions(customer_id), self.as_of))
