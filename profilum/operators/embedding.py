"""Embedding jobs over document tables."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profilum.functions.embedders import Embedder
from profilum.operators.rollups import embedding_stats
from profilum.sources.store import commit, current, merge_update, write_version


def embed_queries(queries: DataFrame, embedder: Embedder) -> DataFrame:
    """Questions with the vector of their cleaned text. An empty question, or one the embedder
    fails on, has a NULL vector and the reason; it scores zero against everything."""
    cleaned = F.trim(F.coalesce("query_text", F.lit("")))
    done = embed_texts(queries.select("query_id", cleaned.alias("query_text")).filter(F.col("query_text") != ""), "query_id", embedder, "query_text")
    vectors = done.select("query_id", F.col("embedding").alias("query_vector"), F.col("error").alias("no_vector_reason"))
    return queries.join(vectors, "query_id", "left").withColumn("no_vector_reason", F.when(cleaned == "", "empty text").otherwise(F.col("no_vector_reason")))


@dataclass(frozen=True)
class EmbeddingRun:
    """The next version of the table and the documents that could not be embedded."""

    table: DataFrame
    quarantine: DataFrame


def embedding_backlog(documents: DataFrame) -> DataFrame:
    """Documents without a vector whose text is worth embedding."""
    return documents.filter(F.col("embedding").isNull() & F.col("full_text").isNotNull() & (F.length("full_text") > 10))


def embed_texts(documents: DataFrame, key: str, embedder: Embedder, text: str = "full_text", batch_size: int | None = None) -> DataFrame:
    """Vectors of whole texts, by default one Arrow batch per call; ``batch_size`` is for embedders that
    take fewer texts at once. A failing call is retried text by text; a text that still fails has a
    NULL vector and the reason, never a made-up vector."""
    source = documents.select(F.col(key), F.col(text).alias("text"))
    key_type = source.schema[key].dataType.simpleString()

    def single(whole: str):
        try:
            return np.asarray(embedder([whole])[0], dtype=np.float64), None
        except Exception as failure:
            return None, f"{type(failure).__name__}: {failure}"

    def several(whole: list[str]):
        try:
            return [(np.asarray(vector, dtype=np.float64), None) for vector in embedder(whole)]
        except Exception:
            return [single(one) for one in whole]

    def run(frames):
        for frame in frames:
            whole = frame["text"].tolist()
            size = batch_size or max(1, len(whole))
            results = [result for first in range(0, len(whole), size) for result in several(whole[first : first + size])]
            yield pd.DataFrame(
                {key: frame[key], "embedding": [vector for vector, _ in results], "error": [reason for _, reason in results]}
            )

    return source.mapInPandas(run, f"{key} {key_type}, embedding array<double>, error string")


def embed_table(documents: DataFrame, key: str, embedder: Embedder, model: str, embedded_at: str, mode: str = "backlog", batch_size: int | None = None) -> EmbeddingRun:
    """Embed the backlog, or every text when ``mode='full'``, and merge the vectors by key.

    The vectors are written once to the shared folder, since both the merge and the quarantine read
    them and an executor may be lost in between.
    """
    if mode not in ("backlog", "full"):
        raise ValueError("mode is 'backlog' or 'full'")
    wanted = embedding_backlog(documents) if mode == "backlog" else documents.filter(F.col("full_text").isNotNull())
    done = write_version(embed_texts(wanted, key, embedder, batch_size=batch_size), "vectors")
    updates = done.filter(F.col("error").isNull()).select(
        key, "embedding", F.lit(model).alias("embedding_model"), F.lit(embedded_at).cast("timestamp_ntz").alias("embedded_at")
    )
    table = documents.withColumn("embedding", F.col("embedding").cast("array<double>"))
    return EmbeddingRun(
        merge_update(table, updates, key, ["embedding", "embedding_model", "embedded_at"]),
        done.filter(F.col("error").isNotNull()).select(key, "error"),
    )


def embedding_job(spark: SparkSession, root: str, key: str, embedder: Embedder, model: str, embedded_at: str, mode: str = "backlog", limit: int | None = None, batch_size: int | None = None) -> DataFrame:
    """Embed the current version of a stored table, commit the result and report its coverage.

    ``limit`` bounds how many documents one run embeds, smallest keys first; the next run goes on from there.
    Texts that failed are committed with their reasons before the table, see :func:`quarantined`.
    """
    documents = current(spark, root)
    wanted = embedding_backlog(documents) if mode == "backlog" else documents.filter(F.col("full_text").isNotNull())
    if limit is not None:
        chosen = wanted.select(key).orderBy(key).limit(limit)
        due = documents.join(chosen, key, "left_semi")
        run = embed_table(due, key, embedder, model, embedded_at, mode, batch_size)
        quarantine = run.quarantine
        rest = documents.join(chosen, key, "left_anti").withColumn("embedding", F.col("embedding").cast("array<double>"))
        table = rest.unionByName(run.table, allowMissingColumns=True)
    else:
        run = embed_table(documents, key, embedder, model, embedded_at, mode, batch_size)
        table, quarantine = run.table, run.quarantine
    commit(quarantine, f"{root}/quarantine")
    number = commit(table, root)
    return embedding_stats({root.rstrip("/").rpartition("/")[2]: current(spark, root)}).withColumn("version", F.lit(number))


def quarantined(spark: SparkSession, root: str) -> DataFrame | None:
    """The key and reason of the texts that the last :func:`embedding_job` over ``root`` could not embed."""
    return current(spark, f"{root}/quarantine")
