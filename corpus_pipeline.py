"""From documents to packed token sequences, in stages that are each written and read again.

1. ``language_id``: documents without a language (null text, no letter, nothing learned) go; a missing label is filled
   in with the language found.
2. ``near_duplicates``: one document of each group of near duplicates stays, the smallest id (null ids last). Linked are
   fingerprints of three-word shingles at most two bits apart, and sets of five-word shingles that are 0.8 similar or
   more (``near_copies``).
3. ``repeated_strings``: strings of ``REPEATED_BYTES`` bytes that start in more than one place are taken out of the
   texts; a character covered only in part stays. ``n_chars`` follows. A document may be left with an empty text. The
   length is that of a passage of 51 words in its shortest form (five bytes a word with its space), so that passages
   of over 50 words go wherever they repeat.
4. ``packing``: what is left becomes pieces of token sequences, one row each.

Every stage takes whole texts of all documents that the one before kept. Repeated rows are near duplicates of each
other, so one stays. Further columns of the documents are carried along to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profilum.llm import language, near_copies, packing, repeats
from profilum.llm.names import unused
from profilum.llm.settings import prepare
from profilum.sources.store import write_version

# SQL expresses neither context trees nor packing; tests hold each stage against a brute-force version.
ORACLE_SQL = None

# A passage of 51 words has 250 bytes and more; the gram that anchors it is a part of it.
REPEATED_BYTES, REPEATED_GRAM = 250, 96


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    models = language.fit(docs.where(language.learnable()))
    name = unused(docs, "_found")
    found = docs.withColumn(name, language.predict(docs, models)["lang"]).where(F.col(name) != language.UNDETERMINED)
    return found.withColumn("lang", F.coalesce("lang", name)).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return near_copies.one_per_group(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return repeats.clean(docs, length=REPEATED_BYTES, gram=REPEATED_GRAM).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    pieces = packing.cut(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return packing.pack(pieces).withColumnRenamed("id", "doc_id")


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("repeated_strings", repeated_strings), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the table ``documents`` in ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place + 1 < len(STAGES):
            docs = write_version(docs, name)
    return docs
