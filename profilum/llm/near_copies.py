"""Groups of near copies for filtering a corpus: fingerprints few bits apart, and sets of shingles that are similar.

SimHash fingerprints (``simhash``) find copies and the closest near copies. Copies with more edits differ in more bits
than anchors can cover, so the sets of ``RULE.shingle`` words that are ``RULE.percent`` / 100 similar are linked as well
(``ngram_join``, exact). A group is what either kind of link connects.

Null, empty and blank texts have the fingerprint zero and no shingles: they are one group. Repeated rows are copies of
each other. An empty table gives no rows. All columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilum.functions.membership import key_filter
from profilum.llm import ngram_join, simhash
from profilum.llm.components import components
from profilum.llm.names import unused
from profilum.operators.metrics import top_per_group
from profilum.sources.store import write_version

RULE = ngram_join.Rule(shingle=5, percent=80)


def one_per_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rule: ngram_join.Rule = RULE) -> DataFrame:
    """The documents with all their columns, one of each group: the smallest id (null last), then the least row."""
    name = unused(docs, "_row")
    row = F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), *[F.col(f"`{column}`") for column in docs.columns])), 16, "0") for seed in (1, 2)])
    place = ngram_join.places(doc_id, text)
    source = docs.select(F.col(f"`{doc_id}`").alias("id"), row.alias("row"), *place, F.col(f"`{text}`").alias("text"))
    prints = write_version(simhash.with_fingerprint(source).drop("text"), "prints")
    rooted = prints.join(simhash.classes(prints.select("id", "fingerprint")).select("fingerprint", "root"), "fingerprint")
    rooted = write_version(rooted.select("id", "row", *ngram_join.PLACE, "root"), "rooted")
    documents, linked = ngram_join.links(docs, doc_id, text, rule)
    # Fingerprint groups that share a set of shingles, and those that linked sets lie in.
    shingled = documents.where("size > 0").select("class", *ngram_join.PLACE).distinct()
    held = write_version(rooted.select(*ngram_join.PLACE, "root").distinct().join(shingled.hint("merge"), ngram_join.PLACE).groupBy("class", "root").count(), "class-roots")
    least = held.groupBy("class").agg(F.min("root").alias("least"), F.max("root").alias("greatest"))
    same = held.join(least.where("least <> greatest"), "class").select(F.col("root").alias("u"), F.col("least").alias("v"))
    # Sets, rows and places grow with the documents; small in files, they would take several times as much in the driver.
    first = least.select("class", "least").hint("merge")
    ends = linked.join(first.select(F.col("class").alias("u"), F.col("least").alias("u_root")), "u").join(first.select(F.col("class").alias("v"), F.col("least").alias("v_root")), "v")
    groups = components(same.unionByName(ends.select(F.col("u_root").alias("u"), F.col("v_root").alias("v"))))
    final = rooted.join(groups.select(F.col("root").alias("group"), F.col("vertex").alias("root")), "root", "left").withColumn("group", F.coalesce("group", "root"))
    stays = write_version(top_per_group(final.select("group", "id", "row"), ["group"], [F.col("id").asc_nulls_last(), F.col("row")], 1, "_rank").select("row"), "stays")
    # Most rows stay and are there once. Only what may be another moves with its text.
    others = rooted.groupBy("row").count().join(stays.withColumn("stays", F.lit(True)).hint("merge"), "row", "left").where("stays is null or count > 1")
    columns = [F.col(f"`{column}`") for column in docs.columns]
    moves = key_filter(write_version(others.select("row"), "others"), F.col("row")).holds(docs.sparkSession, row)
    moved = docs.where(moves).withColumn(name, row).join(stays.select(F.col("row").alias(name)).hint("merge"), name, "left_semi")
    return docs.where(~moves).select(*columns).union(moved.dropDuplicates([name]).select(*columns))
