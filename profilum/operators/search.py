"""Exact and approximate top-k search by cosine similarity.

Queries always arrive as a table. A query set that is small by count is sent to every executor and
the documents are scanned in place, without a shuffle. For a larger one the documents move into
cells of bounded size: by nearness (:mod:`profilum.operators.cells`), where a query goes only to cells that
can hold a better document than it has, or by scope. All ways return the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilum.functions.topk import DIGITS, hit_frame, query_rows, scan, scan_lists, scan_scopes
from profilum.functions.vectors import norm, unit_rows
from profilum.operators import cells
from profilum.operators.metrics import top_per_group
from profilum.session import fresh_path
from profilum.sources.store import write_version

# A query set is sent around when it is within both bounds; at 768 dimensions 4096 queries take 25 MB.
BROADCAST_QUERIES = 4096
BROADCAST_BYTES = 64 * 1024 * 1024
PART_DOCUMENTS = 20_000
SLICE_QUERIES = 65_536


def _prepared(queries: DataFrame, documents: DataFrame, key: str, scope: str | None) -> DataFrame:
    """The columns a search needs. The excluded id is never NULL, so that large ids stay whole numbers
    on their way to Python; a flag tells whether it counts."""
    kind = documents.schema[key].dataType
    excluded = F.col("exclude_id").cast(kind) if "exclude_id" in queries.columns else F.lit(None).cast(kind)
    return queries.select(
        "query_id",
        F.col("query_vector").cast("array<double>").alias("query_vector"),
        F.coalesce(excluded, F.lit(0).cast(kind)).alias("exclude_id"),
        excluded.isNotNull().alias("excludes"),
        *([F.col(scope).alias("_scope")] if scope else []),
    )


def _small_scan(queries: pd.DataFrame, documents: DataFrame, key: str, k: int, schema: str) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(queries)

    def run(frames):
        local, state = shared.value, {}

        def blocks():
            for frame in frames:
                if len(frame):
                    rows = unit_rows(frame["embedding"])
                    if not state:
                        state["queries"], state["excluded"] = query_rows(local, rows.shape[1])
                    yield frame[key].to_numpy(), rows

        stream = blocks()
        first = next(stream, None)
        if first is None:
            return

        def whole():
            yield first
            yield from stream

        best = scan(state["queries"], state["excluded"], whole(), k)
        if len(best):
            yield hit_frame(local["query_id"], key, best)

    sizes = queries["query_vector"].dropna().map(len)
    found = documents.filter(F.col("embedding").isNotNull()).select(key, "embedding")
    # Documents of another dimension than most queries are not compared.
    return (found.filter(F.size("embedding") == int(sizes.mode().min())) if len(sizes) else found).mapInPandas(run, schema)


def _parts(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def _scope_scan(queries: DataFrame, documents: DataFrame, docs: DataFrame, key: str, k: int, schema: str, asking: int) -> DataFrame:
    """Send the queries to cells of documents of their scope.

    The number of cells follows the number of documents, so a cell keeps its size as they grow. All ``documents`` are
    counted, also those without a vector: that bounds the cells and reads no vectors. The queries of a cell come after
    its documents and are never held together; those of a scope that many ask for are split, and its documents go to
    each slice.
    """
    queries = queries.filter(F.col("_scope").isNotNull())
    # Scopes nobody asks for are dropped first.
    docs = docs.join(queries.select("_scope").distinct(), "_scope", "left_semi")
    doc_count = documents.count()
    # A bucket takes whole scopes and is filled to a quarter on average, which leaves room for
    # uneven ones. There are at least as many buckets as cores.
    buckets = max(documents.sparkSession.sparkContext.defaultParallelism, 4 * _parts(doc_count, PART_DOCUMENTS))
    # Only large scopes are split; there can be no more of them than rows over the size.
    splits = []
    for rows, count, size, name in ((documents, doc_count, PART_DOCUMENTS, "_parts"), (queries, asking, SLICE_QUERIES, "_slices")):
        large = rows.groupBy("_scope").agg(F.count("*").alias("n")).filter(F.col("n") > size)
        splits.append((large.select("_scope", F.ceil(F.col("n") / size).cast("int").alias(name)) if count > size else None, name))

    def placed(rows: DataFrame) -> DataFrame:
        for split, name in splits:
            rows = rows.withColumn(name, F.lit(1)) if split is None else rows.join(split, "_scope", "left").withColumn(name, F.coalesce(name, F.lit(1)))
        return rows.withColumn("_bucket", F.pmod(F.xxhash64("_scope"), F.lit(buckets)))

    def numbered(name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(name) - 1))

    place = ["_bucket", "_part", "_slice"]
    held = placed(docs).withColumn("_part", F.pmod(F.xxhash64(key), F.col("_parts")).cast("int")).withColumn("_slice", numbered("_slices"))
    sent = placed(queries).withColumn("_slice", F.pmod(F.xxhash64("query_id", "query_vector"), F.col("_slices")).cast("int")).withColumn("_part", numbered("_parts"))
    together = cells.documents_held(held, place, key, queries).unionByName(cells.queries_sent(sent, place, docs, key))
    return cells.meet(together, place, key, k, schema, scan_scopes)


def _part_scan(queries: DataFrame, documents: DataFrame, key: str, k: int, scope: str | None, schema: str) -> DataFrame:
    # Queries are often results themselves, and are read more than once.
    queries = write_version(queries, "queries")
    # Documents of another dimension than most queries are not compared; the smallest of equally common ones, as in the other way.
    sizes = F.when(F.col("query_vector").isNotNull(), F.size("query_vector"))
    dimension, asking = queries.agg(F.mode(sizes, deterministic=True), F.count("*")).first()
    docs = documents.filter(F.col("embedding").isNotNull() & (F.size("embedding") == F.coalesce(F.lit(dimension).cast("int"), F.size("embedding"))))
    docs = docs.select(F.col(key), F.col("embedding").cast("array<double>").alias("vector"), *([F.col(scope).alias("_scope")] if scope else []))
    if scope:
        return _scope_scan(queries, documents.select(F.col(scope).alias("_scope")), docs, key, k, schema, asking)
    # Those with a vector, which can be few among all.
    known = docs.count()
    if 2 * known <= cells.part_size(dimension):
        return cells.one_cell(queries, docs, key, k, known, asking, schema)
    if dimension is None:
        # Without a vector among the queries all documents score zero.
        docs, dimension = docs.select(key, F.array(F.lit(0.0)).alias("vector")), 1
    return cells.search(queries, docs, key, k, dimension, schema).hits


def partial_top_k(queries: DataFrame, documents: DataFrame, key: str, k: int = 5, scope: str | None = None, broadcast_queries: int = BROADCAST_QUERIES) -> DataFrame:
    """The k best documents of each query within each task; they contain the k best overall.

    ``queries`` has ``query_id`` and ``query_vector`` and may name one document in ``exclude_id`` that
    is not returned. With ``scope`` a query only sees documents whose ``scope`` column equals its own.
    Documents without a vector are skipped.
    """
    prepared = _prepared(queries, documents, key, scope)
    key_type, query_type = (frame.schema[name].dataType.simpleString() for frame, name in ((documents, key), (queries, "query_id")))
    schema = f"query_id {query_type}, {key} {key_type}, similarity_score double"
    if scope is None:
        # One row over the bound tells that the set is too large to send around.
        local = prepared.limit(broadcast_queries + 1).toArrow()
        if not local.num_rows:
            return documents.sparkSession.createDataFrame([], schema)
        if local.num_rows <= broadcast_queries and local.nbytes <= BROADCAST_BYTES:
            return _small_scan(local.to_pandas(), documents, key, k, schema)
    return _part_scan(prepared, documents, key, k, scope, schema)


def top_k(queries: DataFrame, documents: DataFrame, key: str, k: int = 5, scope: str | None = None, broadcast_queries: int = BROADCAST_QUERIES) -> DataFrame:
    """The k most similar documents of each query, ranked; ties go to the smaller id.

    The arguments are those of :func:`partial_top_k`.
    """
    hits = partial_top_k(queries, documents, key, k, scope, broadcast_queries)
    return top_per_group(hits, ["query_id"], [F.col("similarity_score").desc(), F.col(key)], k)


def ticket_details(tickets: DataFrame) -> DataFrame:
    """What a search result shows of a ticket."""
    return tickets.select(
        "ticket_id",
        F.col("ticket_id").cast("string").alias("doc_id"),
        F.lit("support_ticket").alias("source_type"),
        F.col("subject").alias("title"),
        F.substring(F.coalesce("full_text", F.lit("")), 1, 1000).alias("content"),
        "created_at",
        F.create_map(F.lit("status"), "status", F.lit("priority"), "priority", F.lit("customer_email"), "customer_email").alias("metadata"),
    )


def product_details(products: DataFrame) -> DataFrame:
    """What a search result shows of a product."""
    return products.select(
        "product_id",
        F.col("product_id").cast("string").alias("doc_id"),
        F.lit("product").alias("source_type"),
        F.col("product_name").alias("title"),
        F.substring(F.coalesce("full_text", F.lit("")), 1, 500).alias("content"),
        F.lit(None).cast("timestamp_ntz").alias("created_at"),
        F.create_map(
            F.lit("product_name"), "product_name", F.lit("category"), "category",
            F.lit("price"), F.coalesce("price", F.lit(0.0)).cast("string"), F.lit("description"), "description",
        ).alias("metadata"),
    )


def by_address(queries: DataFrame, tickets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries that name an address and the tickets, both with the address in lower case."""
    asked = queries.filter(F.col("customer_email").isNotNull()).withColumn("email_norm", F.lower("customer_email"))
    return asked, tickets.withColumn("email_norm", F.lower("customer_email"))


def search_tickets(queries: DataFrame, tickets: DataFrame, k: int = 5) -> DataFrame:
    return top_k(queries, tickets, "ticket_id", k).join(ticket_details(tickets), "ticket_id").drop("ticket_id")


def search_customer_tickets(queries: DataFrame, tickets: DataFrame, k: int = 5) -> DataFrame:
    """Search among the tickets of the address each query names, ignoring case."""
    asked, owned = by_address(queries, tickets)
    return top_k(asked, owned, "ticket_id", k, scope="email_norm").join(ticket_details(tickets), "ticket_id").drop("ticket_id")


def search_products(queries: DataFrame, products: DataFrame, k: int = 5) -> DataFrame:
    return top_k(queries, products, "product_id", k).join(product_details(products), "product_id").drop("product_id")


@dataclass(frozen=True)
class ListIndex:
    """Documents stored by the list of their nearest centre, and the centres themselves."""

    path: str
    key: str
    centres: np.ndarray


def build_index(documents: DataFrame, key: str, lists: int | None = None, centres: np.ndarray | None = None, seed: int = 7) -> ListIndex:
    """Write the documents partitioned by the list of their nearest centre.

    The centres are given, or found by clustering unit vectors into ``lists``, by default the square root of
    the number of documents. Equally near centres: the first.
    """
    spark = documents.sparkSession
    source = documents.filter(F.col("embedding").isNotNull()).select(key, F.col("embedding").cast("array<double>").alias("embedding"))
    if centres is None:
        length = norm(F.col("embedding"))
        unit = F.when(length > 0, F.transform("embedding", lambda x: x / length)).otherwise(F.col("embedding"))
        lists = lists or max(1, round(source.count() ** 0.5))
        model = KMeans(k=lists, seed=seed, featuresCol="features", predictionCol="list_id", maxIter=10).fit(source.select(array_to_vector(unit).alias("features")))
        centres = np.array(model.clusterCenters())

    def assign(frames):
        for frame in frames:
            if len(frame):
                yield frame.assign(list_id=_nearest(unit_rows(frame["embedding"]), centres, 1)[:, 0].astype("int32"))

    key_type = source.schema[key].dataType.simpleString()
    path = fresh_path(spark, "lists")
    assigned = source.mapInPandas(assign, f"{key} {key_type}, embedding array<double>, list_id int")
    assigned.hint("rebalance", F.col("list_id")).write.partitionBy("list_id").parquet(path)
    return ListIndex(path, key, centres)


def open_index(path: str, key: str, centres: np.ndarray) -> ListIndex:
    """An index that was built before."""
    return ListIndex(path, key, centres)


def _nearest(rows: np.ndarray, centres: np.ndarray, count: int) -> np.ndarray:
    distance = np.round((centres * centres).sum(axis=1)[None, :] - 2.0 * rows @ centres.T, DIGITS)
    return np.argsort(distance, axis=1, kind="stable")[:, :count]


def _choose(queries: DataFrame, index: ListIndex, probes: int, groups: dict[int, list[int]] | None = None) -> DataFrame:
    """The queries with the ``lists`` they should look into, nearest first. With ``groups``, the groups of each list, a
    query is there once per group with the lists of that group. The centres are bounded by the list count."""
    centres = index.centres
    count = min(probes, len(centres))
    names = [name for name in queries.columns if name != "query_vector"]
    kept = [f"`{name}` {queries.schema[name].dataType.simpleString()}" for name in names]

    def choose(frames):
        for frame in frames:
            for first in range(0, len(frame), cells.PART_QUERIES):
                part = frame.iloc[first : first + cells.PART_QUERIES]
                rows, _ = query_rows(part.assign(excludes=False), centres.shape[1])
                nearest = _nearest(rows, centres, count).astype("int32")
                if groups is None:
                    yield part[names].assign(lists=list(nearest))
                    continue
                met = [[place for place in places if place in groups] for places in nearest.tolist()]
                placed: list[dict[int, list[int]]] = []
                for places in met:
                    own: dict[int, list[int]] = {}
                    for number in places:
                        for group in groups[number]:
                            own.setdefault(group, []).append(number)
                    placed.append(own)
                at = np.repeat(np.arange(len(part)), [len(own) for own in placed])
                if len(at):
                    yield part.iloc[at].assign(_group=[group for own in placed for group in own], _scope=[lists for own in placed for lists in own.values()])

    # Vectors leave only with the groups, where the search needs them.
    added = [*kept, "lists array<int>"] if groups is None else [*kept, "query_vector array<double>", "_group int", "_scope array<int>"]
    return queries.select(*names, F.col("query_vector").cast("array<double>").alias("query_vector")).mapInPandas(choose, ", ".join(added))


def nearest_lists(queries: DataFrame, index: ListIndex, probes: int) -> DataFrame:
    """Each query once per list it should look into."""
    return _choose(queries.select("query_id", "query_vector"), index, probes).select("query_id", F.explode("lists").alias("list_id"))


def _list_groups(sizes: dict[int, int], room: int) -> dict[int, list[int]]:
    """The groups of each list: neighbouring lists share one up to ``room`` documents, a list beyond has several of its own."""
    groups, number, filled = {}, 0, 0
    for place, rows in sorted(sizes.items()):
        if filled and filled + rows > room:
            number, filled = number + 1, 0
        parts = -(-rows // room)
        groups[place] = list(range(number, number + parts))
        number, filled = (number + parts, 0) if parts > 1 else (number, filled + rows)
    return groups


def search_index(queries: DataFrame, index: ListIndex, k: int = 5, probes: int = 10) -> DataFrame:
    """Top k among the documents of the nearest lists; with all lists probed it is exact.

    A task holds a group of lists, as many as fit a part, and a query goes there once with the numbers of those it looks into,
    so what moves does not grow with the probes.
    """
    key, spark = index.key, queries.sparkSession
    stored = spark.read.parquet(index.path)
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, {key} {stored.schema[key].dataType.simpleString()}, similarity_score double"
    # Queries are often results themselves, and are read more than once.
    asked = write_version(_prepared(queries, stored, key, None), "queries")
    sizes = F.when(F.col("query_vector").isNotNull(), F.size("query_vector"))
    dimension, asking = asked.agg(F.mode(sizes, deterministic=True), F.count("*")).first()
    docs = stored.filter(F.size("embedding") == F.coalesce(F.lit(dimension).cast("int"), F.size("embedding")))
    # One row per list.
    groups = _list_groups({row.list_id: row.n for row in docs.groupBy("list_id").agg(F.count("*").alias("n")).collect()}, cells.part_size(index.centres.shape[1]))
    if not groups or not asking:
        return top_per_group(spark.createDataFrame([], schema), ["query_id"], [F.col("similarity_score").desc(), F.col(key)], k)
    held_in = spark.createDataFrame([(place, own[0], len(own)) for place, own in groups.items()], "list_id int, _first int, _parts int")
    slices = cells.slices_of(asking, len({group for own in groups.values() for group in own}), spark.sparkContext.defaultParallelism)
    place = ["_group", "_slice"]
    held = docs.join(F.broadcast(held_in), "list_id").select(
        key, F.col("embedding").cast("array<double>").alias("vector"), F.array("list_id").alias("_scope"),
        (F.col("_first") + F.pmod(F.xxhash64(key), F.col("_parts"))).cast("int").alias("_group"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("_slice"),
    )
    sent = _choose(asked, index, probes, groups).withColumn("_slice", F.pmod(F.xxhash64("query_id", "query_vector"), F.lit(slices)).cast("int"))
    together = cells.documents_held(held, place, key, asked).unionByName(cells.queries_sent(sent, place, held, key))
    return top_per_group(cells.meet(together, place, key, k, schema, scan_lists), ["query_id"], [F.col("similarity_score").desc(), F.col(key)], k)


def probed_rows(queries: DataFrame, index: ListIndex, probes: int) -> DataFrame:
    """How many stored documents the probed lists hold, summed over the queries, and how many all lists would."""
    sizes = queries.sparkSession.read.parquet(index.path).groupBy("list_id").agg(F.count("*").alias("rows"))
    probed = nearest_lists(queries, index, probes).join(sizes, "list_id", "left")
    everything = sizes.agg(F.sum("rows")).scalar()
    return probed.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows_probed"), (F.countDistinct("query_id") * everything).alias("rows_in_all_lists"))


def recall(exact: DataFrame, approximate: DataFrame, key: str) -> DataFrame:
    """Share of the exact hits that the approximate search also found."""
    found = exact.select("query_id", key).join(approximate.select("query_id", key, F.lit(1).alias("found")), ["query_id", key], "left")
    return found.agg((F.sum(F.coalesce("found", F.lit(0))) / F.count("*")).alias("recall"), F.count("*").alias("exact_hits"))


def label_agreement(hits: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Per label of the query: hits and the share of hits that carry the same label.

    ``labels`` has ``key`` and ``label``; queries are labelled documents, so ``query_id`` is a key too.
    """
    own = labels.select(F.col(key).alias("query_id"), F.col("label").alias("query_label"))
    joined = hits.join(own, "query_id").join(labels.select(key, "label"), key)
    return joined.groupBy("query_label").agg(
        F.count("*").alias("hits"), (F.count_if(F.col("label") == F.col("query_label")) / F.count("*")).alias("precision_at_k")
    )
