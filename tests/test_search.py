"""Search against brute force, in every way it can run."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from profilum.functions import topk
from profilum.functions.vectors import cosine, unit_rows
from profilum.operators import cells, search

K = 4


def make(seed, count, dimension=8, copies=0):
    vectors = np.random.default_rng(seed).normal(size=(count, dimension))
    if copies:
        vectors[:copies] = vectors[0]
    return vectors


@pytest.fixture(scope="module")
def corpus(spark):
    vectors = make(1, 300, copies=120)
    vectors[200] = 0.0
    rows = [(int(i), [float(x) for x in v], "hot" if i % 3 else f"s{i % 30}") for i, v in enumerate(vectors)]
    rows.append((999, None, "hot"))
    return vectors, {row[0]: row[2] for row in rows}, spark.createDataFrame(rows, "doc bigint, embedding array<double>, place string").repartition(5)


@pytest.fixture(scope="module")
def asked(spark):
    vectors = make(2, 60)
    vectors[5] = 0.0
    vectors[6] = make(1, 300, copies=120)[0]
    rows = [(f"q{i}", [float(x) for x in v], int(i), "hot" if i % 2 else f"s{3 * (i % 10)}") for i, v in enumerate(vectors)]
    rows.append(("none", None, None, "hot"))
    return vectors, {row[0]: row[3] for row in rows}, spark.createDataFrame(rows, "query_id string, query_vector array<double>, exclude_id bigint, place string").repartition(3)


def brute(corpus, asked, scoped):
    docs, places, _ = corpus
    vectors, scopes, _ = asked
    expected = {}
    for i in [*range(len(vectors)), None]:
        name = "none" if i is None else f"q{i}"
        query = np.zeros(docs.shape[1]) if i is None else vectors[i]
        scored = []
        for doc, vector in enumerate(docs):
            if doc == i or (scoped and places[doc] != scopes[name]):
                continue
            lengths = np.linalg.norm(query) * np.linalg.norm(vector)
            scored.append((-round(float(query @ vector / lengths) if lengths else 0.0, 9), doc))
        expected[name] = [doc for _, doc in sorted(scored)[:K]]
    return expected


def listed(hits, key="doc"):
    found = {}
    for row in sorted(hits.collect(), key=lambda row: (row.query_id, row["rank"])):
        found.setdefault(row.query_id, []).append(row[key])
    return found


def test_small_query_set(corpus, asked):
    assert listed(search.top_k(asked[2], corpus[2], "doc", K)) == brute(corpus, asked, False)


def test_split_query_set(monkeypatch, corpus, asked):
    monkeypatch.setattr(cells, "PART_DOCUMENTS", 70)
    monkeypatch.setattr(cells, "SLICE_QUERIES", 13)
    assert listed(search.top_k(asked[2], corpus[2], "doc", K, broadcast_queries=20)) == brute(corpus, asked, False)


@pytest.mark.parametrize("parts", [(20_000, 4096), (50, 7)])
def test_scoped(monkeypatch, corpus, asked, parts):
    monkeypatch.setattr(search, "PART_DOCUMENTS", parts[0])
    monkeypatch.setattr(search, "SLICE_QUERIES", parts[1])
    expected = {name: docs for name, docs in brute(corpus, asked, True).items() if docs}
    assert listed(search.top_k(asked[2], corpus[2], "doc", K, scope="place")) == expected


def test_index_with_all_lists_is_exact(corpus, asked):
    index = search.build_index(corpus[2], "doc", 8)
    exact = search.top_k(asked[2], corpus[2], "doc", K)
    assert listed(search.search_index(asked[2], index, K, probes=8)) == listed(exact)
    few = search.search_index(asked[2], index, K, probes=2)
    share = search.recall(exact, few, "doc").first().recall
    assert 0.2 < share <= 1.0


def test_text_ids(spark):
    docs = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", [-1.0, 0.0])], "doc string, embedding array<double>")
    queries = spark.createDataFrame([(1, [3.0, 0.0])], "query_id bigint, query_vector array<double>")
    for bound in (10, 0):
        hits = search.top_k(queries, docs, "doc", 3, broadcast_queries=bound).orderBy("rank").collect()
        assert [(row.doc, row.similarity_score) for row in hits] == [("a", 1.0), ("b", 1.0), ("c", -1.0)]


def test_large_ids_are_excluded_exactly(spark):
    big = 2**60
    docs = spark.createDataFrame([(big, [1.0, 0.0], "x"), (big + 1, [1.0, 0.1], "x")], "doc bigint, embedding array<double>, place string")
    queries = spark.createDataFrame([("a", [1.0, 0.0], big, "x"), ("b", [1.0, 0.0], None, "x")], "query_id string, query_vector array<double>, exclude_id bigint, place string")
    for options in ({}, {"broadcast_queries": 0}, {"scope": "place"}):
        assert listed(search.top_k(queries, docs, "doc", 2, **options)) == {"a": [big + 1], "b": [big, big + 1]}


def test_no_queries(spark, corpus):
    none = spark.createDataFrame([], "query_id string, query_vector array<double>")
    assert search.top_k(none, corpus[2], "doc").count() == 0
    assert search.top_k(none.withColumn("place", F.lit("hot")), corpus[2], "doc", scope="place").count() == 0


def test_cosine_column(spark):
    frame = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0])], "a array<double>, b array<double>")
    found = [row[0] for row in frame.select(cosine(F.col("a"), F.col("b"))).collect()]
    assert found == [pytest.approx(2 ** -0.5), 0.0, -1.0]


@pytest.mark.parametrize("sizes", [(2, 3), (2, 17), (5, 8), (7, 64)])
def test_equally_common_sizes_are_settled_alike(spark, sizes):
    """The smaller of two equally common dimensions is compared, whatever the size of the query set."""
    docs = spark.createDataFrame([(size, [1.0] * size) for size in sizes], "doc bigint, embedding array<double>")
    asked = spark.createDataFrame([(f"q{size}", [1.0] * size) for size in sizes], "query_id string, query_vector array<double>")
    for limit in (search.BROADCAST_QUERIES, 0):
        found = search.top_k(asked, docs, "doc", K, broadcast_queries=limit).collect()
        assert {row.doc for row in found} == {min(sizes)}


def clustered(spark, documents, groups, seed=5, spread=0.02, dimension=16):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, dimension))
    rows = middles[rng.integers(0, groups, documents)] + spread * rng.normal(size=(documents, dimension))
    # A third are copies of one document, some have no direction.
    rows[: documents // 3] = rows[0]
    rows[-3] = 0.0
    frame = [(i, [float(x) for x in row]) for i, row in enumerate(rows)]
    frame[-2] = (documents - 2, [float("nan")] * dimension)
    frame[-1] = (documents - 1, [float("inf"), *[1.0] * (dimension - 1)])
    return rows, spark.createDataFrame(frame, "doc bigint, embedding array<double>").repartition(4)


@pytest.fixture
def small_cells(monkeypatch):
    monkeypatch.setattr(cells, "PART_DOCUMENTS", 40)
    monkeypatch.setattr(cells, "SLICE_QUERIES", 25)


def test_bounds_skip_cells_and_keep_rows(spark, small_cells):
    rows, docs = clustered(spark, 900, 12)
    queries = docs.select(F.col("doc").alias("query_id"), F.col("embedding").alias("query_vector"), F.col("doc").alias("exclude_id"))
    plain = search.top_k(queries, docs, "doc", K)
    split = search.top_k(queries, docs, "doc", K, broadcast_queries=0)
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, plain.select(split.columns).collect()))
    prepared = search._prepared(queries, docs, "doc", None)
    found = cells.search(prepared, docs.withColumnRenamed("embedding", "vector"), "doc", K, 16, "query_id bigint, doc bigint, similarity_score double")
    assert 0 < found.pairs < found.all_pairs / 2
    # The cell of the copies is asked by a third of all queries, which do not meet in one task.
    assert found.slices >= 900 // 3 // 25


def test_bound_holds_for_every_document(spark, small_cells):
    rows, docs = clustered(spark, 300, 5, spread=0.5)
    built = cells.build_cells(docs.withColumnRenamed("embedding", "vector"), "doc", 16)
    assert built.counts.sum() == 300 and built.counts[-1] == 3
    asked = unit_rows(list(np.random.default_rng(8).normal(size=(50, 16))))
    bounds = built.bounds(asked)
    for row in built.table.filter("cell >= 0").collect():
        assert (asked @ unit_rows([row.vector])[0] <= bounds[:, row.cell] + cells.BOUND_SLACK).all()


@pytest.mark.parametrize("size", [2, 40])
def test_documents_without_direction(spark, monkeypatch, size):
    monkeypatch.setattr(cells, "PART_DOCUMENTS", size)
    docs = spark.createDataFrame([(i, [0.0, 0.0]) for i in range(7)], "doc bigint, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.0, 0.0], None), (3, None, 1)], "query_id bigint, query_vector array<double>, exclude_id bigint")
    expected = {1: [1, 2, 3, 4], 2: [0, 1, 2, 3], 3: [0, 2, 3, 4]}
    for limit in (10, 0):
        assert listed(search.top_k(asked, docs, "doc", K, broadcast_queries=limit)) == expected
    unknown = asked.filter("query_id = 3")
    assert listed(search.top_k(unknown, docs, "doc", K, broadcast_queries=0)) == {3: [0, 2, 3, 4]}
    assert search.top_k(asked, docs.filter("doc > 99"), "doc", K, broadcast_queries=0).count() == 0
    cells_of_two = search.top_k(asked.unionByName(asked.withColumn("query_id", F.col("query_id") + 10)), docs, "doc", K, broadcast_queries=0)
    assert listed(cells_of_two) == expected | {name + 10: found for name, found in expected.items()}


def test_busy_scope_is_split(monkeypatch, corpus, asked):
    monkeypatch.setattr(search, "PART_DOCUMENTS", 50)
    monkeypatch.setattr(search, "SLICE_QUERIES", 9)
    expected = {name: docs for name, docs in brute(corpus, asked, True).items() if docs}
    assert listed(search.top_k(asked[2], corpus[2], "doc", K, scope="place")) == expected


def test_probes_do_not_move_queries_again(spark, monkeypatch):
    """A query meets a group of lists once, however many of its lists it probes, and large lists are split."""
    rows, docs = clustered(spark, 600, 6)
    queries = docs.select(F.col("doc").alias("query_id"), F.col("embedding").alias("query_vector"), F.col("doc").alias("exclude_id"))
    index = search.build_index(docs.filter("doc < 597"), "doc", 12)
    exact = search.top_k(queries, docs.filter("doc < 597"), "doc", K)
    sent, sending = [], cells.queries_sent
    monkeypatch.setattr(cells, "queries_sent", lambda rows, *rest: (sent.append(rows.count()), sending(rows, *rest))[1])
    for part, most in ((160_000, 600), (150, 600 * 8)):
        monkeypatch.setattr(cells, "PART_DOCUMENTS", part)
        assert sorted(map(tuple, search.search_index(queries, index, K, probes=12).collect())) == sorted(map(tuple, exact.select("query_id", "doc", "similarity_score", "rank").collect()))
        assert sent.pop() <= most


def test_hits_wait_until_they_are_worth_ordering(monkeypatch):
    """Far fewer orderings than slices of documents, and the best rows of all, with ties, excluded and missing documents."""
    random = np.random.default_rng(3)
    rows, queries = (unit_rows(random.integers(-2, 3, (count, 6)).astype(float)) for count in (900, 40))
    ids, excluded = np.arange(900)[::-1] * 7, np.array([7 * place if place % 3 else None for place in range(40)], dtype=object)
    ordered, order = [], topk.best_rows
    monkeypatch.setattr(topk, "SLICE", 10)
    monkeypatch.setattr(topk, "best_rows", lambda *given: ordered.append(1) or order(*given))
    for k in (3, 2000):
        ordered.clear()
        found = topk.scan(queries, excluded, [(ids[:400], rows[:400]), (ids[400:], rows[400:])], k)
        assert len(ordered) < 45
        for number, vector in enumerate(queries):
            scores = sorted((-round(float(score), topk.DIGITS), doc) for doc, score in zip(ids.tolist(), rows @ vector) if doc != excluded[number])[:k]
            mine = found[found["query"] == number]
            assert list(zip((-mine["score"]).tolist(), mine["doc"].tolist())) == scores
