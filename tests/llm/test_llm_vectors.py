"""Vector searches against brute force."""

import math
import random

import harness
import numpy as np
import pytest
from conftest_llm import rows

from profilum.llm import exact_topk, nearest, vectors
from profilum.llm.queries import ORACLES, QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def usable(table, nonzero):
    kept = {}
    for key, vector in table:
        if key is not None and vector and all(x is not None and math.isfinite(x) for x in vector):
            kept[key] = min(kept.get(key, tuple(vector)), tuple(vector))
    sizes = [len(vector) for vector in kept.values()]
    common = min(set(sizes), key=lambda size: (-sizes.count(size), size), default=0)
    return {key: vector for key, vector in kept.items() if len(vector) == common and (any(vector) or not nonzero)}


def products(table, every, k):
    kept = {key: [math.floor(64 * x) for x in vector] for key, vector in usable(table, False).items()}
    result = []
    for query, own in kept.items():
        if query % every == 0:
            scores = sorted((-sum(map(lambda a, b: a * b, own, vector)), key) for key, vector in kept.items() if key != query)
            result += [(query, rank, key, -score) for rank, (score, key) in enumerate(scores[:k], 1)]
    return sorted(result)


def cosines(table, every):
    kept = {key: np.array(vector, dtype=float) for key, vector in usable(table, True).items()}
    keys, matrix = np.array(sorted(kept)), np.array([kept[key] / np.sqrt((kept[key] ** 2).sum()) for key in sorted(kept)])
    return {int(query): {int(key): float(score) for key, score in zip(keys, matrix @ matrix[place]) if key != query} for place, query in enumerate(keys) if query % every == 0}


def awkward_vectors(size=8, count=400):
    random.seed(12)
    same = [random.uniform(-1, 1) for _ in range(size)]
    table = [(key, [random.uniform(-1, 1) for _ in range(size)]) for key in range(count)]
    table += [(1000 + key, same) for key in range(150)] + [(key, [x / 2 for x in same]) for key in range(2000, 2020)]
    table += [(-20, same), (-40, [0.0] * size), (5000, None), (5001, []), (5002, [None] * size), (5020, [math.nan] * size), (5040, [math.inf] + [0.0] * (size - 1))]
    table += [(None, same), (6000, [1.0, 2.0]), (7000, same), (7000, same), (7000, [-x for x in same]), (8000, [1e-30] * size), (8020, [1e10] * size)]
    return [(key, None if vector is None else [None if x is None else float(np.float32(x)) for x in vector]) for key, vector in table]


@pytest.fixture
def small_cells(monkeypatch):
    monkeypatch.setattr(vectors, "CELL_ROWS", 64)


def test_exact_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    assert harness.compare(QUERIES["op7_exact_topk"](spark, folder), harness.connect(folder), ORACLES["op7_exact_topk"]) is None


@pytest.mark.parametrize("cells", [64, 1 << 16])
def test_exact_on_awkward_rows(make, cells, monkeypatch):
    monkeypatch.setattr(vectors, "CELL_ROWS", cells)
    monkeypatch.setattr(exact_topk, "BLOCK", 8)
    table = [(key, vector) for key, vector in awkward_vectors() if key != 8020]
    found = exact_topk.of_table(make([(key, vector, 0) for key, vector in table], SCHEMA), every=20, k=20)
    assert sorted((row.query_id, row["rank"], row.id, row.score) for row in found.collect()) == products(table, 20, 20)


def test_fewer_candidates_than_asked(make):
    table = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (21, [0.5, -0.5])]
    frame = make([(key, vector, 0) for key, vector in table], SCHEMA)
    assert sorted((row.query_id, row["rank"], row.id, row.score) for row in exact_topk.of_table(frame, 20, 20).collect()) == products(table, 20, 20)
    assert [(row.query_id, row["rank"], row.id) for row in nearest.of_table(frame, 50, 5).orderBy("rank").collect()] == [(0, 1, 20), (0, 2, 21)]


def test_empty_tables(make):
    for frame in (make([(1, [1.0], 0)], SCHEMA).where("vec_id = 2"), make([(0, None, 0)], SCHEMA)):
        assert exact_topk.of_table(frame, 20, 20).count() == 0
        assert nearest.of_table(frame, 50, 5).count() == 0


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall(spark, folder):
    table = rows(folder, "embeddings", "vec_id, embedding")
    expected = cosines(table, 50)
    found = QUERIES["op9_nearest"](spark, f"/root/testdata/{folder}").collect()
    hits = 0
    for row in found:
        assert row.score == pytest.approx(expected[row.query_id][row.vec_id], abs=1e-12)
        hits += row.score >= sorted(expected[row.query_id].values())[-5] - 1e-12
    assert len(found) == 5 * len(expected) and hits >= 0.9 * len(found)


def test_recall_on_vectors_of_many_lengths(make):
    """The lists that production probes, on twelve groups of directions and lengths from 1 to 100."""
    rng = np.random.default_rng(7)
    data = 0.3 * rng.standard_normal((2000, 64)) + rng.standard_normal((12, 64))[rng.integers(0, 12, 2000)]
    data *= (rng.uniform(1, 100, 2000) / np.linalg.norm(data, axis=1))[:, None]
    table = [(key, np.float32(vector).tolist()) for key, vector in enumerate(data)]
    expected = cosines(table, 10)
    found = nearest.of_table(make([(key, vector, 0) for key, vector in table], SCHEMA), 10, 5).collect()
    hits = sum(row.score >= sorted(expected[row.query_id].values())[-5] - 1e-12 for row in found)
    assert len(found) == 5 * len(expected) and hits >= 0.97 * len(found), hits / len(found)


def test_nearest_on_awkward_rows(make, small_cells, monkeypatch):
    """All lists probed and no test passed over: exact, with ties to the smaller id among equal vectors."""
    monkeypatch.setattr(nearest, "PROBES", 1.0)
    monkeypatch.setattr(nearest, "CONFIDENCE", 1e9)
    table = awkward_vectors()
    expected = cosines(table, 50)
    found = nearest.of_table(make([(key, vector, 0) for key, vector in table], SCHEMA), 50, 5).collect()
    answers = {}
    for row in sorted(found, key=lambda row: (row.query_id, row["rank"])):
        answers.setdefault(row.query_id, []).append((row.id, row.score))
    assert set(answers) == set(expected)
    for query, pairs in answers.items():
        best = sorted(expected[query].items(), key=lambda pair: (-round(pair[1], 12), pair[0]))[:5]
        assert [score for _, score in pairs] == pytest.approx([score for _, score in best], abs=1e-9)
    copies = sorted(key for key, vector in usable(table, True).items() if key >= 1000 and key < 1150)
    assert [key for key, _ in answers[1000]][:1] == [-20] and {key for key, _ in answers[1000]} <= {-20, 7000, *copies, *range(2000, 2020)}


def test_abandoned_rows_are_few_errors(spark):
    """The dimension tests alone, all lists probed: nearly nothing is lost."""
    rng = np.random.default_rng(3)
    data = rng.standard_normal((2000, 64))
    layout = vectors.Layout(np.zeros((1, 64)), np.array([1.0]), np.array([0]), np.array([1]))
    scan = nearest.Scan(layout, np.zeros(2000, dtype=int), data, np.arange(2000))
    pool = scan(data[:100], np.zeros(100, dtype=int), np.full(100, -np.inf), 6)
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    best = np.argsort(-(unit[:100] @ unit.T), axis=1)[:, :6]
    hits = sum(key in best[query] for query, key in zip(pool.query, pool.id))
    assert hits >= 0.95 * 600
