"""Vector codes with bounds against measuring everything in every round."""

import hashlib
import math
import random

import numpy as np
import pytest
from conftest_llm import rows as table_rows
from pyspark.sql import functions as F

from profilum.llm import code_compression
from profilum.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, label int"


def expected(rows):
    """``vec_id, code, error, label_error, digest`` of rows ``vec_id, embedding, label`` of one dimension."""
    rows = [(key, [math.floor(4096 * x) for x in vector], label) for key, vector, label in rows if vector is not None and all(x is not None and math.isfinite(x) for x in vector)]
    if not rows:
        return []
    least = {}
    for key, vector, _ in rows:
        least[key] = min(vector, least.get(key, vector))
    start = [least[key] for key in sorted(least, key=lambda key: (key is None, key))[:16]]
    cuts = [(part * len(start[0]) // 8, (part + 1) * len(start[0]) // 8) for part in range(8)]
    vectors = np.array([vector for _, vector, _ in rows], dtype=np.int64)
    codes, error, books = [], 0, []
    for low, high in cuts:
        part, book = vectors[:, low:high], np.array(start, dtype=np.int64)[:, low:high]
        for _ in range(6):
            entry = ((part[:, None] - book[None]) ** 2).sum(axis=2).argmin(axis=1)
            book = np.array([[sum(column) // len(column) for column in part[entry == one].T.tolist()] if (entry == one).any() else book[one].tolist() for one in range(len(book))], dtype=np.int64).reshape(book.shape)
        squares = ((part[:, None] - book[None]) ** 2).sum(axis=2)
        codes.append(squares.argmin(axis=1))
        error = error + squares.min(axis=1)
        books += book.ravel().tolist()
    by_label = {}
    for (_, _, label), value in zip(rows, error.tolist()):
        by_label[label] = by_label.get(label, 0) + value
    digest = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    return sorted([(key, "".join(f"{code[place]:02x}" for code in codes), int(error[place]), by_label[label], digest) for place, (key, _, label) in enumerate(rows)], key=repr)


def found(frame):
    result = code_compression.with_label_error(code_compression.compress(frame))
    return sorted([(row.id, row.code, row.error, row.label_error, row.codebooks_sha256) for row in result.collect()], key=repr)


def test_query(spark):
    rows = table_rows("sf0.001", "embeddings", "vec_id, embedding, label")
    assert sorted([tuple(row) for row in QUERIES["op11_code_compression"](spark, "/root/testdata/sf0.001").collect()], key=repr) == expected(rows)


def clustered(count, dimension):
    random.seed(5)
    centres = [[random.uniform(-1, 1) for _ in range(dimension)] for _ in range(9)]
    return [(key, [x + random.gauss(0, 0.05) for x in random.choice(centres)], random.choice([1, 2, None])) for key in random.sample(range(10**6), count)]


@pytest.mark.parametrize("near, dimension", [(8, 16), (2, 16), (15, 11), (3, 5)])
def test_clusters_and_widths(make, near, dimension, monkeypatch):
    """Also dimensions that eight does not divide or that leave parts empty."""
    monkeypatch.setattr(code_compression, "MOST_NEAR", near)
    rows = clustered(400, dimension)
    assert found(make(rows, SCHEMA)) == expected(rows)


def test_bounds_settle_parts_and_lists_shrink(make):
    rows = clustered(600, 16)
    whole, dimension = code_compression.whole_numbers(make(rows, SCHEMA), "vec_id", "embedding", "label")
    state, step, widths = code_compression.train(whole, dimension)
    assert widths[0] == 8 and min(widths) < 8 and step.width <= widths[-1]
    assert state.count() == 600 and len(state.first().near) == 8 * widths[-1]


def test_bounds_hold():
    """Random walks of codebooks: bounds never exceed what they bound, entries are the nearest."""
    generator = np.random.default_rng(2)
    rows, codebook = generator.integers(-50, 50, (200, 3)), generator.integers(-50, 50, (16, 3))
    held = code_compression.measured(rows, codebook, 6)
    for width in (6, 6, 4, 4, 2, 2):
        following = codebook + generator.integers(-4, 5, codebook.shape)
        moves = code_compression.root_ceiling(code_compression.squared(codebook, following))
        codebook = following
        held, depths = code_compression.settled(rows, codebook, code_compression.moved(code_compression.narrowed(held, width), moves))
        squares = ((rows[:, None] - codebook[None]) ** 2).sum(axis=2)
        assert (held.entry == squares.argmin(axis=1)).all() and (held.upper**2 >= squares.min(axis=1)).all()
        assert (held.lower**2 <= np.take_along_axis(squares, held.near, axis=1)).all() and (np.diff(held.lower, axis=1) >= 0).all()
        outside = [set(range(16)) - {entry, *near} for entry, near in zip(held.entry.tolist(), held.near.tolist())]
        assert all(min(squares[place, list(others)]) >= held.outer[place] ** 2 for place, others in enumerate(outside))
        assert len(depths) < 200


def test_exact_roots():
    squares = np.array([0, 1, 2, 3, 4, 8, 9, (1 << 59) - 1, (1 << 58), (1 << 29) ** 2 - 1, (1 << 29) ** 2 + 1], dtype=np.int64)
    assert code_compression.root_floor(squares).tolist() == [math.isqrt(int(x)) for x in squares]
    assert code_compression.root_ceiling(squares).tolist() == [math.isqrt(int(x)) + (math.isqrt(int(x)) ** 2 < int(x)) for x in squares]


def test_awkward_rows(make):
    nan, infinite = float("nan"), float("inf")
    rows = [(key, [key / 7, -key / 3, 0.5, 1e-9, -0.0, 100.0, float(key % 3), 2.0], key % 2 or None) for key in range(-20, 20)]
    rows += [(3, [0.0] * 8, 1), (3, [9.0] * 8, None), (None, [1.0] * 8, 1), (None, [1.0] * 8, 1)]
    dropped = [(500, None, 1), (501, [1.0, None] * 4, 1), (502, [nan] * 8, 1), (503, [infinite] * 8, 1), (504, [-infinite] * 8, 1)]
    assert found(make(rows + dropped, SCHEMA)) == expected(rows)
    # Another dimension, no component, and components too large to square take no part.
    others = [(600, [1.0] * 9, 1), (601, [], 1), (602, [1e300] * 8, 1), (603, [1e6] * 8, 1)]
    assert found(make(rows + others, SCHEMA)) == expected(rows)
    # Fewer ids than entries, equal vectors throughout, and none.
    assert found(make(rows[:3], SCHEMA)) == expected(rows[:3])
    assert found(make([(key, [0.25] * 8, None) for key in range(30)], SCHEMA)) == expected([(key, [0.25] * 8, None) for key in range(30)])
    assert found(make(dropped, SCHEMA)) == [] and found(make([], SCHEMA)) == []


def test_many_labels_are_joined(make, monkeypatch):
    monkeypatch.setattr(code_compression, "BROADCAST_LABELS", 0)
    rows = clustered(60, 8)
    frame = make(rows, SCHEMA)
    assert found(frame) == expected(rows)
    assert found(frame.withColumn("label", F.col("label").cast("string"))) == expected(rows)
