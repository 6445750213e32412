"""The join of similar documents against comparing all of them."""

import random

import numpy as np
import pytest
from conftest_llm import documents
from pyspark.sql import functions as F

from profilum.llm import ngram_join
from profilum.llm.ngram_join import Rule
from profilum.llm.queries import QUERIES


def shingles(text, width):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[place : place + width]) for place in range(max(1, len(words) - width + 1))} if words else set()


def expected(rows, width=3, percent=90):
    """``id, n_shingles, component_id`` of ``id, text`` by comparing all pairs of sets that share a shingle."""
    sets = [frozenset(shingles(text, width)) for _, text in rows]
    distinct = sorted({one for one in sets if one}, key=sorted)
    above = {one: one for one in distinct}

    def root(one):
        while above[one] is not one:
            one = above[one]
        return one

    holders = {}
    for one in distinct:
        for other in {other for shingle in one for other in holders.get(shingle, ())}:
            shared = len(one & other)
            if 100 * shared >= percent * (len(one) + len(other) - shared):
                above[root(one)] = root(other)
        for shingle in one:
            holders.setdefault(shingle, []).append(one)
    least = {}
    for (key, _), one in zip(rows, sets):
        if one and key is not None:
            least[root(one)] = min(key, least.get(root(one), key))
    return sorted([(key, len(one), least.get(root(one)) if one else key) for (key, _), one in zip(rows, sets)], key=repr)


def found(frame, **options):
    return sorted([tuple(row) for row in ngram_join.join(frame, **options).collect()], key=repr)


def test_query(spark):
    result = sorted([tuple(row) for row in QUERIES["op13_ngram_join"](spark, "/root/testdata/sf0.001").collect()], key=repr)
    assert result == expected(documents("sf0.001"))


def edited(words, count):
    words = list(words)
    for _ in range(count):
        place = random.randrange(len(words))
        words[place : place + 1] = random.choice([[], [f"new{random.randrange(10**6)}"], [words[place], "more"]])
    return words


def near_copies():
    """Copies at similarities around the threshold, chains of edits, a passage in many texts, short texts."""
    random.seed(9)
    vocabulary = [f"w{place}" for place in range(400)]
    passage = random.choices(vocabulary, k=60)
    rows = []
    for _ in range(40):
        words = random.choices(vocabulary, k=random.choice([5, 12, 40, 90, 200]))
        for _ in range(random.randint(1, 6)):
            rows.append(words)
            words = edited(words, random.choice([0, 1, 1, 2, 3]))
    rows += [passage + random.choices(vocabulary, k=size) for size in [0, 1, 2, 3, 4, 5, 8, 20, 60, 300] for _ in range(4)]
    rows += [edited(passage, 1) for _ in range(25)]
    return [(key, " ".join(words).upper() if key % 3 else " \t".join(words)) for key, words in enumerate(rows)]


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80), (1, 60), (2, 100)])
def test_near_copies(make, width, percent):
    rows = near_copies()
    assert found(make(rows, "doc_id long, text string"), rule=Rule(width, percent)) == expected(rows, width, percent)


def test_large_groups_cost_their_size(make):
    """Many copies of one text with an edit each, and a text that shares its prefix shingles with another part of them."""
    random.seed(3)
    words = [f"w{place}" for place in range(120)]
    rows = [(key, " ".join(edited(words, 1))) for key in range(700)] + [(900 + key, " ".join(edited(words, 6))) for key in range(10)]
    frame = make(rows, "doc_id long, text string")
    joining = ngram_join.Join(frame, "doc_id", "text", Rule())
    first = joining.leader_pairs().distinct().count()
    linked = joining.verified(joining.leader_pairs())
    rest = joining.pairs_left(ngram_join.components(linked).withColumnRenamed("vertex", "class")).distinct().count()
    assert first < 20 * len(rows) and rest < 20 * len(rows) < len(rows) ** 2 / 20
    assert found(frame) == expected(rows)


def test_awkward_rows(awkward, empty, make):
    rows = [(row.doc_id, row.text) for row in awkward.select("doc_id", "text").collect()]
    assert found(awkward) == expected(rows)
    assert found(empty) == []
    short = [(1, "a b"), (2, "A  B"), (3, "a"), (4, "a b c"), (5, "a b c"), (None, "a b c"), (None, "only null"), (6, ""), (7, None), (None, None), (8, "a\x1cb"), (8, "É"), (9, "é")]
    assert found(make(short, "doc_id long, text string")) == expected(short)
    names = make([("x", "one two three"), ("b", "one two three"), (None, "four")], "doc_id string, text string")
    assert sorted([tuple(row) for row in ngram_join.join(names).collect()], key=repr) == sorted([("x", 1, "b"), ("b", 1, "b"), (None, 1, None)], key=repr)


@pytest.mark.parametrize("rule", [Rule(), Rule(5, 80)])
def test_sketches_tell_long_sets_apart(spark, rule):
    """Unlike sets of any size fill more bins than linked ones may; bins never overstate a difference, also folded."""
    random_sets = np.random.default_rng(5)
    rows = []
    for size in (200, 1240, 4000, 30_000):
        one, other = (np.unique(random_sets.integers(0, 1 << 63, size, dtype=np.uint64)) for _ in range(2))
        near = np.union1d(one[: size - size // 20], other[: size // 50])
        for second, alike in ((other, False), (np.union1d(other[: size // 2], one[size // 2 :]), False), (near, True), (one[: size - size // 12], True)):
            sketches = [ngram_join.sketch(values, rule.bins(len(values))).tolist() for values in (one, second)]
            rows.append((*sketches, len(one) + len(second), len(np.setxor1d(one, second)), alike))
    frame = spark.createDataFrame(rows, "u array<long>, v array<long>, sizes long, apart long, alike boolean")
    bins = ngram_join.differing(F.col("u"), F.col("v"))
    for row in frame.select("sizes", "apart", "alike", bins.alias("bins"), rule.apart(F.col("sizes")).alias("most")).collect():
        assert row.bins <= row.apart and (row.bins <= row.most) == row.alike
    assert len({len(row[0]) for row in rows}) > 2 and any(len(row[0]) != len(row[1]) for row in rows)
