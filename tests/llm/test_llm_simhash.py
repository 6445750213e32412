"""SimHash near duplicates against a comparison of all fingerprints."""

import random
import re

import numpy as np
import pytest
import xxhash
from conftest_llm import documents
from pyspark.sql import functions as F

from profilum.llm import components as components_of
from profilum.llm import golay, simhash
from profilum.llm.components import components
from profilum.llm.queries import QUERIES
from profilum.sources.store import write_version


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda match: match.group().lower(), text or ""))
    shingles = [" ".join(words[place : place + 3]) for place in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(shingle.encode(), 42) for shingle in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(value >> bit & 1 for value in hashes) > len(hashes))


def expected(rows):
    prints = [(key, fingerprint(text)) for key, text in rows]
    values = sorted({value for _, value in prints})
    above = {value: value for value in values}

    def root(value):
        while above[value] != value:
            value = above[value]
        return value

    array = np.array(values, dtype=np.uint64)
    for value in values:
        for place in np.flatnonzero(np.bitwise_count(array ^ np.uint64(value)) <= 2):
            above[root(values[place])] = root(value)
    least = {}
    for key, value in prints:
        if key is not None:
            least[root(value)] = min(key, least.get(root(value), key))
    return sorted(((key, f"{value:016x}", least.get(root(value))) for key, value in prints), key=repr)


def found(frame):
    return sorted(((row.id, f"{row.fingerprint & (1 << 64) - 1:016x}", row.component_id) for row in frame.collect()), key=repr)


@pytest.mark.parametrize("dense", [1, 256])
def test_equals_brute_force(spark, dense, monkeypatch):
    monkeypatch.setattr(simhash, "DENSE", dense)
    rows = documents("sf0.001")
    query = QUERIES["op3_simhash"](spark, "/root/testdata/sf0.001")
    assert sorted((tuple(row) for row in query.collect()), key=repr) == expected(rows)


def test_components_end_as_stars(spark, monkeypatch):
    """Stars need no round, whatever else links them is found in a few; null ends and loops say nothing."""
    rounds, write = [], components_of.write_version
    monkeypatch.setattr(components_of, "write_version", lambda frame, name: (rounds.append(name), write(frame, name))[1])

    def roots(rows):
        rounds.clear()
        return sorted(tuple(row) for row in components(spark.createDataFrame(rows, "u long, v long")).collect())

    star = [(1, 5), (1, 6), (7, 1), (7, 1), (2, 2), (None, 3), (4, None), (8, 9)]
    assert roots(star) == [(1, 1), (5, 1), (6, 1), (7, 1), (8, 8), (9, 8)]
    assert rounds == ["links"]
    random.seed(6)
    chain = [(place, place + 1) for place in range(100, 140)]
    rows = chain + [(random.randint(200, 300), random.randint(200, 300)) for _ in range(60)] + [(400, place) for place in range(401, 430)] + [(399, 429)]
    random.shuffle(rows)
    above = {end: end for row in rows for end in row if row[0] != row[1]}
    for _ in range(len(above)):
        for u, v in rows:
            if u != v:
                above[u] = above[v] = min(above[u], above[v])
    assert roots(rows) == sorted(above.items())
    assert len(rounds) > 1


@pytest.mark.parametrize("dense", [2, 256])
def test_links_of_close_and_distant_values(spark, dense, monkeypatch):
    """Clouds of values around a few centres, some a chain apart."""
    monkeypatch.setattr(simhash, "DENSE", dense)
    random.seed(4)
    centres = [random.getrandbits(64) for _ in range(12)]
    values = sorted({centre ^ sum({1 << random.randrange(64) for _ in range(random.randint(0, 5))}) for centre in centres for _ in range(80)})
    signed = [value - (1 << 64) if value >> 63 else value for value in values]
    links = simhash.links(spark.createDataFrame([(value,) for value in signed], "value long"))
    roots = {row.vertex: row.root for row in components(links).collect()}
    array = np.array(values, dtype=np.uint64)
    groups = {}
    for value, own in zip(values, signed):
        for place in np.flatnonzero(np.bitwise_count(array ^ np.uint64(value)) <= 2):
            assert roots.get(own, own) == roots.get(signed[place], signed[place])
        groups.setdefault(roots.get(own, own), []).append(value)
    for members in groups.values():
        reached, left = [members[0]], set(members[1:])
        for value in reached:
            near = {other for other in left if (value ^ other).bit_count() <= 2}
            reached += near
            left -= near
        assert not left


def test_code_is_perfect():
    """Every error of up to three bits has a syndrome of its own, and all of them do."""
    table, excess = golay.error_table(2)
    assert (table[:, 0] >= 0).all() and len(set(table[:, 0].tolist())) == 2048 and excess[0] == 0
    values = np.array([random.getrandbits(62) for _ in range(200)])
    rows, anchors = golay.near_anchors(values, 2)
    homes = golay.home_anchors(values)
    assert all(homes[row] in anchors[rows == row] for row in range(200))
    flipped = golay.home_anchors(values ^ 5)
    assert all(flipped[row] in anchors[rows == row] for row in range(200))


def test_awkward_rows(awkward, empty):
    rows = [(row.doc_id, row.text) for row in awkward.select("doc_id", "text").collect()]
    assert found(simhash.near_duplicates(awkward)) == expected(rows)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_per_component(empty).count() == 0


def test_one_of_each_group_stays(awkward):
    kept = simhash.one_per_component(awkward)
    assert kept.columns == awkward.columns
    rows = [(row.doc_id, row.text) for row in awkward.select("doc_id", "text").collect()]
    groups = {}
    for (key, value, name), _ in zip(expected(rows), rows):
        groups.setdefault((name, value if name is None else None), []).append(key)
    assert sorted((row.doc_id for row in kept.collect()), key=repr) == sorted((name for name, _ in groups), key=repr)


def test_visits_are_not_sent_around(spark):
    """A value makes up to 69 visits, which Spark's estimate of their size leaves out."""
    values = spark.range(1000).select(F.xxhash64("id").alias("value"))
    plan = simhash.links(write_version(values, "values"))._jdf.queryExecution().executedPlan().toString()
    above = []
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-*"))
        above = [*[(place, name) for place, name in above if place < depth], (depth, line)]
        assert "_visits" not in line or not any("BroadcastExchange" in name for _, name in above)
    assert "_visits" in plan and "SortMergeJoin [anchor" in plan
