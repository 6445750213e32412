"""Periodic runs against trying every period at every place."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from conftest_llm import documents

from profilum.llm import periodic_runs
from profilum.llm.queries import QUERIES
from profilum.llm.words import numbered


def all_runs(words):
    """``start, length, period`` by definition, from the shortest period on."""
    number = {}
    places = np.array([number.setdefault(word, len(number)) for word in words])
    runs = []
    for period in range(1, len(words) // 4 + 1):
        edges = np.flatnonzero(np.diff((places[:-period] == places[period:]).astype(int), prepend=0, append=0))
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            length = end - start + period
            inner = any(one <= start and start + length <= one + size and period % other == 0 for one, size, other in runs)
            if length >= max(6, 4 * period) and not inner:
                runs.append((start, length, period))
    return sorted(runs, key=lambda run: (run[0], run[2]))


def collapsed(words, runs):
    gone = {place for start, length, period in runs for place in range(start + period, start + length)}
    return b" ".join(word for place, word in enumerate(words) if place not in gone)


def planted(key, words):
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 or not words:
        return words
    g = h // 10
    a = g % len(words)
    p = 1 + (len(words) - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]


def expected(key, text):
    words = planted(key, (text or "").encode().split())
    runs = all_runs(words)
    longest = max(runs, key=lambda run: (run[1], -run[0], -run[2]), default=None)
    best = (*longest, 1000 * longest[1] // longest[2]) if longest else (None,) * 4
    lines = "".join(f"{start},{length},{period}\n" for start, length, period in runs)
    return (key, len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs)).hexdigest())


def test_query(spark):
    rows = documents("sf0.001")
    found = sorted([tuple(row) for row in QUERIES["op12_periodic_runs"](spark, "/root/testdata/sf0.001").collect()])
    assert found == sorted(expected(*row) for row in rows)
    assert any(row[1] for row in found)


def texts():
    random.seed(6)
    result = []
    for _ in range(1500):
        alphabet = random.choice([1, 2, 3, 30])
        words = []
        while len(words) < random.choice([0, 3, 30, 150, 700]):
            root = [random.randrange(alphabet) for _ in range(random.choice([1, 1, 2, 3, 4, 5, 7, 8, 9, 13, 16, 21, 33, 64]))]
            if random.random() < 0.3:
                root = root[:1] * random.randint(3, 12) + root
            words += root * random.choice([1, 1, 2, 3, 4, 5, 9]) + root[: random.randrange(len(root))]
            words += [random.randrange(alphabet) for _ in range(random.choice([0, 0, 1, 5]))]
        result.append(" ".join(map(str, words)).encode())
    return result


def test_all_runs_of_wild_texts():
    """Many texts at once, periods of all scales, highly periodic parts inside longer periods, few kinds of words."""
    wild = texts()
    _, numbers, counts = numbered(wild)
    for text, runs in zip(wild, periodic_runs.runs_of(numbers, counts)):
        assert runs == all_runs(text.split()), text


@pytest.mark.parametrize("scale", [2, 4, 8])
def test_synchronising_sets(scale):
    """Equal contexts are chosen alike, and no stretch of ``scale`` places outside periodic parts is without a place."""
    random.seed(scale)
    words = np.array([random.randrange(3) for _ in range(3000)], dtype=np.uint64)
    hashes = periodic_runs._mixed(words)
    width = 1
    while width < scale:
        hashes = periodic_runs._joined(hashes[:-width], hashes[width:])
        width *= 2
    places = set(periodic_runs.chosen(hashes, np.zeros(len(hashes), dtype=bool), scale).tolist())
    contexts = {}
    for place in range(len(words) - 2 * scale + 1):
        contexts.setdefault(tuple(words[place : place + 2 * scale]), set()).add(place in places)
    assert all(len(kinds) == 1 for kinds in contexts.values())
    assert all(any(place in places for place in range(start, start + scale)) for start in range(len(words) - 3 * scale))


def test_awkward_rows(awkward, empty, make):
    rows = [(row.doc_id, row.text) for row in awkward.select("doc_id", "text").collect()]
    rows += [(10, "a " * 40_000), (11, "a b\t\nc\x0b" * 9000), (12, "a a a a a"), (13, "a a a a a a"), (14, "a b a b a b a"), (15, "a b a b a b a b"), (16, "x\x1cy x\x1cy x\xa0y"), (None, "b b b b b b c"), (17, "é " * 7)]
    # Ids whose checksum plants a tail, with texts too short or long enough.
    chosen = [key for key in range(20, 200) if zlib.crc32(str(key).encode()) % 10 == 0]
    rows += [(key, " ".join(f"w{place % 7}x{place}" for place in range(size))) for key, size in zip(chosen, [0, 1, 2, 5, 9, 40, 400])]
    frame = make(rows, "doc_id long, text string")
    found = periodic_runs.digests(periodic_runs.find(periodic_runs.repeated_on_purpose(frame))).collect()
    assert sorted([tuple(row) for row in found], key=repr) == sorted([expected(*row) for row in rows], key=repr)
    assert periodic_runs.find(empty).count() == 0
