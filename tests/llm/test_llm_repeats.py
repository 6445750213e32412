"""Removal of repeated strings against counting all of them."""

import hashlib
import random
from collections import Counter

import pytest
from conftest_llm import documents

from profilum.llm import repeats
from profilum.llm.queries import QUERIES
from profilum.llm.suffixes import repeated_windows, suffix_array


def expected(rows, length):
    data = [(key, (text or "").encode()) for key, text in rows]
    times = Counter(text[place : place + length] for _, text in data for place in range(len(text) - length + 1))
    result = []
    for key, text in data:
        covered, done = bytearray(len(text)), 0
        for place in range(len(text) - length + 1):
            if times[text[place : place + length]] > 1:
                begin = max(place, done)
                covered[begin : place + length] = b"\1" * (place + length - begin)
                done = place + length
        kept = bytes(byte for byte, gone in zip(text, covered) if not gone)
        spans = sum(covered[place] and not (place and covered[place - 1]) for place in range(len(text)))
        result.append((key, len(text), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(result, key=repr)


def found(frame):
    return sorted(((row.id, row.n_bytes, row.n_removed, row.n_spans, row.kept_sha256) for row in frame.collect()), key=repr)


@pytest.mark.parametrize("dense", [2, 512])
def test_equals_brute_force(spark, dense, monkeypatch):
    monkeypatch.setattr(repeats, "DENSE", dense)
    query = QUERIES["op4_suffix_dedup"](spark, "/root/testdata/sf0.001").withColumnRenamed("doc_id", "id")
    assert found(query) == expected(documents("sf0.001"), 400)


def texts():
    random.seed(8)
    passage = "".join(random.choice("abcé ") for _ in range(90))
    rows = [(place, "".join(random.choice("abcd é") for _ in range(random.randint(0, 200)))) for place in range(40)]
    rows += [(100 + place, text[:cut] + passage + text[cut:]) for place, (_, text) in enumerate(rows[:15]) for cut in [random.randint(0, len(text))]]
    return rows + [(200, "z" * 300), (201, "ab" * 100), (202, passage + passage), (203, None), (204, ""), (None, passage), (None, passage), (205, passage[1:60]), (205, passage[1:60])]


@pytest.mark.parametrize("length, gram, dense, block", [(40, 8, 512, 1 << 19), (40, 40, 2, 1 << 19), (25, 10, 512, 64)])
def test_short_strings(make, length, gram, dense, block, monkeypatch):
    """Periodic texts, passages in other texts and twice in one, repeated rows, texts longer than a stretch."""
    monkeypatch.setattr(repeats, "DENSE", dense)
    monkeypatch.setattr(repeats, "_BLOCK", block)
    frame = make(texts(), "doc_id long, text string")
    assert found(repeats.digests(repeats.remove(frame, length=length, gram=gram))) == expected(texts(), length)


def test_few_windows_of_dense_anchors_are_counted(make, monkeypatch):
    """A passage in many contexts: only windows near its ends meet one by one, the others as parts of equal pieces."""
    random.seed(5)
    passage = "".join(random.choice("abcdefgh ") for _ in range(300))
    rows = [(place, "".join(random.choice("abcdefgh ") for _ in range(200)) + passage + "".join(random.choice("abcdefgh ") for _ in range(200))) for place in range(40)]
    monkeypatch.setattr(repeats, "DENSE", 8)
    written, write = {}, repeats.write_version
    monkeypatch.setattr(repeats, "write_version", lambda frame, name: written.setdefault(name, write(frame, name)))
    assert found(repeats.digests(repeats.remove(make(rows, "doc_id long, text string"), length=120, gram=20))) == expected(rows, 120)
    windows = written["dense"].selectExpr("sum(length(content) - 119)").first()[0]
    assert 0 < written["windows"].count() < windows / 3


def test_suffix_arrays():
    random.seed(3)
    for _ in range(300):
        alphabet = random.choice([b"ab", b"abc", bytes(range(256)), b"\0\xff"])
        strings = [bytes(random.choice(alphabet) for _ in range(random.randint(0, 40))) for _ in range(random.randint(1, 6))]
        length = random.choice([1, 3, 5, 8, 9, 12])
        times = Counter(string[place : place + length] for string in strings for place in range(len(string) - length + 1))
        flags = [[times[string[place : place + length]] > 1 for place in range(len(string) - length + 1)] for string in strings]
        assert [row.tolist() for row in repeated_windows(strings, length)] == flags
    string = bytes(random.choice(b"abc") for _ in range(500))
    places = [place for place in suffix_array([string], 500).tolist() if place < 500]
    assert places == sorted(range(500), key=lambda place: string[place:])


def test_awkward_rows(awkward, empty):
    rows = [(row.doc_id, row.text) for row in awkward.select("doc_id", "text").collect()]
    assert found(repeats.digests(repeats.remove(awkward))) == expected(rows, 400)
    assert repeats.remove(empty).count() == 0 and repeats.clean(empty).count() == 0


def test_clean_keeps_whole_characters(make):
    shared = "é" * 30
    frame = make([(1, f"a{shared}b"), (2, f"è{shared}ê"), (3, "alone")], "doc_id long, text string")
    cleaned = repeats.clean(frame, length=40, gram=8)
    assert cleaned.columns == frame.columns
    assert {row.doc_id: row.text for row in cleaned.collect()} == {1: "ab", 2: "èê", 3: "alone"}
