"""Language identification against a plain walk down the context trees, and by held-out accuracy."""

import math
import random
import zlib
from collections import Counter

import numpy as np
from conftest_llm import rows
from pyspark.sql import functions as F

from profilum.llm import language
from profilum.llm.queries import QUERIES


def code_length(trees, text, order):
    total, data = 0, b"\n" * order + text
    for place in range(order, len(data)):
        for depth in range(order, -2, -1):
            if depth < 0:
                total += 8 * language.UNIT
                break
            follows = trees[depth].get(data[place - depth : place])
            if follows is None:
                continue
            times, kinds = sum(follows.values()), len(follows)
            if data[place] in follows:
                total += round(language.UNIT * math.log2((times + kinds) / follows[data[place]]))
                break
            total += round(language.UNIT * math.log2((times + kinds) / kinds))
    return total


def test_code_lengths(monkeypatch):
    random.seed(5)
    for block in (50, 1 << 19):
        monkeypatch.setattr(language, "_BLOCK", block)
        for _ in range(30):
            order = random.choice([2, 4])
            made = lambda size: bytes(random.choice(b"abc d\n\xc3\xa9") for _ in range(random.randint(1, size)))
            learned = {name: [made(60) for _ in range(4)] for name in "xyz"}
            counts, trees = {}, {}
            for name, texts in learned.items():
                counts[name] = np.unique(np.concatenate([language.grams(np.frombuffer(b"\n" * order + text, dtype=np.uint8), order) for text in texts]), return_counts=True)
                trees[name] = [{} for _ in range(order + 1)]
                for text in texts:
                    data = b"\n" * order + text
                    for place in range(order, len(data)):
                        for depth in range(order + 1):
                            trees[name][depth].setdefault(data[place - depth : place], Counter())[data[place]] += 1
            texts = [made(200) + bytes([random.randrange(256)]) for _ in range(5)]
            expected = [[code_length(trees[name], text, order) for name in "xyz"] for text in texts]
            assert language.Model(counts, order).code_lengths(texts).tolist() == expected


def test_held_out_accuracy(spark):
    truth = {key: lang for key, lang in rows("sf0.01", "documents", "doc_id, lang")}
    found = QUERIES["op5_language"](spark, "/root/testdata/sf0.01").collect()
    assert len(found) == len(truth)
    assert all(row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 5 == 0) and 0 <= row.score <= 1 for row in found)
    judged = [row.lang_pred == truth[row.doc_id] for row in found if row.held_out]
    assert sum(judged) / len(judged) > 0.97


def test_labels_are_no_input(spark):
    """Held-out rows are predicted alike whatever their label says."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    blind = docs.withColumn("lang", F.when(language.learnable(), F.col("lang"))).withColumn("source", F.lit("?"))
    assert sorted(map(tuple, language.identify(docs).collect())) == sorted(map(tuple, language.identify(blind).collect()))


def test_awkward_rows(awkward, empty):
    found = language.identify(awkward).collect()
    assert len(found) == awkward.count()
    texts = Counter((row.doc_id, any(map(str.isalpha, row.text or ""))) for row in awkward.collect())
    assert Counter((row.id, row.lang_pred != "und") for row in found) == texts
    assert all(row.held_out is False for row in found if row.id is None)
    assert language.identify(empty).count() == 0


def test_nothing_learned(make):
    found = language.identify(make([(1, "some text", None), (2, None, "en"), (None, "text", "en")], "doc_id long, text string, lang string")).collect()
    assert {(row.lang_pred, row.score) for row in found} == {("und", 0.0)}


def made_languages(names, texts):
    """Rows of languages that each have words of their own."""
    draw = random.Random(4)
    words = {name: ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)] for name in names}
    return words, [(key, " ".join(draw.choices(words[name], k=12)), name) for key, name in enumerate(name for name in names for _ in range(texts))]


def test_every_label_is_learned(make, monkeypatch):
    """More languages than were once learned, in one group and in many."""
    _, table = made_languages([f"l{place:02}" for place in range(70)], 8)
    truth = {key: name for key, _, name in table}
    runs = []
    for cells in (language.GROUP_CELLS, 20_000):
        monkeypatch.setattr(language, "GROUP_CELLS", cells)
        found = language.identify(make(table, "doc_id long, text string, lang string")).collect()
        assert {row.id: row.lang_pred for row in found} == truth
        runs.append({row.id: row.score for row in found})
    assert all(math.isclose(score, runs[1][key], rel_tol=1e-9) for key, score in runs[0].items())


def test_one_long_text_is_no_sample(spark, make, monkeypatch):
    """Each language has one long text in the next one's words, whose hash comes before those of the others."""
    monkeypatch.setattr(language, "BYTES", 2000)
    names = [f"l{place}" for place in range(4)]
    words, table = made_languages(names, 40)
    ids = spark.range(5000, 15_000).withColumnRenamed("id", "doc_id").where(language.learnable())
    long = []
    for place, name in enumerate(names):
        text = " ".join(words[names[(place + 1) % 4]] * 100)
        long.append((ids.orderBy(F.xxhash64("doc_id", F.lit(text))).first()["doc_id"], text, name))
    found = language.identify(make(table + long, "doc_id long, text string, lang string")).collect()
    truth = {key: name for key, _, name in table}
    assert {row.id: row.lang_pred for row in found if row.id in truth} == truth
