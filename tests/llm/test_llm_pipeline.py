"""The corpus pipeline, stage by stage on each stage's own input."""

import random

import public_tokenizers
from conftest_llm import documents
from pyspark.sql import functions as F
from test_llm_repeats import expected as without_repeats
from test_llm_join import expected as similar
from test_llm_join import near_copies
from test_llm_simhash import expected as close
from test_llm_tokens import check_packing
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from profilum.llm import near_copies as near_copies_of
from profilum.llm import ngram_join
from profilum.sources.store import write_version

FOLDER = "/root/testdata/sf0.001"


def rows_of(frame):
    return [(row.doc_id, row.text) for row in frame.collect()]


def least_ids(rows):
    """The smallest ids of groups that fingerprints two bits apart or similar sets of five words connect."""
    rows = [(place, text) for place, (_, text) in enumerate(rows)], [key for key, _ in rows]
    above = list(range(len(rows[1])))

    def root(place):
        while above[place] != place:
            place = above[place]
        return place

    for links in (close(rows[0]), similar(rows[0], 5, 80)):
        for place, _, other in links:
            above[root(place)] = root(other)
    groups = {}
    for place, key in enumerate(rows[1]):
        groups.setdefault(root(place), []).append(key)
    return [min(key for key in keys if key is not None) for keys in groups.values() if any(key is not None for key in keys)]


def check_stages(spark, docs):
    columns = docs.columns
    (_, language), (_, duplicates), (_, strings), (_, pack) = corpus_pipeline.STAGES

    kept = language(spark, docs, FOLDER).cache()
    assert kept.columns == columns and kept.where("lang IS NULL").count() == 0
    assert sorted(rows_of(kept), key=repr) == sorted([(key, text) for key, text in rows_of(docs) if any(map(str.isalpha, text or ""))], key=repr)

    single = duplicates(spark, kept, FOLDER).cache()
    assert single.columns == columns
    assert sorted(key for key, _ in rows_of(single) if key is not None) == sorted(least_ids(rows_of(kept)))

    cut = strings(spark, single, FOLDER).cache()
    assert cut.columns == columns and cut.count() == single.count()
    sizes = sorted((key, size - gone) for key, size, gone, _, _ in without_repeats([row for row in rows_of(single) if row[0] is not None], corpus_pipeline.REPEATED_BYTES))
    left = sorted((key, len((text or "").encode())) for key, text in rows_of(cut) if key is not None)
    assert all(own == other and 0 <= size - least <= 3 * 40 for (own, least), (other, size) in zip(sizes, left))
    assert cut.where(F.col("n_chars") != F.length("text")).count() == 0

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = pack(spark, cut, FOLDER).withColumnRenamed("doc_id", "id").collect()
    check_packing(rows_of(cut), pieces, tokenizer)
    return len(pieces)


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    pieces = check_stages(spark, docs)
    assert len(documents("sf0.001")) == docs.count()
    assert contract.queries()["pipeline"](spark, FOLDER).count() == pieces


def test_near_copies_and_passages(spark, make):
    """Copies of a similarity of 0.8 and more go, distinct texts stay; passages of 51 words and more go wherever they repeat."""
    rows = near_copies()
    frame = make(rows, "doc_id long, text string")
    kept = rows_of(corpus_pipeline.near_duplicates(spark, frame, FOLDER))
    assert sorted(key for key, _ in kept) == sorted(least_ids(rows))
    random.seed(2)
    words = [documents("sf0.001")[place][1].split() for place in range(40)]
    texts = [" ".join(random.sample(sorted({word for text in words for word in text}), 300)) for _ in range(6)]
    passages = [" ".join(random.sample(sorted({word for text in words for word in text}), size)) for size in (51, 60)]
    planted = [(place, f"{text[:300]} {passages[place % 2]} {text[300:]}", 0) for place, text in enumerate(texts)]
    cut = corpus_pipeline.repeated_strings(spark, make(planted, "doc_id long, text string, n_chars long"), FOLDER).collect()
    assert all(len(passage) >= corpus_pipeline.REPEATED_BYTES for passage in passages)
    assert all(passages[row.doc_id % 2][20:-20] not in row.text and row.text.startswith(texts[row.doc_id][:300]) for row in cut)


def test_awkward_rows(spark, awkward):
    check_stages(spark, awkward)


def test_empty_table(spark, empty):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.count() == 0


def test_languages_are_found_once(spark, awkward):
    """The filter on the language does not send every text to a second Python worker."""
    plan = corpus_pipeline.language_id(spark, awkward, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_texts_that_stay_do_not_move(spark, make, monkeypatch):
    """Rows that stay and are there once are not among those looked up; repeated rows stay once."""
    rows = near_copies()
    rows += rows[-3:] + [(1000, None), (1000, None), (None, "of no number"), (None, "of no number")]
    frame = make(rows, "doc_id long, text string")
    looked, filtering = [], near_copies_of.key_filter
    monkeypatch.setattr(near_copies_of, "key_filter", lambda some, *rest, **options: (looked.append(some.count()), filtering(some, *rest, **options))[1])
    kept = corpus_pipeline.near_duplicates(spark, frame, FOLDER)
    assert sorted([key for key, _ in rows_of(kept)], key=repr) == sorted([*least_ids(rows), None], key=repr)
    several = {row for row in rows if rows.count(row) > 1}
    assert looked == [len(set(rows) - {(row.doc_id, row.text) for row in kept.collect()} | several)]


def test_tables_that_grow_with_the_documents_are_not_sent_around(spark, monkeypatch):
    plans = {}

    def recorded(frame, name):
        plans.setdefault(name, frame._jdf.queryExecution().executedPlan().toString())
        return write_version(frame, name)

    for module in (near_copies_of, ngram_join):
        monkeypatch.setattr(module, "write_version", recorded)
    kept = near_copies_of.one_per_group(documents_of(spark))
    plans["kept"] = kept._jdf.queryExecution().executedPlan().toString()
    for name in ("entries", "mixed-members", "class-roots", "others", "kept"):
        assert "SortMergeJoin" in plans[name] and "Broadcast" not in plans[name], name


def documents_of(spark):
    words = [f"w{place}" for place in range(40)]
    rows = [(place, " ".join(words[place % 5 : 30 + place % 7])) for place in range(30)]
    return spark.createDataFrame(rows, "doc_id long, text string")
