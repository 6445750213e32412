"""Chat formatting against its SQL and by round trips."""

import hashlib

import harness
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from profilum.llm import chat_format
from profilum.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
WILD = st.text(alphabet="<|\\im_startnl>\n aé🙂", max_size=12)


def test_equals_sql(spark):
    assert harness.compare(QUERIES["op2_chat_format"](spark, FOLDER), harness.connect(FOLDER), ORACLES["op2_chat_format"]) is None


def test_main_path_is_native(spark):
    plan = QUERIES["op2_chat_format"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not [bad for bad in ("Python", "Pandas", "Arrow") if bad in plan]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\n<|nl|>", "", "<\\|"]), WILD), min_size=1, max_size=5), min_size=20, max_size=30))
def test_round_trip(spark, conversations):
    rows = [(conv, turn, role, text) for conv, turns in enumerate(conversations) for turn, (role, text) in enumerate(turns)]
    expanded = chat_format.examples(spark.createDataFrame(rows, SCHEMA))
    read = expanded.select("conv_id", "n_turns", "target", "is_last", chat_format.parse(F.col("formatted")).alias("turns"), chat_format.loss_text().alias("loss")).collect()
    for row in read:
        turns = [tuple(turn) for turn in row.turns]
        assert turns == conversations[row.conv_id][: row.n_turns]
        assert row.loss == (None if row.target is None else turns[-1][1])
    for conv, turns in enumerate(conversations):
        targets = sorted(row.target for row in read if row.conv_id == conv and row.target)
        assert targets == [place for place, (role, _) in enumerate(turns, 1) if role == "assistant"]
        assert sum(row.is_last for row in read if row.conv_id == conv) == 1


def test_awkward_rows(make):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "hi"), (1, 1, "assistant", "hi"), (None, 0, None, "x"), (2, None, "assistant", "first"), (2, 0, "user", "long " * 50_000), (3, 0, "system", "")]
    found = {row.conv_id: row for row in chat_format.digests(chat_format.examples(make(rows, SCHEMA))).collect()}
    assert set(found) == {1, None, 2, 3}

    def digest(turns):
        return hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode()).hexdigest()

    assert found[1].turns_sha256 == digest([("user", ""), ("assistant", "hi"), ("assistant", "hi")]) and found[1].loss_chars == 4 and found[1].n_examples == 2
    assert found[None].turns_sha256 == digest([("", "x")]) and found[None].loss_chars == 0
    assert found[2].turns_sha256 == digest([("assistant", "first"), ("user", "long " * 50_000)]) and found[2].loss_chars == 5


def test_empty_table(make):
    assert chat_format.digests(chat_format.examples(make([(1, 0, "user", "x")], SCHEMA).where("turn = 9"))).count() == 0
