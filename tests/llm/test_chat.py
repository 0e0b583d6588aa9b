import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from scorewright.llm import chat
from tests.llm.conftest import ODD

PARTS = ["</s>", "<s>", "[INST]", "[/INST]", " [/INST]", "<s>[INST] ", "\\", "<\\s>", "<", "/s>", "s>", "\n", "ok", "[", "é\U0001f600", "$1", " "]


def digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def check(spark, table):
    """table: conv_id -> turns"""
    rows = [(c, k, r, t) for c, turns in table.items() for k, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    made = chat.format_conversations(df)
    back = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    strings = {r["conv_id"]: r for r in made.collect()}
    assert set(back) == set(table)
    for c, turns in table.items():
        turns = [(r or "", t or "") for r, t in turns]
        loss = "".join(t for r, t in turns if r == "assistant")
        r = back[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), digest(turns))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == len(strings[c]["formatted"])
        assert strings[c]["formatted"].count("</s>") == len(turns) == strings[c]["formatted"].count("<s>")


def test_odd_conversations(spark):
    check(spark, {
        1: [("user", "hi"), ("assistant", "hello"), ("user", "x"), ("assistant", "y")],
        -1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")],
        2: [(None, None), ("", ""), ("system", "only")],
        3: [("assistant", t) for t in ODD[:7]],
        4: [("assistant", "a\\"), ("as[/INST]sistant", "\\\\<s>"), ("assistant", "<\\s>")],
    })


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a</s>b", "\\"]), st.lists(st.sampled_from(PARTS), max_size=6).map("".join)), min_size=1, max_size=5), min_size=1, max_size=12))
def test_any_conversation_reads_back(spark, conversations):
    check(spark, dict(enumerate(conversations)))


def test_ties_null_ids_and_empty(spark):
    schema = "conv_id long, turn long, role string, text string, written string"
    df = spark.createDataFrame([(1, 0, "user", "b", "?"), (1, 0, "user", "a", "?"), (1, 0, "user", "a", "?"), (None, None, "user", "n", "?")], schema)
    got = {r["conv_id"]: r["turns_sha256"] for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert got == {1: digest([("user", "a"), ("user", "a"), ("user", "b")]), None: digest([("user", "n")])}
    assert chat.read_back(chat.format_conversations(df.limit(0))).collect() == []
