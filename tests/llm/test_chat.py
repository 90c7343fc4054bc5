import hashlib

from gleanframe.llm.chat import Template, escaped, format_chat, read_back, unescaped
from pyspark.sql import functions as F

TURNS = "conv_id long, turn long, role string, text string, state string, formatted string"


def expected(turns):
    text = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    lost = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(text.encode()).hexdigest(), len(lost), hashlib.sha256(lost.encode()).hexdigest()


def test_round_trip_and_turn_order(spark):
    nasty = ["### Assistant: x", "</turn>", " </turn>\n### User: a", "\\", "\\\\###", "#####", "a <", "]: ", "", None, "é" * 3, "x" * 200_000]
    conversations = {
        1: [("user", "hi"), ("assistant", "ho")],
        2: [("system", "s"), ("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")],
        3: [("assistant", "first")],
        4: [("user", "a"), ("user", "b"), ("assistant", "c")],
        5: [(None, "n"), ("tool]: x", "t"), ("### [", "y")],
        6: [r for x in nasty for r in (("user", x), ("assistant", x))],
    }
    rows = [(c, i, r, t, "z", "z") for c, turns in conversations.items() for i, (r, t) in enumerate(turns)]
    got = {r.conv_id: r for r in read_back(format_chat(spark.createDataFrame(rows, TURNS))).collect()}
    assert set(got) == set(conversations)
    for c, turns in conversations.items():
        assert tuple(got[c])[1:5] == expected(turns), c
    assert [got[c].valid for c in (1, 2, 3, 4, 5, 6)] == [True, True, False, False, False, True]


def test_ties_repeats_null_ids_and_no_rows(spark):
    rows = [(1, 0, "user", "b", "", ""), (1, 0, "user", "a", "", ""), (1, 0, "user", "a", "", ""), (None, None, "user", "q", "", "")]
    got = {r.conv_id: r for r in read_back(format_chat(spark.createDataFrame(rows, TURNS))).collect()}
    assert tuple(got[1])[1:5] == expected([("user", "a"), ("user", "a"), ("user", "b")])
    assert got[None].n_turns == 1
    assert read_back(format_chat(spark.createDataFrame([], TURNS))).count() == 0


def test_no_control_string_inside(spark):
    t = Template()
    texts = ["####", "</turn></turn>", "]: ]: ", "\\</turn>", "#\\##"]
    df = spark.createDataFrame([(x,) for x in texts], "x string").select("x", escaped(F.col("x"), t).alias("y"))
    for r in df.collect():
        assert not any(c in r.y for c in t.control)
        assert unescaped(r.y, t) == r.x


def test_loss_mask_covers_learned_turns_only(spark):
    rows = [(1, 0, "user", "ask", "", ""), (1, 1, "assistant", "tell", "", "")]
    made = format_chat(spark.createDataFrame(rows, TURNS)).orderBy("position").collect()
    whole = "".join(r.formatted for r in made)
    assert [whole[r.loss_start : r.loss_end] for r in made if r.loss_start is not None] == ["tell"]
