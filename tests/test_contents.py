"""Contents in parts: literal ids and masks, and every way a conversation can be wrong."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from cairnwork.operators import contents as T
from cairnwork.operators.conversation import render
from cairnwork.sources import readers

USER = {"role": "user", "content": "2+2?"}
TOOL = {"role": "assistant", "content": [{"type": "text", "text": "é"}, {"type": "python", "text": "2+2"}, {"type": "python_output", "text": "4"}, {"type": "text", "text": ""}]}


def rendered(spark, *conversations, **how):
    d = spark.createDataFrame([(k, c if isinstance(c, str) else json.dumps(c)) for k, c in enumerate(conversations)], "id int, line string")
    return [r["r"] for r in d.select("id", T.render_typed(T.checked(T.typed_messages(F.col("line"))), **how).alias("r")).orderBy("id").collect()]


def test_parts_are_rendered_between_their_marks(spark):
    system = [{"role": "system", "content": "S"}, USER, TOOL]
    a, b, c = rendered(spark, {"messages": [USER, TOOL], "other": 1}, system, [USER])
    call, out = [261, *b"2+2", 262], [263, *b"4", 264]
    asked = [256, 257, *b"2+2?", 258]
    assert a["ids"] == [*asked, 259, *"é".encode(), *call, *out, 260]
    assert a["mask"] == [0] * len(asked) + [0, 1, 1] + [1] * 5 + [0] * 3 + [1]
    assert b["ids"] == [256, 257, *b"S\n\n2+2?", *a["ids"][6:]] and c["ids"] == asked and c["mask"] == [0] * 7
    (short,) = rendered(spark, [USER, TOOL], most=10)
    assert (short["ids"], short["mask"]) == (a["ids"][:10], a["mask"][:10])


def test_texts_alone_are_rendered_as_before(spark):
    d = spark.createDataFrame([([("system", "a"), ("user", "b"), ("assistant", "c"), ("user", "")],)], "messages array<struct<role:string,content:string>>")
    r = d.select(render(F.col("messages")).alias("a"), T.render_typed(T.checked(T.plain_messages(F.col("messages")))).alias("b")).first()
    assert r["a"] == r["b"]


def test_completion_leaves_the_last_answer_out(spark):
    d = spark.createDataFrame([(json.dumps([USER, TOOL, USER, TOOL]),)], "line string").select(T.typed_messages(F.col("line")).alias("m"))
    ids = d.select(T.render_typed_for_completion(F.col("m")).alias("ids"), T.render_typed(F.slice("m", 1, 3)).alias("r")).first()
    assert ids["ids"] == [*ids["r"]["ids"], 259]
    with pytest.raises(Exception, match="isn't from the assistant"):
        d.select(T.render_typed_for_completion(F.slice("m", 1, 3))).collect()


WRONG = [
    ("no json", "no messages"), ("[]", "no messages"), ("{}", "no messages"), ([{"role": "system", "content": "S"}], "a system message isn't followed by a user's"),
    ([{"role": "system", "content": []}, USER], "a system message is no text"), ([TOOL], "message 0 is from assistant, not from user"), ([USER, USER], "message 1 is from user, not from assistant"),
    ([USER, {"content": "x"}], "message 1 is from nobody, not from assistant"), ([{"role": "user", "content": [{"type": "text", "text": "x"}]}], "message 0 of the user is no text"),
    ([USER, {"role": "assistant", "content": 7}], "message 1 is neither text nor parts"), ([USER, {"role": "assistant", "content": None}], "message 1 is neither text nor parts"),
    ([USER, {"role": "assistant", "content": [{"type": "image", "text": "x"}]}], "message 1 has a part of type image or without text"), ([USER, {"role": "assistant", "content": [{"type": "text"}]}], "message 1 has a part of type text or without text"),
]


def test_what_is_wrong_is_told(spark):
    d = spark.createDataFrame([(k, c if isinstance(c, str) else json.dumps(c)) for k, (c, _) in enumerate(WRONG)], "id int, line string")
    got = [r["p"] for r in d.select("id", T.problem(T.typed_messages(F.col("line"))).alias("p")).orderBy("id").collect()]
    assert got == [w for _, w in WRONG]
    with pytest.raises(Exception, match="of type image"):
        rendered(spark, WRONG[-2][0])


def test_files_of_typed_conversations(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    path.write_text(json.dumps([USER, TOOL]) + "\n\n" + json.dumps({"messages": [USER]}) + "\n")
    assert [len(r["messages"]) for r in readers.typed_conversations(spark, str(path)).collect()] == [2, 1]
    path.write_text(json.dumps([USER, USER]))
    with pytest.raises(Exception, match="message 1 is from user"):
        readers.typed_conversations(spark, str(path)).collect()
