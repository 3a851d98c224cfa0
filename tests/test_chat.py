"""Chat sources of all four shapes, over several files, with limits that reach the files."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from cairnwork.sources import chat


def turn(role, text, names=("role", "content")):
    return dict(zip(names, (role, text), strict=True))


FROM = ("from", "value")
ROWS = {
    "messages": [
        {"category": "math", "reward_model_score": 0.5, "messages": [turn("user", "q0"), turn("assistant", "a0"), turn("user", "more")], "difficulty": "easy", "quality": "good", "conversation_tokens": 7},
        {"category": None, "reward_model_score": None, "messages": [turn("user", None), turn("assistant", "a1")], "difficulty": None, "quality": None, "conversation_tokens": None},
        {"category": "x", "reward_model_score": 1.0, "messages": [turn("system", "s"), turn("user", "q")], "difficulty": None, "quality": None, "conversation_tokens": 1},
        {"category": "x", "reward_model_score": 1.0, "messages": [turn("user", "alone")], "difficulty": None, "quality": None, "conversation_tokens": 1},
        {"category": "x", "reward_model_score": 1.0, "messages": None, "difficulty": None, "quality": None, "conversation_tokens": 1},
    ],
    "turns": [{"conversations": [turn("user", "q0", FROM), turn("assistant", "a0", FROM)]}, {"conversations": [turn("assistant", "a", FROM), turn("user", "q", FROM)]}, {"conversations": []}],
    "problem": [{"problem": f"p{k}", "solution": None if k == 2 else f"s{k}"} for k in range(5)],
    "question": [{"question": f"q{k}", "answer": f"a{k}"} for k in range(7)],
}
TYPES = {
    "messages": pa.schema([("category", pa.string()), ("reward_model_score", pa.float64()), ("messages", pa.list_(pa.struct([("role", pa.string()), ("content", pa.string())]))), ("difficulty", pa.string()), ("quality", pa.string()), ("conversation_tokens", pa.int64())]),
    "turns": pa.schema([("conversations", pa.list_(pa.struct([("from", pa.string()), ("value", pa.string())])))]),
    "problem": pa.schema([("problem", pa.string()), ("solution", pa.string())]),
    "question": pa.schema([("question", pa.string()), ("answer", pa.string())]),
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("chat")
    for shape, rows in ROWS.items():
        (top / shape).mkdir()
        for k in range(0, len(rows), 2):  # two rows a file
            pq.write_table(pa.Table.from_pylist(rows[k : k + 2], TYPES[shape]), top / shape / f"part-{k:03d}.parquet")
    return top


def test_pairs_of_each_shape(spark, folder):
    found = chat.read_pairs(spark, {s: (str(folder / s), s, None) for s in ROWS})
    got = {}
    for r in found.orderBy("source", "position").collect():
        got.setdefault(r["source"], []).append(tuple(r)[1:])
    assert got["messages"] == [(0, "math", 0.5, "q0", "a0"), (1, None, 0.0, "", "a1")] and got["turns"] == [(0, None, None, "q0", "a0")]
    assert got["problem"] == [(k, None, None, f"p{k}", "" if k == 2 else f"s{k}") for k in range(5)]
    assert got["question"] == [(k, None, None, f"q{k}", f"a{k}") for k in range(7)]


@pytest.mark.parametrize("limit", [0, 1, 2, 5, 99])
def test_a_limit_reads_only_the_files_that_it_needs(spark, folder, limit):
    d = chat.first_rows(spark, str(folder / "question"), chat.SHAPES["question"], limit)
    rows = sorted((r["position"], r["question"]) for r in d.collect())
    assert rows == [(k, f"q{k}") for k in range(min(limit, 7))]
    scanned = d.select("question", "position").where("question IS NOT NULL")._jdf.queryExecution().optimizedPlan().collectLeaves()
    files = [scanned.apply(k).relation().inputFiles() for k in range(scanned.size()) if "question" in scanned.apply(k).schema().fieldNames()] if limit else []
    assert [len(f) for f in files] == ([-(-min(limit, 7) // 2)] if limit else [])


def test_an_unknown_shape_is_an_error(spark, folder):
    with pytest.raises(ValueError, match="unknown shape"):
        chat.pairs(chat.first_rows(spark, str(folder / "question"), chat.SHAPES["question"]), "riddle")
