"""Guards that fail, cursors that don't repeat, and JSON in ASCII."""

import json

import pytest
from pyspark.sql import functions as F

from cairnwork.functions import text as X
from cairnwork.operators import guards as G
from cairnwork.operators import loading as L
from cairnwork.sources import writers


def plain_batches(files, rank, world, batch, cursor, epochs):
    """The loop in its plainest form: files is a list of numbers of row groups, each of seven rows."""
    out, first, epoch = [], True, cursor[2] if cursor else 1
    for epoch in range(epoch, epoch + epochs):
        for f in range(cursor[0] if cursor and first else 0, len(files)):
            g = (cursor[1] // world + 1) * world + rank if cursor and first and f == cursor[0] else rank
            while g < files[f]:
                out += [(epoch, f, g, i // batch) for i in range(0, 7, batch)]
                g += world
        first = False
    return out


@pytest.mark.parametrize("cursor", [None, (0, 0, 1), (0, 4, 3), (1, 1, 2), (2, 5, 1)])
@pytest.mark.parametrize("rank", [0, 1])
def test_batches_after_a_cursor(spark, cursor, rank):
    files = [5, 2, 6]
    rows = spark.createDataFrame([(f, g, p) for f, n in enumerate(files) for g in range(n) for p in range(7)], "pq_idx int, rg_idx int, pos int")
    got = L.document_batches(rows, rank, 2, 3, 2, cursor).select("epoch", "pq_idx", "rg_idx", "batch_idx").distinct().collect()
    assert sorted(map(tuple, got)) == sorted(plain_batches(files, rank, 2, 3, cursor, 2))


def test_guards_fail(spark):
    d = spark.createDataFrame([("A", ["A", "B"]), ("C", ["A", "B"])], "answer string, letters array<string>")
    one = G.answer_in_letters(F.col("answer"), F.col("letters"))
    assert [r[0] for r in d.where("answer = 'A'").select(one).collect()] == ["A"]
    with pytest.raises(Exception, match="must be one of A, B"):
        d.select(one).collect()
    assert G.require_rows(d, 2).count() == 2
    with pytest.raises(Exception, match="fewer than 3 rows"):
        G.require_rows(d, 3).collect()
    assert G.overflow_policy(F.lit(None), F.lit(1), F.lit(None)) is not None
    r = spark.range(1).select(G.overflow_policy(F.lit(None), F.lit(1), F.lit("x exceeds max sequence length")).alias("a"), G.quick_status(F.lit(float("nan")), 1.0).alias("b"), G.confirmed(F.lit("full_confirm_complete"), F.lit(4.0), F.lit(None).cast("double")).alias("c")).first()
    assert tuple(r) == ("fixed", "quick_gate_failed", False)


def test_json_in_ascii(spark, tmp_path):
    said = ["plain", "h\u00e9 \u2603 \U0001f600 \"q\" \\\\ \n", ""]
    d = spark.createDataFrame([([("user", s), ("assistant", "ok")],) for s in said], "messages array<struct<role:string,content:string>>")
    writers.message_lines(d.coalesce(1), str(tmp_path / "m"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "m")).collect()]
    assert all(x.isascii() for x in lines) and [json.loads(x)[0]["content"] for x in lines] == said
    assert [x for x in lines] == [json.dumps(json.loads(x), separators=(",", ":")) for x in lines]


def test_rule_sets(spark):
    ask, tell = "Please explain in a few words how an {} is made today.", "An answer that is long enough to be accepted by all of them."
    rows = [(k, ask.format(w), tell) for k, w in enumerate(["engine", "sql query", "executable", "java class", "pseudocode", "fan fiction"])]
    d = spark.createDataFrame(rows, "k int, user string, assistant string")
    kept = lambda rules: [r[0] for r in d.where(X.valid_pair(F.col("user"), F.col("assistant"), rules)).orderBy("k").collect()]
    assert kept("v1") == [0, 2, 3, 4] and kept("v2") == [0, 4, 5] and kept("v3") == [0, 5] and kept("distilled") == [0, 2, 4, 5]
    pad = spark.createDataFrame([("  " + "u" * 38 + " \t  x  ", "a" * 45)], "user string, assistant string")
    assert pad.where(X.valid_pair(F.col("user"), F.col("assistant"), "v2")).count() == 1
    long = spark.createDataFrame([("u" * 40, "a " * 120)], "user string, assistant string")
    assert [long.where(X.valid_pair(F.col("user"), F.col("assistant"), r)).count() for r in ("distilled", "distilled2")] == [0, 1]
    s = spark.range(1).select(X.clean_solution(F.lit("<|begin_of_solution|> a  b\r\n<|end_of_thought|>c<|end_of_solution|> ")).alias("s")).first()[0]
    assert s == "a b\nc"
