"""Whole reports, run histories, checked conversations, word lists, attempts, token views."""

import datetime

import pytest
from pyspark.sql import functions as F

from cairnwork.functions import sequences as S
from cairnwork.operators import loading as L
from cairnwork.operators import reports as R
from cairnwork.sources import readers


def test_whole_report(spark):
    files = {
        "header.md": "# Run\n\n### Bloat\n- Lines: 5\n- Files: 2\n\nRun started: 2025-01-02 03:04:05\n\n---\n\n",
        "base-model-evaluation.md": "## Base\ntimestamp: 2025-01-02 04:00:00\n\n- CORE: 0.25\n",
        "chat-evaluation-sft.md": "## SFT\ntimestamp: 2025-01-02 05:14:06\n\n- MMLU: 0.3\n- ARC-Easy: 0.5\n- MMLU: 0.31\n- ChatCORE: 0.2\n",
        "chat-evaluation-rl.md": "## RL\ntimestamp: 2025-01-09 00:00:00\n\n- GSM8K: 0.0712345678\n",
        "other.md": "not a part\n",
    }
    got = R.report(spark.createDataFrame(list(files.items()), "file string, content string")).orderBy("place").collect()
    blank = lambda s, n: s + " " * (n - len(s))
    row = lambda m, *v: f"| {blank(m, 15)} | " + " | ".join(blank(x, 8) for x in v) + " |\n"
    table = row("Metric", "BASE", "SFT", "RL") + "|" + "-" * 17 + "|" + ("-" * 10 + "|") * 3 + "\n" + row("CORE", "0.25", "-", "-")
    table += row("ARC-Easy", "-", "0.5", "-") + row("GSM8K", "-", "-", "0.0712345678") + row("MMLU", "-", "0.31", "-") + row("ChatCORE", "-", "0.2", "-")
    want = files["header.md"] + "".join(files[f] + "\n" for f in list(files)[1:4]) + "## Summary\n\n- Lines: 5\n- Files: 2\n\n" + table + "\nTotal wall clock time: 2h10m\n"
    assert "".join(r["part"] for r in got) == want


def test_report_without_header(spark):
    got = R.report(spark.createDataFrame([("chat-sft.md", "no time\n")], "file string, content string")).orderBy("place").collect()
    assert got[0]["part"] == "no time\n\n" and got[1]["part"].startswith("## Summary\n\n[bloat data missing]\n\n| Metric") and got[1]["part"].endswith("\nTotal wall clock time: unknown\n")
    empty = R.report(spark.createDataFrame([], "file string, content string")).collect()
    assert len(empty) == 1 and "unknown" in empty[0]["part"]


def test_wall_clock(spark):
    at = datetime.datetime(2025, 1, 1)
    d = spark.createDataFrame([(at, at + datetime.timedelta(days=2, minutes=3, seconds=59)), (at, None)], "a timestamp, b timestamp")
    assert [r[0] for r in d.select(R.wall_clock(F.col("a"), F.col("b"))).collect()] == ["48h3m", "unknown"]


def test_checked_conversations(spark, tmp_path):
    good = '[{"role":"user","content":"a"},{"role":"assistant","content":"b"},{"role":"user","content":""}]'
    for k, bad in enumerate(["", '[{"role":"user","content":"a"}]', '[{"role":"assistant","content":"a"},{"role":"user","content":"b"}]', '[{"role":"user","content":"a"},{"role":"assistant"}]', "no json", '[{"role":"user","content":"a"},{"content":"b"}]']):
        (tmp_path / f"{k}.jsonl").write_text(f"{good}\n\n{bad}\n")
        d = readers.checked_conversations(spark, str(tmp_path / f"{k}.jsonl"))
        if bad:
            with pytest.raises(Exception, match="not a conversation"):
                d.collect()
        else:
            assert [[m["content"] for m in r["messages"]] for r in d.collect()] == [["a", "b", ""]]


def test_files(spark, tmp_path):
    (tmp_path / "words.txt").write_text(" apple \npear\t\n\nplum")
    assert [r[0] for r in readers.word_list(spark, str(tmp_path / "words.txt")).collect()] == ["apple", "pear", "", "plum"]
    (tmp_path / "r.csv").write_text("depth,loss\n12,0.5\n20,0.25\n")
    d = readers.results_csv(spark, str(tmp_path / "r.csv"))
    assert [tuple(r) for r in d.collect()] == [(12, 0.5), (20, 0.25)] and d.dtypes == [("depth", "int"), ("loss", "double")]
    assert readers.results_csv(spark, str(tmp_path / "r.csv"), "depth long, loss double").dtypes == [("depth", "bigint"), ("loss", "double")]


def test_history(spark):
    rows = [("a", 1, "loss", 1.0), ("a", 2, "loss", 2.0), ("a", 1, "bpb", 9.0), ("b", 1, "bpb", 1.0), ("b", None, "bpb", 2.0), ("c", 1, "loss", None), ("c", 2, "loss", 1.0), ("c", 1, "bpb", 1.0), ("c", 2, "bpb", 1.0), ("d", 3, "bpb", 4.0), ("d", 1, "bpb", 5.0), ("e", 1, "bpb", 1.0), ("e", 2, "bpb", 1.0)]
    d = spark.createDataFrame(rows, "run string, step long, key string, value double")
    got = sorted(map(tuple, readers.history(d, ["loss", "bpb"], pattern="[a-d]", most=2).collect()))
    assert got == [("a", "loss", 1, 1.0), ("a", "loss", 2, 2.0), ("d", "bpb", 1, 5.0), ("d", "bpb", 3, 4.0)]


def test_ladder_and_result_rows(spark):
    spec = R.attempts("a:1024:4096,b:1000:4096,c:512:4096")
    assert spec[1] == (1, "b", 1000, 4096)
    tries = [(run, *s, ok) for run, oks in (("x", [False, True, True]), ("y", [True, False, False]), ("z", [None, False, True])) for s, ok in zip(spec, oks, strict=True) if run != "z" or s[1] != "b"]
    d = spark.createDataFrame(tries, "run string, place long, label string, length long, batch long, ok boolean")
    assert sorted(map(tuple, R.ladder(d).collect())) == [("x", "error"), ("y", "a"), ("z", "c")]
    assert [tuple(r) for r in R.ladder(d.where("run = 'z' AND place = 0")).collect()] == [("z", "fail")]
    d = spark.createDataFrame([(1, 0.5, 3, True), (2, 0.5, 3, False), (3, None, 3, None)], "seed int, score double, steps int, ok boolean")
    assert [tuple(r) for r in R.result_rows(d, ["score", "steps"], "ok").orderBy("seed").collect()] == [(1, "0.5", "3"), (2, "NA", "-1"), (3, "NA", "-1")]


def test_consumed_and_view(spark):
    got = [spark.range(1).select(L.consumed(F.lit(s), 1, 3, 10).alias("c")).first()["c"] for s in (0, 2, 3, 7)]
    assert [tuple(g) for g in got] == [(1, 1, 0.1, False), (7, 1, 0.7, False), (0, 2, 1.0, True), (2, 3, 2.2, True)]
    d = spark.createDataFrame([(["a", "b"], [1, 0], [5, 6])], "p array<string>, m array<int>, i array<int>")
    plain, with_ids = d.select(S.token_view(F.col("p"), F.col("m")), S.token_view(F.col("p"), F.col("m"), F.col("i"))).first()
    assert plain == "\x1b[92ma\x1b[0m|\x1b[91mb\x1b[0m"
    assert with_ids == "\x1b[92ma\x1b[0m|\x1b[90m(5)\x1b[0m|\x1b[91mb\x1b[0m|\x1b[90m(6)\x1b[0m"


def test_packing_shares(spark):
    from cairnwork.operators import packing as P

    packed = spark.createDataFrame([(0, 0, 6, 0), (0, 0, 4, 3), (0, 1, 5, 0), (1, 0, 10, 2)], "rank int, row long, used long, lost long")
    r = P.metrics(packed, 10).first()  # rows (0, 0), (0, 1) and (1, 0) hold 10, 5 and 10 of 10
    assert (r["utilisation"], r["crop"], r["padding"]) == (pytest.approx(25 / 30), pytest.approx(5 / 30), pytest.approx(5 / 30))
