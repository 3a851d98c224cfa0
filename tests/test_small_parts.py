"""Readers, writers and gates that no query goes through, on literal rows."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from cairnwork.functions import sequences as Q
from cairnwork.functions import text as X
from cairnwork.operators import decisions as D
from cairnwork.sources import readers, writers


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_items_and_baselines_and_configs(spark, tmp_path):
    (tmp_path / "items.jsonl").write_text('{"query": "q", "choices": ["a", "b"], "gold": 1}\n{"context_options": ["x"], "continuation": "y", "gold": 0}\n{"context": "c", "continuation": "d"}\n')
    rows = readers.items(spark, str(tmp_path / "items.jsonl")).collect()
    assert rows[0]["choices"] == ["a", "b"] and rows[1]["context_options"] == ["x"] and (rows[2]["context"], rows[2]["gold"]) == ("c", None)
    (tmp_path / "meta.csv").write_text("Eval Task,Random baseline,other\narc,25.0,1\nlm,,2\nodd,NA,3\n")
    assert [tuple(r) for r in readers.random_baselines(spark, str(tmp_path / "meta.csv")).collect()] == [("arc", 25.0), ("lm", None), ("odd", None)]
    (tmp_path / "out.csv").write_text("Task               , Accuracy  , Centered\narc                , 0.500000  , 0.250000\nCORE               ,           , 0.123456\n")
    assert [tuple(r) for r in readers.padded_csv(spark, str(tmp_path / "out.csv")).collect()] == [("arc", 0.5, 0.25), ("CORE", None, 0.123456)]
    tasks = [{"label": "arc", "icl_task_type": "multiple_choice", "dataset_uri": "a.jsonl", "num_fewshot": [10]}, {"label": "s", "icl_task_type": "schema", "dataset_uri": "s.jsonl", "num_fewshot": [0], "continuation_delimiter": ": "}]
    assert [tuple(r) for r in readers.task_config(spark, tasks).collect()] == [("arc", "multiple_choice", "a.jsonl", 10, " "), ("s", "schema", "s.jsonl", 0, ": ")]


def test_corpus_files_and_bad_checkpoints(spark, tmp_path):
    for k, texts in enumerate((["a", "b"], ["c"])):
        spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).write.parquet(str(tmp_path / f"w{k}"))
        next((tmp_path / f"w{k}").glob("*.parquet")).rename(tmp_path / f"shard_{k}.parquet")
    top = tmp_path / "corpus"
    top.mkdir()
    for p in tmp_path.glob("shard_*"):
        p.rename(top / p.name)
    (top / "shard_2.parquet.tmp").write_text("no file")
    assert sorted((r["pq_idx"], r["row"], r["text"]) for r in readers.corpus(spark, str(top)).collect()) == [(0, 0, "a"), (0, 1, "b"), (1, 0, "c")]
    meta = tmp_path / "meta"
    meta.mkdir()
    (meta / "meta_000007.json").write_text(json.dumps({"other": 1}))
    (meta / "meta_000009.json").write_text(json.dumps({"step": 5, "val_bpb": 0.5}))
    (meta / "notes.json").write_text("{}")
    got = sorted((r["file"], r["step"], r["val_bpb"]) for r in readers.checkpoint_metadata(spark, str(meta)).collect())
    assert got == [("meta_000007.json", 7, float("inf")), ("meta_000009.json", 5, 0.5)]


def test_report_values_and_newest_rows(spark):
    assert [value(spark, writers.report_value(F.lit(v).cast(t), t)) for v, t in ((0.123456, "double"), (9999, "int"), (12345678, "bigint"), (True, "boolean"), ("x", "string"))] == ["0.1235", "9999", "12,345,678", "true", "x"]
    d = spark.createDataFrame([("a", 1), ("a", 3), ("a", 2), ("b", 1)], "g string, t int")
    assert sorted(map(tuple, writers.keep_newest(d, "g", "t", 2).collect())) == [("a", 2), ("a", 3), ("b", 1)]


@pytest.mark.parametrize(("mmlu", "pass1", "want"), [(27.0, None, True), (26.9, None, False), (float("nan"), None, False), (None, None, False), (30.0, 0.0, False), (30.0, 0.1, True)])
def test_quick_gate(spark, mmlu, pass1, want):
    assert value(spark, D.quick_gate(F.lit(mmlu).cast("double"), 27.0, None if pass1 is None else F.lit(pass1))) is want


def test_other_gates_and_scales(spark):
    assert [value(spark, D.loss_gate(F.lit(x).cast("double"), 0.8)) for x in (0.8, 0.81, None)] == [True, False, False]
    assert D.rebalanced({"reasoning": 5, "math": 3}, 10) == {"reasoning": 7, "math": 3} and D.rebalanced({"math": 30}, 10) == {"math": 30, "reasoning": 0}
    assert value(spark, D.batch_rate_scale(F.lit(4.0), 1.0)) == 2.0 and value(spark, D.throughput(F.lit(1000), F.lit(500))) == 2000
    runs = [("a", "full_confirm", 5.0, 28.0), ("a", "full_confirm", 4.0, 27.0), ("b", "full_confirm", 3.0, 40.0), ("c", "failed", 9.0, 99.0)]
    got = D.promotion(spark.createDataFrame(runs, "g string, status string, gsm8k_pass8 double, mmlu double"), "g")
    assert {r["g"]: r["decision"] for r in got.collect()} == {"a": "promote", "b": "hold", "c": "failed"}


def test_programs_and_prompts(spark):
    assert value(spark, X.program_of(F.lit("see\n```python\nx = 1\n```\nend"))) == "x = 1" and value(spark, X.program_of(F.lit("  y = 2 \n"))) == "y = 2"
    shot = F.array(F.struct(F.array(F.lit("c0"), F.lit("c1")).alias("context_options"), F.lit(1).alias("gold"), F.lit("so").alias("continuation")))
    assert value(spark, Q.prompts_schema(F.array(F.lit("a"), F.lit("b")), F.lit("then"), shot, ": ")) == ["c1: so\n\na: then", "c1: so\n\nb: then"]
