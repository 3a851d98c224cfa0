"""The flow from items to a composite score, on items whose prompts, spans and outcomes are worked out by hand."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from cairnwork.operators import core_eval as C
from cairnwork.operators import ordered as O

ITEMS = "task string, idx long, query string, choices array<string>, gold int, context_options array<string>, continuation string, context string"
TASKS = "task string, kind string, shots int, delimiter string, baseline double"


def choice(task, idx, query, choices, gold):
    return (task, idx, query, choices, gold, None, None, None)


def planned(spark, items, tasks, **how):
    rows = C.options(C.with_shots(spark.createDataFrame(items, ITEMS), spark.createDataFrame(tasks, TASKS)), **how)
    return rows


def texts(rows):
    return {(r["task"], r["idx"]): r["options"] and [(bytes(x for x in o["ids"] if x < 256).decode(), o["start"], o["end"]) for o in r["options"]] for r in rows.collect()}


MIXED = [
    choice("m", 0, "Q0", ["ab", "ac"], 1), choice("m", 1, "Q1", ["x", "yz"], 0),
    ("s", 0, None, None, 0, ["It is red", "It is big"], "so.", None), ("l", 0, None, None, None, None, "end", " The "), ("l", 1, None, None, None, None, "fin", "A"),
]
KINDS = [("m", "multiple_choice", 1, ":", 25.0), ("s", "schema", 0, " ", 50.0), ("l", "language_modeling", 5, " ", 0.0)]


def test_prompts_and_spans_of_each_kind(spark):
    got = texts(planned(spark, MIXED, KINDS))
    assert got["m", 0] == [("Q1:x\n\nQ0:ab", 11, 12), ("Q1:x\n\nQ0:ac", 11, 12)]  # `Q0:a` is shared
    assert got["m", 1] == [("Q0:ac\n\nQ1:x", 11, 12), ("Q0:ac\n\nQ1:yz", 11, 13)]
    assert got["s", 0] == [("It is red so.", 10, 14), ("It is big so.", 10, 14)]
    assert got["l", 0] == [("A fin\n\nThe end", 11, 15)] and got["l", 1] == [("The end\n\nA fin", 11, 15)]  # the only other one, though five were asked for


def test_overflow_policies(spark):
    skipped = texts(planned(spark, MIXED, KINDS, most=13, policy="skip"))
    assert skipped["m", 0] and not skipped["l", 0] and not skipped["s", 0]
    cut = texts(planned(spark, MIXED, KINDS, most=5, policy="truncate"))
    assert cut["m", 0] is not None and all(end == 5 for _, _, end in cut["m", 0])
    raw = planned(spark, MIXED, KINDS, most=5, policy="truncate").where("task = 'l' AND idx = 1").first()["options"][0]
    assert (bytes(raw["ids"]).decode(), raw["start"], raw["end"]) == ("A fin", 1, 5) and cut["s", 0] is not None
    assert texts(planned(spark, MIXED, KINDS, most=2, policy="truncate"))["l", 0] is None  # a scored token would go
    with pytest.raises(Exception, match="sequence exceeds 13 tokens"):
        planned(spark, MIXED, KINDS, most=13, policy="error").collect()
    with pytest.raises(Exception, match="unknown kind of task: riddle"):
        planned(spark, MIXED[:1], [("m", "riddle", 0, " ", 0.0)]).collect()


def test_outcomes_and_composite(spark):
    items = [choice("m", k, f"Q{k}", ["a", "b", "c"], 1) for k in range(4)] + MIXED[2:4] + [choice("none", 0, "q", ["a" * 99, "b"], 0)]
    tasks = [("m", "multiple_choice", 0, " ", 25.0), *KINDS[1:], ("none", "multiple_choice", 0, " ", 25.0)]
    least = {0: 1, 1: 2, 2: 1}  # item 3 isn't scored whole

    def model(rows):
        wanted = F.coalesce(*[F.when(F.col("idx") == k, F.lit(v)) for k, v in least.items()], F.lit(1))
        loss = F.when(F.col("option") >= wanted, F.col("option") - wanted + 1.0).otherwise(9.0)  # equals go to the first
        right = F.concat(F.slice("ids", 2, F.size("ids")), F.array(F.lit(0)))
        out = rows.select("task", "idx", "option", F.transform("ids", lambda x: loss).alias("losses"), right.alias("predictions"))
        return out.where("NOT (task = 'm' AND idx = 3 AND option = 2)")

    made, kinds = spark.createDataFrame(items, ITEMS), spark.createDataFrame(tasks, TASKS)
    got = {r["task"]: tuple(r)[1:] for r in C.evaluate(made.where("task <> 'none'"), kinds, model).collect()}
    assert got["m"] == (2 / 3, (2 / 3 - 0.25) / 0.75, 3, 1) and got["l"] == (1.0, 1.0, 1, 0) and got["s"] == (0.0, -1.0, 1, 0)
    assert got["CORE"][0] is None and got["CORE"][1] == pytest.approx(((2 / 3 - 0.25) / 0.75 + 1.0 - 1.0) / 3) and got["CORE"][2:] == (5, 1)
    bare = {r["task"]: r for r in C.evaluate(made, kinds, model, most=50, policy="skip").collect()}
    assert math.isnan(bare["none"]["accuracy"]) and math.isnan(bare["CORE"]["centered"]) and bare["none"]["skipped"] == 1


def test_shots_stay_in_their_group(spark):
    d = spark.createDataFrame([(g, k, n) for g, size, n in (("a", 40, 3), ("b", 2, 3), ("c", 1, 3), ("d", 9, 0), (None, 5, 1)) for k in range(size)], "task string, idx long, shots int")
    rows = O.few_shot_within(d, "task", "idx", "shots").collect()
    per = {}
    for r in rows:
        per.setdefault((r["task"], r["idx"]), []).append((r["place"], r["shot"]))
    assert {g: sum(k[0] == g for k in per) for g in ("a", "b", "c", "d", None)} == {"a": 40, "b": 2, "c": 0, "d": 0, None: 5}
    for (g, idx), own in per.items():
        shots = [s for _, s in sorted(own)]
        assert len(shots) == {"a": 3, "b": 1, None: 1}[g] == len(set(shots)) and idx not in shots
        assert all(0 <= s < {"a": 40, "b": 2, None: 5}[g] for s in shots)
