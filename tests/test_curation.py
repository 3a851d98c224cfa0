"""The curation flow against its SQL on rows that meet every rule, and against answers worked out by hand."""

import duckdb
import pytest
from pyspark.sql import functions as F

from cairnwork import catalog
from cairnwork.functions import text as X
from cairnwork.plans import curation

LONG = "The sum of the two given numbers is found by adding them together one at a time. "
ASK = "Explain how the {} of a body that falls freely is found, in a few simple words please."
PAIRS = [
    (ASK.format("force"), LONG + "Final answer: 4."),
    (ASK.format("FORCE"), LONG),  # an equal prompt
    (ASK.format("speed"), "<|begin_of_thought|>We think aloud about it at length.<|end_of_thought|><|begin_of_solution|>" + LONG + "So \\boxed{12} holds.<|end_of_solution|>"),
    (ASK.format("python speed"), LONG),
    ("too short", LONG),
    (ASK.format("mean height"), "**Solution:** Step 1: " + LONG + "Thus. " + LONG + "Hence\nIt ends when the body has come to rest on the ground."),
    (ASK.format("planet"), "```x```" + LONG),
    (ASK.format("riddle"), "\n- a\n- b\n- c\n- d\n" + LONG),
    ("Put your final answer in \\boxed{}. " + ASK.format("ratio"), LONG + "Answer: . The answer is 7 of them. And here the matter comes to its end."),
    (ASK.format("weight") + " (a) low (b) high", LONG + "Answer: B"),
    (ASK.format("colour"), "Let's think step by step: " + LONG),
    (ASK.format("shape"), "First, one thing. Second, two things are here. Third, three things are here. Finally, four things are here to be seen. Five more words follow now."),
    (ASK.format("length"), "word " * 130),
    (ASK.format("sound"), "Stated  with\ttabs.\r\n\r\n\r\n\r\nAnd with lines, which are fewer than they were before it."),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("curation"))
    rows = [(k, t, r, x) for k, p in enumerate(PAIRS * 3) for t, r, x in ((0, "user", p[0] + " " * (k % 2)), (1, "assistant", p[1]))]
    rows += [(900, 0, "assistant", LONG), (900, 1, "user", LONG), (901, 0, "user", ASK), (902, 0, "user", None), (902, 1, "assistant", LONG)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path


@pytest.mark.parametrize("name", ["c01_curation_v3", "c02_curation_distilled", "c03_curation_sources", "c04_curation_manifest", "f09_x07_teacher_answers"])
def test_against_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{folder}/conversations.parquet/*.parquet'")
    want = con.execute(catalog.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    got = sorted(map(tuple, catalog.queries()[name](spark, folder).select(*cols).collect()))
    assert got and got == sorted(want.fetchall())


@pytest.mark.parametrize("text, want", [
    (LONG + "Final answer: 4.", f"Answer: 4\nWhy: {LONG.strip()}"),
    ("Thus.\u00a0One thing.\u2003One thing. Hence", "Thus. One thing."),  # white space of any script parts sentences, equal ones count once
    ("Step 2: It is so.", "It is so."),
    ("a ``` b", ""),
])
def test_answers(spark, text, want):
    assert spark.range(1).select(X.teacher_answer(F.lit(text)).alias("a")).first()["a"] == want


def test_reward_and_limit(spark):
    rows = [(k, ASK.format(f"thing {k}"), LONG, 0.1 * k) for k in range(8)] + [(8, ASK.format("thing 8"), LONG, None)]
    d = spark.createDataFrame(rows, "ord long, user string, assistant string, reward double")
    quotas = curation.quota_table(spark, {"kept": 3})
    got = curation.curate(d, "s", quotas, reward=0.18, limit=7, category=F.lit("kept"), thoughts=False).orderBy("rank").collect()
    assert [r["ord"] for r in got] == [6, 5, 4]  # 7 is beyond the limit, the reward leads the score
    assert curation.candidates(d, "s", reward=0.18, category=F.lit("kept")).count() == 6
    assert curation.candidates(d.limit(0), "s", limit=5).count() == 0
