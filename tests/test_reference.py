"""Queries against DuckDB on the smallest tables, and functions against literal cases."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cairnwork import catalog
from cairnwork.functions import logs as L
from cairnwork.functions import sequences as Q
from cairnwork.functions import text as X
from cairnwork.functions.calculator import calculate
from cairnwork.operators import decisions as D
from cairnwork.operators import conversation as C
from cairnwork.operators import packing as P
from cairnwork.operators import statistics as S
from cairnwork.operators import tokenizer as T
from cairnwork.sources import readers, writers
from cairnwork.streaming import logs as SL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_oracle(spark, con, name):
    a, b = catalog.queries()[name](spark, DATA).toPandas(), con.execute(catalog.oracle_sql()[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    for c in cols:
        if a[c].dtype == object or str(a[c].dtype) in ("str", "string"):
            a[c], b[c] = a[c].astype(str), b[c].astype(str)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9)


def one(spark, expr, **cols):
    row = spark.createDataFrame([tuple(cols.values())], ", ".join(f"`{k}` string" for k in cols))
    return row.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("a\r\nb\rc", "a\nb\nc"), (" a \t b ", "a b"), ("a\n\n\n\nb", "a\n\nb"), ("　x　", "x"), ("", ""), (None, None)],
)
def test_normalize_text(spark, text, want):
    assert one(spark, X.normalize_text(F.col("t")), t=text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [(r"so \boxed{42} it is", "42"), ("Final answer: 7", "7"), ("the answer is x=3.", "x=3"), ("answer: =", None), ("none", None)],
)
def test_answer_hint(spark, text, want):
    assert one(spark, X.answer_hint(F.col("t")), t=text) == want


def test_teacher_answer(spark):
    text = "Step 1: We add two and two. Therefore.\nThe sum is four because numbers add. Final answer: 4."
    assert one(spark, X.teacher_answer(F.col("t")), t=text).startswith("Answer: 4\nWhy: We add two and two.")
    assert one(spark, X.teacher_answer(F.col("t")), t="```x```") == ""
    assert one(spark, X.teacher_answer(F.col("t"), "distilled"), t="Reasoning: a") == ""
    assert one(spark, X.teacher_answer(F.col("t")), t="x\n- a\n- b\n- c\n- d") == ""


def test_prompts_and_classes(spark):
    assert one(spark, X.normalize_user_prompt(F.col("t")), t="Put your final answer in \\boxed{}. How far?") == "How far?"
    assert one(spark, X.classify_thoughts(F.col("t")), t="an excellent day") == "science"
    assert one(spark, X.classify_thoughts(F.col("t")), t="a riddle with an equation") == "puzzle"
    assert one(spark, X.classify_prompt(F.col("t")), t="hello there") == "grounded_qa"


def test_gsm(spark):
    assert one(spark, X.gsm_answer(F.col("t")), t="a\n#### 1,234") == "1234"
    assert one(spark, X.gsm_answer(F.col("t")), t="none") is None
    parts = one(spark, X.gsm_parts(F.col("t")), t="so <<2+2=4>>4 apples")
    assert [(p["kind"], p["text"], p["result"]) for p in parts] == [("text", "so ", None), ("python", "2+2", "4"), ("text", "4 apples", None)]


def test_pretokens_lossless(spark):
    text = "It's 12345  café!!\n\n  x"
    assert "".join(one(spark, X.pretokens(F.col("t")), t=text)) == text


def test_render(spark):
    rows = spark.createDataFrame([(1, 0, "system", "S"), (1, 1, "user", "U"), (1, 2, "assistant", "A")], "conv_id int, turn int, role string, text string")
    r = C.nested(rows).select(C.render(F.col("messages")).alias("r"), C.alternates(F.col("messages")).alias("ok"), C.render_for_completion(F.col("messages")).alias("c")).first()
    assert r["ok"] and r["r"]["ids"] == [256, 257, 83, 10, 10, 85, 258, 259, 65, 260] and r["r"]["mask"] == [0] * 8 + [1, 1] and r["c"][-1] == 259


def test_violations(spark):
    good = [("user", "Q one"), ("assistant", "A")]
    rows = [("1", "s", "t", "math", "high", good), ("1", "", "t", "odd", "low", [("assistant", "```"), ("user", " ")]), ("3", "s", "t", "math", "high", [("user", "Q ONE"), ("assistant", "A")])]
    df = spark.createDataFrame(rows, "id string, source string, teacher_model string, category string, quality string, messages array<struct<role:string,content:string>>")
    found = {(r["id"], r["problem"]) for r in C.violations(df, ["math"]).collect()}
    assert {("1", "blank source"), ("1", "category"), ("1", "quality"), ("1", "roles"), ("1", "empty turn"), ("1", "fence"), ("1", "duplicate id")} <= found
    assert {p for i, p in found if i == "3"} == {"duplicate user turn"}  # the later row is the duplicate


def test_violations_of_every_message(spark):
    """Each rule once, on messages beyond the first and the last; of several duplicates all but the first are reported."""
    ok = [("user", "Q"), ("assistant", "A"), ("user", "Q"), ("assistant", "A")]
    marks = ("let's think step by step", "let us think step by step", "step-by-step", "chain of thought", "reasoning:", "solution:")
    rows = [(0, "a", ok), (1, "b", [*ok[:2], ("user", "w " * 181), ok[3]]), (2, "c", [ok[0], ("assistant", "w " * 221), *ok[2:]]), (3, "d", [("user", "w " * 180), ("assistant", "w " * 220)])]
    rows += [(10 + k, f"m{k}", [("user", f"other {k}"), ("assistant", f"So, {m.upper()} it is"), ("user", m), ("assistant", "A")]) for k, m in enumerate(marks)]
    rows += [(20, "e", [*ok, ok[0]]), (21, "f", [("user", "alone")]), (22, "g", [ok[1], ok[0]]), (23, "a", [("user", "new"), ok[1]])]
    df = spark.createDataFrame([(i, k, "s", "t", "math", "medium", m) for i, k, m in rows], "at long, id string, source string, teacher_model string, category string, quality string, messages array<struct<role:string,content:string>>")
    found = {}
    for r in C.violations(df, ["math"], line="at", carry=("at",)).collect():
        found.setdefault(r["at"], set()).add(r["problem"])
    again = {"duplicate user turn"}
    assert found == {1: {"user words"} | again, 2: {"assistant words"} | again, **{10 + k: {"thinks aloud"} for k in range(6)}, 20: {"turns"} | again, 21: {"turns", "roles"}, 22: {"roles"}, 23: {"duplicate id"}}


def test_best_fit(spark):
    assert list(P.fill(iter([(1, 5), (2, 3), (3, 2), (4, 9)]), 5, 10, True)) == [(0, 1, 5, 0), (1, 2, 3, 0), (1, 3, 2, 0), (2, 4, 5, 4)]
    padded = list(P.fill(iter([(1, 4), (2, 3), (3, 9)]), 5, 10, False))
    assert padded == [(0, 3, 5, 0), (1, 1, 4, 0), (2, 2, 3, 0)]
    docs = spark.createDataFrame([(i, 1 + i % 7) for i in range(300)], "id long, n long")
    packed = P.best_fit(docs, "id", F.col("n"), 10, ranks=3, rows_per_group=16)
    assert packed.agg(F.sum(F.col("used") + F.col("lost"))).first()[0] == sum(1 + i % 7 for i in range(300))
    assert packed.groupBy("rank", "row").agg(F.sum("used").alias("u")).where("u > 10").count() == 0


def test_tokenizer(spark):
    docs = spark.createDataFrame([("low lower lowest low low",)], "text string")
    merges = T.train(docs, 256 + 9 + 4)
    assert merges[0] in ((b"l", b"o"), (b"o", b"w")) and len(merges) == 4
    t = T.Tokenizer(merges)
    assert t.decode(t.encode("lower café")) == "lower café" and t.encode("", prepend="<|bos|>") == [260]


def test_logs(spark):
    s = one(spark, L.step_line(F.col("t")), t="step 00000/615173 (0.00%) | loss: 10.397944 | lrm: 0.00 | dt: 2279.62ms | tok/sec: 7,187 | mfu: 0.00 | epoch: 1 | total time: 0.00m")
    assert (s["step"], s["total"], s["loss"], s["tok_per_sec"], s["eta_minutes"]) == (0, 615173, 10.397944, 7187, None)
    s = one(spark, L.step_line(F.col("t")), t="step 00007 (2.33%) | loss: 4.276271 | lrm: 0.23 |")
    assert (s["step"], s["total"], s["percent"]) == (7, None, 2.33)
    c = one(spark, L.core_task_line(F.col("t")), t="Evaluating: copa (0-shot, type: multiple_choice)... accuracy: 0.6100 | centered: 0.2200 | evaluated: 100 | skipped: 0 | time: 2.13s")
    assert (c["task"], c["shots"], c["accuracy"], c["evaluated"]) == ("copa", 0, 0.61, 100)
    assert one(spark, L.ratio(F.col("t"), "MMLU"), t="MMLU: 234/1000 = 23.40% | x")["k"] == 234
    assert one(spark, L.is_bad(F.col("t")), t="a nanosecond run") is False and one(spark, L.is_bad(F.col("t"), False), t="a nanosecond run") is True


def test_statistics(spark):
    low, high = S.wilson(F.lit(14.0), F.lit(1000.0))
    r = spark.range(1).select(low.alias("a"), high.alias("b")).first()
    assert round(100 * r["a"], 2) == 0.84 and round(100 * r["b"], 2) == 2.34
    d = spark.createDataFrame([("g", float(x), 2.0 * (x - 3) ** 2 + 1) for x in range(6)], "g string, x double, y double")
    v = S.quadratic_vertex(d, "g", "x", "y").first()
    assert abs(v["a"] - 2) < 1e-9 and abs(v["vertex"] - 3) < 1e-9
    rows = S.ridge(spark.createDataFrame([(float(i), 3.0 * i + 1) for i in range(10)], "x double, y double"), ["x"], "y")
    assert abs(rows[0]["weights"][0] - 3) < 1e-9 and rows[0]["r2"] > 0.999999


def test_files_and_streams(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('[{"role":"user","content":"a"}]\n\n[{"role":"user","content":"b"}]\n')
    assert readers.conversations(spark, str(tmp_path / "c.jsonl")).count() == 2
    (tmp_path / "t.tsv").write_text("seed\tscore\n1\tNA\n2\t3.5\n3\t-1\n")
    assert [r["score"] for r in readers.results_table(spark, str(tmp_path / "t.tsv"), ["score"]).orderBy("seed").collect()] == [None, 3.5, None]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "meta_000010.json").write_text('{"val_bpb": 0.9}')
    r = readers.checkpoint_metadata(spark, str(tmp_path / "m")).first()
    assert (r["step"], r["val_bpb"]) == (10, 0.9)
    df = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c")], "shard int, text string")
    writers.shards(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 3
    writers.manifest(df, str(tmp_path / "man"), 42, ["shard"])
    assert '"rows" : 3' in "\n".join(r[0] for r in spark.read.text(str(tmp_path / "man")).collect())
    assert writers.append_new(df, df.where("shard = 1"), ["shard"]).count() == 1
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("step 00001/10 (1%) | loss: 3.5 |\nstep 00002/10 (2%) | loss: 2.5 |\ndone\n")
    out = SL.latest(SL.tail(spark, str(tmp_path / "logs")))
    q = out.writeStream.outputMode("complete").format("memory").queryName("latest_steps").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.sql("SELECT step, loss FROM latest_steps").collect()] == [(2, 2.5)]


@pytest.mark.parametrize(
    ("call", "want"),
    [("12/60=0.2", "0.2"), ("1,000 + 5", "1005"), ("2**9", None), ("'strawberry'.count('r')", "3"), ("__import__('os')", None), ("1/0", None), ("7 // 2\nmore", "3"), ("", None), (None, None), ("open('x').count('a')", None)],
)
def test_calculator(call, want):
    assert calculate(call) == want


def test_sequences(spark):
    r = spark.sql("SELECT array(array(1, 2, 3, 9), array(1, 2, 4, 9)) AS s, array(5, 6, 7, 8) AS ids, array(0.5D, 1.5D, 2.5D, 3.5D) AS losses, array(6, 7, 0, 0) AS p")
    x = r.select(
        Q.common_length(F.col("s")).alias("a"), Q.common_length(F.col("s"), True).alias("b"), Q.span_mean(F.col("losses"), F.lit(1), F.lit(3)).alias("m"), Q.span_matches(F.col("p"), F.col("ids"), F.lit(1), F.lit(3)).alias("ok"),
        Q.fit(F.col("ids"), F.lit(2), F.lit(4), 3, "truncate").alias("f"), Q.fit(F.col("ids"), F.lit(0), F.lit(4), 3, "truncate").alias("g"), Q.padded(F.array(F.col("ids"), F.array(F.lit(1))), F.lit(0)).alias("pad"),
    ).first()
    assert (x["a"], x["b"], x["m"], x["ok"], x["f"]["ids"], x["f"]["start"], x["g"]) == (2, 1, 1.0, True, [6, 7, 8], 1, None) and x["pad"][1] == [1, 0, 0, 0]


def test_prompts(spark):
    d = spark.sql("SELECT 'Q' AS query, array('a', 'b') AS choices, array(struct('P' AS query, array('x', 'y') AS choices, 1 AS gold)) AS shots, ' c ' AS context, array(struct('k ' AS context, 'v' AS continuation)) AS lm")
    x = d.select(Q.prompts_choice(F.col("query"), F.col("choices"), F.col("shots"), ": ").alias("m"), Q.prompts_continuation(F.col("context"), F.lit("w"), F.col("lm"), " ").alias("l")).first()
    assert x["m"] == ["P: y\n\nQ: a", "P: y\n\nQ: b"] and x["l"] == ["k v\n\nc", "k v\n\nc w"]


def test_decisions(spark):
    runs = spark.createDataFrame([("a", "full_confirm", 5.0, 28.0), ("a", "full_confirm", 4.0, 27.0), ("b", "full_confirm", 1.0, 30.0), ("c", "oom", None, None)], "g string, status string, gsm8k_pass8 double, mmlu double")
    assert {r["g"]: r["decision"] for r in D.promotion(runs, "g").collect()} == {"a": "promote", "b": "hold", "c": "failed"}
    assert D.rebalanced({"reasoning": 5, "x": 10}, 12) == {"reasoning": 2, "x": 10} and D.rebalanced({"x": 20}, 5)["reasoning"] == 0
    go, failed = D.stability({"rows": F.col("mmlu") > 20, "gsm": F.col("gsm8k_pass8") > 2})
    assert [tuple(r) for r in runs.where("g = 'b'").select(go, failed).collect()] == [("NO_GO", ["gsm"])]


def test_anchor_classes(spark):
    for text, want in (("My budget is small", "information_seeking"), ("a phishing mail", ""), ("compare these", "reasoning"), ("a physics budget", "information_seeking"), ("hello", "grounded_qa")):
        assert one(spark, X.classify_anchor(F.col("t")), t=text) == want


def test_curation(spark):
    from cairnwork.plans import curation

    long = "The sum of the two given numbers is found by adding them together one at a time. "
    rows = [
        (0, "Explain the physics of a falling ball in simple words please.", long + "Final answer: 4."), (1, "explain the PHYSICS of a falling ball in simple words please.", long), (2, "Write a function in python that adds two numbers together.", long),
        (3, "too short", long), (4, "Solve this riddle about a knight and a liar who both sit at a table.", long), (5, "A riddle about seating three guests around a small round table now.", long + "It ends here."), (6, "Another planet question that asks about orbits of distant stars.", "```x```"),
    ]
    d = spark.createDataFrame(rows, "ord long, user string, assistant string")
    got = curation.curate(d, "s", curation.quota_table(spark, {"science": 5, "puzzle": 1})).orderBy("ord").collect()
    assert got[0]["assistant"].startswith("Answer: 4\nWhy: The sum")
    best = max((r for r in rows if r[0] in (4, 5)), key=lambda r: (max(0, 900 - len(r[2].strip())) * 10_000 + max(0, 220 - len(r[2].split())) * 1_000 + max(0, 700 - len(r[1]))))
    assert got[1]["ord"] == best[0]
