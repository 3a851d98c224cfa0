"""Queries and operators over whole tables: nothing filtered, capped or out of reach."""

import hashlib
import os
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from cairnwork import catalog
from cairnwork.functions import text as X
from cairnwork.operators import ordered as O
from cairnwork.operators import tokenizer as T

DATA = "/root/testdata/sf0.01"


def sql(name):
    """Rows of a query's oracle SQL on tables whose ids go beyond the fixed ranges of the narrow queries."""
    con = duckdb.connect()
    for f in os.listdir(DATA):
        if f.endswith(".parquet"):
            con.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    return con.execute(catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", ["t12_shuffled_order", "s05_document_epochs", "q04_q05_q08_round_trip", "u02_sequence"])
def test_all_rows(spark, name):
    want = sql(name)
    cols = [c[0] for c in want.description]
    assert sorted(map(tuple, catalog.queries()[name](spark, DATA).select(*cols).collect())) == sorted(want.fetchall())


def test_shuffled_places(spark):
    ids = [3 * i for i in range(1500)]
    got = {r["i"]: r["place"] for r in O.shuffled_places(spark.createDataFrame([(i,) for i in ids], "i long").repartition(5), "i", 7).collect()}
    assert got == {i: k for k, i in enumerate(sorted(ids, key=lambda i: hashlib.sha1(f"7:{i}".encode()).hexdigest()))}


def test_epochs_of_every_rank(spark):
    d = spark.range(10)
    assert {(r["id"], r["rank"], r["epoch"]) for r in O.epochs(d, 2, "id", world=3).collect()} == {(i, i % 3, e) for i in range(10) for e in (1, 2)}
    assert sorted(r["id"] for r in O.epochs(d, 1, "id", 2, 3).collect()) == [2, 5, 8]


def plain_train(counts, n):
    """Merges one at a time, each from counts taken anew."""
    words, merges = {t: [bytes([b]) for b in t.encode()] for t in counts}, []
    while len(merges) < n:
        pairs = Counter()
        for t, w in words.items():
            for p in zip(w, w[1:], strict=False):
                pairs[p] += counts[t]
        if not pairs:
            break
        merges.append(max(pairs, key=lambda p: (pairs[p], p)))
        words = {t: T.apply_merges(w, merges[-1:]) for t, w in words.items()}
    return merges


def test_merges_one_at_a_time(spark):
    r = random.Random(5)
    texts = [" ".join("".join(r.choice("aab") for _ in range(r.randint(1, 9))) for _ in range(30)) for _ in range(20)] + ["aaaa aaa", "café ☃☃☃ 12 12", "", None]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    counts = {x["t"]: x["n"] for x in docs.select(F.explode(X.pretokens(F.col("text"))).alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}
    want = plain_train(counts, 40)
    for pending in (T.PENDING, 3):
        assert T.train(docs, 256 + 9 + 40, pending=pending) == want
    few = spark.createDataFrame([("ab ab",)], "text string")
    assert T.train(few, 320) == plain_train({"ab": 1, " ab": 1}, 55)


def test_rare_words_count(spark):
    """520,000 words of one use outweigh the frequent ones only if none is left out."""
    rare = spark.range(520_000).select(F.concat(F.lit("q"), F.translate(F.lpad(F.conv(F.col("id").cast("string"), 10, 16), 5, "0"), "0123456789ABCDEF", "cdefghijklmnoprs")).alias("text"))
    often = spark.range(510_000).select(F.lit("zv").alias("text"))
    assert T.train(rare.select(F.concat("text", F.lit("qx")).alias("text")).union(often), 256 + 9 + 1) == [(b"q", b"x")]


def test_token_bytes_of_the_corpus(spark):
    small = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{small}/documents.parquet")
    counts = {x["t"]: x["n"] for x in d.select(F.explode(X.pretokens(F.col("text"))).alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}
    sizes = [1] * 256 + [len(a + b) for a, b in plain_train(counts, 135)] + [0] * 9
    got = catalog.queries()["q06_q07_token_bytes"](spark, small).collect()
    assert sorted(map(tuple, got)) == list(enumerate(sizes)) and max(sizes) > 1


def test_few_shot_from_all_rows(spark):
    ids = [64 * i for i in range(300)]
    d = spark.createDataFrame([(i,) for i in ids], "i long").repartition(4)
    per = {}
    for r in O.few_shot(d, "i", 3).collect():
        per.setdefault(r["idx"], {})[r["place"]] = r["shot"]
    assert set(per) == set(ids)
    assert all(set(p) == {1, 2, 3} and len(set(p.values())) == 3 and i not in p.values() and set(p.values()) <= set(ids) for i, p in per.items())
    assert max(abs(i - s) for i, p in per.items() for s in p.values()) > 64 * 150
    assert {(r["idx"], r["shot"]) for r in O.few_shot(d.where("i < 192"), "i", 3).collect()} == {(a, b) for a in ids[:3] for b in ids[:3] if a != b}
    assert O.few_shot(d.where("i = 0"), "i", 3).collect() == [] == O.few_shot(d.limit(0), "i", 3).collect()
    out = catalog.queries()["j05_u07_few_shot"](spark, DATA)
    assert out.count() == 3000 and out.where("idx div 64 <> shot div 64").count() > 0


def test_sequence_starts_after_the_last_id(spark):
    a, b = spark.range(250), spark.range(5)
    got = [tuple(r) for r in O.sequence([(a, "id"), (b, "id"), (b, "id")]).orderBy("idx").collect()]
    assert got == [(0, i) for i in range(250)] + [(1, 250 + i) for i in range(5)] + [(2, 255 + i) for i in range(5)]
    assert sorted(tuple(r) for r in O.sequence([(a.limit(0), "id"), (b, "id")]).collect()) == [(1, i) for i in range(5)]
