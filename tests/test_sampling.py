"""Sampling from logits: independence of samples, seeds, temperature 0, counts, top-k, and the probabilities themselves."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from cairnwork.operators import sampling as S


def drawn(df, **how):
    return {(r["idx"], r["sample"]): r["token"] for r in S.samples(df, "idx", "logits", **how).collect()}


@pytest.fixture(scope="module")
def level(spark):
    """Rows whose tokens are all as likely."""
    return spark.createDataFrame([(k, [0.0] * 262) for k in range(3)], "idx int, logits array<double>").cache()


def test_samples_of_a_prompt_differ(level):
    got = drawn(level, n=16)
    assert all(len({got[k, s] for s in range(16)}) > 8 for k in range(3))


def test_a_seed_draws_again_the_same_and_others_differ(level):
    runs = [tuple(sorted(drawn(level, n=4, seed=s).items())) for s in (1, 42, 123, 999)]
    assert runs[1] == tuple(sorted(drawn(level.repartition(3), n=4, seed=42).items())) and len(set(runs)) == 4


def test_steps_draw_for_themselves(spark, level):
    d = level.crossJoin(spark.range(8).withColumnRenamed("id", "place"))
    rows = d.select("idx", "place", S.next_token(F.col("logits"), F.lit(1), F.col("idx"), F.col("place")).alias("t")).collect()
    assert len({r["t"] for r in rows if r["idx"] == 0}) > 4


def test_temperature_zero_takes_the_first_greatest_whatever_the_seed(spark):
    d = spark.createDataFrame([(0, [1.0, 3.0, 3.0]), (1, [-5.0, -math.inf]), (2, []), (3, None), (4, [None, math.nan, 2.0])], "idx int, logits array<double>")
    want = {(0, 0): 1, (1, 0): 0, (2, 0): None, (3, 0): None, (4, 0): 2}
    assert drawn(d, temperature=0.0) == drawn(d, temperature=0.0, seed=7) == want
    assert drawn(d, temperature=0.7, top_k=1) == want | {(0, 0): 1}
    with pytest.raises(ValueError):
        drawn(d, temperature=-0.1)


def test_n_samples_are_n_rows(level):
    assert [S.samples(level, "idx", "logits", n=n).count() for n in (1, 4, 64)] == [3, 12, 192]


def test_draws_follow_the_probabilities(spark):
    logits = [2.0, 1.0, 0.0, -1.0, 1.0]
    d = spark.range(20_000).select(F.col("id").cast("int").alias("idx"), F.array(*map(F.lit, logits)).alias("logits"))
    for temperature, top_k in ((1.0, None), (0.5, None), (1.5, 3), (1.0, 99)):
        kept = sorted(range(5), key=lambda k: (-logits[k], k))[: top_k or 5]
        weight = {k: math.exp(logits[k] / temperature) for k in kept}
        n = {r["token"]: r["count"] for r in S.samples(d, "idx", "logits", temperature=temperature, top_k=top_k).groupBy("token").count().collect()}
        assert set(n) <= set(kept)
        for k in kept:
            p = weight[k] / sum(weight.values())
            assert abs(n.get(k, 0) - 20_000 * p) < 5 * math.sqrt(20_000 * p * (1 - p))
