"""Greedy rows and first fit by falling length against plain loops."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnwork.operators import packing_rows as P
from cairnwork.operators.ordered import at_or_after, chain
from cairnwork.operators.packing import metrics


def plain_greedy(docs, capacity, crop):
    out, row, left = [], 0, capacity
    for doc, n in docs:
        own = n if crop else min(n, capacity)
        if not crop and own > left:
            row, left = row + 1, capacity
        used = min(own, left)
        out.append((row, doc, used, n - used, capacity - left))
        left -= used
        if not left:
            row, left = row + 1, capacity
    return out


def plain_first_fit(docs, capacity):
    free, out = [], []
    for doc, n in sorted(docs, key=lambda d: (-min(d[1], capacity), d[0])):
        own = min(n, capacity)
        row = next((k for k, f in enumerate(free) if f >= own), len(free))
        if row == len(free):
            free.append(capacity)
        out.append((row, doc, own, n - own, capacity - free[row]))
        free[row] -= own
    return out


@pytest.fixture(scope="module")
def docs(spark):
    draw = random.Random(11)
    rows = [(k * 3, draw.choice([0, 1, 2, 7, 7, 30, 64, 65, 200, None])) for k in range(500)]
    return [(d, n) for d, n in rows if n], spark.createDataFrame(rows, "doc_id long, n long").repartition(3).cache()


COLUMNS = ["row", "doc", "used", "lost", "offset"]


@pytest.mark.parametrize("crop", [True, False])
def test_greedy(docs, crop):
    own, df = docs
    got = [tuple(r) for r in P.greedy(df, "doc_id", F.col("n"), 64, crop).select(COLUMNS).collect()]
    assert sorted(got) == sorted(plain_greedy(own, 64, crop))
    assert P.greedy(df.limit(0), "doc_id", F.col("n"), 64, crop).count() == 0


def test_first_fit_by_falling_length(docs):
    own, df = docs
    packed = P.first_fit_decreasing(df, "doc_id", F.col("n"), 64)
    assert sorted(tuple(r) for r in packed.select(COLUMNS).collect()) == sorted(plain_first_fit(own, 64))
    assert metrics(packed, 64).first()["utilisation"] > metrics(P.greedy(df, "doc_id", F.col("n"), 64, False), 64).first()["utilisation"]
    assert P.first_fit_decreasing(df.limit(0), "doc_id", F.col("n"), 64).count() == 0


def test_first_fit_runs_of_many_histograms():
    draw = random.Random(12)
    for _ in range(200):
        capacity = draw.randrange(3, 40)
        counts = {draw.randrange(1, capacity + 1): draw.randrange(1, 30) for _ in range(draw.randrange(1, 8))}
        docs = [(n * 1000 + k, n) for n, c in counts.items() for k in range(c)]
        placements, rows = P.first_fit_runs(counts, capacity)
        got = [(row + k // per, n * 1000 + first + k, n, 0, offset + k % per * n) for n, first, count, row, per, offset in placements for k in range(count)]
        want = plain_first_fit(docs, capacity)
        assert sorted(got) == sorted(want) and rows == len({w[0] for w in want})


def test_pointers_over_a_million_nodes(spark):
    """The way along pointers, with 10 ** 6 groups of which some have the same sum."""
    size = np.arange(1_000_000) * 7919 % 37 // 3 * 3
    sums = np.cumsum(size)
    nodes = spark.range(1_000_000).select(F.col("id").alias("node"), (F.floor(F.col("id") * 7919 % 37 / 3) * 3).alias("size"))
    from cairnwork.operators.ordered import sum_before

    d = sum_before(nodes, "node", F.col("size"), "start").select("node", (F.col("start") + F.col("size")).alias("sum"))
    goals = d.select("node", (F.col("sum") + 500_000).alias("goal")).unionByName(spark.createDataFrame([(-1, 500_000)], "node long, goal long"))
    way = {r["steps"]: r["node"] for r in chain(at_or_after(goals, "goal", d.select("sum", F.col("node").alias("next_")), "sum").select("node", "next_"), -1).collect()}
    at, held = [-1], 0
    while (k := int(np.searchsorted(sums, held + 500_000))) < len(sums):
        at.append(k)
        held = int(sums[k])
    assert [way[k] for k in sorted(way)] == at
