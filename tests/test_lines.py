"""Line numbers of files cut into many splits, and errors that name file and line."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cairnwork.sources import lines as N
from cairnwork.sources import readers


@pytest.fixture
def small_splits(spark):
    own = {"spark.sql.files.maxPartitionBytes": "397", "spark.sql.files.openCostInBytes": "1"}
    kept = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in kept.items():
        spark.conf.set(k, v)


def test_numbers_over_many_splits(small_splits, tmp_path):
    draw, want = random.Random(9), []
    for name, end, last in (("a.log", "\n", True), ("b.log", "\r\n", False), ("c.log", "\n", False), ("d.log", "\n", True)):
        rows = ["" if draw.random() < 0.2 else "x" * draw.randrange(300) + f" {name} {k}" for k in range(120)] + ["end"]
        rows = rows if name != "d.log" else []
        (tmp_path / name).write_bytes((end.join(rows) + end * (last and bool(rows))).encode())
        want += [(name, k + 1, r) for k, r in enumerate(rows)]
    d = N.numbered_lines(small_splits, str(tmp_path), "*.log")
    assert sorted((r["file"].rsplit("/", 1)[1], r["line_no"], r["line"]) for r in d.collect()) == want
    assert small_splits.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    got = readers.log_lines(small_splits, str(tmp_path)).collect()
    assert sorted((r["file"], r["line_no"], r["line"]) for r in got) == want


SCHEMA = "id string, n int"


def test_errors_name_file_and_line(small_splits, tmp_path):
    path = tmp_path / "rows.jsonl"
    good = [f'{{"id": "r{k}", "n": {k}, "more": 1}}' for k in range(200)]
    path.write_text("\n".join([*good[:100], "", "  ", *good[100:]]))
    rows = N.curated_lines(small_splits, str(path), SCHEMA)
    assert sorted((r["line_no"], r["row"]["id"]) for r in rows.collect()) == [(k + 1 + 2 * (k >= 100), f"r{k}") for k in range(200)]
    for bad in ("[1]", '{"id": ', '{"id": "x", "n": "seven"}'):
        path.write_text("\n".join([*good, bad, *good, "{"]))
        with pytest.raises(ValueError, match=r"rows\.jsonl:201: no JSON"):
            N.curated_lines(small_splits, str(path), SCHEMA)
    path.write_text("\n".join(good))
    rule = N.with_rule(N.curated_lines(small_splits, str(path), SCHEMA), F.expr("CASE WHEN row.n >= 150 THEN 'n is too large' END"))
    with pytest.raises(ValueError, match=r"rows\.jsonl:151: n is too large"):
        N.fail_on_first(rule)
    path.write_text("")
    assert N.curated_lines(small_splits, str(path), SCHEMA).count() == 0
