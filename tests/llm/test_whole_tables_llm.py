"""Sources below a block, row numbers and vector widths over whole tables."""

import random

import pytest
from pyspark.sql import functions as F


def test_small_sources_meet_their_target(spark):
    """One large source and 60 far below a block: each is taken as its target asks."""
    from cairnwork.llm import mixing

    rows = [(i, "w " * 5000, "big") for i in range(40)] + [(100 + i, "w " * (1 + i), f"s{i:02d}") for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(d, slots=256).groupBy("doc_id", "target").agg(F.sum("taken").alias("taken")).where("doc_id >= 100").collect()
    assert len(out) == 60 and all(r["taken"] == max(1, round(r["target"])) for r in out)
    parts = mixing.mixture(d, slots=256)
    assert parts.where("source <> 'big'").select("source").distinct().count() == 60
    assert parts.groupBy("slot").agg(F.countDistinct("source").alias("n")).where("n > 1").count() == 0


def test_row_numbers_outlast_other_splits(spark, tmp_path):
    """The same rows have the same numbers when file splits change between two jobs."""
    import corpus_pipeline

    spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.sha1(F.col("id").cast("string").cast("binary")), 20).alias("text")).repartition(6).write.parquet(str(tmp_path / "d"))
    rows = corpus_pipeline._numbered(spark.read.parquet(str(tmp_path / "d")))
    seen = []
    most = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "64k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            seen.append({r["doc_id"]: r[corpus_pipeline.ROW] for r in rows.select("doc_id", corpus_pipeline.ROW).alias(size).collect()})
            rows = rows.select("*")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
    assert len(set(seen[0].values())) == 4000 and seen[0] == seen[1]


def test_near_vectors_of_many_widths(spark):
    """Two near vectors of each of 1,200 widths: every pair links."""
    from cairnwork.llm import embeddings

    rows = [(2 * w + k, [1.0] * w + [1.0 + 0.01 * k]) for w in range(1200) for k in (0, 1)]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in got} == {(i, 1, i - i % 2) for i, _ in rows}
