"""Queries of guards, gates, the training loop's reader and its schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import guards as G
from ..operators import loading as L
from ..sources.row_groups import RowGroups
from .registry import query, read


@query("""SELECT epoch, pq_idx, rg_idx, batch_idx, count(*) AS n, min(doc_id) AS first_doc FROM
    (SELECT doc_id, doc_id // 256 AS pq_idx, (doc_id // 16) % 16 AS rg_idx, (doc_id % 16) // 5 AS batch_idx, e::INT AS epoch FROM documents, generate_series(2, 3) t(e))
    WHERE rg_idx % 3 = 1 AND (epoch > 2 OR pq_idx > 1 OR (pq_idx = 1 AND rg_idx >= 10)) GROUP BY 1, 2, 3, 4""")
def s05_s06_batches_after_cursor(spark, sf_dir):
    d = read(spark, sf_dir, "documents").selectExpr("doc_id", "doc_id div 256 AS pq_idx", "(doc_id div 16) % 16 AS rg_idx", "doc_id % 16 AS pos")
    out = L.document_batches(d, rank=1, world=3, batch=5, epochs=2, cursor=(1, 8, 2))
    return out.groupBy("epoch", "pq_idx", "rg_idx", "batch_idx").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query("SELECT doc_id, md5(text) AS text_md5, e::INT AS epoch FROM documents, generate_series(1, 2) t(e)")
def s05_st05_row_group_source(spark, sf_dir):
    """Two epochs of whole row groups, read from the files in the order of training."""
    spark.dataSource.register(RowGroups)
    d = spark.read.format("row_groups").options(path=f"{sf_dir}/documents.parquet", columns="doc_id,text", epochs="2").load()
    return d.select("epoch", "doc_id", F.md5("text").alias("text_md5"))


@query("""SELECT s AS step, CASE WHEN s < 10 THEN (s + 1) / 10.0 WHEN s <= 500 THEN 1.0 ELSE (1000 - s) / 500.0 + (1 - (1000 - s) / 500.0) * 0.1 END AS base,
    CASE WHEN s / 1000.0 < 0.05 THEN s / 1000.0 / 0.05 WHEN s / 1000.0 < 0.8 THEN 1.0 ELSE greatest(0.0, (1 - s / 1000.0) / 0.2) END AS tuning, 1.0 - s / 1000.0 AS reward,
    (1 - least(s / 300.0, 1.0)) * 0.85 + least(s / 300.0, 1.0) * 0.95 AS momentum, 0.2 * (1 - s / 1000.0) AS weight_decay FROM (SELECT s::DOUBLE AS s FROM generate_series(0, 999) t(s))""")
def w10_schedules(spark, sf_dir):
    s = F.col("step")
    d = spark.range(1000).select(F.col("id").cast("double").alias("step"))
    return d.select("step", L.base_rate(s, 1000, 0.01, 0.5, 0.1).alias("base"), L.tuning_rate(s / 1000, 0.05, 0.2).alias("tuning"), L.reward_rate(s, 1000).alias("reward"), L.momentum(s).alias("momentum"), L.weight_decay(s, 1000, 0.2).alias("weight_decay"))


@query("SELECT count(*) FILTER (quality = 1) AS high, count(*) AS all_rows FROM labels WHERE quality IN (0, 1)")
def f12_include_medium(spark, sf_dir):
    rows = read(spark, sf_dir, "labels").where("quality IN (0, 1)").select(F.when(F.col("quality") == 1, "high").otherwise("medium").alias("quality"))
    one = lambda medium, name: G.by_quality(rows, medium).agg(F.count("*").alias(name))
    return one(False, "high").crossJoin(one(True, "all_rows"))  # one row each


@query("SELECT p_partkey, ['A', 'B', 'C', 'D'][p_size % 4 + 1] AS answer FROM part")
def f16_answer_in_letters(spark, sf_dir):
    letters = F.array(*[F.lit(c) for c in "ABCD"])
    answer = F.element_at(letters, (F.col("p_size") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", G.answer_in_letters(answer, letters).alias("answer"))


@query("SELECT event_id, value - 100 AS val_bpb FROM events WHERE event_id % 11 <> 0 AND value - 100 > 0")
def f17_valid_runs(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 11 != 0, F.col("value") - 100).alias("val_bpb"))
    return G.valid_runs(e)


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'purchase' AND value > 300) > 0")
def f18_supervised(spark, sf_dir):
    target = F.when((F.col("event_type") == "purchase") & (F.col("value") > 300), F.col("event_id")).otherwise(-1)
    b = read(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(target).alias("targets"), F.count("*").alias("n"))  # a user's events are a batch
    return G.supervised(b).select("user_id", "n")


@query("SELECT 'documents' AS name, 1000 AS least, least(count(*), 1000) AS rows, count(*) >= 1000 AS ok FROM documents UNION ALL SELECT 'benchmark', 1000, least(count(*), 1000), count(*) >= 1000 FROM benchmark UNION ALL SELECT 'region', 5, least(count(*), 5), count(*) >= 5 FROM region")
def f20_enough_rows(spark, sf_dir):
    out = None
    for name, least in (("documents", 1000), ("benchmark", 1000), ("region", 5)):
        one = G.enough_rows(read(spark, sf_dir, name), least).select(F.lit(name).alias("name"), F.lit(least).alias("least"), "rows", "ok")
        out = one if out is None else out.unionByName(one)
    return out


_RUNS = "(SELECT user_id, max(value) FILTER (event_type = 'purchase') / 100 AS a8, min(value) FILTER (event_type = 'purchase') AS am, max(value) FILTER (event_type = 'click') / 100 AS b8, min(value) FILTER (event_type = 'click') AS bm, count(*) % 2 = 0 AS whole FROM events GROUP BY 1)"


@query(f"SELECT user_id, CASE WHEN whole AND a8 >= 4.0 AND am >= 27.0 THEN 'promoted_v3_candidate' WHEN whole AND b8 >= 4.0 AND bm >= 27.0 THEN 'promoted_v4_candidate' ELSE 'hold_mixv2_provisional' END AS decision, CASE WHEN am >= 20.0 THEN 'full_confirm' ELSE 'quick_gate_failed' END AS quick FROM {_RUNS}")
def g07_g09_branches(spark, sf_dir):
    best = lambda kind, f: f(F.when(F.col("event_type") == kind, F.col("value")))
    r = read(spark, sf_dir, "events").groupBy("user_id").agg(
        (best("purchase", F.max) / 100).alias("a8"), best("purchase", F.min).alias("am"), (best("click", F.max) / 100).alias("b8"), best("click", F.min).alias("bm"), F.when(F.count("*") % 2 == 0, "full_confirm_complete").otherwise("failed").alias("status"),
    )
    ok = [G.confirmed(F.col("status"), F.col(f"{x}8"), F.col(f"{x}m")) for x in "ab"]
    return r.select("user_id", G.branch(*ok).alias("decision"), G.quick_status(F.col("am"), 20.0).alias("quick"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'fixed' WHEN event_id % 3 = 0 THEN 'standard' WHEN event_id % 2 = 0 THEN 'fixed' ELSE 'failed' END AS policy FROM events")
def g11_overflow_policy(spark, sf_dir):
    i = F.col("event_id")
    log = F.when(i % 2 == 0, "error: Sequence length 6001 > 5120").otherwise("error: out of memory")
    return read(spark, sf_dir, "events").select("event_id", G.overflow_policy(i % 7 == 0, F.when(i % 3 == 0, 0).otherwise(1), log).alias("policy"))


@query("SELECT n_nationkey, (0.5 * n_nationkey + 1 + 0.25 * n_regionkey) / 2 AS estimate FROM nation")
def a22_mean_of_two(spark, sf_dir):
    return read(spark, sf_dir, "nation").select("n_nationkey", G.mean_of_two(0.5 * F.col("n_nationkey") + 1, 0.25 * F.col("n_regionkey")).alias("estimate"))


@query("SELECT count(*) AS total_workers, count(*) FILTER (NOT s_acctbal < 0) AS available_workers, count(*) FILTER (s_acctbal < 0) AS busy_workers FROM supplier")
def a29_worker_pool(spark, sf_dir):
    return G.pool(read(spark, sf_dir, "supplier").withColumn("busy", F.col("s_acctbal") < 0), "busy")


@query("SELECT user_id, event_id, r AS from_end FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 3")
def w07_tail(spark, sf_dir):
    return G.tail(read(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", 3).select("user_id", "event_id", F.col("from_end").cast("long"))
