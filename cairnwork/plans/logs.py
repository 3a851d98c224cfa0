"""Queries over log lines that are written from the events and parsed again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import logs as L
from ..streaming.decoding import decoded
from .registry import query, read


def lines(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    text = F.format_string("step %05d/200000 (%.2f%%) | loss: %.6f | lrm: 1.00 | dt: %.2fms | tok/sec: %,d | mfu: 0.00 | epoch: 1 | total time: 0.00m", "event_id", F.col("event_id") / 2000.0, F.col("value"), F.col("value") * 10, (F.col("value") * 100).cast("long"))
    return e.select("user_id", "event_id", text.alias("line"))


@query("SELECT event_id AS step, 200000::BIGINT AS total, round(value, 6) AS loss, CAST(trunc(value * 100) AS BIGINT) AS tok_per_sec FROM events")
def l01_step_lines(spark, sf_dir):
    s = lines(spark, sf_dir).select(L.step_line(F.col("line")).alias("s"))
    return s.select("s.step", "s.total", "s.loss", "s.tok_per_sec")


@query("SELECT user_id, max(event_id) AS last_step, round(arg_max(value, event_id), 6) AS last_loss FROM events GROUP BY 1")
def l03_l04_last_match(spark, sf_dir):
    s = lines(spark, sf_dir).select("user_id", "event_id", L.step_line(F.col("line")).alias("s"))
    return s.groupBy("user_id").agg(F.max("s.step").alias("last_step"), F.max_by("s.loss", "event_id").alias("last_loss"))


@query("SELECT user_id, CASE WHEN bool_or(event_type = 'purchase' AND value > 400) THEN 'done' WHEN bool_or(value > 480) THEN 'gate' WHEN bool_or(value < 0.05) THEN 'error' ELSE 'running' END AS state FROM events GROUP BY 1")
def l05_terminal_state(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    f = {"done": F.bool_or((F.col("event_type") == "purchase") & (F.col("value") > 400)), "gate": F.bool_or(F.col("value") > 480), "error": F.bool_or(F.col("value") < 0.05), "exhausted": F.lit(False)}
    return e.groupBy("user_id").agg(L.terminal_state(f).alias("state"))


@query("SELECT event_id, value FROM events WHERE event_id % 100 = 0")
def k12_log_every(spark, sf_dir):
    return read(spark, sf_dir, "events").where("event_id % 100 = 0").select("event_id", "value")


@query("""SELECT doc_id, count_if(clean)::BIGINT AS parts, md5(any_value(text)) AS text_md5 FROM (SELECT doc_id, text, CASE WHEN e = n THEN true ELSE NOT ('0x' || hex(encode(text))[2 * e + 1:2 * e + 2])::INT BETWEEN 128 AND 191 END AS clean
    FROM (SELECT doc_id, text, octet_length(encode(text)) AS n, least(unnest(range(61, octet_length(encode(text)) + 61, 61)), octet_length(encode(text))) AS e FROM documents)) GROUP BY doc_id""")
def st07_incremental_text(spark, sf_dir):
    """Documents cut into chunks of 61 bytes: how many let text out, and all that they let out."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("raw")).where("octet_length(raw) > 0")
    chunks = d.select("doc_id", "raw", F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("raw") - 1) / 61).cast("int"))).alias("seq")).select("doc_id", "seq", F.expr("substr(raw, seq * 61 + 1, 61)").alias("piece"))
    out = decoded(chunks, "doc_id", "seq", "piece")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "")
    return out.groupBy("doc_id").agg(F.count("*").alias("parts"), F.md5(text.cast("binary")).alias("text_md5"))
