"""Queries of packing and tokenizer operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import packing as P
from ..operators import packing_rows as R
from ..operators import tokenizer as T
from .registry import query, read


def _lengths(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "text")


@query()
def q12_best_fit_crop(spark, sf_dir):
    return P.best_fit(_lengths(spark, sf_dir), "doc_id", F.octet_length("text") + 1, 2049)


@query()
def q13_best_fit_pad(spark, sf_dir):
    return P.best_fit(_lengths(spark, sf_dir), "doc_id", F.octet_length("text") + 1, 2049, buffer=100, crop=False)


@query()
def q14_packing_metrics(spark, sf_dir):
    return P.metrics(q12_best_fit_crop(spark, sf_dir), 2049)


def _greedy_sql(crop: bool, capacity: int = 2049) -> str:
    own = "d.n" if crop else f"least(d.n, {capacity})"
    over = f'r."offset" + r.used = {capacity}' if crop else f'r."offset" + r.used + {own} > {capacity}'
    at = f'CASE WHEN {over} THEN 0 ELSE r."offset" + r.used END'
    return f"""WITH RECURSIVE d AS (SELECT doc_id, octet_length(encode(text)) + 1 AS n, row_number() OVER (ORDER BY doc_id) AS k FROM documents),
    r AS (SELECT k, doc_id, n, 0::BIGINT AS "row", 0::BIGINT AS "offset", least(n, {capacity})::BIGINT AS used FROM d WHERE k = 1 UNION ALL
      SELECT d.k, d.doc_id, d.n, r."row" + CASE WHEN {over} THEN 1 ELSE 0 END, {at}, least({own}, {capacity} - ({at})) FROM r JOIN d ON d.k = r.k + 1)
    SELECT 0 AS rank, "row", doc_id AS doc, used, (n - used)::BIGINT AS lost, "offset" FROM r"""


@query(_greedy_sql(True))
def q15_greedy_crop(spark, sf_dir):
    return R.greedy(_lengths(spark, sf_dir), "doc_id", F.octet_length("text") + 1, 2049)


@query(_greedy_sql(False))
def q15_greedy_pad(spark, sf_dir):
    return R.greedy(_lengths(spark, sf_dir), "doc_id", F.octet_length("text") + 1, 2049, crop=False)


@query()
def q15_first_fit_decreasing(spark, sf_dir):
    return R.first_fit_decreasing(_lengths(spark, sf_dir), "doc_id", F.octet_length("text") + 1, 2049)


def _round_trip(d):
    merges = T.train(d, 400)
    e = d.withColumn("ids", T.encode_column(merges, F.col("text")))
    return e.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), (T.decode_column(merges, F.col("ids")) == F.col("text")).alias("same"))


@query("SELECT octet_length(encode(text)) AS n_bytes, doc_id, true AS same FROM documents")
def q04_q05_q08_round_trip(spark, sf_dir):
    return _round_trip(_lengths(spark, sf_dir))


@query()
def q06_q07_token_bytes(spark, sf_dir):
    return T.token_bytes(spark, T.train(_lengths(spark, sf_dir), 400))


@query()
def q02_bpe_merges(spark, sf_dir):
    merges = T.train(_lengths(spark, sf_dir), 320)
    return spark.createDataFrame([(k, a.hex(), b.hex()) for k, (a, b) in enumerate(merges)], "rank int, left string, right string")
