"""Queries of reports, result rows, run histories, templates and token views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequences as S
from ..operators import loading as L
from ..operators import reports as R
from ..sources import readers
from .registry import query, read

_METRICS = "SELECT ['base', 'sft', 'rl'][user_id % 3 + 1] AS stage, CASE event_type WHEN 'click' THEN 'CORE' WHEN 'purchase' THEN 'ChatCORE' ELSE event_type || ' of all events' END AS metric, count(*)::VARCHAR AS value FROM events WHERE user_id % 5 <> 0 OR event_type <> 'click' GROUP BY 1, 2"
_PAD = "CASE WHEN length({0}) >= {1} THEN {0} ELSE rpad({0}, {1}, ' ') END"


@query(f"""WITH m AS ({_METRICS}), p AS (SELECT metric, coalesce(max(value) FILTER (stage = 'base'), '-') AS a, coalesce(max(value) FILTER (stage = 'sft'), '-') AS b, coalesce(max(value) FILTER (stage = 'rl'), '-') AS c FROM m GROUP BY 1)
    SELECT row_number() OVER (ORDER BY metric <> 'CORE', metric = 'ChatCORE', metric) AS place, metric,
    '| ' || {_PAD.format("metric", 15)} || ' | ' || {_PAD.format("a", 8)} || ' | ' || {_PAD.format("b", 8)} || ' | ' || {_PAD.format("c", 8)} || ' |' AS line FROM p""")
def k08_u06_metric_table(spark, sf_dir):
    from pyspark.sql import Window as W

    kind = F.when(F.col("event_type") == "click", "CORE").when(F.col("event_type") == "purchase", "ChatCORE").otherwise(F.concat("event_type", F.lit(" of all events")))
    e = read(spark, sf_dir, "events").where("user_id % 5 <> 0 OR event_type <> 'click'")
    m = e.groupBy(F.array(*map(F.lit, R.STAGES))[(F.col("user_id") % 3).cast("int")].alias("stage"), kind.alias("metric")).agg(F.count("*").cast("string").alias("value"))
    return R.metric_table(m).withColumn("place", F.row_number().over(W.orderBy(*R.metric_order(F.col("metric")))).cast("long"))  # a row a metric


@query("""SELECT user_id, CASE WHEN s IS NULL OR e IS NULL THEN 'unknown' ELSE (date_diff('second', s, e) // 3600)::VARCHAR || 'h' || (date_diff('second', s, e) % 3600 // 60)::VARCHAR || 'm' END AS total FROM
    (SELECT user_id, date_trunc('second', min(ts)) AS s, date_trunc('second', max(ts) FILTER (event_type <> 'view')) AS e FROM events GROUP BY 1) WHERE e IS NULL OR e >= s""")
def l10_wall_clock(spark, sf_dir):
    g = read(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("s"), F.max(F.when(F.col("event_type") != "view", F.col("ts"))).alias("e"))
    return g.select("user_id", R.wall_clock(F.col("s"), F.col("e")).alias("total"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'NA' ELSE coalesce(event_type, 'NA') END AS score, CASE WHEN event_type = 'error' THEN '-1' ELSE user_id::VARCHAR END AS steps FROM events")
def k05_result_rows(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("score"), F.col("user_id").alias("steps"), (F.col("event_type") != "error").alias("ok"))
    return R.result_rows(e, ["score", "steps"], "ok")


@query("SELECT 0 AS part, '| n_nationkey | n_name |' AS line UNION ALL SELECT 1, '|---|---|' UNION ALL SELECT 2, '| ' || n_nationkey || ' | ' || n_name || ' |' FROM nation")
def k09_k15_markdown_rows(spark, sf_dir):
    return R.markdown_rows(read(spark, sf_dir, "nation"), ["n_nationkey", "n_name"], with_header=True)


@query("SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN (event_id % 1000 / 8.0)::DOUBLE END AS core, CASE WHEN event_id % 2 = 0 THEN (event_id % 100 / 4.0)::DOUBLE END AS val_bpb FROM events")
def l12_final_scores(spark, sf_dir):
    i = F.col("event_id")
    log = F.concat(F.lit("step 1\n"), F.when(i % 3 != 0, F.concat(F.lit("CORE metric: "), (i % 1000 / 8.0).cast("string"), F.lit("\n"))).otherwise(""), F.when(i % 2 == 0, F.concat(F.lit("Validation bpb: "), (i % 100 / 4.0).cast("string"))).otherwise(""))
    return read(spark, sf_dir, "events").select("event_id", R.final_scores(log).alias("s")).select("event_id", "s.*")


@query("""WITH t AS (SELECT user_id AS run, event_id % 3 AS place, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) = 1 AS ok, CASE WHEN user_id % 7 = 0 AND event_id % 3 = 1 THEN 3001 ELSE 4096 END AS batch FROM events GROUP BY ALL),
    k AS (SELECT run, place, CASE WHEN batch % 1024 <> 0 THEN 'error' WHEN ok THEN ['a', 'b', 'c'][place + 1] END AS kind FROM t)
    SELECT run, coalesce(arg_min(kind, place) FILTER (kind IS NOT NULL), 'fail') AS result FROM k GROUP BY 1""")
def g12_ladder(spark, sf_dir):
    tries = spark.createDataFrame(R.attempts("a:1024:4096,b:1024:4096,c:1024:4096"), "place long, label string, length long, batch long")
    e = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run"), (F.col("event_id") % 3).alias("place")).agg(F.bool_or(F.col("event_type") == "purchase").alias("ok"))
    d = e.join(F.broadcast(tries), "place").withColumn("batch", F.when((F.col("run") % 7 == 0) & (F.col("place") == 1), 3001).otherwise(F.col("batch")))
    return R.ladder(d)


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 50")
def f03_scan_limit(spark, sf_dir):
    return L.scan_limit(read(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 50)


@query("SELECT doc_id AS idx, 'SmolTalk' AS task FROM documents UNION ALL SELECT item_id, 'MMLU' FROM benchmark WHERE item_id < 5200 UNION ALL SELECT doc_id, 'GSM8K' FROM labels WHERE doc_id < 420")
def u03_fixed_mixture(spark, sf_dir):
    t = lambda name, c: read(spark, sf_dir, name).select(F.col(c).alias("idx"))
    return L.fixed_mixture({"SmolTalk": t("documents", "doc_id"), "MMLU": t("benchmark", "item_id"), "GSM8K": t("labels", "doc_id")}, "idx", L.VALIDATION_ROWS)


@query("SELECT event_id, (1 + event_id * 4) % 300 AS \"cursor\", (1 + event_id * 4) // 300 + 1 AS epoch, (1 + event_id * 4) / 300.0::DOUBLE AS progress, 1 + event_id * 4 >= 300 AS last FROM events")
def q16_consumed(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", L.consumed(F.col("event_id"), 1, 4, 300).alias("c")).select("event_id", "c.*")


@query("""WITH p AS (SELECT 'run' || user_id AS run, user_id, event_id AS step, event_type AS key, CASE WHEN event_id % 5 <> 0 THEN value END AS value FROM events WHERE user_id % 2 = 1),
    f AS (SELECT run, min(CASE key WHEN 'purchase' THEN 1 ELSE 2 END) AS k FROM p WHERE key IN ('purchase', 'click') GROUP BY 1),
    r AS (SELECT p.run, p.key, p.step, p.value FROM p JOIN f ON p.run = f.run AND p.key = ['purchase', 'click'][f.k] WHERE p.value IS NOT NULL)
    SELECT r.* FROM r WHERE run IN (SELECT run FROM r GROUP BY 1 HAVING count(*) >= 2 ORDER BY run LIMIT 12)""")
def s24_history(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.concat(F.lit("run"), "user_id").alias("run"), F.col("event_id").alias("step"), F.col("event_type").alias("key"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"))
    return readers.history(e, ["purchase", "click"], pattern=r"^run\d*[13579]$")


@query("SELECT n_nationkey, n_name FROM nation")
def s11_unwrapped(spark, sf_dir):
    return readers.unwrapped(read(spark, sf_dir, "nation").select(F.struct("n_nationkey", "n_name").alias("train"), F.lit(1).alias("other")), "train")


@query("""SELECT i AS idx, 'A store sells notebooks for $' || p || ' each. If I buy ' || n || ' notebooks, what do they cost?' AS question, n || ' * ' || p || ' = ' || n * p || ' dollars.' AS answer
    FROM (SELECT i, i % 20 + 2 AS n, i // 20 + 3 AS p FROM generate_series(0, 239) t(i))""")
def s27_templates(spark, sf_dir):
    from ..operators.guards import require_rows

    question = F.format_string("A store sells notebooks for $%d each. If I buy %d notebooks, what do they cost?", "p", "n")
    answer = F.format_string("%d * %d = %d dollars.", "n", "p", F.col("n") * F.col("p"))
    return require_rows(readers.from_templates(spark, [(i % 20 + 2, i // 20 + 3) for i in range(240)], "n long, p long", question, answer), 200)


@query(r"""SELECT doc_id, md5(array_to_string(list_transform(list_filter(string_split(text, ' '), lambda x: x <> ''), lambda w: CASE WHEN length(w) % 2 = 1 THEN chr(27) || '[92m' ELSE chr(27) || '[91m' END || w || chr(27) || '[0m'), '|')) AS view FROM documents""")
def q11_token_view(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.filter(F.split("text", " "), lambda w: w != "").alias("pieces"))
    return d.select("doc_id", F.md5(S.token_view(F.col("pieces"), F.transform("pieces", lambda w: F.length(w) % 2))).alias("view"))
