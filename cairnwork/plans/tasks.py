"""Queries of task views, generated items, result tables and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from ..operators import ordered as O
from ..sources import readers, writers
from .registry import query, read


@query("SELECT item_id, 'Multiple Choice question: ' || w[1] || chr(10) || '- ' || w[2] || '=A' || chr(10) || '- ' || w[3] || '=B' || chr(10) || chr(10) || 'Respond only with the letter of the correct answer.' AS prompt FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark) WHERE len(w) >= 3")
def x17_render_choices(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark").select("item_id", F.split("text", " ").alias("w")).where("size(w) >= 3")
    return b.select("item_id", X.render_choices(F.col("w")[0], F.array(F.lit("A"), F.lit("B")), F.slice("w", 2, 2)).alias("prompt"))


@query("SELECT item_id, a IS NOT DISTINCT FROM b AS correct FROM (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN NULL ELSE (item_id * 10)::VARCHAR END AS a, CASE WHEN item_id % 3 = 0 THEN NULL ELSE (item_id * 10 + item_id % 2)::VARCHAR END AS b FROM benchmark)")
def x15_e06_answer_matches(spark, sf_dir):
    write = lambda n: F.when(F.col("item_id") % 3 == 0, "no number").otherwise(F.concat(F.lit("so\n#### "), n.cast("string")))
    b = read(spark, sf_dir, "benchmark").select("item_id", write(F.col("item_id") * 10).alias("a"), write(F.col("item_id") * 10 + F.col("item_id") % 2).alias("b"))
    return b.select("item_id", X.gsm_answer(F.col("a")).eqNullSafe(X.gsm_answer(F.col("b"))).alias("correct"))


@query("SELECT p_partkey, array_to_string(list_filter(string_split(p_name, ''), lambda x: x <> ''), ',') AS spelled, length(p_name) - length(replace(p_name, 'a', '')) AS letters FROM part")
def s26_x18_spelling(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", X.spelled(F.col("p_name")).alias("spelled"), X.letter_count(F.col("p_name"), F.lit("a")).cast("long").alias("letters"))


_draw = lambda k, n: f"(('0x' || sha1(seed || ':{k}')[1:15])::BIGINT % ({n}))"
_list = lambda values: "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"
_items = lambda size, first: f"(SELECT idx, seed, word FROM (SELECT i AS idx, i + {first} AS seed FROM generate_series(0, {size - 1}) t(i)) JOIN (SELECT n_nationkey AS k, lower(n_name) AS word FROM nation) ON k = {_draw(0, '(SELECT count(*) FROM nation)')})"


@query(f"""WITH l AS (SELECT *, CASE WHEN {_draw(1, 10)} < 9 THEN word[{_draw(2, 'length(word)')} + 1] ELSE chr((97 + {_draw(3, 26)})::INT) END AS letter, {_list(V.COUNT_QUESTIONS)}[{_draw(4, len(V.COUNT_QUESTIONS))} + 1] AS asked, {_list(V.QUOTES)}[{_draw(6, 3)} + 1] AS q1, {_list(V.QUOTES)}[{_draw(7, 3)} + 1] AS q2 FROM {_items(1000, 0)}),
    n AS (SELECT *, length(word) - length(replace(word, letter, '')) AS answer FROM l)
    SELECT idx, word, letter, replace(replace(CASE WHEN {_draw(5, 10)} < 3 THEN lower(asked) ELSE asked END, '{{letter}}', q1 || letter || q1), '{{word}}', q2 || word || q2) || CASE WHEN {_draw(8, 2)} = 0 THEN '?' ELSE '' END AS question,
    'We are asked to find the number ''' || letter || ''' in the word ''' || word || '''. Let me try a manual approach first.' || chr(10) || chr(10) || 'First spell the word out:' || chr(10) || word || ':' || array_to_string(string_split(word, ''), ',') || chr(10) || chr(10) || 'Then count the occurrences of ''' || letter || ''':' || chr(10)
        || array_to_string(list_transform(range(1, length(word) + 1), lambda i: i || ':' || word[i] || CASE WHEN word[i] = letter THEN ' hit! count=' || (i - length(replace(word[1:i], letter, ''))) ELSE '' END || chr(10)), '') || chr(10) || 'This gives us ' || answer || '.' AS trace,
    '''' || word || '''.count(''' || letter || ''')' AS call, answer, chr(10) || chr(10) || 'Python gives us ' || answer || '.' || chr(10) || chr(10) || 'My final answer is:' || chr(10) || chr(10) || '#### ' || answer AS final FROM n""")
def s25_x18_generated_items(spark, sf_dir):
    return readers.spelling(spark, _nations(spark, sf_dir), 1000)


@query(f"SELECT idx, 'Spell the word: ' || word AS question, word || ':' || array_to_string(string_split(word, ''), ',') AS answer FROM {_items(500, readers.TEST_SEEDS)}")
def s26_spelled_words(spark, sf_dir):
    return readers.spelled_words(spark, _nations(spark, sf_dir), 500, test=True)


def _nations(spark, sf_dir):
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("idx"), F.lower("n_name").alias("word"))


@query("SELECT 0 AS task, doc_id AS idx FROM documents UNION ALL SELECT 1, (SELECT coalesce(max(doc_id) + 1, 0) FROM documents) + item_id FROM benchmark")
def u02_sequence(spark, sf_dir):
    return O.sequence([(read(spark, sf_dir, "documents"), "doc_id"), (read(spark, sf_dir, "benchmark"), "item_id")])


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha1('1337:' || doc_id), doc_id) AS r FROM documents) WHERE r <= 10")
def t11_seeded_limit(spark, sf_dir):
    d = O.hashed_order(read(spark, sf_dir, "documents").select("source", "doc_id"), "doc_id", 1337)
    return O.top_k(d, "source", 10, F.col("shuffle_key"), F.col("doc_id")).select("source", "doc_id")


@query("SELECT c_custkey, CASE WHEN c_custkey >= 10000 THEN printf('%,d', c_custkey) ELSE c_custkey::VARCHAR END AS whole FROM customer".replace("printf('%,d', c_custkey)", "regexp_replace(c_custkey::VARCHAR, '(\\d)(\\d{3})$', '\\1,\\2')"))
def k07_report_values(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", writers.report_value(F.col("c_custkey"), "bigint").alias("whole"))


@query("SELECT 1 AS part, n_name AS task, rpad(n_name, 35, ' ') || ', ' || rpad(printf('%.6f', n_nationkey / 4.0), 10, ' ') || ', ' || rpad(printf('%.6f', n_nationkey / 8.0), 10, ' ') AS line FROM nation UNION ALL SELECT 2, 'CORE', rpad('CORE', 35, ' ') || ', ' || rpad('', 10, ' ') || ', ' || rpad(printf('%.6f', avg(n_nationkey / 8.0)), 10, ' ') FROM nation")
def k04_padded_rows(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select(F.col("n_name").alias("task"), (F.col("n_nationkey") / 4.0).alias("accuracy"), (F.col("n_nationkey") / 8.0).alias("centered"))
    return writers.padded_rows(n)


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def j13_t10_latest_per_prefix(spark, sf_dir):
    o = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("m"))
    return o.select("o_custkey", "m.o_orderkey")


@query("SELECT bucket, a, b, b - a AS delta, (b - a) / a * 100.0 AS percent FROM (SELECT l_linenumber AS bucket, avg(l_extendedprice) FILTER (l_linestatus = 'F') AS a, avg(l_extendedprice) FILTER (l_linestatus = 'O') AS b FROM lineitem GROUP BY 1)")
def j12_j14_head_to_head(spark, sf_dir):
    side = lambda s, n: read(spark, sf_dir, "lineitem").where(F.col("l_linestatus") == s).groupBy(F.col("l_linenumber").alias("bucket")).agg(F.avg("l_extendedprice").alias(n))
    j = side("F", "a").join(side("O", "b"), "bucket", "full")
    return j.select("bucket", "a", "b", (F.col("b") - F.col("a")).alias("delta"), ((F.col("b") - F.col("a")) / F.col("a") * 100.0).alias("percent"))


@query("SELECT user_id, n, mean, b.all_mean, mean - b.all_mean AS gap FROM (SELECT user_id, count(*) AS n, avg(value) AS mean FROM events GROUP BY 1), (SELECT avg(value) AS all_mean FROM events) b")
def j11_baseline_summary(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    per = e.groupBy("user_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return per.crossJoin(F.broadcast(e.agg(F.avg("value").alias("all_mean")))).withColumn("gap", F.col("mean") - F.col("all_mean"))  # one row


@query("SELECT source, sum(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS lines, sum(length(text))::BIGINT AS chars, count(*) AS files, sum(length(text))::BIGINT // 4 AS tokens FROM documents GROUP BY 1")
def a30_bloat_counts(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    g = d.groupBy("source").agg(F.sum(X.count_of(F.col("text"), "\n") + 1).alias("lines"), F.sum(F.length("text")).alias("chars"), F.count("*").alias("files"))
    return g.withColumn("tokens", F.expr("chars div 4"))


@query("SELECT event_id, json_extract_string(props, '$.' || k) AS v FROM (SELECT event_id, props, json_keys(props)[1] AS k FROM events) WHERE k IS NOT NULL")
def m12_json_fields(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "props", F.json_object_keys("props")[0].alias("k")).where("k IS NOT NULL")
    return e.select("event_id", F.map_values(F.from_json("props", "map<string,string>"))[0].alias("v"))
