"""Queries over documents: scans, filters, text functions, dedupe, top-k, pre-tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from ..operators import ordered as O
from .registry import query, read

_norm = lambda c: f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"
_any = lambda c, words: "(" + " OR ".join(f"contains({c}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"
_words = lambda c: f"len(regexp_extract_all({c}, '\\S+'))"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


@query("SELECT doc_id, octet_length(encode(text)) AS n_bytes, length(text) AS n_chars FROM documents")
def s01_s04_scan_project(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.length("text").cast("long").alias("n_chars"))


@query("SELECT split, count(*) AS n, sum(length(text))::BIGINT AS chars FROM (SELECT text, CASE WHEN doc_id // 128 = max(doc_id // 128) OVER () THEN 'val' ELSE 'train' END AS split FROM documents) GROUP BY 1")
def s02_split_last_group(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("rg", F.expr("doc_id div 128"))
    return O.split_last(d, "rg").groupBy("split").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT doc_id // 128 AS rg_idx, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents WHERE (doc_id // 128) % 3 = 1 GROUP BY 1")
def s03_strided_row_groups(spark, sf_dir):
    return O.row_groups(docs(spark, sf_dir), "doc_id", 128, 1, 3).groupBy("rg_idx").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT doc_id % 4 AS rank, e::INT AS epoch, count(*) AS n, count(DISTINCT doc_id // 64) AS batches FROM documents, generate_series(1, 3) t(e) GROUP BY 1, 2")
def s05_document_epochs(spark, sf_dir):
    d = O.epochs(docs(spark, sf_dir).select("doc_id"), 3, "doc_id", world=4)
    return d.groupBy("rank", "epoch").agg(F.count("*").alias("n"), F.countDistinct(F.expr("doc_id div 64")).alias("batches"))


@query("SELECT count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE doc_id // 128 > 2 OR (doc_id // 128 = 2 AND (doc_id // 16) % 8 > 3)")
def s06_resume_after_cursor(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", F.expr("doc_id div 128").alias("pq"), F.expr("(doc_id div 16) % 8").alias("rg"))
    return O.resume_after(d, "pq", "rg", (2, 3)).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query("SELECT (doc_id - 10) // 7 AS doc_id, n_chars FROM documents WHERE doc_id >= 10 AND doc_id < 900 AND (doc_id - 10) % 7 = 0")
def f01_slice(spark, sf_dir):
    return O.slice_view(docs(spark, sf_dir).select("doc_id", "n_chars"), "doc_id", 10, 900, 7)


@query("SELECT doc_id, used, chars_before FROM (SELECT doc_id, length(text[1:10000]) AS used, coalesce(sum(length(text[1:10000])) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS chars_before FROM documents) WHERE chars_before <= 1000000")
def f02_w02_char_budget(spark, sf_dir):
    return O.char_budget(docs(spark, sf_dir).select("doc_id", "text"), most=1_000_000).select("doc_id", F.col("used").cast("long"), "chars_before")


@query("""WITH RECURSIVE p AS (SELECT doc_id, length(text) AS c, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS g FROM documents), q AS (SELECT g, sum(c)::BIGINT AS c, count(*) AS n FROM p GROUP BY 1),
    r AS (SELECT g, n, c AS held, 0::BIGINT AS shard FROM q WHERE g = 0 UNION ALL SELECT q.g, q.n, q.c + CASE WHEN r.held >= 250000 AND r.n = 16 THEN 0 ELSE r.held END, r.shard + CASE WHEN r.held >= 250000 AND r.n = 16 THEN 1 ELSE 0 END FROM r JOIN q ON q.g = r.g + 1)
    SELECT doc_id, shard FROM p JOIN r USING (g) WHERE shard < (SELECT count(*) FROM r WHERE held >= 250000 AND n = 16)""")
def k01_rolling_shards(spark, sf_dir):
    return O.shard_numbers(docs(spark, sf_dir).select("doc_id", "text"), chars=250_000, rows_per_group=16).select("doc_id", "shard")


@query(f"SELECT doc_id, md5({_norm('text')}) AS digest FROM documents")
def x01_normalize_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(X.normalize_text(F.col("text")).cast("binary")).alias("digest"))


@query(f"SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1) || '|\\n+'), lambda x: {_norm('x')}), lambda x: x <> ''), chr(1))) AS chunks FROM documents")
def x04_sentence_chunks(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(F.array_join(X.sentence_chunks(F.col("text")), "\x01").cast("binary")).alias("chunks"))


@query("SELECT category, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN {_any('t', w)} THEN '{c}'" for c, w in V.THOUGHT_CATEGORIES) + f" ELSE 'general-reasoning' END AS category FROM (SELECT lower({_norm('text')}) AS t FROM documents)) GROUP BY 1")
def x09_classify_thoughts(spark, sf_dir):
    return docs(spark, sf_dir).groupBy(X.classify_thoughts(F.col("text")).alias("category")).agg(F.count("*").alias("n"))


@query("SELECT category, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN {_any('t', w)} THEN '{c}'" for c, w in V.THOUGHT_CATEGORIES_V2) + f" ELSE 'general-reasoning' END AS category FROM (SELECT lower({_norm('text')}) AS t FROM documents)) GROUP BY 1")
def x09_classify_thoughts_v2(spark, sf_dir):
    return docs(spark, sf_dir).groupBy(X.classify_thoughts(F.col("text"), "v2").alias("category")).agg(F.count("*").alias("n"))


@query("SELECT category, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN {_any('t', w)} THEN '{c}'" for c, w in V.PROMPT_CATEGORIES) + f" ELSE 'grounded_qa' END AS category FROM (SELECT lower({_norm('text')}) AS t FROM documents)) GROUP BY 1")
def x10_classify_prompt(spark, sf_dir):
    return docs(spark, sf_dir).groupBy(X.classify_prompt(F.col("text")).alias("category")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, {_words('text')} AS words, (length(text) - length(replace(text, chr(10), ''))) AS newlines FROM documents")
def x12_x13_counts(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.word_count(F.col("text")).cast("long").alias("words"), X.count_of(F.col("text"), "\n").cast("long").alias("newlines"))


@query("SELECT doc_id, printf('doc-%s-%07d', lang, doc_id % 10000000) AS row_id FROM documents")
def x14_row_ids(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.concat(F.lit("doc-"), "lang", F.lit("-"), F.lpad((F.col("doc_id") % 10_000_000).cast("string"), 7, "0")).alias("row_id"))


@query("SELECT doc_id, (('0x' || sha1('42:' || text)[1:16])::UBIGINT % 1000)::BIGINT AS tie FROM documents")
def t05_stable_score(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.pmod(X.stable_score(42, F.col("text")), F.lit(1000).cast("decimal(20,0)")).cast("long").alias("tie"))


@query("""SELECT doc_id, lang, rank FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS rank FROM
    (SELECT doc_id, lang, (greatest(0, 900 - length(text)) * 10000 + greatest(0, 220 - len(regexp_extract_all(text, '\\S+'))) * 1000 + greatest(0, 700 - length(text)))::BIGINT * 1000 + (('0x' || sha1('42:' || text)[1:16])::UBIGINT % 1000)::BIGINT AS score FROM documents))
    JOIN (VALUES ('en', 45), ('fr', 30), ('de', 20), ('es', 10)) q(l, quota) ON lang = l WHERE rank <= quota""")
def t02_t06_quota_top_k(spark, sf_dir):
    c = F.col("text")
    d = docs(spark, sf_dir).select("doc_id", "lang", X.selection_score(42, c, c, c).alias("score"))
    quotas = spark.createDataFrame([("en", 45), ("fr", 30), ("de", 20), ("es", 10)], "lang string, quota int")
    return O.top_k(d, "lang", quotas, F.desc("score"), F.col("doc_id")).select("doc_id", "lang", F.col("rank").cast("long"))


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY ('0x' || sha1('7:' || doc_id)[1:16])::UBIGINT, doc_id) AS r FROM documents) WHERE r <= 5")
def t01_smallest_hashes(spark, sf_dir):
    d = docs(spark, sf_dir).select("source", "doc_id", X.stable_score(7, F.col("doc_id").cast("string")).alias("h"))
    return O.top_k(d, "source", 5, F.col("h"), F.col("doc_id")).select("source", "doc_id")


@query(f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY lower({_norm('text')})")
def u05_keep_first(spark, sf_dir):
    key = F.sha2(F.lower(X.normalize_text(F.col("text"))).cast("binary"), 256)
    return O.keep_first(docs(spark, sf_dir).select("doc_id", key.alias("k")), F.col("k"), "doc_id").select("doc_id")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY lower(text) ORDER BY source, doc_id) AS r FROM documents) WHERE r = 1")
def j07_u04_first_across_sources(spark, sf_dir):
    d = docs(spark, sf_dir).select("source", "doc_id", F.sha2(F.lower("text").cast("binary"), 256).alias("k"))
    return O.keep_first(d, F.col("k"), "source", "doc_id").select("doc_id", "source")


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2")
def a01_group_counts(spark, sf_dir):
    return docs(spark, sf_dir).groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("SELECT lang, count(*) AS scanned, count(*) FILTER (n_chars BETWEEN 40 AND 900) AS accepted FROM documents GROUP BY 1")
def a02_scanned_accepted(spark, sf_dir):
    return docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("scanned"), F.count_if(F.col("n_chars").between(40, 900)).alias("accepted"))


@query("SELECT lang, avg(n_chars) AS avg_chars, avg(len(regexp_extract_all(text, '\\S+'))) AS avg_words, quantile_cont(n_chars, 0.95) AS p95_chars FROM documents GROUP BY 1")
def a32_content_profile(spark, sf_dir):
    return docs(spark, sf_dir).groupBy("lang").agg(F.avg("n_chars").alias("avg_chars"), F.avg(X.word_count(F.col("text"))).alias("avg_words"), F.percentile("n_chars", 0.95).alias("p95_chars"))


@query("SELECT quality, count(*) AS n, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END)::BIGINT AS high FROM (SELECT coalesce(l.quality, 0) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY 1")
def f12_j04_quality_default(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id").join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    d = d.withColumn("quality", F.coalesce("quality", F.lit(0)))
    return d.groupBy("quality").agg(F.count("*").alias("n"), F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("high"))


@query("SELECT source, n, n / sum(n) OVER () AS share, n / sum(n) OVER () <= 0.35 AS ok FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)")
def f19_share_guard(spark, sf_dir):
    from pyspark.sql import Window as W

    g = docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1)))  # a row a source
    return g.withColumn("share", share).withColumn("ok", F.col("share") <= 0.35)


@query("SELECT doc_id, doc_id % 64 AS bucket FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j08_k06_anti_join(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", (F.col("doc_id") % 64).alias("bucket"))
    return d.join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


_draw = lambda j: f"(('0x' || sha1((1234 + idx) || ':{j}')[1:15])::BIGINT % (n - {1 + j}))"


@query(f"""WITH r AS (SELECT doc_id AS idx, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS n FROM documents),
    a AS (SELECT *, {_draw(0)} + ({_draw(0)} >= k)::INT AS a FROM r), s AS (SELECT *, least(k, a) AS lo, greatest(k, a) AS hi, {_draw(1)} + ({_draw(1)} >= least(k, a))::INT AS t FROM a), b AS (SELECT *, t + (t >= hi)::INT AS b FROM s),
    q AS (SELECT *, list_sort([k, a, b]) AS l, {_draw(2)} + ({_draw(2)} >= list_sort([k, a, b])[1])::INT AS u FROM b), v AS (SELECT *, u + (u >= l[2])::INT AS w FROM q), c AS (SELECT *, w + (w >= l[3])::INT AS c FROM v)
    SELECT c.idx, r.idx AS shot, place FROM (SELECT idx, unnest([a, b, c]) AS shot_k, unnest([1, 2, 3])::BIGINT AS place FROM c) c JOIN r ON r.k = shot_k""")
def j05_u07_few_shot(spark, sf_dir):
    return O.few_shot(docs(spark, sf_dir), "doc_id", 3).select("idx", "shot", F.col("place").cast("long"))


@query("SELECT t AS task_idx, count(*) AS n, count(DISTINCT id) AS distinct_rows FROM (SELECT 0 AS t, doc_id AS id FROM documents, generate_series(1, 1) UNION ALL SELECT 1, item_id FROM benchmark, generate_series(1, 6)) GROUP BY 1")
def u01_mixture_repeats(spark, sf_dir):
    one = lambda n, c: read(spark, sf_dir, n).select(F.col(c).alias("local_idx"), "text")
    m = O.mixture([(one("documents", "doc_id"), 1), (one("benchmark", "item_id"), 6)])
    return m.groupBy("task_idx").agg(F.count("*").alias("n"), F.countDistinct("local_idx").alias("distinct_rows"))


@query("SELECT doc_id, row_number() OVER (ORDER BY sha1('42:' || doc_id), doc_id) - 1 AS place FROM documents")
def t12_shuffled_order(spark, sf_dir):
    return O.shuffled_places(docs(spark, sf_dir).select("doc_id"), "doc_id", 42)


# DuckDB's patterns look neither ahead nor back: chr(1) is put before the last blank of white space that a word follows, and left out again.
_SPLIT = V.SPLIT_PATTERN.replace("?+", "?").replace("++", "+").replace(r"\s+(?!\S)|", "").replace(r"[^\r\n\p{L}\p{N}]", r"[^\r\n\p{L}\p{N}\x01]").replace(r"[^\s\p{L}\p{N}]", r"[^\s\p{L}\p{N}\x01]").replace("'", "''")
_PRETOKENS = f"list_filter(regexp_extract_all(regexp_replace(text, '([^\\S\\r\\n])(\\S)', chr(1) || '\\1\\2', 'g'), '{_SPLIT}|\\x01'), lambda x: x <> chr(1))"


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest({_PRETOKENS}) AS token FROM documents) GROUP BY 1")
def q01_pretoken_counts(spark, sf_dir):
    return docs(spark, sf_dir).select(F.explode(X.pretokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query(f"SELECT lang, sum(b) / sum(n) AS bytes_per_token, min(b / n) AS least, max(b / n) AS most FROM (SELECT lang, octet_length(encode(text)) AS b, nullif(len({_PRETOKENS}), 0) AS n FROM documents) GROUP BY 1")
def a11_a12_token_bytes(spark, sf_dir):
    t = docs(spark, sf_dir).select("lang", F.octet_length("text").alias("b"), F.size(X.pretokens(F.col("text"))).alias("n"))
    return t.groupBy("lang").agg((F.sum("b") / F.sum("n")).alias("bytes_per_token"), F.min(F.col("b") / F.col("n")).alias("least"), F.max(F.col("b") / F.col("n")).alias("most"))


@query("SELECT name, w AS baseline, c AS ours, (w - c) / w * 100.0 AS relative, CASE WHEN c < w THEN 'ours' WHEN c > w THEN 'baseline' ELSE 'tie' END AS better FROM (SELECT lang AS name, sum(len(regexp_extract_all(text, '\\S+')))::DOUBLE AS w, sum(length(text) - length(replace(text, ' ', '')) + 1)::DOUBLE AS c FROM documents GROUP BY 1)")
def j10_tokenizer_comparison(spark, sf_dir):
    g = docs(spark, sf_dir).groupBy(F.col("lang").alias("name")).agg(F.sum(X.word_count(F.col("text"))).cast("double").alias("baseline"), F.sum(X.count_of(F.col("text"), " ") + 1).cast("double").alias("ours"))
    better = F.when(F.col("ours") < F.col("baseline"), "ours").when(F.col("ours") > F.col("baseline"), "baseline").otherwise("tie")
    return g.withColumn("relative", (F.col("baseline") - F.col("ours")) / F.col("baseline") * 100.0).withColumn("better", better)
