"""Queries of evaluation, scaling fits, series and decisions, over the numeric tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.values import CHANCE
from ..functions import sequences as Q
from ..operators import core_eval as CE
from ..operators import decisions as D
from ..operators import ordered as O
from ..operators import statistics as S
from ..operators import sampling as P
from .registry import ORACLE, query, read

_OUT = "(SELECT event_type AS task, event_id AS idx, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value > 100 END AS ok FROM events)"


def outcomes(spark, sf_dir):
    """Events as evaluated items: right if the value is above 100, skipped at every 17th."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("task"), F.col("event_id").alias("idx"), F.when(F.col("event_id") % 17 != 0, F.col("value") > 100).alias("ok"))


_ACC = f"(SELECT task, avg(CAST(ok AS INT)) AS accuracy, count(ok) AS evaluated, count(*) FILTER (ok IS NULL) AS skipped FROM {_OUT} GROUP BY 1)"


@query(f"SELECT * FROM {_ACC}")
def a04_accuracy_skips(spark, sf_dir):
    return outcomes(spark, sf_dir).groupBy("task").agg(*S.accuracy(F.col("ok")))


@query(f"SELECT task, accuracy, (accuracy - 0.01 * b) / (1.0 - 0.01 * b) AS centered FROM {_ACC} JOIN (VALUES ('click', 25.0), ('view', 50.0), ('purchase', 0.0), ('signup', 10.0), ('logout', 20.0), ('login', 5.0), ('error', 5.0), ('search', 5.0)) v(t, b) ON t = task")
def a05_j01_centered(spark, sf_dir):
    base = spark.createDataFrame([("click", 25.0), ("view", 50.0), ("purchase", 0.0), ("signup", 10.0), ("logout", 20.0), ("login", 5.0), ("error", 5.0), ("search", 5.0)], "task string, b double")
    a = outcomes(spark, sf_dir).groupBy("task").agg(*S.accuracy(F.col("ok"))).join(F.broadcast(base), "task")
    return a.select("task", "accuracy", S.centered(F.col("accuracy"), F.col("b")).alias("centered"))


@query("WITH c AS (" + ORACLE["a05_j01_centered"] + ") SELECT avg(centered) AS core, count(*) AS tasks FROM c")
def a06_composite(spark, sf_dir):
    return a05_j01_centered(spark, sf_dir).agg(F.avg("centered").alias("core"), F.count("*").alias("tasks"))


_CHAT = ", ".join(f"('{t}', {b})" for t, b in CHANCE.items())


@query(f"SELECT CASE WHEN count(DISTINCT task) = 6 THEN avg((acc - b) / (1.0 - b)) END AS chat_core FROM (SELECT task, b, avg(CAST(value > 100 AS INT)) AS acc FROM events JOIN (SELECT row_number() OVER () - 1 AS k, task, b FROM (VALUES {_CHAT}) v(task, b)) ON k = event_id % 6 GROUP BY 1, 2)")
def a07_chat_composite(spark, sf_dir):
    tasks = F.broadcast(spark.createDataFrame([(k, t, b) for k, (t, b) in enumerate(CHANCE.items())], "k long, task string, b double"))
    e = read(spark, sf_dir, "events").withColumn("k", F.col("event_id") % 6).join(tasks, "k")
    a = e.groupBy("task", "b").agg(F.avg((F.col("value") > 100).cast("int")).alias("acc"))
    return a.agg(F.when(F.countDistinct("task") == 6, F.avg((F.col("acc") - F.col("b")) / (1.0 - F.col("b")))).alias("chat_core"))


@query("SELECT event_type, avg(CAST(hit AS INT)) AS pass_rate FROM (SELECT event_type, user_id, bool_or(value > 200) AS hit FROM events GROUP BY 1, 2) GROUP BY 1")
def a08_any_of_k(spark, sf_dir):
    e = read(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.bool_or(F.col("value") > 200).alias("hit"))
    return e.groupBy("event_type").agg(F.avg(F.col("hit").cast("int")).alias("pass_rate"))


@query("SELECT k, avg(CAST(hit AS INT)) AS pass_rate FROM (SELECT k, user_id, bool_or(value > 150) AS hit FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events), generate_series(1, 8) t(k) WHERE r <= k GROUP BY 1, 2) GROUP BY 1")
def a09_e07_pass_at_k(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy("event_id")
    e = read(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") > 150).alias("ok"), F.row_number().over(w).alias("r")).where("r <= 8")
    o = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "ok"))), lambda x: x["ok"]).alias("outcomes"))
    p = o.select(F.explode(F.sequence(F.lit(1), F.lit(8))).alias("k"), "outcomes").select("k", S.pass_at(F.col("outcomes"), F.col("k")).alias("hit"))
    return p.groupBy(F.col("k").cast("long").alias("k")).agg(F.avg(F.col("hit").cast("int")).alias("pass_rate"))


@query("""SELECT l_returnflag, sum(CASE WHEN t >= 0 AND b > 0 THEN l_discount * 100 ELSE 0 END) / (ln(2.0) * sum(CASE WHEN t >= 0 THEN b ELSE 0 END)) AS bpb FROM
    (SELECT l_returnflag, l_discount, CASE WHEN l_linenumber = 7 THEN -1 ELSE l_partkey % 300 END AS t, (l_partkey % 300) % 5 AS b FROM lineitem) GROUP BY 1""")
def a10_j02_bits_per_byte(spark, sf_dir):
    sizes = spark.range(300).select(F.col("id").alias("token_id"), (F.col("id") % 5).alias("n_bytes"))  # 300 rows
    i = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_discount", (F.col("l_partkey") % 300).alias("token_id"), "l_linenumber")
    i = i.join(F.broadcast(sizes), "token_id").withColumn("target", F.when(F.col("l_linenumber") == 7, -1).otherwise(F.col("token_id")))
    return i.groupBy("l_returnflag").agg(S.bits_per_byte(F.col("l_discount") * 100, F.col("n_bytes"), F.col("target")).alias("bpb"))


@query("SELECT event_id, value - avg(value) OVER (PARTITION BY user_id) AS advantage FROM events")
def a13_w09_advantage(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "value")
    m = e.groupBy("user_id").agg(F.avg("value").alias("m"))
    return e.join(m, "user_id").select("event_id", (F.col("value") - F.col("m")).alias("advantage"))


@query("SELECT event_type, " + ", ".join(f"arg_min({c}, event_id) FILTER ({c} IS NOT NULL) AS {n}" for c, n in (("CASE WHEN event_id % 3 = 0 THEN value END", "value"), ("CASE WHEN event_id % 7 = 6 THEN user_id END", "user_id"), ("CAST(NULL AS VARCHAR)", "nothing"))) + " FROM events GROUP BY 1")
def a14_first_non_null(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_type", "event_id", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 7 == 6, F.col("user_id")).alias("user_id"), F.lit(None).cast("string").alias("nothing"))
    return S.first_non_null(e, "event_type", "event_id")


@query("SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def a15_arg_min_row(spark, sf_dir):
    i = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.min(F.struct("l_extendedprice", "l_orderkey", "l_linenumber")).alias("m"))
    return i.select("l_suppkey", "m.l_orderkey", "m.l_linenumber")


@query("""SELECT l_returnflag, round(a, 4) AS a, round(CASE WHEN a > 0 THEN m - b / (2 * a) ELSE least_x END, 4) AS vertex, n FROM (SELECT *, (s4 * (t1 * n - s1 * t0) - t2 * (s3 * n - s1 * s2) + s2 * (s3 * t0 - t1 * s2)) / (s4 * (s2 * n - s1 * s1) - s3 * (s3 * n - s1 * s2) + s2 * (s3 * s1 - s2 * s2)) AS b FROM (SELECT l_returnflag, n, m, least_x, s1, s2, s3, s4, t0, t1, t2, (t2 * (s2 * n - s1 * s1) - s3 * (t1 * n - s1 * t0) + s2 * (t1 * s1 - s2 * t0)) / (s4 * (s2 * n - s1 * s1) - s3 * (s3 * n - s1 * s2) + s2 * (s3 * s1 - s2 * s2)) AS a FROM
    (SELECT l_returnflag, count(*) AS n, any_value(m) AS m, arg_min(x, {'y': y, 'x': x}) AS least_x, sum(u) AS s1, sum(u * u) AS s2, sum(u ** 3) AS s3, sum(u ** 4) AS s4, sum(y) AS t0, sum(y * u) AS t1, sum(y * u * u) AS t2 FROM (SELECT l_returnflag, l_extendedprice AS y, l_quantity AS x, avg(l_quantity) OVER (PARTITION BY l_returnflag) AS m, l_quantity - avg(l_quantity) OVER (PARTITION BY l_returnflag) AS u FROM lineitem) GROUP BY 1)))""")
def a16_quadratic_fit(spark, sf_dir):
    i = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    n = i.groupBy("l_returnflag").agg(F.count("*").alias("n"))
    return S.quadratic_vertex(i, "l_returnflag", "l_quantity", "l_extendedprice").join(n, "l_returnflag").select("l_returnflag", F.round("a", 4).alias("a"), F.round("vertex", 4).alias("vertex"), "n")


@query("SELECT o_orderpriority, regr_slope(ln(o_totalprice), ln(o_custkey + 1)) AS slope, regr_intercept(ln(o_totalprice), ln(o_custkey + 1)) AS intercept FROM orders WHERE o_totalprice > 0 GROUP BY 1")
def a17_m01_power_law(spark, sf_dir):
    o = read(spark, sf_dir, "orders").where("o_totalprice > 0")
    y, x = F.log("o_totalprice"), F.log(F.col("o_custkey") + 1)
    return o.groupBy("o_orderpriority").agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


@query("SELECT l_shipmode_group AS g, avg(r) AS mean, stddev_samp(r) AS std FROM (SELECT l_linenumber AS l_shipmode_group, l_extendedprice / l_quantity AS r FROM lineitem) GROUP BY 1")
def a18_mean_std(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("g"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("r")).groupBy("g").agg(F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"))


@query("SELECT l_linestatus, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept, regr_r2(l_extendedprice, l_quantity) AS r2 FROM lineitem GROUP BY 1")
def a19_linear_regression(spark, sf_dir):
    y, x = "l_extendedprice", "l_quantity"
    return read(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


_XS = ("l_quantity", "l_discount", "l_tax")
_det = lambda m: f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]}) + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))"
_GRAM = [[f"(c{min(i, j)}{max(i, j)}" + (" + alpha)" if i == j else ")") for j in range(3)] for i in range(3)]
_CRAMER = [_det([[f"c{i}3" if j == k else _GRAM[i][j] for j in range(3)] for i in range(3)]) + f" / {_det(_GRAM)}" for k in range(3)]
_SUMS = ", ".join(f"sum((x{i} - m{i}) * (x{j} - m{j})) AS c{i}{j}" for i in range(4) for j in range(i, 4))


@query(f"""WITH x AS (SELECT {", ".join(f"{c}::DOUBLE AS x{i}" for i, c in enumerate((*_XS, "l_extendedprice")))} FROM lineitem), m AS (SELECT avg(x0) AS m0, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3 FROM x),
    c AS (SELECT {_SUMS}, any_value(m0) AS m0, any_value(m1) AS m1, any_value(m2) AS m2, any_value(m3) AS m3 FROM x, m), w AS (SELECT *, {", ".join(f"{e} AS w{k}" for k, e in enumerate(_CRAMER))} FROM c, (VALUES (0.0::DOUBLE), (0.001), (0.01), (0.1), (1.0)) v(alpha))
    SELECT alpha, round(m3 - w0 * m0 - w1 * m1 - w2 * m2, 3) AS intercept, round(w0, 3) AS quantity, round(w1, 3) AS discount, round(w2, 3) AS tax,
    round(1 - (c33 - 2 * (w0 * c03 + w1 * c13 + w2 * c23) + w0 * w0 * c00 + w1 * w1 * c11 + w2 * w2 * c22 + 2 * (w0 * w1 * c01 + w0 * w2 * c02 + w1 * w2 * c12)) / c33, 6) AS r2 FROM w""")
def a20_ridge_sweep(spark, sf_dir):
    rows = S.ridge(read(spark, sf_dir, "lineitem"), list(_XS), "l_extendedprice")
    return spark.createDataFrame([(r["alpha"], round(r["intercept"], 3), *[round(w, 3) for w in r["weights"]], round(r["r2"], 6)) for r in rows], "alpha double, intercept double, quantity double, discount double, tax double, r2 double")


@query("""SELECT feature, r2, row_number() OVER (ORDER BY r2 DESC, feature) AS place FROM (SELECT 'l_quantity' AS feature, regr_r2(l_extendedprice, l_quantity) AS r2 FROM lineitem UNION ALL SELECT 'l_discount', regr_r2(l_extendedprice, l_discount) FROM lineitem UNION ALL SELECT 'l_tax', regr_r2(l_extendedprice, l_tax) FROM lineitem)""")
def a21_features_ranked(spark, sf_dir):
    i = read(spark, sf_dir, "lineitem").selectExpr("l_extendedprice AS y", "stack(3, 'l_quantity', l_quantity, 'l_discount', l_discount, 'l_tax', l_tax) AS (feature, x)")
    r = i.groupBy("feature").agg(F.regr_r2("y", "x").alias("r2"))
    return r.withColumn("place", F.row_number().over(W.orderBy(F.desc("r2"), "feature")).cast("long"))  # a row a feature


@query("SELECT event_type, median(value) FILTER (r <= 100) AS head, median(value) FILTER (q <= 100) AS tail FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS q FROM events) GROUP BY 1")
def a23_w06_head_tail_median(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_type", "event_id", "value")
    ends = [O.top_k(e, "event_type", 100, o).withColumn("end", F.lit(n)) for n, o in (("head", F.asc("event_id")), ("tail", F.desc("event_id")))]
    middle = lambda n: F.percentile(F.when(F.col("end") == n, F.col("value")), 0.5).alias(n)
    return ends[0].unionByName(ends[1]).groupBy("event_type").agg(middle("head"), middle("tail"))


_WIL = "{s}((p + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) {o} 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n))"


@query(f"SELECT event_type, greatest(0.0, {_WIL.format(s='', o='-')}) AS low, least(1.0, {_WIL.format(s='', o='+')}) AS high FROM (SELECT event_type, count(*)::DOUBLE AS n, avg(CAST(value > 100 AS INT)) AS p FROM events GROUP BY 1)")
def a24_wilson(spark, sf_dir):
    g = read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").cast("double").alias("n"), F.sum((F.col("value") > 100).cast("int")).cast("double").alias("k"))
    low, high = S.wilson(F.col("k"), F.col("n"))
    return g.select("event_type", low.alias("low"), high.alias("high"))


@query("SELECT user_id, 3 * avg(value) FILTER (event_type = 'click') + avg(value) FILTER (event_type = 'view') + 0.5 * avg(value) FILTER (event_type = 'purchase') AS score FROM events GROUP BY 1")
def a25_weighted_score(spark, sf_dir):
    mean = lambda t: F.avg(F.when(F.col("event_type") == t, F.col("value")))
    return read(spark, sf_dir, "events").groupBy("user_id").agg((3 * mean("click") + mean("view") + 0.5 * mean("purchase")).alias("score"))


@query("SELECT event_type AS metric, avg(value) FILTER (event_id % 3 = 0) AS base, avg(value) FILTER (event_id % 3 = 1) AS sft, avg(value) FILTER (event_id % 3 = 2) AS rl FROM events GROUP BY 1")
def a26_stage_pivot(spark, sf_dir):
    stage = F.element_at(F.array(F.lit("base"), F.lit("sft"), F.lit("rl")), (F.col("event_id") % 3 + 1).cast("int"))
    return read(spark, sf_dir, "events").withColumn("stage", stage).groupBy(F.col("event_type").alias("metric")).pivot("stage", ["base", "sft", "rl"]).agg(F.avg("value"))


@query("""SELECT depth, params, (6 * (params - left_out) + 12 * heads * (64 * depth // heads) * (3 * (depth // 4) * 1024 + (depth - 3 * (depth // 4)) * 2048))::BIGINT AS flops_per_token FROM
    (SELECT depth, depth // 2 AS heads, (12 * depth * (64 * depth) ** 2)::BIGINT + 2 * 65536 * 64 * depth AS params, (65536 * 64 * depth)::BIGINT + 2 * depth AS left_out FROM generate_series(4, 30) t(depth))""")
def a27_model_flops(spark, sf_dir):
    d = F.col("depth")
    table = spark.range(4, 31).select(F.col("id").alias("depth")).withColumn("params", 12 * d * (64 * d) * (64 * d) + 2 * 65536 * 64 * d)
    short = F.expr("3 * (depth div 4)")
    windows = F.transform(F.sequence(F.lit(0), d.cast("int") - 1), lambda i: F.when(i < short, 1024).otherwise(-1))
    flops = D.model_flops(F.col("params"), 65536 * 64 * d + 2 * d, F.expr("depth div 2"), 64 * d, F.lit(2048), windows)
    return table.select("depth", "params", flops.cast("long").alias("flops_per_token"))


@query("SELECT name, CAST(rate AS DOUBLE) AS peak FROM (VALUES ('NVIDIA H100 80GB HBM3', 989e12), ('NVIDIA H100 PCIe', 756e12), ('NVIDIA GB200', 2.5e15), ('NVIDIA B200', 2.25e15), ('NVIDIA L40S', 362e12), ('NVIDIA L4', 121e12), ('NVIDIA GeForce RTX 4090', 165.2e12), ('AMD Instinct MI300X', 1.3074e15), ('abacus', 'Infinity'::DOUBLE)) v(name, rate)")
def x23_peak_flops(spark, sf_dir):
    names = ["NVIDIA H100 80GB HBM3", "NVIDIA H100 PCIe", "NVIDIA GB200", "NVIDIA B200", "NVIDIA L40S", "NVIDIA L4", "NVIDIA GeForce RTX 4090", "AMD Instinct MI300X", "abacus"]
    return spark.createDataFrame([(n,) for n in names], "name string").select("name", D.peak_flops(F.col("name")).alias("peak"))


@query("WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, event_id FROM events), r AS (SELECT user_id, k, event_id, 0.1 * value AS s FROM o WHERE k = 0 UNION ALL SELECT o.user_id, o.k, o.event_id, 0.9 * r.s + 0.1 * o.value FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1) SELECT event_id, round(s / (1 - 0.9 ** (k + 1)), 8) AS ema FROM r")
def w01_debiased_ema(spark, sf_dir):
    e = S.debiased_ema(read(spark, sf_dir, "events").select("event_id", "user_id", "value"), "user_id", "event_id", "value")
    return e.select("event_id", F.round("ema", 8).alias("ema"))


@query("SELECT event_id, min(value) OVER w AS best, value < coalesce(lag(m) OVER (PARTITION BY user_id ORDER BY event_id), 1e300) AS is_new FROM (SELECT *, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS m FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def w03_running_minimum(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy("event_id")
    so_far, before = F.min("value").over(w.rowsBetween(W.unboundedPreceding, 0)), F.min("value").over(w.rowsBetween(W.unboundedPreceding, -1))
    return read(spark, sf_dir, "events").select("event_id", so_far.alias("best"), (F.col("value") < F.coalesce(before, F.lit(1e300))).alias("is_new"))


@query("SELECT event_id, sum(CASE WHEN k > 10 THEN value ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS total FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)")
def w04_training_time(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy("event_id")
    e = read(spark, sf_dir, "events").withColumn("k", F.row_number().over(w))
    return e.select("event_id", F.sum(F.when(F.col("k") > 10, F.col("value")).otherwise(0.0)).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("total"))


@query("SELECT event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS delta FROM events")
def w08_delta(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", (F.col("value") - F.lag("value").over(W.partitionBy("user_id").orderBy("event_id"))).alias("delta"))


@query("SELECT s AS step, CASE WHEN s < 100 THEN (s + 1) / 100.0 WHEN s > 500 THEN (1000 - s) / 500.0 ELSE 1.0 END AS lr FROM generate_series(0, 999) t(s)")
def w10_schedule(spark, sf_dir):
    s = F.col("step")
    lr = F.when(s < 100, (s + 1) / 100.0).when(s > 500, (1000 - s) / 500.0).otherwise(1.0)
    return spark.range(1000).select(F.col("id").alias("step")).select("step", lr.alias("lr"))


@query("SELECT c_mktsegment, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer WHERE c_acctbal <> -1) WHERE r = 1")
def t08_t09_best_row(spark, sf_dir):
    c = read(spark, sf_dir, "customer").where("c_acctbal <> -1").groupBy("c_mktsegment").agg(F.max(F.struct("c_acctbal", -F.col("c_custkey"))).alias("m"))
    return c.select("c_mktsegment", (-F.col("m.col2")).alias("c_custkey"), "m.c_acctbal")


@query("SELECT l_orderkey, l_linenumber AS choice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def t13_least_loss_option(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_linenumber", F.struct("l_discount", "l_linenumber")).alias("choice"))


@query("SELECT vec_id, list_position(embedding[1:4], list_max(embedding[1:4])) - 1 AS choice FROM embeddings")
def t14_restricted_argmax(spark, sf_dir):
    four = F.slice("embedding", 1, 4)
    return read(spark, sf_dir, "embeddings").select("vec_id", (F.array_position(four, F.array_max(four)) - 1).cast("int").alias("choice"))


@query("SELECT vec_id, list_sum(list_transform(list_slice(list_reverse_sort(embedding), 1, 10), lambda x: x::DOUBLE)) AS top10 FROM embeddings")
def t15_top_k_logits(spark, sf_dir):
    top = F.slice(F.sort_array("embedding", False), 1, 10)
    return read(spark, sf_dir, "embeddings").select("vec_id", F.aggregate(top, F.lit(0.0), lambda a, x: a + x.cast("double")).alias("top10"))


#: Tasks of the flow's query: kind, shots, delimiter, baseline in percent.
_TASKS = [("choice", CE.CHOICE, 2, " ", 33.0), ("schema", CE.SCHEMA, 1, ": ", 50.0), ("continuation", CE.CONTINUATION, 1, " ", 0.0)]
_MOST = 230

_shot = lambda j: f"(('0x' || sha1((1234 + idx) || ':{j}')[1:15])::BIGINT % (n - {1 + j}))"


def _core_items(spark, sf_dir):
    """An item of one of the three kinds from each document's first characters."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.substring("text", 1, 120), "[^!-~]", "").alias("t"))
    at = lambda head, first, n, tail="": F.concat(F.lit(head), F.substring("t", first, n), F.lit(tail))
    parts = [
        at("q", 1, 30).alias("query"), F.array(at("A", 31, 8), at("B", 39, 12), at("C", 51, 5)).alias("choices"), F.when(F.col("doc_id") % 3 == 0, F.floor(F.col("doc_id") / 3) % 3).otherwise(F.floor(F.col("doc_id") / 3) % 2).cast("int").alias("gold"),
        F.array(at("x", 1, 20, "1"), at("y", 21, 25, "2")).alias("context_options"), at("Z", 46, 14).alias("continuation"), at(" c", 1, 25, " ").alias("context"),
    ]
    task = F.array(*[F.lit(t[0]) for t in _TASKS])[(F.col("doc_id") % 3).cast("int")]
    return d.select(task.alias("task"), F.col("doc_id").alias("idx"), *parts)


def _core_model(rows):
    """Losses and predictions by a rule in place of a model: whole numbers, and right predictions for two of three items."""
    losses = F.transform("ids", lambda x, i: ((x * 31 + (i + 1) * 17) % 101).cast("double"))
    right = F.concat(F.slice("ids", 2, F.size("ids")), F.array(F.lit(0)))
    return rows.select("task", "idx", "option", losses.alias("losses"), F.when(F.floor(F.col("idx") / 3) % 3 < 2, right).otherwise(F.transform("ids", lambda x: F.lit(0))).alias("predictions"))


_SPAN_LOSS = "list_sum(list_transform(range(first - 1, 1 + length(prompt) - 1), lambda p: (CASE WHEN p = 0 THEN 256 ELSE ascii(prompt[p]) END * 31 + (p + 1) * 17) % 101))::DOUBLE / (1 + length(prompt) - first)"


@query(f"""WITH t AS (SELECT doc_id AS idx, doc_id % 3 AS kind, doc_id // 3 AS h, regexp_replace(text[1:120], '[^!-~]', '', 'g') AS t FROM documents),
    i AS (SELECT idx, kind, h, row_number() OVER (PARTITION BY kind ORDER BY idx) - 1 AS k, count(*) OVER (PARTITION BY kind) AS n, CASE WHEN kind = 0 THEN h % 3 ELSE h % 2 END AS gold, 'q' || t[1:30] AS query,
        ['A' || t[31:38], 'B' || t[39:50], 'C' || t[51:55]] AS choices, ['x' || t[1:20] || '1', 'y' || t[21:45] || '2'] AS contexts, 'Z' || t[46:59] AS cont, 'c' || t[1:25] AS context FROM t),
    a AS (SELECT *, {_shot(0)} + ({_shot(0)} >= k)::INT AS a FROM i), b0 AS (SELECT *, {_shot(1)} + ({_shot(1)} >= least(k, a))::INT AS u FROM a), b AS (SELECT *, u + (u >= greatest(k, a))::INT AS b FROM b0),
    s AS (SELECT b.*, CASE b.kind WHEN 0 THEN x.query || ' ' || x.choices[x.gold + 1] || chr(10) || chr(10) || y.query || ' ' || y.choices[y.gold + 1] || chr(10) || chr(10)
        WHEN 1 THEN x.contexts[x.gold + 1] || ': ' || x.cont || chr(10) || chr(10) ELSE x.context || ' ' || x.cont || chr(10) || chr(10) END AS head
      FROM b JOIN i x ON x.kind = b.kind AND x.k = b.a JOIN i y ON y.kind = b.kind AND y.k = b.b),
    o AS (SELECT idx, kind, h, gold, o, CASE kind WHEN 0 THEN head || query || ' ' || choices[o] WHEN 1 THEN head || contexts[o] || ': ' || cont ELSE head || context || ' ' || cont END AS prompt,
        CASE kind WHEN 0 THEN 1 + length(head || query || ' ') WHEN 1 THEN 1 + length(head || contexts[o]) ELSE 1 + length(head || context) END AS first
      FROM s, (SELECT unnest([1, 2, 3]) AS o) WHERE o <= CASE kind WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END),
    z AS (SELECT idx, kind, max(1 + length(prompt)) > {_MOST} AS over, CASE WHEN kind = 2 THEN any_value(h) % 3 < 2 ELSE arg_min(o, ({_SPAN_LOSS}, o)) - 1 = any_value(gold) END AS ok FROM o GROUP BY 1, 2),
    per AS (SELECT (['choice', 'schema', 'continuation'])[kind + 1] AS task, avg(ok::INT) FILTER (NOT over) AS accuracy, count(*) FILTER (NOT over) AS evaluated, count(*) FILTER (over) AS skipped, ([0.33, 0.5, 0.0])[kind + 1]::DOUBLE AS b FROM z GROUP BY kind),
    c AS (SELECT task, accuracy, (accuracy - b) / (1.0 - b) AS centered, evaluated, skipped FROM per)
    SELECT task, round(accuracy, 9) AS accuracy, round(centered, 9) AS centered, evaluated::BIGINT AS evaluated, skipped::BIGINT AS skipped FROM (SELECT * FROM c UNION ALL SELECT 'CORE', NULL, avg(centered), sum(evaluated), sum(skipped) FROM c)""")
def e01_e05_core_flow(spark, sf_dir):
    """Items, shots inside their tasks, prompts, spans, losses, outcomes with skips, accuracies, centred scores and their mean."""
    tasks = spark.createDataFrame(_TASKS, "task string, kind string, shots int, delimiter string, baseline double")
    out = CE.evaluate(_core_items(spark, sf_dir), tasks, _core_model, _MOST, "skip")
    return out.select("task", F.round("accuracy", 9).alias("accuracy"), F.round("centered", 9).alias("centered"), "evaluated", "skipped")


# The draw of each of a vector's ten greatest entries, by the checksum of seed, id, sample, step and place.
_GUMBEL = "x::DOUBLE / 0.8 - ln(-ln((('0x' || left(sha1('42:' || vec_id || ':' || sample || ':0:' || place), 13))::BIGINT + 0.5) / 4503599627370496.0))"


@query(f"""SELECT vec_id, sample, CASE WHEN sample < 2 THEN arg_max(place, (score, -place)) ELSE arg_max(place, (x, -place)) END::INT AS token FROM
    (SELECT *, {_GUMBEL} AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, place) AS r FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS place FROM embeddings WHERE embedding IS NOT NULL)
      WHERE x IS NOT NULL AND NOT isnan(x)), (SELECT unnest(range(3))::INT AS sample) WHERE r <= 10) GROUP BY 1, 2""")
def t15_sampled_tokens(spark, sf_dir):
    """Two draws at temperature 0.8 among the ten greatest entries of each vector, and as sample 2 the greedy choice."""
    e = read(spark, sf_dir, "embeddings").where("size(filter(embedding, x -> x IS NOT NULL AND NOT isnan(x))) > 0")
    drawn = P.samples(e, "vec_id", "embedding", n=2, temperature=0.8, top_k=10)
    return drawn.unionByName(P.samples(e, "vec_id", "embedding", temperature=0.0).withColumn("sample", F.lit(2)))


@query("SELECT o_orderkey, CASE WHEN o_totalprice <= 1000 THEN 1.0 WHEN o_totalprice >= 300000 THEN 9.0 WHEN o_totalprice < 50000 THEN 1.0 + 3.0 * (o_totalprice - 1000) / 49000 ELSE 4.0 + 5.0 * (o_totalprice - 50000) / 250000 END AS value FROM orders")
def j06_interpolation(spark, sf_dir):
    curve = spark.createDataFrame([(1000.0, 1.0), (50000.0, 4.0), (300000.0, 9.0)], "x double, y double")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return S.interpolate(curve, o, "x", "y", "o_totalprice").select("o_orderkey", "value")


@query("""SELECT user_id, good, n_full AS full, CASE WHEN good >= 2 THEN 'promote' WHEN n_full > 0 THEN 'hold' ELSE 'failed' END AS decision FROM
    (SELECT user_id, count(*) FILTER (event_type = 'purchase' AND value / 50 >= 4 AND value / 10 >= 27) AS good, count(*) FILTER (event_type = 'purchase') AS n_full FROM events GROUP BY 1)""")
def g01_promotion(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    runs = e.select("user_id", F.when(F.col("event_type") == "purchase", "full_confirm").otherwise("quick").alias("status"), (F.col("value") / 50).alias("gsm8k_pass8"), (F.col("value") / 10).alias("mmlu"))
    return D.promotion(runs, "user_id")


@query("""SELECT event_type, list_filter([CASE WHEN n < 2000 THEN 'rows' END, CASE WHEN avg_v >= 250 THEN 'mean' END, CASE WHEN hi >= 490.005 THEN 'peak' END, CASE WHEN lo < 0.02 THEN 'floor' END, CASE WHEN bad > 0 THEN 'missing' END], lambda x: x IS NOT NULL) AS failed FROM
    (SELECT event_type, count(*) AS n, avg(value) AS avg_v, max(value) AS hi, min(value) AS lo, count(*) FILTER (value IS NULL) AS bad FROM events GROUP BY 1)""".replace("SELECT event_type, list_filter", "SELECT event_type, CASE WHEN len(failed) = 0 THEN 'GO' ELSE 'NO_GO' END AS decision, array_to_string(failed, ',') AS failed FROM (SELECT event_type, list_filter", 1) + ")")
def g05_stability_gate(spark, sf_dir):
    g = read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("hi"), F.min("value").alias("lo"), F.count_if(F.col("value").isNull()).alias("bad"))
    decision, failed = D.stability({"rows": F.col("n") >= 2000, "mean": F.col("mean") < 250, "peak": F.col("hi") < 490.005, "floor": F.col("lo") >= 0.02, "missing": F.col("bad") == 0})
    return g.select("event_type", decision.alias("decision"), F.array_join(failed, ",").alias("failed"))


@query("SELECT c_nationkey, best, b AS control, best >= coalesce(b, 22.5) + 100 AS go FROM (SELECT c_nationkey, max(c_acctbal) AS best, max(c_acctbal) FILTER (c_mktsegment = 'BUILDING') AS b FROM customer GROUP BY 1)")
def g13_sweep_gate(spark, sf_dir):
    g = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.max("c_acctbal").alias("best"), F.max(F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal"))).alias("control"))
    return g.select("c_nationkey", "best", "control", D.sweep_gate(F.col("best"), F.col("control"), 100).alias("go"))


@query("SELECT vec_id, list_position(m, list_min(m)) - 1 AS choice FROM (SELECT vec_id, list_transform([1, 17, 33, 49], lambda i: list_sum(list_transform(embedding[i:i + 7], lambda x: x::DOUBLE)) / 8) AS m FROM embeddings)")
def e01_m11_option_losses(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("losses"))
    means = F.array(*[Q.span_mean(F.col("losses"), F.lit(a), F.lit(a + 8)) for a in (1, 17, 33, 49)])
    return e.select("vec_id", Q.least_option(means).cast("int").alias("choice"))


@query("SELECT doc_id, CASE WHEN n > 300 THEN NULL ELSE n END AS kept FROM (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS n FROM documents)")
def e02_overflow_skip(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("ids"))
    fit = Q.fit(F.col("ids"), F.lit(1), F.size("ids"), 300, "skip")
    return d.select("doc_id", F.when(fit.isNotNull(), F.size(fit["ids"])).cast("long").alias("kept"))


@query("SELECT doc_id, CASE WHEN n > 300 AND n - 100 - (n - 300) < 0 THEN NULL ELSE n - 100 - greatest(0, n - 300) END AS start FROM (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS n FROM documents) WHERE n > 100")
def m08_truncate_left(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("ids")).where("size(ids) > 100")
    return d.select("doc_id", Q.fit(F.col("ids"), F.size("ids") - 100, F.size("ids"), 300, "truncate")["start"].cast("long").alias("start"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice >= 150000 + 5000 THEN 'promote' WHEN o_totalprice <= 150000 - 100000 THEN 'hard_fail' ELSE 'hold' END AS decision FROM orders")
def g06_against_reference(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", D.against_reference(F.col("o_totalprice"), F.lit(150000), 5000, 100000).alias("decision"))


@query("SELECT p_partkey, CASE WHEN contains(p_type, 'BRASS') THEN 3.0 ELSE 2.0 END * p_size AS cost FROM part".replace("contains(p_type, 'BRASS')", "contains(p_name, 'H100')"))
def a31_cost(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", D.hourly_cost(F.col("p_name"), F.col("p_size")).alias("cost"))


@query("SELECT s AS ratio, CAST(floor(floor(s * 419958144.0) / 524288) AS BIGINT) AS step FROM generate_series(1, 60) t(s)")
def m03_m14_target_step(spark, sf_dir):
    return spark.range(1, 61).select(F.col("id").alias("ratio"), D.target_step(F.col("id"), 419958144, 524288).alias("step"))


@query("SELECT event_type, arg_min(user_id, o) FILTER (ok) AS chosen FROM (SELECT event_type, user_id, min(event_id) AS o, max(value) > 400 AS ok FROM events GROUP BY 1, 2) GROUP BY 1")
def g08_first_passing(spark, sf_dir):
    g = read(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.min("event_id").alias("o"), (F.max("value") > 400).alias("ok"))
    return D.first_passing(g, "event_type", "o", F.col("ok"), "user_id")
