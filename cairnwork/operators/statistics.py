"""Aggregates of evaluation and scaling studies, as expressions and small grouped fits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def centered(accuracy: Column, baseline_percent: Column) -> Column:
    return (accuracy - 0.01 * baseline_percent) / (1.0 - 0.01 * baseline_percent)


def accuracy(outcome: Column) -> list[Column]:
    """accuracy over rows with an outcome, evaluated and skipped (null) rows; null accuracy if none was evaluated."""
    return [F.avg(outcome.cast("double")).alias("accuracy"), F.count(outcome).alias("evaluated"), F.count_if(outcome.isNull()).alias("skipped")]


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson interval of k of n."""
    p, d = k / n, 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)


def bits_per_byte(loss: Column, n_bytes: Column, target: Column) -> Column:
    """Sum of losses at targets with bytes, over ln 2 times the bytes; ignored targets are negative; infinite without bytes."""
    counted = F.when(target >= 0, n_bytes).otherwise(0)
    total = F.sum(counted)
    return F.when(total > 0, F.sum(F.when(counted > 0, loss).otherwise(0.0)) / (F.log(F.lit(2.0)) * total)).otherwise(F.lit(float("inf")))


def pass_at(outcomes: Column, k: Column) -> Column:
    """Whether any of the first k outcomes is right."""
    return F.exists(F.slice(outcomes, 1, k), lambda b: b)


def first_non_null(df: DataFrame, group: str, order: str) -> DataFrame:
    """For each group the first value that isn't null of every other column, in the order of one of them; null if all are."""
    rest = [c for c in df.columns if c not in (group, order)]
    return df.groupBy(group).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in rest])


def quadratic_vertex(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """(group, a, b, c, vertex) of the least-squares parabola of each group, by centred power sums and Cramer's rule.

    vertex: -b / 2a if a > 0, else the x of the least y. Sums are partial aggregates; nothing is gathered.
    """
    m = df.groupBy(group).agg(F.avg(x).alias("m_"), F.min_by(x, F.struct(y, x)).alias("raw_"))
    d = df.join(m, group).withColumn("u_", F.col(x) - F.col("m_"))
    s = d.groupBy(group).agg(F.first("m_").alias("m_"), F.first("raw_").alias("raw_"), F.count("*").cast("double").alias("n"), *[F.sum(F.pow("u_", F.lit(float(k)))).alias(f"s{k}") for k in (1, 2, 3, 4)], *[F.sum(F.col(y) * F.pow("u_", F.lit(float(k)))).alias(f"t{k}") for k in (0, 1, 2)])
    det = lambda r: " + ".join(f"({a}) * (({b}) * ({c}) - ({d}) * ({e}))" for a, b, c, d, e in r)
    three = lambda m: det([(m[0][0], m[1][1], m[2][2], m[1][2], m[2][1]), (f"-({m[0][1]})", m[1][0], m[2][2], m[1][2], m[2][0]), (m[0][2], m[1][0], m[2][1], m[1][1], m[2][0])])
    a0 = [["s4", "s3", "s2"], ["s3", "s2", "s1"], ["s2", "s1", "n"]]
    rhs = ["t2", "t1", "t0"]
    sub = lambda j: [[rhs[i] if k == j else a0[i][k] for k in range(3)] for i in range(3)]
    s = s.withColumn("det_", F.expr(three(a0)))
    for j, name in enumerate(("a_", "b_", "c_")):
        s = s.withColumn(name, F.expr(f"({three(sub(j))}) / nullif(det_, 0)"))
    fit = s.select(group, F.col("a_").alias("a"), (F.col("b_") - 2 * F.col("a_") * F.col("m_")).alias("b"), (F.col("c_") - F.col("b_") * F.col("m_") + F.col("a_") * F.col("m_") * F.col("m_")).alias("c"), "raw_")
    return fit.withColumn("vertex", F.when(F.col("a") > 0, -F.col("b") / (2 * F.col("a"))).otherwise(F.col("raw_"))).drop("raw_")


def r_squared(y: Column, fitted: Column) -> Column:
    """1 - residual over total sum of squares, from sums."""
    n = F.count(y)
    return 1 - F.sum((y - fitted) * (y - fitted)) / (F.sum(y * y) - F.sum(y) * F.sum(y) / n)


def ridge(df: DataFrame, features: list[str], y: str, alphas: tuple[float, ...] = (0.0, 0.001, 0.01, 0.1, 1.0)) -> list[dict]:
    """Coefficients and R-squared for each alpha, the intercept without a penalty.

    Spark sums the products (a fixed number of sums, whatever the rows); the driver solves the small system.
    """
    cols = [*features, y]
    sums = [F.count("*").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(cols)]]
    sums += [F.sum(F.col(a) * F.col(b)).alias(f"p{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]
    r = df.na.drop(subset=cols).agg(*sums).first()
    n, k = r["n"], len(features)
    if not n:
        return []
    mean = np.array([r[f"s{i}"] for i in range(k + 1)]) / n
    prod = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)]) - n * np.outer(mean, mean)
    out = []
    for alpha in alphas:
        w = np.linalg.lstsq(prod[:k, :k] + alpha * np.eye(k), prod[:k, k], rcond=None)[0]
        rss = prod[k, k] - 2 * w @ prod[:k, k] + w @ prod[:k, :k] @ w
        out.append({"alpha": alpha, "intercept": float(mean[k] - w @ mean[:k]), "weights": w.tolist(), "r2": float(1 - rss / prod[k, k]) if prod[k, k] else 0.0})
    return out


def interpolate(points: DataFrame, queries: DataFrame, x: str, y: str, at: str) -> DataFrame:
    """queries with `value`: y of the points at `at`, linear between neighbours, held at the ends.

    The points are one short sorted array (a curve), sent along with the queries.
    """
    curve = points.agg(F.sort_array(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))).alias("curve_"))
    q = queries.crossJoin(F.broadcast(curve))
    low = F.array_max(F.filter("curve_", lambda p: p["x"] <= F.col(at)))
    high = F.array_min(F.filter("curve_", lambda p: p["x"] >= F.col(at)))
    q = q.withColumn("l_", low).withColumn("h_", high)
    between = F.col("l_.y") + (F.col("h_.y") - F.col("l_.y")) * (F.col(at) - F.col("l_.x")) / (F.col("h_.x") - F.col("l_.x"))
    value = F.when(F.col("l_").isNull(), F.col("h_.y")).when(F.col("h_").isNull() | (F.col("l_.x") == F.col("h_.x")), F.col("l_.y")).otherwise(between)
    return q.withColumn("value", value).drop("curve_", "l_", "h_")


def debiased_ema(df: DataFrame, group: str, order: str, value: str, beta: float = 0.9, shift: int = 1, name: str = "ema", head: int = 1024) -> DataFrame:
    """Exponential mean of value in order, divided by 1 - beta ** (step + shift), steps from 0.

    s_n = (1 - beta) sum beta ** (n - i) x_i is a window sum over a bounded frame: terms older than `head` rows weigh
    less than beta ** head, below double precision, so no array of the whole series is built.
    """
    w = W.partitionBy(group).orderBy(order)
    recent = F.collect_list(value).over(w.rowsBetween(-min(head, int(np.ceil(40 / -np.log(beta)))), 0))
    s = F.aggregate(recent, F.lit(0.0), lambda a, x: beta * a + (1 - beta) * x)
    step = F.row_number().over(w) - 1
    return df.withColumn(name, s / (1 - F.pow(F.lit(beta), step + shift)))
