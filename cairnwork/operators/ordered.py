"""Operators over an explicit order: slices, strides, splits, running sums, keep-first, top-k, shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranks import cut, global_rank


def slice_view(df: DataFrame, idx: str, start: int = 0, stop: int | None = None, step: int = 1) -> DataFrame:
    """Rows start, start + step, ... below stop, numbered anew from 0. A stop beyond the table isn't clamped."""
    out = df.where((F.col(idx) >= start) & ((F.col(idx) - start) % step == 0))
    if stop is not None:
        out = out.where(F.col(idx) < stop)
    return out.withColumn(idx, F.expr(f"({idx} - {start}) div {step}"))


def row_groups(df: DataFrame, idx: str, rows_per_group: int, start: int = 0, step: int = 1) -> DataFrame:
    """Rows of every step-th logical row group from start, with the group's number rg_idx."""
    return df.withColumn("rg_idx", F.expr(f"{idx} div {rows_per_group}")).where((F.col("rg_idx") >= start) & ((F.col("rg_idx") - start) % step == 0))


def split_last(df: DataFrame, group: str) -> DataFrame:
    """split: `val` for the last group, `train` for the rest. One group alone is all val."""
    last = df.agg(F.max(group).alias("last_"))
    return df.crossJoin(F.broadcast(last)).withColumn("split", F.when(F.col(group) == F.col("last_"), "val").otherwise("train")).drop("last_")


def resume_after(df: DataFrame, file: str, group: str, cursor: tuple[int, int]) -> DataFrame:
    """Rows after a cursor (file, group)."""
    return df.where(F.struct(F.col(file).cast("long"), F.col(group).cast("long")) > F.struct(F.lit(cursor[0]).cast("long"), F.lit(cursor[1]).cast("long")))


def epochs(df: DataFrame, n: int, idx: str | None = None, rank: int | None = None, world: int = 1) -> DataFrame:
    """The table n times over, with the epoch from 1. With idx, rank is idx % world, of one rank if it is given, else of all."""
    if idx is not None:
        df = df.withColumn("rank", F.col(idx) % world)
        df = df if rank is None else df.where(F.col("rank") == rank)
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(n))))


def sum_before(df: DataFrame, idx: str, value: Column, name: str, width: int = 4096) -> DataFrame:
    """name: the sum of value over all rows with a smaller idx, a whole number without a null.

    Two levels: sums of stretches of idx, their running sum over one row a stretch, and a window inside each
    stretch; so no window holds the whole table.
    """
    d = df.withColumn("v_", value).withColumn("piece_", F.expr(f"{idx} div {width}"))
    pieces = d.groupBy("piece_").agg(F.sum("v_").alias("s_"))
    coarse = pieces.withColumn("far_", F.expr(f"piece_ div {width}"))
    far = coarse.groupBy("far_").agg(F.sum("s_").alias("f_"))
    far = far.select(F.col("far_").alias("far_k"), F.coalesce(F.sum("f_").over(W.orderBy("far_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("far_before"))
    near = coarse.join(F.broadcast(far), F.col("far_") == F.col("far_k"))  # a row for each width * width ids
    before = F.coalesce(F.sum("s_").over(W.partitionBy("far_").orderBy("piece_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    near = near.select(F.col("piece_").alias("p_"), (F.col("far_before") + before).alias("before_"))
    inside = F.coalesce(F.sum("v_").over(W.partitionBy("piece_").orderBy(idx).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return d.withColumn("in_", inside).join(near, F.col("piece_") == F.col("p_")).withColumn(name, F.col("in_") + F.col("before_")).drop("v_", "piece_", "p_", "before_", "in_")


def char_budget(docs: DataFrame, idx: str = "doc_id", text: str = "text", cap: int = 10_000, most: int = 2_000_000_000) -> DataFrame:
    """Texts cropped to cap characters, up to and with the one whose running total exceeds most."""
    d = docs.withColumn(text, F.substring(text, 1, cap)).withColumn("used", F.length(text))
    return sum_before(d, idx, F.length(text), "chars_before").where(F.col("chars_before") <= most)


def at_or_after(rows: DataFrame, at: str, marks: DataFrame, mark: str) -> DataFrame:
    """rows with `next_`: the least mark that isn't below their own `at`, null if all are; marks without a null, `next_` of any type in order with them.

    marks: (mark, next_). Rows and marks are dealt together by ranges of their values and read from above within
    a range; what a range's end doesn't know comes from the ranges behind it, one row for each. Nothing is joined by inequality.
    """
    cols = rows.columns
    one = rows.select(F.struct(*cols).alias("row_"), F.col(at).alias("v_"), F.lit(0).alias("is_mark_"), F.lit(None).cast(marks.schema["next_"].dataType).alias("next_"))
    both = one.unionByName(marks.select(F.lit(None).cast(one.schema["row_"].dataType).alias("row_"), F.col(mark).alias("v_"), F.lit(1).alias("is_mark_"), "next_"))
    order = ["v_", "is_mark_", F.xxhash64("row_")]
    ids = cut(both.repartitionByRange(*order).sortWithinPartitions("v_", "is_mark_").withColumn("id_", F.monotonically_increasing_id())).withColumn("part_", F.shiftright("id_", 33))
    firsts = ids.groupBy(F.col("part_").alias("p_")).agg(F.min("next_").alias("first_"))  # a row for each range
    firsts = firsts.select("p_", F.min("first_").over(W.orderBy(F.desc("p_")).rowsBetween(W.unboundedPreceding, -1)).alias("later_"))
    down = W.partitionBy("part_").orderBy(F.desc("id_")).rowsBetween(W.unboundedPreceding, 0)
    found = ids.withColumn("own_", F.min("next_").over(down)).where("is_mark_ = 0").join(F.broadcast(firsts), F.col("part_") == F.col("p_"))
    return found.select("row_.*", F.coalesce("own_", "later_").alias("next_"))


def chain(pointers: DataFrame, start: int) -> DataFrame:
    """(node, steps) of the nodes on the way from start along pointers (node, next_), which rise; the way ends at a null.

    Pointers are doubled until the start's leads beyond the end: as many rounds as the number of steps has bits, each a
    join of whole tables that is cut to the shared folder. Then the way is read off from the longest jumps to the shortest.
    """
    jumps = [cut(pointers.where("next_ IS NOT NULL").select("node", "next_"))]
    while not jumps[-1].where(F.col("node") == start).isEmpty():
        p = jumps[-1]
        jumps.append(cut(p.join(p.select(F.col("node").alias("next_"), F.col("next_").alias("far_")), "next_").select("node", F.col("far_").alias("next_"))))
    spark = pointers.sparkSession
    way = spark.createDataFrame([(start, 0)], "node long, steps long")
    for k in reversed(range(len(jumps))):
        way = cut(way.unionByName(way.join(jumps[k], "node").select(F.col("next_").alias("node"), (F.col("steps") + (1 << k)).alias("steps"))))
    return way


def shard_numbers(docs: DataFrame, idx: str = "doc_id", text: str = "text", chars: int = 250_000_000, rows_per_group: int = 1024, keep_tail: bool = False) -> DataFrame:
    """shard: which output shard a document goes to, in the order of idx.

    A shard ends after the first whole row group with which it has `chars` characters; documents after the last end are
    left out, or go to a last shard with keep_tail. Each group points to the end of a shard that would begin behind it,
    found by running sums of characters; the shards are the way along these pointers from before the first group. No task walks
    through all groups.
    """
    if chars < 1:
        raise ValueError("a shard has one character at least")
    ranked = global_rank(docs.select(F.col(idx).alias("idx_"), F.length(text).cast("long").alias("used_")), ["idx_"]).withColumn("g_", F.expr(f"rank_ div {rows_per_group}"))
    groups = cut(ranked.groupBy("g_").agg(F.coalesce(F.sum("used_"), F.lit(0)).alias("c_"), F.count("*").alias("n_")))
    sums = cut(sum_before(groups, "g_", F.col("c_"), "chars_before").select("g_", "n_", (F.col("chars_before") + F.col("c_")).alias("sum_")))
    behind = sums.select(F.col("g_").alias("node"), (F.col("sum_") + chars).alias("goal_"))
    behind = behind.unionByName(docs.sparkSession.createDataFrame([(-1, chars)], "node long, goal_ long"))
    whole = sums.where(F.col("n_") == rows_per_group).select("sum_", F.col("g_").alias("next_"))
    ends = chain(at_or_after(behind, "goal_", whole, "sum_").select("node", "next_"), -1).where("steps > 0")
    of = at_or_after(sums.select("g_"), "g_", ends.select("node", (F.col("steps") - 1).alias("next_")), "node")
    if keep_tail:
        last = ends.agg(F.coalesce(F.max("steps"), F.lit(0)).alias("last_"))
        of = of.crossJoin(F.broadcast(last)).select("g_", F.coalesce("next_", "last_").alias("next_"))  # one row
    of = of.where("next_ IS NOT NULL").select(F.col("g_").alias("s_"), F.col("next_").alias("shard"))
    of = ranked.join(of, F.col("g_") == F.col("s_")).select("idx_", "shard")
    return docs.join(of, F.col(idx) == F.col("idx_")).drop("idx_")


def keep_first(df: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row of each key in the given order: an aggregate with partial results, so a hot key is no window."""
    d = df.withColumn("key_", key)
    cols = [c for c in df.columns if c not in order]
    best = d.groupBy("key_").agg(F.min(F.struct(*order, *cols)).alias("best_"))
    return best.select("best_.*").select(*df.columns)


def top_k(df: DataFrame, group: str, quotas: DataFrame | int, *order: Column) -> DataFrame:
    """The first quota rows of each group; quotas is one number or a table (group, quota) of few rows.

    The largest quota is a literal, so each task keeps no more rows of a group than that before the shuffle.
    """
    most = quotas if isinstance(quotas, int) else quotas.agg(F.max("quota")).first()[0] or 0
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("rank") <= most)
    if isinstance(quotas, int):
        return ranked
    return ranked.join(F.broadcast(quotas), group).where(F.col("rank") <= F.col("quota"))


def hashed_order(df: DataFrame, idx: str, seed: int) -> DataFrame:
    """shuffle_key: a fixed pseudo-random order of rows."""
    return df.withColumn("shuffle_key", F.sha1(F.concat(F.lit(f"{seed}:"), F.col(idx).cast("string")).cast("binary")))


def shuffled_places(df: DataFrame, idx: str, seed: int) -> DataFrame:
    """place: each row's position from 0 in the hashed order of all rows, from one range shuffle."""
    ranked = global_rank(hashed_order(df, idx, seed), ["shuffle_key", idx])
    return ranked.withColumnRenamed("rank_", "place").drop("shuffle_key")


def mixture(tasks: list[tuple[DataFrame, int]], seed: int = 42) -> DataFrame:
    """Rows (task_idx, local_idx, copy, ...) of all tasks, each repeated so many times, with a shuffle key."""
    out = None
    for t, (df, repeat) in enumerate(tasks):
        one = df.withColumn("task_idx", F.lit(t)).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(repeat))))
        out = one if out is None else out.unionByName(one)
    payload = F.concat_ws(":", F.lit(str(seed)), "task_idx", "local_idx", "copy")
    return out.withColumn("shuffle_key", F.sha1(payload.cast("binary")))


def sequence(tables: list[tuple[DataFrame, str]]) -> DataFrame:
    """Rows (task, idx) of whole tables one after the other: a table's ids start after the greatest one of those before."""
    out = None
    for t, (df, idx) in enumerate(tables):
        one = df.select(F.lit(t).alias("task"), F.col(idx).cast("long").alias("idx"))
        if out is not None:
            start = out.agg(F.coalesce(F.max("idx") + 1, F.lit(0)).alias("start_"))
            one = one.crossJoin(F.broadcast(start)).select("task", (F.col("idx") + F.col("start_")).alias("idx"))  # one row
        out = one if out is None else out.union(one)
    return out


def _draws(k: Column, seed: int) -> Column:
    """An array of rank_ and k other numbers below n_, or all n_ - 1 if there are fewer; seeded by idx."""

    def draw(used: Column, j: Column) -> Column:
        h = F.sha1(F.concat_ws(":", (F.lit(seed) + F.col("idx")).cast("string"), j.cast("string")).cast("binary"))
        x = F.pmod(F.conv(F.substring(h, 1, 15), 16, 10).cast("long"), F.col("n_") - 1 - j)
        return F.concat(used, F.array(F.aggregate(F.array_sort(used), x, lambda at, u: F.when(at >= u, at + 1).otherwise(at))))

    last = F.least(k.cast("long"), F.col("n_") - 1) - 1
    steps = F.when(last >= 0, F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0).cast("long")))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, F.array("rank_"), draw)


def few_shot_within(items: DataFrame, group: str, idx: str, shots: str, seed: int = 1234) -> DataFrame:
    """(group, idx, shot, place): for each row as many other rows of its own group as its column `shots` says, fewer only if there aren't so many.

    The draws are those of few_shot inside the group. One range shuffle ranks all rows, so a group of any size is spread; the
    groups' first ranks are one row a group, as a list of tasks has.
    """
    ranked = global_rank(items.select(F.col(group).alias("group_"), F.col(idx).alias("idx"), F.col(shots).alias("k_")), ["group_", "idx"]).withColumnRenamed("rank_", "all_")
    groups = ranked.groupBy(F.col("group_").alias("g_")).agg(F.min("all_").alias("first_"), F.count("*").alias("n_"))
    d = ranked.join(F.broadcast(groups), F.col("group_").eqNullSafe(F.col("g_"))).withColumn("rank_", F.col("all_") - F.col("first_"))
    d = d.select("group_", "idx", "first_", F.posexplode(_draws(F.col("k_"), seed)).alias("place", "shot_")).where("place > 0")
    at = ranked.select(F.col("idx").alias("shot"), F.col("all_").alias("at_"))
    return d.join(at, F.col("first_") + F.col("shot_") == F.col("at_")).select(F.col("group_").alias(group), F.col("idx").alias(idx), "shot", "place")


def few_shot(items: DataFrame, idx: str, k: int, seed: int = 1234) -> DataFrame:
    """(idx, shot, place): k other rows for each row from the whole table, without replacement; fewer only if there aren't k.

    Row number r of n draws a seeded number below n - 1, n - 2, ... from a hash and steps over itself and the rows drawn
    before, so all choices are equally likely. Shots meet their ids in an equi-join on row numbers; nothing is crossed.
    """
    ranked = global_rank(items.select(F.col(idx).alias("idx")), ["idx"])
    n = ranked.agg(F.count("*").alias("n_"))
    d = ranked.crossJoin(F.broadcast(n)).where("n_ > 1")  # one row

    draws = _draws(F.lit(k), seed)
    d = d.select("idx", F.posexplode(draws).alias("place", "shot_rank_")).where("place > 0")
    return d.join(ranked.select(F.col("idx").alias("shot"), "rank_"), F.col("shot_rank_") == F.col("rank_")).select("idx", "shot", "place")
