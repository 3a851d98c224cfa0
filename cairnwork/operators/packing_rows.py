"""Other ways to pack documents into rows of fixed length, of one stream: greedy with crops or pads, and first fit by falling length.

All give (rank, row, doc, used, lost) as packing.best_fit does, with rank 0, and, with `offset`, the place in the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import at_or_after, chain, sum_before
from .ranks import cut, global_rank


def greedy(docs: DataFrame, idx: str, length: Column, capacity: int, crop: bool = True) -> DataFrame:
    """Documents in the order of idx, one after the other. One that doesn't fit into the row's rest is cut to it, or without crop begins the next row.

    Each document points to where the row after its own would begin, found by running sums; the rows are the way along
    these pointers (ordered.chain), so no task walks through all documents: as many joins of narrow rows as the number of rows has
    bits. Without crop a document longer than a row is cut to it. Documents of no tokens or a null length are left out;
    the last row may be short.
    """
    d = docs.select(F.col(idx).alias("doc"), length.cast("long").alias("size_")).where("size_ > 0")
    d = global_rank(d, ["doc", "size_"]).withColumn("n_", F.col("size_") if crop else F.least("size_", F.lit(capacity)))
    d = cut(sum_before(d, "rank_", F.col("n_"), "start_"))
    sums = d.select((F.col("start_") + F.col("n_")).alias("sum_"), F.col("rank_").alias("next_"))
    if crop:  # nodes: the last document of a row, -1 before the first
        spark = docs.sparkSession
        goals = d.select(F.col("rank_").alias("node"), (F.col("start_") + F.col("n_") + capacity).alias("goal_")).unionByName(spark.createDataFrame([(-1, capacity)], "node long, goal_ long"))
        ends = cut(chain(at_or_after(goals, "goal_", sums, "sum_").select("node", "next_"), -1))
        marks = ends.where("steps > 0").select("node", (F.col("steps") - 1).alias("next_"))
        first = ends.join(d.select("rank_", (F.col("start_") + F.col("n_")).alias("at_")), F.col("node") == F.col("rank_"), "left").select(F.col("steps").alias("row"), F.coalesce("at_", F.lit(0)).alias("at_"))
        last = ends.agg(F.max("steps").alias("last_"))
        place = d.withColumn("here_", F.col("rank_"))
    else:  # nodes: the first document of a row
        goals = d.select(F.col("rank_").alias("node"), (F.col("start_") + capacity + 1).alias("goal_"))
        starts = cut(chain(at_or_after(goals, "goal_", sums, "sum_").select("node", "next_"), 0))
        marks = starts.where("steps > 0").select("node", (F.col("steps") - 1).alias("next_"))
        first = starts.join(d.select("rank_", F.col("start_").alias("at_")), F.col("node") == F.col("rank_")).select(F.col("steps").alias("row"), "at_")
        last = starts.agg(F.max("steps").alias("last_"))
        place = d.withColumn("here_", F.col("rank_") + 1)
    rows = at_or_after(place, "here_", marks, "node").crossJoin(F.broadcast(last)).withColumn("row", F.coalesce("next_", "last_"))  # last: one row
    rows = rows.join(first, "row").withColumn("offset", F.col("start_") - F.col("at_"))
    used = F.least(F.col("n_"), capacity - F.col("offset"))
    return rows.select(F.lit(0).alias("rank"), "row", F.col("doc").cast("long").alias("doc"), used.alias("used"), (F.col("size_") - used).alias("lost"), "offset")


def first_fit_runs(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """(placements, rows) of first fit by falling length, from how many documents have each length.

    Rows of equal content are one run, so the work depends on the lengths and not on the documents. A placement
    (length, first, n, row, per_row, offset): n documents of the length, from the first-th on, per_row to a row from `row` on.
    """
    runs: list[list[int]] = []  # first row, rows, tokens free
    out, rows = [], 0
    for length in sorted(counts, reverse=True):
        left, done, kept = counts[length], 0, []
        for start, n, free in runs:
            per = free // length
            if not left or not per:
                kept.append([start, n, free])
                continue
            full = min(n, left // per)
            if full:
                out.append((length, done, full * per, start, per, capacity - free))
                kept.append([start, full, free - per * length])
                left, done = left - full * per, done + full * per
            if full < n:
                if left:
                    out.append((length, done, left, start + full, left, capacity - free))
                    kept.append([start + full, 1, free - left * length])
                    done, left, full = done + left, 0, full + 1
                if full < n:
                    kept.append([start + full, n - full, free])
        per = capacity // length
        for n, each in ((left // per, per), (1 if left % per else 0, left % per)):
            if n:
                out.append((length, done, n * each, rows, each, 0))
                kept.append([rows, n, capacity - each * length])
                rows, done = rows + n, done + n * each
        runs = [r for r in kept if r[2]]
    return out, rows


def first_fit_decreasing(docs: DataFrame, idx: str, length: Column, capacity: int) -> DataFrame:
    """Documents by falling length, of equals by idx, each into the first row that has room for it.

    The driver gets a count for each length, `capacity` of them at most, and lays out runs of equal rows; documents find
    theirs by their rank among those of their length, from one range shuffle of narrow rows. Documents longer than a
    row are cut to it. Documents of no tokens or a null length are left out.
    """
    d = docs.select(F.col(idx).alias("doc"), length.cast("long").alias("size_")).where("size_ > 0").withColumn("n_", F.least("size_", F.lit(capacity)))
    ranked = global_rank(d, ["n_", "doc"])
    found = ranked.groupBy("n_").agg(F.count("*").alias("c_"), F.min("rank_").alias("f_")).collect()  # `capacity` rows at most
    firsts = {r["n_"]: r["f_"] for r in found}
    placements, _ = first_fit_runs({r["n_"]: r["c_"] for r in found}, capacity)
    rows = [(n, firsts[n] + first, firsts[n] + first + count, row, per, offset) for n, first, count, row, per, offset in placements]
    plan = docs.sparkSession.createDataFrame(rows, "p_ long, from_ long, to_ long, row_ long, per_ long, offset_ long")
    at = ranked.join(F.broadcast(plan), (F.col("n_") == F.col("p_")) & (F.col("rank_") >= F.col("from_")) & (F.col("rank_") < F.col("to_")))  # bounded by the lengths
    nth = F.col("rank_") - F.col("from_")
    row, offset = F.col("row_") + F.floor(nth / F.col("per_")), F.col("offset_") + nth % F.col("per_") * F.col("n_")
    return at.select(F.lit(0).alias("rank"), row.alias("row"), F.col("doc").cast("long").alias("doc"), F.col("n_").alias("used"), (F.col("size_") - F.col("n_")).alias("lost"), offset.alias("offset"))
