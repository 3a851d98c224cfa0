"""Shared pieces of the operators here: word rule, batches, connected components."""

from __future__ import annotations

import ctypes
import ctypes.util

import pyarrow
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import checkpoint_folder, cut, global_rank  # noqa: F401  (the operators here take them from this module)

#: The white space that ends a word: space and \x09-\x0D. Everything else is part of a word.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words, without an array of them: word starts are counted in a text of marks."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: A key with more than one in so many of all rows is hot; there are fewer hot keys than this.
HOT = 10_000


def hot_join(rows: DataFrame, marks: DataFrame, keys: list[str], n_col: str) -> DataFrame:
    """rows joined by keys with marks, which has one row a key and in n_col how many rows have it; n_col is dropped.

    Rows of hot keys stay where they are and get their marks by a broadcast of fewer than HOT rows; the others are
    shuffled, so no task gets more than one in HOT of the rows by a single key. marks is read twice: cut it before.
    """
    total = marks.agg(F.sum(n_col)).first()[0] or 0
    hot = marks.where(F.col(n_col) * HOT > total)
    few = hot.limit(HOT).count()
    if not few:
        return rows.join(marks.drop(n_col), keys)
    if few == marks.limit(HOT).count():  # all keys are
        return rows.join(F.broadcast(marks.drop(n_col)), keys)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(marks.where(F.col(n_col) * HOT <= total).drop(n_col), keys)
    return rows.join(F.broadcast(hot.drop(n_col)), keys).unionByName(cold)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b); component is the smallest node reachable.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each is an aggregation with
    partial sums and a join that adaptive execution splits where a node is hot, and the edges are cut
    to the shared folder after each pair of steps, until a round changes nothing: the rounds grow with the logarithm
    of the longest way. Nothing is collected but two numbers a round. Empty edges give an empty table.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    while mark[0]:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        e = cut(small.where("a <> b").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())


def tidy(work):
    """work, an operator on Arrow batches, that hands freed memory back when a task ends: workers serve many tasks."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            pyarrow.default_memory_pool().release_unused()
            libc = ctypes.CDLL(ctypes.util.find_library("c"))
            if hasattr(libc, "malloc_trim"):
                libc.malloc_trim(0)

    return run


#: Rows of an Arrow batch, and bytes of text that an operator works on at once.
BATCH_ROWS = 1000
SLICE_BYTES = 2 << 20


def bounded_batches(df: DataFrame, rows: int = BATCH_ROWS) -> DataFrame:
    """df, with Arrow batches of its session held to so many rows: long texts then fit beside each other."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def text_slices(batch, most: int = SLICE_BYTES):
    """(ids, texts) of consecutive rows of a batch (id, text) of at most so many bytes, or of one row."""
    size = 0
    start = 0
    texts = batch.column(1).to_pylist()
    for k, t in enumerate(texts):
        n = len(t) if t else 0
        if k > start and size + n > most:
            yield batch.column(0).slice(start, k - start), texts[start:k]
            start, size = k, 0
        size += n
    if start < len(texts):
        yield batch.column(0).slice(start), texts[start:]
