"""Checkpoints and ranks over a whole table, for operators of the library and of cairnwork.llm."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of checkpoints: spark.checkpoint.dir wins; a session without it gets a local one if its master is local."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(shared or f"file://{tempfile.gettempdir()}/cairnwork-{os.getuid()}")
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder and read back: its lineage ends there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def global_rank(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with `rank_` (0, 1, ... in the order of keys), written and read back.

    One range shuffle: Spark samples the keys and splits any run of equal leading keys, so a hot key
    doesn't meet in one task. The rank is the offset of the range partition plus the place in it, both
    taken from monotonically_increasing_id() of the checkpointed rows. The offsets are one row for each
    partition; their running sum is the only step in one task.
    """
    from pyspark.sql import Window as W

    ordered = df.repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    ids = cut(ordered.withColumn("mid_", F.monotonically_increasing_id()))
    part = F.shiftright("mid_", 33)
    sizes = ids.groupBy(part.alias("part_")).agg(F.count("*").alias("n_"))
    before = W.orderBy("part_").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("part_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_"))
    return (
        ids.withColumn("part_", part)
        .join(F.broadcast(starts), "part_")  # a row for each shuffle partition
        .withColumn("rank_", F.col("start_") + F.col("mid_").bitwiseAND((1 << 33) - 1))
        .drop("part_", "mid_", "start_")
    )
