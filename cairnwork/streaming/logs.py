"""Streaming over logs and counts: latest values, terminal states, readiness, event windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import logs as L


def tail(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of files as they appear: (file, line, seen)."""
    return spark.readStream.text(folder).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line"), F.current_timestamp().alias("seen"))


def latest(lines: DataFrame) -> DataFrame:
    """The last step of each file and its loss; state is one row a file."""
    s = lines.withColumn("s", L.step_line(F.col("line"))).where("s IS NOT NULL")
    return s.groupBy("file").agg(F.max("s.step").alias("step"), F.max_by("s.loss", "s.step").alias("loss"))


def terminal(lines: DataFrame, marks: dict[str, str], order: tuple[str, ...] = L.FINISH_ORDER) -> DataFrame:
    """The state of each file from marks (name -> pattern)."""
    flags = {k: F.bool_or(F.col("line").rlike(p)) for k, p in marks.items()}
    return lines.groupBy("file").agg(L.terminal_state({k: flags.get(k, F.lit(False)) for k in order}, order).alias("state"))


def when_reached(lines: DataFrame, step: int, fire: Callable[[DataFrame], None]):
    """A running query that calls fire with the lines of steps at or beyond the target, batch by batch."""
    hits = lines.withColumn("s", L.step_line(F.col("line"))).where(F.col("s.step") >= step).select("file", "s.*")
    return hits.writeStream.foreachBatch(lambda df, _: fire(df) if not df.isEmpty() else None).trigger(availableNow=True).start()


def ready(rows: DataFrame, least: int) -> DataFrame:
    """Whether as many rows have come."""
    return rows.groupBy().agg(F.count("*").alias("rows")).withColumn("ready", F.col("rows") >= least)
