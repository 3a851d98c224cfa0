"""Lines of text files by their true numbers, however the files are split, and rows whose errors name file and line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ranks import cut


def numbered_lines(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(file, line_no, line): the number counts from 1 in each file, blank lines too.

    Lines end with LF, CRLF or CR, as Spark's reader cuts them, and the last may end with none; an empty file has no line.
    A task reads its stretches of files in order, so a line's number is its place in its stretch plus the lines of the
    file's stretches before it. Only the counts, a row for each stretch, are summed over; lines aren't shuffled or sorted. They are
    written once, since the cuts of the moment must hold for both readings.
    """
    reader = spark.read.option("pathGlobFilter", pattern) if pattern else spark.read
    block = F.col("_metadata.file_block_start")
    d = reader.text(path).select(F.col("_metadata.file_path").alias("file"), block.alias("block_"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("at_"))
    d = cut(d)
    counts = d.groupBy("file", "block_").agg(F.min("at_").alias("first_"), F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(W.partitionBy("file").orderBy("block_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("file").alias("f_"), F.col("block_").alias("b_"), (before - F.col("first_") + 1).alias("shift_"))
    found = d.join(starts, (F.col("file") == F.col("f_")) & (F.col("block_") == F.col("b_")))
    return found.select("file", (F.col("at_") + F.col("shift_")).alias("line_no"), "line")


def parsed_lines(lines: DataFrame, schema: str) -> DataFrame:
    """Numbered lines with `row`, one JSON object of the schema each, and `error`: what is wrong, by file and line, or null.

    Blank lines are passed over. A line that is no JSON object, or has a value of another type than its field's, is an error; a
    missing field is null, a field beyond the schema is left out.
    """
    d = lines.where(F.col("line").rlike(r"\S"))
    row = F.from_json("line", f"{schema}, bad_ string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad_"})
    d = d.withColumn("row_", row)
    wrong = F.when(~F.col("line").rlike(r"^\s*\{"), "no JSON object").when(F.col("row_").isNull() | F.col("row_.bad_").isNotNull(), "no JSON of the schema")
    where = F.concat("file", F.lit(":"), F.col("line_no").cast("string"), F.lit(": "))
    return d.withColumn("error", F.concat(where, wrong)).withColumn("row", F.when(wrong.isNull(), F.col("row_").dropFields("bad_"))).drop("row_")


def fail_on_first(rows: DataFrame, error: str = "error", order: tuple[str, ...] = ("file", "line_no")) -> DataFrame:
    """rows without the column of errors; fails at once, naming the first error in order, if there is one."""
    first = rows.where(F.col(error).isNotNull()).agg(F.min(F.struct(*order, error)).alias("e")).first()["e"]
    if first is not None:
        raise ValueError(first[error])
    return rows.drop(error)


def curated_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, line_no, row) of one JSON object a line; the first line that isn't one is an error that names it."""
    return fail_on_first(parsed_lines(numbered_lines(spark, path), schema).select("file", "line_no", "row", "error"))


def with_rule(rows: DataFrame, broken: Column) -> DataFrame:
    """rows with an error, by file and line, where a rule is broken; broken: its name or null."""
    where = F.concat("file", F.lit(":"), F.col("line_no").cast("string"), F.lit(": "))
    return rows.withColumn("error", F.concat(where, broken))
