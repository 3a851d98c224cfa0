"""Chat data of four row shapes as question and answer pairs, read in the order of their files up to a limit of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The columns of each shape.
SHAPES = {
    "messages": "category string, reward_model_score double, messages array<struct<role:string,content:string>>, difficulty string, quality string, conversation_tokens long",
    "turns": "conversations array<struct<from:string,value:string>>",
    "problem": "problem string, solution string",
    "question": "question string, answer string",
}


def first_rows(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """Rows of Parquet files with `position`, their place from 0 in the order of file names and of rows in each file.

    With a limit only the files that hold the first `limit` rows are read, and of the last of them its first rows. A file's number of
    rows comes from its end, without its columns. One row a file goes through a window; the paths of the kept files go to the driver, at most `limit`.
    """
    file, at = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    sizes = spark.read.schema("none_ string").parquet(path).groupBy(file.alias("file_")).agg(F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(W.orderBy("file_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("file_", before.alias("start_"))
    reader = spark.read.schema(schema)
    if limit is None:
        d = reader.parquet(path)
    else:
        kept = [r["file_"] for r in starts.where(F.col("start_") < limit).select("file_").collect()]
        d = reader.parquet(*kept) if kept else reader.parquet(path).limit(0)
    d = d.select("*", file.alias("of_"), at.alias("at_")).join(F.broadcast(starts), F.col("of_") == F.col("file_"))  # a row a file
    d = d.withColumn("position", F.col("start_") + F.col("at_")).drop("of_", "file_", "start_", "at_")
    return d if limit is None else d.where(F.col("position") < limit)


def _turns(turns: Column, role: str, text: str) -> tuple[Column, Column, Column]:
    first, second = F.get(turns, F.lit(0)), F.get(turns, F.lit(1))
    there = F.coalesce((first[role] == "user") & (second[role] == "assistant"), F.lit(False))
    return there, first[text], second[text]


def pairs(rows: DataFrame, shape: str) -> DataFrame:
    """(position, category, reward, user, assistant) of rows of a shape; texts as they are, null ones empty.

    Of messages and turns the first two must be the user's and the assistant's, else the row is left out. Category and reward are those
    of `messages`, a missing reward 0.0; the other shapes have none.
    """
    none = F.lit(None).cast("string"), F.lit(None).cast("double")
    if shape == "messages":
        (there, user, assistant), extra = _turns(F.col("messages"), "role", "content"), (F.col("category"), F.coalesce("reward_model_score", F.lit(0.0)))
    elif shape == "turns":
        (there, user, assistant), extra = _turns(F.col("conversations"), "from", "value"), none
    elif shape in ("problem", "question"):
        names = ("problem", "solution") if shape == "problem" else ("question", "answer")
        there, user, assistant, extra = F.lit(True), F.col(names[0]), F.col(names[1]), none
    else:
        raise ValueError(f"unknown shape {shape}: one of {', '.join(SHAPES)}")
    text = lambda c: F.coalesce(c, F.lit(""))
    return rows.where(there).select("position", extra[0].alias("category"), extra[1].alias("reward"), text(user).alias("user"), text(assistant).alias("assistant"))


def read_pairs(spark: SparkSession, sources: dict[str, tuple[str, str, int | None]]) -> DataFrame:
    """(source, position, category, reward, user, assistant) of sources name -> (path, shape, limit of rows read)."""
    out = None
    for name, (path, shape, limit) in sources.items():
        part = pairs(first_rows(spark, path, SHAPES[shape], limit), shape).select(F.lit(name).alias("source"), "*")
        out = part if out is None else out.unionByName(part)
    return out
