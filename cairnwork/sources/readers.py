"""Readers: corpus shards, conversation and item files, result tables, logs, checkpoint metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from ..operators import contents as T
from .lines import numbered_lines

MESSAGES = "array<struct<role:string,content:string>>"


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of all Parquet shards, with file, row in the file, and pq_idx, the file's place by name.

    Temporary files are left out. One row a file is ranked, not the texts.
    """
    from pyspark.sql import Window as W

    d = spark.read.option("pathGlobFilter", "*.parquet").parquet(folder).select("text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    files = d.select("file").distinct().withColumn("pq_idx", F.row_number().over(W.orderBy("file")) - 1)
    return d.join(F.broadcast(files), "file")


def conversations(spark: SparkSession, path: str) -> DataFrame:
    """One conversation a line: an array of messages; blank lines are skipped, bad ones have null messages."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", MESSAGES).alias("messages"))


def curated_rows(spark: SparkSession, path: str) -> DataFrame:
    """Raw curated rows; a line that doesn't parse is in _corrupt_record."""
    schema = f"id string, source string, teacher_model string, category string, quality string, tags array<string>, messages {MESSAGES}, _corrupt_record string"
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def items(spark: SparkSession, path: str) -> DataFrame:
    """Items of any of the three kinds of composite evaluation tasks."""
    return spark.read.schema("query string, choices array<string>, gold int, context_options array<string>, continuation string, context string").json(path)


def number(c: Column) -> Column:
    """A number from text, null for the sentinels NA, nan, -1 and blank."""
    t = F.trim(c)
    return F.when(~F.lower(t).isin("", "na", "nan", "-1"), t.try_cast("double"))


def random_baselines(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.option("header", True).csv(path)
    return d.select(F.col("Eval Task").alias("task"), number(F.col("Random baseline")).alias("baseline"))


def padded_csv(spark: SparkSession, path: str) -> DataFrame:
    """A result file of padded columns; rows without a number in the second column are skipped."""
    d = spark.read.schema("task string, accuracy string, centered string").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    d = d.select("task", F.col("accuracy").try_cast("double").alias("accuracy"), F.col("centered").try_cast("double").alias("centered"))
    return d.where("accuracy IS NOT NULL OR centered IS NOT NULL")


def results_table(spark: SparkSession, path: str, numbers: list[str]) -> DataFrame:
    """A TSV with a header whose named columns are numbers with sentinels."""
    d = spark.read.option("header", True).option("sep", "\t").csv(path)
    return d.withColumns({c: number(F.col(c)) for c in numbers})


def task_config(spark: SparkSession, tasks: list[dict]) -> DataFrame:
    """A parsed task list as a table, with the defaults of missing fields."""
    rows = [(t["label"], t["icl_task_type"], t["dataset_uri"], int(t["num_fewshot"][0]), t.get("continuation_delimiter", " ")) for t in tasks]
    return spark.createDataFrame(rows, "label string, icl_task_type string, dataset_uri string, num_fewshot int, continuation_delimiter string")


def checkpoint_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """(file, step, val_bpb) of meta_*.json; bad files are ignored, a missing step is in the name, a missing loss infinite."""
    d = spark.read.option("multiLine", True).option("ignoreCorruptFiles", True).option("pathGlobFilter", "meta_*.json").schema("step long, val_bpb double").json(folder)
    file = F.col("_metadata.file_name")
    return d.select(file.alias("file"), F.coalesce("step", F.regexp_extract(file, r"meta_(\d+)", 1).try_cast("long")).alias("step"), F.coalesce("val_bpb", F.lit(float("inf"))).alias("val_bpb"))


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line): lines of logs with their numbers in their files, from 1."""
    return numbered_lines(spark, path).withColumn("file", F.substring_index("file", "/", -1))


#: Seeds of test items begin here, beyond those of training items.
TEST_SEEDS = 10_000_000


def _generated(spark: SparkSession, words: DataFrame, size: int, test: bool) -> tuple[DataFrame, object]:
    """size items (idx, seed_, word), each with a word (idx, word) drawn by its own seed, and the draws: draw(k, n) is below n."""
    n = words.count()
    d = spark.range(size).select(F.col("id").alias("idx"), (F.col("id") + (TEST_SEEDS if test else 0)).alias("seed_"))
    draw = lambda k, most: F.conv(F.substring(F.sha1(F.concat("seed_", F.lit(f":{k}")).cast("binary")), 1, 15), 16, 10).cast("long") % most
    w = words.select(F.col("idx").alias("w_"), "word")
    return d.withColumn("pick_", draw(0, max(1, n))).join(w, F.col("pick_") == F.col("w_")).drop("pick_", "w_"), draw


def spelling(spark: SparkSession, words: DataFrame, size: int, test: bool = False) -> DataFrame:
    """size generated items (idx, word, letter, question, trace, call, answer, final) from a word table (idx from 0, word).

    The letter is one of the word's in nine of ten items. Three of ten questions are in lower case, half end with a question
    mark, letter and word may stand in quotes. The trace counts by hand, the call counts by program. An empty word has the letter ''.
    """
    d, draw = _generated(spark, words, size, test)
    own = F.substring("word", (draw(2, F.greatest(F.length("word"), F.lit(1))) + 1).cast("int"), F.lit(1))
    d = d.withColumn("letter", F.when(draw(1, 10) < 9, own).otherwise(F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (draw(3, 26) + 1).cast("int"), F.lit(1))))
    of = lambda values, k: F.array(*map(F.lit, values))[draw(k, len(values)).cast("int")]
    asked = of(V.COUNT_QUESTIONS, 4)
    asked = F.when(draw(5, 10) < 3, F.lower(asked)).otherwise(asked)
    quoted = lambda c, k: F.concat(of(V.QUOTES, k), c, of(V.QUOTES, k))
    asked = F.replace(F.replace(asked, F.lit("{letter}"), quoted("letter", 6)), F.lit("{word}"), quoted("word", 7))
    d = d.withColumn("question", F.concat(asked, F.when(draw(8, 2) == 0, "?").otherwise("")))
    count = X.letter_count(F.col("word"), F.col("letter")).cast("long")
    call = F.concat(F.lit("'"), "word", F.lit("'.count('"), "letter", F.lit("')"))
    final = F.concat(F.lit("\n\nPython gives us "), count, F.lit(".\n\nMy final answer is:\n\n#### "), count)
    return d.select("idx", "word", "letter", "question", X.letter_trace(F.col("word"), F.col("letter")).alias("trace"), call.alias("call"), count.alias("answer"), final.alias("final"))


def spelled_words(spark: SparkSession, words: DataFrame, size: int, test: bool = False) -> DataFrame:
    """size items (idx, question, answer) that ask for a word's letters."""
    d, _ = _generated(spark, words, size, test)
    return d.select("idx", F.concat(F.lit("Spell the word: "), "word").alias("question"), F.concat("word", F.lit(":"), X.spelled(F.col("word"))).alias("answer"))


def unwrapped(df: DataFrame, wrapper: str) -> DataFrame:
    """The fields of a struct column as columns; the others go."""
    return df.select(f"{wrapper}.*")


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """(word) of a file with a word a line, without white space around; blank lines are empty words."""
    return spark.read.text(path).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("word"))


def results_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV of results with a header; without a schema the types are inferred by a second reading."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def checked_conversations(spark: SparkSession, path: str) -> DataFrame:
    """conversations(), failing on a line that isn't two or more messages of text by user and assistant in turn."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(checked_messages(F.from_json("value", MESSAGES), F.col("value")).alias("messages"))


def typed_conversations(spark: SparkSession, path: str) -> DataFrame:
    """(messages) of a conversation a line, an array or an object with `messages`, whose contents are texts or lists of typed parts.

    Blank lines are skipped; the query fails on a line that can't be rendered, with what is wrong with it.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(T.checked(T.typed_messages(F.col("value"))).alias("messages"))


def checked_messages(messages: Column, line: Column) -> Column:
    """The messages; the query fails, with the line's beginning, unless there are two and user and assistant alternate."""
    turn = lambda m, i: (m["role"] == F.when(i % 2 == 0, "user").otherwise("assistant")) & m["content"].isNotNull()
    good = F.coalesce((F.size(messages) >= 2) & F.forall(F.transform(messages, turn), lambda ok: F.coalesce(ok, F.lit(False))), F.lit(False))
    return F.when(good, messages).otherwise(F.raise_error(F.concat(F.lit("not a conversation: "), F.substring(F.coalesce(line, F.lit("null")), 1, 200))).cast(MESSAGES))


def history(points: DataFrame, keys: list[str], pattern: str | None = None, most: int = 12) -> DataFrame:
    """(run, key, step, value) from points (run, step, key, value): of each run the first of the keys that it has.

    Points without a step or a value are left out, then runs of fewer than two points; of the others the first `most` by name.
    A run with none of the keys has no point.
    """
    d = points.where(F.col("run").rlike(pattern)) if pattern else points
    place = F.array_position(F.array(*[F.lit(k) for k in keys]), F.col("key"))
    d = d.where(F.col("key").isin(keys)).withColumn("place_", place)
    whole = F.col("step").isNotNull() & F.col("value").isNotNull()
    first = d.groupBy("run", "place_").agg(F.count_if(whole).alias("n_")).groupBy("run").agg(F.min(F.struct("place_", "n_")).alias("f_"))
    runs = first.where("f_.n_ >= 2").orderBy("run").limit(most).select("run", F.col("f_.place_").alias("place_"))
    return d.where(whole).join(F.broadcast(runs), ["run", "place_"]).select("run", "key", "step", "value")


def from_templates(spark: SparkSession, literals: list[tuple], schema: str, question: Column, answer: Column) -> DataFrame:
    """(idx, question, answer) of a template filled from a bounded list of literals in its order."""
    d = spark.createDataFrame([(k, *row) for k, row in enumerate(literals)], f"idx long, {schema}")
    return d.select("idx", question.alias("question"), answer.alias("answer"))
