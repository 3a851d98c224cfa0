"""From items of tasks to a composite score: prompts with shots, token spans, option losses, outcomes, centred mean, report.

An item is a row (task, idx, query, choices, gold, context_options, continuation, context), of which its task's kind reads
some; a task is a row (task, kind, shots, delimiter, baseline). The model enters as a table of losses and predictions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequences as Q
from . import statistics as S
from .conversation import byte_ids, special_id
from .ordered import few_shot_within
from .ranks import cut

PARTS = ("query", "choices", "gold", "context_options", "continuation", "context")
CHOICE, SCHEMA, CONTINUATION = "multiple_choice", "schema", "language_modeling"


def with_shots(items: DataFrame, tasks: DataFrame, seed: int = 1234) -> DataFrame:
    """items with their task's columns and examples, an array of other items of the task, in the order drawn."""
    d = items.join(F.broadcast(tasks), "task")  # a row a task
    drawn = few_shot_within(d.select("task", "idx", "shots"), "task", "idx", "shots", seed)
    shot = items.select(F.col("task").alias("t_"), F.col("idx").alias("shot"), F.struct(*PARTS).alias("example_"))
    own = drawn.join(shot, (F.col("task") == F.col("t_")) & (drawn["shot"] == shot["shot"])).groupBy("task", "idx").agg(F.array_sort(F.collect_list(F.struct("place", "example_"))).alias("own_"))  # as many as its task has shots
    own = own.select(F.col("task").alias("t_"), F.col("idx").alias("i_"), F.col("own_.example_").alias("examples"))
    none = F.array().cast(own.schema["examples"].dataType)
    return d.join(own, (F.col("task") == F.col("t_")) & (F.col("idx") == F.col("i_")), "left").drop("t_", "i_").withColumn("examples", F.coalesce("examples", none))


def options(rows: DataFrame, ids: Callable[[Column], Column] = byte_ids, bos: int | None = None, most: int | None = None, policy: str = "error") -> DataFrame:
    """(task, idx, kind, gold, baseline, options) of rows with examples: options are an array of (ids, start, end), null if the item is skipped.

    Choices share a beginning, and what follows it is scored; contexts of a schema share an end, which is scored; of a
    continuation its own tokens are. Sequences of more than `most` tokens follow the policy: `error` fails, `skip` leaves the
    item out, `truncate` keeps the last tokens unless the scored ones would go.
    """
    start = F.array(F.lit(special_id("<|bos|>") if bos is None else bos))
    shot, delimiter = F.col("examples"), F.col("delimiter")
    prompts = (
        F.when(F.col("kind") == CHOICE, Q.prompts_choice(F.col("query"), F.col("choices"), shot, delimiter))
        .when(F.col("kind") == SCHEMA, Q.prompts_schema(F.col("context_options"), F.col("continuation"), shot, delimiter))
        .when(F.col("kind") == CONTINUATION, Q.prompts_continuation(F.col("context"), F.col("continuation"), shot, delimiter))
        .otherwise(F.raise_error(F.concat(F.lit("unknown kind of task: "), F.coalesce("kind", F.lit("null")))).cast("array<string>"))
    )
    d = rows.withColumn("tokens_", F.transform(prompts, lambda p: F.concat(start, ids(p))))
    head, tail = Q.common_length(F.col("tokens_")).cast("int"), Q.common_length(F.col("tokens_"), True).cast("int")
    d = d.withColumns({"head_": head, "tail_": tail})
    span = lambda t, first: F.struct(t.alias("ids"), first.cast("int").alias("start"), F.size(t).alias("end"))
    found = (
        F.when(F.col("kind") == CHOICE, F.transform("tokens_", lambda t: span(t, F.col("head_"))))
        .when(F.col("kind") == SCHEMA, F.transform("tokens_", lambda t: span(t, F.size(t) - F.col("tail_"))))
        .otherwise(F.array(span(F.get("tokens_", F.lit(1)), F.size(F.get("tokens_", F.lit(0))))))
    )
    if most is not None:
        found = F.transform(found, lambda o: Q.fit(o["ids"], o["start"], o["end"], most, policy))
    d = d.withColumn("options", found)
    return d.select("task", "idx", "kind", "gold", "baseline", F.when(~F.exists("options", lambda o: o.isNull()), F.col("options")).alias("options"))


def requests(planned: DataFrame) -> DataFrame:
    """(task, idx, option, ids, start, end): the sequences that a model has to score."""
    return planned.select("task", "idx", F.posexplode("options").alias("option", "o_")).select("task", "idx", "option", "o_.*")


def outcomes(planned: DataFrame, scores: DataFrame) -> DataFrame:
    """(task, idx, ok) from scores (task, idx, option, losses, predictions); null for an item that was skipped or lacks a score.

    Losses and predictions stand where the token before the one they are of stands. The option of the least mean loss, the first of equals,
    must be the gold one; all tokens of a continuation must be predicted. An option without a scored token is never the least.
    """
    own = scores.select(F.col("task").alias("t_"), F.col("idx").alias("i_"), F.col("option").alias("n_"), "losses", "predictions")
    d = requests(planned).join(own, (F.col("task") == F.col("t_")) & (F.col("idx") == F.col("i_")) & (F.col("option") == F.col("n_")))
    mean = Q.span_mean(F.col("losses"), F.col("start"), F.col("end"))
    hit = Q.span_matches(F.col("predictions"), F.col("ids"), F.col("start"), F.col("end"))
    found = d.groupBy(F.col("task").alias("t_"), F.col("idx").alias("i_")).agg(F.min(F.struct(mean.isNull().alias("none"), mean.alias("mean"), "option"))["option"].alias("least_"), F.bool_and(hit).alias("hit_"), F.count("*").alias("scored_"))
    out = planned.join(found, (F.col("task") == F.col("t_")) & (F.col("idx") == F.col("i_")), "left")
    ok = F.when(F.col("kind") == CONTINUATION, F.col("hit_")).otherwise(F.col("least_") == F.col("gold"))
    return out.select("task", "idx", "baseline", F.when(F.col("scored_") == F.size("options"), ok).alias("ok"))


def composite(found: DataFrame, footer: str = "CORE") -> DataFrame:
    """(task, accuracy, centered, evaluated, skipped) of outcomes, and the footer's row with the mean of centred scores.

    A task without an evaluated item has the accuracy NaN, and so has then the mean.
    """
    nan = F.lit(float("nan"))
    per = found.groupBy("task").agg(*S.accuracy(F.col("ok")), F.first("baseline").alias("b_")).withColumn("accuracy", F.coalesce("accuracy", nan))
    per = per.select("task", "accuracy", S.centered(F.col("accuracy"), F.col("b_")).alias("centered"), "evaluated", "skipped")
    foot = per.agg(F.avg("centered").alias("centered"), F.sum("evaluated").alias("evaluated"), F.sum("skipped").alias("skipped"))
    return per.unionByName(foot.select(F.lit(footer).alias("task"), F.lit(None).cast("double").alias("accuracy"), "centered", "evaluated", "skipped"))


def evaluate(items: DataFrame, tasks: DataFrame, model: Callable[[DataFrame], DataFrame], most: int | None = None, policy: str = "error", ids: Callable[[Column], Column] = byte_ids) -> DataFrame:
    """composite() of items under a model, a function from requests to scores. What it is asked is written to the shared folder once."""
    planned = cut(options(with_shots(items, tasks), ids, None, most, policy))
    return composite(outcomes(planned, model(requests(planned))))
