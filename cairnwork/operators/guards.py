"""Guards and gates: rows that must hold, counts that must suffice, and what to do when a run didn't."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by_quality(rows: DataFrame, include_medium: bool = False, quality: str = "quality") -> DataFrame:
    """Rows of high quality, or all; a null quality isn't high."""
    return rows if include_medium else rows.where(F.col(quality) == "high")


def answer_in_letters(answer: Column, letters: Column) -> Column:
    """The answer; the query fails on a row whose answer is none of its letters."""
    ok = F.coalesce(F.array_contains(letters, answer), F.lit(False))
    return F.when(ok, answer).otherwise(F.raise_error(F.concat(F.lit("answer "), F.coalesce(answer, F.lit("null")), F.lit(" must be one of "), F.coalesce(F.array_join(letters, ", "), F.lit("null")))).cast("string"))


def valid_runs(runs: DataFrame, loss: str = "val_bpb") -> DataFrame:
    """Runs with a number above 0 as their loss."""
    return runs.where(F.col(loss).isNotNull() & ~F.isnan(F.col(loss).cast("double")) & (F.col(loss) > 0))


def supervised(batches: DataFrame, targets: str = "targets") -> DataFrame:
    """Batches with at least one target that isn't -1."""
    return batches.where(F.exists(targets, lambda t: t != -1))


def enough_rows(rows: DataFrame, least: int) -> DataFrame:
    """(rows, ok): whether a table has so many rows; counts one row more than needed at most."""
    return rows.limit(least).agg(F.count("*").alias("rows")).withColumn("ok", F.col("rows") >= least)


def require_rows(rows: DataFrame, least: int) -> DataFrame:
    """The table; a query on it fails if it has fewer rows."""
    check = enough_rows(rows, least).select(F.col("rows").alias("rows_"), F.col("ok").alias("ok_"))  # one row
    fails = F.raise_error(F.concat(F.lit(f"fewer than {least} rows: "), F.col("rows_").cast("string"))).cast("boolean")
    return rows.crossJoin(F.broadcast(check)).where(F.when(F.col("ok_"), F.lit(True)).otherwise(fails)).drop("rows_", "ok_")


def confirmed(status: Column, pass8: Column, mmlu: Column, gsm: float = 4.0, least: float = 27.0) -> Column:
    """Whether a run was confirmed in full and clears both thresholds."""
    return F.coalesce((status == "full_confirm_complete") & (pass8 >= gsm) & (mmlu >= least), F.lit(False))


def branch(first_ok: Column, second_ok: Column, names: tuple[str, str, str] = ("promoted_v3_candidate", "promoted_v4_candidate", "hold_mixv2_provisional")) -> Column:
    """The first of two branches that clears its thresholds, or the standing choice."""
    return F.when(F.coalesce(first_ok, F.lit(False)), names[0]).when(F.coalesce(second_ok, F.lit(False)), names[1]).otherwise(names[2])


def quick_status(mmlu: Column, least: float) -> Column:
    """quick_gate_failed below the threshold or without a number, else on to the full confirmation."""
    return F.when(F.coalesce(~F.isnan(mmlu) & (mmlu >= least), F.lit(False)), "full_confirm").otherwise("quick_gate_failed")


def overflow_policy(locked: Column, code: Column, log: Column) -> Column:
    """standard, fixed (a lock stands, or the log tells of a sequence too long: the lock is set) or failed."""
    too_long = log.rlike(r"exceeds max sequence length|Sequence length.*>")
    return F.when(F.coalesce(locked, F.lit(False)), "fixed").when(code == 0, "standard").when(too_long, "fixed").otherwise("failed")


def mean_of_two(a: Column, b: Column) -> Column:
    """The mean of two estimators."""
    return (a + b) / 2


def pool(workers: DataFrame, busy: str) -> DataFrame:
    """(total_workers, available_workers, busy_workers) from one row a worker; a null counts as available."""
    taken = F.count_if(F.coalesce(F.col(busy), F.lit(False)))
    return workers.agg(F.count("*").alias("total_workers"), (F.count("*") - taken).alias("available_workers"), taken.alias("busy_workers"))


def tail(lines: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The last n rows of each group in its order; the number is a literal, so tasks keep no more before the shuffle."""
    return lines.withColumn("from_end", F.row_number().over(W.partitionBy(group).orderBy(F.col(order).desc()))).where(F.col("from_end") <= n)
