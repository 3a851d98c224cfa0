"""Parsing of training and evaluation log lines, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _num(line: Column, pattern: str, kind: str = "double", group: int = 1) -> Column:
    v = F.replace(F.regexp_extract(line, pattern, group), F.lit(","), F.lit(""))
    return F.nullif(v, F.lit("")).try_cast(kind)


def step_line(line: Column) -> Column:
    """A struct of a step line's numbers; null if it isn't one. The total and the eta may be absent."""
    fields = {
        "step": _num(line, r"step\s+(\d+)", "long"), "total": _num(line, r"step\s+\d+/(\d+)", "long"), "percent": _num(line, r"\(([\d.]+)%\)"), "loss": _num(line, r"loss:\s*(nan|[-\d.]+)"),
        "lrm": _num(line, r"lrm:\s*([-\d.]+)"), "dt_ms": _num(line, r"dt:\s*([\d.]+)ms"), "tok_per_sec": _num(line, r"tok/sec:\s*([\d,]+)", "long"), "mfu": _num(line, r"mfu:\s*([\d.]+)"),
        "epoch": _num(line, r"epoch:\s*(\d+)", "long"), "minutes": _num(line, r"total time:\s*([\d.]+)m"), "eta_minutes": _num(line, r"eta:\s*([\d.]+)m"),
    }
    return F.when(line.rlike(r"^\s*step\s+\d+"), F.struct(*[v.alias(k) for k, v in fields.items()]))


def ratio(line: Column, label: str) -> Column:
    """(k, n, percent) of `label: k/n = p%`, fields null if absent."""
    p = rf"{label}:\s*(\d+)/(\d+)\s*=\s*([\d.]+)%"
    return F.struct(_num(line, p, "long", 1).alias("k"), _num(line, p, "long", 2).alias("n"), _num(line, p, "double", 3).alias("percent"))


def core_task_line(line: Column) -> Column:
    """A struct of a task's line in a composite evaluation; null if it isn't one."""
    s = F.struct(
        F.regexp_extract(line, r"Evaluating:\s*(\S+)", 1).alias("task"), _num(line, r"\((\d+)-shot", "int").alias("shots"), F.regexp_extract(line, r"type:\s*(\w+)", 1).alias("kind"), _num(line, r"accuracy:\s*([-\d.]+)").alias("accuracy"),
        _num(line, r"centered:\s*([-\d.]+)").alias("centered"), _num(line, r"evaluated:\s*(\d+)", "long").alias("evaluated"), _num(line, r"skipped:\s*(\d+)", "long").alias("skipped"), _num(line, r"time:\s*([\d.]+)s").alias("seconds"),
    )
    return F.when(line.rlike(r"Evaluating:.*accuracy:"), s)


def final_count(line: Column) -> Column:
    return F.struct(_num(line, r"Final:\s*(\d+)/(\d+)", "long", 1).alias("k"), _num(line, r"Final:\s*(\d+)/(\d+)", "long", 2).alias("n"))


def is_bad(line: Column, whole_words: bool = True) -> Column:
    """A line that tells of a failure. Without whole_words, `nan` also counts inside other words."""
    nan = r"\bnan\b" if whole_words else "nan"
    return line.rlike(rf"(?i)({nan}|out of memory|outofmemoryerror|traceback|cuda error)")


def key_value(line: Column) -> Column:
    """What follows the first colon, stripped."""
    return F.regexp_replace(F.split_part(line, F.lit(":"), F.lit(2)), r"^\s+|\s+$", "")


def timestamp(line: Column) -> Column:
    return F.try_to_timestamp(F.regexp_extract(line, r"(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)", 1), F.lit("yyyy-MM-dd HH:mm:ss"))


def eta_minutes(percent: Column, elapsed: Column) -> Column:
    return F.when(percent > 0, F.greatest(F.lit(0.0), elapsed * (100 - percent) / percent))


#: Orders in which terminal marks of a run are looked for.
FINISH_ORDER = ("done", "gate", "error", "exhausted")
WATCH_ORDER = ("error", "exhausted", "gate", "done")


def terminal_state(flags: dict[str, Column], order: tuple[str, ...] = FINISH_ORDER) -> Column:
    """The first mark in order that any line has (flags are aggregates like bool_or), else running."""
    return F.coalesce(*[F.when(flags[k], F.lit(k)) for k in order], F.lit("running"))
