"""Reports: sections in their order, a table of metrics by stage, wall-clock time, rows of results and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names that a report's parts have, in the report's order.
SECTIONS = ["tokenizer-training.md", "tokenizer-evaluation.md", "base-model-training.md", "base-model-loss.md", "base-model-evaluation.md", "chat-sft.md", "chat-evaluation-sft.md", "chat-rl.md", "chat-evaluation-rl.md"]
HEADER = "header.md"
STAGES = ["base", "sft", "rl"]
STAGE_METRICS = {
    "base": ("base-model-evaluation.md", ["CORE"]),
    "sft": ("chat-evaluation-sft.md", ["ARC-Easy", "ARC-Challenge", "MMLU", "GSM8K", "HumanEval", "ChatCORE"]),
    "rl": ("chat-evaluation-rl.md", ["GSM8K"]),
}
METRIC_WIDTH, VALUE_WIDTH = 15, 8


def padded(c: Column, width: int) -> Column:
    """c filled with blanks to the width; longer ones stay whole."""
    return F.when(F.length(c) >= width, c).otherwise(F.rpad(c, width, " "))


def stage_metrics(sections: DataFrame) -> DataFrame:
    """(stage, metric, value) from sections (file, content): what follows the first colon, up to a second one, of the last line that names it."""
    lines = sections.select("file", F.posexplode(F.split("content", "\n")).alias("at", "line"))
    wanted = F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(f).alias("of"), F.lit(m).alias("metric")) for s, (f, ms) in STAGE_METRICS.items() for m in ms])
    d = lines.select("*", F.explode(wanted).alias("w")).where((F.col("file") == F.col("w.of")) & F.contains("line", F.col("w.metric")))
    value = F.trim(F.get(F.split("line", ":"), F.lit(1)))
    return d.groupBy("w.stage", "w.metric").agg(F.max_by(value, "at").alias("value"))


def metric_table(metrics: DataFrame, stages: list[str] = STAGES) -> DataFrame:
    """(metric, line) from (stage, metric, value): a row for each metric of any stage, a dash where a stage lacks it."""
    per = metrics.groupBy("metric").agg(*[F.max(F.when(F.col("stage") == s, F.col("value"))).alias(f"v{k}_") for k, s in enumerate(stages)])
    cells = [F.concat(F.lit(" "), padded(F.coalesce(f"v{k}_", F.lit("-")), VALUE_WIDTH), F.lit(" |")) for k in range(len(stages))]
    return per.select("metric", F.concat(F.lit("| "), padded(F.col("metric"), METRIC_WIDTH), F.lit(" |"), *cells).alias("line"))


def metric_order(metric: Column) -> list[Column]:
    """CORE first, ChatCORE last, the others by name."""
    return [metric != "CORE", metric == "ChatCORE", metric]


def stamp(content: Column, prefix: str) -> Column:
    """The time after a line's prefix; null without one."""
    return F.try_to_timestamp(F.nullif(F.trim(F.regexp_extract(content, rf"(?m)^{prefix}(.*)$", 1)), F.lit("")), F.lit("yyyy-MM-dd HH:mm:ss"))


def wall_clock(start: Column, end: Column) -> Column:
    """Hours and minutes between two times, unknown without both."""
    s = F.unix_timestamp(end) - F.unix_timestamp(start)
    return F.coalesce(F.concat(F.floor(s / 3600).cast("string"), F.lit("h"), F.floor(F.pmod(s, F.lit(3600)) / 60).cast("string"), F.lit("m")), F.lit("unknown"))


def report(sections: DataFrame) -> DataFrame:
    """(place, part) of a whole report from sections (file, content), a row a file: header, sections in their order, summary.

    Files of other names are left out. The wall-clock time goes from the header's start to the last section that isn't
    about reward learning.
    """
    names = [HEADER, *SECTIONS]
    known = sections.select("file", "content", (F.array_position(F.array(*[F.lit(n) for n in names]), F.col("file")) - 1).cast("int").alias("place")).where("place >= 0")
    parts = known.select("place", F.when(F.col("place") == 0, F.col("content")).otherwise(F.concat("content", F.lit("\n"))).alias("part"))
    rows = metric_table(stage_metrics(sections))
    key = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(metric_order(F.col("metric")))], "line")
    body = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda r: F.concat(r["line"], F.lit("\n"))), "").alias("body"))  # a row for each known metric at most
    head = "| " + "Metric".ljust(METRIC_WIDTH) + " |" + "".join(f" {s.upper().ljust(VALUE_WIDTH)} |" for s in STAGES) + "\n"
    rule = "|" + "-" * (METRIC_WIDTH + 2) + "|" + "".join("-" * (VALUE_WIDTH + 2) + "|" for _ in STAGES) + "\n"
    others = F.col("place").between(1, len(SECTIONS)) & ~F.contains("file", F.lit("rl"))
    is_header = F.col("place") == 0
    facts = known.agg(
        F.max(F.when(is_header, stamp(F.col("content"), "Run started:"))).alias("start"), F.max_by(F.when(others, stamp(F.col("content"), "timestamp:")), F.when(others, F.col("place"))).alias("end"),
        F.max(F.when(is_header, F.regexp_extract("content", r"(?s)### Bloat\n(.*?)\n\n", 1))).alias("bloat"),
    )
    summary = F.concat(F.lit("## Summary\n\n"), F.coalesce("bloat", F.lit("[bloat data missing]")), F.lit("\n\n" + head + rule), "body", F.lit("\nTotal wall clock time: "), wall_clock(F.col("start"), F.col("end")), F.lit("\n"))
    return parts.unionByName(facts.crossJoin(F.broadcast(body)).select(F.lit(len(names)).alias("place"), summary.alias("part")))  # one row each


def result_rows(runs: DataFrame, values: list[str], ok: str) -> DataFrame:
    """Rows for a table of results: of a failed run the first value is NA and the others are -1."""
    done = F.coalesce(F.col(ok), F.lit(False))
    text = {v: F.when(done, F.coalesce(F.col(v).cast("string"), F.lit("NA"))).otherwise("-1" if k else "NA") for k, v in enumerate(values)}
    return runs.withColumns(text).drop(ok)


def markdown_rows(rows: DataFrame, columns: list[str], with_header: bool) -> DataFrame:
    """(part, line) for a Markdown table: the header and the rule under it, unless the table has them, and a line a row."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    body = rows.select(F.lit(2).alias("part"), line.alias("line"))
    if not with_header:
        return body
    head = rows.sparkSession.createDataFrame([(0, "| " + " | ".join(columns) + " |"), (1, "|" + "---|" * len(columns))], "part int, line string")
    return head.unionByName(body)


def final_scores(log: Column) -> Column:
    """(core, val_bpb) of a log's text, as decimals, null if absent."""
    number = lambda label: F.nullif(F.regexp_extract(log, rf"{label}:\s*(-?\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")
    return F.struct(number("CORE metric").alias("core"), number("(?i)validation bpb").alias("val_bpb"))


def attempts(spec: str) -> list[tuple[int, str, int, int]]:
    """(place, label, length, batch) of a ladder like `a:2048:65536,b:1024:32768`."""
    return [(k, label, int(n), int(b)) for k, (label, n, b) in enumerate(part.split(":") for part in spec.split(","))]


def ladder(tries: DataFrame) -> DataFrame:
    """(run, result) from (run, place, label, length, batch, ok): the first attempt that ended well.

    The ladder stops with `error` at a batch that the length doesn't divide; without a good attempt it is `fail`.
    """
    kind = F.when(F.col("batch") % F.col("length") != 0, "error").when(F.coalesce("ok", F.lit(False)), F.col("label"))
    first = F.min(F.when(kind.isNotNull(), F.struct("place", kind.alias("kind"))))
    return tries.groupBy("run").agg(F.coalesce(first["kind"], F.lit("fail")).alias("result"))
