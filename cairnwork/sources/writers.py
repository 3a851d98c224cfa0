"""Writers: corpus shards, message lines, manifests, reports, result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shards(df: DataFrame, path: str, shard: str = "shard", rows: int = 1_000_000) -> None:
    """Parquet by shard number, zstd, files of bounded rows."""
    df.repartition(shard).sortWithinPartitions(shard).write.option("compression", "zstd").option("maxRecordsPerFile", rows).partitionBy(shard).mode("overwrite").parquet(path)


def ascii_json(json: Column) -> Column:
    """JSON text with every character beyond ASCII as \\u escapes, two of them beyond the basic plane."""

    def escaped(c: Column) -> Column:
        h = F.lower(F.hex(F.encode(c, "UTF-16BE")))
        pair = F.concat(F.lit("\\u"), F.substring(h, 1, 4))
        return F.when(c.rlike(r"^[\x00-\x7f]$"), c).when(F.length(h) == 8, F.concat(pair, F.lit("\\u"), F.substring(h, 5, 4))).otherwise(pair)

    return F.when(json.rlike(r"[^\x00-\x7f]"), F.array_join(F.transform(F.regexp_extract_all(json, F.lit("(?s)."), F.lit(0)), escaped), "")).otherwise(json)


def message_lines(df: DataFrame, path: str, messages: str = "messages", ascii_only: bool = True) -> None:
    """One array of messages a line, as JSON in ASCII with escapes, or in raw UTF-8."""
    line = F.to_json(messages)
    df.select((ascii_json(line) if ascii_only else line).alias("value")).write.mode("overwrite").text(path)


def manifest(df: DataFrame, path: str, seed: int, counts: list[str]) -> None:
    """One indented JSON document: rows and counts by column value, in sorted order."""
    base = df.agg(F.count("*").alias("rows")).select(F.lit(seed).alias("seed"), "rows")
    parts = []
    for c in counts:
        g = df.groupBy(F.col(c).cast("string").alias("k")).agg(F.count("*").alias("n"))
        parts.append(g.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(f"{c}_counts")))
    out = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts, base)  # one row each
    out.select(F.to_json(F.struct("*"), {"pretty": "true"})).coalesce(1).write.mode("overwrite").text(path)


def padded_rows(df: DataFrame, footer: str = "CORE") -> DataFrame:
    """Lines of task, accuracy and centred score in columns of 35, 10 and 10, and a footer with the mean."""
    row = lambda a, b, c: F.concat(F.rpad(a, 35, " "), F.lit(", "), F.rpad(b, 10, " "), F.lit(", "), F.rpad(c, 10, " "))
    num = lambda c: F.coalesce(F.format_string("%.6f", F.col(c)), F.lit(""))
    body = df.select(F.lit(1).alias("part"), "task", row(F.col("task"), num("accuracy"), num("centered")).alias("line"))
    foot = df.agg(F.avg("centered").alias("m")).select(F.lit(2).alias("part"), F.lit(footer).alias("task"), row(F.lit(footer), F.lit(""), num("m")).alias("line"))
    return body.unionByName(foot)


def append_new(df: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of df whose key isn't there yet."""
    return df.join(existing.select(*keys).distinct(), keys, "left_anti")


def report_value(c: Column, kind: str) -> Column:
    """A value as a report shows it: floats with four places, large whole numbers with thousands marks."""
    if kind in ("double", "float"):
        return F.format_string("%.4f", c)
    if kind in ("int", "bigint", "long"):
        return F.when(c >= 10000, F.format_string("%,d", c.cast("long"))).otherwise(c.cast("string"))
    return c.cast("string")


def keep_newest(df: DataFrame, group: str, time: str, k: int) -> DataFrame:
    """The k newest rows of each group."""
    from pyspark.sql import Window as W

    return df.withColumn("r_", F.row_number().over(W.partitionBy(group).orderBy(F.desc(time)))).where(F.col("r_") <= k).drop("r_")
