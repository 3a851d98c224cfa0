"""Reading a corpus as a training loop does: strided row groups, batches, epochs, cursors; and its schedules by step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def document_batches(rows: DataFrame, rank: int = 0, world: int = 1, batch: int = 128, epochs: int = 1, cursor: tuple[int, int, int] | None = None) -> DataFrame:
    """rows (pq_idx, rg_idx, pos, ...) of one rank with their epoch and batch_idx, for so many epochs from the cursor's.

    A rank reads every world-th row group of each file from its own number on. After a cursor (pq_idx, rg_idx, epoch) the
    first epoch goes on in the cursor's file with the rank's group of the next stride, so nothing is read twice, or with
    the next file if that one has no more groups; later epochs read everything. batch_idx counts batches inside a row
    group; (epoch, pq_idx, rg_idx, batch_idx) is the order, and its first three are the cursor of the batch.
    """
    start = cursor[2] if cursor else 1
    d = rows.where(F.pmod("rg_idx", F.lit(world)) == rank).withColumn("epoch", F.explode(F.sequence(F.lit(start), F.lit(start + epochs - 1))))
    if cursor:
        again = (cursor[1] // world + 1) * world + rank
        after = (F.col("pq_idx") > cursor[0]) | ((F.col("pq_idx") == cursor[0]) & (F.col("rg_idx") >= again))
        d = d.where((F.col("epoch") > start) | after)
    return d.withColumn("batch_idx", F.expr(f"pos div {batch}"))


def base_rate(step: Column, steps: int, warmup: float = 0.0, warmdown: float = 0.5, last: float = 0.0) -> Column:
    """Share of the learning rate in pre-training: up over the warm-up, level, down to `last`."""
    up, down = round(warmup * steps), round(warmdown * steps)
    rest = (steps - step) / F.lit(float(max(down, 1)))
    fallen = rest + (1 - rest) * last
    out = F.when(step <= steps - down, F.lit(1.0)).otherwise(fallen)
    return F.when(step < up, (step + 1) / F.lit(float(up))).otherwise(out) if up else out


def tuning_rate(progress: Column, warmup: float = 0.0, warmdown: float = 0.0) -> Column:
    """Share of the learning rate in fine-tuning by progress from 0 to 1; never below 0."""
    up = progress / warmup if warmup > 0 else F.lit(1.0)
    down = F.greatest(F.lit(0.0), (1 - progress) / warmdown) if warmdown > 0 else F.lit(1.0)
    return F.when(progress < warmup, up).when(progress < 1 - warmdown, F.lit(1.0)).otherwise(down)


def reward_rate(step: Column, steps: int) -> Column:
    """Share of the learning rate in reward learning: straight down."""
    return 1.0 - step / F.lit(float(steps))


def momentum(step: Column, steps: int = 300, first: float = 0.85, last: float = 0.95) -> Column:
    share = F.least(step / F.lit(float(steps)), F.lit(1.0))
    return (1 - share) * first + share * last


def weight_decay(step: Column, steps: int, most: float) -> Column:
    return most * (1 - step / F.lit(float(steps)))


def consumed(step: Column, rank: int, world: int, size: int) -> Column:
    """(cursor, epoch, progress, last) after so many rows of one rank of `world` that deals a table of `size` rows in turn."""
    taken = rank + step * world
    return F.struct((taken % size).cast("long").alias("cursor"), (F.floor(taken / size) + 1).cast("long").alias("epoch"), (taken / size).alias("progress"), (taken >= size).alias("last"))


def scan_limit(rows: DataFrame, source: str, order: str, n: int) -> DataFrame:
    """The first n rows of each source in its order; tasks keep no more before the shuffle."""
    from pyspark.sql import Window as W

    return rows.withColumn("r_", F.row_number().over(W.partitionBy(source).orderBy(order))).where(F.col("r_") <= n).drop("r_")


#: Rows that each source gives to the fixed validation mixture; None is all.
VALIDATION_ROWS = {"SmolTalk": None, "MMLU": 5200, "GSM8K": 420}


def fixed_mixture(sources: dict[str, DataFrame], idx: str, rows: dict[str, int | None]) -> DataFrame:
    """The first rows of each source by its index, with the source's name: all of those without a number."""
    out = None
    for name, n in rows.items():
        part = (sources[name] if n is None else sources[name].where(F.col(idx) < n)).withColumn("task", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
