"""Best-fit packing of token lengths into rows of fixed length, one stream of rows for each rank."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Filler:
    """Rows being filled from a buffer of documents, one document after the other.

    A piece leaves as soon as the buffer is full: of its documents the longest that fits goes first, the earliest of equals. If none
    fits: with crop, the shortest is cut to the row's rest and what is cut off is lost; without, the row ends. A document
    longer than a row is cut to it when padding. What it holds (`held`, `arrival`, `row`, `left`) is all its state.
    """

    def __init__(self, capacity: int, buffer: int, crop: bool) -> None:
        self.capacity, self.buffer, self.crop = capacity, buffer, crop
        self.held: list[tuple[int, int, int]] = []  # length, arrival, document
        self.arrival, self.row, self.left = 0, 0, capacity

    def add(self, doc: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """Takes a document in; (row, doc, used, lost) of what leaves for it."""
        insort(self.held, (n if self.crop else min(n, self.capacity), self.arrival, doc))
        self.arrival += 1
        while len(self.held) >= self.buffer:
            yield from self._step()

    def drain(self) -> Iterator[tuple[int, int, int, int]]:
        """What the buffer still holds, when no more documents come."""
        while self.held:
            yield from self._step()

    def _step(self) -> Iterator[tuple[int, int, int, int]]:
        held, left = self.held, self.left
        at = bisect_right(held, (left, float("inf"), 0)) - 1
        if at >= 0:
            n, _, doc = held.pop(bisect_left(held, (held[at][0], -1, 0)))
            yield self.row, doc, n, 0
        elif self.crop:
            size, _, doc = held.pop(0)
            n = left
            yield self.row, doc, n, size - n
        else:
            n = left
        self.left -= n
        if not self.left:
            self.row, self.left = self.row + 1, self.capacity


def fill(docs: Iterator[tuple[int, int]], capacity: int, buffer: int, crop: bool) -> Iterator[tuple[int, int, int, int]]:
    """(row, doc, used, lost) of each piece of documents (doc, length), by a Filler."""
    filler = Filler(capacity, buffer, crop)
    for doc, n in docs:
        yield from filler.add(doc, n)
    yield from filler.drain()


def best_fit(docs: DataFrame, idx: str, length: Column, capacity: int, buffer: int = 1000, crop: bool = True, ranks: int = 8, rows_per_group: int = 128) -> DataFrame:
    """(rank, row, doc, used, lost): row groups are dealt to ranks in turn, and each rank packs its own stream.

    Only ids and lengths are moved. A rank holds no more than its buffer.
    """
    d = docs.select(F.col(idx).cast("long").alias("doc"), length.cast("long").alias("n")).where("n > 0").withColumn("rank", F.expr(f"(doc div {rows_per_group}) % {ranks}").cast("int"))
    d = d.repartition(ranks, "rank").sortWithinPartitions("rank", "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((r, doc, n) for b in batches for doc, n, r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        ahead = next(rows, None)
        while ahead is not None:
            rank, first = ahead[0], ahead

            def own():
                nonlocal ahead
                item = first
                while item is not None and item[0] == rank:
                    ahead = item
                    yield item[1:]
                    item = next(rows, None)
                ahead = item

            out: list[tuple] = []
            for piece in fill(own(), capacity, buffer, crop):
                out.append((rank, *piece))
                if len(out) >= 10_000:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    return d.mapInArrow(run, "rank int, row long, doc long, used long, lost long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["rank", "row", "doc", "used", "lost"])


def metrics(packed: DataFrame, capacity: int) -> DataFrame:
    """utilisation, crop and padding shares of a packing."""
    rows = packed.groupBy("rank", "row").agg(F.sum("used").alias("used"), F.sum("lost").alias("lost"))
    g = rows.agg(F.sum("used").alias("u"), F.sum("lost").alias("l"), F.count("*").alias("n"))
    return g.select((F.col("u") / (F.col("n") * capacity)).alias("utilisation"), (F.col("l") / (F.col("u") + F.col("l"))).alias("crop"), (1 - F.col("u") / (F.col("n") * capacity)).alias("padding"))
