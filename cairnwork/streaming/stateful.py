"""Streams with state of their own: packing from a buffer that outlives batches, and a watcher that speaks once a file.

Both need the RocksDB state store: set `spark.sql.streaming.stateStore.providerClass` to STORE (rocksdb_store(spark) does).
A stream with times in it (flush_ms, silent_ms, remember_ms) has batches without data, as its timers fire in them; so under the trigger `availableNow` it
doesn't end, unless `spark.sql.streaming.noDataMicroBatches.enabled` is false.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import logs as L
from ..operators.packing import Filler

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rocksdb_store(spark: SparkSession) -> None:
    """Sets the state store that states of several columns need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class _Packing(StatefulProcessor):
    """A Filler for each rank: its buffer is list state, its counters value state, the flush a timer of processing time."""

    def __init__(self, capacity: int, buffer: int, crop: bool, flush_ms: int | None) -> None:
        self.make = lambda: Filler(capacity, buffer, crop)
        self.flush_ms = flush_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "n long, arrival long, doc long")
        self.counters = handle.getValueState("counters", "arrival long, row long, left long")

    def _load(self) -> Filler:
        filler = self.make()
        if self.counters.exists():
            filler.arrival, filler.row, filler.left = self.counters.get()
        filler.held = sorted(tuple(x) for x in self.held.get()) if self.held.exists() else []
        return filler

    def _save(self, filler: Filler) -> None:
        if filler.held:
            self.held.put(filler.held)
        else:
            self.held.clear()
        self.counters.update((filler.arrival, filler.row, filler.left))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        filler = self._load()
        out = []
        for seq, doc, n in sorted((r["seq"], r["doc"], r["n"]) for r in rows):
            out += filler.add(doc, n) if n is not None else filler.drain()
        self._save(filler)
        if self.flush_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if filler.held:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.flush_ms)
        return iter([Row(rank=key[0], row=r, doc=d, used=u, lost=x) for r, d, u, x in out])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        filler = self._load()
        out = list(filler.drain())
        self._save(filler)
        return iter([Row(rank=key[0], row=r, doc=d, used=u, lost=x) for r, d, u, x in out])

    def close(self) -> None:
        pass


def pack_stream(docs: DataFrame, capacity: int, buffer: int = 1000, crop: bool = True, flush_ms: int | None = None) -> DataFrame:
    """A stream (rank, row, doc, used, lost) of a stream (rank, seq, doc, n): each rank packs its documents as they come.

    Piece for piece what `packing.fill` gives for all documents of a rank in the order of seq, however they fall into
    batches, as long as a batch's seq are greater than those before. A row whose n is null ends the rank's documents: the
    buffer is emptied and the next document begins behind it. So does a rank without documents for flush_ms, if given.
    Nulls in seq come first; documents of no tokens are left out. State: the buffer, fewer rows than `buffer`, and three numbers a rank.
    """
    d = docs.where("n IS NULL OR n > 0").select(F.col("rank").cast("int").alias("rank"), F.col("seq").cast("long").alias("seq"), F.col("doc").cast("long").alias("doc"), F.col("n").cast("long").alias("n"))
    processor = _Packing(capacity, buffer, crop, flush_ms)
    return d.groupBy("rank").transformWithState(processor, "rank int, row long, doc long, used long, lost long", "append", "None" if flush_ms is None else "ProcessingTime")


class _Watch(StatefulProcessor):
    """Lines seen of each file that hasn't ended; after its word only, for a while, that it was told."""

    def __init__(self, silent_ms: int | None, remember_ms: int | None) -> None:
        self.silent_ms, self.remember_ms = silent_ms, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = handle.getValueState("lines", "lines long")
        self.told = handle.getValueState("told", "told boolean", self.remember_ms) if self.remember_ms else None

    def _end(self, key, state: str, lines: int) -> Iterator[Row]:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.lines.clear()
        if self.told is not None:
            self.told.update((True,))
        return iter([Row(file=key[0], state=state, lines=lines)])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        if self.told is not None and self.told.exists():
            return iter([])
        lines, best = (self.lines.get()[0] if self.lines.exists() else 0), None
        for r in rows:
            lines += 1
            if r["place"] is not None and (best is None or r["place"] < best[0]):
                best = (r["place"], r["mark"])
        if best is not None:
            return self._end(key, best[1], lines)
        self.lines.update((lines,))
        if self.silent_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silent_ms)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        return self._end(key, "silent", self.lines.get()[0] if self.lines.exists() else 0)

    def close(self) -> None:
        pass


def watch(lines: DataFrame, marks: dict[str, str], order: tuple[str, ...] = L.FINISH_ORDER, silent_ms: int | None = None, remember_ms: int | None = None) -> DataFrame:
    """A stream (file, state, lines) of a stream (file, line): one row a file, when a line matches one of marks (name -> pattern).

    Of several marks in a batch the first in order wins; lines may come in any order. A file without a line for silent_ms
    speaks with the state `silent`. Once it has spoken a file's state is removed; for remember_ms, if given, it stays
    known that it spoke, and lines that come late are passed over; later ones begin anew.
    """
    named = [k for k in order if k in marks]
    hits = [F.when(F.col("line").rlike(marks[k]), F.struct(F.lit(i).alias("place"), F.lit(k).alias("mark"))) for i, k in enumerate(named)]
    d = lines.withColumn("hit_", F.coalesce(*hits)).select("file", F.col("hit_.place").alias("place"), F.col("hit_.mark").alias("mark"))
    return d.groupBy("file").transformWithState(_Watch(silent_ms, remember_ms), "file string, state string, lines long", "append", "None" if silent_ms is None and remember_ms is None else "ProcessingTime")
