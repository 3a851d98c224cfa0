"""Packing token sequences by non-negative least squares over the histogram of lengths.

Every document is cut into whole windows and a remainder. Shallow combinations of remainder lengths that fill a
window exactly are enumerated; their repeat counts are the non-negative least-squares solution against the
histogram of remainders, rounded down to what the histogram has. What is left over is packed greedily end to
end and cut at window ends, and the last window's rest falls into powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bpe
from .common import bounded_batches, cut, text_slices, tidy
from .tokens import TOKENIZER, tokenizer_path

WINDOW = 1024
#: Triples tried for each shortest length.
TRIPLES = 16
SWEEPS = 60
#: Rows of the table of ranks up to which it goes to every executor; beyond, it meets the documents in a shuffle.
BROADCAST_ROWS = 100_000


def combinations(hist: list[int], window: int = WINDOW, triples: int = TRIPLES) -> list[tuple[int, ...]]:
    """Pairs and triples of lengths with documents (hist[length] > 0) whose sum is the window.

    All pairs; of triples, for each shortest length, at most `triples` spread evenly over its choices.
    """
    have = [n for n in range(1, window) if hist[n]]
    out: list[tuple[int, ...]] = [(a, window - a) for a in have if 2 * a <= window and hist[window - a]]
    for a in have:
        if 3 * a > window:
            break
        fit = [b for b in have if a <= b <= window - a - b and hist[window - a - b]]
        step = max(1, -(-len(fit) // triples))
        out += [(a, b, window - a - b) for b in fit[a % step :: step]]
    return out


def solve(hist: list[int], combos: list[tuple[int, ...]], sweeps: int = SWEEPS) -> list[int]:
    """Whole repeat counts: min |A x - hist| over x >= 0 by coordinate descent, rounded down and held to hist.

    A column of A has how often a combination has each length. Columns have two or three entries, so a step
    costs as much, and a sweep is linear in the number of combinations.
    """
    columns = [sorted({n: c.count(n) for n in c}.items()) for c in combos]
    norms = [sum(k * k for _, k in col) for col in columns]
    x, rest = [0.0] * len(combos), [float(v) for v in hist]
    for _ in range(sweeps):
        moved = 0.0
        for j, col in enumerate(columns):
            step = max(-x[j], sum(k * rest[n] for n, k in col) / norms[j])
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for n, k in col:
                    rest[n] -= k * step
        if moved < 0.25:
            break
    left, out = list(hist), []
    for xj, col in sorted(zip(x, range(len(x)), strict=True), reverse=True):
        n = min(int(xj + 1e-9), *(left[m] // k for m, k in columns[col]))
        out.append((col, n))
        for m, k in columns[col]:
            left[m] -= k * n
    return [n for _, n in sorted(out)]


class Plan:
    """Where the r-th remainder of each length goes; of a size that the window bounds, not the input."""

    def __init__(self, hist: list[int], window: int = WINDOW) -> None:
        self.window = window
        combos = combinations(hist, window)
        runs: list[list[tuple[int, int, int]]] = [[] for _ in range(window)]  # rank from, sequence, offset
        used = [0] * window
        sequence = 0
        for combo, n in zip(combos, solve(hist, combos), strict=True):
            offset = 0
            for length in combo if n else ():
                runs[length].append((used[length], sequence, offset))
                used[length] += n
                offset += length
            sequence += n
        self.filled = sequence
        self.used = np.array(used)
        self.rank_from = [np.array([r[0] for r in x], np.int64) for x in runs]
        self.sequence = [np.array([r[1] for r in x], np.int64) for x in runs]
        self.offset = [np.array([r[2] for r in x], np.int64) for x in runs]
        left = np.array(hist[:window], np.int64) - self.used
        sizes = left * np.arange(window)
        self.rest_from = np.concatenate([[0], np.cumsum(sizes)[:-1]])  # first residual token of each length
        self.residual = int(sizes.sum())
        # Ends of residual sequences: whole windows, then powers of two.
        self.whole = self.residual // window
        tail, at, ends = self.residual % window, self.whole * window, []
        for bit in reversed(range(window.bit_length())):
            if tail >> bit & 1:
                at += 1 << bit
                ends.append(at)
        self.tail_ends = ends
        self.sequences = self.filled + self.whole + len(ends)

    def place(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of the pieces of the remainder with this rank among its length."""
        if rank < self.used[length]:
            k = int(np.searchsorted(self.rank_from[length], rank, side="right")) - 1
            return [(0, length, int(self.sequence[length][k] + rank - self.rank_from[length][k]), int(self.offset[length][k]))]
        at = int(self.rest_from[length] + (rank - self.used[length]) * length)
        out, start, end = [], 0, at + length
        while at < end:
            if at < self.whole * self.window:
                nth, begin = divmod(at, self.window)[0], at // self.window * self.window
                stop = begin + self.window
            else:
                nth = next(k for k, e in enumerate(self.tail_ends) if at < e)
                begin = self.tail_ends[nth - 1] if nth else self.whole * self.window
                stop, nth = self.tail_ends[nth], self.whole + nth
            n = min(end, stop) - at
            out.append((start, n, self.filled + nth, at - begin))
            at, start = at + n, start + n
        return out


def tokenized(docs: DataFrame, tokenizer: str = TOKENIZER, window: int = WINDOW, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, part, nth, rest, whole, before, ids): each document's ids and end_id, as bytes, written and read back.

    part: the task; whole: whole windows; rest: tokens beyond them; nth: how many documents of the task before it
    have the same rest; before: whole windows of the task before it. ids: little-endian, of two bytes if the vocabulary fits them, else of four.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.load(tokenizer_path(tokenizer), native=True)
        part, seen, windows = TaskContext.get().partitionId(), np.zeros(window, np.int64), 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for ids, texts in text_slices(batch):
                raw = [np.frombuffer(b + end, "<u4") for b in encoder.encode(texts)]
                rest = [len(r) % window for r in raw]
                nth = []
                for n in rest:
                    nth.append(int(seen[n]))
                    seen[n] += 1
                whole = np.array([len(r) // window for r in raw], np.int64)
                before = windows + np.cumsum(whole) - whole
                windows += int(whole.sum())
                kinds = [r.astype("<u2").tobytes() if encoder.short else r.tobytes() for r in raw]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([part] * len(raw), pa.int32()), pa.array(nth, pa.int64()), pa.array(rest, pa.int32()), pa.array(whole), pa.array(before), pa.array(kinds, pa.binary()), pa.array([encoder.short] * len(raw))],
                    ["doc_id", "part", "nth", "rest", "whole", "before", "ids", "short"],
                )

    rows = bounded_batches(docs).select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return cut(rows.mapInArrow(tidy(encode), f"doc_id {kind}, part int, nth long, rest int, whole long, before long, ids binary, short boolean"))


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, window: int = WINDOW, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Each document's ids, end_id included, lie in exactly one piece each; pieces of a sequence lie end to end from
    offset 0; every sequence has `window` tokens or a power of two, so nothing is padded. Null and empty texts are
    end_id alone. Repeated rows and ids are documents of their own; other columns aren't read; an empty table
    gives an empty result. Only counts by (task, length) are shuffled: a length that a third of all documents share
    is ranked inside each task, and its tasks' starts are summed over one row a task. The driver gets one number for
    each length below the window.
    """
    rows = tokenized(docs, tokenizer, window, end_id, id_col, text_col)
    counts = cut(rows.groupBy("rest", "part").agg(F.count("*").alias("n"), F.sum("whole").alias("whole")))
    hist = [0] * window
    for r in counts.where("rest > 0").groupBy("rest").agg(F.sum("n").alias("n")).collect():  # below `window` rows
        hist[r["rest"]] = r["n"]
    plan = Plan(hist, window)
    of_rest = W.partitionBy("rest").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    of_part = W.orderBy("q_").rowsBetween(W.unboundedPreceding, -1)  # a row for each task
    parts = counts.groupBy(F.col("part").alias("q_")).agg(F.sum("whole").alias("w_")).select("q_", F.coalesce(F.sum("w_").over(of_part), F.lit(0)).alias("first_window"))
    starts = counts.select(F.col("rest").alias("r_"), F.col("part").alias("p_"), F.coalesce(F.sum("n").over(of_rest), F.lit(0)).alias("base"))
    starts = starts.join(parts, F.col("p_") == F.col("q_")).drop("q_")
    if counts.count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    ranked = rows.join(starts, (F.col("rest") == F.col("r_")) & (F.col("part") == F.col("p_")))
    ranked = ranked.select("doc_id", (plan.sequences + F.col("first_window") + F.col("before")).alias("base"), "rest", (F.col("base") + F.col("nth")).alias("rank"), "ids", "short")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {n: batch.column(k).to_pylist() for k, n in enumerate(batch.schema.names) if n != "doc_id"}
            at, start, length, ids, total, sequence, offset = [], [], [], [], [], [], []
            size = 0
            for k, raw in enumerate(cols["ids"]):
                own = np.frombuffer(raw, "<u2" if cols["short"][k] else "<u4").astype("<u4")
                whole = len(own) // window
                pieces = [(w * window, window, cols["base"][k] + w, 0) for w in range(whole)]
                if rest := cols["rest"][k]:
                    pieces += [(whole * window + a, n, s, o) for a, n, s, o in plan.place(rest, cols["rank"][k])]
                for a, n, s, o in pieces:
                    at.append(k)
                    start.append(a)
                    length.append(n)
                    ids.append(own[a : a + n].tobytes())
                    total.append(len(own))
                    sequence.append(s)
                    offset.append(o)
                size += 4 * len(own)
                if size > 8 << 20 or k == len(cols["ids"]) - 1:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(at, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64()), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                        ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                    )
                    at, start, length, ids, total, sequence, offset, size = [], [], [], [], [], [], [], 0

    kind = rows.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(tidy(place), f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
