"""A byte-level convolutional network in numpy, for the quality of whole texts.

Learned filters slide over the bytes of a text. The text is covered by overlapping chunks; in each chunk every
filter keeps its largest answer, and mean and maximum of the chunks' answers give one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, text_slices, tidy

EMBED, WIDTH, FILTERS = 8, 6, 16
BLOCK = 64
CHUNK_BLOCKS, STRIDE_BLOCKS = 8, 7
#: Bytes of a text that the filters slide over at once.
PIECE = 512 * BLOCK
#: Labelled rows of each class that the network learns from, with their whole texts: the bound on what the driver gets.
TRAIN_ROWS = 2000
STEPS, BATCH, RATE = 400, 64, 0.01
#: Share of the learning steps' texts that are cut to a short stretch, so that short texts aren't taken for poor ones.
SHORT = 0.35
#: Labels are learned from rows whose crc32 of the id's text leaves another remainder than this.
FOLDS, HELD_OUT = 3, 1
SEED = 5


def held_out(id_col, folds: int = FOLDS, fold: int = HELD_OUT):
    """Whether a row's labels stay unseen. A null id's text is empty."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


class Sample(NamedTuple):
    """Labelled rows as (text, label), and for each class how many learnable rows the table has for one of them."""

    rows: list[tuple[str, int]]
    weight: dict[int, float]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, rows: int, seed: int, id_col: str = "doc_id", text_col: str = "text") -> Sample:
    """At most `rows` learnable rows of each class, those of the least hashes, with their whole texts.

    The sample is chosen from ids and labels alone, and texts are fetched for the chosen ids only, which go to every
    executor: 2 * rows of them at most. Ids of no document and repeated rows do no harm.
    """
    ids = docs.select(F.col(id_col).alias("i_"))
    known = labels.select(F.col("doc_id").alias("i_"), F.col(label).cast("int").alias("y_")).where(F.col("y_").isin(0, 1) & F.col("i_").isNotNull() & ~held_out(F.col("i_"), folds, fold))
    known = cut(known.join(ids, "i_", "left_semi").distinct().withColumn("h_", F.xxhash64("i_", F.lit(seed))))
    total = {r["y_"]: r["count"] for r in known.groupBy("y_").count().collect()}  # two rows at most
    chosen = known.where("y_ = 0").orderBy("h_", "i_").limit(rows).union(known.where("y_ = 1").orderBy("h_", "i_").limit(rows))
    got = docs.select(F.col(id_col).alias("i_"), F.coalesce(F.col(text_col), F.lit("")).alias("t_"))
    got = got.join(F.broadcast(chosen), "i_").groupBy("i_", "y_").agg(F.min("t_").alias("t_"), F.min("h_").alias("h_"))
    out = [(r["t_"], r["y_"]) for r in got.orderBy("h_", "i_").collect()]
    return Sample(out, {y: n / max(1, sum(1 for _, v in out if v == y)) for y, n in total.items()})


class ByteCNN:
    """The network. Texts are padded with zero bytes to whole blocks, in learning as in scoring."""

    def __init__(self, seed: int = SEED) -> None:
        r = np.random.default_rng(seed)
        self.p = {
            "embed": r.normal(0, 0.5, (256, EMBED)),
            "conv": r.normal(0, (2 / (WIDTH * EMBED)) ** 0.5, (WIDTH * EMBED, FILTERS)),
            "bias": np.zeros(FILTERS),
            "mean": r.normal(0, 0.2, FILTERS),
            "most": r.normal(0, 0.2, FILTERS),
            "short": np.zeros(1),  # of a text that doesn't fill one chunk
            "b": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    @staticmethod
    def _blocks(text: str | None) -> np.ndarray:
        raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
        out = np.zeros(max(1, -(-len(raw) // BLOCK)) * BLOCK, np.uint8)
        out[: len(raw)] = raw
        return out

    @staticmethod
    def _short(blocks: np.ndarray) -> np.ndarray:
        return (1 - np.minimum(blocks, CHUNK_BLOCKS) / CHUNK_BLOCKS).astype(np.float32)

    def _windows(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first block, block after the last) of the chunks that cover texts of so many blocks, laid end to end."""
        first = np.cumsum(blocks) - blocks
        chunks = np.maximum(1, -(-(blocks - CHUNK_BLOCKS) // STRIDE_BLOCKS) + 1)
        owner = np.repeat(np.arange(len(blocks)), chunks)
        start = first[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)) * STRIDE_BLOCKS
        return owner, start, np.minimum(start + CHUNK_BLOCKS, (first + blocks)[owner])

    def _answers(self, raw: list[np.ndarray]) -> Iterator[np.ndarray]:
        """Every filter's answer at every byte of the texts, in pieces of at most PIECE bytes."""
        p, tail = self.p, np.zeros(WIDTH - 1, np.uint8)
        look = [np.ascontiguousarray(p["embed"] @ p["conv"][k * EMBED : (k + 1) * EMBED]) for k in range(WIDTH)]
        for b in raw:
            for at in range(0, len(b), PIECE):
                piece = np.concatenate([b[at : at + PIECE + WIDTH - 1], tail])
                n = min(PIECE, len(b) - at)
                a = look[0].take(piece[:n], 0)
                for k in range(1, WIDTH):
                    a += look[k].take(piece[k : n + k], 0)
                yield a

    def fit(self, rows: list[tuple[str, int]], seed: int = SEED) -> ByteCNN:
        """Adam on the logistic loss of whole texts, and of short stretches from anywhere in them; classes weigh the same."""
        r = np.random.default_rng(seed)
        y = np.array([v for _, v in rows], np.float32)
        raw = [self._blocks(t) for t, _ in rows]
        by_class = [np.flatnonzero(y == c) for c in (0, 1)]
        if not all(map(len, by_class)):  # one class only: its rate is all that can be learned
            self.p["b"][:] = 0 if not len(y) else 4 * float(np.sign(y.mean() - 0.5))
            self.p["mean"][:] = self.p["most"][:] = self.p["short"][:] = 0
            return self
        state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        for step in range(1, STEPS + 1):
            pick = np.concatenate([r.choice(c, BATCH // 2) for c in by_class])
            texts = []
            for i in pick:
                piece = raw[i]
                if r.random() < SHORT:
                    n = int(r.integers(1, CHUNK_BLOCKS))
                    at = int(r.integers(0, max(1, len(piece) // BLOCK - n + 1)))
                    piece = piece[at * BLOCK : (at + n) * BLOCK]
                texts.append(piece)
            grad = self._grad(texts, y[pick])
            rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
            for k, g in grad.items():
                m, v = state[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                self.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def _grad(self, texts: list[np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients over whole texts: each chunk's winning byte stretch of each filter is all that they run through."""
        p, n = self.p, len(texts)
        blocks = np.array([len(t) // BLOCK for t in texts])
        owner, start, end = self._windows(blocks)
        tops, spots = [], []
        for a in self._answers(texts):
            a = a.reshape(-1, BLOCK, FILTERS)
            spots.append(a.argmax(1))
            tops.append(np.take_along_axis(a, spots[-1][:, None, :], 1)[:, 0])
        tops, spots = np.concatenate(tops), np.concatenate(spots)
        at = np.minimum(start[:, None] + np.arange(CHUNK_BLOCKS), end[:, None] - 1)  # chunk, block
        best = np.take_along_axis(at, tops[at].argmax(1), 1)  # chunk, filter: block of the winner
        filters = np.arange(FILTERS)
        where = best * BLOCK + spots[best, filters]
        h = np.maximum(tops[best, filters] + p["bias"], 0)
        doc = np.searchsorted(owner, np.arange(n))
        chunks = np.diff(np.append(doc, len(owner))).astype(np.float32)
        mean, most = np.add.reduceat(h, doc) / chunks[:, None], np.maximum.reduceat(h, doc)
        top = np.stack([a + h[a:b].argmax(0) for a, b in zip(doc, np.append(doc[1:], len(owner)), strict=True)])
        short = self._short(blocks)
        z = mean @ p["mean"] + most @ p["most"] + short * p["short"][0] + p["b"][0]
        d = (1 / (1 + np.exp(-z)) - y) / n
        dh = (d / chunks)[owner][:, None] * p["mean"]
        dh[top, filters] += d[:, None] * p["most"]
        dh = (dh * (h > 0)).astype(np.float32)
        out = {"mean": mean.T @ d + 1e-4 * p["mean"], "most": most.T @ d + 1e-4 * p["most"], "short": np.array([d @ short]), "b": np.array([d.sum()]), "bias": dh.sum(0)}
        out["conv"], out["embed"] = np.zeros((WIDTH * EMBED, FILTERS)), np.zeros((256, EMBED))
        line = np.concatenate([*texts, np.zeros(WIDTH - 1, np.uint8)])
        last = (np.cumsum(blocks) * BLOCK)[owner][:, None, None]  # bytes after a text count as zero bytes
        for k in range(0, len(owner), 4096):
            w = where[k : k + 4096, :, None] + np.arange(WIDTH)
            seen = np.where(w < last[k : k + 4096], line[w], 0)  # chunk, filter, place
            g = dh[k : k + 4096]
            out["conv"] += np.einsum("cfw,cf->wf", p["embed"][seen].reshape(*seen.shape[:2], -1), g)
            back = np.einsum("wf,cf->cfw", p["conv"], g).reshape(-1, EMBED)
            out["embed"] += np.stack([np.bincount(seen.reshape(-1), back[:, j], 256) for j in range(EMBED)], 1)
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        """The probability of label 1 for each whole text."""
        p = self.p
        raw = [self._blocks(t) for t in texts]
        blocks = np.array([len(b) // BLOCK for b in raw])
        tops = np.concatenate([*(a.reshape(-1, BLOCK, FILTERS).max(1) for a in self._answers(raw)), np.zeros((1, FILTERS), np.float32)])
        owner, start, end = self._windows(blocks)
        h = np.maximum(np.maximum.reduceat(tops, np.stack([start, end], 1).ravel())[::2] + p["bias"], 0)
        doc = np.searchsorted(owner, np.arange(len(raw)))
        mean, most = np.add.reduceat(h, doc) / np.diff(np.append(doc, len(owner)))[:, None], np.maximum.reduceat(h, doc)
        return 1 / (1 + np.exp(-(mean @ p["mean"] + most @ p["most"] + self._short(blocks) * p["short"][0] + p["b"][0]).astype(np.float64)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> ByteCNN:
    return ByteCNN().fit(labelled_sample(docs, labels, "quality", FOLDS, HELD_OUT, TRAIN_ROWS, SEED, id_col, text_col).rows)


def scored(docs: DataFrame, score, width: int = 2 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each row by score(texts) in Arrow batches, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in text_slices(batch, width):
                yield pa.RecordBatch.from_arrays([ids, pa.array(score(texts), pa.float64())], ["doc_id", "score"])

    rows = bounded_batches(docs).select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(tidy(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def with_scores(docs: DataFrame, score, name: str, text_col: str = "text") -> DataFrame:
    """docs with all of its columns and the score of each row's text under a new name, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            done = 0
            for part, texts in text_slices(batch.select([at, at])):
                rows = batch.slice(done, len(part))
                done += len(part)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(score(texts), pa.float64())], names=[*rows.schema.names, name])

    from pyspark.sql import types as T

    return bounded_batches(docs).mapInArrow(tidy(run), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted (1 if score >= 0.5).

    Only the text enters a score. Null and empty texts are scored as one block of zero bytes. Null ids pass through,
    repeated rows are scored each, other columns aren't read; an empty table gives an empty result. Without labels
    of both classes all scores are alike. The model is a few thousand numbers and goes along with the task.
    """
    model = train(docs, labels, id_col, text_col)
    s = scored(docs, model.score, id_col=id_col, text_col=text_col)
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
