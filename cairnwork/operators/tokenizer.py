"""Byte-level BPE: training on pre-token counts, encoding and decoding in Arrow batches, token sizes."""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import pretokens
from ..functions.values import SPECIAL_TOKENS, SPLIT_PATTERN
from .ranks import cut

#: Merges that tasks replay on a word each round; after so many the words are written anew as they stand.
PENDING = 256


def apply_merges(symbols: list[bytes], merges: list[tuple[bytes, bytes]]) -> list[bytes]:
    """symbols after each merge in turn, from left to right."""
    word = b"".join(symbols)
    for a, b in merges:
        if len(symbols) < 2:
            break
        if a + b not in word:
            continue
        new, k = [], 0
        while k < len(symbols):
            if k + 1 < len(symbols) and symbols[k] == a and symbols[k + 1] == b:
                new.append(a + b)
                k += 2
            else:
                new.append(symbols[k])
                k += 1
        symbols = new
    return symbols


def next_merges(pairs: dict[tuple[bytes, bytes], int], known: set[bytes], most: int) -> list[tuple[bytes, bytes]]:
    """The next merges, as many as are certain from the counts of pairs; known takes their symbols.

    The most frequent pair is certain, ties going to the greater pair. Each pair that merges bring about lies where a
    pair lay that starts with a merge's second symbol or ends with its first, so it is at most as frequent. While the
    next pair is more frequent than all of those, its own count hasn't changed and it comes next. A pair of equal
    symbols, or one that makes a known symbol again, can add to counts otherwise: nothing after it is certain.
    """
    starts, ends = defaultdict(int), defaultdict(int)
    for (a, b), n in pairs.items():
        starts[a] = max(starts[a], n)
        ends[b] = max(ends[b], n)
    out, bound = [], 0
    for n, (a, b) in heapq.nlargest(min(most, len(pairs)), ((n, p) for p, n in pairs.items())):
        if n <= bound:
            break
        out.append((a, b))
        if a == b or a + b in known:
            break
        known.add(a + b)
        bound = max(bound, starts[b], ends[a])
    return out


def _pair_counts(words: DataFrame, pending: list[tuple[bytes, bytes]], new: list[tuple[bytes, bytes]]) -> Counter:
    """Counts of pairs that the new merges add, those that they take away below 0; without new merges, all counts."""

    def count(batches):
        sums: Counter = Counter()
        for batch in batches:
            for symbols, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                old = apply_merges(symbols, pending)
                if new:
                    for p in zip(old, old[1:], strict=False):
                        sums[p] -= n
                    old = apply_merges(old, new)
                for p in zip(old, old[1:], strict=False):
                    sums[p] += n
        rows = [(a, b, n) for (a, b), n in sums.items() if n]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], ["a", "b", "n"])

    if new:
        # The other words have no such pair.
        words = words.where(reduce(Column.__or__, [F.contains("word", F.lit(a + b)) for a, b in new]))
    found = words.select("symbols", "n").mapInArrow(count, "a binary, b binary, n long")
    return Counter({(bytes(r["a"]), bytes(r["b"])): r["n"] for r in found.groupBy("a", "b").agg(F.sum("n").alias("n")).collect()})


def _rewritten(words: DataFrame, merges: list[tuple[bytes, bytes]]) -> DataFrame:
    """words with their symbols after the merges, cut to the shared folder."""

    def run(batches):
        for batch in batches:
            symbols = pa.array([apply_merges(s, merges) for s in batch.column(0).to_pylist()], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([symbols, batch.column(1), batch.column(2)], ["symbols", "n", "word"])

    return cut(words.mapInArrow(run, "symbols array<binary>, n long, word binary"))


def train(docs: DataFrame, vocabulary: int, text: str = "text", pending: int = PENDING) -> list[tuple[bytes, bytes]]:
    """Merges in order, from the counts of all distinct pre-tokens.

    The pre-tokens stay distributed, written once; each round adds up in Spark what the last merges changed in the
    counts of pairs. The driver holds the table of pairs alone, which grows with the symbols and not with the corpus.
    """
    counts = docs.select(F.explode(pretokens(F.col(text))).alias("t")).groupBy("t").agg(F.count("*").alias("n"))

    def in_bytes(batches):
        for batch in batches:
            words = [t.encode() for t in batch.column(0).to_pylist()]
            symbols = pa.array([[w[k : k + 1] for k in range(len(w))] for w in words], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([symbols, batch.column(1), pa.array(words, pa.binary())], ["symbols", "n", "word"])

    words = cut(counts.where("t IS NOT NULL").mapInArrow(in_bytes, "symbols array<binary>, n long, word binary"))
    pairs = _pair_counts(words, [], [])
    most, known = vocabulary - 256 - len(SPECIAL_TOKENS), {bytes([b]) for b in range(256)}
    merges: list[tuple[bytes, bytes]] = []
    done = 0
    while len(merges) < most and pairs:
        new = next_merges(pairs, known, most - len(merges))
        if len(merges) + len(new) < most:
            for p, n in _pair_counts(words, merges[done:], new).items():
                pairs[p] += n
                if pairs[p] <= 0:
                    del pairs[p]
        merges += new
        if len(merges) - done >= pending:
            words, done = _rewritten(words, merges[done:]), len(merges)
    return merges


class Tokenizer:
    """Ids: 256 bytes, merges in order, then special tokens."""

    def __init__(self, merges: list[tuple[bytes, bytes]]) -> None:
        import tiktoken

        ranks = {bytes([b]): b for b in range(256)} | {a + b: 256 + k for k, (a, b) in enumerate(merges)}
        self.special = {s: len(ranks) + k for k, s in enumerate(SPECIAL_TOKENS)}
        self.own = tiktoken.Encoding("own", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.sizes = [0] * (len(ranks) + len(self.special))
        for t, k in ranks.items():
            self.sizes[k] = len(t)

    def encode(self, text: str, prepend: str | None = None, append: str | None = None) -> list[int]:
        ids = self.own.encode_ordinary(text)
        return [*([self.special[prepend]] if prepend else []), *ids, *([self.special[append]] if append else [])]

    def decode(self, ids: list[int]) -> str:
        return self.own.decode(ids)


def _each(kind: str, merges: list[tuple[bytes, bytes]], column: Column, work) -> Column:
    """work(tokenizer, value) of each value that isn't null; a task makes the tokenizer once."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = Tokenizer(merges)
        for s in batches:
            yield s.map(lambda x: None if x is None else work(t, x))

    return run(column)


def encode_column(merges: list[tuple[bytes, bytes]], text: Column, prepend: str | None = None, append: str | None = None) -> Column:
    return _each("array<int>", merges, text, lambda t, x: t.encode(x, prepend, append))


def decode_column(merges: list[tuple[bytes, bytes]], ids: Column) -> Column:
    return _each("string", merges, ids, lambda t, x: t.decode([int(i) for i in x]))


def token_bytes(spark, merges: list[tuple[bytes, bytes]]) -> DataFrame:
    """(token_id, n_bytes), 0 for special tokens."""
    return spark.createDataFrame(list(enumerate(Tokenizer(merges).sizes)), "token_id int, n_bytes int")
