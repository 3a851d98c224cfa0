"""Token ids in binary files by canonical Huffman codes of bounded length, made from the counts of the whole corpus.

The files are two tables in a folder: `codebook` (id, bits) and `streams`, whose rows lie in the order of documents. A stream
is a run of whole documents: blocks of ids that don't depend on each other, with a checkpoint for each. So all blocks of a
stream are decoded side by side, one table lookup an id, and a reader of a few documents starts at the checkpoint before them.

Layout of a stream, little-endian: `CHF1`, ids in a block and longest code (unsigned 16 bits each), ids and blocks (unsigned
64 bits each); for each block its first bit (unsigned 64); then the bits, the highest of a byte first, and 8 bytes of zeros.
Codes are canonical: in the order of (bits, id) each is the one before plus one, lengthened by zeros.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import byte_symbols
from .common import bounded_batches, checkpoint_folder, cut, tidy
from .tokens import tokenizer_path

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
#: Longest code; the decoder's table has two to that power entries. Vocabularies that need more get more.
LONGEST = 17
#: Ids in a block; ids of a stream of several documents at most; ids whose bits are laid at once.
BLOCK, STREAM, AT_ONCE = 256, 1 << 20, 1 << 18
#: Words that a worker remembers, and the longest of them.
REMEMBER, LONG = 1_000_000, 64
#: Bytes of text that are encoded at once.
TEXT_BYTES = 16 << 20
HEADER = struct.Struct("<4sHHQQ")
MAGIC = b"CHF1"


#: The word that marks a text's end: no other has a line end.
END = " \n"
#: Small letters that the tokenizer leaves as they are and takes for letters; words of them are one pre-token each.
LETTERS = "a-zà-öø-ÿ"


class WordEncoder:
    """Ids of whole texts by the tokenizers library.

    The tokenizer never joins characters across a space or a line end: its rule drops white space between tokens, its
    normal form composes nothing with a space, and its special strings have none. So a text's ids are those of its
    words, one after the other, and a word seen before is looked up. Capitals are made small and a stop behind a
    letter is parted from it beforehand, as the tokenizer does with both, so that fewer words differ. A word of small
    letters needs no normal form and goes to the library's model at once.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if max(self.library.get_vocab().values()) < 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {"": b""}
        signs = {b: c for c, b in byte_symbols().items()}
        self.signs = {ord(c): "".join(signs[b] for b in c.encode()) for c in map(chr, range(0x100)) if re.match(f"[{LETTERS}]", c)}

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each with `end` behind it, and their numbers of ids."""
        low, special = pc.ascii_lower(texts), pc.match_substring(texts, "<|")  # a special string is one only in small letters
        if pc.any(special).as_py():
            low = pc.if_else(special, texts, low)
        low = pc.binary_join_element_wise(pc.replace_substring(low, "\n", " "), *(pa.scalar(x, pa.large_string()) for x in (END, "")))
        words = pc.split_pattern(pc.replace_substring_regex(low, f"([{LETTERS}])([.,;:!?]) ", r"\1 \2 "), " ")
        coded = words.flatten().dictionary_encode()
        entries = self._entries(coded.dictionary.to_pylist(), np.array([end], self.kind).tobytes())
        size = np.fromiter(map(len, entries), np.int32, len(entries)) // self.kind.itemsize
        at = coded.indices.to_numpy(zero_copy_only=False)
        n = size[at]
        stop = np.cumsum(n)  # a slice's ids are far fewer than 2 ** 31
        place = np.repeat((np.cumsum(size, dtype=np.int32) - size)[at] - (stop - n).astype(np.int32), n)
        place += np.arange(len(place), dtype=np.int32)
        ends = stop[np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False)) - 1]
        return np.frombuffer(b"".join(entries), self.kind)[place], np.diff(ends, prepend=0)

    def _entries(self, words: list[str], end: bytes) -> list[bytes]:
        """The ids of distinct words; the end's mark gives the end."""
        known = self.known
        known[END[1:]] = end
        out = [known.get(w) for w in words]
        new = [k for k, b in enumerate(out) if b is None]
        signs, model, code, odd = self.signs, self.library.model.tokenize, "H" if self.kind.itemsize == 2 else "I", []
        for k in new:
            w = words[k]
            if _PLAIN(w):
                known[w] = out[k] = array(code, [t.id for t in model(w.translate(signs))]).tobytes()
            else:
                odd.append(k)
        for k, e in zip(odd, self.library.encode_batch_fast([words[k] for k in odd], add_special_tokens=False), strict=True):
            out[k] = array(code, e.ids).tobytes()
            if len(words[k]) <= LONG:
                known[words[k]] = out[k]
        if len(known) > REMEMBER:
            self.known = {"": b""}
        return out


_PLAIN = re.compile(f"[{LETTERS}]{{1,{LONG}}}").fullmatch


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One for each file and worker process."""
    return WordEncoder(path)


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Bits of each symbol's code, none above `longest` (or what so many symbols need), of the least sum of counts * bits.

    Package-merge by levels: a level is the counts merged with the pairs of the level below. The cheapest 2 n - 2 items
    of the last level are taken; the packages among them take twice as many of the level below, and so on. A symbol
    without a count has 0 bits, a single symbol 1.
    """
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    used = used[np.argsort(counts[used], kind="stable")]
    if len(used) < 2:
        out[used] = 1
        return out
    weights = counts[used].astype(np.float64)
    longest = max(longest, int(len(used) - 1).bit_length())
    level, own = weights, [np.ones(len(used), bool)]
    for _ in range(longest - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weights, pairs])
        order = np.argsort(both, kind="stable")
        level = both[order]
        own.append(order < len(weights))
    take = 2 * len(used) - 2
    for mine in reversed(own):
        n = int(mine[:take].sum())
        out[used[:n]] += 1
        take = 2 * (take - n)
    return out


class Codebook:
    """Canonical codes by their lengths, and the decoder's table of all windows of `longest` bits."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits, self.longest = bits.astype(np.uint64), int(bits.max(initial=1))
        used = np.flatnonzero(bits)
        used = used[np.lexsort((used, bits[used]))]
        span = np.left_shift(np.int64(1), self.longest - bits[used])
        first = np.cumsum(span) - span  # of the windows that begin with the code
        self.codes = np.zeros(len(bits), np.uint64)
        self.codes[used] = first >> (self.longest - bits[used])
        windows = np.repeat(used << 5 | bits[used], span)  # id and length
        rest = (1 << self.longest) - len(windows)  # one symbol alone leaves windows that nothing makes
        self.windows = np.append(windows, np.ones(rest, np.int64)).astype(np.uint32)

    def _bits(self, ids: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
        """(words, first bit of each block) of some ids."""
        n, code = self.bits[ids].astype(np.int64), self.codes[ids]
        start = np.cumsum(n)
        words = np.zeros((int(start[-1]) + 63) // 64, np.uint64)
        start -= n
        word, room = start >> 6, 64 - (start & 63) - n  # room: bits free behind the code, below 0 what goes to the next word
        over = np.flatnonzero(room < 0)
        high = np.left_shift(code, np.maximum(room, 0).astype(np.uint64))
        high[over] = code[over] >> (-room[over]).astype(np.uint64)
        firsts = np.flatnonzero(np.diff(word, prepend=-1))  # no code is as long as a word, so every word but the last has a first
        words[: len(firsts)] = np.bitwise_or.reduceat(high, firsts)
        words[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
        return words, start[::block]

    def pack(self, ids: np.ndarray, block: int = BLOCK) -> bytes:
        """A stream of ids."""
        words, checkpoints, size = [], [np.zeros(0, np.int64)], 0
        step = max(1, AT_ONCE // block) * block
        for k in range(0, len(ids), step):
            w, at = self._bits(ids[k : k + step], block)
            words.append(w.astype(">u8").tobytes())
            checkpoints.append(at + size)
            size += 64 * len(w)
        at = np.concatenate(checkpoints)
        return HEADER.pack(MAGIC, block, self.longest, len(ids), len(at)) + at.astype("<u8").tobytes() + b"".join(words) + bytes(8)

    def unpack(self, stream: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids first to last of a stream; only the blocks that hold them are decoded, side by side."""
        magic, block, longest, n, blocks = HEADER.unpack_from(stream)
        if magic != MAGIC or longest != self.longest:
            raise ValueError("not a stream of this codebook")
        last = n if last is None else min(n, last)
        if first >= last:
            return np.zeros(0, np.uint32)
        low, high = first // block, -(-last // block)
        at = np.frombuffer(stream, "<u8", blocks, HEADER.size)[low:high].astype(np.int64)
        body = HEADER.size + 8 * blocks
        begin = int(at[0]) >> 3
        end = int(np.frombuffer(stream, "<u8", 1, HEADER.size + 8 * high)[0]) >> 3 if high < blocks else len(stream) - body - 8
        raw = np.frombuffer(stream, np.uint8, end - begin + 8, body + begin).astype(np.uint32)
        windows = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]  # 32 bits from each byte on
        at -= begin << 3
        out = np.zeros((block, high - low), np.uint32)
        left = 32 - self.longest
        full = n - (high - 1) * block if high == blocks else block  # ids of the last of these blocks
        for k in range(block):
            if k == full:
                at = at[:-1]
            if not len(at):
                break
            found = self.windows[(windows[at >> 3] << (at & 7).astype(np.uint32)) >> left]
            out[k, : len(at)] = found >> 5
            at += found & 31
        return out.T.reshape(-1)[first - low * block : last - low * block]


def written(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, place, doc_id, before, n, ids): documents in order, written to path and read back.

    part: the range of ids; place: the document's place in it; before: ids before it in its part. Equal document ids go by
    their texts. Parts are cut by a sample of ids and checksums, so one id that many rows share is many parts.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer_path(tokenizer))
        part, place, before = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            size = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
            first = 0
            while first < len(size):
                stop = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + TEXT_BYTES)))
                own = batch.slice(first, stop - first)
                flat, n = words.encode(own.column(1).cast(pa.large_string()), end_id)
                total = np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(n), pa.int32()), pa.array(np.arange(place, place + len(n))), own.column(0), pa.array(before + total - n), pa.array(n), _binary(flat, total)],
                    ["part", "place", "doc_id", "before", "n", "ids"],
                )
                first, place, before = stop, place + len(n), before + int(total[-1])

    rows = bounded_batches(docs).select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    order = ["doc_id", F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    rows.mapInArrow(tidy(encode), f"part int, place long, doc_id {kind}, before long, n long, ids binary").write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def _binary(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """ids as one binary value up to each end."""
    at = np.concatenate([[0], ends]).astype(np.int64) * ids.itemsize
    if at[-1] > np.iinfo(np.int32).max:
        raise ValueError("a batch of ids is beyond 2 GB")
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(ids.tobytes())])


def _flat(n: np.ndarray, raw: pa.Array) -> np.ndarray:
    """The ids of a column of binary values, end to end; n: how many each has."""
    at = np.frombuffer(raw.buffers()[1], np.int32, len(raw) + 1, 4 * raw.offset) if len(raw) else np.zeros(1, np.int32)
    data = np.frombuffer(raw.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    return data.view("<u2" if len(data) == 2 * int(n.sum()) else "<u4")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros(0, np.int64)
    for batch in batches:
        own = np.bincount(_flat(batch.column(0).to_numpy(), batch.column(1)), minlength=len(sums))
        own[: len(sums)] += sums
        sums = own
    at = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["id", "n"])


def write(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, longest: int = LONGEST, block: int = BLOCK, stream: int = STREAM, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of all documents, each with end_id behind it, in ascending order of document ids (nulls first).

    path/codebook: (id, bits); path/streams: (start, stop, doc_ids, sizes, stream) with the ids before the stream and up to
    its end. Null and empty texts are end_id alone; repeated rows and ids are documents of their own; other columns
    aren't read; an empty table gives empty files. Whole texts are encoded once and shuffled once. The driver gets a number
    for each id of the vocabulary; the starts of parts are one row for each range of documents.
    """
    spark = docs.sparkSession
    own = f"{path}/parts"
    rows = written(docs, own, tokenizer, end_id, id_col, text_col)
    found = rows.select("n", "ids").mapInArrow(tidy(_counts), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # of the vocabulary's size
    counts = np.zeros(max((r["id"] for r in found), default=0) + 1, np.int64)
    counts[[r["id"] for r in found]] = [r["n"] for r in found]
    bits = code_lengths(counts, longest)
    used = np.flatnonzero(bits)
    spark.createDataFrame(pa.table({"id": used, "bits": bits[used]}), "id long, bits long").coalesce(1).write.parquet(f"{path}/codebook")
    of_part = W.orderBy("p_").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    parts = rows.groupBy(F.col("part").alias("p_")).agg(F.sum("n").alias("n_")).select("p_", F.coalesce(F.sum("n_").over(of_part), F.lit(0)).alias("first_"))
    placed = rows.join(F.broadcast(parts), F.col("part") == F.col("p_")).select("part", "place", (F.col("first_") + F.col("before")).alias("start"), "n", "ids", "doc_id")
    kind = rows.schema["doc_id"].dataType.simpleString()
    small = bits.astype(np.uint8)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook(small.astype(np.int64))
        for batch in batches:
            part, place, start, n = (batch.column(k).to_numpy() for k in range(4))
            ids, end = _flat(n, batch.column(4)), np.cumsum(n)
            breaks = np.flatnonzero((np.diff(part) != 0) | (np.diff(place) != 1)) + 1
            first = 0
            while first < len(n):
                begin = int(end[first - 1]) if first else 0
                stop = max(first + 1, int(np.searchsorted(end, begin + stream, "right")))
                stop = min([stop, *breaks[breaks > first][:1]])
                lists = [pa.ListArray.from_arrays(pa.array([0, stop - first], pa.int32()), c) for c in (batch.column(5).slice(first, stop - first), pa.array(n[first:stop]))]
                data = pa.array([book.pack(ids[begin : end[stop - 1]], block)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(start[first : first + 1]), pa.array(start[stop - 1 : stop] + n[stop - 1]), *lists, data], ["start", "stop", "doc_ids", "sizes", "stream"])
                first = stop

    placed.mapInArrow(tidy(encode), f"start long, stop long, doc_ids array<{kind}>, sizes array<long>, stream binary").write.option("compression", "none").parquet(f"{path}/streams")
    delete(spark, own)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder on whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def read(spark: SparkSession, path: str, first: int = 0, last: int | None = None) -> DataFrame:
    """(doc_id, start, ids) of what write() wrote: documents that start at id number `first` or later and before `last`.

    ids are little-endian unsigned 32-bit numbers, the end's included. Streams outside the range are pruned by their
    numbers in the files; of the others only the blocks that hold such documents are decoded.
    """
    book = {r["id"]: r["bits"] for r in spark.read.parquet(f"{path}/codebook").collect()}  # of the vocabulary's size
    small = np.zeros(max(book, default=0) + 1, np.uint8)
    small[[*book]] = [*book.values()]
    streams = spark.read.parquet(f"{path}/streams").where(F.col("stop") > first)
    if last is not None:
        streams = streams.where(F.col("start") < last)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codebook(small.astype(np.int64))
        for batch in batches:
            for k in range(batch.num_rows):
                start = batch.column(0)[k].as_py()
                size = batch.column(2)[k].values.to_numpy()
                end = np.cumsum(size)
                at = start + end - size
                own = np.flatnonzero((at >= first) & (at < (last if last is not None else end[-1] + start)))
                if len(own):
                    low, high = int(own[0]), int(own[-1]) + 1
                    begin = int(end[low] - size[low])
                    ids = _binary(codes.unpack(batch.column(3)[k].as_py(), begin, int(end[high - 1])).astype("<u4"), end[low:high] - begin)
                    yield pa.RecordBatch.from_arrays([batch.column(1)[k].values.slice(low, high - low), pa.array(at[low:high]), ids], ["doc_id", "start", "ids"])

    kind = streams.schema["doc_ids"].dataType.elementType.simpleString()
    rows = streams.select("start", "doc_ids", "sizes", "stream")  # Arrow batches are bounded by their bytes too
    return rows.mapInArrow(tidy(decode), f"doc_id {kind}, start long, ids binary")


def round_trip(docs: DataFrame, path: str | None = None, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files of all documents, which stay if a path is given."""
    spark = docs.sparkSession
    own = path or f"{checkpoint_folder(spark)}/ids-{uuid.uuid4().hex}"
    write(docs, own, tokenizer, end_id)
    out = read(spark, own).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    if path:
        return out
    out = cut(out)  # narrow rows; the files aren't needed any more
    delete(spark, own)
    return out
