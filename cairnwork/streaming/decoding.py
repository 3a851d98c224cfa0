"""Incremental UTF-8: which text each chunk of a byte stream lets out, so that no character is shown half."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import sum_before
from ..operators.ranks import global_rank

#: Bytes of the longest character; whether a text ends clean shows in its last so many bytes.
LONGEST = 4
REPLACEMENT = "�"


def decoded(chunks: DataFrame, stream: str, seq: str, data: str) -> DataFrame:
    """(stream, seq, text): what becomes readable with each chunk of a stream, in the order of seq; chunks that let nothing out have no row.

    A chunk lets out all bytes since the last one that did, decoded with replacement characters, unless that would end in a
    replacement character: then the bytes wait, be they half a character, no UTF-8, or that character itself. What waits when a stream
    ends is never let out. Null chunks are empty; chunks that share a seq go by their bytes.

    Any byte that begins a character does so whatever stood before it, so a chunk needs only the three bytes before
    it, which up to three chunks hold: each sends its last bytes to the next ones by their rank. All chunks are then
    looked at side by side, also those of one long stream; what is put together is the bytes between two clean ends.
    """
    d = chunks.select(F.col(stream).alias("stream_"), F.col(seq).alias("seq_"), F.coalesce(F.col(data), F.lit(b"")).alias("bytes_")).where(F.octet_length("bytes_") > 0)
    d = global_rank(d, ["stream_", "seq_", "bytes_"])
    tail = F.expr(f"substr(bytes_, greatest(1, octet_length(bytes_) - {LONGEST - 1}))")
    sent = d.select("stream_", F.posexplode(F.sequence(F.col("rank_"), F.col("rank_") + LONGEST - 1)).alias("back_", "to_"), tail.alias("tail_"))
    sent = sent.groupBy("stream_", "to_").agg(F.array_sort(F.collect_list(F.struct((-F.col("back_")).alias("order_"), "tail_"))).alias("tails_"))  # four at most
    end = F.aggregate("tails_", F.lit(b""), lambda a, x: F.concat(a, x["tail_"]))
    last = F.expr(f"substr(end_, greatest(1, octet_length(end_) - {LONGEST - 1}))")
    sent = sent.withColumn("end_", end).select(F.col("stream_").alias("s_"), "to_", (~F.make_valid_utf8(last.cast("string")).endswith(REPLACEMENT)).cast("long").alias("clean_"))
    d = d.join(sent, d["stream_"].eqNullSafe(sent["s_"]) & (F.col("rank_") == F.col("to_"))).drop("s_", "to_")
    d = sum_before(d, "rank_", F.col("clean_"), "run_")
    run = F.transform(F.array_sort(F.collect_list(F.struct("rank_", "bytes_"))), lambda x: x["bytes_"])
    runs = d.groupBy("stream_", "run_").agg(F.max(F.struct("rank_", "seq_", "clean_")).alias("last_"), run.alias("parts_")).where("last_.clean_ = 1")
    whole = F.aggregate("parts_", F.lit(b""), lambda a, x: F.concat(a, x))
    return runs.select(F.col("stream_").alias(stream), F.col("last_.seq_").alias(seq), F.make_valid_utf8(whole.cast("string")).alias("text"))
