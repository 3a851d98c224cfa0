"""Mixing sources to target weights with a low-discrepancy schedule, in DataFrame functions only.

Slot k of the schedule takes one block of equal token count. The golden-ratio point frac((k + 1/2) phi) falls into
one source's stretch of the cumulative shares, so every run of slots follows the weights. The slots of a
source are ranked, and slot r takes block r of the source's shuffled words, which repeat without end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, n_words

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Slots of the schedule: a bound of the schedule's own, whatever the input's size; blocks grow with the input instead.
SLOTS = 1 << 17
#: Sources whose target is below so many blocks get as many words as their target asks, whatever the schedule dealt them.
FEW_BLOCKS = 64
SEED = 20
#: Pieces of a source for ranks and running sums, so that no source is one task's.
PIECES = 512
GOLDEN = 0.6180339887498949


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code point order, null last, take the weights in turn. The mix has share times all words. A target
    stops at most times the source's size and the excess goes to the rest by weight: with the sources in order of
    most * size / weight, the first k are at their stop, for the least k at which the level for the rest is below the
    next one's stop. The windows run over one row a source, in one task.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    everything = W.partitionBy(F.lit(0))
    by_stop = W.partitionBy(F.lit(0)).orderBy("stop_", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    s = sizes.withColumn("weight_", weight).withColumn("stop_", F.lit(most) * F.col("source_size") / F.col("weight_"))
    s = s.withColumn("rest_", share * F.sum("source_size").over(everything) - F.coalesce(most * F.sum("source_size").over(by_stop), F.lit(0)))
    s = s.withColumn("level_", F.col("rest_") / (F.sum("weight_").over(everything) - F.coalesce(F.sum("weight_").over(by_stop), F.lit(0.0))))
    s = s.withColumn("place_", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("stop_", F.col("source").asc_nulls_last())))
    fits = F.col("level_") <= F.col("stop_")
    s = s.withColumn("level_", F.min_by(F.when(fits, F.col("level_")), F.when(fits, F.col("place_"))).over(everything))
    full = (F.lit(most) * F.col("source_size")).cast("double")
    return s.select("source", "source_size", F.when(F.col("stop_") <= F.col("level_"), full).otherwise(F.least(full, F.coalesce(F.col("weight_") * F.col("level_"), full))).alias("target"))


def blocks(goals: DataFrame, slots: int = SLOTS) -> DataFrame:
    """goals with the mix's words sum_ and the words of a block, the same for all sources."""
    total = F.sum("target").over(W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return goals.withColumn("sum_", total).withColumn("block_words", F.greatest(F.lit(1), F.ceil(F.col("sum_") / slots)).cast("long"))


def schedule(goals: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(slot, source, rank, block_words): which source each slot takes, and which of that source's blocks.

    block_words is what a slot takes, the same for all. Ranks are counted in pieces of consecutive slots and
    summed over the pieces, so that a heavy source's slots aren't ranked in one task.
    """
    spark = goals.sparkSession
    up = W.orderBy(F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    g = goals if "block_words" in goals.columns else blocks(goals, slots)
    g = g.where("target > 0").withColumn("to_", F.sum("target").over(up) / F.col("sum_"))
    last = W.orderBy(F.col("source").asc_nulls_last())
    g = g.withColumn("from_", F.coalesce(F.lag("to_").over(last), F.lit(0.0)))
    g = g.withColumn("to_", F.when(F.lead("to_").over(last).isNull(), 2.0).otherwise(F.col("to_")))
    g = g.select("source", "from_", "to_", "block_words", "sum_")
    point = (F.col("id") + 0.5) * GOLDEN
    k = spark.range(0, slots, 1, 8).select(F.col("id").alias("slot"), (point - F.floor(point)).alias("point_"))
    # Points and stretches meet by buckets of the cumulative share: sources plus slots rows at most, however many sources there are.
    bucket = lambda c: F.least(F.lit(slots - 1), F.floor(F.col(c) * slots)).cast("long")
    k = k.withColumn("k_", bucket("point_"))
    g = g.withColumn("g_", F.explode(F.sequence(bucket("from_"), bucket("to_"))))
    taken = k.join(g, (F.col("k_") == F.col("g_")) & (F.col("point_") >= F.col("from_")) & (F.col("point_") < F.col("to_")))
    taken = taken.where(F.col("slot") < F.ceil(F.col("sum_") / F.col("block_words"))).drop("point_", "from_", "to_", "sum_", "k_", "g_")
    taken = taken.withColumn("piece_", F.expr(f"slot div {max(1, slots // PIECES)}"))
    counts = taken.groupBy("source", "piece_").agg(F.count("*").alias("n_"))
    before = W.partitionBy("source").orderBy("piece_").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(F.col("source").alias("s_"), F.col("piece_").alias("q_"), F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_"))
    local = F.row_number().over(W.partitionBy("source", "piece_").orderBy("slot")) - 1
    ranked = taken.withColumn("local_", local)
    ranked = ranked.join(starts, (F.col("source").eqNullSafe(F.col("s_"))) & (F.col("piece_") == F.col("q_")))
    return ranked.select("slot", "source", (F.col("start_") + F.col("local_")).alias("rank"), "block_words")


def settled(slot_rows: DataFrame, goals: DataFrame, slots: int = SLOTS) -> DataFrame:
    """slot_rows with source_size and stop_words_, where the source's words end: no source is lost between the points.

    The schedule is off by a few blocks a source, which is all of a source below a block. Sources whose target is below
    FEW_BLOCKS blocks end at their target, rounded, with one word at least; blocks that the schedule didn't deal
    them follow as slots after the last one, fewer than FEW_BLOCKS a source. The others end at MOST times their size.
    """
    few = F.col("target") < FEW_BLOCKS * F.col("block_words")
    words = F.when(few, F.greatest(F.lit(1), F.round("target").cast("long"))).otherwise(MOST * F.col("source_size")).cast("long")
    g = goals.where("target > 0").select(F.col("source").alias("g_"), "source_size", words.alias("stop_words_"), few.alias("few_"), F.col("block_words").alias("w_"))
    dealt = slot_rows.groupBy(F.col("source").alias("d_")).agg(F.count("*").alias("n_"))
    need = g.where("few_").join(dealt, F.col("g_").eqNullSafe(F.col("d_")), "left").withColumn("n_", F.coalesce("n_", F.lit(0)))
    need = need.withColumn("end_", F.ceil(F.col("stop_words_") / F.col("w_")).cast("long")).where("n_ < end_")
    up = W.orderBy(F.col("g_").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)  # a row a source
    need = need.withColumn("first_", slots + F.coalesce(F.sum(F.col("end_") - F.col("n_")).over(up), F.lit(0)))
    more = need.withColumn("rank", F.explode(F.expr("sequence(n_, end_ - 1)")))
    more = more.select((F.col("first_") + F.col("rank") - F.col("n_")).alias("slot"), F.col("g_").alias("source"), "rank", F.col("w_").alias("block_words"), "source_size", "stop_words_")
    own = slot_rows.join(g.drop("few_", "w_"), F.col("source").eqNullSafe(F.col("g_"))).drop("g_")
    return own.unionByName(more)


def _laid_out(docs: DataFrame, size: Column, slots: int, seed: int, id_col: str, source_col: str, carry: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(documents with their place in their source's shuffled words, schedule), the latter cut to the shared folder."""
    key = F.sha1(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row_"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.cast("long").alias("size"), key.alias("key_"))
    d = d.withColumn("piece_", (F.conv(F.substring("key_", 1, 4), 16, 10).cast("int") * PIECES / (1 << 16)).cast("int"))
    d = cut(d.withColumn("uid_", F.monotonically_increasing_id()))
    by_piece = d.groupBy("source", "piece_").agg(F.sum("size").alias("n_"))
    before = W.partitionBy("source").orderBy("piece_").rowsBetween(W.unboundedPreceding, -1)
    by_piece = cut(by_piece.select(F.col("source").alias("s_"), F.col("piece_").alias("q_"), "n_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_")))
    goals = cut(blocks(targets(by_piece.groupBy(F.col("s_").alias("source")).agg(F.sum("n_").alias("source_size"))), slots))
    places = by_piece.join(goals.withColumnRenamed("source", "g_"), F.col("s_").eqNullSafe(F.col("g_"))).drop("g_", "n_", "sum_")
    inside = W.partitionBy("source", "piece_").orderBy("key_", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = d.withColumn("at_", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(places, F.col("source").eqNullSafe(F.col("s_")) & (F.col("piece_") == F.col("q_"))).withColumn("at_", F.col("at_") + F.col("start_"))
    return placed.drop("s_", "q_", "start_", "key_", "piece_"), cut(settled(cut(schedule(goals, slots)), goals, slots))


def _taken(placed: DataFrame, slot_rows: DataFrame) -> DataFrame:
    """(uid_, slot, pass, from_word, words): the part of each document that each slot takes.

    A slot's block is cut at the end of a pass over its source and at stop_words_, where the source's words end; blocks and documents
    meet in an equi-join on the stretch of block_words words, of which a row on either side covers as many as it
    touches. Rows out: documents plus slots at most, for both lie side by side.
    """
    b = slot_rows.withColumn("start_", F.col("rank") * F.col("block_words")).withColumn("end_", F.least(F.col("start_") + F.col("block_words"), "stop_words_"))
    passes = F.sequence(F.expr("start_ div source_size"), F.expr("(end_ - 1) div source_size"))
    b = b.where("start_ < end_").withColumn("pass", F.explode(passes))
    b = b.select("slot", F.col("source").alias("s_"), "pass", F.greatest(F.lit(0), F.col("start_") - F.col("pass") * F.col("source_size")).alias("a_"), F.least("source_size", F.col("end_") - F.col("pass") * F.col("source_size")).alias("b_"), "block_words")
    b = b.withColumn("k_", F.explode(F.expr("sequence(a_ div block_words, (b_ - 1) div block_words)"))).drop("block_words")
    d = placed.where("size > 0").select("uid_", "source", "at_", "size", F.explode(F.expr("sequence(at_ div block_words, (at_ + size - 1) div block_words)")).alias("j_"), "block_words")
    both = d.join(b, F.col("source").eqNullSafe(F.col("s_")) & (F.col("j_") == F.col("k_")))
    low = F.greatest("at_", "a_", F.col("j_") * F.col("block_words"))
    high = F.least(F.col("at_") + F.col("size"), F.col("b_"), (F.col("j_") + 1) * F.col("block_words"))
    return both.where(high > low).select("uid_", "slot", "pass", (low - F.col("at_")).alias("from_word"), (high - low).alias("words"))


def mix(docs: DataFrame, size: Column | None = None, slots: int = SLOTS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: doc_id, size, source_size, target (of its source), taken (words the mix takes), copies, row_.

    size: a column of token counts, by default the number of words. A source's documents are shuffled by a hash of
    their id and laid end to end; slot r of the source takes words [r b, (r + 1) b) of them, again from the start
    after the end. What passes MOST times the source's size is cut off, so a document is taken twice at most. Sources
    below FEW_BLOCKS blocks get exactly the words of their target, rounded, one at least.
    copies: passes that take its first word. row_: the columns named in carry, unread otherwise.
    Null text counts 0, null ids and null sources are values like others, repeated rows are rows of their own, and
    those that agree in everything are exchangeable. A source without words has target 0; an empty table gives none.
    Running sums go by (source, piece of the shuffle), so a hot source is spread over PIECES groups.
    """
    size = n_words(F.col(text_col)) if size is None else size
    placed, slot_rows = _laid_out(docs, size, slots, seed, id_col, source_col, carry or (id_col,))
    parts = _taken(placed, slot_rows).select("uid_", "words", (F.col("from_word") == 0).cast("long").alias("first_"))
    taken = parts.groupBy("uid_").agg(F.sum("words").alias("words"), F.sum("first_").alias("first_")).withColumnRenamed("uid_", "t_")
    out = placed.join(taken, F.col("uid_") == F.col("t_"), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"), F.coalesce("first_", F.lit(0)).alias("copies"), "row_")


def mixture(docs: DataFrame, slots: int = SLOTS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself in slot order: (slot, pass, doc_id, source, from_word, words), unsorted."""
    placed, slot_rows = _laid_out(docs, n_words(F.col(text_col)), slots, seed, id_col, source_col, (id_col,))
    ids = placed.select(F.col("uid_").alias("u_"), "doc_id", "source")
    return _taken(placed, slot_rows).join(ids, F.col("uid_") == F.col("u_")).select("slot", "pass", "doc_id", "source", "from_word", "words")


def oracle_sql(slots: int = SLOTS, seed: int = SEED) -> str:
    """The result of mix() in DuckDB SQL: each source's slots are counted, and its words laid end to end in one window."""
    weight = ", ".join(f"{w}.0" for w in WEIGHTS)
    return f"""
    WITH d AS (SELECT doc_id, source, sha1('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
    w AS (SELECT *, ([{weight}])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1]::DOUBLE AS weight FROM s),
    c AS (SELECT *, {MOST} * source_size / weight AS stop, {SHARE} * sum(source_size) OVER () - coalesce(sum({MOST} * source_size) OVER o, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS free, row_number() OVER (ORDER BY {MOST} * source_size / weight, source NULLS LAST) AS place
        FROM w WINDOW o AS (ORDER BY {MOST} * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    l AS (SELECT arg_min(rest / free, place) AS level FROM c WHERE rest / free <= stop),
    g AS (SELECT source, source_size, CASE WHEN stop <= level THEN {MOST}.0 * source_size ELSE least({MOST}.0 * source_size, coalesce(weight * level, {MOST}.0 * source_size)) END AS target FROM c, l),
    h AS (SELECT *, sum(target) OVER () AS total, sum(target) OVER (ORDER BY source NULLS LAST ROWS UNBOUNDED PRECEDING) / sum(target) OVER () AS upto, row_number() OVER (ORDER BY source DESC NULLS FIRST) = 1 AS last FROM g WHERE target > 0),
    b AS (SELECT *, greatest(1, ceil(total / {slots}))::BIGINT AS block, coalesce(lag(upto) OVER (ORDER BY source NULLS LAST), 0.0) AS lo, CASE WHEN last THEN 2.0 ELSE upto END AS hi FROM h),
    n AS (SELECT source, least(count(*) * any_value(block), {MOST} * any_value(source_size))::BIGINT AS words FROM b, (SELECT k, (k + 0.5) * {GOLDEN}::DOUBLE - floor((k + 0.5) * {GOLDEN}::DOUBLE) AS u FROM range({slots}) t(k)) p
        WHERE u >= lo AND u < hi AND k < ceil(total / block) GROUP BY 1),
    q AS (SELECT d.*, g.source_size, g.target, CASE WHEN g.target > 0 AND g.target < {FEW_BLOCKS} * (SELECT max(block) FROM b) THEN greatest(1, round(g.target))::BIGINT ELSE coalesce(n.words, 0) END AS words, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
        FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN n ON d.source IS NOT DISTINCT FROM n.source)
    SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE words // source_size * size + greatest(0, least(pos + size, words % source_size) - pos) END::BIGINT AS taken FROM q"""
