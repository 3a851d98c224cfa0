"""Sharding along a Hilbert curve, in DataFrame functions only.

Three metadata dimensions (language, source, size) are quantised to BITS bits each by rank: a value's level is where
its rows lie among all rows in the order of values. The cell's index on the 3-D Hilbert curve orders the documents, and
runs of that order are the shards. Rows that are alike in any of the dimensions lie in few shards, so a filter on one of
them prunes files by their minimum and maximum.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, global_rank

BITS = 6
SHARDS = 24


@cache
def steps() -> list[int]:
    """What one level of the 3-D Hilbert curve does: entry 8 state + corner is 24 octant + next state.

    The curve comes from Gray codes with an entry corner e and a direction d for each level (Hamilton 2006); a state is
    3 e + d, and a corner has the level's bit of the first dimension lowest.
    """
    n, out = 3, []
    turn = lambda v, k: ((v >> k % n) | (v << (n - k % n))) & 7 if k % n else v
    gray = lambda v: v ^ (v >> 1)

    def ungray(g: int) -> int:
        v = 0
        while g:
            v ^= g
            g >>= 1
        return v

    def ones(v: int) -> int:
        k = 0
        while v & 1:
            v, k = v >> 1, k + 1
        return k

    for state in range(24):
        e, d = divmod(state, n)
        for corner in range(8):
            w = ungray(turn(corner ^ e, d + 1))
            entry = 0 if w == 0 else gray(2 * ((w - 1) // 2))
            way = 0 if w == 0 else (ones(w - 1) if w % 2 == 0 else ones(w)) % n
            back = ((entry << (d + 1) % n) | (entry >> (n - (d + 1) % n))) & 7 if (d + 1) % n else entry
            out.append(24 * w + 3 * (e ^ back) + (d + way + 1) % n)
    return out


def _index(x: str, y: str, z: str, bits: int, table: str, fold: str, div: str, at: str, shift: str) -> str:
    """SQL for the curve index of levels x, y and z: one step a bit, the state below the octants passed so far."""
    corner = " + ".join(f"{1 << k} * ({shift.format(v)} & 1)" for k, v in enumerate((x, y, z)))
    step = at.format(table=table, place=f"(acc % 24) * 8 + {corner} + 1")
    return fold.format(bits=", ".join(map(str, reversed(range(bits)))), step=f"((acc {div} 24) * 8 + {step} {div} 24) * 24 + {step} % 24") + f" {div} 24"


def _size_step(size: str, shift: str) -> str:
    """SQL for a size's step as text: eight to an octave, in the order of sizes. Sizes start at 8, of four bits."""
    return f"lpad(cast(length(bin({size})) * 8 + ({shift} & 7) as {{}}), 3, '0')"


def levels(rows: DataFrame, dims: list[str], bits: int = BITS) -> list[list[tuple[str, int]]]:
    """For each dimension the least value of each level that has one, in order: 2 ** bits - 1 of them at most.

    A value's level is the middle of its rows' ranks, in steps of equal numbers of rows. A value that many rows share is one level, and
    its neighbours keep theirs. Nulls are last and have the last level to themselves. Values are counted before they
    are shuffled, and running sums go by range partitions, so neither a hot value nor many values are one task's.
    """
    top = (1 << bits) - 1
    value = F.explode(F.array(*[F.struct(F.lit(k).alias("dim"), F.col(d).cast("string").alias("value")) for k, d in enumerate(dims)]))
    counts = rows.select(value.alias("v_")).select("v_.*").groupBy("dim", "value").agg(F.count("*").alias("n"))
    order = [F.col("dim"), F.col("value").asc_nulls_last()]
    counts = cut(counts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id_", F.monotonically_increasing_id()).withColumn("part_", F.shiftright("id_", 33)))
    before = F.coalesce(F.sum("n").over(W.partitionBy("part_").orderBy("id_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = counts.groupBy(F.col("part_").alias("p_")).agg(F.sum("n").alias("s_"))  # a row for each shuffle partition
    parts = parts.select("p_", F.coalesce(F.sum("s_").over(W.orderBy("p_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start_"))
    placed = counts.withColumn("in_", before).join(F.broadcast(parts), F.col("part_") == F.col("p_"))
    total = rows.count()
    # Each dimension counts every row once, so the rows of the dimensions before it are a multiple of the total.
    level = F.expr(f"((2 * (in_ + start_ - dim * {total}L) + n) * {top}) div (2 * {max(1, total)}L)").cast("int")
    least = placed.where("value IS NOT NULL").groupBy("dim", level.alias("level")).agg(F.min("value").alias("value"))
    out: list[list[tuple[str, int]]] = [[] for _ in dims]
    for r in least.orderBy("dim", "level").collect():  # len(dims) * top rows at most
        out[r["dim"]].append((r["value"], r["level"]))
    return out


def _level(value: Column, least: list[tuple[str, int]], bits: int) -> Column:
    if not least:
        return F.lit((1 << bits) - 1)
    ends, at = F.array(*[F.lit(v) for v, _ in least]), F.array(*[F.lit(k) for _, k in least])
    own = F.element_at(at, F.greatest(F.lit(1), F.size(F.filter(ends, lambda e: e <= value))))
    return F.when(value.isNull(), F.lit((1 << bits) - 1)).otherwise(own)


def hilbert_shards(docs: DataFrame, shards: int = SHARDS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """One row a document: its size, checksum, cell index, shard and slot. Law: `rows`.

    Shards hold ceil or floor of rows / shards documents, slots run from 0 without a gap. Order: curve index,
    checksum, id, size; so copies of a text that share metadata are neighbours. Null text: size 8, checksum of the
    empty text. Null metadata have a level of their own. Null ids sort first; rows that agree in all four keys are
    exchangeable. Empty table: empty result. Other columns of docs aren't read, so their names can't clash. The texts are
    read once; only narrow rows are written and shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.col(dims[0]).cast("string").alias("x_"),
        F.col(dims[1]).cast("string").alias("y_"),
    )
    rows = cut(rows.withColumn("z_", F.expr(_size_step("size", "shiftright(size, length(bin(size)) - 4)").format("string"))))
    found = levels(rows, ["x_", "y_", "z_"], bits)
    for name, least in zip(("x_", "y_", "z_"), found, strict=True):
        rows = rows.withColumn(name, _level(F.col(name), least, bits))
    table = f"array({', '.join(map(str, steps()))})"
    index = _index("x_", "y_", "z_", bits, table, "aggregate(array({bits}), 0L, (acc, b) -> {step})", "div", "element_at({table}, cast({place} as int))", "shiftright({}, b)")
    keyed = rows.select("doc_id", "size", "text_crc32", F.expr(index).alias("curve_index"))
    ranked = global_rank(keyed, ["curve_index", "text_crc32", "doc_id", "size"])
    total = ranked.agg(F.count("*").alias("total_"))
    shard = F.expr(f"(rank_ * {shards}) div total_")
    out = ranked.crossJoin(F.broadcast(total)).withColumn("shard", shard.cast("int"))  # total: one row
    start = F.expr(f"(shard * total_ + {shards - 1}) div {shards}")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("rank_") - start).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve_index"
    )


def oracle_sql(shards: int = SHARDS, bits: int = BITS) -> str:
    """The same rows in DuckDB SQL; the checksum is a fold of the standard reflected polynomial."""
    crc = []
    for v in range(256):
        for _ in range(8):
            v = v >> 1 ^ 0xEDB88320 if v & 1 else v >> 1
        crc.append(v)
    top = (1 << bits) - 1
    index = _index("x", "y", "z", bits, "turns", "list_reduce([0, {bits}]::BIGINT[], lambda acc, b: {step})", "//", "{table}[{place}]", "({} >> CAST(b AS INT))")
    step = _size_step("size", "(size >> CAST(length(bin(size)) - 4 AS INT))").format("varchar")
    values = " UNION ALL ".join(f"SELECT {k} AS dim, {c} AS value, count(*) AS n FROM s GROUP BY 2" for k, c in enumerate(("lang", "source", "step")))
    level = lambda k, c: f"(SELECT CASE WHEN value IS NULL THEN {top} ELSE level END FROM l WHERE dim = {k} AND value IS NOT DISTINCT FROM {c})"
    return f"""
    WITH tab AS (SELECT {crc}::UBIGINT[] AS t, {steps()}::BIGINT[] AS turns),
    d AS (SELECT doc_id, coalesce(text, '') AS text, lang, source, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size FROM documents),
    s AS (SELECT doc_id, lang, source, size, {step} AS step,
        CASE WHEN text = '' THEN 0 ELSE xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT,
            list_transform(range(1, strlen(text) + 1), lambda i: CAST('0x' || hx[2 * i - 1:2 * i] AS UBIGINT))),
            lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1]))) END AS crc
      FROM (SELECT *, hex(encode(text)) AS hx FROM d), tab),
    v AS ({values}),
    l AS (SELECT dim, value, CAST(((2 * coalesce(sum(n) OVER (PARTITION BY dim ORDER BY value NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n) * {top}) // (2 * sum(n) OVER (PARTITION BY dim)) AS BIGINT) AS level FROM v),
    g AS (SELECT doc_id, size, crc, {level(0, 'lang')} AS x, {level(1, 'source')} AS y, {level(2, 'step')} AS z FROM s),
    c AS (SELECT doc_id, size, crc, CAST({index} AS BIGINT) AS curve_index FROM g, tab),
    r AS (SELECT *, row_number() OVER (ORDER BY curve_index, crc, doc_id, size) - 1 AS rk, count(*) OVER () AS total FROM c),
    h AS (SELECT *, CAST(rk * {shards} // total AS INT) AS shard FROM r)
    SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law, shard,
        CAST(rk - (shard * total + {shards - 1}) // {shards} AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard, curve_index FROM h"""
