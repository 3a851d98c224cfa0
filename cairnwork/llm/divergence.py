"""Source divergence audit: how far the word shares of a language's sources lie apart, by wide term vectors.

Each kept term of a language becomes one row with an array that has a place for every source of the language. Array
functions turn counts into smoothed shares and emit a contribution for each pair of sources; partial aggregation sums
them before anything is shuffled.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, cut, hot_join, tidy

#: A term: code points beyond ASCII and ASCII letters.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of its language that a kept term is in, what is added to each count, and what a share of one is written as.
LEAST_DOCS = 30
ADDED = 5
UNIT = 1_000_000_000
#: Ranks of the terms reported for each source; a top-k report.
TOP = 50


#: Bytes of text that a task sums at once; a longer text is summed on its own.
AT_ONCE = 16 << 20
COUNTS = "lang string, source string, term string, n long, docs long"
#: What ends a term (a byte that is ASCII and no letter) becomes a space, and a capital its small letter.
_FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)).lower()


def _sums(langs: list[str], sources: list[str], texts: list[str]) -> pa.RecordBatch:
    """Sums by language, source and term of a few documents."""
    low = pa.array([t.encode().translate(_FOLD) for t in texts], pa.large_binary()).cast(pa.large_string())
    words = pc.ascii_split_whitespace(low)
    coded = words.flatten().dictionary_encode()
    known: dict[tuple[str, str], int] = {}
    group = np.array([known.setdefault(g, len(known)) for g in zip(langs, sources, strict=True)], np.int64)
    size, doc = max(1, len(coded.dictionary)), np.repeat(np.arange(len(texts)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    pairs, n = np.unique(doc * size + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)  # of document and term
    doc, term = np.divmod(pairs, size)
    keys, place, docs = np.unique(group[doc] * size + term, return_inverse=True, return_counts=True)
    n = np.bincount(place, n, len(keys)).astype(np.int64)
    group, term = np.divmod(keys, size)
    of = lambda k: pa.array([g[k] for g in known], pa.string()).take(pa.array(group))
    out = pa.RecordBatch.from_arrays([of(0), of(1), coded.dictionary.take(pa.array(term)).cast(pa.string()), pa.array(n), pa.array(docs)], ["lang", "source", "term", "n", "docs"])
    return out.filter(pc.not_equal(out.column(2), ""))  # the edge of a text may give an empty word


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a task's documents (lang, source, text), handed on after each AT_ONCE bytes of text."""
    held: list[tuple[str, str, str]] = []
    size = 0
    for row in (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)):
        held.append(row)
        size += len(row[2])
        if size >= AT_ONCE:
            yield _sums(*zip(*held, strict=True))
            held, size = [], 0
    if held:
        yield _sums(*zip(*held, strict=True))


def _empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term; nulls are empty strings.

    Tasks sum their own documents first, so a frequent term or a hot source is a few rows a task. The rows are dealt by (lang, term).
    """
    rows = bounded_batches(docs).select(_empty(lang).alias("lang"), _empty(source).alias("source"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = rows.mapInArrow(tidy(_counted), COUNTS).repartition("lang", "term")
    return parts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + ADDED) / (total + ADDED * terms)), exact."""
    whole = lambda c, digits: c.cast(f"decimal({digits},0)")
    top = whole(F.lit(UNIT), 12) * whole(n + ADDED, 19)
    return 1 + F.call_function("div", top, whole(total + ADDED * terms, 19))


def vectors(docs: DataFrame, least_docs: int = LEAST_DOCS, lang: str = "lang", source: str = "source", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(wide, marks). wide: (lang, term, total, entries), a row for each kept term with its sources' counts. marks:
    (lang, terms, total, sources, totals), a row for each language with its sources in order and their sums of kept terms.

    A row of either is as long as its language has sources, a number whose square the audit returns.
    """
    counts = term_counts(docs, lang, source, text)
    entries = F.collect_list(F.struct("source", "n")).alias("entries")  # one for each source
    wide = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), entries).where(F.col("docs") >= least_docs)
    wide = cut(wide.select("lang", "term", "total", "entries"))
    groups = docs.select(_empty(lang).alias("lang"), _empty(source).alias("source"), F.lit(0).cast("long").alias("n"))
    sums = groups.unionByName(wide.select("lang", F.inline("entries"))).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    by_source = F.array_sort(F.collect_list(F.struct("source", "n")))
    marks = sums.groupBy("lang").agg(by_source.alias("s_"), F.sum("n").alias("all_"))
    terms = wide.groupBy("lang").agg(F.count("*").alias("terms"))
    marks = marks.join(terms, "lang", "left").select("lang", F.coalesce("terms", F.lit(0)).alias("terms"), "all_", F.col("s_.source").alias("sources"), F.col("s_.n").alias("totals"))
    return wide, cut(marks)


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank) for each source of each language.

    Part `pair`: every other source of the language with the summed absolute differences of the two sources' shares of
    all kept terms (0 without a kept term). Part `term`: the `top` kept terms of the source whose share exceeds the
    language's most. Ranks go by falling value, then by the item's bytes. A kept term is in least_docs documents
    of its language or more; shares are smoothed by ADDED for each term and are whole numbers of one in UNIT.

    Null texts have no terms, null languages and sources are the empty one; a source without a term, or of null texts,
    is a group like others. Repeated rows count each. Other columns aren't read, so their names can't clash. An
    empty table gives an empty result. The languages' rows of sources go to every executor for languages with more
    than one in 10,000 kept terms, fewer than 10,000 of them; others meet their terms in a shuffle.
    """
    wide, marks = vectors(docs, least_docs, lang, source, text)
    own = marks.withColumnRenamed("terms", "terms_").withColumn("n_", F.col("terms_")).where("terms_ > 0")
    rows = hot_join(wide, own, ["lang"], "n_")
    found = F.map_from_entries("entries")
    counts = F.transform("sources", lambda s: F.coalesce(F.try_element_at(found, s), F.lit(0)))
    rows = rows.withColumn("counts", counts)
    rows = rows.withColumn("p", F.transform("counts", lambda n, i: _share(n, F.get("totals", i), F.col("terms_")))).withColumn("q", _share(F.col("total"), F.col("all_"), F.col("terms_")))
    # A pair is summed once, with its places in order.
    places = F.sequence(F.lit(0), F.size("p") - 1)
    after = lambda i: F.transform(F.slice("p", i + 2, F.size("p")), lambda x, k: F.struct(i.alias("i"), (i + 1 + k).alias("j"), F.abs(F.get("p", i) - x).alias("f")))
    sums = rows.select("lang", F.inline(F.flatten(F.transform(places, after)))).groupBy("lang", "i", "j").agg(F.sum("f").alias("value"))
    sides = marks.select("lang", "sources", F.posexplode("sources").alias("a", "source")).select("lang", "a", "source", F.posexplode("sources").alias("b", "item")).where("a <> b")
    sides = sides.withColumn("i", F.least("a", "b")).withColumn("j", F.greatest("a", "b"))
    pairs = sides.join(sums, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    by_value = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(by_value))
    each = F.inline(F.arrays_zip("sources", "counts", "p"))
    above = rows.select("lang", F.col("term").alias("item"), "q", each).where("counts > 0 AND p > q")
    above = above.select("lang", F.col("sources").alias("source"), F.lit("term").alias("part"), "item", (F.col("p") - F.col("q")).alias("value"))
    above = above.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
    return pairs.unionByName(above)


def oracle_sql(least_docs: int = LEAST_DOCS, top: int = TOP) -> str:
    """The same rows in DuckDB SQL, by a join of every group with every kept term."""
    share = lambda n, total, v: f"(1 + ({UNIT}::HUGEINT * ({n} + {ADDED})) // ({total} + {ADDED} * {v}))::BIGINT"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS text FROM documents),
    o AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '{TERM}')) AS term FROM d),
    k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY ALL HAVING count(DISTINCT id) >= {least_docs}),
    c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL),
    g AS (SELECT DISTINCT lang, source FROM d),
    l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
    s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
    w AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
        {share('coalesce(c.n, 0)', 'coalesce(s.total, 0)', 'l.v')} AS p, {share('k.n', 'l.total', 'l.v')} AS q
      FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
      LEFT JOIN s ON s.lang = g.lang AND s.source = g.source),
    f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM w a JOIN w b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM w WHERE n > 0 AND p > q),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM u)
    SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= {top}"""
