"""Quality rules: a threshold table compiled into one projection, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words

# Common words of the four languages, in lower case.
STOP_WORDS = {
    "en": ("a", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "that", "the", "this", "to", "was", "with"),
    "fr": ("au", "aux", "avec", "dans", "de", "des", "du", "en", "est", "et", "la", "le", "les", "ou", "par", "pas", "pour", "que", "qui", "sur", "un", "une"),
    "de": ("als", "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "für", "ist", "im", "in", "mit", "nicht", "sich", "und", "von", "zu"),
    "es": ("a", "al", "con", "de", "del", "el", "en", "es", "la", "las", "lo", "los", "no", "para", "por", "que", "se", "su", "un", "una", "y"),
}
SYMBOLS = "#*$%&|<>"

#: (measure, least, most): a document is kept if every measure is between its two thresholds; None: no threshold.
THRESHOLDS: tuple[tuple[str, float | None, float | None], ...] = (
    ("mean_word_chars", 1.5, 15.0),
    ("symbol_ratio", None, 0.15),
    ("stop_words", 2, None),
    ("stop_ratio", 0.005, None),
    ("dup_line_ratio", None, 0.4),
    ("repeat_word_ratio", None, 0.5),
)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once: a lambda variable isn't evaluated again where it is used twice."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(w: Column) -> Column:
    """Words in 3-word windows that the array w has twice or more, each word counted once.

    Windows are sorted, so equal ones are neighbours: n log n in a text's length whatever its repeats. The first
    window of an equal run is counted too.
    """

    def covered(s: Column) -> Column:
        # Windows whose neighbour is equal; s[-1] isn't asked for.
        same = F.filter(F.sequence(F.lit(1), F.size(s) - 1), lambda k: s[k]["w"] == s[k - 1]["w"])
        starts = F.flatten(F.transform(same, lambda k: F.array(s[k]["i"], s[k - 1]["i"])))
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))

    window = lambda i: F.struct(F.concat_ws(" ", w[i], w[i + 1], w[i + 2]).alias("w"), i.alias("i"))
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), window)
    counted = _let(windows, lambda v: F.when(F.size(F.array_distinct(F.transform(v, lambda x: x["w"]))) == F.size(v), 0).otherwise(_let(F.sort_array(v), covered)))
    return F.when(F.size(w) < 4, 0).otherwise(counted)


def measures(text: Column) -> Column:
    """A struct of every base measure and ratio of a text. Null text is the empty text."""
    text = F.coalesce(text, F.lit(""))
    stops = sorted({w for ws in STOP_WORDS.values() for w in ws})
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)

    def of(w: Column) -> Column:
        n = F.size(w).cast("long")
        chars = F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long")
        symbols = (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")
        return _let(
            F.struct(
                n.alias("n_words"),
                chars.alias("word_chars"),
                symbols.alias("n_symbols"),
                _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
                _repeat_words(w).cast("long").alias("n_repeat_words"),
                F.size(F.filter(w, lambda x: F.lower(x).isin(*stops))).cast("long").alias("stop_words"),
            ),
            lambda m: F.struct(
                m["n_words"].alias("n_words"),
                m["word_chars"].alias("word_chars"),
                m["n_symbols"].alias("n_symbols"),
                m["lines"]["dup"].alias("n_dup_lines"),
                m["n_repeat_words"].alias("n_repeat_words"),
                m["stop_words"].alias("stop_words"),
                (m["word_chars"] / F.greatest(m["n_words"], F.lit(1))).alias("mean_word_chars"),
                (m["n_symbols"] / F.greatest(m["n_words"], F.lit(1))).alias("symbol_ratio"),
                (m["stop_words"] / F.greatest(m["n_words"], F.lit(1))).alias("stop_ratio"),
                (m["lines"]["dup"] / F.greatest(m["lines"]["n"], F.lit(1))).alias("dup_line_ratio"),
                (m["n_repeat_words"] / F.greatest(m["n_words"], F.lit(1))).alias("repeat_word_ratio"),
            ),
        )

    return _let(words(text), of)


def verdict(m: Column, thresholds=THRESHOLDS) -> Column:
    """The threshold table as one boolean expression over the struct m."""
    out = F.lit(True)
    for name, least, most in thresholds:
        if least is not None:
            out = out & (m[name] >= least)
        if most is not None:
            out = out & (m[name] <= most)
    return out


def quality_rules(docs: DataFrame, thresholds=THRESHOLDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document, in one projection without a shuffle: counts, base_failed and kept.

    Null and empty texts have no words and fail the base rule. Repeated rows are judged one by one; null ids pass
    through; other columns aren't read, so their names can't clash; an empty table gives an empty result.
    """
    m = docs.select(F.col(id_col).alias("doc_id"), measures(F.col(text_col)).alias("m"))
    base = (F.col("m.n_words") < 50) | (100 * F.col("m.n_repeat_words") > 50 * F.col("m.n_words"))
    return m.select("doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", base.alias("base_failed"), (~base & verdict(F.col("m"), thresholds)).alias("kept"))


def oracle_sql(thresholds=THRESHOLDS) -> str:
    """The same rows in DuckDB SQL, with words and lines as rows."""
    stops = ", ".join("'" + w + "'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))
    rules = " AND ".join([f"{n} >= {a}" for n, a, _ in thresholds if a is not None] + [f"{n} <= {b}" for n, _, b in thresholds if b is not None])
    return rf"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS u, coalesce(text, '') AS text FROM documents),
    t AS (SELECT doc_id, u, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
    word AS (SELECT u, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM t),
    win AS (SELECT u, i, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS x FROM word WINDOW o AS (PARTITION BY u ORDER BY i)),
    dup AS (SELECT u, i FROM (SELECT u, i, count(*) OVER (PARTITION BY u, x) AS c FROM win WHERE x IS NOT NULL) WHERE c > 1),
    rep AS (SELECT u, count(DISTINCT i + k) AS n_repeat_words FROM dup, (VALUES (0), (1), (2)) v(k) GROUP BY u),
    line AS (SELECT u, count(*) AS n, count(*) - count(DISTINCT x) AS dup FROM (SELECT u, unnest(string_split(text, chr(10))) AS x FROM t) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY u),
    st AS (SELECT u, count(*) AS n, sum(length(w)) AS chars, count(*) FILTER (lower(w) IN ({stops})) AS stop FROM word GROUP BY u),
    m AS (SELECT doc_id, coalesce(st.n, 0) AS n_words, coalesce(chars, 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        coalesce(dup, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(stop, 0) AS stop_words, coalesce(line.n, 0) AS n_lines
      FROM t LEFT JOIN st USING (u) LEFT JOIN line USING (u) LEFT JOIN rep USING (u)),
    r AS (SELECT *, word_chars / greatest(n_words, 1) AS mean_word_chars, n_symbols / greatest(n_words, 1) AS symbol_ratio, stop_words / greatest(n_words, 1) AS stop_ratio,
        n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio, n_repeat_words / greatest(n_words, 1) AS repeat_word_ratio,
        n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
    SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
        n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND {rules} AS kept FROM r"""
