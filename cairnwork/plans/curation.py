"""The curation flow: filter, normalise, validate, classify, keep first, score, quota, and its manifest counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from ..operators import conversation as C
from ..operators import ordered as O
from . import rules_sql as R
from .conversations import _PAIRS as PAIRS
from .registry import query, read


def once(df: DataFrame, name: str, value) -> DataFrame:
    """df with a costly column that is computed once a row: filters on it aren't pushed below a generator, where they would repeat it."""
    return df.withColumn(name, F.explode(F.array(value)))


def candidates(pairs: DataFrame, mark: str, rules: str = "v3", seed: int = 42, category: Column | None = None, marked: bool = True, reward: float | None = None, limit: int | None = None, thoughts: bool | None = None) -> DataFrame:
    """Valid rows (ord, category, user, assistant, score) of pairs (ord, user, assistant[, reward]), the first of equal prompts by ord.

    One lazy plan: cheap filters first, each text normalised once; long texts are dropped before anything is shuffled.
    The category is the given column of pairs, else the prompt's class. With `reward`, rows of at least that reward count
    and it leads the score. `limit` reads only the first rows by ord. The tie hash is of mark, category (if `marked`) and prompt.
    """
    d = pairs if limit is None else pairs.where(F.col("ord") <= F.lit(last_of_first(pairs, limit)))
    worth = F.lit(None).cast("double") if reward is None else F.coalesce("reward", F.lit(0.0))
    if reward is not None:
        d = d.where(worth >= reward)
    cut = rules == "v3" if thoughts is None else thoughts
    answer = X.teacher_answer(X.after_thought(F.col("assistant")) if cut else F.col("assistant"), rules)
    kind = F.lit(None).cast("string") if category is None else category
    d = once(d, "n", F.struct(X.normalize_user_prompt(F.col("user")).alias("user"), answer.alias("assistant"), kind.alias("kind"), worth.alias("worth"))).select("ord", "n.*")
    d = once(d.where("user <> '' AND assistant <> ''"), "ok", X.valid_pair(F.col("user"), F.col("assistant"), rules)).where("ok")
    if category is None:
        d = d.withColumn("kind", X.classify_thoughts(F.col("user")) if rules == "v3" else X.classify_prompt(F.col("user")))
    d = O.keep_first(d.select("ord", F.col("kind").alias("category"), "user", "assistant", "worth"), F.lower("user"), "ord")
    payload = F.concat(F.lit(f"{mark}:"), *([F.col("category"), F.lit(":")] if marked else []), "user")
    score = X.selection_score(seed, payload, F.col("user"), F.col("assistant"), None if reward is None else F.col("worth"), rules)
    return d.withColumn("score", score).drop("worth")


def last_of_first(pairs: DataFrame, limit: int):
    """The ord of the last of the first `limit` rows; only ords are read, and tasks keep no more than the limit."""
    return pairs.select("ord").orderBy("ord").limit(limit).agg(F.max("ord")).first()[0]


def chosen(found: DataFrame, source: str, quotas: DataFrame) -> DataFrame:
    """The best candidates of each category up to its quota (a table category, quota)."""
    d = found.withColumn("source", F.lit(source))
    return O.top_k(d, "category", quotas, F.desc("score"), F.col("ord")).select("ord", "source", "category", "user", "assistant", "score", "rank")


def curate(pairs: DataFrame, source: str, quotas: DataFrame, rules: str = "v3", seed: int = 42, reward: float | None = None, **how) -> DataFrame:
    """Chosen rows (ord, source, category, user, assistant, score, rank) of one source's pairs; `how` as for candidates()."""
    return chosen(candidates(pairs, source, rules, seed, reward=reward, **how), source, quotas)


def merged(parts: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """The chosen rows of several sources with their categories in order: of equal prompts the first source's row stays."""
    out = []
    for k, (rows, kinds) in enumerate(parts):
        out.append(rows.withColumn("source_place", F.lit(k)).withColumn("kind_place", F.array_position(F.array(*map(F.lit, kinds)), F.col("category"))))
    return O.keep_first(reduce(DataFrame.unionByName, out), F.lower("user"), "source_place", "kind_place", "rank")


def manifest(rows: DataFrame, found: dict[str, DataFrame], read_rows: dict[str, tuple[DataFrame, int | None]]) -> DataFrame:
    """Counts (part, name, n) of a curation: rows by source and category, accepted candidates and scanned rows by source.

    A source (rows, limit) with more rows than its limit counts the row that it stopped at, too.
    """
    scanned = lambda d, most: d.agg((F.count("*") if most is None else F.least(F.count("*"), F.lit(most + 1))).cast("long").alias("n"))
    by = lambda d, part, name: d.groupBy(F.lit(part).alias("part"), name.alias("name")).agg(F.count("*").alias("n"))
    out = [by(rows, "source", F.col("source")), by(rows, "category", F.col("category"))]
    out += [by(d, "accepted", F.concat(F.lit(f"{s}/"), "category")) for s, d in found.items()]
    out += [scanned(*d).select(F.lit("scanned").alias("part"), F.lit(s).alias("name"), "n") for s, d in read_rows.items()]
    return reduce(DataFrame.unionByName, out)


def quota_table(spark, quotas: dict[str, int]) -> DataFrame:
    return spark.createDataFrame(list(quotas.items()), "category string, quota int")


def messages(rows: DataFrame) -> DataFrame:
    """Rows as training conversations."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    return rows.withColumn("messages", F.array(turn("user", "user"), turn("assistant", "assistant")))


_BY_TURNS = f"(SELECT conv_id AS ord, user, assistant FROM {PAIRS})"
_FIELDS = "ord, source, category, user, assistant, score, rank"


def _pairs(spark, sf_dir):
    return C.first_pairs(read(spark, sf_dir, "conversations")).withColumnRenamed("conv_id", "ord")


@query(R.chosen(R.candidates(_BY_TURNS, "open-thoughts"), "open-thoughts", V.QUOTAS_V3))
def c01_curation_v3(spark, sf_dir):
    return curate(_pairs(spark, sf_dir), "open-thoughts", quota_table(spark, V.QUOTAS_V3))


_DISTILLED = {"science": 60, "puzzle": 50, "logic": 30, "grounded_qa": 20}


@query(R.chosen(R.candidates(_BY_TURNS, "openthoughts", "distilled"), "openthoughts", _DISTILLED))
def c02_curation_distilled(spark, sf_dir):
    return curate(_pairs(spark, sf_dir), "openthoughts", quota_table(spark, _DISTILLED), "distilled")


#: Quotas of the three sources of c03, in their order.
_SOURCES = {"open-thoughts": V.QUOTAS_V3, "open-r1": {"math": 30}, "magpie": {"reasoning": 20, "data-analysis": 20, "information-seeking": 10}}
_MAGPIE_LIMIT = 30_000
# All pairs in three dresses: as they are; as solved problems that state an answer; as rewarded rows of a category.
_R1 = f"(SELECT ord, user, '**Solution:** ' || assistant || chr(10) || 'The answer is ' || ord AS assistant FROM {_BY_TURNS})"
_MAG = f"(SELECT ord, user || ' (' || ord % 7 || ')' AS user, 'Step 1: ' || assistant AS assistant, ['reasoning', 'data-analysis', 'information-seeking', 'other'][ord % 4 + 1] AS category, ord % 50 / 50.0 AS reward FROM {_BY_TURNS} ORDER BY ord LIMIT {_MAGPIE_LIMIT})"
_FOUND = {"open-thoughts": R.candidates(_BY_TURNS, "open-thoughts"), "open-r1": R.candidates(_R1, "open-r1", category="'math'", marked=False, thoughts=False), "magpie": R.candidates(_MAG, "magpie", category="category", reward=0.18, thoughts=False)}


def _dressed(spark, sf_dir):
    """The candidates of the three sources, and the rows that each reads."""
    p = _pairs(spark, sf_dir)
    solved = p.withColumn("assistant", F.concat(F.lit("**Solution:** "), "assistant", F.lit("\nThe answer is "), "ord"))
    kinds = F.array(*map(F.lit, ("reasoning", "data-analysis", "information-seeking", "other")))
    rated = p.select("ord", F.concat("user", F.lit(" ("), F.col("ord") % 7, F.lit(")")).alias("user"), F.concat(F.lit("Step 1: "), "assistant").alias("assistant"), kinds[(F.col("ord") % 4).cast("int")].alias("category"), (F.col("ord") % 50 / 50).alias("reward"))
    found = {
        "open-thoughts": candidates(p, "open-thoughts"), "open-r1": candidates(solved, "open-r1", category=F.lit("math"), marked=False, thoughts=False),
        "magpie": candidates(rated, "magpie", category=F.col("category"), reward=0.18, limit=_MAGPIE_LIMIT, thoughts=False),
    }
    return found, {s: (p, _MAGPIE_LIMIT if s == "magpie" else None) for s in found}


def _mixed(spark, found):
    return merged([(chosen(d, s, quota_table(spark, _SOURCES[s])), list(_SOURCES[s])) for s, d in found.items()])


_MERGED = R.merged({s: (R.chosen(sql, s, _SOURCES[s]), list(_SOURCES[s])) for s, sql in _FOUND.items()})


@query(f"SELECT {_FIELDS} FROM ({_MERGED})")
def c03_curation_sources(spark, sf_dir):
    return _mixed(spark, _dressed(spark, sf_dir)[0]).select(*_FIELDS.split(", "))


@query(f"WITH m AS ({_MERGED}) SELECT 'source' AS part, source AS name, count(*) AS n FROM m GROUP BY 2 UNION ALL SELECT 'category', category, count(*) FROM m GROUP BY 2"
       + "".join(f" UNION ALL SELECT 'accepted', '{s}/' || category, count(*) FROM ({sql}) GROUP BY 2 UNION ALL SELECT 'scanned', '{s}', least(count(*), {_MAGPIE_LIMIT + 1 if s == 'magpie' else 'count(*)'}) FROM {_BY_TURNS}" for s, sql in _FOUND.items()))
def c04_curation_manifest(spark, sf_dir):
    found, rows = _dressed(spark, sf_dir)
    return manifest(_mixed(spark, found), found, rows)
