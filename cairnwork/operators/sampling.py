"""Next tokens drawn from logits: greedy, by temperature, among the k greatest; seeded, native, one draw for each row and sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform(seed: Column, *keys: Column) -> Column:
    """A number between 0 and 1, neither included, from a seed and keys: of the same, the same on any cluster."""
    h = F.sha1(F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in (seed, *keys)]).cast("binary"))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def greatest_logits(logits: Column, top_k: int | None = None) -> Column:
    """(logit, token) of the top_k greatest logits, of equals the first tokens, in falling order; all of them without top_k.

    Nulls and NaN are no logits.
    """
    pairs = F.filter(F.transform(logits, lambda x, i: F.struct((-x.cast("double")).alias("low"), i.alias("token"))), lambda p: p["low"].isNotNull() & ~F.isnan(p["low"]))
    found = F.array_sort(pairs)
    return F.transform(F.slice(found, 1, top_k) if top_k else found, lambda p: F.struct((-p["low"]).alias("logit"), p["token"].alias("token")))


def next_token(logits: Column, seed: Column, *keys: Column, temperature: float = 1.0, top_k: int | None = None) -> Column:
    """A token drawn with the probabilities softmax(logits / temperature), among the top_k greatest if given; null without a logit.

    Each logit gets a Gumbel number of its own from the seed, the keys and its token, and the greatest sum wins: that
    is a draw with these probabilities. A temperature of 0 takes the greatest logit, the first of equals. top_k of 0 or None is all.
    """
    if temperature < 0:
        raise ValueError("the temperature is below 0")
    if temperature == 0:
        return F.get(greatest_logits(logits, 1), F.lit(0))["token"]
    noise = lambda t: -F.log(-F.log(uniform(seed, *keys, t)))
    drawn = F.transform(greatest_logits(logits, top_k), lambda p: F.struct((p["logit"] / temperature + noise(p["token"])).alias("score"), (-p["token"]).alias("low")))
    return (-F.array_max(drawn)["low"]).cast("int")


def samples(rows: DataFrame, idx: str, logits: str, n: int = 1, seed: int = 42, step: Column | None = None, temperature: float = 1.0, top_k: int | None = None) -> DataFrame:
    """(idx, sample, token): n draws for each row, each of its own; step is one more key, as the place in a sequence.

    Rows are drawn from where they are, without a shuffle. A null id is an id; rows that share one draw alike.
    """
    keys = [F.col(idx), F.col("sample"), step if step is not None else F.lit(0)]
    d = rows.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return d.select(idx, "sample", next_token(F.col(logits), F.lit(seed), *keys, temperature=temperature, top_k=top_k).alias("token"))
