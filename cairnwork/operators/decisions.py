"""Decisions on runs: promotion, gates, choice of a champion, comparison of candidates, costs and schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import PEAK_FLOPS

# Dollars an hour of one device whose name holds the word; any other costs the default.
DEVICE_RATES = (("H100", 3.00), ("A100", 1.79), ("V100", 0.55))
DEFAULT_RATE = 2.0


def promotion(runs: DataFrame, group: str, gsm: float = 4.0, mmlu: float = 27.0, least: int = 2) -> DataFrame:
    """promote, hold or failed for each group of runs (status, gsm8k_pass8, mmlu)."""
    full = F.col("status") == "full_confirm"
    good = full & (F.col("gsm8k_pass8") >= gsm) & (F.col("mmlu") >= mmlu)
    g = runs.groupBy(group).agg(F.count_if(good).alias("good"), F.count_if(full).alias("full"))
    return g.select(group, "good", "full", F.when(F.col("good") >= least, "promote").when(F.col("full") > 0, "hold").otherwise("failed").alias("decision"))


def quick_gate(mmlu: Column, least: float, pass1: Column | None = None) -> Column:
    ok = mmlu.isNotNull() & ~F.isnan(mmlu) & (mmlu >= least)
    ok = ok if pass1 is None else ok & (pass1 > 0)
    return F.coalesce(ok, F.lit(False))


def loss_gate(best: Column, most: float) -> Column:
    return F.coalesce(best <= most, F.lit(False))


def stability(checks: dict[str, Column]) -> tuple[Column, Column]:
    """(GO or NO_GO, names of failed checks)."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in checks.items()]), lambda x: x.isNotNull())
    return F.when(F.size(failed) == 0, "GO").otherwise("NO_GO"), failed


def against_reference(score: Column, reference: Column, promote: float, fail: float) -> Column:
    return F.when(score >= reference + promote, "promote").when(score <= reference - fail, "hard_fail").otherwise("hold")


def weighted_score(gsm: Column, mmlu: Column, spelling: Column) -> Column:
    return 3 * gsm + mmlu + 0.5 * spelling


def sweep_gate(best: Column, control: Column, margin: float, fallback: float = 22.5) -> Column:
    return best >= F.coalesce(control, F.lit(fallback)) + margin


def champion(manual: Column, fixed: Column, tested: Column) -> Column:
    """A manual choice, else a fixed one, else the tested."""
    return F.coalesce(F.nullif(manual, F.lit("")), F.nullif(fixed, F.lit("")), tested)


def first_passing(options: DataFrame, group: str, order: str, ok: Column, label: str) -> DataFrame:
    """The first option in order that passes, for each group; null if none does."""
    return options.groupBy(group).agg(F.min_by(F.when(ok, F.col(label)), F.when(ok, F.col(order))).alias("chosen"))


def rebalanced(quotas: dict[str, int], target: int, into: str = "reasoning") -> dict[str, int]:
    """Quotas with the difference to the target put into one category, which never falls below 0."""
    gap = target - sum(quotas.values())
    return quotas | {into: max(0, quotas.get(into, 0) + gap)}


def hourly_cost(name: Column, count: Column) -> Column:
    rate = F.coalesce(*[F.when(name.contains(word), F.lit(r)) for word, r in DEVICE_RATES], F.lit(DEFAULT_RATE))
    return rate * count


def target_step(ratio: Column, parameters: int, batch: int) -> Column:
    """Steps that give as many tokens a parameter."""
    return F.floor(F.floor(ratio * parameters) / batch)


def batch_rate_scale(batch: Column, base: float) -> Column:
    return F.sqrt(batch / base)


def peak_flops(name: Column) -> Column:
    """BF16 operations a second of a device by its name; infinite for a name that isn't known, so utilisation shows as 0."""
    low = F.lower(name)
    fits = lambda words: F.forall(F.array(*[F.lit(w) for w in words]), lambda w: low.contains(w))
    return F.coalesce(*[F.when(fits(words), F.lit(float(rate))) for words, rate in PEAK_FLOPS], F.lit(float("inf")))


def model_flops(parameters: Column, left_out: Column, heads: Column, width: Column, length: Column, windows: Column) -> Column:
    """Operations a token, forward and backward: six a matrix parameter and 12 heads * width * seen length for each layer.

    left_out: parameters of embeddings and scalars. windows: what each layer sees to the left, below 0 for the whole length.
    """
    seen = F.aggregate(windows, F.lit(0).cast("long"), lambda a, w: a + F.when(w < 0, length).otherwise(F.least(w, length)).cast("long"))
    return 6 * (parameters - left_out) + 12 * heads * F.floor(width / heads) * seen


def throughput(tokens: Column, milliseconds: Column) -> Column:
    return (tokens / (milliseconds / 1000)).cast("long")


def utilisation(flops_per_token: Column, tokens_per_second: Column, peak: Column) -> Column:
    return 100 * flops_per_token * tokens_per_second / peak
