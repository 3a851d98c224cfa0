"""Arrays of token ids: common ends, padding, truncation, spans, option choice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def common_length(sequences: Column, from_end: bool = False) -> Column:
    """Tokens that all of an array of sequences share at their beginning, or at their end."""
    s = F.transform(sequences, F.reverse) if from_end else sequences
    shortest = F.array_min(F.transform(s, F.size))
    first = F.element_at(s, 1)

    def same_as_first(x: Column) -> Column:
        at = F.array_position(F.zip_with(F.slice(first, 1, shortest), F.slice(x, 1, shortest), lambda a, b: a == b), F.lit(False))
        return F.when(at > 0, at - 1).otherwise(shortest.cast("long"))

    return F.when(shortest == 0, F.lit(0).cast("long")).otherwise(F.array_min(F.transform(s, same_as_first)))


def padded(sequences: Column, pad: Column) -> Column:
    """Every sequence with pads at its end up to the longest."""
    longest = F.array_max(F.transform(sequences, F.size))
    return F.transform(sequences, lambda x: F.concat(x, F.array_repeat(pad, longest - F.size(x))))


def fit(ids: Column, start: Column, end: Column, most: int, policy: str = "skip") -> Column:
    """(ids, start, end) within most tokens, or null if the policy or a span cut off says so.

    truncate keeps the last tokens and moves the span along.
    """
    over = F.greatest(F.lit(0), F.size(ids) - most)
    kept = F.struct(F.slice(ids, over + 1, F.greatest(F.lit(1), F.size(ids))).alias("ids"), (start - over).alias("start"), (end - over).alias("end"))
    if policy == "truncate":
        return F.when((over == 0) | ((start - over >= 0) & (end - over > 0)), kept)
    if policy == "skip":
        return F.when(over == 0, kept)
    return F.when(over == 0, kept).otherwise(F.raise_error(F.concat(F.lit("sequence exceeds "), F.lit(str(most)), F.lit(" tokens"))))


def span_mean(losses: Column, start: Column, end: Column) -> Column:
    """Mean loss of predicting the tokens of [start, end); the prediction of a token stands one place before it."""
    part = F.slice(losses, F.greatest(F.lit(1), start), F.greatest(F.lit(0), end - start))
    return F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(part), F.lit(0))


def span_matches(predictions: Column, ids: Column, start: Column, end: Column) -> Column:
    """Whether the predictions of [start, end) are the tokens there."""
    n = F.greatest(F.lit(0), end - start)
    return F.slice(predictions, F.greatest(F.lit(1), start), n) == F.slice(ids, start + 1, n)


def least_option(losses: Column) -> Column:
    """The place from 0 of the least mean loss, the first of equals."""
    return (F.array_position(losses, F.array_min(losses)) - 1).cast("int")


def common_prompt(shots: Column, one, last: Column) -> Column:
    """Few-shot examples by one(example), an empty line after each, then the last part."""
    return F.concat(F.array_join(F.transform(shots, lambda x: F.concat(one(x), F.lit("\n\n"))), ""), last)


def prompts_choice(query: Column, choices: Column, shots: Column, delimiter: str | Column) -> Column:
    """A prompt for each choice of a multiple-choice item."""
    shot = lambda x: F.concat(x["query"], F.lit(delimiter), F.get(x["choices"], x["gold"]))
    return F.transform(choices, lambda c: common_prompt(shots, shot, F.concat(query, F.lit(delimiter), c)))


def prompts_schema(contexts: Column, continuation: Column, shots: Column, delimiter: str | Column) -> Column:
    """A prompt for each context of a schema item."""
    shot = lambda x: F.concat(F.get(x["context_options"], x["gold"]), F.lit(delimiter), x["continuation"])
    return F.transform(contexts, lambda c: common_prompt(shots, shot, F.concat(c, F.lit(delimiter), continuation)))


def prompts_continuation(context: Column, continuation: Column, shots: Column, delimiter: str | Column) -> Column:
    """[without, with the continuation] of a language-modelling item; contexts are trimmed, the first prompt stripped."""
    from .text import strip

    shot = lambda x: F.concat(strip(x["context"]), F.lit(delimiter), x["continuation"])
    head = common_prompt(shots, shot, F.concat(strip(context), F.lit(delimiter)))
    return F.array(strip(head), F.concat(head, continuation))


def token_view(pieces: Column, mask: Column, ids: Column | None = None) -> Column:
    """Tokens in terminal colours, parted by bars: green where the mask is 1, red elsewhere; with ids each in grey after it."""
    esc, grey = "\x1b[", "\x1b[90m"
    colour = lambda t, m: F.concat(F.when(m == 1, esc + "92m").otherwise(esc + "91m"), t, F.lit(esc + "0m"))
    out = F.zip_with(pieces, mask, colour)
    if ids is not None:
        out = F.zip_with(out, ids, lambda t, i: F.concat(t, F.lit("|" + grey + "("), i.cast("string"), F.lit(")" + esc + "0m")))
    return F.array_join(out, "|")
