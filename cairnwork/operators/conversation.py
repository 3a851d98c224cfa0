"""Conversations: first pairs, role checks, rendering to ids and masks, request checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import SPECIAL_TOKENS
from .ranks import cut


def first_pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, user, assistant) of conversations whose first two turns are user and assistant.

    Only turns 0 and 1 are read, in partial aggregates, so a hot conversation isn't gathered. A turn without text is a
    turn: its side is null.
    """
    at = lambda n, role: (F.col("turn") == n) & (F.col("role") == role)
    pick = lambda n, role: F.max(F.when(at(n, role), F.col("text"))).alias(role)
    there = [F.bool_or(at(n, role)).alias(f"{role}_there_") for n, role in ((0, "user"), (1, "assistant"))]
    g = turns.where("turn IN (0, 1)").groupBy("conv_id").agg(pick(0, "user"), pick(1, "assistant"), *there)
    return g.where("user_there_ AND assistant_there_").drop("user_there_", "assistant_there_")


def nested(turns: DataFrame) -> DataFrame:
    """(conv_id, messages) with messages in order of their turns."""
    m = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return turns.groupBy("conv_id").agg(F.transform(m, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def alternates(messages: Column, system: bool = True, least: int = 2) -> Column:
    """User and assistant in turn, after a leading system message if allowed, least messages or more."""
    rest = F.when((F.element_at(messages, 1)["role"] == "system") & F.lit(system), F.slice(messages, 2, F.size(messages))).otherwise(messages)
    return (F.size(rest) >= least) & F.forall(F.transform(rest, lambda x, i: x["role"] == F.when(i % 2 == 0, "user").otherwise("assistant")), lambda b: b)


def merged_system(messages: Column) -> Column:
    """A leading system message put before the first user message, with an empty line between."""
    first, second = F.element_at(messages, 1), F.get(messages, F.lit(1))
    head = F.struct(second["role"].alias("role"), F.concat(first["content"], F.lit("\n\n"), second["content"]).alias("content"))
    return F.when(first["role"] == "system", F.concat(F.array(head), F.slice(messages, 3, F.size(messages)))).otherwise(messages)


def special_id(name: str, base: int = 256) -> int:
    return base + SPECIAL_TOKENS.index(name)


def byte_ids(text: Column) -> Column:
    """A text's bytes as ids, natively; a byte of a binary is found in constant time."""
    raw = text.cast("binary")
    n = F.octet_length(raw)
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n)), lambda i: F.conv(F.hex(F.substr(raw, i, F.lit(1))), 16, 10).cast("int")))


def render(messages: Column, most: int = 2048, ids=byte_ids) -> Column:
    """(ids, mask) of a conversation: bos, then each message between its marks; mask 1 on what the assistant writes."""
    mark = lambda n: F.lit(special_id(n))

    def of(m: Column) -> Column:
        own = ids(m["content"])
        user = F.concat(F.array(mark("<|user_start|>")), own, F.array(mark("<|user_end|>")))
        assistant = F.concat(F.array(mark("<|assistant_start|>")), own, F.array(mark("<|assistant_end|>")))
        by_user = m["role"] == "user"
        zeros = F.array_repeat(F.lit(0), F.size(user))
        ones = F.concat(F.array(F.lit(0)), F.array_repeat(F.lit(1), F.size(own) + 1))
        return F.struct(F.when(by_user, user).otherwise(assistant).alias("ids"), F.when(by_user, zeros).otherwise(ones).alias("mask"))

    parts = F.transform(merged_system(messages), of)

    def joined(p: Column) -> Column:
        flat = lambda c: F.flatten(F.transform(p, lambda x: x[c]))
        return F.struct(F.slice(F.concat(F.array(mark("<|bos|>")), flat("ids")), 1, most).alias("ids"), F.slice(F.concat(F.array(F.lit(0)), flat("mask")), 1, most).alias("mask"))

    return F.transform(F.array(parts), joined)[0]


def render_for_completion(messages: Column, most: int = 2048, ids=byte_ids) -> Column:
    """ids up to the place where the assistant is to answer; its last message is left out."""
    r = render(F.slice(messages, 1, F.greatest(F.lit(1), F.size(messages) - 1)), most, ids)
    return F.concat(r["ids"], F.array(F.lit(special_id("<|assistant_start|>"))))


def shifted(ids: Column, mask: Column) -> Column:
    """(inputs, targets): targets are the next ids, -1 where the mask is 0."""
    n = F.size(ids)
    targets = F.zip_with(F.slice(ids, 2, n), F.slice(mask, 2, n), lambda t, m: F.when(m == 0, -1).otherwise(t))
    return F.struct(F.slice(ids, 1, F.greatest(F.lit(0), n - 1)).alias("inputs"), targets.alias("targets"))


def request_problem(messages: Column, temperature: Column, top_k: Column, max_tokens: Column) -> Column:
    """The first thing wrong with a chat request, or null."""
    total = F.aggregate(messages, F.lit(0), lambda a, m: a + F.length(m["content"]))
    checks = [
        (F.size(messages).between(1, 500), "messages"),
        (F.forall(messages, lambda m: F.length(m["content"]).between(1, 8000)), "message length"),
        (total <= 32000, "total length"),
        (F.forall(messages, lambda m: m["role"].isin("user", "assistant")), "role"),
        (F.coalesce(temperature.between(0.0, 2.0), F.lit(True)), "temperature"),
        (F.coalesce(top_k.between(0, 200), F.lit(True)), "top_k"),
        (F.coalesce(max_tokens.between(1, 4096), F.lit(True)), "max_tokens"),
    ]
    return F.coalesce(*[F.when(~ok, F.lit(name)) for ok, name in checks])


def violations(rows: DataFrame, categories: list[str], qualities: tuple[str, ...] = ("high", "medium"), line: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, problem) for every rule that a curated row breaks; rows (id, source, teacher_model, category, quality, messages).

    line: a column with the rows' order; of rows that share an id or a first user turn all but the first are reported, by
    default in the order of ids, sources and contents. carry: more columns of the rows to return. Every message counts: user ones are the first, third, ...
    """
    from ..functions import text as X
    from ..functions.values import THINKING_ALOUD

    blank = lambda c: F.coalesce(X.normalize_text(F.col(c)) == "", F.lit(True))
    side = lambda k, of: F.exists(F.transform("messages", lambda m, i: (i % 2 == k) & of(m["content"])), lambda b: b)
    checks = [
        (blank("id"), "blank id"), (blank("source"), "blank source"), (blank("teacher_model"), "blank teacher"),
        (~F.coalesce(F.col("category").isin(*categories), F.lit(False)), "category"), (~F.coalesce(F.col("quality").isin(*qualities), F.lit(False)), "quality"),
        (~F.coalesce(F.size("messages").between(2, 4), F.lit(False)), "turns"), (~alternates(F.col("messages"), system=False), "roles"),
        (F.exists("messages", lambda m: F.coalesce(X.normalize_text(m["content"]) == "", F.lit(True))), "empty turn"), (F.exists("messages", lambda m: m["content"].contains("```")), "fence"),
        (side(0, lambda c: X.word_count(c) > 180), "user words"), (side(1, lambda c: X.word_count(c) > 220), "assistant words"), (side(1, lambda c: X.has_any(F.lower(c), THINKING_ALOUD)), "thinks aloud"),
    ]
    found = F.filter(F.array(*[F.when(bad, F.lit(name)) for bad, name in checks]), lambda x: x.isNotNull())
    out = rows.select("id", *carry, F.explode(found).alias("problem"))
    place = F.struct(*([line] if line else ["id", "source", F.to_json("messages")]), F.monotonically_increasing_id().alias("tie_"))
    first_turn = F.lower(X.normalize_text(F.element_at("messages", 1)["content"]))
    keyed = cut(rows.select("id", *carry, F.col("id").alias("by_id_"), F.xxhash64(first_turn).alias("by_turn_"), first_turn.alias("turn_"), place.alias("at_")))  # ties are broken alike below
    for keys, problem in ((["by_id_"], "duplicate id"), (["by_turn_", "turn_"], "duplicate user turn")):
        first = keyed.groupBy(*keys).agg(F.min("at_").alias("first_"), F.count("*").alias("n_")).where("n_ > 1").select(*keys, "first_")
        out = out.unionByName(keyed.join(first, keys).where("at_ > first_").select("id", *carry, F.lit(problem).alias("problem")))
    return out
