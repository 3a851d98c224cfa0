"""Conversations whose contents are texts or lists of typed parts: read as variants, checked, rendered to ids and masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .conversation import byte_ids, special_id

#: A message: text is a content that is a string, parts one that is a list; the other is null, and both for any other content.
TYPED = "array<struct<role:string,text:string,parts:array<struct<type:string,text:string>>>>"
#: The marks around a part of each type, and whether its tokens are learned.
PARTS = {"text": (None, None, 1), "python": ("<|python_start|>", "<|python_end|>", 1), "python_output": ("<|output_start|>", "<|output_end|>", 0)}


def typed_messages(json: Column) -> Column:
    """TYPED from JSON: an array of messages, or an object that has it as `messages`; null if it is neither or no JSON."""
    v = F.try_parse_json(json)
    found = F.coalesce(F.try_variant_get(v, "$.messages", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"))
    part = lambda p: F.struct(F.try_variant_get(p, "$.type", "string").alias("type"), F.try_variant_get(p, "$.text", "string").alias("text"))

    def message(m: Column) -> Column:
        content = F.try_variant_get(m, "$.content", "variant")
        text = F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get(content, "$", "string"))
        return F.struct(F.try_variant_get(m, "$.role", "string").alias("role"), text.alias("text"), F.transform(F.try_variant_get(content, "$", "array<variant>"), part).alias("parts"))

    return F.transform(found, message)


def plain_messages(messages: Column) -> Column:
    """TYPED from messages (role, content) of texts alone."""
    return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("text"), F.lit(None).cast("array<struct<type:string,text:string>>").alias("parts")))


def problem(messages: Column) -> Column:
    """What keeps typed messages from being rendered, or null.

    A leading system message must be a text and be followed by a user's text, which it joins. There must be a message
    besides; user and assistant speak in turn, the user in texts, the assistant in texts or parts of known types with a text each.
    """
    lead = F.coalesce(F.get(messages, F.lit(0))["role"] == "system", F.lit(False))
    second = F.get(messages, F.lit(1))
    rest = F.when(lead, F.slice(messages, 2, F.size(messages))).otherwise(messages)
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("nobody")) for p in parts])

    def of(m: Column, i: Column) -> Column:
        due = F.when(i % 2 == 0, "user").otherwise("assistant")
        unknown = F.filter(m["parts"], lambda p: ~F.coalesce(p["type"].isin(list(PARTS)), F.lit(False)) | p["text"].isNull())
        return (
            F.when(~F.coalesce(m["role"] == due, F.lit(False)), say("message ", i, " is from ", m["role"], ", not from ", due))
            .when((due == "user") & m["text"].isNull(), say("message ", i, " of the user is no text"))
            .when(m["text"].isNull() & m["parts"].isNull(), say("message ", i, " is neither text nor parts"))
            .when(F.size(unknown) > 0, say("message ", i, " has a part of type ", F.get(unknown, F.lit(0))["type"], " or without text"))
        )

    found = F.filter(F.transform(rest, of), lambda x: x.isNotNull())
    return (
        F.when(messages.isNull(), "no messages")
        .when(lead & ~F.coalesce(second["role"] == "user", F.lit(False)), "a system message isn't followed by a user's")
        .when(lead & F.get(messages, F.lit(0))["text"].isNull(), "a system message is no text")
        .when(F.size(rest) == 0, "no messages")
        .otherwise(F.get(found, F.lit(0)))
    )


def checked(messages: Column) -> Column:
    """messages; the query fails with its problem() if it has one."""
    bad = problem(messages)
    return F.when(bad.isNull(), messages).otherwise(F.raise_error(bad).cast(TYPED))


def render_typed(messages: Column, most: int = 2048, ids=byte_ids) -> Column:
    """(ids, mask) of typed messages without a problem(), cut to the first `most`.

    Mask 1: the assistant's texts, its tool calls with their marks, and the mark of its end; what a tool puts out isn't learned.
    """
    mark = lambda n: F.array(F.lit(special_id(n)))
    run = lambda x, learned: F.struct(x.alias("ids"), F.lit(learned).alias("mask"))
    first, second = F.get(messages, F.lit(0)), F.get(messages, F.lit(1))
    joined = F.struct(second["role"].alias("role"), F.concat(first["text"], F.lit("\n\n"), second["text"]).alias("text"), second["parts"].alias("parts"))
    own = F.when(first["role"] == "system", F.concat(F.array(joined), F.slice(messages, 3, F.size(messages)))).otherwise(messages)

    def part(p: Column) -> Column:
        out = None
        for kind, (start, end, learned) in PARTS.items():
            body = run(ids(p["text"]), learned)
            runs = F.array(run(mark(start), learned), body, run(mark(end), learned)) if start else F.array(body)
            out = F.when(p["type"] == kind, runs) if out is None else out.when(p["type"] == kind, runs)
        return out

    def of(m: Column) -> Column:
        user = F.array(run(mark("<|user_start|>"), 0), run(ids(m["text"]), 0), run(mark("<|user_end|>"), 0))
        body = F.when(m["text"].isNotNull(), F.array(run(ids(m["text"]), 1))).otherwise(F.flatten(F.transform(m["parts"], part)))
        return F.when(m["role"] == "user", user).otherwise(F.concat(F.array(run(mark("<|assistant_start|>"), 0)), body, F.array(run(mark("<|assistant_end|>"), 1))))

    runs = F.concat(F.array(run(mark("<|bos|>"), 0)), F.flatten(F.transform(own, of)))

    def both(r: Column) -> Column:  # the runs are worked out once
        mask = F.flatten(F.transform(r, lambda x: F.array_repeat(x["mask"], F.size(x["ids"]))))
        return F.struct(F.slice(F.flatten(r["ids"]), 1, most).alias("ids"), F.slice(mask, 1, most).alias("mask"))

    return F.transform(F.array(runs), both)[0]


def render_typed_for_completion(messages: Column, most: int = 2048, ids=byte_ids) -> Column:
    """ids up to the place where the assistant is to answer; its last message is left out, and it is an error if the last isn't its own."""
    last = F.element_at(messages, -1)["role"]
    own = F.when(last == "assistant", F.slice(messages, 1, F.size(messages) - 1)).otherwise(F.raise_error(F.lit("the last message isn't from the assistant")).cast(TYPED))
    return F.concat(render_typed(own, most, ids)["ids"], F.array(F.lit(special_id("<|assistant_start|>"))))
