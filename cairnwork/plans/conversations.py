"""Queries over conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from ..operators import contents as T
from ..operators import conversation as C
from . import rules_sql as R
from .corpus import _any, _norm, _words
from .registry import query, read

_PAIRS = "(SELECT u.conv_id, u.text AS user, a.text AS assistant FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND u.turn = 0 AND a.turn = 1 AND u.role = 'user' AND a.role = 'assistant')"


@query(f"SELECT conv_id, length(user) AS user_chars, length(assistant) AS assistant_chars FROM {_PAIRS}")
def f06_first_pairs(spark, sf_dir):
    p = C.first_pairs(read(spark, sf_dir, "conversations"))
    return p.select("conv_id", F.length("user").cast("long").alias("user_chars"), F.length("assistant").cast("long").alias("assistant_chars"))


_NORMAL = f"(SELECT conv_id, {_norm('user')} AS user, {_norm('assistant')} AS assistant FROM {_PAIRS})"


@query(f"SELECT conv_id FROM {_NORMAL} WHERE length(user) BETWEEN 40 AND 800 AND length(assistant) BETWEEN 40 AND 1600 AND NOT {_any('lower(user)', V.BANNED_V1)}")
def f07_f11_valid_pairs_v1(spark, sf_dir):
    p = C.first_pairs(read(spark, sf_dir, "conversations"))
    return p.where(X.valid_pair(F.col("user"), F.col("assistant"), "v1")).select("conv_id")


@query(f"SELECT conv_id FROM {_NORMAL} WHERE length(user) BETWEEN 40 AND 900 AND length(assistant) BETWEEN 40 AND 2200 AND NOT {_any('lower(user)', V.CODE_V2)}")
def f08_f11_valid_pairs(spark, sf_dir):
    p = C.first_pairs(read(spark, sf_dir, "conversations"))
    return p.where(X.valid_pair(F.col("user"), F.col("assistant"), "v2")).select("conv_id")


def _distilled(chars: int, words: int) -> str:
    return f"""SELECT conv_id FROM {_PAIRS} WHERE length(user) BETWEEN 35 AND 650 AND length(assistant) BETWEEN 35 AND {chars} AND {_words('assistant')} <= {words} AND length(assistant) - length(replace(assistant, chr(10), '')) <= 2
    AND NOT {_any('lower(user)', V.CODE_DISTILLED)} AND NOT {_any('lower(user)', [w for w in V.MULTIPLE_CHOICE if chr(10) not in w])} AND NOT regexp_matches(lower(user), '\\n[abcd]\\.') AND NOT {_any('lower(assistant)', V.THINKING_ALOUD)}
    AND NOT regexp_full_match(trim(lower(assistant)), '(answer:\\s*)?[a-d][.]?')"""


@query(_distilled(850, 130))
def f10_valid_pairs_distilled_v2(spark, sf_dir):
    p = C.first_pairs(read(spark, sf_dir, "conversations"))
    return p.where(X.valid_pair(F.col("user"), F.col("assistant"), "distilled2")).select("conv_id")


@query(_distilled(700, 110))
def f10_valid_pairs_distilled(spark, sf_dir):
    p = C.first_pairs(read(spark, sf_dir, "conversations"))
    return p.where(X.valid_pair(F.col("user"), F.col("assistant"), "distilled")).select("conv_id")


@query(f"SELECT conv_id, assistant AS answer, conv_id IN (SELECT conv_id FROM {R.valid(_PAIRS, 'v3')}) AS valid FROM {R.answers(_PAIRS, 'assistant', True)}")
def f09_x07_teacher_answers(spark, sf_dir):
    p = C.first_pairs(read(spark, sf_dir, "conversations"))
    answer = X.teacher_answer(F.col("assistant"))
    return p.select("conv_id", answer.alias("answer"), X.valid_pair(F.col("user"), F.col("assistant")).alias("valid"))


@query("""SELECT conv_id, bool_and(role = CASE WHEN (turn - s) % 2 = 0 THEN 'user' ELSE 'assistant' END) AND count(*) >= 2 AS ok FROM
    (SELECT *, max(CASE WHEN turn = 0 AND role = 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS s FROM conversations) WHERE NOT (turn = 0 AND role = 'system') GROUP BY 1""")
def f14_alternation(spark, sf_dir):
    n = C.nested(read(spark, sf_dir, "conversations"))
    return n.select("conv_id", C.alternates(F.col("messages")).alias("ok"))


@query("SELECT avg_words FROM (SELECT coalesce(round(avg(len(regexp_extract_all(text, '\\S+'))), 1), 0.0) AS avg_words FROM (SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY 1))")
def a03_assistant_words(spark, sf_dir):
    last = read(spark, sf_dir, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))
    return last.agg(F.coalesce(F.bround(F.avg(X.word_count(F.col("text"))), 1), F.lit(0.0)).alias("avg_words"))


# Ids and mask of a conversation as text: a leading system turn joins the first user turn; 256 to 260 are the marks.
_BYTES = "list_transform(range(1, octet_length(encode(t)) + 1), lambda i: CAST(('0x' || hex(encode(t))[2 * i - 1:2 * i]) AS INT))"
_TURNS = """(SELECT conv_id, turn, role, CASE WHEN role = 'user' AND s IS NOT NULL AND turn = 1 THEN s || chr(10) || chr(10) || text ELSE text END AS t FROM
    (SELECT *, max(CASE WHEN turn = 0 AND role = 'system' THEN text END) OVER (PARTITION BY conv_id) AS s FROM conversations) WHERE NOT (turn = 0 AND role = 'system'))"""
_ASCII_TURNS = _TURNS.replace("FROM conversations)", "FROM (SELECT conv_id, turn, role, regexp_replace(text, '[^ -~]', '', 'g') AS text FROM conversations))")
_RENDERED = f"""(SELECT conv_id, list_prepend(256, flatten(list(CASE WHEN role = 'user' THEN list_append(list_prepend(257, b), 258) ELSE list_append(list_prepend(259, b), 260) END ORDER BY turn))) AS ids,
    list_prepend(0, flatten(list(CASE WHEN role = 'user' THEN list_transform(range(len(b) + 2), lambda i: 0) ELSE list_prepend(0, list_transform(range(len(b) + 1), lambda i: 1)) END ORDER BY turn))) AS mask
    FROM (SELECT *, {_BYTES} AS b FROM {_TURNS}) GROUP BY 1)"""


def _digest(ids) -> F.Column:
    return F.md5(F.array_join(ids, ",").cast("binary"))


@query(f"SELECT conv_id, md5(array_to_string(ids, ',')) AS ids, md5(array_to_string(mask, ',')) AS mask, len(ids)::BIGINT AS n_ids FROM {_RENDERED}")
def q09_render(spark, sf_dir):
    n = C.nested(read(spark, sf_dir, "conversations"))
    r = n.select("conv_id", C.render(F.col("messages"), most=10_000_000).alias("r"))
    return r.select("conv_id", _digest("r.ids").alias("ids"), _digest("r.mask").alias("mask"), F.size("r.ids").cast("long").alias("n_ids"))


# Every third conversation's assistant speaks in a text, a call, its output; the next one's in calls alone. 261 to 264 are the marks.
_PARTED = f"""(SELECT conv_id, turn, CASE WHEN role = 'user' THEN list_append(list_prepend(257, b), 258)
        WHEN conv_id % 3 = 0 THEN flatten([[259], b[1:n], [261], b[n + 1:2 * n], [262, 263], b[2 * n + 1:], [264, 260]])
        WHEN conv_id % 3 = 1 THEN flatten([[259, 261], b, [262, 260]]) ELSE list_append(list_prepend(259, b), 260) END AS ids,
      list_transform(CASE WHEN role = 'user' THEN range(len(b) + 2) WHEN conv_id % 3 = 0 THEN range(len(b) + 6) WHEN conv_id % 3 = 1 THEN range(len(b) + 4) ELSE range(len(b) + 2) END,
        lambda i: (CASE WHEN role = 'user' OR i = 0 THEN 0 WHEN conv_id % 3 = 0 THEN CASE WHEN i <= 2 * n + 2 OR i = len(b) + 5 THEN 1 ELSE 0 END ELSE 1 END)) AS mask
    FROM (SELECT conv_id, turn, role, {_BYTES} AS b, octet_length(encode(t)) // 3 AS n FROM {_ASCII_TURNS}))"""


def _with_parts(spark, sf_dir):
    """Typed messages of the conversations' ASCII, read back from JSON whose contents are texts and lists of parts."""
    n = C.nested(read(spark, sf_dir, "conversations").withColumn("text", F.regexp_replace("text", "[^ -~]", "")))
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))

    def json(m):
        text = m["content"]
        k = F.floor(F.length(text) / 3).cast("int")
        three = F.array(part("text", F.substr(text, F.lit(1), k)), part("python", F.substr(text, k + 1, k)), part("python_output", F.substr(text, 2 * k + 1)))
        of = lambda c: F.to_json(F.struct(m["role"].alias("role"), c.alias("content")))
        own = F.when(F.col("conv_id") % 3 == 0, of(three)).when(F.col("conv_id") % 3 == 1, of(F.array(part("python", text)))).otherwise(of(text))
        return F.when(m["role"] == "assistant", own).otherwise(of(text))

    line = F.concat(F.lit('{"messages":['), F.array_join(F.transform("messages", json), ","), F.lit("]}"))
    return n.select("conv_id", T.typed_messages(line).alias("messages"))


@query(f"""SELECT conv_id, md5(array_to_string(list_prepend(256, flatten(list(ids ORDER BY turn))), ',')) AS ids, md5(array_to_string(list_prepend(0, flatten(list(mask ORDER BY turn))), ',')) AS mask FROM {_PARTED} GROUP BY 1""")
def q09_render_parts(spark, sf_dir):
    r = _with_parts(spark, sf_dir).select("conv_id", T.render_typed(T.checked(F.col("messages")), most=10_000_000).alias("r"))
    return r.select("conv_id", _digest("r.ids").alias("ids"), _digest("r.mask").alias("mask"))


@query(f"""SELECT conv_id, md5(array_to_string(list_append((list_prepend(256, flatten(list(ids ORDER BY turn) FILTER (turn < final))))[1:2048], 259), ',')) AS ids
    FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS final FROM {_PARTED}) JOIN (SELECT conv_id, arg_max(role, turn) AS last FROM conversations GROUP BY 1) USING (conv_id) WHERE last = 'assistant' GROUP BY conv_id""")
def q10_render_parts_for_completion(spark, sf_dir):
    d = _with_parts(spark, sf_dir).where(F.element_at("messages", -1)["role"] == "assistant")
    return d.select("conv_id", _digest(T.render_typed_for_completion(F.col("messages"))).alias("ids"))


@query(f"""SELECT conv_id, md5(array_to_string(list_append((ids[1:len(ids) - octet_length(encode(final)) - 2])[1:2048], 259), ',')) AS ids
    FROM {_RENDERED} JOIN (SELECT conv_id, arg_max(role, turn) AS last, arg_max(t, turn) AS final FROM {_TURNS} GROUP BY 1) USING (conv_id) WHERE last = 'assistant'""")
def q10_render_for_completion(spark, sf_dir):
    n = C.nested(read(spark, sf_dir, "conversations")).where(F.element_at("messages", -1)["role"] == "assistant")
    return n.select("conv_id", _digest(C.render_for_completion(F.col("messages"))).alias("ids"))


@query(f"""SELECT conv_id, md5(array_to_string(ids[1:len(ids) - 1], ',')) AS inputs, md5(array_to_string(list_transform(range(2, len(ids) + 1), lambda i: CASE WHEN mask[i] = 0 THEN -1 ELSE ids[i] END), ',')) AS targets
    FROM (SELECT conv_id, ids[1:2048] AS ids, mask[1:2048] AS mask FROM {_RENDERED})""")
def m09_shifted_targets(spark, sf_dir):
    n = C.nested(read(spark, sf_dir, "conversations")).select("conv_id", C.render(F.col("messages")).alias("r"))
    s = n.select("conv_id", C.shifted(F.col("r.ids"), F.col("r.mask")).alias("s"))
    return s.select("conv_id", _digest("s.inputs").alias("inputs"), _digest("s.targets").alias("targets"))


#: Categories of the rows that f13 makes of conversations.
_KINDS = ("reasoning", "math", "safety")


@query(f"""WITH c AS (SELECT conv_id, 'c' || conv_id % 90 AS id, list(role ORDER BY turn) AS r, list(text ORDER BY turn) AS t FROM conversations GROUP BY conv_id),
    k AS (SELECT *, CASE conv_id % 4 WHEN 0 THEN 'reasoning' WHEN 1 THEN 'math' WHEN 2 THEN 'safety' ELSE 'odd' END AS kind, CASE WHEN conv_id % 5 = 0 THEN 'low' ELSE 'high' END AS quality,
        list_filter(t, lambda x, i: i % 2 = 1) AS u, list_filter(t, lambda x, i: i % 2 = 0) AS a, {_norm('lower(t[1])')} AS first FROM c)
    SELECT conv_id, problem FROM (SELECT conv_id, unnest([
        CASE WHEN kind = 'odd' THEN 'category' END, CASE WHEN quality = 'low' THEN 'quality' END, CASE WHEN len(t) NOT BETWEEN 2 AND 4 THEN 'turns' END,
        CASE WHEN len(t) < 2 OR len(list_filter(r, lambda x, i: x <> CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END)) > 0 THEN 'roles' END,
        CASE WHEN len(list_filter(u, lambda x: {_words('x')} > 180)) > 0 THEN 'user words' END, CASE WHEN len(list_filter(a, lambda x: {_words('x')} > 220)) > 0 THEN 'assistant words' END,
        CASE WHEN len(list_filter(a, lambda x: {_any('lower(x)', V.THINKING_ALOUD)})) > 0 THEN 'thinks aloud' END, CASE WHEN len(list_filter(t, lambda x: contains(x, '```'))) > 0 THEN 'fence' END,
        CASE WHEN row_number() OVER (PARTITION BY id ORDER BY conv_id) > 1 THEN 'duplicate id' END, CASE WHEN row_number() OVER (PARTITION BY first ORDER BY conv_id) > 1 THEN 'duplicate user turn' END]) AS problem FROM k) WHERE problem IS NOT NULL""")
def f13_violations(spark, sf_dir):
    n = C.nested(read(spark, sf_dir, "conversations"))
    kind = F.coalesce(*[F.when(F.col("conv_id") % 4 == k, F.lit(c)) for k, c in enumerate(_KINDS)], F.lit("odd"))
    one = F.struct("conv_id", F.concat(F.lit("c"), F.col("conv_id") % 90).alias("id"))
    rows = n.select(one.alias("id_"), F.lit("s").alias("source"), F.lit("t").alias("teacher_model"), kind.alias("category"), F.when(F.col("conv_id") % 5 == 0, "low").otherwise("high").alias("quality"), "messages", "conv_id")
    out = C.violations(rows.select("*", F.col("id_.id").alias("id")).drop("id_"), list(_KINDS), line="conv_id", carry=("conv_id",))
    return out.select("conv_id", "problem")


@query("SELECT conv_id, CASE WHEN bool_or(role NOT IN ('user', 'assistant')) THEN 'role' END AS problem FROM conversations GROUP BY 1")
def f15_request_checks(spark, sf_dir):
    n = C.nested(read(spark, sf_dir, "conversations"))
    null = F.lit(None)
    return n.select("conv_id", C.request_problem(F.col("messages"), null.cast("double"), null.cast("int"), null.cast("int")).alias("problem"))
