"""The curation rules as DuckDB SQL, for the oracles: answers, valid pairs, classes, scores, quotas."""

from __future__ import annotations

from functools import reduce

from ..functions import values as V
from .corpus import _any, _norm, _words

_text = lambda s: "'" + s.replace("'", "''") + "'"
_strip = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def _without(c: str, beginnings) -> str:
    return reduce(lambda x, p: _strip(f"regexp_replace({x}, {_text('(?i)' + p)}, '')"), beginnings, c)


def prompt(c: str) -> str:
    """A prompt, normalised, without its fixed beginnings."""
    return _norm(_without(_norm(c), V.PROMPT_BEGINNINGS))


def answers(rel: str, col: str, v3: bool) -> str:
    """The relation with a column of it replaced by the short answer."""
    chars, words, most, why = (520, 120, 4, 3) if v3 else (360, 110, 3, 2)
    plain = _norm(reduce(lambda x, m: f"replace({x}, {_text(m)}, '')", V.MARKUP, col))
    count = lambda m: f"(length(t_) - length(replace(t_, {m}, ''))) / 2"
    bad = f"t_ = '' OR contains(t_, '```') OR " + (f"{count('chr(10) || chr(45)')} >= 4 OR {count('chr(10) || chr(42)')} >= 4" if v3 else _any("lower(t_)", V.THINKING_ALOUD))
    found = [f"trim({_norm(f'regexp_extract(t_, {_text(p)}, 1)')}, ' .$')" for p in V.ANSWER_PLACES]
    hint = "CASE " + " ".join(f"WHEN regexp_matches({h}, '[A-Za-z0-9]') THEN {h}" for h in found) + " END"
    chunks = f"list_filter(list_transform(string_split_regex(regexp_replace(t_, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1) || '|\\n+'), lambda x: {_norm('x')}), lambda x: x <> '')"
    cleaned = f"list_filter(list_transform({chunks}, lambda x: {_without('x', V.ANSWER_BEGINNINGS)}), lambda x: x <> '')"
    once = "list_filter(c_, lambda x, i: lower(x) NOT IN ('therefore', 'thus', 'hence') AND list_position(c_, x) = i)" if v3 else "c_"
    fits = f"len(list_filter(range(1, least(len(o_), {most}) + 1), lambda k: list_sum(list_transform(o_[1:k], lambda y: length(y))) <= {chars} AND list_sum(list_transform(o_[1:k], lambda y: {_words('y')})) <= {words}))"
    reason = _strip(f"array_to_string(list_filter(k_, lambda x: NOT contains(lower(x), lower(h_)))[1:{why}], ' ')")
    end, link = ("''", "chr(10) || 'Why: '") if v3 else ("'.'", "'. Why: '")
    letter = "" if v3 else "WHEN lower(h_) IN ('a', 'b', 'c', 'd') THEN ''"
    stated = _norm(f"'Answer: ' || h_ || CASE WHEN w_ = '' THEN {end} ELSE {link} || w_ END")
    whole = _norm("array_to_string(k_, ' ')")
    return f"""(SELECT * EXCLUDE ({col}, t_, h_, c_, o_, k_, w_), CASE WHEN {bad} THEN '' WHEN h_ IS NULL THEN {whole} {letter} ELSE {stated} END AS {col} FROM
        (SELECT *, {reason} AS w_ FROM (SELECT *, o_[1:{fits}] AS k_ FROM (SELECT *, {once} AS o_ FROM (SELECT *, {hint} AS h_, {cleaned} AS c_ FROM (SELECT *, {plain} AS t_ FROM {rel}))))))"""


def valid(rel: str, rules: str) -> str:
    """The relation's rows whose user and assistant are a valid pair."""
    limits = V.PAIR_LIMITS[rules]
    again = answers(f"(SELECT *, {prompt('user')} AS user_again, assistant AS assistant_again FROM {rel})", "assistant_again", True) if rules == "v3" else f"(SELECT *, user AS user_again, assistant AS assistant_again FROM {rel})"
    u, a = "user_again", "assistant_again"
    ok = f"length({u}) BETWEEN {limits['user'][0]} AND {limits['user'][1]} AND length({a}) BETWEEN {limits['assistant'][0]} AND {limits['assistant'][1]} AND {_words(a)} <= {limits['words']} AND length({a}) - length(replace({a}, chr(10), '')) <= {limits['newlines']}"
    if rules == "v3":
        ok += f" AND NOT {_any(f'lower({u})', V.CODE_V3)}"
    else:
        ok += f" AND NOT {_any(f'lower({u})', V.CODE_DISTILLED)} AND NOT {_any(f'lower({u})', V.MULTIPLE_CHOICE)} AND NOT {_any(f'lower({a})', V.THINKING_ALOUD)} AND NOT regexp_full_match({_strip(f'lower({a})')}, '(answer:\\s*)?[a-d][.]?')"
    return f"(SELECT * EXCLUDE ({u}, {a}) FROM {again} WHERE user <> '' AND assistant <> '' AND {ok})"


def kind(rules: str) -> str:
    table, other, c = (V.THOUGHT_CATEGORIES, "general-reasoning", _norm("user")) if rules == "v3" else (V.PROMPT_CATEGORIES, "grounded_qa", prompt("user"))
    return "CASE " + " ".join(f"WHEN {_any(f'lower({c})', words)} THEN '{name}'" for name, words in table) + f" ELSE '{other}' END"


def score(seed: int, payload: str, rules: str, reward: bool) -> str:
    tie = f"(('0x' || sha1('{seed}:' || {payload})[1:16])::UBIGINT % 1000)::BIGINT"
    u, a, w = "length(user)", "length(assistant)", _words("assistant")
    rank = f"greatest(0, 900 - {a}) * 10000 + greatest(0, 220 - {w}) * 1000 + greatest(0, 700 - {u})" if rules == "v3" else f"greatest(0, 650 - {u}) * 1000 + greatest(0, 700 - {a}) * 100 + greatest(0, 110 - {w})"
    lead = f" + floor(reward * 1000)::BIGINT * {1_000_000_000 if rules == 'v3' else 1_000_000}" if reward else ""
    return f"({rank})::BIGINT * 1000 + {tie}{lead}"


def candidates(rel: str, mark: str, rules: str = "v3", seed: int = 42, category: str | None = None, marked: bool = True, reward: float | None = None, thoughts: bool | None = None) -> str:
    """SELECT of the valid rows (ord, category, user, assistant, score), the first of equal prompts by ord."""
    after = "CASE WHEN contains(a_, '<|end_of_thought|>') THEN a_[instr(a_, '<|end_of_thought|>') + 18:] ELSE a_ END" if (rules == "v3" if thoughts is None else thoughts) else "assistant"
    worth = "reward" if reward is not None else "NULL::DOUBLE"
    least = f"WHERE coalesce(reward, 0) >= {reward}" if reward is not None else ""
    raw = f"(SELECT ord, {prompt('user')} AS user, {after} AS assistant, {category or 'NULL'} AS given, {worth} AS reward FROM (SELECT *, {_norm('assistant')} AS a_ FROM {rel}) {least})"
    rows = f"(SELECT *, {'given' if category else kind(rules)} AS category FROM {valid(answers(raw, 'assistant', rules == 'v3'), rules)})"
    payload = f"'{mark}:' || " + ("category || ':' || user" if marked else "user")
    return f"SELECT ord, category, user, assistant, {score(seed, payload, rules, reward is not None)} AS score FROM (SELECT *, row_number() OVER (PARTITION BY lower(user) ORDER BY ord) AS first_ FROM {rows}) WHERE first_ = 1"


def chosen(found: str, source: str, quotas: dict[str, int]) -> str:
    """SELECT of the best candidates of each category up to its quota."""
    table = ", ".join(f"('{c}', {n})" for c, n in quotas.items())
    return f"SELECT ord, '{source}' AS source, category, user, assistant, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, ord) AS rank FROM ({found})) JOIN (VALUES {table}) q(c, quota) ON category = c WHERE rank <= quota"


def merged(parts: dict[str, tuple[str, list[str]]]) -> str:
    """SELECT of the chosen rows of all sources: of equal prompts the first source's."""
    union = " UNION ALL ".join(f"SELECT *, {k} AS source_place, list_position({list(kinds)}, category) AS kind_place FROM ({sql})" for k, (sql, kinds) in enumerate(parts.values()))
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(user) ORDER BY source_place, kind_place, rank) AS first_ FROM ({union})) WHERE first_ = 1"
