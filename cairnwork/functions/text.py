"""Text functions as column expressions: normalising, answers, classes, pairs, ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_text(c: Column) -> Column:
    """Line ends as \\n, blanks and tabs as one space, at most one empty line, no outer white space."""
    c = F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), "[ \t]+", " ")
    return strip(F.regexp_replace(c, "\n{3,}", "\n\n"))


def normalize_user_prompt(c: Column) -> Column:
    # Texts have no outer white space before a beginning is cut, so stripping where nothing was cut changes nothing.
    return normalize_text(reduce(lambda x, p: strip(F.regexp_replace(x, "(?iU)" + p, "")), V.PROMPT_BEGINNINGS, normalize_text(c)))


def strip_markup(c: Column) -> Column:
    return normalize_text(reduce(lambda x, m: F.replace(x, F.lit(m), F.lit("")), V.MARKUP, c))


def sentence_chunks(c: Column) -> Column:
    """Sentences and lines, normalised, without empty ones."""
    return F.filter(F.transform(F.split(c, r"(?U)(?<=[.!?])\s+|\n+"), normalize_text), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))


def count_of(c: Column, part: str) -> Column:
    """How often a fixed string stands in a text, without overlaps."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / len(part)).cast("int")


def has_any(c: Column, parts) -> Column:
    """Whether a text holds one of the strings, inside words too."""
    return reduce(lambda a, b: a | b, [c.contains(p) for p in parts])


def answer_hint(c: Column, bare_operators: bool = False) -> Column:
    """The answer a text states, or null: the first place with letters or digits in it wins."""
    out = []
    for p in V.ANSWER_PLACES:
        v = F.btrim(normalize_text(F.regexp_extract(c, "(?U)" + p, 1)), F.lit(" .$"))
        good = v.rlike("[A-Za-z0-9]")
        out.append(F.when(good, v))
    return F.coalesce(*out)


def without_beginnings(c: Column) -> Column:
    return reduce(lambda x, p: strip(F.regexp_replace(x, "(?iU)" + p, "")), V.ANSWER_BEGINNINGS, c)


def _gathered(chunks: Column, chars: int, words: int, most: int, unique: bool) -> Column:
    """The first chunks that fit the limits; the first that doesn't ends it."""
    state = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("chars"), F.lit(0).alias("words"), F.lit(False).alias("done"))

    def step(a: Column, x: Column) -> Column:
        skip = (x == "") | (F.lower(x).isin("therefore", "thus", "hence") | F.array_contains(a["kept"], x) if unique else F.lit(False))
        n = word_count(x)
        full = (F.size(a["kept"]) >= most) | (a["chars"] + F.length(x) > chars) | (a["words"] + n > words)
        more = F.struct(F.concat(a["kept"], F.array(x)).alias("kept"), (a["chars"] + F.length(x)).alias("chars"), (a["words"] + n).alias("words"), F.lit(False).alias("done"))
        ended = F.struct(a["kept"].alias("kept"), a["chars"].alias("chars"), a["words"].alias("words"), F.lit(True).alias("done"))
        return F.when(a["done"] | skip, a).when(full, ended).otherwise(more)

    return F.aggregate(chunks, state, step)["kept"]


def teacher_answer(c: Column, rules: str = "v3") -> Column:
    """A teacher's answer cut to a short answer with a reason; empty if it has code, lists or thinks aloud."""
    v3 = rules == "v3"

    def of(text: Column) -> Column:
        bad = (text == "") | text.contains("```")
        bad = bad | (count_of(text, "\n-") >= 4) | (count_of(text, "\n*") >= 4) if v3 else bad | has_any(F.lower(text), V.THINKING_ALOUD)
        cleaned = F.transform(sentence_chunks(text), without_beginnings)
        kept = _gathered(cleaned, 520, 120, 4, True) if v3 else _gathered(cleaned, 360, 110, 3, False)

        def write(s: Column) -> Column:
            hint, chunks = s["hint"], s["kept"]
            why = strip(F.array_join(F.slice(F.filter(chunks, lambda x: ~F.lower(x).contains(F.lower(hint))), 1, 3 if v3 else 2), " "))
            end, link = ("", "\nWhy: ") if v3 else (".", ". Why: ")
            answer = F.when(why != "", F.concat(F.lit("Answer: "), hint, F.lit(link), why)).otherwise(F.concat(F.lit("Answer: "), hint, F.lit(end)))
            plain = F.array_join(chunks, " ")
            letter = F.lit(False) if v3 else F.lower(hint).isin("a", "b", "c", "d")
            return normalize_text(F.when(hint.isNull(), plain).when(letter, "").otherwise(answer))

        return F.when(bad, "").otherwise(let(F.struct(answer_hint(text).alias("hint"), kept.alias("kept")), write))

    return let(strip_markup(c), of)


def clean_solution(c: Column) -> Column:
    """A solution without the marks around thoughts and solutions, normalised before and after."""
    out = normalize_text(c)
    for mark in V.MARKUP[:4]:
        out = F.replace(out, F.lit(mark), F.lit(""))
    return normalize_text(out)


def after_thought(c: Column) -> Column:
    """What follows the first end of a thought, or all."""
    mark = "<|end_of_thought|>"
    return let(normalize_text(c), lambda x: F.when(x.contains(mark), F.substr(x, F.locate(mark, x) + len(mark))).otherwise(x))


def category(c: Column, table, other: str) -> Column:
    """The first category of the table with a keyword in the lowered text."""
    return let(F.lower(c), lambda x: F.coalesce(*[F.when(has_any(x, words), name) for name, words in table], F.lit(other)))


def classify_thoughts(c: Column, rules: str = "v3") -> Column:
    return category(normalize_text(c), V.THOUGHT_CATEGORIES_V2 if rules == "v2" else V.THOUGHT_CATEGORIES, "general-reasoning")


def classify_prompt(c: Column) -> Column:
    return category(normalize_user_prompt(c), V.PROMPT_CATEGORIES, "grounded_qa")


def classify_anchor(c: Column) -> Column:
    """The category of a manual prompt; empty for prompts that are left out."""

    def of(x: Column) -> Column:
        plain = category(x, V.PROMPT_CATEGORIES, "grounded_qa")
        reasons = (plain == "grounded_qa") & has_any(x, V.ANCHOR_EVIDENCE)
        return F.when(has_any(x, V.ANCHOR_SEEKING), "information_seeking").when(has_any(x, V.ANCHOR_REASONING), "reasoning").when(has_any(x, V.ANCHOR_LEFT_OUT), "").when(reasons, "reasoning").otherwise(plain)

    return let(F.lower(normalize_user_prompt(c)), of)


def valid_pair(user: Column, assistant: Column, rules: str = "v3") -> Column:
    """Whether a pair meets a rule set. v1, v2 and v3 normalise both sides (again) first; a null side fails."""
    limits, distilled = V.PAIR_LIMITS[rules], rules.startswith("distilled")
    banned = {"v1": V.BANNED_V1, "v2": V.CODE_V2, "v3": V.CODE_V3}.get(rules, V.CODE_DISTILLED)

    def of(s: Column) -> Column:
        u, a = s["u"], s["a"]
        ok = F.length(u).between(*limits["user"]) & F.length(a).between(*limits["assistant"])
        if "words" in limits:
            ok = ok & (word_count(a) <= limits["words"]) & (count_of(a, "\n") <= limits["newlines"])
        ok = ok & ~has_any(F.lower(u), banned)
        if distilled:
            ok = ok & ~has_any(F.lower(u), V.MULTIPLE_CHOICE) & ~has_any(F.lower(a), V.THINKING_ALOUD) & ~strip(F.lower(a)).rlike(r"^(answer:\s*)?[a-d][.]?$")
        return ok

    u, a = (user, assistant) if distilled else (normalize_user_prompt(user), teacher_answer(assistant)) if rules == "v3" else (normalize_text(user), normalize_text(assistant))
    return F.coalesce(let(F.struct(u.alias("u"), a.alias("a")), of), F.lit(False))


def stable_score(seed: int, payload: Column) -> Column:
    """The first 8 bytes of a SHA-1 as an unsigned number, which needs a decimal."""
    return F.conv(F.substring(F.sha1(F.concat(F.lit(f"{seed}:"), payload).cast("binary")), 1, 16), 16, 10).cast("decimal(20,0)")


def brevity_rank(user: Column, assistant: Column, rules: str = "v3") -> Column:
    spare = lambda most, n: F.greatest(F.lit(0), F.lit(most) - n)
    if rules == "v3":
        return spare(900, F.length(assistant)) * 10_000 + spare(220, word_count(assistant)) * 1_000 + spare(700, F.length(user))
    return spare(650, F.length(user)) * 1_000 + spare(700, F.length(assistant)) * 100 + spare(110, word_count(assistant))


def selection_score(seed: int, payload: Column, user: Column, assistant: Column, reward: Column | None = None, rules: str = "v3") -> Column:
    tie = F.pmod(stable_score(seed, payload), F.lit(1000).cast("decimal(20,0)")).cast("long")
    base = brevity_rank(user, assistant, rules).cast("long") * 1000 + tie
    if reward is None:
        return base
    return base + F.when(reward > 0, F.floor(reward * 1000).cast("long") * (1_000_000_000 if rules == "v3" else 1_000_000)).otherwise(0)


def gsm_answer(c: Column) -> Column:
    """The number after ####, without commas; null if there is none."""
    return F.nullif(F.replace(F.regexp_extract(c, r"#### (\-?[0-9\.\,]+)", 1), F.lit(","), F.lit("")), F.lit(""))


def gsm_parts(c: Column) -> Column:
    """Text and calculator calls <<expression=result>> in order, as structs (kind, text, result)."""
    parts = F.regexp_extract_all(c, F.lit(r"<<[^>]+>>|(?:(?!<<[^>]+>>)[\s\S])+"), F.lit(0))

    def of(p: Column) -> Column:
        inner = F.substr(p, F.lit(3), F.length(p) - 4)
        at = F.length(inner) - F.locate("=", F.reverse(inner))
        call = F.locate("=", inner) > 0
        tool = F.struct(F.lit("python").alias("kind"), F.when(call, F.substr(inner, F.lit(1), at)).otherwise(inner).alias("text"), F.when(call, F.substr(inner, at + 2)).otherwise("").alias("result"))
        return F.when(p.rlike("^<<[^>]+>>$"), tool).otherwise(F.struct(F.lit("text").alias("kind"), p.alias("text"), F.lit(None).cast("string").alias("result")))

    return F.transform(parts, of)


def render_choices(question: Column, letters: Column, choices: Column) -> Column:
    """A multiple-choice prompt: the question, a line `- choice=letter` each, and the request for a letter."""
    lines = F.zip_with(letters, choices, lambda k, c: F.concat(F.lit("- "), c, F.lit("="), k, F.lit("\n")))
    return F.concat(F.lit("Multiple Choice question: "), question, F.lit("\n"), F.array_join(lines, ""), F.lit("\nRespond only with the letter of the correct answer."))


def spelled(word: Column) -> Column:
    return F.array_join(F.filter(F.split(word, ""), lambda x: x != ""), ",")


def letter_count(word: Column, letter: Column) -> Column:
    return F.length(word) - F.length(F.replace(word, letter, F.lit("")))


def letter_trace(word: Column, letter: Column) -> Column:
    """A word spelled out and its letters counted one by one, as text."""

    def line(c: Column, i: Column) -> Column:
        so_far = letter_count(F.substring(word, F.lit(1), i + 1), letter)
        return F.concat(i + 1, F.lit(":"), c, F.when(c == letter, F.concat(F.lit(" hit! count="), so_far)).otherwise(""), F.lit("\n"))

    letters = F.filter(F.split(word, ""), lambda x: x != "")
    head = F.concat(F.lit("We are asked to find the number '"), letter, F.lit("' in the word '"), word, F.lit("'. Let me try a manual approach first.\n\nFirst spell the word out:\n"), word, F.lit(":"), spelled(word), F.lit("\n\nThen count the occurrences of '"), letter, F.lit("':\n"))
    return F.concat(head, F.array_join(F.transform(letters, line), ""), F.lit("\nThis gives us "), letter_count(word, letter), F.lit("."))


def program_of(c: Column) -> Column:
    """The first fenced block, or the stripped text."""
    block = F.regexp_extract(c, r"(?s)```(?:python)?\s*\n(.*?)\n```", 1)
    return F.when(block != "", strip(block)).otherwise(strip(c))


def leading_imports(c: Column) -> Column:
    """Import lines before any other line but comments and empty ones."""
    state = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("done"))

    def step(a: Column, line: Column) -> Column:
        s = strip(line)
        imports = s.startswith("import ") | s.startswith("from ")
        skip = (s == "") | s.startswith("#")
        return F.when(a["done"] | (skip & ~imports), a).when(imports, F.struct(F.concat(a["kept"], F.array(s)).alias("kept"), F.lit(False).alias("done"))).otherwise(F.struct(a["kept"].alias("kept"), F.lit(True).alias("done")))

    return F.array_join(F.aggregate(F.split(c, "\n"), state, step)["kept"], "\n")


def slug(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit(" "), F.lit("-"))


def safe_name(c: Column) -> Column:
    return F.replace(c, F.lit("/"), F.lit("_"))


def pretokens(c: Column) -> Column:
    """Pre-tokens by the split rule, white space of any script included."""
    return F.regexp_extract_all(c, F.lit("(?U)" + V.SPLIT_PATTERN), F.lit(0))
