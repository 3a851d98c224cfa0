"""Conversation structure repair: the cheapest edits that make roles alternate, by Dial's bucket queue.

A conversation is a graph of (rows read, state of the role grammar); arcs are edits of costs 0 to 3, so nodes are settled
from buckets by distance, from the end backwards. The audit is the walk from the start that takes, of the arcs that
lie on a cheapest way, the one whose letter is least.

Rows are ranked over the whole table and cut into stretches. Distances through a stretch are a 4 x 4 matrix; the
matrices of a conversation's stretches are multiplied in (min, +) from its end, which gives each stretch the distances
at its own end. Stretches are then walked from all four states, and the walks that fit are put end to end. So the
work on a conversation of any length is spread, and what goes through one task is a row for each stretch. The
checksum of a repaired conversation is one stream by its nature: its rows pass a task in order and aren't held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import bounded_batches, cut, global_rank, tidy

#: Rows of the whole order in a stretch.
STRETCH = 4096
BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a. A conversation may end in the first and the last.
START, AFTER_S, AFTER_U, AFTER_A = STATES = range(4)
END = (0, None, None, 0)
#: Pairs of neighbouring initials that are as they should be.
LEGAL = ("su", "ua", "au")
#: Initials that the grammar knows; any other, or none, is written o. A truncated row's is a capital, x must be deleted.
CODES = "suaoSUAOx"


def _next(state: int) -> int:
    """The state after a message whose role is chosen freely."""
    return AFTER_A if state == AFTER_U else AFTER_U


def arcs(code: str) -> list[tuple[int, str, int, int]]:
    """(from, edit, cost, to) of a row with this code."""
    out = [(s, "D", DELETE, s) for s in STATES]
    more = TRUNCATED * code.isupper()
    if code != "x":
        out += [(s, "R", REROLE + more, _next(s)) for s in STATES]
        out += [(START, "K", KEEP + more, AFTER_S)] * (code in "sS")
        out += [(s, "K", KEEP + more, _next(s)) for s in STATES if code in ("aA" if s == AFTER_U else "uU")]
    return out


#: Arcs by code and state, forwards in the order of their letters (steps over rows, cost, to, letter) and backwards (cost, from).
_FORWARD = {c: [sorted([(e, 1, w, t) for a, e, w, t in arcs(c) if a == s] + [("I", 0, INSERT, _next(s))]) for s in STATES] for c in CODES}
_BACKWARD = {c: [[(w, a) for a, _, w, t in arcs(c) if t == s] for s in STATES] for c in CODES}
_INSERTED = [[a for a in STATES if _next(a) == s] for s in STATES]


def distances(codes: str, ends: tuple[int | None, ...]) -> list[int | None]:
    """Least cost from each node 4 * row + state to the stretch's end, where state s costs ends[s] more; None: no way."""
    out: list[int | None] = [None] * (4 * len(codes) + 4)
    buckets: list[list[int]] = []

    def put(node: int, d: int) -> None:
        if out[node] is None:
            while len(buckets) <= d:
                buckets.append([])
            buckets[d].append(node)

    for s, d in enumerate(ends):
        if d is not None:
            put(4 * len(codes) + s, d)
    d = 0
    while d < len(buckets):
        for node in buckets[d]:  # arcs of no cost put into the bucket that is being read
            if out[node] is None:
                out[node] = d
                row, s = divmod(node, 4)
                for a in _INSERTED[s]:
                    put(4 * row + a, d + INSERT)
                if row:
                    for w, a in _BACKWARD[codes[row - 1]][s]:
                        put(4 * row - 4 + a, d + w)
        buckets[d] = []
        d += 1
    return out


@lru_cache(maxsize=20_000)
def matrix(codes: str) -> tuple[int | None, ...]:
    """Least cost through a stretch from each state (row) to each state (column)."""
    columns = [distances(codes, tuple(0 if s == t else None for s in STATES))[:4] for t in STATES]
    return tuple(columns[t][s] for s in STATES for t in STATES)


def before(steps: list[int | None], ends: tuple[int | None, ...]) -> tuple[int | None, ...]:
    """The distances at a stretch's beginning from its matrix and those at its end."""
    sums = [[steps[4 * s + t] + e for t, e in enumerate(ends) if e is not None and steps[4 * s + t] is not None] for s in STATES]
    return tuple(min(x) if x else None for x in sums)


@lru_cache(maxsize=20_000)
def walks(codes: str, ends: tuple[int | None, ...], last: bool) -> tuple[tuple[str, int], ...]:
    """(edits, state at the end) of the least cheapest walk from each state; of a state without a way ("", -1)."""
    far, out = distances(codes, ends), []
    for s in STATES:
        row, edits = 0, []
        while row < len(codes) and far[4 * row + s] is not None:
            here = far[4 * row + s]
            for letter, step, w, t in _FORWARD[codes[row]][s]:
                then = far[4 * (row + step) + t]
                if then is not None and then + w == here:
                    edits.append(letter)
                    row, s = row + step, t
                    break
        while last and far[4 * row + s]:
            edits.append("I")
            s = _next(s)
        out.append(("".join(edits), s if far[4 * row + s] is not None else -1))
    return tuple(out)


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that the checksum of `conv_id:turn` deals; a null text or role is one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    d = turns.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("k_")).where("k_ <> 0")
    text = F.when(F.col("k_") == 1, "").when(F.col("k_") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    d = d.select("conv_id", "turn", F.when(F.col("k_") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "k_")
    copies = F.when(F.col("k_") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return d.withColumn("copy_", F.explode(copies)).select("conv_id", "turn", "role", "text")


ORDER = ["conv_id", "turn", "role", "key"]


def _keyed(rows: DataFrame) -> DataFrame:
    """rows with the checksum of their text, which stands for it where rows are ordered and compared."""
    return rows.withColumn("key", F.unhex(F.sha2("text", 256)))


def marked(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, rank_, fault, initial) of rows (conv_id, turn, role, text): narrow, in the order of the whole table.

    fault is blank, duplicate, truncated or null. Rows that share a turn go by role and then by their text's checksum.
    """
    end = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    fault = F.when(blank, "blank").when(~end.isin(".", "!", "?"), "truncated")
    ranked = global_rank(_keyed(rows).select(*ORDER, fault.alias("fault")), ORDER)
    again = ranked.groupBy("conv_id", "role", "key").agg(F.min("rank_").alias("first_"), F.count("*").alias("n_")).where("n_ > 1")
    again = again.select(F.col("conv_id").alias("c_"), F.col("role").alias("r_"), F.col("key").alias("k_"), "first_")
    same = F.col("conv_id").eqNullSafe(F.col("c_")) & (F.col("role") == F.col("r_")) & (F.col("key") == F.col("k_"))
    initial = F.substring("role", 1, 1)
    first = F.col("fault").eqNullSafe("blank")
    fault = F.when(first, "blank").when(F.col("rank_") > F.col("first_"), "duplicate").otherwise(F.col("fault"))
    out = ranked.join(again, same, "left").withColumn("fault", fault)
    return out.select("conv_id", "turn", "rank_", "fault", F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"))


def stretches(rows: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(conv_id, piece, codes, initials): a row for each conversation and stretch, of at most so many rows."""
    code = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    own = F.array_sort(F.collect_list(F.struct("rank_", code.alias("code"), "initial")))
    g = rows.groupBy("conv_id", F.expr(f"rank_ div {stretch}").alias("piece")).agg(own.alias("own_"))
    return g.select("conv_id", "piece", F.array_join("own_.code", "").alias("codes"), F.array_join("own_.initial", "").alias("initials"))


def _each(rows: DataFrame, schema: str, step: Callable[[Iterator[dict]], Iterator[dict]]) -> DataFrame:
    """Rows through step, a function on a task's rows in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for row in step(r for b in batches for r in b.to_pylist()):
            held.append(row)
            if len(held) == 1000:
                yield pa.RecordBatch.from_pylist(held, kinds)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, kinds)

    kinds = to_arrow_schema(StructType.fromDDL(schema))
    return bounded_batches(rows).mapInArrow(tidy(run), schema)


def _through(rows: Iterator[dict]) -> Iterator[dict]:
    for r in rows:
        pairs = (r["initials"][k : k + 2] for k in range(len(r["initials"]) - 1))
        yield r | {"steps": list(matrix(r["codes"])), "illegal": sum(p not in LEGAL for p in pairs), "edge": r["initials"][0] + r["initials"][-1]}


def _backwards(rows: Iterator[dict]) -> Iterator[dict]:
    """The distances at each stretch's end, of which only differences matter, and the cost from the start of what is left."""
    here: object = rows  # no conversation's id
    ends: tuple[int | None, ...] = END
    for r in rows:
        last = r["conv_id"] != here
        if last:
            here, ends = r["conv_id"], END
        low = min(e for e in ends if e is not None)
        then = before(r["steps"], ends)
        yield r | {"ends": [None if e is None else e - low for e in ends], "last": last, "cost": then[START]}
        ends = then


def _walked(rows: Iterator[dict]) -> Iterator[dict]:
    for r in rows:
        found = walks(r["codes"], tuple(r["ends"]), r["last"])
        yield r | {"edits": [e for e, _ in found], "to": [s for _, s in found]}


def _forwards(rows: Iterator[dict]) -> Iterator[dict]:
    """One row a conversation: its walks put end to end."""
    now: dict | None = None
    for r in rows:
        if now is None or now["conv_id"] != r["conv_id"]:
            if now:
                yield now | {"audit": "".join(now["audit"])}
            now = {"conv_id": r["conv_id"], "audit": [], "illegal": 0, "cost": r["cost"], "state": START, "edge": ""}
        now["illegal"] += r["illegal"] + (now["edge"] + r["edge"][0] not in LEGAL if now["edge"] else 0)
        now["audit"].append(r["edits"][now["state"]])
        now |= {"state": r["to"][now["state"]], "edge": r["edge"][1]}
    if now:
        yield now | {"audit": "".join(now["audit"])}


def _hashed(rows: Iterator[dict]) -> Iterator[dict]:
    """Each conversation's audit row (without a role) comes first, then its rows in order, which its edits read one by one."""
    now: dict | None = None
    for r in rows:
        if r["role"] is None:
            if now:
                yield _ended(now)
            now = r | {"at": 0, "sum": hashlib.sha256(), "lines": 0, "to": START}
        else:
            _inserts(now)
            edit = now["audit"][now["at"]]
            now["at"] += 1
            if edit == "K":
                now["to"] = AFTER_S if now["to"] == START and r["role"].startswith("s") else _next(now["to"])
                _line(now, r["role"], r["text"])
            elif edit == "R":
                now["to"] = _next(now["to"])
                _line(now, "user" if now["to"] == AFTER_U else "assistant", r["text"])
    if now:
        yield _ended(now)


def _line(now: dict, role: str, text: str) -> None:
    now["sum"].update(f"{chr(10) if now['lines'] else ''}{role}:{text}".encode())
    now["lines"] += 1


def _inserts(now: dict) -> None:
    while now["audit"][now["at"] : now["at"] + 1] == "I":
        now["at"] += 1
        now["to"] = _next(now["to"])
        _line(now, "user" if now["to"] == AFTER_U else "assistant", "")


def _ended(now: dict) -> dict:
    _inserts(now)
    return now | {"repaired_sha256": now["sum"].hexdigest()}


def audits(rows: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(conv_id, audit, illegal, cost) from marked rows, one row a conversation."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    f = stretches(rows, stretch)
    known = f"conv_id {kind}, piece long, codes string, initials string, steps array<int>, illegal long, edge string"
    f = _each(f, known, _through).drop("initials")
    known = f"conv_id {kind}, piece long, codes string, illegal long, edge string, ends array<int>, last boolean, cost long"
    f = _each(f.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("piece")), known, _backwards)
    known = f"conv_id {kind}, piece long, illegal long, edge string, cost long, edits array<string>, to array<int>"
    f = _each(f.repartition("conv_id", "piece"), known, _walked)
    return _each(f.repartition("conv_id").sortWithinPartitions("conv_id", "piece"), f"conv_id {kind}, audit string, illegal long, cost long", _forwards)


def repaired(turns: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """One row a conv_id of rows (conv_id, turn, role, text): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows go by turn, nulls first, then by role and the checksum of their text, so repeated rows are neighbours and
    ties don't matter. Null roles and texts are empty; a null conv_id is a conversation of its own. A role without an
    initial of the grammar, the empty one too, can only be changed or deleted. Columns other than the four aren't
    read. An empty table gives an empty result.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select("conv_id", "turn", empty("role").alias("role"), empty("text").alias("text"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    marks = cut(marked(rows))
    found = cut(audits(marks, stretch))
    n = lambda f: F.count(F.when(F.col("fault") == f, 1)).alias(f)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    counts = marks.groupBy("conv_id").agg(gaps.alias("gaps"), n("blank"), n("duplicate"), n("truncated"))
    none = lambda *names: [F.lit(None).cast(t).alias(c) for c, t in names]
    heads = found.select("conv_id", *none(("turn", rows.schema["turn"].dataType.simpleString()), ("role", "string"), ("text", "string"), ("key", "binary")), "audit", "illegal", "cost")
    lines = _keyed(rows).select(*ORDER[:3], "text", "key", *none(("audit", "string"), ("illegal", "long"), ("cost", "long")))
    both = heads.unionByName(lines).repartition("conv_id").sortWithinPartitions("conv_id", F.col("role").isNotNull(), "turn", "role", "key")
    hashes = _each(both, f"conv_id {kind}, illegal long, cost long, audit string, repaired_sha256 string", _hashed).withColumnRenamed("conv_id", "c_")
    return counts.join(hashes, F.col("conv_id").eqNullSafe(F.col("c_"))).drop("c_")


def repair_audit(turns: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """repaired() of the damaged rows, with a row for every conv_id of turns.

    A conversation that the damage left without rows has zeros, an empty audit and the checksum of nothing.
    """
    ids = turns.select("conv_id").distinct()
    found = repaired(damaged(turns), stretch).withColumnRenamed("conv_id", "c_")
    out = ids.join(found, F.col("conv_id").eqNullSafe(F.col("c_")), "left").drop("c_")
    nothing = hashlib.sha256().hexdigest()
    of = lambda c, d: F.coalesce(F.col(c), F.lit(d).cast("long") if d == 0 else F.lit(d)).alias(c)
    return out.select("conv_id", *[of(c, 0) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], of("audit", ""), of("repaired_sha256", nothing))


def oracle_sql() -> str:
    """The same rows in DuckDB SQL: cheapest costs with their least audit are carried forwards row by row."""
    crc = []
    for v in range(256):
        for _ in range(8):
            v = v >> 1 ^ 0xEDB88320 if v & 1 else v >> 1
        crc.append(v)
    steps = ", ".join(f"('{c}', {a}, '{e}', {w}, {t})" for c in CODES for a, e, w, t in arcs(c))
    closure = [(s, 0, s) for s in STATES] + [(s, 1, _next(s)) for s in STATES] + [(s, 2, _next(_next(s))) for s in STATES if _next(_next(s)) != s]
    legal = ", ".join(f"'{p}'" for p in LEGAL)
    return f"""
    WITH RECURSIVE tab AS (SELECT {crc}::UBIGINT[] AS t),
    arc(code, a, edit, w, b) AS (VALUES {steps}),
    ins(a, k, b) AS (VALUES {', '.join(map(str, closure))}),
    x AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
    h AS (SELECT * EXCLUDE name, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT,
            list_transform(range(1, strlen(name) + 1), lambda i: ascii(name[i])::UBIGINT)),
            lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1]))) % 20 AS k FROM x, tab),
    d AS (SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role,
        CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE k WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE k <> 0),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM d),
    f AS (SELECT *, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS initial,
        CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
          WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
          WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' END AS fault FROM o),
    m AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' WHEN fault = 'truncated' THEN upper(initial) ELSE initial END AS code,
        initial <> 'o' AND lag(initial) OVER w || initial IN ({legal}) AS fits, lag(initial) OVER w IS NOT NULL AS second FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
    n AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count_if(fault = 'blank')::BIGINT AS blank,
        count_if(fault = 'duplicate')::BIGINT AS duplicate, count_if(fault = 'truncated')::BIGINT AS truncated, count_if(second AND NOT fits)::BIGINT AS illegal FROM m GROUP BY conv_id),
    way AS (SELECT conv_id, 0::BIGINT AS i, 0 AS s, {{'c': 0::BIGINT, 'e': ''}} AS v FROM n
      UNION ALL
      SELECT w.conv_id, w.i + 1, arc.b, min({{'c': w.v.c + 2 * ins.k + arc.w, 'e': w.v.e || repeat('I', ins.k) || arc.edit}})
      FROM way w JOIN m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1 JOIN ins ON ins.a = w.s JOIN arc ON arc.code = m.code AND arc.a = ins.b
      GROUP BY w.conv_id, w.i + 1, arc.b),
    best AS (SELECT w.conv_id, min({{'c': w.v.c + 2 * ins.k, 'e': w.v.e || repeat('I', ins.k)}}) AS v
      FROM way w JOIN n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.n = w.i JOIN ins ON ins.a = w.s AND ins.b IN (0, 3) GROUP BY w.conv_id),
    p AS (SELECT conv_id, v.e AS audit, unnest(range(1, length(v.e) + 1)) AS p FROM best),
    q AS (SELECT conv_id, p, audit[p] AS edit, length(replace(audit[:p], 'I', '')) AS i, length(replace(audit[:p], 'D', '')) AS place FROM p),
    r AS (SELECT q.*, m.role, m.text, max(place = 1 AND edit = 'K' AND m.initial = 's') OVER (PARTITION BY q.conv_id) AS led
      FROM q LEFT JOIN m ON m.conv_id IS NOT DISTINCT FROM q.conv_id AND m.i = q.i AND q.edit <> 'I'),
    l AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - led::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS lines
      FROM r WHERE edit <> 'D' GROUP BY conv_id)
    SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
        coalesce(best.v.c, 0) AS cost, coalesce(best.v.e, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id
    LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN l ON l.conv_id IS NOT DISTINCT FROM c.conv_id"""
