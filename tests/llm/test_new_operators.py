"""Operators 11 to 13 against the library and plain versions, on inputs with nulls, ties, repeated rows and long texts."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cairnwork.llm import divergence, huffman, repair


def by_hand_repair(rows):
    """(cost, audit, repaired) by trying edits forwards, of rows (code, role, text)."""

    def after(state, initial):
        return {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}.get((state, initial))

    best = {0: (0, "", ())}
    for k in range(len(rows) + 1):
        for _ in range(2):  # inserts
            for s, (c, e, out) in list(best.items()):
                for role in ("user", "assistant"):
                    t = after(s, role[0])
                    if t is not None:
                        new = (c + 2, e + "I", (*out, (role, "")))
                        best[t] = min(best.get(t, new), new)
        if k == len(rows):
            break
        (fault, role, text), then = rows[k], {}
        more = fault == "truncated"
        for s, (c, e, out) in best.items():
            ways = [(s, (c + 3, e + "D", out))]
            if fault not in ("blank", "duplicate"):
                ways += [(after(s, role[:1]), (c + more, e + "K", (*out, (role, text))))]
                ways += [(after(s, r[0]), (c + 2 + more, e + "R", (*out, (r, text)))) for r in ("user", "assistant")]
            for t, new in ways:
                if t is not None:
                    then[t] = min(then.get(t, new), new)
        best = then
    return min(v for s, v in best.items() if s in (0, 3))


def by_hand_conversations(turns):
    out = {}
    for conv in {c for c, *_ in turns}:
        rows = []
        for c, turn, role, text in turns:
            if c != conv:
                continue
            blank = lambda v: " " if v is None else str(v)
            k = zlib.crc32(f"{blank(c)}:{blank(turn)}".encode()) % 20
            role, text = blank(role), blank(text)
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            rows += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, marked = set(), []
        for _, role, text in rows:
            end = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else None
            seen.add((role, text))
            marked.append((fault, role, text))
        numbers = [t for t, *_ in rows if t is not None]
        n = Counter(f for f, *_ in marked)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
        cost, audit, lines = by_hand_repair(marked)
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest())
    return out


REPAIR_COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def conversations():
    draw = random.Random(5)
    turns = []
    for conv in [None, *range(60)]:
        for turn in range(draw.randrange(0, 9)):
            role = draw.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "shy"])
            text = draw.choice(["Yes.", "No", "  ", "", None, "Why?\n", "a ", "Long " * 50 + "end!", "é.\x0b"])
            turns.append((conv, draw.choice([turn, turn, turn + 3, None]), role, text))
    turns += [(99, t, "user" if t % 2 else "assistant", f"Line {t // 7}{'.' * (t % 3)}") for t in range(300)]  # a long one
    return turns + turns[:5]


def test_repair_equals_a_plain_version_for_any_stretch(spark):
    turns = conversations()
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, audit string")
    want = by_hand_conversations(turns)
    for stretch in (4096, 7, 1):
        got = {r["conv_id"]: tuple(r[c] for c in REPAIR_COLUMNS) for r in repair.repair_audit(df, stretch).collect()}
        assert got == want


def test_distances_are_those_of_the_matrices():
    draw = random.Random(6)
    for _ in range(200):
        codes = "".join(draw.choices(repair.CODES, k=draw.randrange(0, 12)))
        cut = draw.randrange(len(codes) + 1)
        whole = repair.distances(codes, repair.END)
        assert tuple(whole[:4]) == repair.before(list(repair.matrix(codes[:cut])), repair.before(list(repair.matrix(codes[cut:])), repair.END))


def test_repair_without_rows_and_of_what_the_damage_drops(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair_audit(none).count() == 0
    gone = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    row = repair.repair_audit(spark.createDataFrame([(1, gone, "user", "Hi.")], none.schema)).first()
    assert tuple(row[c] for c in REPAIR_COLUMNS) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def by_hand_divergence(docs, least, top):
    words, counts, groups = {}, defaultdict(Counter), set()
    found = defaultdict(Counter)
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").encode().lower().decode())
        counts[lang, source].update(words)
        found[lang].update(set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in found[lang].items() if n >= least]
        sources = sorted(s for x, s in groups if x == lang)
        alike = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}
        share = {s: alike(counts[lang, s]) for s in sources}
        q = alike(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(o, sum(abs(share[s][t] - share[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, share[s][t] - q[t]) for t in kept if counts[lang, s][t] and share[s][t] > q[t]]
            for part, rows, most in (("pair", pairs, None), ("term", terms, top)):
                rows.sort(key=lambda r: (-r[1], r[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(rows[:most])]
    return sorted(out)


DOCS = "lang string, source string, text string, term string, n long, sources string, p int"


def test_divergence_equals_a_plain_version(spark):
    draw = random.Random(7)
    terms = ["Alpha", "alpha", "b", "Été", "été", "x1y", "中文", "it's", "\U0001f600", "\x00z"]
    docs = []
    for _ in range(150):
        text = draw.choice([None, "", "123 _ \x7f", " ".join(draw.choices(terms, k=draw.randrange(1, 12)))])
        docs.append((draw.choice(["en", "en", "de", None, ""]), draw.choice(["a", "a", "a", "b", "é", None, ""]), text))
    docs += [("quiet", s, None) for s in "abc"] + [("lone", "only", "alpha " * 40)] * 9 + [("en", "a", "Alpha beta " * 300_000)]
    df = spark.createDataFrame([(*d, "t", 1, "s", 0) for d in docs], DOCS)
    for least, top in ((8, 3), (1, 50)):
        got = sorted(tuple(r) for r in divergence.divergence(df, least, top).select("lang", "source", "part", "item", "value", "rank").collect())
        assert got == by_hand_divergence(docs, least, top)
    assert divergence.divergence(df.limit(0)).count() == 0


def digest(docs):
    """By the library, whole texts: {(doc_id, start): (n_tokens, crc)} in order of ids, nulls first, equal ids by text hash left out."""
    library = Tokenizer.from_file(public_tokenizers.path(huffman.TOKENIZER))
    out, start = [], 0
    for doc, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc, start, len(ids), zlib.crc32(array("I", ids).tobytes())))
        start += len(ids)
    return out


def odd_texts():
    draw = random.Random(3)
    alphabet = [" ", "\n", "\t", "'", "a", "b", "T", "s", "é", "e\u0301", "\u0301", "\x1c", "\x85", "\x0b", "\u2003", "\r", ".", "!", "<|", "|>", "1", "中", "K", "İ", "Σ"]
    texts = [None, "", "\n", "<|endoftext|> x<|STARTOFTEXT|>y<|startoftext|>", "don't I'LL 'S o'clock. A.", "a" * 5000 + " b", "Word, word; word: WORD! (word). e.g. U.S.A. 3.14, 5."]
    return texts + ["".join(draw.choices(alphabet, k=draw.randrange(40))) for _ in range(400)]


def test_files_of_ids_give_what_the_library_does(spark, tmp_path):
    docs = list(enumerate(odd_texts())) + [(5000, "long text. " * 50_000), (-7, "first"), (None, "null id")]
    random.Random(1).shuffle(docs)
    df = spark.createDataFrame([(*d, 0, 1) for d in docs], "doc_id long, text string, ids long, part int")
    want = digest(sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)))
    columns = ["doc_id", "start", "n_tokens", "ids_crc32"]
    by_start = lambda rows: sorted((tuple(r) for r in rows), key=lambda r: r[1])
    assert by_start(huffman.round_trip(df).select(columns).collect()) == want
    path = f"file://{tmp_path}/ids"
    huffman.write(df, path, block=7, stream=100)
    for first, last in ((0, None), (50, 500), (want[40][1], want[41][1]), (10**9, None), (3, 3)):
        got = [(r["doc_id"], r["start"], len(r["ids"]) // 4, zlib.crc32(r["ids"])) for r in huffman.read(spark, path, first, last).collect()]
        assert by_start(got) == [w for w in want if first <= w[1] and (last is None or w[1] < last)]
    assert sorted(p.name for p in (tmp_path / "ids").iterdir()) == ["codebook", "streams"]
    assert huffman.round_trip(df.limit(0)).count() == 0


def test_files_of_ids_of_repeated_documents(spark):
    docs = [(3, "b"), (3, "a"), (3, None), (1, "x y"), (1, "x y")]
    got = huffman.round_trip(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((d, n, c) for d, _, n, c in digest(docs))
    ends = sorted((r["start"], r["start"] + r["n_tokens"]) for r in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in itertools.pairwise(ends))


def test_code_lengths_are_least_and_bounded():
    draw = np.random.default_rng(2)
    for _ in range(60):
        counts = draw.integers(0, 1000, draw.integers(2, 60)) ** int(draw.integers(1, 4))
        heap = [int(c) for c in counts if c]
        if len(heap) < 2:
            continue
        least, n = 0, len(heap)
        heapq.heapify(heap)
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            least += both
            heapq.heappush(heap, both)
        free, bounded = huffman.code_lengths(counts, 64), huffman.code_lengths(counts, 1)
        assert int((counts * free).sum()) == least and all((b > 0) == (c > 0) for b, c in zip(free, counts, strict=True))
        assert bounded.max() <= (n - 1).bit_length() and sum(2.0**-b for b in bounded if b) <= 1 >= sum(2.0**-b for b in free if b)


def test_streams_by_block_and_range():
    ids = (np.random.default_rng(4).zipf(1.3, 300_000) % 3000).astype(np.uint16)
    book = huffman.Codebook(huffman.code_lengths(np.bincount(ids)))
    stream = book.pack(ids)
    for first, last in ((0, None), (255, 257), (256, 512), (299_999, 10**9), (7, 7), (262_143, 262_145)):
        assert (book.unpack(stream, first, last) == ids[first:last]).all()
    one = huffman.Codebook(huffman.code_lengths(np.array([0, 0, 9])))
    assert one.unpack(one.pack(np.full(700, 2, np.uint16))).tolist() == [2] * 700
    with pytest.raises(ValueError):
        book.unpack(b"nope" + stream[4:])


def test_words_of_all_characters_are_those_of_the_library():
    """Every character beside letters, stops, spaces and line ends."""
    encode, texts = huffman.WordEncoder(public_tokenizers.path(huffman.TOKENIZER)), []
    for k in range(0, 0x11000, 16):
        some = [chr(c) for c in range(k, k + 16) if not 0xD800 <= c < 0xE000]
        texts.append("".join(f"a{c} {c}b\n{c}'t.{c}!" for c in some))
    flat, n = encode.encode(pa.array(texts, pa.large_string()), 2)
    want = [[*e.ids, 2] for e in encode.library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == want
