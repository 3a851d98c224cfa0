"""Defined results on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnwork.llm import cnn, embeddings, html_text, jaccard, mixing, packing, quality_rules, sharding, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, score double, ids binary, n long, fp long, token string, rank long, component_id long, part int, kept boolean"
LONG = "word " * 60_000


def rows():
    base = [
        (0, "the cat sat on the mat and it was the best of days for a cat", "en", "a"), (1, None, None, None), (2, "", "", ""), (3, " \t\n ", "en", "a"), (4, "x", "fr", "b"),
        (5, "the cat sat on the mat and it was the best of days for a cat", "en", "b"), (None, "der Hund und die Katze", "de", "c"), (7, LONG, "en", "a"), (8, "ünï ☃ 😀\x00 end", "es", "é"),
        (9, "same words here now then", "en", "a"), (9, "same words here now then", "en", "a"), (11, "<|endoftext|> two  spaces\n\n x", None, "c"),
    ]
    return [(i, t, lang, s, None if t is None else len(t), 1, 2, 0.5, b"x", 3, 4, "t", 5, 6, 7, True) for i, t, lang, s in base]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    good = "the of and to in that is was for it with as on be at by from are this"
    return spark.createDataFrame([(i, 1, 0) for i in (0, 4, 5)] + [(8, 0, 1), (99, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int") if good else None


ALL = {
    "sharding": lambda d, _: sharding.hilbert_shards(d),
    "mixing": lambda d, _: mixing.mix(d, slots=1024),
    "rules": lambda d, _: quality_rules.quality_rules(d),
    "packing": lambda d, _: packing.pack(d),
    "quality": lambda d, labels: cnn.quality_scores(d, labels),
    "toxicity": lambda d, labels: toxicity.toxicity_scores(d, labels),
    "tokens": lambda d, _: tokens.token_counts(d),
    "jaccard": lambda d, _: jaccard.jaccard_components(d),
}


@pytest.mark.parametrize("name", ALL)
def test_empty_table(none, labels, name):
    assert ALL[name](none, labels).collect() == []


@pytest.mark.parametrize("name", [n for n in ALL if n != "packing"])
def test_one_row_each(docs, labels, name):
    out = ALL[name](docs, labels).collect()
    key = lambda x: (x is None, x or 0)
    assert sorted((r["doc_id"] for r in out), key=key) == sorted((r[0] for r in rows()), key=key)


def test_sharding(docs):
    out = sharding.hilbert_shards(docs, shards=5).collect()
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    want = {i: ((len(t.encode()) if t else 0) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows()}
    assert all(want[r["doc_id"]] == (r["size"], r["text_crc32"]) for r in out)


def test_curve_steps_by_one_cell():
    """Every cell of a grid of 8 by 8 by 8 once, each beside the one before."""
    table, at = sharding.steps(), {}
    for c in np.ndindex(8, 8, 8):
        state = h = 0
        for bit in (2, 1, 0):
            step = table[8 * state + sum((v >> bit & 1) << j for j, v in enumerate(c))]
            h, state = 8 * h + step // 24, step % 24
        at[h] = np.array(c)
    assert sorted(at) == list(range(512))
    assert all(abs(at[h] - at[h + 1]).sum() == 1 for h in range(511))


def test_shards_touched_by_a_filter(spark):
    """Each language and source lies in few of 24 shards, with a null row or without, and whatever the names begin with."""
    r = np.random.default_rng(3)
    langs, sources = ["common-prefix-" + x for x in ("de", "en", "es", "fr")], [f"common-prefix-{k}" for k in range(20)]
    rows_ = [(i, "w" * int(r.integers(1, 4000)), str(r.choice(langs, p=[0.13, 0.62, 0.15, 0.1])), str(r.choice(sources))) for i in range(3000)]
    for more in ([], [(3000, None, None, None)]):
        d = spark.createDataFrame(rows_ + more, "doc_id long, text string, lang string, source string")
        out = sharding.hilbert_shards(d).select("doc_id", "shard").join(d, "doc_id")
        by_lang = {x["lang"]: x["n"] for x in out.groupBy("lang").agg(F.countDistinct("shard").alias("n")).collect()}
        by_source = {x["source"]: x["n"] for x in out.groupBy("source").agg(F.countDistinct("shard").alias("n")).collect()}
        assert by_lang["common-prefix-fr"] <= 9 and by_lang["common-prefix-de"] <= 11
        assert max(n for s, n in by_source.items() if s) <= 14
        assert by_lang.get(None, 1) == 1


def test_mixing_by_laying_words_out(spark):
    rows_ = [(i, " ".join(["w"] * (1 + i * 7 % 30)), "abcd"[i * i % 4]) for i in range(60)] + [(60, None, None), (61, "q q q", None)]
    d = spark.createDataFrame(rows_, "doc_id long, text string, source string")
    out = mixing.mix(d, slots=512).collect()
    size = {r["doc_id"]: r["size"] for r in out}
    assert size == {i: len((t or "").split()) for i, t, _ in rows_}
    source = {i: s for i, _, s in rows_}
    sums, taken, target = {}, {}, {}
    for r in out:
        s = source[r["doc_id"]]
        sums[s] = sums.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        target[s] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    names = sorted((s for s in sums if s), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, free, want = 1.5 * sum(sums.values()), set(names), {}
    while True:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > 2 * sums[s]]
        if not over:
            break
        for s in over:
            want[s] = 2 * sums[s]
            left -= want[s]
            free.remove(s)
    want |= {s: weight[s] * level for s in free}
    assert all(abs(want[s] - target[s]) < 1e-6 for s in names)
    block = max(1, -(-int(sum(want.values())) // 512))
    assert all(abs(taken[s] - target[s]) <= 4 * block + 1 for s in names)
    parts = mixing.mixture(d, slots=512)
    per = {r["doc_id"]: r["w"] for r in parts.groupBy("doc_id").agg(F.sum("words").alias("w")).collect()}
    assert per == {r["doc_id"]: r["taken"] for r in out if r["taken"]}
    assert parts.groupBy("slot").agg(F.sum("words").alias("w"), F.countDistinct("source").alias("n")).where(f"w > {block} OR n > 1").count() == 0


def test_rules_by_brute_force(docs):
    import re

    for r in quality_rules.quality_rules(docs).where("doc_id IS NOT NULL").collect():
        t = next(t for i, t, *_ in rows() if i == r["doc_id"]) or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        many = {x for x in wins if wins.count(x) > 1} if len(wins) < 1000 else set(wins)
        rep = {i + k for i, x in enumerate(wins) if x in many for k in range(3)}
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(rep))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(rep) > 50 * len(w))


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_tokens_as_the_library_counts(docs):
    t = library()
    text = {i: x for i, x, *_ in rows()}
    for r in tokens.token_counts(docs).collect():
        x = text[r["doc_id"]] or ""
        n = len(t.encode(x, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(x.encode()), n, n > 1024)


def test_packing_round_trip(docs):
    t = library()
    pieces = packing.pack(docs).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    text = {i: x for i, x, *_ in rows()}
    for i, own in by_doc.items():
        own.sort(key=lambda p: p["start"])
        ids = b"".join(np.array([*t.encode(text[i] or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for _ in range(2 if i == 9 else 1))
        got = b"".join(p["ids"] for p in sorted(own, key=lambda p: (p["sequence_id"], p["offset"])) ) if i == 9 else b"".join(p["ids"] for p in own)
        assert sorted(got) == sorted(ids) if i == 9 else got == ids
    for own in by_sequence.values():
        own.sort(key=lambda p: p["offset"])
        at = 0
        for p in own:
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024 and at & (at - 1) == 0


def test_plan_of_a_skewed_histogram():
    hist = [0] * 1024
    hist[700], hist[324], hist[5], hist[1023], hist[1] = 1000, 10, 333, 7, 9
    plan, seen = packing.Plan(hist), {}
    for n, c in enumerate(hist):
        for r in range(c):
            at = 0
            for start, length, s, offset in plan.place(n, r):
                assert start == at
                at += length
                seen.setdefault(s, []).append((offset, length))
            assert at == n
    assert sorted(seen) == list(range(plan.sequences))
    for parts in seen.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at & (at - 1) == 0 and at <= 1024


def test_jaccard_edges(docs):
    got = {}
    for r in jaccard.jaccard_components(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"]))
    assert got[1] == [(0, 1)] and got[2] == [(0, 2)] and got[3] == [(0, 3)] and got[4] == [(1, 4)]
    assert got[0][0][1] == got[5][0][1] == 0 and got[7] == [(1, 7)]
    assert got[9] == [(1, 9), (1, 9)] and got[None] == [(1, None)]


@pytest.mark.parametrize("limit", [jaccard.GROUP_BYTES, 3000])
def test_jaccard_by_brute_force(spark, limit):
    r = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    texts = []
    passage = list(r.choice(words, 60))
    for _ in range(12):
        base = list(r.choice(words, int(r.integers(6, 160))))
        for _ in range(int(r.integers(1, 25))):
            own = base.copy()
            for _ in range(int(r.integers(0, 4))):
                own[int(r.integers(len(own)))] = str(r.choice(words))
            texts.append(" ".join(own if r.random() < 0.7 else own + passage))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(d, group_bytes=limit).collect()}
    assert got == {i: (len(s), label[i]) for i, s in enumerate(sets)}


def test_embeddings(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(40, 24))
    x = [list(map(float, base[int(r.integers(40))] + 0.1 * r.normal(size=24))) for _ in range(300)]
    x[5] = x[6] = x[7]
    rows_ = [(i, v, 1, "c") for i, v in enumerate(x)]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 24), (1003, [float("nan")] * 24), (1004, [None] + [1.0] * 23), (1005, [float("inf")] * 24), (1006, [1.0, 2.0])]
    d = spark.createDataFrame(rows_ + [(i, v, 1, "c") for i, v in odd], "vec_id long, embedding array<double>, n_links int, component_id string")
    a = np.array(x)
    near = (a @ a.T) / np.outer(*[np.linalg.norm(a, axis=1)] * 2) >= 0.95
    np.fill_diagonal(near, False)
    i, j = np.nonzero(near)
    label = embeddings.forest(len(a), i, j)
    for chunk in (embeddings.CHUNK, 20):
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_vectors(d, chunk=chunk).collect()}
        assert all(got[k] == (near[k].sum(), label[k], label[k] == k) for k in range(300))
        assert all(got[k] == (0, k, True) for k, _ in odd)
    assert embeddings.near_vectors(d.limit(0)).collect() == []


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""), ("", ""), ("<p>", ""), ("plain, text", "plain, text"),
        ("<html><body><nav><a>Menu</a></nav><article><h1>T</h1><p>One,  two &amp; three.<p>Four<br>five.</article><div class='comments'><p>Me too, yes, yes, yes.</p></div><footer>F</footer>", "T\n\nOne, two & three.\n\nFour five."),
        ("<div id=sidebar><p>Side, bar, with, many, commas, in, it.</p></div><div id=main><p>Body text, long enough to count, here.</p><script>x('<p>no</p>')</script></div>", "Body text, long enough to count, here."),
        ("<div><div><p>a, b, c.</p></div><p>Sibling prose stays.</p></div>", "a, b, c.\n\nSibling prose stays."),
    ],
)
def test_html(html, want):
    assert html_text.main_text(html) == want


def test_html_table(spark):
    d = spark.createDataFrame([(1, None, None, "x"), (2, "u", "<p>Hi.</p>", "y"), (2, "u", "<p>Hi.</p>", "y"), (None, "v", "<div>" * 3000 + "deep, text" + "</div>" * 3000, "z")], "page_id long, url string, html string, text string")
    got = sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in html_text.extract(d).collect())
    assert got == [("1", "", 0), ("2", "Hi.", 3), ("2", "Hi.", 3), ("None", "deep, text", 10)]
    assert html_text.extract(d.limit(0)).collect() == []


def test_linked_sizes_far_apart():
    """Groups of very short and very long sets: links found, and signatures of long ones stay sharp beside short ones."""
    r = np.random.default_rng(4)
    sets = []
    for size in (3, 40, 150, 700, 3000, 21_000, 70_000):
        base = r.integers(0, 1 << 63, size, np.uint64)
        sets += [np.unique(base), np.unique(np.concatenate([base[size // 10 :], r.integers(0, 1 << 63, size // 10, np.uint64)])), np.unique(r.integers(0, 1 << 63, size, np.uint64))]
    share = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    args = [jaccard.signature(s) for s in sets], [len(s) for s in sets], [int(s[0]) for s in sets], np.arange(len(sets)), 80, 100
    want = [min(j for j in range(i + 1) if share(sets[i], sets[j]) >= 0.8) for i in range(len(sets))]
    assert jaccard._linked(*args, sets)[1].tolist() == want
    possible = jaccard._linked(*args)[1].tolist()
    assert all(possible[i] == possible[w] for i, w in enumerate(want)) and possible[6:] == want[6:]
