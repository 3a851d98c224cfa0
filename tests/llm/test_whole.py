"""Whole texts, all widths, long ways: what a bound, a prefix or a round limit would lose."""

import random
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnwork.llm import cnn, embeddings, html_text, mixing, queries, toxicity
from cairnwork.llm.common import connected_components, hot_join

DATA = "/root/testdata/sf0.01"


def test_packed_ids_are_the_library_s(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall())
    pieces = queries.op4_packing(spark, DATA).toPandas()
    seen = {}
    for r in pieces.itertuples():
        seen.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    assert seen.keys() == texts.keys()
    for i, text in texts.items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for start, length, crc in sorted(seen[i]):
            assert start == at and crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    full = pieces.groupby("sequence_id").length.sum()
    assert all(n & (n - 1) == 0 for n in full if n != 1024) and full.max() == 1024


def test_components_of_a_long_path(spark):
    order = list(range(5000))
    random.Random(4).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(4999)], "a long, b long")
    assert connected_components(edges).agg(F.count("*"), F.max("component")).first()[:] == (5000, 0)


def test_hot_join(spark):
    rows = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(30_000)], "k long, v long")
    marks = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("low"))
    a = hot_join(rows, marks, ["k"], "n").agg(F.count("*"), F.sum("low"), F.sum("v")).first()
    assert a == rows.join(marks, "k").agg(F.count("*"), F.sum("low"), F.sum("v")).first()


def test_vectors_of_many_widths_and_sizes(spark):
    rows = [(2 * w + k, [1.0 + k * 1e-3] + [2.0] * w) for w in range(1001) for k in (0, 1)]
    near = [1.0, 2.0, 3.0, 4.0]
    far = [(5000 + k, [x * s for x in near]) for k, s in enumerate((1e200, 1e-200, 5e-324 * 2**40, 1.0000001e200))]
    zero = [(6000, [0.0, 1.0, 5.0]), (6001, [-0.0, 1.0, 5.0]), (None, [0.0, 1.0, 5.0]), (6001, [9.0, 9.0, -9.0])]
    got = embeddings.near_vectors(spark.createDataFrame(rows + far + zero, "vec_id long, embedding array<double>")).collect()
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"]))
    assert all(by[2 * w + k] == [(1, 2 * w)] for w in range(1001) for k in (0, 1) if w not in (2, 3))
    assert by[5000][0] == by[5003][0] and by[5000][0][0] == by[5001][0][0] == by[5002][0][0] and by[5000][0][0] >= 3
    assert by[6000] == [(2, 6000)] and by[None] == [(2, 6000)] and sorted(by[6001]) == [(0, 6001), (2, 6000)]


def test_vectors_beyond_one_chunk(spark):
    """Cut cells, hot clusters and trees give the links of brute force."""
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(size=(1500, 24)), r.normal(size=24) + 0.05 * r.normal(size=(500, 24)), r.normal(size=(1000, 24)) + 6 * np.eye(24)[0]])
    d = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    label = embeddings.forest(len(x), *np.nonzero(near))
    for chunk in (256, 100_000):
        got = {g["vec_id"]: (g["n_links"], g["component_id"]) for g in embeddings.near_vectors(d, chunk=chunk).collect()}
        assert all(got[k] == (near[k].sum(), label[k]) for k in range(len(x)))


def test_learning_reads_whole_texts(spark):
    """The only signal stands after character 20,000, in the sample as in the network."""
    r = random.Random(2)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(2, 8)))
    text = lambda y: " ".join(word() for _ in range(3700)) + (" zzqq!" * 300 if y else " yyww." * 300)
    rows = [(i, text(i % 2)) for i in range(60)]
    assert min(len(t) for _, t in rows) > 20_000
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    sample = cnn.labelled_sample(docs, labels, "quality", cnn.FOLDS, cnn.HELD_OUT, 2000, 1)
    assert all(t == rows[k][1] for t, _ in sample.rows for k in [next(i for i, x in rows if x == t)])
    s = cnn.quality_scores(docs, labels).where("held_out").collect()
    assert len(s) > 10 and sum(x["predicted"] == x["doc_id"] % 2 for x in s) / len(s) > 0.9


def test_gradient_by_differences():
    """Whole texts of one and of many chunks: the gradient is that of the loss of score()."""
    net = cnn.ByteCNN()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    texts = ["short", "a longer text, " * 120, "x" * 700 + " end."]
    y = np.array([1.0, 0.0, 1.0])
    loss = lambda: float(-np.mean(y * np.log(net.score(texts)) + (1 - y) * np.log(1 - net.score(texts)))) + 5e-5 * sum(float((net.p[k] ** 2).sum()) for k in ("mean", "most"))
    grad = net._grad([net._blocks(t) for t in texts], y)
    for k in ("mean", "most", "bias", "short", "b", "conv", "embed"):
        flat = net.p[k].reshape(-1)
        for j in np.argsort(-np.abs(grad[k].reshape(-1)))[:3]:
            own, ends = flat[j], []
            for step in (1e-5, -1e-5):
                flat[j] = own + step
                ends.append(loss())
            flat[j] = own
            assert abs((ends[0] - ends[1]) / 2e-5 - grad[k].reshape(-1)[j]) < 1e-4 + 1e-2 * abs(grad[k].reshape(-1)[j])


def test_one_class_or_no_label():
    assert set(cnn.ByteCNN().fit([]).score(["a", None, "b" * 5000])) == {0.5}
    assert (cnn.ByteCNN().fit([("a", 1), ("b", 1)]).score(["a", ""]) > 0.5).all()
    assert set(toxicity.Toxicity(cnn.Sample([], {})).score(["a", None])) == {0.5}
    assert (toxicity.Toxicity(cnn.Sample([("a b", 0)] * 9, {0: 1.0})).score(["a", ""]) < 0.5).all()


def test_scores_are_rates_of_the_table():
    """A sample of as many toxic as other rows, with weights, gives the rates of a table with one in twenty."""
    r = random.Random(8)
    row = lambda y: (" ".join(r.choices(["sun", "sea", "tree", "road", "house", "vile"] if y or r.random() < 0.03 else ["sun", "sea", "tree", "road", "house", "calm"], k=12)), y)
    both = [row(i % 2) for i in range(1200)]
    even, rare = (toxicity.Toxicity(cnn.Sample(both, w)) for w in ({0: 1.0, 1: 1.0}, {0: 19.0, 1: 1.0}))
    texts = ["sun vile sea tree vile road house sun sea tree vile house"]
    assert even.score(texts)[0] > 0.9 > 0.85 > rare.score(texts)[0] > 0.3


def plain_text(root):
    """The scorer in its plainest form, for small trees: every ancestor is walked to for every paragraph."""
    walk = lambda n: [n, *(x for c in n.children if not isinstance(c, str) for x in walk(c))]
    flat = lambda c: c if isinstance(c, str) else "".join(map(flat, c.children))
    strings = lambda n: [c for x in walk(n) for c in x.children if isinstance(c, str)]
    length = lambda parts: sum(len(" ".join(p.split())) for p in parts)
    nodes = html_text._clean(root)
    linked = {id(n): sum(length(strings(x)) for x in walk(n) if x is not n and x.tag == "a" and not any(p.tag == "a" for p in above(x, n))) for n in nodes}
    score = {id(n): 0.0 for n in nodes}
    for n in nodes:
        chars = length(strings(n))
        prose = n.tag in html_text.PROSE
        if chars and (prose or n.tag in html_text.BLOCK and any(isinstance(c, str) and c.strip() for c in n.children)):
            points = (1 + flat(n).count(",") + min(3, chars / 100)) * (1 - linked[id(n)] / chars)
            up, share = n.parent if prose else n, 1.0
            while up is not None:
                score[id(up)] += points * share
                up, share = up.parent, share / 2
    return score, nodes


def above(x, n):
    out, x = [], x.parent
    while x is not None and x is not n:
        out.append(x)
        x = x.parent
    return out


@pytest.mark.parametrize("seed", range(40))
def test_html_scores_by_a_plain_scorer(seed):
    r = random.Random(seed)
    tags = ["div", "p", "section", "ul", "li", "a", "b", "article", "blockquote", "table", "tr", "td", "span", "h2"]
    soup = "".join(r.choice([f"<{t}>", f"</{t}>", "one, two. ", "more words here, and, more ", " ", '<a href="x">link</a>']) for t in r.choices(tags, k=80))
    score, nodes = plain_text(html_text.parse(soup))
    own = html_text._clean(html_text.parse(soup))
    html_text.best_container(own)
    assert len(own) == len(nodes) and all(abs(a.score - score[id(b)]) < 1e-9 for a, b in zip(own, nodes, strict=True))


@pytest.mark.parametrize("seed", range(40))
def test_no_markup_in_the_text(seed):
    r = random.Random(seed)
    bits = ["<p>", "</p>", '<a title="', "<div class='x", '">', "'>", "<b", "</b>", "<!--", "-->", "<br/>", "word, ", "<script>if (a<b)", "</script>", "=", '"', "'", "<td ", "<h1>", "&lt;", "<?php ?>", "<!x>", "< ", "\n"]
    text = html_text.main_text("".join(r.choices(bits, k=60)))
    assert not any(f"<{t}" in text.replace("< ", "") for t in ("p", "a ", "div", "b", "/", "!", "br", "script", "td", "h1", "?"))


def test_broken_and_deep_pages_take_linear_time():
    assert html_text.main_text('<p>Hello <a title="x>there</a> friend, yes it is.</p>') == "Hello there friend, yes it is."
    assert html_text.main_text("<article><p>One, two.</p><p class=print>Kept.</p><p class='legal tags'>Also.</p><p class=ad>Buy.</p></article><div class=legal>Gone.</div>") == "One, two.\n\nKept.\n\nAlso."
    for bit in ("<div>x, y ", '<a "', '<a b="', "<span>a<p>", "<h1>", "<!-", "<header>a", "<ul><li>a, b", "</x", "<table><tr><td>", "<"):
        start = time.process_time()
        html_text.main_text(bit * 50_000)
        assert time.process_time() - start < 8, bit  # a few hundred times as long if it grew with the square


def test_very_long_page(spark):
    d = spark.createDataFrame([(1, "u", "<article>" + "<p>Some words, and more words here.</p>" * 40_000 + "</article>")], "page_id long, url string, html string")
    assert html_text.extract(d).first()["n_chars"] == 40_000 * 32 + 2 * 39_999


def test_mixing_of_one_and_of_many_small_sources(spark):
    one = mixing.mix(spark.createDataFrame([(i, "a b c", "s") for i in range(50)], "doc_id long, text string, source string")).agg(F.sum("taken"), F.max("taken")).first()
    assert one[0] == 225 and one[1] <= 6
    d = spark.createDataFrame([(i, "a b c d", f"s{i % 60:02d}") for i in range(240)], "doc_id long, text string, source string")
    per = mixing.mix(d, slots=16).groupBy("source_size", "target").agg(F.sum("taken").alias("t"), F.count("*").alias("n"))
    out = mixing.mix(d, slots=16, carry=("source",)).groupBy("row_.source").agg(F.sum("taken").alias("t"), F.max("target").alias("target")).collect()
    assert len(out) == 60 and all(abs(r["t"] - r["target"]) <= 1 for r in out) and per.count() > 0


def test_mixing_sql_with_small_sources(spark):
    rows = [(i, "w " * (1 + i % 7), "big") for i in range(4000)] + [(4000 + i, "x y", f"tiny{i % 9}") for i in range(18)] + [(5000, None, None)]
    want = duckdb.connect()
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want.register("documents", d.toPandas())
    a = mixing.mix(d, slots=64).drop("row_", "copies").toPandas().sort_values("doc_id").reset_index(drop=True)
    b = want.sql(mixing.oracle_sql(slots=64)).df().sort_values("doc_id").reset_index(drop=True)
    assert (a[["doc_id", "size", "source_size", "taken"]].to_numpy() == b[["doc_id", "size", "source_size", "taken"]].to_numpy()).all() and np.allclose(a.target, b.target)
