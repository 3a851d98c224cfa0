"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration, in numpy.

Features are densities of a lexicon and of word beginnings, both drawn from labelled rows, how near such words are to
the second person, capitals, punctuation and obfuscation rates. The trees
learn each labelled row with a lexicon of other rows, so that they see the lexicon as new texts show it, and the
calibration is fitted on rows that the trees haven't seen.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cnn import Sample, held_out, labelled_sample, scored

#: Labelled rows of each class that are learned from: the bound on what the driver gets.
TRAIN_ROWS = 3000
FOLDS, HELD_OUT = 5, 0
SEED = 6
#: Letters of a word's beginning, and how many more times as common in toxic rows an entry of the
#: lexicon must be; it must also be in so many toxic rows, and so large a share of them, or a copied row would make entries.
STEM = 4
RATIO, LEAST_ROWS, LEAST_SHARE = 12.0, 4, 0.015
TREES, DEPTH, RATE, LEAVES = 60, 3, 0.2, 12
BINS = 32
FEATURES = 10
NEAR = 4

# Second-person words of the four languages, in lower case.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine euch ihr ti tú usted ustedes vos vosotros tus".split())
# Characters that stand for letters in obfuscated words.
LOOKALIKE = str.maketrans("013457@$!", "oieastasi")
_MARKS = str.maketrans({c: " " for c in ".,;:?\"()[]{}<>|/\\…«»„“”¡¿"})
_MASKED = re.compile(r"[*@$#!0-9]+(?:(?<=\w[*@$#!0-9])|(?<=\w[*@$#!0-9]{2}))(?=\w)")
_DRAWN = re.compile(r"a{3,}|e{3,}|i{3,}|o{3,}|u{3,}")


def _tokens(text: str) -> list[str]:
    return text.lower().translate(_MARKS).split()


def _plain(word: str) -> str:
    """A word without obfuscation: look-alikes as letters, marks between letters dropped."""
    return word if word.isalpha() else re.sub(r"[^\w]|_", "", word.translate(LOOKALIKE))


class Lexicon:
    def __init__(self, rows: list[tuple[str, int]]) -> None:
        """Words and word beginnings that are RATIO times as common in toxic rows as in others, smoothed by half a row."""
        seen = {0: (Counter(), Counter()), 1: (Counter(), Counter())}
        n = {0: 0.5, 1: 0.5}
        for text, y in rows:
            own = set(map(_plain, _tokens(text)))
            seen[y][0].update(own)
            seen[y][1].update({w[:STEM] for w in own if len(w) > STEM})
            n[y] += 1
        pick = lambda k: {w for w, c in seen[1][k].items() if c >= max(LEAST_ROWS, LEAST_SHARE * n[1]) and len(w) > 2 and c / n[1] > RATIO * (seen[0][k][w] + 0.5) / n[0]}
        self.stems = pick(1)
        self.words = {w for w in pick(0) if w[:STEM] not in self.stems}

    def features(self, text: str | None) -> list[float]:
        text = text or ""
        words, n = _tokens(text), 0
        known, stems = self.words, self.stems
        hits = [i for i, w in enumerate(words) if w in known or (w[:STEM] in stems and len(w) > STEM)]
        masked, marked = 0, len(_MASKED.findall(text))
        if marked:
            for i, w in enumerate(words):
                if not w.isalpha() and (p := _plain(w)) != w and (p in known or (p[:STEM] in stems and len(p) > STEM)):
                    masked += 1
                    hits.append(i)
        n = len(words) or 1
        chars = len(text) or 1
        near = sum(1 for i in hits if not SECOND_PERSON.isdisjoint(words[max(0, i - NEAR) : i + NEAR + 1])) if hits else 0
        kinds = len({words[i] for i in hits})
        capitals = sum(map(str.isupper, text.split())) if not text.islower() else 0
        marks = text.count("!") + text.count("?")
        return [len(hits) / n, float(np.log1p(len(hits))), kinds, near / n, float(np.log1p(near)), capitals / n, marks / chars, masked / n, marked / n, len(_DRAWN.findall(text)) / n]


class Trees:
    """Boosted regression trees on the logistic loss, over features cut into at most BINS steps."""

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c[c > 0], np.linspace(0, 1, BINS)) if (c > 0).any() else np.zeros(1)) for c in x.T]
        b = self._bins(x)
        rate = min(max(float(np.average(y, weights=weight)) if len(y) else 0.5, 1e-3), 1 - 1e-3)
        self.base, self.trees = float(np.log(rate / (1 - rate))), []
        f = np.full(len(y), self.base)
        self.least = max(2, min(LEAVES, int(min(y.sum(), len(y) - y.sum())) // 8))
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            tree, leaf = self._grow(b, weight * (y - p), weight * p * (1 - p))
            self.trees.append(tree)
            f += leaf
        return self

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T, strict=True)], 1)

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray):
        """([(feature, step) of each inner node], [value of each leaf]) of a full tree, and each row's value."""
        splits, node = [], np.zeros(len(g), np.int64)
        for depth in range(DEPTH):
            chosen = []
            for k in range(1 << depth):
                own = np.flatnonzero(node == k)
                best = (1e-9, 0, BINS + 1)
                total_g, total_h = g[own].sum(), h[own].sum()
                for j in range(b.shape[1]):
                    sg, sh, sn = (np.cumsum(np.bincount(b[own, j], w, BINS + 2)) for w in (g[own], h[own], None))
                    ok = (sn >= self.least) & (len(own) - sn >= self.least)
                    gain = np.where(ok, sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1), 0)
                    at = int(gain.argmax())
                    if gain[at] > best[0]:
                        best = (float(gain[at]), j, at)
                chosen.append(best[1:])
            splits.append(chosen)
            feature, step = np.array(chosen).T
            node = 2 * node + (b[np.arange(len(g)), feature[node]] > step[node])
        leaves = RATE * np.bincount(node, g, 1 << DEPTH) / (np.bincount(node, h, 1 << DEPTH) + 1)
        return (splits, leaves), leaves[node]

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, out, rows = self._bins(x), np.full(len(x), self.base), np.arange(len(x))
        for splits, leaves in self.trees:
            node = np.zeros(len(x), np.int64)
            for chosen in splits:
                feature, step = np.array(chosen).T
                node = 2 * node + (b[rows, feature[node]] > step[node])
            out += leaves[node]
        return out


def isotonic(m: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(margins, rising rates) by pooling adjacent violators; each pool is smoothed by a row of weight one, half of each class."""
    order = np.argsort(m, kind="stable")
    pools: list[list[float]] = []
    for a, b, w in zip(m[order].tolist(), (y * weight)[order].tolist(), weight[order].tolist(), strict=True):
        pools.append([b, w, a, a])
        while len(pools) > 1 and (pools[-2][3] == pools[-1][2] or pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]):
            s, n, _, hi = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2], hi]
    at = np.array([x for p in pools for x in (p[2], p[3])]) if pools else np.zeros(1)
    rate = np.array([x for p in pools for x in [(p[0] + 0.5) / (p[1] + 1)] * 2]) if pools else np.full(1, 0.5)
    return at, np.maximum.accumulate(rate)


class Toxicity:
    def __init__(self, sample: Sample, folds: int = 4) -> None:
        """Features of each fold of the rows come from a lexicon of the other folds, as new texts will have them.

        Rows weigh as many rows of their class as they stand for, over the mean, so that a bound on the sample doesn't move rates.
        """
        rows = sample.rows
        weight = np.array([sample.weight[v] for _, v in rows])
        weight = weight / weight.mean() if len(rows) else weight
        x, y = np.zeros((len(rows), FEATURES)), np.array([v for _, v in rows], float)
        for k in range(folds):
            lexicon = Lexicon([r for i, r in enumerate(rows) if i % folds != k])
            for i in range(k, len(rows), folds):
                x[i] = lexicon.features(rows[i][0])
        self.lexicon = Lexicon(rows)
        part = np.arange(len(y)) // folds % 4 < 3
        self.trees = Trees().fit(x[part], y[part], weight[part])
        rest = ~part if not part.all() else part  # a handful of rows serve both
        self.at, self.rate = isotonic(self.trees.margin(x[rest]), y[rest], weight[rest])

    def score(self, texts: list[str | None]) -> np.ndarray:
        m = self.trees.margin(np.array([self.lexicon.features(t) for t in texts]).reshape(-1, FEATURES))
        return np.interp(m, self.at, self.rate)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Toxicity:
    return Toxicity(labelled_sample(docs, labels, "toxic", FOLDS, HELD_OUT, TRAIN_ROWS, SEED, id_col, text_col))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted (1 if score >= 0.5).

    Only the text enters a score. Null and empty texts have all features 0. Null ids pass through, repeated rows are
    scored each, other columns aren't read; an empty table gives an empty result. At most TRAIN_ROWS rows
    of each class are learned from, weighed by the class's share of all labelled rows, so scores are rates of the table.
    """
    model = train(docs, labels, id_col, text_col)
    s = scored(docs, model.score, id_col=id_col, text_col=text_col)
    return s.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
