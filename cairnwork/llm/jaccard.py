"""Join of documents by the Jaccard similarity of their word shingles, with signature trees.

Documents with the same shingle set are one node. Two sets of similarity t or more share a token among their
first n - ceil(t n) + 1 in any order of tokens that all documents follow; here frequent tokens come last. All nodes
with a token in that prefix form a block, and blocks led by the same node are one group. In a group a signature tree
holds for each of its inner nodes the OR of token bitmaps and the range of set sizes; pairs of inner nodes whose
largest possible overlap is too small for their sizes are dropped with all that is below them, and what remains is
compared exactly. Pairs already known to be connected are skipped: the result is the components. The traversal runs twice, first with
bitmaps alone, so that only the sets of nodes that may have a partner are sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import bounded_batches, connected_components, cut, hot_join, text_slices, tidy

SHINGLE = 5
#: Similarity as a fraction: 100 * intersection >= 80 * union.
NUM, DEN = 80, 100
#: Tokens that the order puts last, by their counts: the bound of a broadcast. Any set of them gives right results.
FREQUENT, FREQUENT_LEAST = 1 << 17, 24
#: Bytes of shingle sets that one task compares at once; larger groups are cut into chunks, and chunks meet in pairs.
GROUP_BYTES = 24 << 20
#: Bits of the bitmap that tells which documents' sets are needed; when it is full, all are sent and joined.
NEED_BITS = 24
FANOUT = 8
#: Of a signature's plane: twice as many bits as tokens up to two to this power.
MOST_BITS = 17
#: Characters of text hashed at once.
TEXT_BYTES = 1 << 20


_BYTE = np.random.default_rng(9).integers(0, 1 << 64, 256, np.uint64)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]  # A-Z count as a-z
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64, n of each at least."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(1 << n.bit_length(), b, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[str | None], k: int = SHINGLE) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its k-word shingles.

    Fewer words than k are one shingle, no words none. All texts are hashed together: a word's hash is a polynomial in
    its bytes, taken from running sums, and a shingle's a sum over its words by place. Both are mixed.
    """
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    line = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    power, inverse = _power(len(line) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[line] * power[: len(line)])])
    gap = _GAP[line]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap]).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]  # the line ends with a gap
    word = _mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    ends = np.cumsum([len(r) + 1 for r in raw])
    first = np.searchsorted(start, np.append(0, ends))
    out = []
    whole = np.zeros(max(0, len(word) - k + 1), np.uint64)
    for j in range(k):
        whole += word[j : len(word) - k + 1 + j] * _place(j)
    whole = _mix(whole + np.uint64(k))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(whole[a : b - k + 1]))
        elif b > a:
            h = sum((int(w) * int(_place(j)) for j, w in enumerate(word[a:b])), b - a) & (1 << 64) - 1
            out.append(_mix(np.array([h], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _place(j: int) -> np.uint64:
    return _PLACE[j % len(_PLACE)] + np.uint64(2 * (j // len(_PLACE)))


def fingerprint(s: np.ndarray) -> int:
    """Signed 64 bits for a whole set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def prefix_size(n: int, num: int = NUM, den: int = DEN) -> int:
    return n - -(-num * n // den) + 1


class Frequent:
    """Frequent tokens with their counts; orders a set with the others by hash first, then these by count."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(tokens)
        self.tokens, self.counts = tokens[order], counts[order]

    def prefix(self, s: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(first n tokens, which of them are frequent)."""
        if not len(self.tokens):
            return s[:n], np.zeros(min(n, len(s)), bool)
        at = np.minimum(np.searchsorted(self.tokens, s), len(self.tokens) - 1)
        hot = self.tokens[at] == s
        rare = s[~hot][:n]
        if len(rare) == n:
            return rare, np.zeros(n, bool)
        late = s[hot]
        late = late[np.lexsort((late, self.counts[at[hot]]))][: n - len(rare)]
        return np.concatenate([rare, late]), np.append(np.zeros(len(rare), bool), np.ones(len(late), bool))


class _Seen:
    """Fingerprints met in a task, as far as a bound; forgetting one only costs a row more."""

    def __init__(self, most: int = 1 << 18) -> None:
        self.own, self.most = set(), most

    def new(self, fp: int) -> bool:
        if fp in self.own:
            return False
        if len(self.own) >= self.most:
            self.own.clear()
        self.own.add(fp)
        return True


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def signature(s: np.ndarray) -> tuple[bytes, int]:
    """(two bit planes, tokens beyond them) of a set: bits with a token, bits with two, tokens that are third or later."""
    bits = 1 << min(MOST_BITS, max(8, (2 * len(s) - 1).bit_length()))
    c = np.bincount((s >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits)
    return np.packbits(c > 0).tobytes() + np.packbits(c > 1).tobytes(), int(np.maximum(c - 2, 0).sum())


def _folded(raw: bytes, beyond: int, size: int) -> tuple[np.ndarray, int]:
    """A signature as if made with planes of `size` bytes: halves are laid on each other."""
    p = np.frombuffer(raw, np.uint8).reshape(2, -1)
    while p.shape[1] > size:
        h = p.shape[1] // 2
        a, b = p[:, :h], p[:, h:]
        beyond += int(np.bitwise_count(a[1] & b[0]).sum(dtype=np.int64) + np.bitwise_count(a[0] & b[1]).sum(dtype=np.int64))
        p = np.stack([a[0] | b[0], a[1] | b[1] | (a[0] & b[0])])
    return p.reshape(-1), beyond


class SignatureTree:
    """Signatures and size ranges over sets in the order of their least tokens; links() runs the dual traversal.

    The overlap of two sets is at most the common bits of both planes and the smaller count beyond; ORs and maxima of
    these bound the overlap of any two sets below two inner nodes. With sets, pairs that pass are compared exactly;
    without, they count as linked.
    """

    def __init__(self, signatures: list[tuple[bytes, int]], sizes: list[int], least: list[int], labels: np.ndarray, num: int, den: int, sets: list[np.ndarray] | None = None) -> None:
        self.num, self.den = num, den
        self.order = np.argsort(np.array(least, np.uint64), kind="stable")
        self.sets = [sets[i] for i in self.order] if sets else None
        self.root = labels[self.order].copy()
        n = np.array(sizes, np.int64)[self.order]
        size = min(len(raw) // 2 for raw, _ in signatures)
        folded = [_folded(*signatures[i], size) for i in self.order]
        planes = np.stack([f[0] for f in folded]).view(np.uint64)
        self.levels = [(planes, np.array([f[1] for f in folded], np.int64), n, n)]
        while len(self.levels[-1][1]) > FANOUT:
            p, b, low, high = self.levels[-1]
            at = np.arange(0, len(b), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(p, at, 0), np.maximum.reduceat(b, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))

    def _possible(self, level: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        p, beyond, low, high = self.levels[level]
        num, den = self.num, self.den
        ok = (den * high[u] >= num * low[v]) & (den * high[v] >= num * low[u])
        out = np.flatnonzero(ok)
        u, v = u[out], v[out]
        overlap = np.bitwise_count(p[u] & p[v]).sum(1, dtype=np.int64) + np.minimum(beyond[u], beyond[v])
        overlap = np.minimum(overlap, np.minimum(high[u], high[v]))
        return out[(num + den) * overlap >= num * (low[u] + low[v])]

    def _same(self, level: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Pairs below which all is one component already."""
        low = high = self.root
        for _ in range(level):
            at = np.arange(0, len(low), FANOUT)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
        return (low[u] == high[u]) & (low[v] == high[v]) & (low[u] == low[v])

    def _compare(self, u: np.ndarray, v: np.ndarray, out: list[tuple[int, int]]) -> None:
        apart = self.root[u] != self.root[v]
        u, v = u[apart], v[apart]
        while len(u):
            for i, j in zip(u[:128].tolist(), v[:128].tolist(), strict=True):
                if self.root[i] == self.root[j]:
                    continue
                linked = self.sets is None
                if not linked:
                    a, b = self.sets[i], self.sets[j]
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    linked = self.den * both >= self.num * (len(a) + len(b) - both)
                if linked:
                    out.append((int(self.order[i]), int(self.order[j])))
                    x, y = self.root[i], self.root[j]
                    self.root[self.root == max(x, y)] = min(x, y)
            u, v = u[128:], v[128:]
            apart = self.root[u] != self.root[v]
            u, v = u[apart], v[apart]

    def links(self, block: int = 1 << 15) -> list[tuple[int, int]]:
        """Pairs of places in the sets given, enough to connect all that are linked."""
        out: list[tuple[int, int]] = []
        top = len(self.levels) - 1
        u, v = np.triu_indices(len(self.levels[top][1]), 1 if top == 0 else 0)
        todo = [(top, u, v)]
        while todo:
            level, u, v = todo.pop()
            if len(u) > block:
                todo.append((level, u[block:], v[block:]))
                u, v = u[:block], v[:block]
            apart = ~self._same(level, u, v)
            u, v = u[apart], v[apart]
            keep = self._possible(level, u, v)
            u, v = u[keep], v[keep]
            if not len(u):
                continue
            if level == 0:
                self._compare(u, v, out)
                continue
            n = len(self.levels[level - 1][1])
            i = (u[:, None] * FANOUT + np.repeat(np.arange(FANOUT), FANOUT)).ravel()
            j = (v[:, None] * FANOUT + np.tile(np.arange(FANOUT), FANOUT)).ravel()
            ok = (i < n) & (j < n) & ((i < j) | ((i == j) & (level > 1)))
            todo.append((level - 1, i[ok], j[ok]))
        return out


def _linked(signatures: list[tuple[bytes, int]], sizes: list[int], least: list[int], labels: np.ndarray, num: int, den: int, sets: list[np.ndarray] | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(pairs of places, enough to connect all that are linked; the label of each place's component).

    A tree for each size of planes holds the signatures of that size and of those larger ones that a partner may have,
    folded to it, so that short texts in a group don't blur the signatures of long ones.
    """
    root, out = labels.copy(), []
    planes = np.array([len(raw) for raw, _ in signatures])
    for size in np.unique(planes):
        at = np.flatnonzero((planes >= size) & (num * planes < 2 * den * size))
        if len(at) < 2:
            continue
        pick = lambda values: [values[i] for i in at]  # noqa: E731, B023
        tree = SignatureTree(pick(signatures), pick(sizes), pick(least), root[at], num, den, pick(sets) if sets else None)
        for i, j in tree.links():
            i, j = int(at[i]), int(at[j])
            out.append((i, j))
            x, y = root[i], root[j]
            root[root == max(x, y)] = min(x, y)
    return out, root


def _groups(batches: Iterator[pa.RecordBatch], values: int) -> Iterator[list[tuple]]:
    """Rows' last columns, group by group, from batches sorted by the columns before."""
    key, rows = None, []
    for batch in batches:
        cols = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
        for k, row in zip(zip(*cols[:-values], strict=True), zip(*cols[-values:], strict=True), strict=True):
            if k != key:
                if len(rows) > 1:
                    yield rows
                key, rows = k, []
            rows.append(row)
    if len(rows) > 1:
        yield rows


def _pairs_out(found: Iterator[list[tuple[int, int]]], names: list[str]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, int]] = []
    flush = lambda: pa.RecordBatch.from_arrays([pa.array([f[k] for f in held], pa.int64()) for k in (0, 1)], names)
    for pairs in found:
        held += pairs
        if len(held) > 10_000:
            yield flush()
            held = []
    yield flush()


def _links(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of the groups in batches (group..., fp, root, tokens), sorted by group."""

    def solve(rows: list[tuple]) -> list[tuple[int, int]]:
        own = {fp: (root, np.frombuffer(raw, np.uint64)) for fp, root, raw in rows}
        if len(own) < 2:
            return []
        fps = list(own)
        sets = [own[f][1] for f in fps]
        pairs, _ = _linked([signature(s) for s in sets], [len(s) for s in sets], [int(s[0]) for s in sets], np.array([own[f][0] for f in fps], np.int64), num, den, sets)
        return [(fps[i], fps[j]) for i, j in pairs]

    yield from _pairs_out((solve(rows) for rows in _groups(batches, 3)), ["a", "b"])


def _possible_groups(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """(leader, fp) of what signatures can't rule out, from (leader, fp, n, least, planes, beyond) sorted by leader.

    Nodes connected by possible pairs are a group of their own, led by its first; nodes without one are gone.
    """

    def solve(rows: list[tuple]) -> list[tuple[int, int]]:
        rows = list({r[0]: r for r in rows}.values())
        if len(rows) < 2:
            return []
        _, roots = _linked([(r[3], r[4]) for r in rows], [r[1] for r in rows], [r[2] & (1 << 64) - 1 for r in rows], np.arange(len(rows)), num, den)
        groups: dict[int, list[int]] = {}
        for row, root in zip(rows, roots.tolist(), strict=True):
            groups.setdefault(root, []).append(row[0])
        return [(min(g), fp) for g in groups.values() if len(g) > 1 for fp in g]

    yield from _pairs_out((solve(rows) for rows in _groups(batches, 5)), ["leader", "fp"])


def _leaders(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """(leader, fp) from (token, n, fp) in that order: each node with the first one of its block, if there are two.

    A token's nodes fall into blocks where a size is too large for the size before it, and so for all before.
    """
    last = None
    for batch in batches:
        if not len(batch):
            continue
        t, n, f = (batch.column(k).to_numpy() for k in range(3))
        apart = lambda t0, n0, t1, n1: (t0 != t1) | (den * n0 < num * n1)
        new = np.append(last is None or bool(apart(last[0], last[1], t[0], n[0])), apart(t[:-1], n[:-1], t[1:], n[1:]))
        begin = np.flatnonzero(new)
        leads = f[begin]
        if not new[0]:
            begin, leads = np.append(0, begin), np.append(last[2], leads)
        own = leads[np.searchsorted(begin, np.arange(len(t)), side="right") - 1]
        last = (t[-1], n[-1], own[-1])
        more = own != f
        yield pa.RecordBatch.from_arrays([pa.array(own[more]), pa.array(f[more])], ["leader", "fp"])


def jaccard_components(docs: DataFrame, num: int = NUM, den: int = DEN, k: int = SHINGLE, group_bytes: int = GROUP_BYTES, frequent: int = FREQUENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id.

    Documents link when den * intersection >= num * union of their shingle sets; component_id is the smallest id
    reachable, itself included. Null, empty and wordless texts have no shingles and link with nothing. Equal sets link
    whatever their texts. A null id takes part as a document and is never the smallest unless all of its component are
    null; repeated rows link with each other; other columns aren't read; an empty table gives an empty result.

    Shuffled are the prefix tokens of distinct sets (about a fifth of the shingles, 16 bytes each), then the sets of those
    nodes alone that share a prefix token with another. Groups beyond group_bytes are cut into chunks; what chunks
    of a group have left unconnected is compared across them in pairs of chunks, so no task holds a whole hot group.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    rows = bounded_batches(docs).select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    ids_type = to_arrow_type(rows.schema["doc_id"].dataType)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents with their fingerprints, and tokens that are frequent inside this task."""
        seen, counts, held, held_n = _Seen(), {}, [], 0

        def tally() -> None:
            t, c = np.unique(np.concatenate(held), return_counts=True)
            often = c > 2
            for a, b in zip(t[often].tolist(), c[often].tolist(), strict=True):
                counts[a] = counts.get(a, 0) + b
            if len(counts) > 2 * frequent:
                for a in sorted(counts, key=counts.get)[: len(counts) - frequent]:
                    del counts[a]

        for batch in batches:
            for ids, texts in text_slices(batch, TEXT_BYTES):
                fps, ns = [], []
                for s in shingle_sets(texts, k):
                    fps.append(fingerprint(s))
                    ns.append(len(s))
                    if ns[-1] and seen.new(fps[-1]):
                        held.append(s)
                        held_n += len(s)
                if held_n > 1 << 20:
                    tally()
                    held, held_n = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([True] * len(fps)), ids, pa.array(fps, pa.int64()), pa.array(ns, pa.int64())], ["doc", "doc_id", "fp", "n"])
        if held:
            tally()
        best = sorted(counts, key=lambda t: (-counts[t], t))[:frequent]
        yield pa.RecordBatch.from_arrays(
            [pa.array([False] * len(best), pa.bool_()), pa.nulls(len(best), ids_type), _signed(np.array(best, np.uint64)), pa.array([counts[t] for t in best], pa.int64())],
            ["doc", "doc_id", "fp", "n"],
        )

    scanned = cut(rows.mapInArrow(tidy(scan), f"doc boolean, doc_id {kind}, fp long, n long"))
    nodes = scanned.where("doc").select("doc_id", "fp", F.col("n").alias("n_shingles"))
    often = scanned.where("NOT doc").groupBy("fp").agg(F.sum("n").alias("n")).where(f"n >= {FREQUENT_LEAST}").orderBy(F.desc("n"), "fp").limit(frequent).collect()
    table = sc.broadcast(Frequent(np.array([r["fp"] for r in often], np.int64).view(np.uint64), np.array([r["n"] for r in often], np.int64)))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, order = _Seen(), table.value
        for batch in batches:
            for _, texts in text_slices(batch, TEXT_BYTES):
                tokens, ns, fps, hots = [], [], [], []
                for s in shingle_sets(texts, k):
                    if len(s) and seen.new(fp := fingerprint(s)):
                        t, hot = order.prefix(s, prefix_size(len(s), num, den))
                        tokens.append(t)
                        hots.append(hot)
                        fps.append(np.full(len(t), fp, np.int64))
                        ns.append(np.full(len(t), len(s), np.int32))
                if fps:
                    yield pa.RecordBatch.from_arrays([_signed(np.concatenate(tokens)), pa.array(np.concatenate(ns)), pa.array(np.concatenate(fps)), pa.array(np.concatenate(hots))], ["token", "n", "fp", "hot"])

    prefix = rows.mapInArrow(tidy(prefixes), "token long, n int, fp long, hot boolean")
    spread = prefix.where("NOT hot").select("token", "n", "fp").repartition("token").sortWithinPartitions("token", "n", "fp")
    pairs = spread.mapInArrow(tidy(lambda batches: _leaders(batches, num, den)), "leader long, fp long")
    if often:  # frequent tokens: their leaders are a bounded table, and their rows stay where they are
        hot = cut(prefix.where("hot").select("token", "fp"))
        leads = hot.groupBy("token").agg(F.min("fp").alias("leader"))
        pairs = pairs.union(hot.join(F.broadcast(leads), "token").where("fp <> leader").select("leader", "fp"))
    pairs = cut(pairs.distinct())

    def of_members(pairs: DataFrame) -> tuple[DataFrame, object]:
        """(pairs with the leader among its members, a bitmap of the members to spare other documents the way)."""
        members = pairs.union(pairs.select("leader", F.col("leader").alias("fp"))).distinct()
        spot = F.shiftrightunsigned("fp", 64 - NEED_BITS)
        words = members.select(spot.alias("s_")).groupBy(F.shiftright("s_", 6).alias("w_")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s_ & 63 as int))")).alias("v_")).collect()
        bitmap = np.zeros(1 << NEED_BITS - 6, np.int64)
        for r in words:
            bitmap[r["w_"]] = r["v_"]
        return members, sc.broadcast(bitmap.view(np.uint64)) if words else None

    def of_sets(need, make, names: list[str]):
        """A scan of the texts that sends make(set) of each node in the bitmap, once from a task."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen, bits = _Seen(), need.value
            for batch in batches:
                for _, texts in text_slices(batch, TEXT_BYTES):
                    out = []
                    for s in shingle_sets(texts, k):
                        if len(s):
                            fp = fingerprint(s)
                            at = (fp & (1 << 64) - 1) >> 64 - NEED_BITS
                            if int(bits[at >> 6]) >> (at & 63) & 1 and seen.new(fp):
                                out.append((fp, *make(s)))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["fp", *names])

        return run

    members, need = of_members(pairs)
    if need is None:
        return _with_components(nodes, None)
    look = of_sets(need, lambda s: (len(s), int(s[:1].view(np.int64)[0]), *signature(s)), ["n", "least", "planes", "beyond"])
    signed = rows.mapInArrow(tidy(look), "fp long, n long, least long, planes binary, beyond long").dropDuplicates(["fp"])
    signed = cut(members.join(signed, "fp"))
    weight = signed.groupBy("leader").agg(F.sum(F.octet_length("planes") + 64).alias("w_")).where(f"w_ > {group_bytes}").select("leader")
    weight = cut(weight)
    vast = weight.count() > 0  # groups too large for one task skip this step
    small = signed.join(weight, "leader", "left_anti") if vast else signed
    small = small.select("leader", "fp", "n", "least", "planes", "beyond").repartition("leader").sortWithinPartitions("leader")
    pairs = small.mapInArrow(tidy(lambda batches: _possible_groups(batches, num, den)), "leader long, fp long")
    if vast:
        pairs = pairs.union(signed.join(weight, "leader", "left_semi").select("leader", "fp"))
    members, need = of_members(cut(pairs.distinct()))
    if need is None:
        return _with_components(nodes, None)
    sets = of_sets(need, lambda s: (s.tobytes(),), ["tokens"])
    wanted = rows.mapInArrow(tidy(sets), "fp long, tokens binary").dropDuplicates(["fp"])
    full = members.join(wanted, "fp")
    sizes = cut(members.join(nodes.select("fp", "n_shingles").distinct(), "fp").groupBy("leader").agg(F.sum(F.col("n_shingles") * 8).alias("bytes_")))
    large = sizes.where(f"bytes_ > {group_bytes}").select("leader", F.ceil(F.col("bytes_") / group_bytes).cast("long").alias("chunks_"))
    split = large.count() > 0
    if split:
        full = full.join(large, "leader", "left").withColumn("chunk_", F.pmod(F.xxhash64("fp"), F.coalesce("chunks_", F.lit(1))))
        full = cut(full.select("leader", "chunk_", "fp", "tokens", "chunks_"))
    else:
        full = full.withColumn("chunk_", F.lit(0).cast("long"))
    solve = lambda batches: _links(batches, num, den)
    first = full.select("leader", "chunk_", "fp", F.col("fp").alias("root"), "tokens").repartition("leader", "chunk_").sortWithinPartitions("leader", "chunk_")
    links = cut(first.mapInArrow(tidy(solve), "a long, b long"))
    roots = connected_components(links)
    if split:
        links = links.union(_across(cut(full.where("chunks_ > 1")), cut(roots), group_bytes, solve))
        roots = connected_components(cut(links))
    return _with_components(nodes, roots)


def _across(full: DataFrame, roots: DataFrame, group_bytes: int, solve) -> DataFrame:
    """Edges between chunks of the groups that have several.

    Per group, the nodes of its largest component so far are one side, all others the other side. Others meet others
    and the largest component in pairs of chunks; the largest component needn't meet itself. Others are few where copies
    are many, so what is sent grows with a group's size and not with its square.
    """
    m = full.join(roots, full["fp"] == roots["node"], "left").select("leader", "fp", "tokens", F.coalesce("component", "fp").alias("root"))
    per = m.groupBy("leader", "root").agg(F.sum(F.octet_length("tokens")).alias("b_"))
    main = per.groupBy("leader").agg(F.max_by("root", F.struct("b_", "root")).alias("main_"), F.max(F.struct("b_", "root"))["b_"].alias("main_b"), F.sum("b_").alias("all_b")).where("all_b > main_b")
    # Both sides of a task together stay within group_bytes.
    chunks = lambda c: F.greatest(F.lit(1), F.ceil(2 * c / group_bytes)).cast("int")
    main = main.select("leader", "main_", chunks(F.col("all_b") - F.col("main_b")).alias("ko"), chunks(F.col("main_b")).alias("kc"))
    m = m.join(main, "leader").withColumn("other", F.col("root") != F.col("main_"))
    own = F.pmod(F.xxhash64("fp"), F.when(F.col("other"), F.col("ko")).otherwise(F.col("kc"))).cast("int")
    m = m.withColumn("own", own)
    with_others = F.transform(F.sequence(F.lit(0), F.col("ko") - 1), lambda j: F.struct(F.lit(0).alias("side"), F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))
    with_main = F.transform(F.sequence(F.lit(0), F.col("kc") - 1), lambda j: F.struct(F.lit(1).alias("side"), F.col("own").alias("i"), j.alias("j")))
    to_others = F.transform(F.sequence(F.lit(0), F.col("ko") - 1), lambda i: F.struct(F.lit(1).alias("side"), i.alias("i"), F.col("own").alias("j")))
    m = m.withColumn("t_", F.explode(F.when(F.col("other"), F.concat(with_others, with_main)).otherwise(to_others)))
    m = m.select("leader", "t_.side", "t_.i", "t_.j", "fp", "root", "tokens")
    return m.repartition("leader", "side", "i", "j").sortWithinPartitions("leader", "side", "i", "j").mapInArrow(tidy(solve), "a long, b long")


def _with_components(nodes: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Components by the smallest id, from those of fingerprints. Nodes without shingles stay alone."""
    full = nodes.where("n_shingles > 0")
    least = full.groupBy("fp").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n_"))
    if roots is not None:
        roots = roots.select(F.col("node").alias("fp"), F.col("component").alias("root_"))
        least = cut(least)
        tied = cut(least.join(roots, "fp").select("fp", F.col("component_id").alias("least_"), "root_"))
        by_root = cut(tied.groupBy("root_").agg(F.min("least_").alias("of_root"), F.count("*").alias("m_")))
        tied = hot_join(tied, by_root, ["root_"], "m_").select("fp", "of_root")
        least = least.join(tied, "fp", "left").select("fp", F.when(F.col("of_root").isNotNull(), F.col("of_root")).otherwise(F.col("component_id")).alias("component_id"), "n_")
    out = hot_join(full, cut(least), ["fp"], "n_").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.unionByName(nodes.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def oracle_sql(num: int = NUM, den: int = DEN, k: int = SHINGLE) -> str:
    """The same rows in DuckDB SQL, for small tables: all pairs with a common shingle are counted."""
    upper, lower = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
    return rf"""
    WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, md5(x) AS x FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' ')) END) AS x FROM t)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {den} * c >= {num} * (x.n + y.n - c)),
    r AS (SELECT DISTINCT a AS doc_id, a AS root FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.root = e.a)
    SELECT doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, coalesce(min(root), doc_id) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY doc_id"""
