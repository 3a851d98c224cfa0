"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors x, y of cosine c or more have |x - y|^2 <= 2 - 2 c. After a fixed rotation their coordinates are split
into blocks; since the blocks' squared distances add up, at least one block stays within its proportional share of
that budget. Each block is range-joined: a k-d tree deals its rows to cells, rows near a cut are sent on across it, and
a task joins the rows of a cell by halves and strips along the cuts. This first join sees a block's coordinates alone
and only says which rows have a candidate; their whole vectors follow, candidates are verified exactly, and a pair
counts in the first block that admits it, so the union needs no list of pairs.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, connected_components, cut, hot_join

COSINE = 0.95
BLOCKS = 4
#: Vectors of a cell that its tree aims at; a fuller cell, or what is sent on to it, is cut into chunks that meet in pairs.
CHUNK = 8192
#: Vectors whose coordinates the trees' cuts are medians of, and levels of a tree at most. Any cuts give the same result.
SAMPLE, LEVELS = 8192, 12
#: Bytes of whole vectors that one side of a task holds.
TASK_BYTES = 16 << 20
SEED = 7
#: Slack on the budget for rounding in the rotation, and for single precision; candidates only, verification is exact.
SLACK, COARSE = 1e-9, 1e-5
#: How near to a bound a product of matrices may come before the pair is looked at again, element by element.
BORDER = 1e-9
#: Pairs that are compared at once rather than halved further.
DENSE = 1 << 19


def rotation_signs(width: int, seed: int = SEED) -> np.ndarray:
    """Random signs before each of two Hadamard transforms of this width, a power of two."""
    return np.random.default_rng(seed).choice([-1.0, 1.0], (2, width))


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Rows of x, padded to the signs' width, under signs and Hadamard transform, twice.

    Only element-wise steps, so that a row's result doesn't depend on the rows beside it: every task decides alike.
    """
    width = signs.shape[1]
    y = np.zeros((len(x), width))
    y[:, : x.shape[1]] = x
    for s in signs:
        y = y * s
        h = 1
        while h < width:
            v = y.reshape(len(y), width // (2 * h), 2, h)
            y = np.stack([v[:, :, 0] + v[:, :, 1], v[:, :, 0] - v[:, :, 1]], 2).reshape(len(y), width)
            h *= 2
        y = y / np.sqrt(width)
    return y


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component near one: exact, and squares stay finite."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def _norm(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


class Tree:
    """Cuts of a block: node k of a level splits coordinate dims[k] at at[k]; its halves are nodes 2 k and 2 k + 1."""

    def __init__(self, y: np.ndarray, levels: int) -> None:
        """Medians of a sample, along the coordinate in which the node's part of it spreads most."""
        self.dims, self.at = [], []
        node = np.zeros(len(y), np.int64)
        for level in range(levels):
            dims, at = np.zeros(1 << level, np.int64), np.zeros(1 << level)
            for k in range(1 << level):
                if len(own := y[node == k]):
                    dims[k] = own.var(0).argmax()
                    at[k] = np.median(own[:, dims[k]])
            self.dims.append(dims)
            self.at.append(at)
            node = 2 * node + (y[np.arange(len(y)), dims[node]] >= at[node])

    def deal(self, y: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, home): each row's own cell, and the cells that hold rows within r of it and come after its own.

        A pair lies in one cell, or the row before the cut that parts them is sent on to the other's cell.
        """
        rows, cell, home = np.arange(len(y)), np.zeros(len(y), np.int64), np.ones(len(y), bool)
        for dims, at in zip(self.dims, self.at, strict=True):
            d = y[rows, dims[cell]] - at[cell]
            low, high = np.where(home, d < 0, d <= r), np.where(home, d >= 0, d >= -r)
            over = home & (d < 0) & (d >= -r)
            rows, cell, home = (
                np.concatenate([rows[low], rows[high], rows[over]]),
                np.concatenate([2 * cell[low], 2 * cell[high] + 1, 2 * cell[over] + 1]),
                np.concatenate([home[low], home[high], np.zeros(int(over.sum()), bool)]),
            )
        return rows, cell, home


class Subspaces:
    """Blocks of a rotated space and their budgets."""

    def __init__(self, dims: int, cosine: float = COSINE, blocks: int = BLOCKS) -> None:
        self.width = 1 << max(0, (dims - 1).bit_length())
        self.signs = rotation_signs(self.width)
        self.cosine = cosine
        parts = [p for p in np.array_split(np.arange(self.width), min(blocks, self.width)) if len(p)]
        self.parts = [slice(p[0], p[-1] + 1) for p in parts]
        self.budget = [(2 - 2 * cosine) * len(p) / self.width + SLACK for p in parts]

    def unit(self, x: np.ndarray) -> np.ndarray:
        x = scaled(x)
        return rotate(x / _norm(x)[:, None], self.signs)

    def near(self, y: np.ndarray, b: int, n: int, own: bool) -> np.ndarray:
        """Which rows of a task may have a partner in block b, from single precision coordinates and a wider budget.

        own: the first n rows meet each other; otherwise they meet the rest.
        """
        out = np.zeros(len(y), bool)
        budget = np.float32(self.budget[b] + COARSE)
        r = float(budget) ** 0.5 + COARSE
        square = np.einsum("ij,ij->i", y, y)
        one = np.ones((len(y), 1), np.float32)
        left, right = np.concatenate([-2 * y, square[:, None], one], 1), np.concatenate([y, one, square[:, None]], 1)

        def halves(i: np.ndarray, dim: int, at: float) -> tuple[np.ndarray, ...]:
            d = y[i, dim] - at
            return i[d < 0], i[d >= 0], i[(d < 0) & (d >= -r)], i[(d >= 0) & (d <= r)]

        def meet(i: np.ndarray, j: np.ndarray, depth: int) -> None:
            if not len(i) or not len(j):
                return
            if len(i) * len(j) <= DENSE or depth >= 2 * y.shape[1]:
                for a in range(0, len(i), 1024):
                    for c in range(0, len(j), 1024):
                        u, v = i[a : a + 1024], j[c : c + 1024]
                        hit = left[u] @ right[v].T <= budget
                        if i is j:
                            hit &= u[:, None] != v[None, :]
                        out[u] |= hit.any(1)
                        out[v] |= hit.any(0)
                return
            all_ = y[i] if i is j else np.concatenate([y[i], y[j]])
            dim = int(all_.var(0).argmax())
            at = float(np.median(all_[:, dim]))
            a, b, an, bn = halves(i, dim, at)
            if not len(a) or not len(b):
                depth = 2 * y.shape[1]
            if i is j:
                meet(a, a, depth + 1)
                meet(b, b, depth + 1)
                meet(an, bn, depth + 1)
            else:
                c, d, cn, dn = halves(j, dim, at)
                meet(a, c, depth + 1)
                meet(b, d, depth + 1)
                meet(an, dn, depth + 1)
                meet(bn, cn, depth + 1)

        first = np.arange(n)
        meet(first, first if own else np.arange(n, len(y)), 0)
        return out

    def linked(self, x: np.ndarray, y: np.ndarray, u: slice, v: slice, b: int) -> np.ndarray:
        """Which of the pairs of the stretches u and v link and have block b as the first to admit them, as a matrix."""

        def decide(value: np.ndarray, bound: float, exact: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
            out = value <= bound
            i, j = np.nonzero(np.abs(value - bound) < BORDER)
            for k in range(0, len(i), 1 << 16):
                s, t = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                out[s, t] = exact(s + u.start, t + v.start) <= bound
            return out

        out = np.ones((u.stop - u.start, v.stop - v.start), bool)
        if u == v:
            out = np.triu(out, 1)
        for k in range(b, -1, -1):
            p = y[:, self.parts[k]]
            a, c = p[u], p[v]
            apart = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", c, c)[None, :] - 2 * (a @ c.T)
            within = decide(apart, self.budget[k], lambda s, t: np.einsum("ij,ij->i", p[s] - p[t], p[s] - p[t]))
            out &= within if k == b else ~within
            if not out.any():
                return out
        size = _norm(x)
        out &= decide(-(x[u] @ x[v].T) / (size[u][:, None] * size[v][None, :]), -self.cosine, lambda s, t: -np.einsum("ij,ij->i", x[s], x[t]) / (size[s] * size[t]))
        return out


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row reachable from each of n rows over the pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        least = label.copy()
        m = np.minimum(label[a], label[b])
        np.minimum.at(least, label[a], m)
        np.minimum.at(least, label[b], m)
        while True:
            jump = least[least]
            if (jump == least).all():
                break
            least = jump
        label = least[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def spaces(cosine: float, blocks: int) -> Callable[[int], Subspaces]:
    """The subspaces of each width, made once in a task."""
    return functools.cache(lambda width: Subspaces(width, cosine, blocks))


#: Columns that name a task: width, block, cell, whether its own rows meet each other (0) or rows sent on (1), and the chunks of both.
TASK = ["w", "b", "c", "kind", "i", "j"]


def _tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, ...], pa.Table]]:
    """(task, its rows with side 0 first) from batches sorted by TASK."""
    key, held = None, []

    def closed() -> pa.Table:
        t = pa.Table.from_batches(held).combine_chunks()
        return t.take(pa.array(np.argsort(t.column("side").to_numpy(), kind="stable")))

    for batch in batches:
        if not len(batch):
            continue
        k = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(len(TASK))], 1)
        edges = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(k)]
        for a, z in zip(edges, edges[1:], strict=False):
            own = tuple(k[a].tolist())
            if own != key:
                if held:
                    yield key, closed()
                key, held = own, []
            held.append(batch.slice(a, z - a))
    if held:
        yield key, closed()


def _matrix(column: pa.ChunkedArray, dtype: str) -> np.ndarray:
    """Rows of numbers from a column of byte strings or of lists of one width."""
    rows = pa.concat_arrays(column.chunks)
    if pa.types.is_binary(rows.type):
        return np.frombuffer(b"".join(rows.to_pylist()), dtype).reshape(len(rows), -1)
    return rows.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(rows), -1)


def _candidates(batches: Iterator[pa.RecordBatch], space_of: Callable[[int], Subspaces]) -> Iterator[pa.RecordBatch]:
    """The rows (TASK, side, node_) that may have a partner in their task."""
    for key, rows in _tasks(batches):
        side = rows.column("side").to_numpy()
        n = int((side == 0).sum())
        own = key[3] == 0 and key[4] == key[5]
        if not own and n in (0, len(side)):
            continue
        hit = np.flatnonzero(space_of(key[0]).near(_matrix(rows.column("z"), "<f4"), key[1], n, own))
        if len(hit):
            for batch in rows.select([*TASK, "side", "node_"]).take(pa.array(hit)).combine_chunks().to_batches():
                yield batch


def _solved(batches: Iterator[pa.RecordBatch], space_of: Callable[[int], Subspaces], step: int = 1024) -> Iterator[pa.RecordBatch]:
    """(id, links, root) from rows (TASK, side, node_, copies_, vector) sorted by task."""
    for key, rows in _tasks(batches):
        space, b = space_of(key[0]), key[1]
        ids, copies, side = (rows.column(c).to_numpy() for c in ("node_", "copies_", "side"))
        x = scaled(_matrix(rows.column("v_"), "f8"))
        y = space.unit(x)
        n, m = int((side == 0).sum()), len(ids)
        if key[3] == 0 and key[4] == key[5]:
            stretches = [(s, t, n, n) for s in range(0, n, step) for t in range(s, n, step)]
        else:
            stretches = [(s, t, n, m) for s in range(0, n, step) for t in range(n, m, step)]
        links, edges = np.zeros(m), []
        for s, t, e, f in stretches:
            u, v = slice(s, min(s + step, e)), slice(t, min(t + step, f))
            hit = space.linked(x, y, u, v, b)
            i, j = np.nonzero(hit)
            if not len(i):
                continue
            links[u] += hit @ copies[v].astype(float)
            links[v] += copies[u].astype(float) @ hit
            # Of a stretch's pairs only a spanning forest is held.
            own = forest(2 * step, i, j + step)
            tie = np.flatnonzero(own != np.arange(2 * step))
            place = lambda k: np.where(k < step, k + u.start, k - step + v.start)  # noqa: B023, E731
            edges.append((place(tie), place(own[tie])))
        if edges:
            root = forest(m, np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges]))
            has = np.flatnonzero(links > 0)
            yield pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.array(links[has].astype(np.int64)), pa.array(ids[root[has]])], ["id", "links", "root"])


def near_vectors(vectors: DataFrame, cosine: float = COSINE, blocks: int = BLOCKS, chunk: int = CHUNK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept (vec_id = component_id).

    Vectors link if their cosine in double precision is at least `cosine`, however long or short they are. Vectors that
    are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of different widths with
    each other. Equal vectors are joined as one with a count, so a hot vector is one row of the join; each of them links
    with the others. A null id counts as a link to others and is smallest only in a component of nulls; repeated ids are
    vectors of their own. Other columns aren't read; an empty table gives an empty result.

    What is shuffled: one block's coordinates in single precision for every cell near a distinct vector, and the whole
    vectors of those that have a candidate. Tasks return counts and a forest of their links, never the pairs.
    """
    v = F.col("v_")
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, number) & F.exists(v, lambda x: x != 0)
    base = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v_")).withColumn("ok_", F.coalesce(sound, F.lit(False)))
    # -0.0 and 0.0 are the same component.
    keyed = base.withColumn("v_", F.when(F.col("ok_"), F.transform(v, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))))
    keyed = cut(keyed.withColumn("key_", F.xxhash64("v_")))
    # One row a distinct vector; its number stands for it from here on.
    nodes = keyed.where("ok_").groupBy("key_", "v_").agg(F.count("*").alias("copies_"), F.min("vec_id").alias("least_"))
    nodes = cut(nodes.withColumn("node_", F.monotonically_increasing_id()))
    found = cut(_joined(nodes, cosine, blocks, chunk))
    links = found.groupBy(F.col("id").alias("node_")).agg(F.sum("links").alias("links_"))
    roots = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    tied = nodes.select("node_", "copies_", "least_").join(links, "node_").join(roots.withColumnRenamed("component", "root_"), F.col("node_") == F.col("node")).drop("node")
    tied = cut(tied)  # of the nodes with links to other nodes
    least = cut(tied.groupBy("root_").agg(F.min("least_").alias("component_id"), F.count("*").alias("n_")))
    tied = cut(hot_join(tied, least, ["root_"], "n_").select("node_", "links_", "component_id"))
    n = nodes.join(tied, "node_", "left").select("key_", "v_", "copies_", (F.coalesce("links_", F.lit(0)) + F.col("copies_") - 1).alias("n_links"), F.when(F.col("links_").isNotNull(), F.col("component_id")).otherwise(F.col("least_")).alias("component_id"))
    out = hot_join(keyed.where("ok_").select("vec_id", "key_", "v_"), cut(n), ["key_", "v_"], "copies_").select("vec_id", "n_links", "component_id")
    alone = keyed.where("NOT ok_").select("vec_id", F.lit(0).alias("n_links"), F.col("vec_id").alias("component_id"))
    out = out.unionByName(alone)
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _trees(nodes: DataFrame, space_of: Callable[[int], Subspaces], chunk: int) -> dict[int, list[Tree]]:
    """For each width that is common in the sample a tree of each block, with cells of about `chunk` vectors."""
    total = nodes.count()
    by_width: dict[int, list[list[float]]] = {}
    if total > chunk:
        for r in nodes.orderBy(F.xxhash64("key_", F.lit(SEED)), "node_").limit(SAMPLE).select("v_").collect():
            by_width.setdefault(len(r["v_"]), []).append(r["v_"])
    took = sum(map(len, by_width.values()))
    out = {}
    for width, rows in by_width.items():
        cells = min(total * len(rows) / took / chunk, len(rows) / 2)
        if cells > 1:
            levels = min(LEVELS, int(np.ceil(np.log2(cells))))
            y = space_of(width).unit(np.array(rows, np.float64))
            out[width] = [Tree(y[:, p], levels) for p in space_of(width).parts]
    return out


def _joined(nodes: DataFrame, cosine: float, blocks: int, chunk: int) -> DataFrame:
    """(id, links, root): links of each node as far as each task has found them, and a node its links lead to.

    The width is part of a task's key, so one plan joins vectors of however many widths.
    """
    trees = _trees(nodes, spaces(cosine, blocks), chunk)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space_of = spaces(cosine, blocks)
        for batch in batches:
            if not len(batch):
                continue
            widths = pc.list_value_length(batch.column(1)).to_numpy()
            for width in map(int, np.unique(widths)):
                of = batch.take(pa.array(np.flatnonzero(widths == width)))
                space = space_of(width)
                y = space.unit(of.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(of), width))
                for b, part in enumerate(space.parts):
                    own = np.ascontiguousarray(y[:, part])
                    tree = trees[width][b] if width in trees else Tree(own, 0)
                    rows, cells, home = tree.deal(own, space.budget[b] ** 0.5)
                    size = own.shape[1]
                    z = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * size), len(own), [None, pa.py_buffer(own.astype("<f4").tobytes())]).cast(pa.binary())
                    whole = lambda k: pa.array(np.full(len(rows), k, np.int32))  # noqa: B023, E731
                    cols = [whole(width), whole(b), pa.array(cells.astype(np.int32)), pa.array(home), of.column(0).take(pa.array(rows)), z.take(pa.array(rows))]
                    yield pa.RecordBatch.from_arrays(cols, ["w", "b", "c", "home", "node_", "z"])

    spots = bounded_batches(nodes.select("node_", "v_"), 4000).mapInArrow(place, "w int, b int, c int, home boolean, node_ long, z binary")
    # Rows of each cell, own and sent on, decide its chunks; one row a cell, of which the trees bound the number for a width.
    cells = spots.groupBy("w", "b", "c").agg(F.sum(F.col("home").cast("long")).alias("own_"), F.sum((~F.col("home")).cast("long")).alias("sent_"))
    most = F.greatest(F.lit(64), F.least(F.lit(chunk), F.floor(F.lit(TASK_BYTES) / (8 * F.col("w")))))
    pieces = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / most)).cast("int")
    cells = cut(cells.where("own_ > 0 AND own_ + sent_ > 1").select("w", "b", "c", pieces("own_").alias("ko"), pieces("sent_").alias("ks"), (F.col("sent_") > 0).alias("some")))
    s = spots.join(F.broadcast(cells) if cells.count() <= 4 << LEVELS else cells, ["w", "b", "c"])
    s = s.withColumn("mine", F.pmod(F.xxhash64("node_"), F.when(F.col("home"), F.col("ko")).otherwise(F.col("ks"))).cast("int"))
    # Own chunks meet own chunks from themselves on, and every chunk of sent rows.
    spot = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))
    own = F.transform(F.sequence(F.lit(0), F.col("ko") - 1), lambda j: spot(0, F.least("mine", j), F.greatest("mine", j), (F.col("mine") > j).cast("int")))
    out = F.when(F.col("some"), F.transform(F.sequence(F.lit(0), F.col("ks") - 1), lambda j: spot(1, F.col("mine"), j, F.lit(0)))).otherwise(F.slice(own, 1, 0))
    sent = F.transform(F.sequence(F.lit(0), F.col("ko") - 1), lambda i: spot(1, i, F.col("mine"), F.lit(1)))
    s = s.withColumn("t", F.explode(F.when(F.col("home"), F.concat(own, out)).otherwise(sent)))
    s = s.select("w", "b", "c", "t.kind", "t.i", "t.j", "t.side", "node_", "z").repartition(*TASK).sortWithinPartitions(*TASK)
    kind = "w int, b int, c int, kind int, i int, j int, side int, node_ long"
    some = cut(s.mapInArrow(lambda batches: _candidates(batches, spaces(cosine, blocks)), kind))
    whole = some.join(nodes.select("node_", "copies_", "v_"), "node_").select(*TASK, "side", "node_", "copies_", "v_")
    return whole.repartition(*TASK).sortWithinPartitions(*TASK).mapInArrow(lambda batches: _solved(batches, spaces(cosine, blocks)), "id long, links long, root long")


def oracle_sql(cosine: float = COSINE) -> str:
    """The same rows in DuckDB SQL, for small tables without nulls inside vectors: every pair is compared."""
    return f"""
    WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings WHERE embedding IS NOT NULL),
    u AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS n FROM v WHERE list_dot_product(x, x) > 0 AND isfinite(list_dot_product(x, x))),
    e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.x, b.x) / (a.n * b.n) >= {cosine}),
    r AS (SELECT DISTINCT a AS vec_id, a AS root FROM e UNION SELECT r.vec_id, e.b FROM r JOIN e ON r.root = e.a)
    SELECT m.vec_id, coalesce(l.n, 0)::BIGINT AS n_links, coalesce(c.root, m.vec_id) AS component_id, coalesce(c.root, m.vec_id) = m.vec_id AS kept FROM embeddings m
    LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY 1) l ON l.a = m.vec_id LEFT JOIN (SELECT vec_id, min(root) AS root FROM r GROUP BY 1) c ON c.vec_id = m.vec_id"""
