"""Streams with state: restarts, batches of any cut, and what stays in the state."""

from __future__ import annotations

import json
import os
import random
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from cairnwork.operators.loading import document_batches
from cairnwork.operators.packing import fill
from cairnwork.sources.row_groups import RowGroups
from cairnwork.streaming import stateful


@pytest.fixture
def store(spark):
    """A session whose streams have one partition of state, as each costs seconds here."""
    own = {"spark.sql.shuffle.partitions": "1", "spark.sql.streaming.stateStore.providerClass": stateful.STORE, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in kept.items():
        spark.conf.set(k, v)


def put(folder, name, rows):
    """A file that a stream of files finds whole, later than those before it."""
    folder.mkdir(exist_ok=True)
    path = folder.parent / f"tmp-{name}"
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    os.utime(path, (1e9 + len(list(folder.iterdir())),) * 2)
    path.rename(folder / name)


class Sink:
    """Rows by number of batch, as an idempotent sink keeps them; fails once before rows are kept if asked."""

    def __init__(self):
        self.batches, self.fail = {}, False

    def __call__(self, df, number):
        rows = [tuple(r) for r in df.collect()]
        if rows and self.fail:
            self.fail = False
            raise RuntimeError("lost")
        self.batches[number] = rows

    def rows(self):
        return [r for k in sorted(self.batches) for r in self.batches[k]]


def run(df, sink, checkpoint, **trigger):
    return df.writeStream.foreachBatch(sink).option("checkpointLocation", str(checkpoint)).trigger(**(trigger or {"availableNow": True})).start()


def test_packing_over_batches_and_restarts_is_that_of_the_whole_stream(store, tmp_path):
    draw, crop = random.Random(8), True
    docs = [(draw.randrange(2), k, 1000 + k, draw.choice([0, 1, 5, 5, 17, 40, 64, 90])) for k in range(240)]
    ends = [(r, 10_000, None, None) for r in range(2)]
    want = {r: list(fill(((d, n) for k, _, d, n in docs if k == r and n), 64, 9, crop)) for r in range(2)}
    source = lambda: store.readStream.schema("rank int, seq long, doc long, n long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    sink, at = Sink(), 0
    for k, size in enumerate((100, 61, 79)):
        put(tmp_path / "in", f"{k}.json", [dict(zip(("rank", "seq", "doc", "n"), d, strict=True)) for d in draw.sample(docs[at : at + size], size)])
        at += size
        sink.fail = k == 1
        query = run(stateful.pack_stream(source(), 64, 9, crop), sink, tmp_path / "state")
        if k == 1:  # the batch was computed, its state written, and its rows lost
            with pytest.raises(Exception, match="lost"):
                query.awaitTermination()
        else:
            query.awaitTermination()
    so_far = {r: [x[1:] for x in sink.rows() if x[0] == r] for r in range(2)}
    assert all(want[r][: len(so_far[r])] == so_far[r] and 0 < len(so_far[r]) < len(want[r]) for r in range(2))
    put(tmp_path / "in", "end.json", [dict(zip(("rank", "seq", "doc", "n"), d, strict=True)) for d in ends])
    run(stateful.pack_stream(source(), 64, 9, crop), sink, tmp_path / "state").awaitTermination()
    assert {r: [x[1:] for x in sink.rows() if x[0] == r] for r in range(2)} == want


def test_packing_flushes_a_silent_rank(store, tmp_path):
    store.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")  # timers fire in them
    put(tmp_path / "in", "0.json", [{"rank": 0, "seq": k, "doc": k, "n": 10} for k in range(5)])
    source = store.readStream.schema("rank int, seq long, doc long, n long").json(str(tmp_path / "in"))
    sink = Sink()
    query = run(stateful.pack_stream(source, 25, 100, flush_ms=500), sink, tmp_path / "state", processingTime="200 milliseconds")
    try:
        wait(lambda: sink.rows())
    finally:
        query.stop()
    assert [r[1:] for r in sink.rows()] == list(fill(((k, 10) for k in range(5)), 25, 100, True))


def wait(until, seconds=90):
    end = time.time() + seconds
    while not until():
        assert time.time() < end, "nothing came"
        time.sleep(0.1)


MARKS = {"done": r"^\[done\]", "gate": r"^\[gate\] quick gate failed", "error": r"^\[error\]"}


def test_the_watcher_speaks_once_a_file_and_forgets_it(store, tmp_path):
    batches = [
        [("a", "step 1"), ("b", "step 1"), ("c", "[error] x")],
        [("b", "[gate] quick gate failed at 5"), ("b", "[error] late"), ("a", "step 2")],
        [("b", "step 9"), ("a", "[done] completed"), ("c", "[done] again")],
    ]
    source = lambda: store.readStream.schema("file string, line string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    sink = Sink()
    for k, rows in enumerate(batches):
        put(tmp_path / "in", f"{k}.json", [dict(zip(("file", "line"), r, strict=True)) for r in rows])
        sink.fail = k == 1
        query = run(stateful.watch(source(), MARKS, remember_ms=3_600_000), sink, tmp_path / "state")
        if k == 1:
            with pytest.raises(Exception, match="lost"):
                query.awaitTermination()
            query = run(stateful.watch(source(), MARKS, remember_ms=3_600_000), sink, tmp_path / "state")
        query.awaitTermination()
    assert sorted(sink.rows()) == [("a", "done", 3), ("b", "gate", 3), ("c", "error", 1)]
    left = store.read.format("statestore").option("stateVarName", "lines").load(str(tmp_path / "state"))
    assert left.count() == 0


def test_the_watcher_tells_of_silent_files_and_keeps_nothing(store, tmp_path):
    store.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")  # timers fire in them
    put(tmp_path / "in", "0.json", [{"file": "a", "line": "step 1"}, {"file": "b", "line": "[done]"}])
    source = store.readStream.schema("file string, line string").json(str(tmp_path / "in"))
    sink = Sink()
    query = run(stateful.watch(source, MARKS, silent_ms=500), sink, tmp_path / "state", processingTime="200 milliseconds")
    try:
        wait(lambda: len(sink.rows()) == 2)
    finally:
        query.stop()
    assert sorted(sink.rows()) == [("a", "silent", 1), ("b", "done", 1)]


def shards(folder):
    """Three files of 5, 1 and 6 row groups."""
    folder.mkdir()
    n = 0
    for k, (rows, group) in enumerate(((23, 5), (4, 10), (17, 3))):
        pq.write_table(pa.table({"text": [f"text {n + i}" for i in range(rows)], "number": list(range(n, n + rows))}), folder / f"shard_{k:05d}.parquet", row_group_size=group)
        n += rows
    (folder / "shard_00009.parquet.tmp").write_text("not whole")
    return str(folder)


@pytest.fixture
def corpus(spark, tmp_path):
    spark.dataSource.register(RowGroups)
    path = shards(tmp_path / "corpus")
    rows = [(f, r // g, r % g, n) for f, (start, rows, g) in enumerate(((0, 23, 5), (23, 4, 10), (27, 17, 3))) for r, n in enumerate(range(start, start + rows))]
    return path, spark.createDataFrame(rows, "pq_idx int, rg_idx int, pos int, number long")


PLACES = ["epoch", "pq_idx", "rg_idx", "batch_idx", "pos", "number"]


@pytest.mark.parametrize(("rank", "world", "cursor", "epochs"), [(0, 1, None, 2), (1, 2, None, 1), (1, 2, (0, 1, 1), 2), (0, 2, (0, 4, 3), 1), (2, 3, (2, 5, 1), 2)])
def test_the_source_reads_what_document_batches_says(spark, corpus, rank, world, cursor, epochs):
    path, rows = corpus
    own = {"cursor": ",".join(map(str, cursor))} if cursor else {}
    got = spark.read.format("row_groups").options(path=path, world=str(world), rank=str(rank), batch="2", epochs=str(epochs), **own).load()
    want = document_batches(rows, rank, world, 2, epochs, cursor)
    assert sorted(map(tuple, got.select(PLACES).collect())) == sorted(map(tuple, want.select(PLACES).collect()))
    assert got.where("text = concat('text ', number) AND rank = rg_idx % " + str(world)).count() == got.count()


def test_splits_and_columns_of_the_source(spark, corpus):
    read = lambda **o: spark.read.format("row_groups").options(path=corpus[0], **o).load()
    assert {r["number"] for r in read(split="val").collect()} == set(range(27, 44)) and read(split="train", columns="number").count() == 27
    assert read(columns="number").columns == ["epoch", "pq_idx", "rg_idx", "rank", "batch_idx", "pos", "number"]
    with pytest.raises(Exception, match="no row group of this rank|no file has a row group"):
        read(split="val", world="9", rank="8").count()


def test_the_stream_goes_on_where_it_stopped(spark, corpus, tmp_path):
    path, rows = corpus
    sink = Sink()
    for batches in (2, 6):
        stream = spark.readStream.format("row_groups").options(path=path, world="2", groups_per_batch="3", batch="2", columns="number", progress=f"{tmp_path}/progress/cursor.json").load()
        query = run(stream.select(PLACES), sink, tmp_path / "state", processingTime="0 seconds")
        try:
            wait(lambda batches=batches: len(sink.batches) >= batches)
        finally:
            query.stop()
    strides = [(e, f, s) for e in range(1, 9) for f, n in enumerate((5, 1, 6)) for s in range(0, n, 2)]
    read = set(strides[: 3 * len(sink.batches)])
    want = [tuple(r) for rank in (0, 1) for r in document_batches(rows, rank, 2, 2, 8).select(PLACES).collect() if (r["epoch"], r["pq_idx"], r["rg_idx"] // 2 * 2) in read]
    assert sorted(sink.rows()) == sorted(want)
