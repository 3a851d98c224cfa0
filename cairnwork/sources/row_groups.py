"""A source of row groups in a training loop's order: endless as a stream, so many epochs as a batch, resumable at a cursor.

`spark.dataSource.register(RowGroups)`, then `spark.read.format("row_groups")` or `spark.readStream.format("row_groups")`.
A cursor is (pq_idx, rg_idx, epoch) of the last row group that was read. Each partition is one row group of a real Parquet file.

The files are opened by pyarrow on executors, so paths are ones that it can open: local or mounted folders, `file:`, `hdfs:`, `s3:`, `gs:`.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import IntegerType, StructField, StructType


#: Where a row stands, before its own columns.
PLACE = ("epoch", "pq_idx", "rg_idx", "rank", "batch_idx", "pos")


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)


def files(path: str, split: str = "all") -> list[str]:
    """The Parquet files of a folder by name, or one file. split `val` is the last of them, `train` all but the last."""
    store, at = _open(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.Directory:
        found = sorted(f.path for f in store.get_file_info(fs.FileSelector(at)) if f.base_name.endswith(".parquet") and f.type == fs.FileType.File)
    else:
        found = [at] if info.type == fs.FileType.File else []
    if not found:
        raise FileNotFoundError(f"no Parquet files at {path}")
    return found if split == "all" else found[-1:] if split == "val" else found[:-1]


@dataclass(frozen=True, order=True)
class Cursor:
    """The last row group read, in the order of reading; rg_idx -1 is before the first of a file."""

    epoch: int = 1
    pq_idx: int = 0
    rg_idx: int = -1

    @staticmethod
    def of(text: str) -> Cursor:
        """From `pq_idx,rg_idx,epoch`."""
        pq_idx, rg_idx, epoch = map(int, text.split(","))
        return Cursor(epoch, pq_idx, rg_idx)


class Order:
    """The row groups in order: epochs, in them files, in them strides of `world` groups, one for each rank."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.world, self.rank = options["path"], int(options.get("world", "1")), int(options["rank"]) if "rank" in options else None
        self.files = files(self.path, options.get("split", "all"))
        if not self.files:
            raise FileNotFoundError(f"no file of this split at {self.path}")
        self.known: dict[int, int] = {}

    def groups(self, pq_idx: int) -> int:
        """Row groups of a file; its end is read when it is first asked for."""
        if pq_idx not in self.known:
            self.known[pq_idx] = pq.read_metadata(self.files[pq_idx], filesystem=_open(self.path)[0]).num_row_groups
        return self.known[pq_idx]

    def after(self, cursor: Cursor) -> Cursor:
        """The stride after a cursor's, by its last group; the rest of the cursor's own stride is passed over."""
        first = (cursor.rg_idx // self.world + 1) * self.world
        for _ in range(len(self.files) + 1):
            n = self.groups(cursor.pq_idx)
            if first + (self.rank or 0) < n:
                last = first + self.rank if self.rank is not None else min(first + self.world, n) - 1
                return Cursor(cursor.epoch, cursor.pq_idx, last)
            more = cursor.pq_idx + 1 < len(self.files)
            cursor, first = Cursor(cursor.epoch + (not more), cursor.pq_idx + 1 if more else 0), 0
        raise ValueError("no file has a row group of this rank")

    def between(self, start: Cursor, end: Cursor) -> Iterator[tuple[int, int, int]]:
        """(epoch, pq_idx, rg_idx) of the groups after start up to end."""
        while (start := self.after(start)) <= end:
            low = start.rg_idx // self.world * self.world
            for rg_idx in [start.rg_idx] if self.rank is not None else range(low, start.rg_idx + 1):
                yield start.epoch, start.pq_idx, rg_idx

    def forward(self, cursor: Cursor, strides: int) -> Cursor:
        for _ in range(strides):
            cursor = self.after(cursor)
        return cursor


@dataclass
class Group(InputPartition):
    epoch: int
    pq_idx: int
    rg_idx: int


class _Reading:
    """Reads a group's rows, a batch of `batch` rows after the other."""

    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path, self.batch, self.world = options["path"], int(options.get("batch", "128")), int(options.get("world", "1"))
        self.columns = schema.fieldNames()[len(PLACE) :]
        self.order = Order(options)
        self.names = self.order.files

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        table = pq.ParquetFile(self.names[partition.pq_idx], filesystem=_open(self.path)[0]).read_row_group(partition.rg_idx, columns=self.columns).combine_chunks()
        head = [partition.epoch, partition.pq_idx, partition.rg_idx, partition.rg_idx % self.world]
        for first in range(0, table.num_rows, self.batch):
            for own in table.slice(first, self.batch).to_batches():
                n = own.num_rows
                made = [pa.array([v] * n, pa.int32()) for v in (*head, first // self.batch)] + [pa.array(range(first, first + n), pa.int32())]
                yield pa.RecordBatch.from_arrays(made + own.columns, [*PLACE, *self.columns])


class _Batch(_Reading, DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        super().__init__(options, schema)
        start = Cursor.of(options["cursor"]) if "cursor" in options else Cursor()
        last = start.epoch + int(options.get("epochs", "1")) - 1
        # The last stride of an epoch is the one before that which begins the next one.
        self.parts = [Group(*g) for g in self._until(start, last)]

    def _until(self, start: Cursor, last: int) -> Iterator[tuple[int, int, int]]:
        while (then := self.order.after(start)).epoch <= last:
            yield from self.order.between(start, then)
            start = then

    def partitions(self) -> list[Group]:
        return self.parts


class _Stream(_Reading, DataSourceStreamReader):
    """Endless: each batch has `groups_per_batch` strides more than the one before.

    Spark asks for the newest offset without telling where it is, also after a restart. So the end of each planned batch is noted in
    `progress`, a file of the query's own on a store that the driver can write; a batch is planned before it runs, and planned anew if it didn't end.
    """

    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        super().__init__(options, schema)
        self.strides, self.progress = int(options.get("groups_per_batch", "1")), options["progress"]
        self.start = Cursor.of(options["cursor"]) if "cursor" in options else Cursor()

    def _noted(self) -> Cursor:
        store, at = _open(self.progress)
        if store.get_file_info(at).type != fs.FileType.File:
            return self.start
        with store.open_input_stream(at) as f:
            return Cursor(**json.loads(f.read()))

    def initialOffset(self) -> dict:  # noqa: N802
        return vars(self.start)

    def latestOffset(self) -> dict:  # noqa: N802
        return vars(self.order.forward(self._noted(), self.strides))

    def partitions(self, start: dict, end: dict) -> list[Group]:
        if Cursor(**end) > self._noted():
            store, at = _open(self.progress)
            store.create_dir(at.rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(at + ".new") as f:
                f.write(json.dumps(end).encode())
            store.move(at + ".new", at)
        return [Group(*g) for g in self.order.between(Cursor(**start), Cursor(**end))]

    def commit(self, end: dict) -> None:
        pass


class RowGroups(DataSource):
    """Rows (epoch, pq_idx, rg_idx, rank, batch_idx, pos, the files' columns) of a corpus in Parquet.

    Options: path (a folder or a file); split (all, train: all files but the last, val: the last); world and rank (each rank reads every
    world-th group of a file; without a rank all are read, and the column tells whose it is); batch (rows of a
    batch_idx); columns (of the files, by default all); cursor `pq_idx,rg_idx,epoch`: reading goes on in that file with the
    next stride, so nothing is read twice; epochs (batch only). groups_per_batch and progress: of a stream, see there.
    Files without a group of the rank are passed over; it is an error if none has one. Columns named like those above are an error.
    """

    @classmethod
    def name(cls) -> str:
        return "row_groups"

    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        first = files(self.options["path"])[0]
        own = from_arrow_schema(pq.read_schema(first, filesystem=_open(self.options["path"])[0]))
        wanted = [c.strip() for c in self.options["columns"].split(",")] if "columns" in self.options else own.fieldNames()
        out = StructType([StructField(c, IntegerType()) for c in PLACE])
        if clash := {c.lower() for c in wanted} & {c.lower() for c in out.fieldNames()}:
            raise ValueError(f"columns of the files are named like the source's own: {sorted(clash)}")
        return StructType(out.fields + [own[c] for c in wanted])

    def reader(self, schema: StructType) -> _Batch:
        return _Batch(dict(self.options), schema)

    def streamReader(self, schema: StructType) -> _Stream:  # noqa: N802
        return _Stream(dict(self.options), schema)
