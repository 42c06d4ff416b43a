"""A stream of the rows of parquet files with offsets of its own: spark.readStream.format("row_feed"), as ``feed`` makes it.

Files are taken as they come: by time of change and name among those that a look finds new, or by name alone (``order``). An offset is a number of rows in that
order. An admission is of at most ``rows`` rows, also in the middle of a file; what is beyond waits, and nothing is dropped. A micro-batch
is given one admission, or as many as ``admissions`` says while that many wait: a backlog is then worked off in fewer micro-batches,
each still bounded. A look opens only as many files as the next micro-batch needs, so a long backlog costs a listing and no more.

The source keeps a log, one for each query, in a folder that lasts as its checkpoint does: the order of files with their rows, and each
admission with what then waited (``admissions``). Started again, it goes on from there. If it is ended between an admission and Spark's
own note of it, the next micro-batch holds both. A file that changes after it was found gives an error; empty files count for nothing.
With a schema that has a column ``offset``, rows carry theirs. Trigger.AvailableNow takes one micro-batch only: Spark asks but once.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructType

from pairwave.sources.shared import file_system, located

OFFSET = "offset"


@dataclass
class Piece(InputPartition):
    """Rows lo to hi of a file whose first row has the offset ``first``."""

    path: str
    size: int
    first: int
    lo: int
    hi: int


class Log:
    """JSON files, numbered, of an entry a line, one file for what is added at once; a name with a dot in front until it is whole."""

    def __init__(self, folder: str, kind: str):
        self.store, top = file_system(folder)
        self.folder = f"{top}/{kind}"
        self.store.create_dir(self.folder, recursive=True)
        names = sorted(f.base_name for f in self.store.get_file_info(fs.FileSelector(self.folder)) if not f.base_name.startswith("."))
        self.entries, self.added = [], len(names)
        for name in names:
            with self.store.open_input_stream(f"{self.folder}/{name}") as f:
                self.entries += map(json.loads, f.read().splitlines())

    def add(self, entries: list[dict]) -> None:
        if not entries:
            return
        name = f"{self.added:012d}.json"
        with self.store.open_output_stream(f"{self.folder}/.{name}") as f:
            f.write("\n".join(map(json.dumps, entries)).encode())
        self.store.move(f"{self.folder}/.{name}", f"{self.folder}/{name}")
        self.entries += entries
        self.added += 1


class FeedReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.schema = options["path"], schema
        self.rows, self.split, self.timed = int(options["rows"]), int(options.get("split", 1 << 20)), options.get("order", "time") == "time"
        self.admissions = int(options.get("admissions", 1))
        if min(self.rows, self.split, self.admissions) < 1:
            raise ValueError("rows, split and admissions must be at least 1")
        self.files, self.admitted = Log(options["log"], "files"), Log(options["log"], "admitted")
        self.known = {e["path"] for e in self.files.entries}
        self.ends = [e["end"] for e in self.files.entries]

    def initialOffset(self) -> dict:  # noqa: N802
        return {"row": 0}

    def listed(self) -> list[fs.FileInfo]:
        """Files not yet in the order, as they are to be taken in."""
        store, top = file_system(self.path)
        at = store.get_file_info(top)
        found = [at] if at.type == fs.FileType.File else store.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True))
        hidden = lambda f: any(p[0] in "._" for p in f.path.removeprefix(top).split("/") if p)
        new = [f for f in found if f.type == fs.FileType.File and f.size and f.path not in self.known and not hidden(f)]
        return sorted(new, key=lambda f: (f.mtime_ns or 0 if self.timed else 0, f.path))

    def latestOffset(self) -> dict:  # noqa: N802
        start = self.admitted.entries[-1]["end"] if self.admitted.entries else 0
        store, _ = file_system(self.path)
        waiting, taken, most = self.listed(), [], start + self.rows * self.admissions
        for f in waiting:
            if self.ends and self.ends[-1] >= most:
                break
            with store.open_input_file(f.path) as opened:
                n = pq.read_metadata(opened).num_rows
            self.ends.append((self.ends[-1] if self.ends else 0) + n)
            self.known.add(f.path)
            taken.append({"path": f.path, "size": f.size, "end": self.ends[-1]})
        self.files.add(taken)
        known, left = self.ends[-1] if self.ends else 0, waiting[len(taken) :]
        files, size = len(left), sum(f.size for f in left)
        ends = [min(a + self.rows, known) for a in range(start, min(most, known), self.rows)]
        self.admitted.add([{"start": a, "end": e, "waiting_rows": known - e, "waiting_files": files, "waiting_bytes": size} for a, e in zip([start, *ends], ends, strict=False)])
        return {"row": ends[-1] if ends else start}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        lo, hi, found = start["row"], end["row"], []
        for i in range(bisect_right(self.ends, lo), len(self.ends)):
            first = self.ends[i - 1] if i else 0
            if first >= hi:
                break
            e = self.files.entries[i]
            for a in range(max(lo, first), min(hi, e["end"]), self.split):
                found.append(Piece(e["path"], e["size"], first, a - first, min(a + self.split, hi, e["end"]) - first))
        return found

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        store, _ = file_system(self.path)
        if store.get_file_info(partition.path).size != partition.size:
            raise ValueError(f"{partition.path} has changed since it was found")
        names, kinds = [f.name for f in self.schema if f.name != OFFSET], to_arrow_schema(self.schema)
        with store.open_input_file(partition.path) as opened:
            source = pq.ParquetFile(opened)
            first = 0
            for g in range(source.num_row_groups):
                n = source.metadata.row_group(g).num_rows
                if first < partition.hi and first + n > partition.lo:
                    at = first
                    for batch in source.iter_batches(row_groups=[g], columns=names):
                        lo, hi = max(partition.lo - at, 0), min(partition.hi - at, batch.num_rows)
                        if lo < hi:
                            columns = dict(zip(batch.schema.names, batch.slice(lo, hi - lo).columns, strict=True))
                            columns[OFFSET] = pa.array(np.arange(partition.first + at + lo, partition.first + at + hi))
                            yield pa.RecordBatch.from_arrays([columns[k.name].cast(k.type) for k in kinds], schema=kinds)
                        at += batch.num_rows
                first += n


class RowFeed(DataSource):
    """Options: path, log, rows (of an admission at most), admissions (of a micro-batch at most), split (rows of a task at most), order (time or name)."""

    @classmethod
    def name(cls) -> str:
        return "row_feed"

    def schema(self) -> StructType:
        raise ValueError("row_feed needs a schema")

    def streamReader(self, schema: StructType) -> FeedReader:  # noqa: N802
        return FeedReader(dict(self.options), schema)


def feed(spark: SparkSession, path: str, schema: StructType, log: str, rows: int, split: int = 1 << 20, order: str = "time", admissions: int = 1) -> DataFrame:
    """The rows of the parquet files at path (a file or a folder) as a stream, with their offset."""
    spark.dataSource.register(RowFeed)
    columns = StructType(schema.fields).add(OFFSET, LongType()) if OFFSET not in schema.names else schema
    return spark.readStream.format("row_feed").schema(columns).options(path=located(path), log=log, rows=rows, split=split, order=order, admissions=admissions).load()


def admissions(spark: SparkSession, log: str) -> DataFrame:
    """(start, end, waiting_rows, waiting_files, waiting_bytes) for each admission: what waited beyond it, as
    rows of files that were opened, and files that were not."""
    return spark.read.schema("start long, end long, waiting_rows long, waiting_files long, waiting_bytes long").json(f"{log}/admitted")
