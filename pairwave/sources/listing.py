"""A Spark data source of the files below a folder, listed by the tasks: spark.read.format("file_listing").load(folder) gives (name, length), with
names that begin with a dot or an underscore, which Spark's own file sources pass over."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pairwave.sources.shared import file_system


@dataclass
class Share(InputPartition):
    """The files below a folder (or only in it) that fall to one of several tasks by their name."""

    folder: str
    deep: bool
    part: int
    parts: int


def shares(folder: str, splits: int) -> list[Share]:
    """So many for each of a folder's own subfolders, which alone are listed here, and for the files that stand in the folder itself."""
    store, top = file_system(folder)
    below = [f.path for f in store.get_file_info(fs.FileSelector(top)) if f.type == fs.FileType.Directory and f.base_name != "_temporary"]
    return [Share(p, p != top, i, splits) for p in [top, *sorted(below)] for i in range(splits)]


def files_of(folder: str, share: Share) -> Iterator[tuple[str, fs.FileInfo]]:
    """(name below the folder, file) of a share."""
    store, top = file_system(folder)
    for f in store.get_file_info(fs.FileSelector(share.folder, recursive=share.deep)):
        name = f.path.removeprefix(top).lstrip("/")
        if f.type == fs.FileType.File and zlib.crc32(name.encode()) % share.parts == share.part:
            yield name, f


class Lister(DataSourceReader):
    def __init__(self, folder: str, splits: int):
        self.folder, self.splits = folder, splits

    def partitions(self) -> list[Share]:
        return shares(self.folder, self.splits)

    def read(self, partition: Share) -> Iterator[tuple]:
        for name, f in files_of(self.folder, partition):
            yield name, f.size


class ListingSource(DataSource):
    """Options: splits, the tasks for each subfolder."""

    @classmethod
    def name(cls) -> str:
        return "file_listing"

    def schema(self) -> str:
        return "name string, length long"

    def reader(self, schema) -> Lister:
        return Lister(self.options["path"], int(self.options.get("splits", 1)))
