"""WAV files: decoding of binary columns, and a Spark data source that reads and writes one file a row.

PCM of 8 to 32 bits and IEEE floats of 32 and 64 can be read, PCM_16 and FLOAT (32 bits) written. Other containers give an error.
"""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, StringStartsWith, WriterCommitMessage

from pairwave.sources.listing import Share, files_of, shares
from pairwave.sources.shared import file_system

# Fixed values of the format: kinds of samples, and the kind that names another one further on.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
SUBTYPES = ("PCM_16", "FLOAT")


class CodecUnavailable(ValueError):
    """The container or the kind of its samples needs a codec that isn't installed."""


@dataclass(frozen=True)
class Layout:
    """Where a file's samples are, and what they are."""

    rate: int
    channels: int
    width: int
    kind: int
    at: int
    frames: int

    @property
    def frame(self) -> int:
        return self.width * self.channels


def layout(f: BinaryIO, path: str = "") -> Layout:
    """Read a file's headers, and only these."""
    top = f.read(12)
    if top[:4] != b"RIFF" or top[8:] != b"WAVE":
        raise CodecUnavailable(f"{path or 'this file'}: only WAV can be decoded here")
    found = None
    while len(head := f.read(8)) == 8:
        name, size = head[:4], int.from_bytes(head[4:], "little")
        if name == b"data":
            if found is None:
                break
            kind, channels, rate, width = found
            if kind not in (PCM, FLOAT) or width not in ((1, 2, 3, 4) if kind == PCM else (4, 8)) or not channels:
                raise CodecUnavailable(f"{path or 'this file'}: samples of kind {kind} and {8 * width} bits can't be decoded here")
            return Layout(rate, channels, width, kind, f.tell(), size // (width * channels))
        body = f.read(size + size % 2)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            found = int.from_bytes(body[24:26], "little") if kind == EXTENSIBLE else kind, channels, rate, bits // 8
    raise EOFError(f"{path or 'this file'}: no samples")


def frames_in(f: BinaryIO, of: Layout, start: int = 0, n: int | None = None) -> np.ndarray:
    """frames x channels as float64: n frames from start on, or all; a read of no more than these."""
    start = min(max(start, 0), of.frames)
    f.seek(of.at + start * of.frame)
    raw = f.read((of.frames - start if n is None else min(n, of.frames - start)) * of.frame)
    raw = raw[: len(raw) // of.frame * of.frame]
    if of.kind == FLOAT:
        x = np.frombuffer(raw, f"<f{of.width}").astype(float)
    elif of.width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif of.width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(raw, f"<i{of.width}").astype(float) / float(1 << (8 * of.width - 1))
    return x.reshape(-1, of.channels)


def decode(content: bytes, path: str = "") -> tuple[np.ndarray, int]:
    """(frames x channels as float64, rate) of a WAV file."""
    f = io.BytesIO(content)
    of = layout(f, path)
    return frames_in(f, of), of.rate


def encode(samples: np.ndarray, rate: int, subtype: str = "PCM_16") -> bytes:
    """A mono file: 16-bit, where full scale is 32767 and what is beyond is clipped, or 32-bit floats as they are."""
    if subtype not in SUBTYPES:
        raise ValueError(f"{subtype!r}: only {' and '.join(SUBTYPES)} can be written")
    if samples is None or subtype == "PCM_16" and np.isnan(samples).any():
        raise ValueError("no samples, or one that is no number")
    samples = np.asarray(samples, float)
    if subtype == "FLOAT":
        kind, width, data, more = FLOAT, 4, np.asarray(samples, "<f4").tobytes(), b"fact" + struct.pack("<II", 4, len(samples))
    else:
        data = (np.floor(np.abs(np.clip(samples, -1, 1)) * 32767 + 0.5).astype("<i2") * np.sign(samples).astype("<i2")).tobytes()
        kind, width, more = PCM, 2, b""
    body = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, kind, 1, rate, rate * width, width, 8 * width) + more + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def decoded(files: DataFrame) -> DataFrame:
    """(path, sr, samples, error) from rows (path, content): channels averaged; a file that can't be decoded gives its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    x, rate = decode(bytes(content), path)
                    rows.append((path, rate, x.mean(axis=1), None))
                except (ValueError, EOFError, struct.error) as e:
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "sr", "samples", "error"]).astype({"sr": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, sr int, samples array<double>, error string")


@dataclass
class Written(WriterCommitMessage):
    attempt: str
    files: int


class WavWriter(DataSourceWriter):
    """Each attempt of a task writes into a folder of its own below _temporary; commit moves what the tasks that reported wrote, file
    by file, and leaves a marker; what else was begun goes, as all of it does on abort."""

    def __init__(self, folder: str, subtype: str):
        if subtype not in SUBTYPES:
            raise ValueError(f"{subtype!r}: only {' and '.join(SUBTYPES)} can be written")
        self.folder, self.subtype, self.job = folder, subtype, uuid.uuid4().hex

    def staging(self, top: str) -> str:
        return f"{top}/_temporary/{self.job}"

    def write(self, rows: Iterator) -> Written:
        (store, top), n, made, attempt = file_system(self.folder), 0, set(), uuid.uuid4().hex
        for r in rows:
            path = f"{self.staging(top)}/{attempt}/{r.path}"
            folder = path.rpartition("/")[0]
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            with store.open_output_stream(path) as f:
                f.write(encode(r.samples, r.sr, self.subtype))
            n += 1
        return Written(attempt, n)

    def commit(self, messages) -> None:
        (store, top), made = file_system(self.folder), set()
        for m in messages:
            if m is None or not m.files:
                continue
            attempt = f"{self.staging(top)}/{m.attempt}"
            for f in store.get_file_info(fs.FileSelector(attempt, recursive=True)):
                if f.type == fs.FileType.File:
                    path = f"{top}/{f.path.removeprefix(attempt).lstrip('/')}"
                    folder = path.rpartition("/")[0]
                    if folder not in made:
                        store.create_dir(folder, recursive=True)
                        made.add(folder)
                    store.move(f.path, path)
        self.clean(store, top)
        store.create_dir(top, recursive=True)
        with store.open_output_stream(f"{top}/_SUCCESS"):
            pass

    def abort(self, messages) -> None:
        self.clean(*file_system(self.folder))

    def clean(self, store: fs.FileSystem, top: str) -> None:
        """Remove this job's folder, and the one above if no other job is at work there."""
        if store.get_file_info(self.staging(top)).type == fs.FileType.Directory:
            store.delete_dir(self.staging(top))
        above = f"{top}/_temporary"
        if store.get_file_info(above).type == fs.FileType.Directory and not store.get_file_info(fs.FileSelector(above)):
            store.delete_dir(above)


class WavReader(DataSourceReader):
    """A row for each file below a folder. The driver lists the folder's own subfolders; files are listed by the tasks, one or ``splits`` for
    each subfolder. ``start`` and ``frames`` read only so much of each file."""

    def __init__(self, folder: str, splits: int, start: int, frames: int | None):
        self.folder, self.splits, self.start, self.frames = folder, splits, start, frames
        self.only: set[str] | None = None
        self.begins: list[str] = []

    def partitions(self) -> list[Share]:
        return shares(self.folder, self.splits)

    def wanted(self, name: str) -> bool:
        return (self.only is None or name in self.only) and all(map(name.startswith, self.begins))

    def read(self, partition: Share) -> Iterator[tuple]:
        store, _ = file_system(self.folder)
        for name, f in files_of(self.folder, partition):
            if not name.lower().endswith(".wav") or not self.wanted(name):
                continue
            try:
                with store.open_input_file(f.path) as file:
                    of = layout(file, name)
                    yield name, of.rate, of.frames, frames_in(file, of, self.start, self.frames).mean(axis=1).tolist(), None
            except (ValueError, EOFError, struct.error) as e:
                yield name, None, None, None, f"{type(e).__name__}: {e}"


class FilteringWavReader(WavReader):
    """The same with filters on path met before a file is opened; Spark calls it only with spark.sql.python.filterPushdown.enabled."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("path",):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = names if self.only is None else self.only & names
            elif isinstance(f, StringStartsWith) and f.attribute == ("path",):
                self.begins.append(f.value)
            else:
                yield f


class WavSource(DataSource):
    """df.write.format("wav").mode("append").option("subtype", "FLOAT").save(folder) for rows (path, sr, samples), and
    spark.read.format("wav").load(folder) for (path, sr, frames, samples, error), channels averaged: the folder must be one that all executors share.
    Options of a read: splits, start, frames, and pushdown ("true": filters on path spare files)."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return "path string, sr int, frames long, samples array<double>, error string"

    def reader(self, schema) -> WavReader:
        frames, kind = self.options.get("frames"), FilteringWavReader if self.options.get("pushdown", "false") == "true" else WavReader
        return kind(self.options["path"], int(self.options.get("splits", 1)), int(self.options.get("start", 0)), None if frames is None else int(frames))

    def writer(self, schema, overwrite: bool) -> WavWriter:
        return WavWriter(self.options["path"], self.options.get("subtype", "PCM_16"))
