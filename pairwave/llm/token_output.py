"""Token ids as Arrow stream files of equal-length sequences.

Documents are encoded in ascending order of doc_id (null first; repeated ids by a hash of the text), each followed by an end id, and laid
end to end. A file is an Arrow IPC stream of batches with three columns: ``ids``, a fixed-size list of ``length`` ids;
``mask``, of as many booleans, false on padding; and ``docs``, the documents that begin in that sequence, as (doc_id,
row, at, n). Nothing is compressed, so sequence k of a memory-mapped file is a slice, with no copy. Only a file's
last sequence has padding. Files are numbered in order; each task writes one, under a name of its own attempt, and only those
that a finished task has reported are read: a lost or repeated task leaves nothing that counts.

Null texts count as empty and get the end id alone. Other columns are ignored. An empty table gives no files and no rows.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwave.llm.common import new_path, written
from pairwave.sources.shared import file_system

LENGTH = 1024
#: Sequences to a batch.
BATCH = 256
#: Words whose ids a worker keeps, and as many that it had before: of those, what is met again is kept again.
KEPT_WORDS = 1 << 19
#: Plain words that are encoded in one call.
TOGETHER = 500
#: Signs that, after an ASCII letter, always begin a pre-token of their own which no letter joins.
SIGNS = ".,;:!?|%&*#$)"
#: Separators that str.split() takes for white space and the library doesn't.
ODD = "\x1c\x1d\x1e\x1f"


class Encoder:
    """Ids of the tokenizers library. Its normaliser and pre-tokenizer never join what white space parts, so words are encoded once and kept."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        self.ends = None  # for each id whether it ends a pre-token
        if suffix:
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        self.kept: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def packed(self, ids: list[int]) -> bytes:
        return array("H" if self.kind == np.uint16 else "I", ids).tobytes()

    @staticmethod
    def parts(word: str) -> tuple[str, str]:
        """A word's stem and the signs after it; a plain ASCII stem in lower case, as the normaliser would have it."""
        stem = word.rstrip(SIGNS)
        if stem.isascii() and stem.isalpha():
            return stem.lower(), word[len(stem) :]
        if stem[-1:].isascii() and stem[-1:].isalpha():
            return stem, word[len(stem) :]
        return word, ""

    def fresh(self, words: list[str]) -> None:
        """Keep the ids of words by the library. Plain words go many to a call: each is one pre-token, whose last id ends it."""
        plain = [w for w in words if w.isascii() and w.isalpha()] if self.ends is not None else []
        for at in range(0, len(plain), TOGETHER):
            some = plain[at : at + TOGETHER]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.kind)
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) == len(some):
                data, size = ids.tobytes(), self.kind().itemsize
                cuts = [0, *(last * size).tolist()]
                self.kept.update(zip(some, [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))
        rest = [w for w in words if w not in self.kept]
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.kept[w] = self.packed(e.ids)

    def learn(self, words: set[str]) -> None:
        """Keep the ids of words: those of the stem, then those of the signs."""
        back = {w: self.before[w] for w in words if w in self.before}
        self.kept.update(back)
        new = {w: self.parts(w) for w in words if w not in back}
        self.fresh([p for p in dict.fromkeys(p for both in new.values() for p in both if p) if p not in self.kept])
        for w, (stem, signs) in new.items():
            if signs:
                self.kept[w] = (self.kept[stem] if stem else b"") + self.kept[signs]
            elif w != stem:
                self.kept[w] = self.kept[stem]

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text the ids, as little-endian numbers of ``kind``."""
        if len(self.kept) > KEPT_WORDS:
            self.kept, self.before = {}, self.kept
        words = [None if any(c in t for c in ODD) else t.split() for t in texts]
        self.learn(set().union(*(w for w in words if w)).difference(self.kept))
        kept = self.kept
        return [b"".join([kept[x] for x in w]) if w is not None else self.packed(self.tokenizer.encode(t, add_special_tokens=False).ids) for w, t in zip(words, texts, strict=True)]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def layout(kind: np.dtype, length: int) -> pa.Schema:
    doc = pa.struct([("doc_id", pa.int64()), ("row", pa.int64()), ("at", pa.int32()), ("n", pa.int64())])
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length)), ("docs", pa.list_(doc))])


class Sink:
    """Packs ids into sequences and writes them batch by batch."""

    def __init__(self, out, kind, length: int):
        self.schema, self.kind, self.length = layout(kind, length), kind, length
        self.writer = pa.ipc.new_stream(out, self.schema)
        self.pending, self.n, self.total, self.docs = [], 0, 0, []

    def add(self, doc_id: int | None, row: int, ids: np.ndarray) -> None:
        self.docs.append((self.n, {"doc_id": doc_id, "row": row, "at": self.n % self.length, "n": len(ids)}))
        self.pending.append(ids)
        self.n += len(ids)
        self.total += len(ids)
        if self.n >= self.length * BATCH:
            self.flush(self.n // self.length * self.length)

    def flush(self, upto: int) -> None:
        """Write the first ``upto`` pending ids; short of them, padding."""
        ids = np.concatenate(self.pending) if self.pending else np.array([], self.kind)
        whole, rest = ids[:upto], ids[upto:]
        padded = np.concatenate((whole, np.zeros(upto - len(whole), self.kind)))
        starts = [[] for _ in range(upto // self.length)]
        left = []
        for at, d in self.docs:
            starts[at // self.length].append(d) if at < upto else left.append((at - upto, d))
        for a in range(0, upto // self.length, BATCH):
            b = min(a + BATCH, upto // self.length)
            cut = slice(a * self.length, b * self.length)
            mask = np.arange(cut.start, cut.stop) < len(whole)
            self.writer.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(padded[cut]), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length), pa.array(starts[a:b], self.schema.field("docs").type)], schema=self.schema))
        self.pending, self.n, self.docs = [rest], len(rest), left

    def close(self) -> int:
        if self.n:
            self.flush(-(-self.n // self.length) * self.length)
        self.writer.close()
        return self.total


def write_tokens(docs: DataFrame, path: str, folder: str, end_id: int = 2, length: int = LENGTH) -> DataFrame:
    """Write the files; returns the manifest (part, file, n_tokens) as a table, one row a file, parts in order."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = ("doc_id", F.xxhash64("text"))  # rows with the same or no doc_id needn't share a task
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, e, sink, row = TaskContext.get(), encoder(path), None, 0
        store, where = file_system(folder)
        name = f"tokens-{context.partitionId():06d}-{context.taskAttemptId()}.arrow"
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                codes = e.encode(part.column(1).to_pylist())
                for doc_id, code in zip(part.column(0).to_pylist(), codes, strict=True):
                    if sink is None:
                        store.create_dir(where, recursive=True)
                        out = store.open_output_stream(f"{where}/{name}")
                        sink = Sink(out, e.kind, length)
                    sink.add(doc_id, row, np.concatenate((np.frombuffer(code, e.kind), np.array([end_id], e.kind))))
                    row += 1
        if sink is not None:
            total = sink.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([context.partitionId()], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([total], pa.int64())], names=["part", "file", "n_tokens"])

    return written(ordered.mapInArrow(run, "part int, file string, n_tokens long"), "manifest")


def sequences(file: str) -> pa.Table:
    """All sequences of a file on a local disk, memory-mapped: rows are slices of the file."""
    return pa.ipc.open_stream(pa.memory_map(file_system(file)[1])).read_all()


def documents_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int, int, int]]:
    """(doc_id, offset in the file, n, crc32) for each document of a file's batches; holds one batch at a time."""
    open_doc, left, crc, offset, done = None, 0, 0, 0, 0
    for batch in batches:
        column = batch.column(0)
        length = column.type.list_size
        ids = column.flatten().to_numpy()
        here = [(k * length + d["at"], d) for k, ds in enumerate(batch.column(2).to_pylist()) for d in ds]
        if left:
            take = min(left, len(ids))
            crc, left = zlib.crc32(ids[:take].astype("<u4").tobytes(), crc), left - take
            if not left:
                yield open_doc, offset, done, crc
        for at, d in here:
            open_doc, done, offset_in = d["doc_id"], d["n"], at
            take = min(done, len(ids) - at)
            crc, left = zlib.crc32(ids[at : at + take].astype("<u4").tobytes()), done - take
            offset = d["row"]
            if not left:
                yield open_doc, offset, done, crc


def read_documents(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from the files of a manifest."""
    spark: SparkSession = manifest.sparkSession
    # one row a file: their running sum is a small table's
    files = manifest.orderBy("part").select("part", "file", "n_tokens").collect()
    starts, total = [], 0
    for f in files:
        starts.append((f.file, total))
        total += f.n_tokens
    if not starts:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, where = file_system(file)
                with store.open_input_stream(where) as f:
                    rows = list(documents_in(iter(pa.ipc.open_stream(f))))
                n = np.array([r[2] for r in rows], np.int64)
                at = start + np.cumsum(n) - n
                for k in range(0, len(rows), 1 << 14):
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[k : k + (1 << 14)]], pa.int64()), pa.array(at[k : k + (1 << 14)]), pa.array(n[k : k + (1 << 14)]), pa.array([r[3] for r in rows[k : k + (1 << 14)]], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    table = spark.createDataFrame(starts, "file string, start long").repartitionByRange(len(starts), "start")
    return table.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, end_id: int = 2, length: int = LENGTH) -> DataFrame:
    return read_documents(write_tokens(docs, path, new_path(docs.sparkSession, "tokens"), end_id, length))
