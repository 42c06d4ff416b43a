"""Benchmark decontamination for a benchmark that no task can hold: the same windows, Hamming blocks and exact check as joins of tables.

The documents are scanned once, however large the benchmark. A task holds only a bit filter of the items' shingles, of a fixed size at most
(``FILTER_BITS``; a fuller filter lets more windows through and loses none). A window passes if as many of its shingles as an item of its size needs
stand in items, and in items of that size. Those that pass are written with their SimHash and spelt out by block, with up to
two bits changed, and items with up to one: of two fingerprints within the radius of 15 some block of 16 differs in at most three, so the join on (shingle
width, size, block, value) finds every such pair. Pairs within the radius are checked exactly. Equal windows and equal items are joined once;
where they stand and which ids they have is joined to the result. Texts are known by their MD5 and words by their 64-bit XXH64.

Null texts hold nothing, and nor do items without a word; repeated rows, doc_ids and items each give their own rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwave.llm.common import small, written
from pairwave.llm.windows import BLOCKS, MIX, RADIUS, WIDTH, WORDS, bits, flips, mixed, needed, packed, shingles, similarity

FILTER_BITS = 1 << 28
#: Bits of the filter that a group makes; bits of a block that items have changed, windows have the others.
SEGMENT_BITS, ITEM_FLIPS = 1 << 16, 1
#: Words whose hash a worker remembers; windows in a batch.
REMEMBERED, ROWS = 1 << 18, 1_000
ITEM = "item_key string, k int, size int, print long, shingles binary"
WINDOW = "text_key string, first_word long, window_key string, k int, size int, print long, shingles binary"

_hashes: dict[str, int] = {}


def word_hashes(text: str) -> np.ndarray:
    words = WORDS.findall(text.lower())
    if len(_hashes) > REMEMBERED:
        _hashes.clear()
    for w in words:
        if w not in _hashes:
            _hashes[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def sized(h: np.ndarray, size: int) -> np.ndarray:
    """Shingles as those of an item of a size."""
    return mixed(h + np.uint64(size * int(MIX) % (1 << 64)))


def printed(h: np.ndarray) -> int:
    return int(packed(bits(h).sum(axis=0, keepdims=True)).view(np.int64)[0])


def batches_of(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}


def arrow(schema: str) -> pa.Schema:
    return pa.schema([(n, KINDS[t]) for n, t in (c.split() for c in schema.split(", "))])


def item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = word_hashes(text)
                if len(ids):
                    k = min(len(ids), WIDTH)
                    h = shingles(ids, k)
                    yield key, k, len(h), printed(h), h.tobytes()

    return batches_of(rows(), arrow(ITEM))


def slots(bits_: int):
    """(segment, bit) of each shingle of an item, as it is and as one of the item's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for size, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = np.frombuffer(raw, np.uint64)
                found += [h, sized(h, size)]
            at = np.unique(np.concatenate(found) & np.uint64(bits_ - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at // SEGMENT_BITS).astype(np.int32)), pa.array((at % SEGMENT_BITS).astype(np.int32))], names=["segment", "bit"])

    return run


def segment_bytes(rows: pa.Table) -> pa.Table:
    marks = np.zeros(SEGMENT_BITS, bool)
    marks[rows.column("bit").to_numpy()] = True
    return pa.table({"segment": rows.column("segment").slice(0, 1), "bytes": pa.array([np.packbits(marks, bitorder="little").tobytes()])})


def filter_of(items: DataFrame, shingles_: int) -> bytes:
    """The filter, of FILTER_BITS bits at most, put together from segments of 8 KB."""
    bits_ = min(FILTER_BITS, max(SEGMENT_BITS, 1 << (16 * shingles_).bit_length()))
    found = items.select("size", "shingles").mapInArrow(slots(bits_), "segment int, bit int").distinct().groupBy("segment").applyInArrow(segment_bytes, "segment int, bytes binary")
    whole = bytearray(bits_ // 8)
    for r in found.toLocalIterator():
        at = r.segment * SEGMENT_BITS // 8
        whole[at : at + SEGMENT_BITS // 8] = r.bytes
    return bytes(whole)


class Filter:
    def __init__(self, raw: bytes):
        self.bytes, self.mask = np.frombuffer(raw, np.uint8), np.uint64(8 * len(raw) - 1)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h & self.mask
        return (self.bytes[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def passing(ids: np.ndarray, known: Filter, sizes: dict[int, list[int]], least: float) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(shingle width, first word, size of the items to compare, shingles) of a text's windows that enough shingles of some items stand in."""
    for k, wanted in sizes.items():
        h = shingles(ids, k)
        at, n = np.flatnonzero(known.has(h)), len(h)
        for m in wanted:  # from the smallest
            need = needed(m, min(m, n), least)
            if n < least * m or len(at) < need:
                break
            own = at[known.has(sized(h[at], m))]
            if len(own) < need:
                continue
            if n < m:  # the whole document is the one window
                yield k, 0, m, h
                continue
            begins = np.unique(np.concatenate([own - j for j in range(m)])) if m * len(own) < n else np.arange(n - m + 1)
            begins = begins[(begins >= 0) & (begins <= n - m)]
            for s in begins[np.searchsorted(own, begins + m) - np.searchsorted(own, begins) >= need].tolist():
                yield k, s, m, h[s : s + m]


def window_rows(shared, sizes: dict[int, list[int]], least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Filter(shared.value)

        def rows():
            for batch in batches:
                for text in batch.column(0):
                    text = text.as_py()
                    key = None
                    for k, s, m, h in passing(word_hashes(text), known, sizes, least):
                        key = key or hashlib.md5(text.encode()).hexdigest()
                        raw = h.tobytes()
                        yield key, s, hashlib.md5(bytes([k]) + raw).hexdigest(), k, m, printed(h), raw

        yield from batches_of(rows(), arrow(WINDOW))

    return run


def spelt(df: DataFrame, name: str, most: int) -> DataFrame:
    """Each row once for each block of a fingerprint and each value at most so many bits away."""
    changed = F.array(*[F.lit(int(x)).cast("long") for x in flips(most)])

    def values(b: int) -> Column:
        own = F.shiftrightunsigned(name, 16 * b).bitwiseAND(F.lit(0xFFFF).cast("long"))
        return F.transform(changed, lambda x: F.struct(F.lit(b).alias("block"), own.bitwiseXOR(x).alias("value")))

    return df.withColumn("__at", F.explode(F.flatten(F.array(*map(values, range(BLOCKS)))))).select(*df.columns, "__at.block", "__at.value")


def exact(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for w, i, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    found = similarity(np.unique(np.frombuffer(b, np.uint64), return_counts=True), np.frombuffer(a, np.uint64))
                    if found >= least:
                        yield w, i, found

        yield from batches_of(rows(), arrow("window_key string, item_key string, similarity double"))

    return run


def linked(docs: DataFrame, benchmark: DataFrame, least: float) -> DataFrame | None:
    """(text_key, item_key, first_word, similarity): the MD5 of texts and of the items that they hold, with the best window; None if no item has a word."""
    texts = benchmark.where("text is not null").select(F.md5("text").alias("item_key"), "text").dropDuplicates(["item_key"])
    items = written(texts.mapInArrow(item_rows, ITEM), "benchmark-items")
    shapes = items.groupBy("k", "size").agg(F.count("*").alias("n")).orderBy("k", "size").collect()  # the lengths that items have, not items
    if not shapes:
        return None
    sizes: dict[int, list[int]] = {}
    for r in shapes:
        sizes.setdefault(r.k, []).append(r.size)
    shared = docs.sparkSession.sparkContext.broadcast(filter_of(items, sum(2 * r.size * r.n for r in shapes)))
    windows = written(docs.where("text is not null").select("text").mapInArrow(window_rows(shared, sizes, least), WINDOW), "benchmark-windows")
    asked = spelt(windows.select("window_key", "k", "size", F.col("print").alias("window_print")).distinct(), "window_print", RADIUS // BLOCKS - ITEM_FLIPS)
    index = spelt(items.select("item_key", "k", "size", F.col("print").alias("item_print")), "item_print", ITEM_FLIPS)
    near = asked.join(index, ["k", "size", "block", "value"]).where(F.bit_count(F.col("window_print").bitwiseXOR(F.col("item_print"))) <= RADIUS).select("window_key", "item_key").distinct()
    held = windows.groupBy("window_key").agg(F.first("shingles").alias("window"))
    both = near.join(held, "window_key").join(items.select("item_key", F.col("shingles").alias("item")), "item_key").select("window_key", "item_key", "window", "item")
    judged = both.mapInArrow(exact(least), "window_key string, item_key string, similarity double")
    stands = windows.select("text_key", "first_word", "window_key").distinct().join(judged, "window_key")
    best = stands.groupBy("text_key", "item_key").agg(F.max(F.struct("similarity", (-F.col("first_word")).alias("at"))).alias("b"))
    return written(best.select("text_key", "item_key", (-F.col("b.at")).alias("first_word"), F.col("b.similarity").alias("similarity")), "benchmark-links")


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float) -> DataFrame | None:
    found = linked(docs, benchmark, least)
    if found is None:
        return None
    named = found.join(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.md5("text").alias("item_key")), "item_key").drop("item_key")
    named = written(named, "benchmark-found")
    return docs.select("doc_id", F.md5("text").alias("text_key")).join(small(named), "text_key").select("doc_id", "item_id", "first_word", "similarity")


def cleaned(docs: DataFrame, benchmark: DataFrame, least: float) -> DataFrame:
    """The rows of docs that hold no item; beyond 200,000 texts that do, the join shuffles the rows by their text's MD5."""
    found = linked(docs, benchmark, least)
    if found is None:
        return docs
    held = found.select(F.col("text_key").alias("__held")).distinct()
    return docs.join(small(held), F.md5(docs["text"]) == F.col("__held"), "left_anti")
