"""Document fingerprints: one-permutation MinHash with optimal densification, packed low-order bits, bias-corrected likeness.

A text's shingles (``width`` words; A-Z lower-cased) are hashed once. The top of a hash picks one of ``bins`` bins, of which each keeps its
smallest hash. An empty bin takes the value of a bin that isn't: the first in an order of all bins that is its own and the same for
all texts, as repeated draws from a 2-universal family would give. Of every bin the ``bits`` low-order bits are stored. Two fingerprints
agree in a bin with a chance of J + (1 - J) / 2^bits; ``likeness`` takes that chance part out.

Fewer words than ``width`` make one shingle. Null texts and texts without a word have none: their fingerprint is all zero, like each
other (1) and no other text (0). Texts are hashed piece by piece, so a long one needs 8 bytes a word.

``edited`` sets each text beside the next one by doc_id: rows are dealt and sorted by ranges of (doc_id, a hash of the text), null
first, each task walks its range once, and only the first and last row of a range are joined to their neighbours. Repeated rows
and ids stay; equal rows are neighbours. A lone row is its own successor. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairwave.llm.common import written

WIDTH, BINS, BITS = 5, 256, 8
#: Bytes of a text that are split at once; distinct words whose hashes a task keeps.
PIECE, KEPT = 1 << 20, 1 << 19
BLANKS = re.compile(rb"[ \t-\r]")
# The multipliers of a public 64-bit finaliser, and an odd one for the places in a shingle.
MIX_1, MIX_2, PLACE = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """Hash of each distinct word, worked out when it is first met."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word, 42)
        return h


def word_hashes(text: str | None, known: Words) -> np.ndarray:
    data, at, found = (text or "").encode().lower(), 0, []  # bytes: A-Z only, and the six blanks
    while at < len(data):
        stop = BLANKS.search(data, at + PIECE)
        end = stop.start() if stop else len(data)
        if len(known) > KEPT:
            known.clear()
        words = data[at:end].split()
        found.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        at = end
    return np.concatenate(found) if found else np.array([], np.uint64)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` words; for fewer words one, of all of them."""
    if not len(words):
        return words
    width = min(width, len(words))
    h = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        h = h * PLACE + words[i : len(words) - width + 1 + i]
    h ^= h >> np.uint64(33)
    h *= MIX_1
    h ^= h >> np.uint64(33)
    h *= MIX_2
    return h ^ (h >> np.uint64(33))


@lru_cache(4)
def order_of(bins: int) -> np.ndarray:
    """For each bin a rank of every bin: which one it turns to first, second, ... when empty."""
    return np.random.default_rng(bins).random((bins, bins), np.float32)


def sketch(h: np.ndarray, bins: int) -> np.ndarray:
    """The smallest hash of each bin, empty ones filled; h: at least one hash; bins: a power of two."""
    h = np.sort(h)
    at = np.searchsorted(h, np.arange(bins, dtype=np.uint64) << np.uint64(64 - bins.bit_length() + 1))
    there = np.diff(np.r_[at, len(h)]) > 0
    full = np.flatnonzero(there)
    source = np.arange(bins)
    if len(full) < bins:
        empty = np.flatnonzero(~there)
        source[empty] = full[order_of(bins)[np.ix_(empty, full)].argmin(axis=1)]
    return h[at[source]]


def fingerprint(text: str | None, known: Words | None = None, width: int = WIDTH, bins: int = BINS, bits: int = BITS) -> bytes:
    """The low-order bits of each bin, packed; all zero without a word."""
    h = shingles(word_hashes(text, Words() if known is None else known), width)
    if not len(h):
        return bytes(bins * bits // 8)
    low = sketch(h, bins)[:, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)
    return np.packbits(low.astype(np.uint8)).tobytes()


def likeness(a: bytes, b: bytes, bits: int = BITS) -> float:
    """An estimate of the texts' resemblance (shared shingles to all), 0 to 1, unbiased but for the cut at 0; 1 only if all bins agree."""
    if a == b:
        return 1.0
    if not any(a) or not any(b):
        return 0.0
    apart = np.unpackbits(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)).reshape(-1, bits).any(axis=1)
    chance = 0.5**bits
    return max(0.0, (1 - float(apart.mean()) - chance) / (1 - chance))


def fingerprints(docs: DataFrame, width: int = WIDTH, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint (hex digits) for every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(x.as_py(), known, width, bins, bits).hex() for x in batch.column(1)])], names=["doc_id", "fingerprint"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, rows.select("doc_id", F.lit("").alias("fingerprint")).schema)


FIGURES = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def edited(docs: DataFrame, width: int = WIDTH, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs (doc_id, text).

    The edited text has its last half, rounded down, replaced by as many code points of the next document's beginning, or all.
    """
    kinds = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.binary(), "fingerprint": pa.binary(), "edited_fingerprint": pa.binary(), "near_edited": pa.float64(), "near_next": pa.float64()}
    ends = kinds | {"part": pa.int32(), "side": pa.string(), "text": pa.string()}
    of = lambda text, known: fingerprint(text, known, width, bins, bits)
    batch_of = lambda rows, kinds: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))

    def figures(doc_id: int | None, text: str, fp: bytes, after: str, fp_after: bytes, known: Words) -> tuple:
        n = len(text)
        new = text[: n - n // 2] + after[: n // 2]
        fp_new = of(new, known)
        return doc_id, n, hashlib.sha256(new.encode()).digest(), fp, fp_new, likeness(fp, fp_new, bits), likeness(fp, fp_after, bits)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, known, before = TaskContext.get().partitionId(), Words(), None
        none = (None,) * (len(kinds) - 1)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for doc_id, text in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    fp = of(text, known)
                    out.append((doc_id, *none, part, "first", text) if before is None else (*figures(*before, text, fp, known), None, None, None))
                    before = (doc_id, text, fp)
                yield batch_of(out, ends)
        if before is not None:
            yield batch_of([(before[0], *none, part, "last", before[1])], ends)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            for doc_id, text, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield batch_of([figures(doc_id, text, of(text, known), after, of(after, known), known)], kinds)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = ("doc_id", F.xxhash64("text"))  # rows with the same or no doc_id needn't share a task
    found = written(rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").mapInArrow(walk, f"{FIGURES}, part int, side string, text string"), "walked")
    last = found.where("side = 'last'").select("doc_id", "text", "part")
    parts, every = Window.orderBy("part"), Window.partitionBy()
    follows = found.where("side = 'first'").select("part", F.coalesce(F.lead("part").over(parts), F.min("part").over(every)).alias("next"))  # a row a task
    first = found.where("side = 'first'").select(F.col("part").alias("next"), F.col("text").alias("after"))
    rest = last.join(follows, "part").join(first, "next").select("doc_id", "text", "after").mapInArrow(join, FIGURES)
    every_row = found.where("side is null").select(*kinds).unionByName(rest)
    return every_row.withColumns({c: F.lower(F.hex(c)) for c, kind in kinds.items() if kind == pa.binary()})  # hex digits only here: the table holds bytes
