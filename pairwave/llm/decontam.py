"""Benchmark decontamination: SimHash windows the size of each benchmark item, multi-index Hamming blocks, exact check.

Words are runs of letters and digits in lower case; shingles are of five words (an item of fewer words is one shingle). A
window of a document with as many words as an item, or the whole of a shorter document, is compared with it by weighted Jaccard
similarity of the two shingle multisets; the document is contaminated by the item if some window reaches ``similarity``.

Windows get their SimHash from running sums of hash bits. A multi-index proposes the items: fingerprints are cut into
``BLOCKS`` blocks of 16 bits, and of two that differ in at most ``RADIUS`` bits some block differs in at most RADIUS // BLOCKS;
for each block the index lists items by group of sizes and value, their own and those a bit away, so it stays small; a window
looks up the values that the other bits lead to, and finds every item of its size within the radius. The exact similarity then decides. A pair just at a
similarity of 0.8 differs in about ten bits, and the radius is two standard deviations beyond; the README has the measured recall.

Windows that can't reach any item of their size are skipped without loss: a window needs a certain number of shingles
that stand in some item, whichever, and a membership test on shingle hashes counts them (a text without any is done).

The index of at most ``block`` items and ``BLOCK_BYTES`` of text goes to every task and is built once a worker, and no document row is
shuffled; a larger benchmark is a table that windows are joined to (decontam_tables). Null texts and texts without a word hold nothing; items without a word are in nothing;
repeated rows, doc_ids and items each give their own rows; null ids are carried. Of windows with equal similarity the first
is given. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwave.llm import decontam_tables
from pairwave.llm.windows import BLOCKS, MIX, RADIUS, WIDTH, WORDS, bits, flips, needed, packed, shingles, similarity

SIMILARITY, BLOCK, BLOCK_BYTES = 0.8, 20_000, 1 << 24
#: Differing bits of a block that the index spells out; a window's look-ups spell out the others.
LISTED = 2
#: Windows that are looked up at once.
LOOKUPS = 512
#: Windows whose running sums are held at once.
STRETCH = 1 << 14
def block_values(prints: np.ndarray) -> np.ndarray:
    """(n, BLOCKS): the 16-bit blocks of fingerprints."""
    return np.ascontiguousarray(prints).view(np.uint16).reshape(-1, BLOCKS)


class Index:
    """Benchmark items, by what finds them."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        words = [WORDS.findall((t or "").lower()) for _, t in items]
        kept = [i for i, w in enumerate(words) if w]
        self.item_id = [items[i][0] for i in kept]
        self.number = {w: k + 1 for k, w in enumerate(dict.fromkeys(w for i in kept for w in words[i]))}
        ids = [np.array([self.number[w] for w in words[i]], np.uint64) for i in kept]
        self.k = np.array([min(len(x), WIDTH) for x in ids], int)
        parts = [shingles(x, int(k)) for x, k in zip(ids, self.k, strict=True)]
        self.size = np.array([len(p) for p in parts], int)
        self.counted = [np.unique(p, return_counts=True) for p in parts]
        self.print = np.array([packed(bits(p).sum(axis=0, keepdims=True))[0] for p in parts], np.uint64)
        #: by shingle width: the sizes of items, the hashes of all their shingles, and a filter for those
        self.sizes = {int(k): np.unique(self.size[self.k == k]) for k in np.unique(self.k)}
        self.hashes = {k: np.unique(np.concatenate([p for p, w in zip(parts, self.k, strict=True) if w == k])) for k in self.sizes}
        self.filter = {}
        for k, h in self.hashes.items():
            self.filter[k] = np.zeros(1 << min(25, max(20, (8 * len(h)).bit_length())), bool)
            self.filter[k][self.slots(k, h)] = True
        #: sizes of items in as many groups as keep the lists short
        self.groups = 1 << min(6, max(0, (len(parts) >> 9).bit_length() - 1))
        #: by block: where the list of each group and value begins, and the lists one after the other
        own, listed, self.looked_up = block_values(self.print), flips(LISTED), flips(RADIUS // BLOCKS - LISTED)
        self.lists = []
        for b in range(BLOCKS):
            keys = (self.group(self.size).astype(np.int32)[:, None] << 16 | own[:, b, None] ^ listed).ravel()
            ends = np.cumsum(np.bincount(keys, minlength=self.groups << 16))
            self.lists.append((np.r_[0, ends].astype(np.int32), (np.argsort(keys) // len(listed)).astype(np.int32)))

    def slots(self, k: int, h: np.ndarray) -> np.ndarray:
        return (h & np.uint64(len(self.filter[k]) - 1)).astype(np.int64)

    def group(self, size):
        return size & (self.groups - 1)

    def proposed(self, prints: np.ndarray, group: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all pairs that some block lets through, in a group of sizes; repeated if found in several ways."""
        own, windows, items = block_values(prints), [], []
        for b, (starts, listed) in enumerate(self.lists):
            values = (own[:, b, None] ^ self.looked_up).ravel() + np.int64(group << 16)
            lo = starts[values]
            n = starts[values + 1] - lo
            some = np.flatnonzero(n)
            lo, n = lo[some], n[some]
            windows.append(np.repeat(some // len(self.looked_up), n))
            items.append(listed[np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)])
        return np.concatenate(windows), np.concatenate(items)

    def within(self, prints: np.ndarray, k: int, least: int, most: int) -> list[tuple[int, int]]:
        """(window, item) of all fingerprints within the radius, for items of least to most shingles of k words."""
        sizes, found = self.sizes[k], set()
        for group in np.unique(self.group(sizes[(sizes >= least) & (sizes <= most)])).tolist():
            for at in range(0, len(prints), LOOKUPS):
                w, i = self.proposed(prints[at : at + LOOKUPS], group)
                ok = np.flatnonzero(np.bitwise_count(prints[at + w] ^ self.print[i]) <= RADIUS)
                w, i = at + w[ok], i[ok]
                ok = (self.k[i] == k) & (self.size[i] >= least) & (self.size[i] <= most)
                found.update(zip(w[ok].tolist(), i[ok].tolist(), strict=True))
        return sorted(found)


def hits(index: Index, ids: np.ndarray) -> dict[int, np.ndarray]:
    """For each shingle width of the index, where a shingle of some item stands."""
    found = {}
    for k, known in index.hashes.items():
        h = shingles(ids, k)
        at = np.flatnonzero(index.filter[k][index.slots(k, h)])
        at = at[known[np.minimum(np.searchsorted(known, h[at]), len(known) - 1)] == h[at]]
        if len(at):
            found[k] = at
    return found


def contamination(index: Index, ids: np.ndarray, least: float, spots: dict[int, np.ndarray]) -> Iterator[tuple[int, int, float]]:
    """(item, first word of the best window, its similarity) for each item in a document of these word numbers."""
    best: dict[int, tuple[float, int]] = {}
    for k, at in spots.items():
        h = shingles(ids, k)
        n, sizes = len(h), index.sizes[k]

        def judge(prints: np.ndarray, starts: np.ndarray, size: int, low: int, high: int, k: int = k, h: np.ndarray = h) -> None:
            for w, i in index.within(prints, k, low, high):
                s = int(starts[w])
                found = similarity(index.counted[i], h[s : s + size])
                if found >= least:
                    best[i] = max(best.get(i, (0.0, 0)), (found, -s))

        larger = sizes[(sizes > n) & (n >= least * sizes)]
        if len(larger) and len(at) >= needed(int(larger[0]), n, least):  # the whole document is the one window
            judge(packed(bits(h).sum(axis=0, keepdims=True)), np.array([0]), n, int(larger[0]), int(larger[-1]))
        seen = np.zeros(n + 1, np.int32)
        seen[at + 1] = 1
        seen = np.cumsum(seen)
        starts = {int(m): np.flatnonzero(seen[m:] - seen[:-m] >= needed(m, m, least)) for m in sizes[sizes <= n].tolist() if len(at) >= needed(m, m, least)}
        starts = {m: s for m, s in starts.items() if len(s)}
        if not starts:
            continue
        widest, last = max(starts), max(int(s[-1]) for s in starts.values())
        for c in range(min(int(s[0]) for s in starts.values()), last + 1, STRETCH):  # running sums over a bounded stretch at a time
            inside = {m: s[np.searchsorted(s, c) : np.searchsorted(s, c + STRETCH)] for m, s in starts.items()}
            if any(len(s) for s in inside.values()):
                sums = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(bits(h[c : c + STRETCH + widest]), axis=0, dtype=np.int32)))
                for m, s in inside.items():
                    if len(s):
                        judge(packed(sums[s - c + m] - sums[s - c]), s, m, m, m)
    for i, (found, s) in sorted(best.items()):
        yield i, -s, found


def held_by_tasks(benchmark: DataFrame, block: int):
    """The items, broadcast; None if they are more than ``block`` or BLOCK_BYTES of text."""
    items = benchmark.select("item_id", "text")
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    if size.n > block or size.bytes > BLOCK_BYTES:
        return None
    return benchmark.sparkSession.sparkContext.broadcast([tuple(r) for r in items.collect()])


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, first_word, similarity): every document and item that it holds, with the best window."""
    schema = "doc_id long, item_id long, first_word long, similarity double"
    shared = held_by_tasks(benchmark, block)
    if shared is None:
        found = decontam_tables.contaminated(docs, benchmark, least)
        return docs.sparkSession.createDataFrame([], schema) if found is None else found
    return docs.select("doc_id", "text").mapInArrow(matching(shared, least), schema)


def cleaned(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """The rows of docs (text, ...) that hold no benchmark item; with a benchmark that tasks hold nothing is joined."""
    shared = held_by_tasks(benchmark, block)
    if shared is None:
        return decontam_tables.cleaned(docs, benchmark, least)
    return docs.mapInArrow(filtering(shared, least, docs.columns.index("text")), docs.schema)


def searched(index: Index, texts: list[str | None], least: float) -> Iterator[tuple[int, int, int, float]]:
    """(which text, item, first word, similarity) of what some texts hold."""
    number = index.number.get
    words = [WORDS.findall((t or "").lower()) for t in texts]
    ends = np.cumsum([len(w) + WIDTH for w in words])
    ids = np.zeros(int(ends[-1]), np.uint64)  # texts apart by zeros, which no item has
    for w, e in zip(words, ends.tolist(), strict=True):
        if w:
            ids[e - WIDTH - len(w) : e - WIDTH] = np.fromiter(map(number, w, repeat(0)), np.uint64, len(w))
    spots = hits(index, ids) if index.item_id else {}
    if not spots:
        return
    for d in np.unique(np.concatenate([np.searchsorted(ends, p, side="right") for p in spots.values()])).tolist():
        a, e = int(ends[d]) - WIDTH - len(words[d]), int(ends[d]) - WIDTH
        own = {k: p[(p >= a) & (p + k <= e)] - a for k, p in spots.items()}
        for i, s, j in contamination(index, ids[a:e], least, {k: p for k, p in own.items() if len(p)}):
            yield d, i, s, j


#: The index that this worker has built, by the name of its broadcast.
_built: dict[str, Index] = {}


def built(name: str, shared) -> Index:
    if name not in _built:
        _built.clear()
        _built[name] = Index(shared.value)
    return _built[name]


def matching(shared, least: float):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = built(name, shared)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                made = [(part.column(0)[d].as_py(), index.item_id[i], s, j) for d, i, s, j in searched(index, part.column(1).to_pylist(), least)]
                if made:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "first_word", "similarity"])

    return run


def filtering(shared, least: float, column: int):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = built(name, shared)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                keep = np.ones(part.num_rows, bool)
                keep[[d for d, *_ in searched(index, part.column(column).to_pylist(), least)]] = False
                yield part.filter(pa.array(keep))

    return run
