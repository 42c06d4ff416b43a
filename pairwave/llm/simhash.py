"""SimHash near-duplicate detection over a Gray-ordered hierarchical index.

A document's fingerprint is the bitwise majority of the XXH64 hashes (seed 42) of its word shingles. Two fingerprints
are linked if they differ in at most ``radius`` bits; documents that links join form a group.

The index has two parts. Upper nodes are masked bit patterns: 64 bits are cut into radius + 2 blocks, and every pair of
blocks is a mask, so two fingerprints within the radius agree on at least one mask and meet below at least one
upper node. A node with more than ``leaf`` members is refined by masks over its free bits, so no node is ever
worked on that is larger than that, however many fingerprints crowd together, and none is cut off. Below a node
its members stand in Gray order (neighbours differ in few bits), as a binary tree whose inner nodes hold the bits that all
members share; pairs of subtrees are dropped as a whole once the differences on shared bits exceed the radius.

A node gives a spanning forest of its links, not all pairs; that keeps components whole. Null texts and texts without
a word have fingerprint zero and are linked like any other. Repeated rows and repeated doc_ids are kept as they come; a null
doc_id gets a group as well, and never is the smallest id. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwave.llm.common import connected, small, written

SEED = 42
#: Shingles whose bits are counted at once.
PIECE = 1 << 16


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of the shingles of ``width`` words of the text, A-Z lower-cased; 0 without a word."""
    words = (text or "").encode().lower().split()  # bytes: both calls know ASCII only
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, total, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(words) - width + 1
    for at in range(0, n, PIECE):
        part = words[at : min(at + PIECE, n) + width - 1]
        hashes = np.array([digest(s, SEED) for s in map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False))], np.uint64)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, columns in keep, fp (the fingerprint as a signed long)."""
    rows = docs.select("doc_id", *keep, F.col("text").alias("__text"))
    schema = rows.drop("__text").withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                fps = np.array([fingerprint(t, width) for t in part.column(part.num_columns - 1).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(fps)], names=[*part.schema.names[:-1], "fp"])

    return rows.mapInArrow(run, schema)


def masks(bits: list[int], radius: int) -> list[list[int]]:
    """Sets of bits, one of which any two patterns over ``bits`` within the radius agree on: all pairs of radius + 2 blocks."""
    blocks = [b.tolist() for b in np.array_split(np.array(bits), min(radius + 2, len(bits)))]
    return [a + b for a, b in combinations(blocks, 2)]


def signed(bits: list[int]) -> int:
    x = sum(1 << b for b in bits)
    return x - (1 << 64) if x >> 63 else x


def gray_rank(fp):
    """Position of a pattern in Gray order, as an unsigned number in a signed column."""
    for step in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, step))
    return fp


def tree_links(group: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of all members of the same group within the radius. group: ascending; fp: in Gray order in each group."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    counts = [np.diff(np.r_[starts, len(group)])]
    first, ands, ors = [starts], [fp], [fp]
    while counts[-1].max() > 1:  # a level up: two neighbours make a node
        n, f = counts[-1], first[-1]
        up = (n + 1) // 2
        nf = np.r_[0, np.cumsum(up)[:-1]]
        owner = np.repeat(np.arange(len(n)), up)
        j = np.arange(up.sum()) - nf[owner]
        left = f[owner] + 2 * j
        right = np.where(2 * j + 1 < n[owner], left + 1, left)
        counts.append(up)
        first.append(nf)
        ands.append(ands[-1][left] & ands[-1][right])
        ors.append(ors[-1][left] | ors[-1][right])
    own = np.arange(len(starts))
    a = b = np.arange(len(starts))
    for level in range(len(counts) - 2, -1, -1):
        f, n, up = first[level], counts[level], first[level + 1]
        ja, jb = 2 * (a - up[own]), 2 * (b - up[own])
        pairs = [(ja, jb, own), (ja, jb + 1, own), (ja + 1, jb + 1, own)]
        other = a != b
        pairs.append((ja[other] + 1, jb[other], own[other]))
        ja, jb, own = (np.concatenate(x) for x in zip(*pairs, strict=True))
        there = (ja < n[own]) & (jb < n[own])
        ja, jb, own = ja[there], jb[there], own[there]
        a, b = f[own] + ja, f[own] + jb
        lo, hi = ands[level], ors[level]
        shared = ~(lo[a] ^ hi[a]) & ~(lo[b] ^ hi[b])
        near = np.bitwise_count((lo[a] ^ lo[b]) & shared) <= radius
        a, b, own = a[near], b[near], own[near]
    keep = a < b
    return a[keep], b[keep]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n positions the smallest one that the links (a, b) join it to."""
    root = np.arange(n)
    while len(a):
        before = root.copy()
        np.minimum.at(root, a, before[b])
        np.minimum.at(root, b, before[a])
        root = root[root]
        if (root == before).all():
            break
    return root


def leaf_links(radius: int, most: int = 1 << 22):
    """mapInArrow function over rows (mask, key, fp) that come sorted; gives (a, b), a spanning forest of each node's links."""

    def solve(group: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        out_a, out_b = [], []
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        work = np.cumsum(np.diff(np.r_[starts, len(group)]).astype(np.int64) ** 2)
        for piece in np.split(np.arange(len(starts)), np.flatnonzero(np.diff(work // most)) + 1):  # bounds the pairs held at once
            lo, hi = starts[piece[0]], starts[piece[-1] + 1] if piece[-1] + 1 < len(starts) else len(group)
            root = forest(hi - lo, *tree_links(group[lo:hi], fp[lo:hi], radius))
            moved = np.flatnonzero(root != np.arange(hi - lo))
            out_a.append(fp[lo:hi][moved])
            out_b.append(fp[lo:hi][root[moved]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (out_a, out_b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.array([], np.int64)] * 3
        for batch in batches:
            if not batch.num_rows:
                continue
            rest = [np.concatenate((r, batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64))) for i, r in enumerate(rest)]
            change = np.flatnonzero((rest[0][1:] != rest[0][:-1]) | (rest[1][1:] != rest[1][:-1])) + 1
            if len(change) and len(rest[0]) > 4096:
                cut = change[-1]
                group = np.cumsum(np.r_[0, (rest[0][1:cut] != rest[0][: cut - 1]) | (rest[1][1:cut] != rest[1][: cut - 1])])
                yield solve(group, rest[2][:cut].view(np.uint64))
                rest = [r[cut:] for r in rest]
        if len(rest[0]):
            group = np.cumsum(np.r_[0, (rest[0][1:] != rest[0][:-1]) | (rest[1][1:] != rest[1][:-1])])
            yield solve(group, rest[2].view(np.uint64))

    return run


def links(fps: DataFrame, radius: int = 2, leaf: int = 512) -> DataFrame:
    """(a, b) of fps (fp, distinct): links that join all fingerprints within the radius, over one or more of them."""
    found = None
    todo, free = fps.select("fp", F.lit(0).alias("mask"), F.lit(0).cast("long").alias("key")), {0: list(range(64))}
    while todo is not None:
        more, code = {}, None
        for old, bits in free.items():
            parts = []
            for m in masks(bits, radius):
                new = len(more) + 1
                more[new] = [b for b in bits if b not in m]
                fixed = signed([b for b in range(64) if b not in more[new]])
                parts.append(F.struct(F.lit(new).alias("mask"), F.col("fp").bitwiseAND(F.lit(fixed)).alias("key")))
            code = F.when(F.col("mask") == old, F.array(*parts)) if code is None else code.when(F.col("mask") == old, F.array(*parts))
        nodes = todo.select("fp", F.explode(code).alias("at")).select("fp", "at.mask", "at.key")
        sizes = nodes.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
        last = min(map(len, more.values())) < 2 * (radius + 2)  # then the free bits leave few patterns, and all may stand in one node
        crowded = None if last else written(sizes.where(F.col("n") > leaf), "nodes")
        few = nodes.join(sizes if last else sizes.where(F.col("n") <= leaf), ["mask", "key"]).select("mask", "key", "fp")
        ordered = few.repartition("mask", "key").sortWithinPartitions("mask", "key", gray_rank(F.col("fp")))
        got = written(ordered.mapInArrow(leaf_links(radius), "a long, b long"), "links")
        found = got if found is None else found.unionByName(got)
        todo = None
        if crowded is not None and not crowded.isEmpty():
            todo, free = written(nodes.join(small(crowded).drop("n"), ["mask", "key"]).select("fp", "mask", "key"), "crowded"), more
    return found


def groups(fp_rows: DataFrame, radius: int = 2, leaf: int = 512) -> DataFrame:
    """(fp, root, component_id) for every fingerprint of the rows (doc_id, fp): root, the smallest fingerprint that links reach
    from it, names the group, and component_id is the smallest doc_id there."""
    classes = written(fp_rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    roots = connected(links(classes.select("fp"), radius, leaf)).withColumnRenamed("node", "fp")
    linked = roots.join(classes, "fp")
    least = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    of = linked.join(least, "root").select("fp", "root", "component_id")
    return classes.join(of, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("rep")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, leaf: int = 512) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, for every row of docs (doc_id, text)."""
    rows = written(fingerprints(docs, width), "fingerprints")
    of = small(written(groups(rows, radius, leaf).drop("root"), "groups"))  # a table of its own: Spark can split the rows of a frequent fingerprint
    return rows.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, width: int = 3, radius: int = 2, leaf: int = 512) -> DataFrame:
    """The rows of docs (doc_id, text, ...) without near-duplicates: of each group the first by doc_id, null last, and then by text.

    Texts stay where they are: what is joined to them is the list of doc_ids to drop, in general a small part. Rows without
    a doc_id or with one that others have too can't be told apart by it, so they, if any, are chosen by their whole content.
    """
    rows = written(fingerprints(docs, width), "fingerprints")
    group = written(groups(rows, radius, leaf), "groups")
    of = written(rows.join(small(group), "fp").select("doc_id", "fp", "root", "component_id"), "rows-of-groups")
    unsure = of.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("doc_id") != F.col("component_id")).alias("out")).where("n > 1 or doc_id is null or out > 0")
    ids = written(unsure.select(F.col("doc_id").alias("__id"), F.expr("n > 1 or doc_id is null").alias("shared")), "ids")
    shared = ids.where("shared").select("__id")
    kept = docs.join(small(ids), F.col("doc_id").eqNullSafe(F.col("__id")), "left_anti").select(*docs.columns)
    if shared.isEmpty():
        return kept
    mark = docs.join(small(shared), F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    own = fingerprints(mark.select("doc_id", "text", F.struct(*docs.columns).alias("__row")), width, ("__row",))
    placed = own.join(small(group), "fp").where("doc_id <=> component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.col("__row.text"), F.to_json("__row"))
    chosen = placed.groupBy("root").agg(F.min_by("__row", order).alias("__row")).select("__row.*")  # one row of each group leaves a task
    return kept.union(chosen)
