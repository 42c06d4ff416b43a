"""Conversation prefix trie by smallest-member ownership.

A node is a distinct sequence of first turns (role, text); its members are the conversations that begin with it, and the smallest of
them owns it. Who owns a node owns, or shares with no smaller one, all that follows on its own path: so each conversation owns a suffix
of its path, and every node has one owner. Sums over a subtree need no tree then: a subtree's tokens are those of its members' paths from
there on, less those of nodes that they own; its leaves are the members that own theirs. Running sums along each path, from its end,
and one group-by over prefixes give all figures of all nodes.

A prefix is known by its depth and two 64-bit exclusive ors of hashes of (depth, turn), which a scan can carry through conversations of any length. Windows are
over ranges of paths, never over the members of a node, which for a common first turn may be a third of all: those are counted by a
group-by, and only nodes with several members are joined back. Ids of conversations that end at a node are packed, up to ``PACK`` in
a row, by ranges of (node, conv_id) before a node's digest runs over them.

Turns stand in order of turn (null first), ties by a digest of role and text; null role or text is empty. Rows without a conv_id belong to no
conversation. Repeated rows are turns of their own. The remainder of a negative id is negative, as in SQL. Other columns are ignored. An empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwave.llm.common import small, written
from pairwave.operators.scan import latest, parity, ranged, scanned, total

#: Conversations whose first one lends its turns, and the number below which the turns lent stay.
SPAN, LENT = 100, 6
NODE = ("depth", "z1", "z2")
PACK = 4096


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, tokens): every turn by its place, 1, 2, ... in its conversation; tokens are code points of the text."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("tokens"))
    order = ["turn", "digest"]
    return scanned(ranged(rows, ["conv_id"], order, "turns"), ["conv_id"], order, {"pos": total(F.lit(1))}).select("conv_id", F.col("pos").cast("int").alias("pos"), "digest", "tokens")


def rebuilt(turns: DataFrame, span: int = SPAN, lent: int = LENT) -> DataFrame:
    """(conv_id, depth, digest, tokens, last): turns (conv_id, pos, digest, tokens) of conversations that each begin with some of the
    turns of their span's first one, and a row of depth 0 for each."""
    first = (F.col("conv_id") - F.col("conv_id") % span).alias("base")
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("n")).select("conv_id", first, (F.crc32(F.col("conv_id").cast("string")) % lent).cast("int").alias("h"), "n")
    bases = convs.where("conv_id = base").select("base", F.col("n").alias("base_n"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    plan = convs.join(bases, "base", "left").select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    plan = written(plan, "conversations")
    heads = turns.where((F.col("pos") < lent) & (F.col("conv_id") % span == 0)).withColumnRenamed("conv_id", "base")
    borrowed = heads.join(plan, "base").where("pos <= h").select("conv_id", F.col("pos").alias("depth"), "digest", "tokens", "length")  # at most span conversations to a base
    own = turns.join(plan, "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "digest", "tokens", "length")
    roots = plan.select("conv_id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("digest"), F.lit(0).cast("long").alias("tokens"), "length")
    return borrowed.union(own).union(roots).select("conv_id", "depth", "digest", "tokens", (F.col("depth") == F.col("length")).alias("last"))


def paths(turns: DataFrame) -> DataFrame:
    """turns (conv_id, depth, digest, tokens, last) as a table in ranges, with the prefix of each as (z1, z2)."""
    z = {f"z{k}": parity(F.when(F.col("depth") > 0, F.xxhash64(F.lit(k), F.col("depth"), F.col("digest")))) for k in (1, 2)}
    return written(scanned(ranged(turns, ["conv_id"], ["depth"], "paths"), ["conv_id"], ["depth"], z).drop("digest"), "prefixes")


def digests_of_ids(ends: DataFrame) -> DataFrame:
    """(depth, z1, z2, sha256) from ends (depth, z1, z2, conv_id): SHA-256 of the decimal ids of each, ascending, comma-joined."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, out = None, [], []
        for batch in batches:
            for *here, i in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids and (here != node or len(ids) == PACK):
                    out.append((*node, ids[0], ",".join(map(str, ids))))
                    ids = []
                node = here
                ids.append(i)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*node, ids[0], ",".join(map(str, ids))), kinds, strict=True)], names=names)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha, out = None, None, []
        for batch in batches:
            for *here, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if here == node:
                    sha.update(b",")
                else:
                    if sha is not None:
                        out.append((*node, sha.hexdigest()))
                    node, sha = here, hashlib.sha256()
                sha.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [*kinds[:3], pa.string()], strict=True)], names=[*NODE, "sha256"])
                out = []
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*node, sha.hexdigest()), [*kinds[:3], pa.string()], strict=True)], names=[*NODE, "sha256"])

    kinds, names = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()], [*NODE, "first", "ids"]
    node = "depth int, z1 long, z2 long"
    packed = ends.select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(pack, f"{node}, first long, ids string")
    return packed.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digest, f"{node}, sha256 string")


def nodes(paths_: DataFrame) -> DataFrame:
    """A row for each node of paths (conv_id, depth, z1, z2, tokens, last): conv_id (its owner), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    several = paths_.groupBy(*NODE).agg(F.min("conv_id").alias("owner"), F.min("last").alias("leaf"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    shared = small(written(several, "shared"))
    known = paths_.join(shared, list(NODE), "left").withColumns({"owner": F.coalesce("owner", "conv_id"), "leaf": F.coalesce("leaf", "last")})
    along, order = written(known, "owners"), ["depth"]
    owned = F.col("owner") == F.col("conv_id")
    down = scanned(along, ["conv_id"], order, {"parent": latest(F.col("owner"), -1)})
    up = {
        "child": latest(owned.cast("int"), -1),
        "saved": total(F.when(owned, 0).otherwise(F.col("tokens"))),
        "leaves": total((F.col("last") & F.col("leaf") & owned).cast("int")),
    }
    figures = scanned(down, ["conv_id"], order, up, backward=True)
    long = lambda c, name: c.cast("long").alias(name)
    of = figures.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), long(F.min("parent"), "parent_conv_id"), F.count("*").alias("n_convs"), long(F.sum(F.coalesce("child", F.lit(0))), "n_children"), long(F.sum("leaves"), "n_leaves"), long(F.sum("saved"), "saved_tokens")
    )
    ends = digests_of_ids(paths_.where("last"))
    none = hashlib.sha256().hexdigest()
    return of.join(ends, list(NODE), "left").select("conv_id", long(F.col("depth"), "depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha256", F.lit(none)).alias("ends_sha256"))


def trie(conversations: DataFrame, span: int = SPAN, lent: int = LENT) -> DataFrame:
    """The nodes of all conversations (conv_id, turn, role, text), rebuilt."""
    return nodes(paths(rebuilt(written(turns_of(conversations), "placed"), span, lent)))
