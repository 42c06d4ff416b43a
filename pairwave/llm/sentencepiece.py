"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut into units no piece crosses: a run of blanks (as U+2581) with the visible characters after it, up to where
letters and ASCII signs meet unless a piece of the model joins the two. A line feed is a unit. Every distinct unit is encoded
relationally: it is exploded into its substrings of bounded length, the substrings are equi-joined to the piece table, the
edges that result are grouped by unit, and a fold over a unit's edges finds the segmentation. For a unigram model the fold is
Viterbi's (best sum of scores). The public model at hand is a BPE model, for which a best sum isn't what the library returns;
there, the fold merges the best-scored (leftmost of equals) edge over two neighbouring segments until none is left.
Characters without a piece become bytes.

Documents that lie together form a chunk. A chunk gives its distinct units, which are dealt by hash to be told apart and
encoded once for the whole corpus, and it gets back the ids of its own: what is shuffled is each chunk's vocabulary, there and
back, and the texts once, compressed. A task holds one chunk and its vocabulary, and nothing goes to the driver or to all tasks
but the pieces.

Null and empty texts have no ids. Repeated rows stay; other columns are carried only if asked for. Decoding inverts the
encoding: it gives the text as normalised, which for this model's identity normaliser is the text itself, but that a
U+2581 in a text comes back as a blank, as from the library.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwave.llm.common import cores, written

BLANK = "▁"
#: Documents of a chunk at most, and bytes of their texts by the average text; bytes of text that travel as one row; units that a task holds before it sends them on.
CHUNK_ROWS, CHUNK_BYTES, BLOCK_BYTES, FLUSH = 1 << 13, 1 << 25, 1 << 20, 1 << 20
#: Characters from which a unit is grouped by its digest, and starts of substrings in one slice of it.
LONG, SLICE = 64, 256


@lru_cache(2)
def processor(path: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


def piece_rows(path: str) -> list[tuple[int, str, float]]:
    """(id, piece, score) of the pieces that text can match: neither control, unknown nor byte pieces."""
    m = processor(path)
    return [(i, m.id_to_piece(i), m.get_score(i)) for i in range(m.vocab_size()) if " " not in m.id_to_piece(i) and not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]


def byte_ids(path: str) -> list[int]:
    m = processor(path)
    return [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]


@lru_cache(2)
def unit_pattern(path: str) -> str:
    """The regular expression of a unit, with plain blanks for U+2581."""
    signs = set("0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    pairs = {pair for _, p, _ in piece_rows(path) for pair in zip(p, p[1:], strict=False)}
    if any(b == BLANK != a or "\n" in (a, b) for a, b in pairs):
        raise ValueError("the model has pieces across words or lines")
    joined = defaultdict(set)  # what follows a character in a piece, of letters and signs
    for a, b in pairs:
        if a != BLANK and (a in signs) != (b in signs):
            joined[a].add(b)
    inside = lambda of: "".join(f"\\{c}" if c.isascii() and not c.isalnum() else c for c in sorted(of))
    run = f"(?:[{inside(signs)}]++|[^ \n{inside(signs)}]++)"
    joint = "|".join(f"(?<={inside(a)})(?=[{inside(of)}])" for a, of in sorted(joined.items()))
    after = set().union(*joined.values())
    return f" *+{run}" + (f"(?:(?=[{inside(after)}])(?:{joint}){run})*+" if joint else "") + "| ++|\n"


def units_of(text: str, pattern: str) -> list[str]:
    return re.findall(pattern, " " + text.replace(BLANK, " ")) if text else []


def edges_of(units: DataFrame, pieces: DataFrame, longest: int, dealt: tuple[str, ...] = ()) -> DataFrame:
    """(columns in dealt, key, s, e, id, score): piece id stands from s to e of the distinct unit that has the key (see key_of)."""
    cut = F.explode(F.expr(f"sequence(0, int((length(unit) - 1) div {SLICE}))"))  # a long unit in overlapping slices
    key = F.when(F.length("unit") <= LONG, F.col("unit")).otherwise(F.concat(F.lit("\n"), F.sha2("unit", 256)))
    slices = units.select(*dealt, key.alias("key"), "unit", cut.alias("k")).select(*dealt, "key", (F.col("k") * SLICE).alias("at"), F.substring("unit", F.col("k") * SLICE + 1, F.lit(SLICE + longest - 1)).alias("slice"))
    at, n = F.col("at"), F.length("slice")
    starts = slices.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(SLICE), n))).alias("start"))
    spans = starts.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), n - F.col("start") + 1))).alias("size"))
    s = at + F.col("start") - 1
    parts = spans.select(*dealt, "key", s.alias("s"), (s + F.col("size")).alias("e"), F.substring("slice", F.col("start"), F.col("size")).alias("piece"))
    return parts.join(F.broadcast(pieces), "piece").select(*dealt, "key", "s", "e", "id", "score")


def key_of(unit: str) -> str:
    """What the edges of a unit are grouped by: the unit, or the digest of a long one."""
    return unit if len(unit) <= LONG else "\n" + sha256(unit.encode()).hexdigest()


def lattice(units: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """(unit, edges): for each distinct unit the array of (s, e, id, score) where piece id stands from s to e."""
    found = edges_of(units.select("unit", F.col("unit").alias("whole")), pieces, longest, ("whole",)).withColumnRenamed("whole", "unit")
    edges = found.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("s", "e", "id", "score"))).alias("edges"))
    return units.select("unit").join(edges, "unit", "left").select("unit", F.coalesce("edges", F.array().cast("array<struct<s:int,e:int,id:int,score:double>>")).alias("edges"))


def merge_fold(n: int, scores: dict[tuple[int, int], float]) -> list[int]:
    """The end of each segment of the BPE segmentation of n characters, at its start (elsewhere 0): from all characters apart,
    merge the best edge over two neighbours, leftmost of equals, again and again."""
    ends, before = list(range(1, n + 1)), list(range(-1, n))
    heap = [(-scores[x], *x) for x in zip(range(n - 1), range(2, n + 1), strict=True) if x in scores] if n > 1 else []
    heapify(heap)
    while heap:
        _, s, e = heappop(heap)
        m = ends[s]
        if not 0 < m < e or ends[m] != e:
            continue
        ends[s], ends[m], before[e] = e, 0, s
        for x in ((s, ends[e]) if e < n else None, (before[s], e) if s else None):
            if x in scores:
                heappush(heap, (-scores[x], *x))
    return ends


def viterbi_fold(unit: Column, edges: Column, unknown: float) -> Column:
    """Boundaries of the segmentation with the largest sum of scores (of equals, the one whose last piece begins first). A
    character without a piece scores ``unknown``. The fold carries the best score and the last boundary for each position."""
    state = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("back")))

    def reach(best: Column, e: Column) -> Column:
        ends = F.filter(edges, lambda x: x["e"] == e)
        ways = F.transform(ends, lambda x: F.struct((F.get(best, x["s"])["score"] + x["score"]).alias("score"), (-x["s"]).alias("back")))
        alone = F.struct((F.get(best, e - 1)["score"] + F.when(F.exists(ends, lambda x: x["s"] == e - 1), F.lit(float("-inf"))).otherwise(F.lit(unknown))).alias("score"), (-(e - 1)).alias("back"))
        top = F.array_max(F.concat(ways, F.array(alone)))
        return F.concat(best, F.transform(F.array(top), lambda t: F.struct(t["score"].alias("score"), (-t["back"]).alias("back"))))

    best = F.aggregate(F.sequence(F.lit(1), F.length(unit)), state, reach)
    walk = lambda b: F.aggregate(F.sequence(F.lit(1), F.length(unit)), F.array(F.length(unit)), lambda a, _: F.when(F.get(a, F.lit(0)) > 0, F.concat(F.array(F.get(b, F.get(a, F.lit(0)))["back"]), a)).otherwise(a))
    return F.get(F.transform(F.array(best), walk), F.lit(0))


def segments(units: list[str], edges: pa.Table, byte_id: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all units, one after the other; how many each has): the fold over each unit's edges (key, s, e, id, score)."""
    n = np.fromiter(map(len, units), np.int64, len(units))
    base = np.cumsum(n + 1) - n - 1  # where the n + 1 bounds of each unit begin
    u = pc.index_in(edges.column("key").combine_chunks(), value_set=pa.array(map(key_of, units), pa.string())).to_numpy()
    s, e, piece, score = (edges.column(x).to_numpy() for x in ("s", "e", "id", "score"))
    of = np.full((int(n.sum()) + len(n), int((e - s).max(initial=1)) + 1), -1, np.int32)  # the piece by its start and size
    of[base[u] + s, e - s] = piece
    bound = np.ones(len(of), bool)
    many, long = e - s > 1, n[u] > LONG
    order = np.flatnonzero(many & ~long)
    order = order[np.lexsort((s[order], -score[order], u[order]))]
    left = u[order], (base[u] + s)[order], (base[u] + e)[order]
    while len(left[0]):  # in each unit the best edge over two neighbours is merged
        unit, a, b = left
        count, at = np.cumsum(bound), np.flatnonzero(bound)
        fits = np.flatnonzero(count[b] - count[a] == 2)
        best = fits[np.diff(unit[fits], prepend=-1) != 0]
        bound[at[count[a[best]]]] = False
        going = np.zeros(len(n), bool)
        going[unit[best]] = True
        stay = going[unit] & bound[a] & bound[b]
        left = unit[stay], a[stay], b[stay]
    rows = np.flatnonzero(many & long)
    for k in np.unique(u[rows]).tolist():
        mine = rows[u[rows] == k]
        ends = merge_fold(int(n[k]), dict(zip(zip(s[mine].tolist(), e[mine].tolist(), strict=True), score[mine].tolist(), strict=True)))
        bound[base[k] : base[k] + n[k]] = np.array(ends) > 0
    at = np.flatnonzero(bound)
    owner = np.repeat(np.arange(len(n)), n + 1)[at]
    first = np.flatnonzero(owner[1:] == owner[:-1]) if len(at) else at
    start, owner = at[first], owner[first]
    ids, sizes = of[start, np.minimum(at[first + 1] - start, of.shape[1] - 1)], np.ones(len(first), np.int64)
    lost, text = np.flatnonzero(ids < 0), "".join(units).replace(" ", BLANK)
    codes = [[byte_id[x] for x in text[i].encode()] for i in (start[lost] - owner[lost]).tolist()]
    sizes[lost] = [len(x) for x in codes]
    ids, ends = np.repeat(ids, sizes), np.cumsum(sizes)
    for k, code in zip(lost.tolist(), codes, strict=True):
        ids[ends[k] - len(code) : ends[k]] = code
    return ids, np.bincount(owner, sizes, len(n)).astype(np.int64)


def piece_table(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The vocabulary, of a fixed size, with plain blanks, and the length of its longest piece."""
    rows = [(i, p.replace(BLANK, " "), score) for i, p, score in piece_rows(path)]
    return spark.createDataFrame(rows, "id int, piece string, score double"), max(len(p) for _, p, _ in rows)


def encoded_units(units: DataFrame, path: str) -> DataFrame:
    """(unit, ids) by the relational lattice."""
    bucket = F.pmod(F.xxhash64("unit"), F.lit(16 * cores(units.sparkSession))).cast("int").alias("bucket")
    plain = F.when(F.col("unit") == "\n", "").otherwise(F.translate("unit", BLANK, " "))
    listed = units.select(bucket, F.concat(F.lit("0\n"), plain).alias("units"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for r in batch.to_pylist() for x in units_with_ids(r["blob"], r["n"], r["size"])]
            yield pa.RecordBatch.from_arrays([pa.array([u.replace(" ", BLANK) for u, _ in found], pa.string()), pa.array([np.frombuffer(x, "<i4") for _, x in found], pa.list_(pa.int32()))], names=["unit", "ids"])

    return folded(listed, path).mapInArrow(run, "unit string, ids array<int>")


def folded(listed: DataFrame, path: str) -> DataFrame:
    """(chunk, n, size, blob): the n units of (bucket, units), of a chunk and bucket, with their ids (see units_with_ids). A
    bucket's distinct units go through the lattice once, whatever the number of chunks that they are in."""
    pieces, longest = piece_table(listed.sparkSession, path)
    byte_id = byte_ids(path)
    n = cores(listed.sparkSession)
    # a task sorts the edges of about four buckets; read by both sides, in the same columns, so that Spark deals once
    dealt = listed.repartition(max(n, min(4 * n, 1 << 12)), "bucket")
    each = dealt.select("bucket", F.explode(F.slice(F.split("units", "\n", -1), 2, F.lit(1 << 30))).alias("unit"))
    distinct = each.select("bucket", F.when(F.col("unit") == "", "\n").otherwise(F.col("unit")).alias("unit")).distinct()

    def run(edges: pa.Table, given: pa.Table) -> pa.Table:
        chunks: dict[str, dict[str, None]] = defaultdict(dict)
        for x in given.column("units").to_pylist():
            chunk, *units = x.split("\n")
            chunks[chunk].update(dict.fromkeys(units))
        number = {u: k for k, u in enumerate({u: None for x in chunks.values() for u in x})}
        ids, sizes = segments([u or "\n" for u in number], edges, byte_id)
        ids, sizes, ends = ids.astype("<i4"), sizes.astype("<i4"), np.cumsum(sizes)
        blobs, raw = [], []
        for x in chunks.values():
            rows = np.fromiter(map(number.__getitem__, x), np.int64, len(x))
            size = sizes[rows]
            at = np.repeat(ends[rows] - np.cumsum(size), size) + np.arange(int(size.sum()))
            code = size.tobytes() + ids[at].tobytes() + "\n".join(x).encode()
            blobs.append(pa.compress(code, "zstd", asbytes=True))
            raw.append(len(code))
        return pa.table([pa.array(map(int, chunks), pa.int64()), pa.array(map(len, chunks.values()), pa.int64()), pa.array(raw, pa.int64()), pa.array(blobs, pa.binary())], names=["chunk", "n", "size", "blob"])

    edges = edges_of(distinct, pieces, longest, ("bucket",)).withColumnRenamed("bucket", "of")
    return edges.groupBy("of").cogroup(dealt.groupBy("bucket")).applyInArrow(run, "chunk long, n long, size long, blob binary")


def units_with_ids(blob: bytes | pa.Buffer, n: int, size: int) -> Iterator[tuple[str, bytes]]:
    """n units, each with its ids as little-endian 32-bit numbers, from a blob of so many bytes: sizes, ids, units."""
    code = pa.decompress(blob, size, "zstd", asbytes=True)
    cuts = (4 * (n + np.cumsum([0, *np.frombuffer(code, "<i4", n)]))).tolist()
    return ((u or "\n", code[a:b]) for u, a, b in zip(code[cuts[-1] :].decode().split("\n"), cuts, cuts[1:], strict=False))


def packed(table: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write(table)
    return sink.getvalue().to_pybytes()


def unpacked(blob: bytes | pa.Buffer) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def in_chunks(docs: DataFrame, keep: tuple[str, ...], part: int = 1) -> DataFrame:
    """(doc_id, columns in keep, __text, chunk): a chunk is a range of rows of one file, the same in each reading; rows that aren't
    a file's are written first. part: divides the limits of a chunk."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        docs = written(docs.select("doc_id", "text", *keep), "texts")
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    rows = max(1, min(CHUNK_ROWS // part, -(-n // docs.sparkSession.sparkContext.defaultParallelism), CHUNK_BYTES // part * n // max(size, 1)))
    chunk = F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / rows))
    return docs.select("doc_id", *keep, F.coalesce("text", F.lit("")).alias("__text"), chunk.alias("chunk"))


def units_by_chunk(rows: DataFrame, path: str) -> DataFrame:
    """(bucket, units): the chunk and its distinct units that fall into a bucket, sorted, between line feeds; a line feed itself is empty there."""
    buckets, pattern = min(16 * cores(rows.sparkSession), 1 << 14), unit_pattern(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, set[str]] = defaultdict(set)

        def sent() -> Iterator[pa.RecordBatch]:
            for chunk in list(seen):
                lists = defaultdict(list)
                for u in seen.pop(chunk):
                    lists[zlib.crc32(u.encode()) % buckets].append("" if u == "\n" else u)
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), pa.array(["\n".join([str(chunk), *sorted(x)]) for x in lists.values()], pa.string())], names=["bucket", "units"])

        last = None
        for batch in batches:
            for text, chunk in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if chunk != last:  # a file's rows come in order, so the chunks before this one are done
                    yield from sent()
                    last = chunk
                seen[chunk].update(units_of(text.as_py(), pattern))
            if len(seen.get(last, ())) >= FLUSH:
                yield from sent()
        yield from sent()

    return rows.select("__text", "chunk").mapInArrow(run, "bucket int, units string")


def in_blocks(rows: DataFrame) -> DataFrame:
    """(chunk, blob): documents of one chunk that lie together, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                chunk = batch.column("chunk").to_numpy()
                block = np.cumsum(pc.binary_length(batch.column("__text")).to_numpy(), dtype=np.int64) // BLOCK_BYTES
                cuts = [0, *(np.flatnonzero((np.diff(chunk) != 0) | (np.diff(block) != 0)) + 1).tolist(), batch.num_rows]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    blob = packed(batch.slice(a, b - a).drop_columns(["chunk"]))
                    yield pa.RecordBatch.from_arrays([pa.array(chunk[a : a + 1], pa.int64()), pa.array([blob], pa.binary())], names=["chunk", "blob"])

    return rows.mapInArrow(run, "chunk long, blob binary")


def piece_bytes(path: str) -> pa.Array:
    """What each id decodes to."""
    of = {i: p.replace(BLANK, " ").encode() for i, p, _ in piece_rows(path)} | {i: bytes([b]) for b, i in enumerate(byte_ids(path))}
    return pa.array([of.get(i, b"") for i in range(processor(path).vocab_size())], pa.large_binary())


def decoded(ids: np.ndarray, sizes: list[int], pieces: pa.Array) -> list[bytes]:
    """The texts, in UTF-8, of lists of ids that stand one after the other. pieces: what each id decodes to."""
    found = pieces.take(pa.array(ids, pa.int32()))
    _, ends, data = found.buffers()
    text = data.to_pybytes() if data else b""
    cuts = np.frombuffer(ends, "<i8")[np.cumsum([0, *sizes])].tolist() if len(ids) else [0] * (len(sizes) + 1)
    return [text[a:b][1:] for a, b in zip(cuts, cuts[1:], strict=False)]  # without the blank that encoding puts first


def encoded(docs: DataFrame, path: str, keep: tuple[str, ...] = (), with_ids: bool = True) -> DataFrame:
    """doc_id, columns in keep, n_pieces, ids_crc32 (of the ids as little-endian 32-bit numbers), round_trip (whether decoding
    the ids gives the text), and ids if asked for, for every row of docs (doc_id, text). docs is read twice and must give the
    same rows each time."""
    rows = in_chunks(docs, keep, 1 + with_ids)  # a chunk's ids are as much again to hold
    units = folded(units_by_chunk(rows, path), path)
    names = ["doc_id", *keep, "n_pieces", "ids_crc32", "round_trip", *["ids"] * with_ids]
    schema = rows.drop("__text", "chunk").withColumns({"n_pieces": F.lit(0).cast("long"), "ids_crc32": F.lit(0).cast("long"), "round_trip": F.lit(True)} | ({"ids": F.array().cast("array<int>")} if with_ids else {})).schema

    # the tasks get the pattern and the pieces, not the model: a worker would keep it in memory
    pattern, pieces = unit_pattern(path), piece_bytes(path)

    def run(blocks: pa.Table, vocabulary: pa.Table) -> pa.Table:
        known: dict[str, bytes] = {}
        for blob, *counts in zip(vocabulary.column("blob"), *(vocabulary.column(x).to_pylist() for x in ("n", "size")), strict=True):
            known.update(units_with_ids(blob.as_buffer(), *counts))
        done = []
        for blob in blocks.column("blob"):
            part = unpacked(blob.as_buffer())
            texts = part.column("__text").to_pylist()
            codes = [b"".join([known[u] for u in units_of(t, pattern)]) for t in texts]
            ids, sizes = np.frombuffer(b"".join(codes), "<i4"), [len(x) // 4 for x in codes]
            same = [a == t.encode() for a, t in zip(decoded(ids, sizes, pieces), texts, strict=True)]
            out = [*part.drop_columns(["__text"]).columns, pa.array(sizes, pa.int64()), pa.array([zlib.crc32(x) for x in codes], pa.int64()), pa.array(same, pa.bool_())]
            if with_ids:
                out.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(ids, pa.int32())))
            done.append(pa.Table.from_arrays(out, names=names))
        return pa.concat_tables(done)

    return in_blocks(rows).groupBy("chunk").cogroup(units.groupBy("chunk")).applyInArrow(run, schema)
