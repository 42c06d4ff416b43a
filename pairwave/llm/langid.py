"""Language identification by the nearest of several centroids per language.

A text becomes a vector of hashed character n-grams (one to three letters, case folded, anything else a blank), damped
counts weighted by inverse document frequency and brought to length one. Per language, spherical k-means over a bounded sample of the
training texts (``sample`` a language, picked by a hash of the text, each distinct text once) gives ``clusters``
centroids; a text takes the language of the centroid with the largest cosine, ties going to the language that sorts
first. Each centroid also keeps the distance that all but the farthest of its own texts stay within, and a prediction
beyond it, widened by ``slack``, is marked as rejected.

The fit sees the text and language of training rows only. A prediction sees the whole text and nothing else. Null texts and
texts without a letter give ``und`` with score 0; so does everything if no row has a language to learn. Repeated rows
are predicted one by one, and other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwave.llm.common import written

SIZE, SAMPLE, CLUSTERS, SLACK = 1 << 12, 400, 4, 0.1
#: Characters whose n-grams are counted at once.
PIECE = 1 << 18


@lru_cache(1)
def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def counts(text: str | None, size: int = SIZE) -> np.ndarray | None:
    """Damped counts of a text's hashed n-grams; None without a letter."""
    if not text:
        return None
    total, found, shift = np.zeros(size, np.float64), False, np.uint32(32 - int(math.log2(size)))
    tail = np.array([], np.uint32)  # the two signs before a piece
    for at in range(0, len(text), PIECE):
        x = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letters()[x]
        found = found or bool(is_letter.any())
        x = np.where(is_letter, x, 32).astype(np.uint32)
        x = x[(x != 32) | (np.r_[tail[-1:] if len(tail) else 0, x[:-1]] != 32)]  # one blank between words
        every = np.r_[tail, x].astype(np.uint32)
        one = every * np.uint32(2654435761)
        two = one[:-1] * np.uint32(31) + every[1:] * np.uint32(2246822519)
        three = two[:-1] * np.uint32(31) + every[2:] * np.uint32(3266489917)
        for n, h in enumerate((one, two, three)):
            total += np.bincount(h[max(0, len(tail) - n) :] >> shift, minlength=size)  # those that end in this piece
        tail = every[-2:]
    return np.log1p(total).astype(np.float32) if found else None


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


def clustered(v: np.ndarray, k: int, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means, begun at texts from near the mean to far from it: centroids, and each one's largest distance but for the
    last hundredth. A cluster of under a twentieth of the texts is dropped: it is of odd or mislabelled texts."""
    order = np.argsort(v @ unit(v.mean(axis=0)), kind="stable")
    centers = v[order[np.unique(np.linspace(len(v) - 1, len(v) // 5, min(k, len(v))).astype(int))]]
    for _ in range(rounds):
        near = np.argmax(v @ centers.T, axis=1)
        centers = np.stack([unit(v[near == i].mean(axis=0)) if (near == i).any() else centers[i] for i in range(len(centers))])
    cos = v @ centers.T
    near = np.argmax(cos, axis=1)
    share = np.bincount(near, minlength=len(centers)) / len(v)
    keep = np.flatnonzero(share >= min(0.05, share.max()))
    reach = [1 - np.quantile(cos[near == i, i], 0.01) if (near == i).any() else 0.0 for i in keep]
    return centers[keep], np.array(reach)


def fitted(train: DataFrame, sample: int = SAMPLE, clusters: int = CLUSTERS, size: int = SIZE) -> dict:
    """The model: languages, centroids, reach, idf. train: (text, lang), lang not null. At most about ``sample`` texts of a language are looked at."""
    texts = train.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    rates = {r.lang: min(1.0, sample / r.n) for r in texts.groupBy("lang").agg(F.approx_count_distinct("text", 0.02).alias("n")).collect()}
    empty = {"langs": [], "centers": np.zeros((0, size), np.float32), "reach": np.zeros(0), "idf": np.zeros(size, np.float32)}
    if not rates:
        return empty
    rate = F.create_map(*(x for lang, r in rates.items() for x in (F.lit(lang), F.lit(r))))
    place = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) + F.pmod(F.xxhash64(F.lit(1), "text"), F.lit(1 << 40)) / float(1 << 40)  # fine enough for any number of texts
    picked = texts.where(place < F.element_at(rate, F.col("lang")) * 1_000_000)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                made = [(lang, v.tobytes()) for lang, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if (v := counts(t, size)) is not None]
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made]), pa.array([m[1] for m in made], pa.binary())], names=["lang", "v"])

    sampled = written(picked.select("lang", "text").distinct().mapInArrow(vectors, "lang string, v binary"), "language-sample")

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(size, np.int64)
        for batch in batches:
            for v in batch.column(0).to_pylist():
                df += np.frombuffer(v, np.float32) > 0
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([df.tobytes()], pa.binary())], names=["n", "df"])

    found = sampled.select("v").mapInArrow(present, "n long, df binary").collect()  # a row a task, of a fixed size
    n = sum(r.n for r in found)
    idf = np.log((1 + n) / (1 + sum((np.frombuffer(r.df, np.int64) for r in found), np.zeros(size, np.int64)))).astype(np.float32) + 1

    def centroids(table: pa.Table) -> pa.Table:
        v = unit(np.stack([np.frombuffer(x, np.float32) for x in table.column("v").to_pylist()]) * idf)
        v = v[np.lexsort(v.T[:8])]  # the order that rows come in doesn't matter
        c, reach = clustered(v, clusters)
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(c)), "center": pa.array([x.astype(np.float32).tobytes() for x in c], pa.binary()), "reach": pa.array(reach, pa.float64())})

    rows = sorted(sampled.groupBy("lang").applyInArrow(centroids, "lang string, center binary, reach double").collect(), key=lambda r: r.lang)
    if not rows:
        return empty
    return {"langs": [r.lang for r in rows], "centers": np.stack([np.frombuffer(r.center, np.float32) for r in rows]), "reach": np.array([r.reach for r in rows]), "idf": idf}


def identified(docs: DataFrame, model: dict, keep: tuple[str, ...] = (), slack: float = SLACK) -> DataFrame:
    """doc_id, columns in keep, lang_pred, score, rejected for every row of docs (doc_id, text)."""
    rows = docs.select("doc_id", *keep, "text")
    schema = rows.drop("text").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "rejected": F.lit(True)}).schema
    names = ["doc_id", *keep, "lang_pred", "score", "rejected"]
    langs, centers, reach, idf = model["langs"], model["centers"], model["reach"], model["idf"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                made = [counts(t, len(idf)) if langs else None for t in part.column(part.num_columns - 1).to_pylist()]
                some = [i for i, v in enumerate(made) if v is not None]
                pred, score, rejected = ["und"] * len(made), [0.0] * len(made), [True] * len(made)
                if some:
                    cos = unit(np.stack([made[i] for i in some]) * idf) @ centers.T
                    for i, c in zip(some, cos, strict=True):
                        best = int(np.argmax(c))
                        pred[i], score[i], rejected[i] = langs[best], float(min(1.0, max(0.0, c[best]))), bool(1 - c[best] > reach[best] + slack)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(pred), pa.array(score, pa.float64()), pa.array(rejected)], names=names)

    return rows.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """One document in five, by its id, isn't trained on (a null id counts as 0)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("0")).cast("binary")) % 5 == 0


def predicted(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected: learns from the rows that aren't held out, predicts all."""
    rows = docs.select("doc_id", "text", "lang", held_out().alias("held_out"))
    model = fitted(rows.where(~F.col("held_out")).select("text", "lang"))
    return identified(rows, model, ("held_out",)).select("doc_id", "held_out", "lang_pred", "score", "rejected")
