"""One-permutation MinHash, the conversation trie and importance resampling, against plain code, with odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwave.llm import conv_trie, minhash, resample

rng = random.Random(11)
LONG = " ".join(rng.choice(["alpha", "Beta,", "gamma", "delta\n", "it's", "12", "é"]) for _ in range(60_000))
TEXTS = [None, "", " \n\t ", "a", "One two  three", LONG, LONG, "a b c d e f", "日本語 テキスト 🎉" * 3, "x" * 5000, "A\x00b"]
ROWS = [*((i, t) for i, t in enumerate(TEXTS)), (3, "a"), (3, "a"), (3, "other words here"), (None, "no id"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    clash = ("part", "side", "n_words", "buckets", "gains", "score", "rank", "text_", "__range", "__place", "after", "n")
    return spark.createDataFrame(ROWS, "doc_id long, text string").select("*", *(F.lit("clash").alias(c) for c in clash))


def plain_shingles(text: str | None, width: int = 5) -> set[bytes]:
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def test_edited_texts_of_odd_rows(spark, docs):
    got = minhash.edited(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in ROWS)
    alone = {t: minhash.fingerprint(t).hex() for _, t in ROWS}
    of = defaultdict(set)
    for i, t in ROWS:
        of[i].add((len(t or ""), alone[t]))
    assert all((r.n_chars, r.fingerprint) in of[r.doc_id] for r in got)
    one = {r.doc_id: r for r in got}
    after = lambda a, b: (a or "")[: len(a or "") - len(a or "") // 2] + (b or "")[: len(a or "") // 2]
    for i in (4, 5, 6, 7, 8, 9):
        new = after(TEXTS[i], TEXTS[i + 1])
        assert one[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest() and one[i].edited_fingerprint == minhash.fingerprint(new).hex()
    assert one[5].near_next == 1 and one[1].near_next == 1 and one[9].near_next == 0
    last = after(TEXTS[10], None), after(TEXTS[10], "no id")  # the first row is one without an id, by a hash of its text
    assert one[10].edited_sha256 in {hashlib.sha256(t.encode()).hexdigest() for t in last}
    assert minhash.edited(docs.limit(0)).count() == 0
    lone = minhash.edited(docs.where("doc_id = 7")).first()
    assert lone.edited_sha256 == hashlib.sha256(b"a b c a b c").hexdigest() and lone.near_next == 1


def test_edited_texts_against_plain_code(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(7)
    rows = sorted((r.doc_id, r.text or "") for r in d.select("doc_id", "text").collect())
    got = {r.doc_id: r for r in minhash.edited(d).collect()}
    apart = []
    for (i, a), (_, b) in zip(rows, rows[1:] + rows[:1], strict=True):
        new = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        assert got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest() and got[i].fingerprint == minhash.fingerprint(a).hex()
        for near, other in ((got[i].near_edited, new), (got[i].near_next, b)):
            x, y = plain_shingles(a), plain_shingles(other)
            apart.append(near - (len(x & y) / len(x | y) if x | y else 1.0))
    assert len(got) == len(rows) and abs(np.mean(apart)) < 0.01 and np.sqrt(np.mean(np.square(apart))) < 0.06


@pytest.mark.parametrize("bins,bits", [(64, 8), (256, 8), (128, 2), (64, 1)])
def test_likeness_is_unbiased(bins, bits):
    for shared, own in ((40, 10), (5, 5), (500, 2000), (0, 30)):
        near = []
        for k in range(60):
            words = [f"w{k}-{i}" for i in range(shared + 2 * own)]
            a, b = words[: shared + own], words[:shared] + words[shared + own :]
            pair = [minhash.fingerprint(" ".join(w), width=1, bins=bins, bits=bits) for w in (a, b)]
            x, y = (np.frombuffer(p, np.uint8) for p in pair)
            agree = 1 - np.unpackbits(x ^ y).reshape(-1, bits).any(axis=1).mean()
            near.append((agree - 0.5**bits) / (1 - 0.5**bits))
            assert minhash.likeness(*pair, bits) == pytest.approx(max(0, near[-1]))
        assert abs(np.mean(near) - shared / (shared + 2 * own)) < 0.06


def test_sketch_against_plain_code():
    h = np.array([rng.getrandbits(64) for _ in range(20)], np.uint64)
    order = minhash.order_of(64)
    least = {}
    for x in map(int, h):
        least[x >> 58] = min(x, least.get(x >> 58, x))
    want = [least[i] if i in least else least[min(least, key=lambda j: order[i, j])] for i in range(64)]
    assert minhash.sketch(h, 64).tolist() == want


def test_pieces_of_a_long_text(monkeypatch):
    whole = minhash.fingerprint(LONG)
    monkeypatch.setattr(minhash, "PIECE", 100)
    monkeypatch.setattr(minhash, "KEPT", 3)
    assert minhash.fingerprint(LONG) == whole


TURNS = "conv_id long, turn long, role string, text string"


def plain_trie(rows: list[tuple]) -> Counter:
    convs = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            key = f"{len(role or '')}:{role or ''}{text or ''}"
            convs[c].append((t is not None, t or 0, hashlib.md5(key.encode()).hexdigest(), (role or "", text or "")))
    own = {c: [x[3] for x in sorted(v)] for c, v in convs.items()}
    paths = {c: own.get(c - int(math.fmod(c, 100)), [])[: (h := zlib.crc32(str(c).encode()) % 6)] + v[h:] for c, v in own.items()}
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
    found = Counter()
    for node, of in members.items():
        below = [m for m in members if m[: len(node)] == node]
        leaves = [m for m in below if not any(len(x) == len(m) + 1 and x[:-1] == m for x in below)]
        saved = sum((len(members[m]) - 1) * len(m[-1][1]) for m in below if m)
        ends = ",".join(map(str, sorted(c for c in of if len(paths[c]) == len(node))))
        children = sum(len(m) == len(node) + 1 for m in below)
        found[min(of), len(node), min(members[node[:-1]]) if node else None, len(of), children, len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()] += 1
    return found


def test_trie_against_plain_code(spark, monkeypatch):
    monkeypatch.setattr(conv_trie, "PACK", 3)
    rows = []
    for c in [*range(0, 30), *range(100, 140), *range(205, 215), 1000, 1001, -7]:
        for t in range(rng.choice([1, 1, 2, 5, 8])):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", None]), rng.choice(["hi", "", None, "long text é", f"t{t}"])))
    rows += [(50, t, "user", "hi") for t in range(300)] + [(51, t, "user", "hi") for t in range(299)] + [(52, 1, "user", "hi")] * 4
    rows += [(None, 1, "user", "nobody's"), (None, None, None, None)]
    d = spark.createDataFrame(rows, TURNS).select("*", *(F.lit("clash").alias(c) for c in ("pos", "depth", "owner", "base", "h", "z1", "last", "__range", "tokens")))
    got = Counter(tuple(r) for r in conv_trie.trie(d.repartition(5)).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())
    assert got == plain_trie(rows)


def test_trie_of_few_rows(spark):
    assert conv_trie.trie(spark.createDataFrame([], TURNS)).count() == 0
    assert conv_trie.trie(spark.createDataFrame([(None, 0, "a", "b")], TURNS)).count() == 0
    rows = [(2, 0, "user", "x")]  # its first turns go, and nothing lends any: turnless
    got = conv_trie.trie(spark.createDataFrame(rows, TURNS)).collect()
    assert zlib.crc32(b"2") % 6 > 0 and len(got) == 1
    assert tuple(got[0]) == (2, 0, None, 1, 0, 1, 0, hashlib.sha256(b"2").hexdigest())


def plain_features(text: str | None) -> list[bytes]:
    words = "".join(c.lower() if "A" <= c <= "Z" else c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in text or "").split(" ")
    words = [w for w in words if w]
    return [" ".join(words[i : i + n]).encode() for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain_resampling(rows: list[tuple], target: list[str | None], percent: int = 5) -> list[tuple]:
    of = [[zlib.crc32(f) % 10_000 for f in plain_features(t)] for _, t in rows]
    s, t = Counter(b for x in of for b in x), Counter(zlib.crc32(f) % 10_000 for x in target for f in plain_features(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + 10_000.0) / ((s[b] + 1.0) * (all_t + 10_000.0))))
    out = []
    for (i, text), x in zip(rows, of, strict=True):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, x))
        n_words = sum(b" " not in f for f in plain_features(text))
        out.append((i, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words))
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    place = {id(r): k + 1 for k, r in enumerate(able[: math.floor(Fraction(percent * len(able), 100))])}
    return [(*r[:4], place.get(id(r)), r[4]) for r in out]


def test_resampling_of_odd_rows(spark, docs):
    rows = [*ROWS, *((100 + i, " ".join(rng.choice(["red", "Blue", "x9", "ü"]) for _ in range(15 + i % 20))) for i in range(90))]
    d = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("clash").alias("n_words"), F.lit("clash").alias("buckets"), F.lit("clash").alias("rank"))
    target = [None, "", "red blue red blue", "x9"]
    got = Counter(tuple(r) for r in resample.resampled(d, spark.createDataFrame([(t, 1) for t in target], "text string, n_words int"), percent=20).collect())
    assert got == Counter(plain_resampling(rows, target, 20)) and sum(r[4] is not None for r in got) >= 10
    assert resample.resampled(docs.limit(0), docs).count() == 0
    assert Counter(r.doc_id for r in resample.resampled(docs, docs.limit(0)).collect()) == Counter(r[0] for r in ROWS)


def test_resampling_by_one_dictionary(spark):
    d, b = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    a = {r.doc_id: r.weight for r in resample.resampled(d, b).collect()}
    assert a == {r.doc_id: r.weight for r in resample.weights_by_dictionary(d, b).collect()}


def test_features_in_pieces(monkeypatch):
    whole = resample.Dictionary(10_000).of(LONG, 3)
    monkeypatch.setattr(resample, "PIECE", 100)
    monkeypatch.setattr(resample, "KEPT", 50)
    parts = resample.Dictionary(10_000).of(LONG, 3)
    assert parts[0] == whole[0] and sorted(parts[1]) == sorted(whole[1]) == sorted(zlib.crc32(f) % 10_000 for f in plain_features(LONG))
