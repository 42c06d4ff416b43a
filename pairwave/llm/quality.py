"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Words and pairs of neighbouring words are hashed into ``buckets`` counters. Over all documents (raw) and over the trusted
ones (target) the counters make two multinomials with additive smoothing; a document's score is the mean, over its n-grams,
of log(target / raw), so its length does not matter. A trusted document is scored against a target without its own counts,
as it would be without its label. A document is kept if the base rules hold and its score reaches the threshold, which all but
``SPARED`` of the trusted documents reach by those held-out scores: so verdicts do not depend on the size of the corpus.

Everything is DataFrame functions. The only things that are gathered are the table of ``buckets`` counts and log-ratios and a
histogram of held-out scores in steps of ``STEP``, of sizes that do not depend on the corpus. Null and empty texts have no words and fail the base rules. Rows
are judged one by one: repeated rows and doc_ids stay, and columns of the input other than those named are only
carried along if asked for. Documents without a label, with a null label or doc_id are raw corpus only; if no document
is trusted the ratio is 0 everywhere, and whatever the base rules keep is kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwave.llm.common import small, words_of, written

BUCKETS = 1 << 16
#: The uniform part, as a share; and how often each bucket counts as seen beyond that, which matters for small corpora only.
SMOOTHING, SEEN = 1.0, 8.0
#: Share of the trusted documents that may score under the threshold, and the steps in which scores are counted for it.
SPARED, STEP = 0.01, 1e-4
MIN_WORDS, REPEAT_PERCENT = 50, 50
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS, NO_BLANK = "[#*$%&|<>]", r"[^\x20\x09-\x0D]"


def hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def let(value: Column, f) -> Column:
    """f(value) with value computed once: an expression that a lambda mentions would be computed again for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def grams(h: Column, buckets: int) -> Column:
    """Bucket numbers of a word-hash array's words and word pairs."""
    fold = lambda x: F.pmod(x, F.lit(buckets)).cast("int")

    def both(h: Column) -> Column:
        twos = F.transform(h, lambda x, i: F.when(i > 0, fold(F.xxhash64(F.get(h, i - 1), x))))
        return F.concat(F.transform(h, fold), F.slice(twos, 2, F.greatest(F.size(h) - 1, F.lit(0))))

    return let(h, both)


def windows(h: Column) -> Column:
    """A hash for each window of three words."""
    return let(h, lambda h: F.transform(F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))))


def covered(w: Column) -> Column:
    """From the hashes of all windows: how many words lie in one that occurs again. Sorting puts equal windows side by side."""
    ordered = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    same = lambda s, x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
    again = let(ordered, lambda s: F.filter(s, lambda x, j: F.when(j > 0, same(s, x, j - 1)).otherwise(False) | same(s, x, j + 1)))
    at = F.sort_array(F.transform(again, lambda x: x["p"]))
    none = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(at, none, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])


def measured(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, columns in keep, the base figures, and h (word hashes)."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(NO_BLANK))
    # regular expressions and the words themselves: translate() makes a string of each character
    w = docs.select(
        "doc_id",
        *keep,
        words_of(F.col("text")).alias("__words"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    a = w.select("doc_id", *keep, hashes(F.col("__words")).alias("h"), F.length(F.array_join("__words", "")).cast("long").alias("word_chars"), "n_symbols", "n_dup_lines")
    # a cheap test first, on a column, where it is compiled: most texts repeat no window
    v = a.select("*", windows(F.col("h")).alias("__w"))
    repeats = F.when(F.size(F.array_distinct("__w")) < F.size("__w"), covered(F.col("__w"))).otherwise(F.lit(0).cast("long"))
    b = v.select("doc_id", *keep, "h", F.size("h").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", repeats.alias("n_repeat_words"))
    return b.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def with_trust(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with __trusted: whether some label of the doc_id has quality 1."""
    trusted = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("__trusted_id")).distinct()
    return docs.join(small(trusted), F.col("doc_id") == F.col("__trusted_id"), "left").withColumn("__trusted", F.col("__trusted_id").isNotNull()).drop("__trusted_id")


def untoxic(labels: DataFrame) -> DataFrame:
    """The labels (doc_id, quality, toxic) of documents that none of them calls toxic."""
    toxic = labels.where("toxic = 1 and doc_id is not null").select(F.col("doc_id").alias("__toxic_id")).distinct()
    return labels.join(small(toxic), F.col("doc_id") == F.col("__toxic_id"), "left_anti")


def bucket_counts(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, raw, target): n-gram counts over all documents, and over those with quality 1. One pass; what is shuffled is counters."""
    hashed = with_trust(docs.select("doc_id", "text"), labels).select("__trusted", hashes(words_of(F.col("text"))).alias("h"))
    each = hashed.select("__trusted", F.explode(grams(F.col("h"), buckets)).alias("bucket"))
    return each.groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if("__trusted").alias("target"))


def log_ratio(raw: Column, all_raw: Column, target: Column, all_target: Column, buckets: int, smoothing: float) -> Column:
    share = lambda of, all_of: F.log(of / all_of + smoothing / buckets + SEEN / all_target)
    return F.when(all_target <= 0, F.lit(0.0)).otherwise(share(target, all_target) - share(raw, all_raw))


def ratios(counts: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """One row: raw, target, ratio (counts and log-ratio of every bucket, as arrays in bucket order), all_raw, all_target."""
    every = counts.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    full = every.join(counts, "bucket", "left").select("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    rows = F.sort_array(F.collect_list(F.struct("bucket", "raw", "target")))
    one = full.agg(rows.alias("rows"), F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"))
    ratio = F.transform("rows", lambda x: log_ratio(x["raw"], F.col("all_raw"), x["target"], F.col("all_target"), buckets, smoothing))
    return one.select(F.col("rows.raw").alias("raw"), F.col("rows.target").alias("target"), ratio.alias("ratio"), "all_raw", "all_target")


def runs(g: Column) -> Column:
    """(v, n) for each value of an array: how often it stands there."""

    def of(s: Column) -> Column:
        ends = F.filter(F.transform(s, lambda x, i: F.when(F.coalesce(F.get(s, i + 1) == x, F.lit(False)), F.lit(None)).otherwise(i)), lambda i: i.isNotNull())
        return let(ends, lambda e: F.transform(e, lambda p, j: F.struct(F.get(s, p).alias("v"), (p - F.when(j > 0, F.get(e, j - 1)).otherwise(F.lit(-1))).alias("n"))))

    return let(F.sort_array(g), of)


def mean_ratio(g: Column, t: Column) -> Column:
    """The score of a document with these buckets."""
    return let(F.struct(g.alias("g"), t["ratio"].alias("r")), lambda x: F.when(F.size(x["g"]) > 0, F.aggregate(x["g"], F.lit(0.0), lambda a, b: a + F.get(x["r"], b)) / F.size(x["g"])))


def held_out(g: Column, t: Column, buckets: int, smoothing: float) -> Column:
    """The same for a trusted document, whose own counts are taken out of the target."""

    def of(x: Column) -> Column:
        g, raw, target, rest = x["g"], x["raw"], x["target"], x["all_target"] - F.size(x["g"])
        one = lambda r: log_ratio(F.get(raw, r["v"]), x["all_raw"], F.get(target, r["v"]) - r["n"], rest, buckets, smoothing) * r["n"]
        return F.when(F.size(g) > 0, F.aggregate(runs(g), F.lit(0.0), lambda a, r: a + one(r)) / F.size(g))

    return let(F.struct(g.alias("g"), *(t[n].alias(n) for n in ("raw", "target", "all_raw", "all_target"))), of)


def derived_threshold(scores: DataFrame) -> DataFrame:
    """One row, one column: the score that all but SPARED of the trusted documents (score) reach, in steps; null without any."""
    steps = scores.where("score is not null").groupBy(F.floor(F.col("score") / STEP).alias("step")).agg(F.count("*").alias("n"))
    all_steps = F.sort_array(F.collect_list(F.struct("step", "n")))
    one = steps.agg(all_steps.alias("steps"), F.sum("n").alias("n"))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("step"))
    more = lambda a, x: F.struct((a["n"] + x["n"]).alias("n"), F.when(a["step"].isNull() & (a["n"] + x["n"] > SPARED * F.col("n")), x["step"]).otherwise(a["step"]).alias("step"))
    return one.select((F.aggregate("steps", none, more)["step"] * STEP).alias("threshold"))


def scored(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = (), buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """doc_id, columns in keep, base figures, base_failed, score, __trusted: two passes over the texts, one to count and one to score."""
    counted = written(ratios(bucket_counts(docs, labels, buckets), buckets, smoothing), "ratios")
    m = measured(with_trust(docs, labels), (*keep, "__trusted"))
    g = grams(F.col("h"), buckets)
    s = m.withColumn("t", counted.select(F.struct("*")).scalar()).withColumn("score", F.when(F.col("__trusted"), held_out(g, F.col("t"), buckets, smoothing)).otherwise(mean_ratio(g, F.col("t"))))
    return s.select("doc_id", *keep, *FIGURES, "base_failed", "score", "__trusted")


def judged(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = (), buckets: int = BUCKETS, smoothing: float = SMOOTHING, threshold: float | None = None) -> DataFrame:
    """doc_id, columns in keep, base figures, base_failed, kept, score. Without a threshold, it comes from the trusted documents.

    Scores are written once, so that the threshold and the verdicts read them and not the texts.
    """
    rows = written(scored(docs, labels, keep, buckets, smoothing), "scores")
    least = F.lit(threshold) if threshold is not None else derived_threshold(rows.where(F.col("__trusted") & (F.col("n_words") >= MIN_WORDS)).select("score")).scalar()
    verdict = ~F.col("base_failed") & F.coalesce(F.col("score") >= F.coalesce(least, F.lit(-math.inf)), F.lit(False))
    return rows.select("doc_id", *keep, *FIGURES, "base_failed", verdict.alias("kept"), "score")


def brute_score(grams_of_docs: list[list[int]], trusted: list[bool], buckets: int, smoothing: float = SMOOTHING) -> list[float | None]:
    """The same scores by plain counting, for tests."""
    raw, target = [0] * buckets, [0] * buckets
    for gs, t in zip(grams_of_docs, trusted, strict=True):
        for g in gs:
            raw[g] += 1
            target[g] += t
    r, scores = sum(raw), []
    for gs, own in zip(grams_of_docs, trusted, strict=True):
        n = [0] * buckets
        for g in gs if own else []:
            n[g] += 1
        t = sum(target) - sum(n)
        ratio = {g: 0.0 if not t else math.log((target[g] - n[g]) / t + smoothing / buckets + SEEN / t) - math.log(raw[g] / r + smoothing / buckets + SEEN / t) for g in set(gs)}
        scores.append(sum(ratio[g] for g in gs) / len(gs) if gs else None)
    return scores
