"""Secret scans behind a trigram inverted index.

From each rule's regular expression a Boolean query over lower-case trigrams is derived: what every match must hold. The
index is a table of postings (trigram, key) for the trigrams that some query names, where key is a text's MD5: equal texts have
the same postings, which stand there once. The postings are intersected and united as the queries ask, text
by text, which gives the candidates (key, rules). Rows are joined to the candidates by key, and only the rules of a row's
candidate are verified by their regular expressions; a rule without a mandatory trigram (runs of hex digits) scans every
text. Up to ``CANDIDATES`` candidates go to every task and no text moves; beyond that, the join shuffles the rows by key, and Spark
splits the rows of a frequent text.

Matches are leftmost and do not overlap within a kind; a match whose checked group is shorter than the rule asks is
dropped. Offsets are code points, ends exclusive. Null and empty texts have no spans. Repeated rows and doc_ids stay, nulls
elsewhere don't matter, and columns that are not named are only carried if asked for.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwave.llm.common import small, written

#: Candidates (a key and a number, about 50 bytes) up to which they are sent to every task.
CANDIDATES = 1_000_000


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# What secrets look like. The first three make the base; their order is that of equal starts.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
BASE = ("assign", "access", "hex")

#: A query is True (no demand), a trigram, or ("and" | "or", queries).
Query = bool | str | tuple

#: Strings that are followed exactly through a pattern before they are turned into a demand.
FEW = 16


def joined(op: str, queries: list[Query]) -> Query:
    """and/or of queries, simplified."""
    if op == "and":
        queries = [q for q in queries if q is not True]
    elif any(q is True for q in queries):
        return True
    queries = list(dict.fromkeys(queries))
    return True if not queries else queries[0] if len(queries) == 1 else (op, tuple(queries))


def demanded(strings: frozenset[str]) -> Query:
    """What a text must have to hold one of the strings."""
    return joined("or", [joined("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def derived(pattern: str) -> Query:
    """The trigram query of a regular expression, for texts in lower case."""

    def walk(nodes) -> tuple[frozenset[str] | None, Query]:
        """(the strings that the nodes match exactly, if they are few; the query)."""
        exact, whole, demands = frozenset([""]), True, []
        for op, arg in nodes:
            some: frozenset[str] | None = None
            query: Query = True
            if op is sre.LITERAL:
                some = frozenset([chr(arg).lower()])
            elif op is sre.IN and all(x is sre.LITERAL for x, _ in arg):
                some = frozenset(chr(c).lower() for _, c in arg)
            elif op is sre.SUBPATTERN:
                some, query = walk(arg[3])
            elif op is sre.BRANCH:
                parts = [walk(x) for x in arg[1]]
                some = None if any(s is None for s, _ in parts) else frozenset().union(*(s for s, _ in parts))
                query = joined("or", [q for _, q in parts])
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
                lo, hi, inner = arg
                s, q = walk(inner)
                query = q if lo else True
                if s is not None and (lo, hi) == (0, 1):
                    some = s | {""}
                elif s is not None and lo == hi and hi <= 8:
                    some = frozenset([""])
                    for _ in range(hi):
                        some = frozenset(a + b for a in some for b in s)
            if some is not None and len(exact) * len(some) <= FEW:
                exact = frozenset(a + b for a in exact for b in some)
                continue
            demands.append(demanded(exact))
            demands.append(query if some is None else demanded(some))
            exact, whole = (some if some is not None and len(some) <= FEW else frozenset([""])), False
        return (exact, demanded(exact)) if whole else (None, joined("and", [*demands, demanded(exact)]))

    return walk(sre_parser.parse(pattern))[1]


def trigrams(query: Query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def vocabulary(rules: tuple[Rule, ...]) -> list[str]:
    return sorted(set().union(*(trigrams(derived(r.pattern)) for r in rules)))


def keyed(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, columns in keep, __text (null: empty), __key."""
    rows = docs.select("doc_id", *keep, F.coalesce("text", F.lit("")).alias("__text"))
    return rows.withColumn("__key", F.md5(F.col("__text").cast("binary")))


def postings(rows: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(trigram, key): the index of rows (__text, __key), each posting once. trigram: the number in the vocabulary."""
    known = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(i).alias("i")) for i, t in enumerate(vocabulary(rules))))
    found = F.transform(F.array(F.lower("__text")), lambda low: F.transform(F.filter(known, lambda x: F.contains(low, x["t"])), lambda x: x["i"]))
    return rows.select(F.explode(F.get(found, F.lit(0))).alias("trigram"), F.col("__key").alias("key")).distinct()


def answered(query: Query, posted: Column, known: list[str]) -> Column:
    """Whether a text with these postings answers the query."""
    if query is True:
        return F.lit(True)
    if isinstance(query, str):
        return F.array_contains(posted, known.index(query))
    parts = [answered(q, posted, known) for q in query[1]]
    return reduce((lambda a, b: a & b) if query[0] == "and" else (lambda a, b: a | b), parts)


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, rules): texts whose postings answer some rule's query, and a bit for each such rule."""
    known = vocabulary(rules)
    lists = index.groupBy("key").agg(F.collect_set("trigram").alias("posted"))
    asked = [(k, derived(r.pattern)) for k, r in enumerate(rules)]
    some = [F.when(answered(q, F.col("posted"), known), F.lit(1 << k)).otherwise(F.lit(0)) for k, q in asked if q is not True]
    return lists.select("key", reduce(lambda a, b: a + b, some, F.lit(0)).alias("rules")).where("rules > 0")


NO_SPANS = "array<struct<s:int,e:int,k:int>>"


def matches(text: Column, rule: Rule, order: int) -> Column:
    """array of (s, e, k) of a rule's matches: the lengths of matches and of what lies between them add up to offsets."""
    p = F.lit(rule.pattern)
    parts = F.struct(F.regexp_extract_all(text, p, F.lit(0)).alias("m"), F.split(text, rule.pattern, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(rule.group)).alias("checked"))

    def spans(x: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(NO_SPANS).alias("out"))

        def add(a: Column, i: Column) -> Column:
            s = a["at"] + F.length(F.get(x["gap"], i))
            e = s + F.length(F.get(x["m"], i))
            one = F.array(F.struct(s.alias("s"), e.alias("e"), F.lit(order).alias("k")))
            return F.struct(e.alias("at"), F.when(F.length(F.get(x["checked"], i)) >= rule.least, F.concat(a["out"], one)).otherwise(a["out"]).alias("out"))

        return F.aggregate(F.sequence(F.lit(0), F.size(x["m"]) - 1), start, add, lambda a: a["out"])

    return F.get(F.transform(F.array(parts), lambda x: F.when(F.size(x["m"]) > 0, spans(x))), F.lit(0))


def quick(rule: Rule) -> str:
    """A pattern that is found in a text only if the rule has a match of its least length there."""
    return rule.pattern.removesuffix("+") + f"{{{rule.least}}}" if rule.pattern.startswith("[") and rule.least else rule.pattern


def scanned(docs: DataFrame, keep: tuple[str, ...] = (), rules: tuple[Rule, ...] = RULES, most: int = CANDIDATES) -> DataFrame:
    """doc_id, columns in keep, found: array of (s, e, k), by start and then rule."""
    rows = keyed(docs, keep)
    index = written(postings(rows, rules), "postings")
    found = written(candidates(index, rules), "candidates").select(F.col("key").alias("__key"), F.col("rules").alias("__rules"))
    t, each = F.col("__text"), []
    for order, r in enumerate(rules):
        maybe = F.rlike(t, F.lit(quick(r)))
        if derived(r.pattern) is not True:
            maybe = (F.col("__rules").bitwiseAND(1 << order) > 0) & maybe
        each.append(F.coalesce(F.when(maybe, matches(t, r, order)), F.array().cast(NO_SPANS)))
    return rows.join(small(found, most), "__key", "left").select("doc_id", *keep, F.sort_array(F.concat(*each)).alias("found"))


def listed(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def reported(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = scanned(docs, (), rules).select("doc_id", F.explode(F.array("found")).alias("found"))  # found: worked out once
    count = lambda k: F.size(F.filter("found", lambda x: x["k"] == k)).cast("long")
    base = F.filter("found", lambda x: x["k"] < len(BASE))
    return found.select("doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(BASE)), F.sha2(listed(base, rules), 256).alias("base_sha256"), listed(F.col("found"), rules).alias("spans"))


def redacted(text: Column, found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The text with each span, or chain of overlapping spans, replaced by its first kind in brackets."""
    names = F.array(*(F.lit(f"[{r.kind}]") for r in rules))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def put(a: Column, x: Column) -> Column:
        fresh = F.concat(a["out"], F.substring(text, a["at"] + 1, x["s"] - a["at"]), F.get(names, x["k"]))
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.when(x["s"] >= a["at"], fresh).otherwise(a["out"]).alias("out"))

    rest = lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text)))
    return F.when(F.size(found) == 0, text).otherwise(F.aggregate(found, start, put, rest))
