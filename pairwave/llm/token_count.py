"""Exact token counts by a byte-level BPE that is compiled, as it is used, into a deterministic transducer.

A transducer state holds, for each place of the last bytes at which a longer token may still begin, the place in the
vocabulary's trie, the token that ends there, and how many tokens there are to it. Reading a byte gives the next state and
the number of tokens emitted, which may be negative where a merge takes tokens back. States and transitions are made
when first needed and kept. Texts are cut where the pre-tokenizer always starts anew (before a blank that a visible
character follows), and counts of the parts met before are kept as well.

A long text is cut into chunks of about ``chunk`` characters, which become rows of their own. Each nominal cut moves to a place
near it where a pre-token is sure to begin, as both neighbours see the same ``WINDOW`` characters on either side; where there is none, the cut
stands in a long run of signs of one kind, which is one pre-token, and is open. A chunk's state map gives, for each state of the
transducer that it may be entered in, the state that it is left in and the tokens emitted on the way. After a sure cut that is the
first state alone; after an open one, it is those that any of the signs before the cut lead to, run in step and together from where they
meet. Maps hold no text, compose associatively, and are composed as a balanced tree for each document, from the first state. A
text whose composition meets a state that a map lacks is counted whole.

Null texts count as empty: 0 bytes, 0 tokens. Repeated rows and doc_ids stay (equal rows of a long text are worked out once); other columns are ignored. The text of a
special token counts as that token, as the tokenizers library does by default.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwave.llm.common import written

#: Fixed by the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as the tokenizers library's patterns have it.
SPACE = r"\p{White_Space}"
CHUNK, WINDOW = 1 << 14, 64
#: The map's name for the first state.
FRESH = b""
#: Parts whose counts, transducer states, and token pairs a worker keeps before it starts afresh.
KEPT_PARTS, KEPT_STATES, KEPT_PAIRS = 3 << 17, 1 << 18, 1 << 18
NEVER = 1 << 60
#: What a row of a long text is known by, and its copies together: it says the same of a row if a lost task is run again.
ROW = ("doc_id", "n_bytes", "key")
KEYS = (*ROW, "no", "copies")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable bytes for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Transducer:
    """Counts tokens of a byte-level BPE given as a tokenizers .json file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        ids = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(letters[c] for c in s) for s, i in ids.items() if all(c in letters for c in s)}
        self.single = {b[0]: i for i, b in self.bytes_of.items() if len(b) == 1}
        self.merge, self.made_of = {}, {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merge[ids[a], ids[b]] = (rank, ids[a + b])
            self.made_of[ids[a + b]] = (ids[a], ids[b], rank)
        self.spines: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.specials = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.words = regex.compile(PATTERN.replace(r"\s", SPACE).replace(r"\S", rf"[^{SPACE}]"))
        self.odd = regex.compile(rf"{SPACE}{SPACE}|^{SPACE}|{SPACE}$")
        self.trie: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for i, b in self.bytes_of.items():
            node = 0
            for x in b:
                if x not in self.trie[node]:
                    self.trie[node][x] = len(self.trie)
                    self.trie.append({})
                    self.token_at.append(-1)
                node = self.trie[node][x]
            self.token_at[node] = i
        self.kind = regex.compile(rf"(\p{{L}})|(\p{{N}})|({SPACE})|(.)", regex.S)
        self.margin = max([1, *map(len, self.special)]) + 1
        self.pairs: dict[tuple[int, int], bool] = {}
        self.counts: dict[str, int] = {}
        self.word_counts: dict[str, int] = {}
        self.states: list[tuple] = []
        self.bound()

    def bound(self) -> None:
        """Drop what has grown too large; it is made again when needed."""
        if len(self.counts) > KEPT_PARTS:
            self.counts = {}
        if len(self.word_counts) > KEPT_PARTS:
            self.word_counts = {}
        if len(self.pairs) > KEPT_PAIRS:
            self.pairs = {}
        if not self.states or len(self.states) > KEPT_STATES:
            first = ((0, -1, 0),)
            self.states, self.number = [first], {first: 0}
            self.next: list[dict[int, tuple[int, int]]] = [{}]

    def merged(self, data: bytes) -> list[int]:
        """Plain BPE: the best-ranked pair is merged until none is left."""
        out = [self.single[b] for b in data]
        while len(out) > 1:
            rank, at = min((self.merge.get(p, (NEVER, 0))[0], k) for k, p in enumerate(zip(out, out[1:], strict=False)))
            if rank == NEVER:
                break
            out[at : at + 2] = [self.merge[out[at], out[at + 1]][1]]
        return out

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The pieces that stand at a token's left (0) or right (1) edge while it is built, each with the rank at which it is used up."""
        known = self.spines.get((token, side))
        if known is None:
            known, t = [(token, NEVER)], token
            while t in self.made_of:
                rank = self.made_of[t][2]
                t = self.made_of[t][side]
                known.append((t, rank))
            known = self.spines[token, side] = known[::-1]
        return known

    def follows(self, a: int, b: int) -> bool:
        """Whether the BPE leaves token b as it is, after token a (-1: at the start).

        It does unless, while both tokens are being built, the pieces at their border have a merge that comes before
        the one that uses up either; of equal ranks the left one comes first.
        """
        known = self.pairs.get((a, b))
        if known is None:
            if a < 0:
                known = self.merged(self.bytes_of[b]) == [b]
            else:
                left, right, i, j, known = self.spine(a, 1), self.spine(b, 0), 0, 0, True
                while True:
                    (x, x_ends), (y, y_ends) = left[i], right[j]
                    rank = self.merge.get((x, y), (NEVER, 0))[0]
                    if rank < x_ends and rank <= y_ends and rank < NEVER:
                        known = False
                        break
                    if x_ends == y_ends == NEVER:
                        break
                    if x_ends <= y_ends:
                        i += 1
                    else:
                        j += 1
                known = known and self.follows(-1, b)
            self.pairs[a, b] = known
        return known

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """Next state, and the tokens that reading the byte adds."""
        alive, token, gain = [], None, 0
        for node, last, count in self.states[state]:
            down = self.trie[node].get(byte)
            if down is not None:
                alive.append((down, last, count))
                if token is None and (t := self.token_at[down]) >= 0 and self.follows(last, t):
                    token, gain = t, count + 1
        after = (*((n, last, c - gain) for n, last, c in alive if self.trie[n]), (0, token, 0))
        at = self.number.get(after)
        if at is None:
            at = self.number[after] = len(self.states)
            self.states.append(after)
            self.next.append({})
        self.next[state][byte] = at, gain
        return at, gain

    def run(self, data: bytes) -> int:
        state = total = 0
        table = self.next
        for b in data:
            state, gain = table[state].get(b) or self.step(state, b)
            total += gain
        return total

    def part(self, text: str) -> int:
        """Tokens of a text without special tokens."""
        total, known = 0, self.word_counts
        for w in self.words.findall(text):
            n = known.get(w)
            if n is None:
                n = known[w] = self.run(w.encode())
            total += n
        return total

    def plain(self, text: str) -> int:
        if not text:
            return 0
        if self.odd.search(text):
            return sum(map(self.known, regex.split(rf"(?= [^{SPACE}])", text)))
        first, *rest = text.replace("\n", " \n").split(" ")
        counts = self.counts
        try:
            return self.part(first) + sum([counts[w] for w in rest])
        except KeyError:
            self.bound()
            counts = self.counts
            for w in rest:
                if w not in counts:
                    counts[w] = self.part(w if w[0] == "\n" else " " + w)
            return self.part(first) + sum([counts[w] for w in rest])

    def known(self, part: str) -> int:
        if part[:1] == " " and part[1:2] not in ("\n", ""):  # then the key without the blank says the same
            n = self.counts.get(part[1:])
            if n is None:
                n = self.counts[part[1:]] = self.part(part)
            return n
        return self.part(part)

    def count(self, text: str) -> int:
        if self.specials is None or not any(s in text for s in self.special):
            return self.plain(text)
        parts = self.specials.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))

    def cut(self, window: str, middle: int) -> tuple[int, bool | None]:
        """(where to cut a window of text, whether that is open); None if that can't be told. It is sure where a pre-token begins
        whatever stands before the window, nearest to the middle first, and no special token is near."""
        kinds = [m.lastindex for m in self.kind.finditer(window)]
        letter, space, other = 1, 3, 4
        near = [m.span() for m in self.specials.finditer(window)] if self.specials else []
        low, high = self.margin, len(window) - self.margin if len(window) == 2 * middle else len(window) - 1

        def sure(p: int) -> bool:
            a, b = kinds[p - 1], kinds[p]
            if any(s - 1 <= p <= e + 1 for s, e in near):
                return False
            if b == space:
                return a != space or p + 1 < len(kinds) and kinds[p + 1] != space  # the last of some
            if a == space:
                return window[p - 1] != " " and kinds[p - 2] != space
            if a == other and b == letter and window[p - 1] == "'":  # unless that is a contraction
                return kinds[p - 2] == other or window[p - 2] == " "
            return a != b

        for d in range(max(middle - low, high - middle) + 1):
            for p in (middle - d, middle + d):
                if low <= p <= high and sure(p):
                    return p, False
        return middle, True if len(set(kinds[low - 1 : high + 1])) == 1 else None

    def name(self, state: int) -> bytes:
        """The same in all workers."""
        return FRESH if state == 0 else hashlib.blake2b(repr(self.states[state]).encode(), digest_size=16).digest()

    def through(self, entries: list[int], data: bytes) -> list[tuple[int, int]]:
        """(exit state, tokens) for each entry state, over the same bytes. Those in one state go on as one."""
        groups = {s: [(k, 0) for k, e in enumerate(entries) if e == s] for s in dict.fromkeys(entries)}
        totals = dict.fromkeys(groups, 0)
        for at, b in enumerate(data):
            if len(groups) == 1:
                state, total = next(iter(totals.items()))
                members = groups[state]
                for x in data[at:]:
                    state, gain = self.next[state].get(x) or self.step(state, x)
                    total += gain
                groups, totals = {state: members}, {state: total}
                break
            after, sums = {}, {}
            for s, members in groups.items():
                t, gain = self.next[s].get(b) or self.step(s, b)
                n = totals[s] + gain
                if t in after:
                    after[t] += [(k, off + n - sums[t]) for k, off in members]
                else:
                    after[t], sums[t] = members, n
            groups, totals = after, sums
        out = [(0, 0)] * len(entries)
        for s, members in groups.items():
            for k, off in members:
                out[k] = s, totals[s] + off
        return out

    def state_map(self, piece: str, before: int, after: int) -> dict[bytes, tuple[bytes, int]]:
        """The map of a chunk, which begins about ``before`` characters into the piece and ends about ``after`` before its end (0: at an end
        of the text). Empty if it can't be told."""
        self.bound()
        begin, is_open = self.cut(piece[: before + WINDOW], before) if before else (0, False)
        end, goes_on = len(piece), False
        if after:
            at = len(piece) - after - WINDOW
            end, goes_on = self.cut(piece[at:], WINDOW)
            end += at
        if is_open is None or goes_on is None:
            return {}
        parts = self.specials.split(piece[begin:end]) if self.specials else [piece[begin:end]]
        lead = self.words.match(parts[0])[0] if is_open and parts[0] else ""
        entries = list(dict.fromkeys(self.through([0], piece[begin - j : begin].encode())[0][0] for j in range(before - self.margin))) if is_open else [0]
        ways = self.through(entries, lead.encode())
        if goes_on and len(parts) == 1 and len(lead) == end - begin:  # one run from end to end
            return {self.name(e): (self.name(x), n) for e, (x, n) in zip(entries, ways, strict=True)}
        parts[0] = parts[0][len(lead) :]
        left, n = FRESH, len(parts) - 1 + sum(map(self.plain, parts[:-1]))
        if goes_on:
            *words, tail = self.words.findall(parts[-1])
            (state, more), = self.through([0], tail.encode())
            left, n = self.name(state), n + more + sum(self.run(w.encode()) for w in words)
        else:
            n += self.plain(parts[-1])
        return {self.name(e): (left, n + m) for e, (_, m) in zip(entries, ways, strict=True)}

    @staticmethod
    def compose(a: dict, b: dict) -> dict[bytes, tuple[bytes, int]]:
        """The map of chunk a and then chunk b."""
        return {k: (b[e][0], n + b[e][1]) for k, (e, n) in a.items() if e in b}

    def scanned(self, maps: list[dict]) -> int | None:
        """Tokens of the whole text from its chunks' maps, composed as a tree; None if some map lacks a state."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0].get(FRESH, (None, None))[1]


@lru_cache(2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def counted(docs: DataFrame, path: str, limit: int = 1024, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs (doc_id, text). A text of one chunk has a map of one entry, its count."""
    chunk = max(chunk, 4 * WINDOW)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n = [t.count(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64())], names=[part.schema.names[0], "n_bytes", "n_tokens"])

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        entry = pa.list_(pa.struct([("entry", pa.binary()), ("exit", pa.binary()), ("n", pa.int64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16)
                made = [t.state_map(*x) for x in zip(*(part.column(c).to_pylist() for c in ("piece", "before", "after")), strict=True)]
                found = pa.array([[{"entry": k, "exit": e, "n": n} for k, (e, n) in m.items()] for m in made], entry)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in KEYS), found], names=[*KEYS, "map"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for batch in batches:
            n = [t.scanned([{e["entry"]: (e["exit"], e["n"]) for e in m["map"]} for m in ms]) for ms in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(n, pa.int64())], names=[*ROW, "copies", "n_tokens"])

    size = F.octet_length("text").cast("long").alias("n_bytes")
    whole = rows.where(F.length("text") <= chunk).select("doc_id", size, "text").mapInArrow(short, "doc_id long, n_bytes long, n_tokens long")
    n, key = F.length("text"), F.md5(F.col("text").cast("binary")).alias("key")
    long = rows.where(n > chunk).select("doc_id", size, key, "text", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("int"))).alias("no"))
    begin, end = F.col("no") * chunk, F.least((F.col("no") + 1) * chunk, n)
    before, after = F.least(begin, F.lit(WINDOW)), F.least(n - end, F.lit(WINDOW))
    pieces = long.select(*ROW, "no", before.alias("before"), after.alias("after"), F.substring(F.col("text"), begin - before + 1, end + after - begin + before).alias("piece"))
    once = pieces.groupBy(*ROW, "no").agg(F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("before", "after", "piece")))
    kinds = "doc_id long, n_bytes long, key string, no int, copies long"
    mapped = once.mapInArrow(maps, f"{kinds}, map array<struct<entry: binary, exit: binary, n: long>>")
    of_doc = mapped.groupBy(*ROW).agg(F.first("copies").alias("copies"), F.sort_array(F.collect_list(F.struct("no", "map"))).alias("maps"))
    found = written(of_doc.mapInArrow(join, "doc_id long, n_bytes long, key string, copies long, n_tokens long"), "token-counts")
    found = found.select(*ROW, "n_tokens", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("col")
    done, open_ = found.where("n_tokens is not null"), found.where("n_tokens is null")
    out = whole.unionByName(done.drop("key"))
    if not open_.isEmpty():
        texts = rows.where(n > chunk).select(key, size, "text").join(open_.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
        again = texts.mapInArrow(short, "key string, n_bytes long, n_tokens long").select("key", "n_tokens")
        out = out.unionByName(open_.drop("n_tokens").join(again, "key").select("doc_id", "n_bytes", "n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
