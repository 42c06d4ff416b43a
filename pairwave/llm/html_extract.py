"""Main text of HTML pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass decides what it can:

- markup: what stands in menus, headers, footers, sidebars, notices, adverts, forms and comments (by element, role, class or
  id) is boilerplate, and so is, where a page marks its article, what stands outside;
- links: a block whose text is mostly links is boilerplate, as is a copyright line of some size outside an article;
- stop words and length: a block of some length with enough stop words for running text of some language is content, one with
  too few is boilerplate (open inside an article). Blocks in a script that the stop words don't know, and pages
  most of whose long blocks have too few (their language isn't known), are decided by length alone.

Headings and short blocks are left open. In the second pass each open block inherits the label of its nearest decided neighbour in
its region; between two at the same distance, a heading takes the one below and another block takes content. Where nothing
is decided as content, the longest open blocks are. Without any decided neighbour an open block is content.

A class or id sets nothing aside that holds the page's article or main, or its h1 or most of its prose if it has neither. An article
or main is set aside by a whole class name only (``comment``, not ``share-enabled``), or one that begins with a word for comments; a paragraph and whatever stands
inside an article by these, or by a part that always means boilerplate (``related`` or ``ad-slot``, not ``related-work``); a heading by such a part only.

Each page is worked on alone and in time that grows with its length, so a task holds one batch of pages and nothing is
shuffled. A null html counts as empty and gives an empty text; repeated rows stay; url and page_id may be null; other
columns are ignored. Unclosed and stray tags are tolerated: an unclosed comment, script or style runs to the end of the
page, any other element that never closes hides nothing; a quote in a tag that never closes is an ordinary sign.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters from which a block can be decided by its words; stop words needed among them; share of characters in links; characters up
#: to which a line with a copyright sign is a notice.
LONG, DENSITY, LINKS, LINE = 70, 0.10, 0.5, 300

# HTML element names by kind, and frequent function words of a few languages.
SKIPPED = frozenset("head script style title noscript template textarea select option button iframe object canvas svg math audio video map datalist".split())
BREAKS = frozenset(
    "html body p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table caption thead tbody tfoot tr td th section article main header footer nav aside form fieldset "
    "legend blockquote pre figure figcaption address hr details summary dialog menu center hgroup search".split()
)
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 hr".split())
ASIDE = frozenset("nav footer aside form menu dialog search fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead "
    "topbar footer sidebar aside widget cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login share sharing social comment "
    "comments commentlist respond reply replies disqus related recommended recommendations pagination pager toolbar legal copyright disclaimer hidden skip".split()
)
#: Of these, what is set aside however much it holds; and those that mean comments.
ALWAYS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr newsletter subscribe login hidden".split())
REMARKS = frozenset("comment comments commentlist respond reply replies disqus".split())
STOP = frozenset(
    "the of and to in is it that a as for was with on by be this are from or an at have not but which you his her they he she we de la le les des et en un une du "
    "que qui est dans pour par sur pas au aux avec ce il ne se plus son el los las y del con una por su para es al lo como der die das und ist den von zu mit "
    "sich auf für nicht ein eine dem im auch als an werden aus bei nach wird einer um am sind noch wie il di che è non per sono della o e do da em os não mais "
    "het een van op te dat niet zijn met voor aan och att som på det av för är med den till".split()
)

OPEN = re.compile(r"<(?:(/?)([a-zA-Z][a-zA-Z0-9:-]*)|[!?])")
CLOSES = {name: re.compile(rf"</{name}(?![a-zA-Z0-9:-])", re.I) for name in SKIPPED}
RAW = frozenset(("script", "style"))
IN_TAG = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
REGION = re.compile(r"<(?:article|main)\b", re.I)
#: Characters of scripts that say about twice as much in one, and letters of scripts that the stop words are written in.
WIDE = re.compile(r"[\u2e80-\u9fff\uac00-\ud7a3\uf900-\ufaff]")
LATIN = re.compile(r"[a-zA-Z\u00c0-\u024f]")
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
NOTICE = re.compile(r"\u00a9|\ball rights reserved\b", re.I)


@dataclass
class Block:
    text: str
    linked: int  # characters in links
    aside: bool  # in boilerplate, by markup
    region: int | None
    heading: bool
    hint: int  # innermost element around that a class or id calls boilerplate; 0: none

    @property
    def size(self) -> int:
        return len(self.text) + len(WIDE.findall(self.text))

    @property
    def links(self) -> bool:
        return self.linked > LINKS * len(self.text)


def marked(attributes: str, whole: bool = False, article: bool = False) -> tuple[str, bool]:
    """What an element's class or id calls it, if that is boilerplate (always or weak), and whether its other attributes do, or hide it.
    whole: a part of a name counts only if it is always boilerplate (not for an article), or begins the name and means comments."""
    hint = ""
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            for word in value.split():
                parts = re.split("[_-]+", word)
                found = {word} & HINTS | {parts[0]} & REMARKS | (set() if article else ALWAYS.intersection(parts)) if whole else HINTS.intersection(parts)
                if found:
                    hint = "always" if hint == "always" or found & ALWAYS or found & REMARKS else "weak"
        if name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and HIDING.search(value):
            return hint, True
    return hint, False


class Page:
    """The blocks of a page. One pass forward; what a search doesn't find is remembered, so that no tag is looked for twice in vain."""

    def __init__(self, page: str):
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked: list[str] = []
        #: open elements: (name, set aside, region, innermost hint); and how many there are of each name
        self.stack: list[tuple[str, bool, int | None, int]] = []
        self.open: dict[str, int] = {}
        #: for each hint: the hint around it, whether it holds what the page is about, and whether it is weak
        self.around, self.cleared, self.weak = [0], [True], [False]
        self.plain = REGION.search(page) is None
        self.link = self.heading = self.leaf = False
        self.regions = 0
        self.last = {q: page.rfind(q) for q in "\"'>"}
        self.loose, self.never = False, set()
        at, end = 0, len(page)
        while (m := OPEN.search(page, at)) is not None:
            if m.start() > at:
                self.add(page[at : m.start()])
            if m[2] is None:
                stop, size = ("-->", 3) if page.startswith("<!--", m.start()) else (">", 1)
                at = page.find(stop, m.start() + 2)
                at = end if at < 0 else at + size
            elif m.end() > self.last[">"]:
                at = m.start()
                break
            else:
                close = self.tag_end(page, m.end())
                at = self.element(page, m[2].lower(), bool(m[1]), page[m.end() : close], close + 1)
        self.add(page[at:])
        self.end_block()
        self.settle()

    def tag_end(self, page: str, at: int) -> int:
        """Where a tag's > stands, beyond quoted parts. Once that fails, quotes in this page's tags don't count any more."""
        p = at
        while not self.loose and (m := IN_TAG.search(page, p)) is not None:
            if m[0] == ">":
                return m.start()
            p = m.end()
            if p <= self.last[m[0]]:
                p = page.index(m[0], p) + 1
        self.loose = True
        return page.index(">", at)

    def element(self, page: str, name: str, closes: bool, attributes: str, at: int) -> int:
        """Take a tag in; returns where to go on."""
        if name not in SKIPPED:
            self.tag(name, closes, attributes)
        elif not closes and (name in RAW or not attributes.endswith("/")):
            m = None if name in self.never else CLOSES[name].search(page, at)
            if m is not None:
                stop = page.find(">", m.end())
                return len(page) if stop < 0 else stop + 1
            self.never.add(name)
            return len(page) if name in RAW else at
        return at

    def add(self, text: str) -> None:
        text = unescape(text) if "&" in text else text
        self.parts.append(text)
        if self.link:
            self.linked.append(text)

    def clear(self, hint: int) -> None:
        """What holds the page's article isn't boilerplate, nor is what is around it."""
        while not self.cleared[hint]:
            self.cleared[hint] = True
            hint = self.around[hint]

    def tag(self, name: str, closes: bool, attributes: str) -> None:
        if name == "a":
            self.link = not closes
        elif name == "br":
            self.add(" ")
        elif name in BREAKS:
            self.end_block()
            self.link, self.heading = False, not closes and name[0] == "h" and name[1:].isdigit()
            if name in LEAVES:
                hint, sure = marked(attributes, True) if attributes and not closes and name != "hr" else ("", False)
                if sure or hint == "always" or hint and name == "p":
                    self.leaf = True
                elif not closes and name == "h1" and self.plain and self.stack and not self.stack[-1][1]:
                    self.clear(self.stack[-1][3])
            elif closes:
                if self.open.get(name):
                    while (top := self.stack.pop()[0]) != name:
                        self.open[top] -= 1
                    self.open[name] -= 1
            else:
                self.enter(name, attributes)

    def enter(self, name: str, attributes: str) -> None:
        _, aside, region, around = self.stack[-1] if self.stack else ("", False, None, 0)
        article = name in ("article", "main")
        hint, sure = marked(attributes, article or region is not None, article) if attributes else ("", False)
        if article and not aside:
            if not (hint or sure) and (name == "main" or not self.regions):
                self.clear(around)
            if self.cleared[around]:
                if region is None:
                    self.regions += 1
                    region = self.regions
                aside = bool(hint or sure) and name != "main"
        elif name not in ("html", "body"):
            aside = aside or name in ASIDE or name == "header" and region is None or sure
            if hint:
                self.around.append(around)
                self.cleared.append(False)
                self.weak.append(hint == "weak")
                around = len(self.around) - 1
        self.stack.append((name, aside, region, around))
        self.open[name] = self.open.get(name, 0) + 1

    def end_block(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            _, aside, region, hint = self.stack[-1] if self.stack else ("", False, None, 0)
            self.blocks.append(Block(text, len(" ".join("".join(self.linked).split())), aside or self.leaf, region, self.heading, hint))
        self.parts, self.linked, self.leaf = [], [], False

    def settle(self) -> None:
        """On a page without article or main, weak hints that hold most of the prose don't count; then hints set blocks aside."""
        if self.plain:
            held, prose = [0] * len(self.around), 0
            for b in self.blocks:
                if not (b.aside or b.links) and b.size >= LONG:
                    held[b.hint] += b.size
                    prose += b.size
            for k in range(len(held) - 1, 0, -1):
                if self.weak[k] and 2 * held[k] > prose:
                    self.cleared[k] = True
                held[self.around[k]] += held[k] if self.weak[k] else 0
            for k in range(1, len(held)):
                self.cleared[k] = self.cleared[k] and self.cleared[self.around[k]]
        for b in self.blocks:
            b.aside = b.aside or not self.cleared[b.hint]


def density(text: str) -> float | None:
    """Share of stop words; None for a text not mostly in their script."""
    if 2 * len(LATIN.findall(text)) < sum(map(str.isalpha, text)):
        return None
    words = [w.strip(".,;:!?\"'()[]#*$%&|<>-").lower() for w in text.split()]
    return sum(w in STOP for w in words) / len(words)


def noticed(b: Block) -> bool:
    """A copyright line of some size: short, begun or ended by the notice, or not in running words."""
    m = NOTICE.search(b.text) if len(b.text) <= LINE else None
    return m is not None and (b.size < LONG or m.start() == 0 or m.end() >= len(b.text) - 1 or (density(b.text) or 0) < DENSITY)


def first_pass(blocks: list[Block]) -> list[tuple[bool | None, str]]:
    """For each block (True: content, False: boilerplate, None: open; the rule that says so)."""
    found = [
        (False, "markup") if b.aside else (False, "links") if b.links else (False, "notice") if not b.region and noticed(b) else (None, "heading") if b.heading else (None, "short") if b.size < LONG else (None, "long")
        for b in blocks
    ]
    long = {i: density(blocks[i].text) for i, (_, rule) in enumerate(found) if rule == "long"}
    told = sum(blocks[i].size for i, d in long.items() if d is not None)
    known = 2 * sum(blocks[i].size for i, d in long.items() if d is not None and d >= DENSITY) >= told
    for i, d in long.items():
        if d is not None and d >= DENSITY:
            found[i] = True, "stop words"
        elif d is None or not known:
            found[i] = True, "length"
        else:
            found[i] = None if blocks[i].region else False, "few stop words"
    if not any(ok for ok, _ in found):  # nothing long: what is longest is what the page says
        least = max((b.size for b, (ok, rule) in zip(blocks, found, strict=True) if ok is None and rule != "heading"), default=0) / 2
        found = [(True, "longest") if ok is None and rule != "heading" and b.size >= least else (ok, rule) for b, (ok, rule) in zip(blocks, found, strict=True)]
    inside = {b.region for b, (ok, _) in zip(blocks, found, strict=True) if b.region and ok is not False}
    if inside:  # the page says where its article is
        found = [(ok, rule) if b.region or ok is False else (False, "outside") for b, (ok, rule) in zip(blocks, found, strict=True)]
    return found


def second_pass(blocks: list[Block], labels: list[bool | None]) -> list[bool]:
    """Open blocks inherit from the nearest decided block of their region: one scan each way."""
    n = len(blocks)
    before, after = [(n + 1, True)] * n, [(n + 1, True)] * n
    for out, order in ((before, range(n)), (after, range(n - 1, -1, -1))):
        last: dict[int | None, tuple[int, bool]] = {}
        for i in order:
            region = blocks[i].region
            if labels[i] is not None:
                if not (region and blocks[i].aside):  # what is set aside inside an article doesn't speak for the article
                    last[region] = (i, labels[i])
            elif region in last:
                j, ok = last[region]
                out[i] = abs(i - j), ok
    final = []
    for i in range(n):
        if labels[i] is not None:
            final.append(labels[i])
            continue
        (d, ok), (e, ok2) = before[i], after[i]
        final.append(ok if d < e else ok2 if e < d or blocks[i].heading else ok or ok2)
    return final


def main_text(page: str | None) -> str:
    """The content blocks of a page, joined by line feeds."""
    if not page:
        return ""
    blocks = Page(page).blocks
    return "\n".join(b.text for b, ok in zip(blocks, second_pass(blocks, [ok for ok, _ in first_pass(blocks)]), strict=True) if ok)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html)."""
    rows = pages.select("page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    found = rows.mapInArrow(run, "page_id long, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
