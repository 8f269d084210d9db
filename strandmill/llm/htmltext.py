"""Main text of web pages by tag-path ratios.

A page is read into blocks: runs of text between block-level tags, each with its root-to-leaf path of tags and classes.
For each path, the mean length of plain (unlinked) text and the mean number of punctuation marks of its blocks are taken,
both are smoothed over neighbouring paths in page order and fused into one weight, and paths whose weight is over a share
of the weights' spread are content: every block on them is text.

What an element is called counts as a factor of its paths' weights, and nowhere else: under elements that by tag, role or
class are menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or reader comments it is 0. (A class
name on an element around nine tenths of the page's text is no evidence and does not count.) So it is outside article and
main elements, where a first round of weights finds half of the content in them.

Short paths lose length and punctuation to their neighbours, so headings, paragraphs, list items and cells below the
threshold join content next to them: headings what follows them, others the content of their own section, if they are
not mostly links. Where article or main elements hold most content, text comes from them alone.

All steps are linear in the length of a page: elements point to their parents, paths are numbers, and the end of a tag
with unclosed quotes is looked for once.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm import common

OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([A-Za-z][^\s/>]*))")
STOP = re.compile("[>\"']")
ATTR = re.compile(r"""([A-Za-z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: Cells stand in one line of their row.
CELL = frozenset(("td", "th"))
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of running text, and those that only arrange them.
PROSE = HEADING | frozenset("p li dt dd tr caption pre blockquote figcaption summary article main".split())
ARRANGE = frozenset("ul ol dl dir table thead tbody tfoot tr li dd blockquote figure hgroup details".split())
DROP = frozenset("head script style noscript template title nav footer aside form button select textarea input iframe object svg canvas dialog menu audio video noembed noframes xmp".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())
#: Words of class and id names of menus, headers, footers, sidebars, notices, adverts, forms and reader comments.
MARKS = frozenset("ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo sidebar sidebars aside nav navbar navigation menu menus breadcrumb breadcrumbs pagination footer masthead header comment comments disqus replies cookie cookies consent gdpr notice notices popup modal newsletter form".split())
SAFE = frozenset(("html", "body", "article", "main"))
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡\"'“”«»()-]")
HIDDEN = re.compile(r"display\s*:\s*none")


@dataclass
class Block:
    element: int
    shade: int
    parts: list = field(default_factory=list)
    linked: int = 0
    text: str = ""
    out: bool = False
    path: int = 0


class Page:
    """Elements (name, parent, path number, whether excluded), in page order, and the blocks of text."""

    def __init__(self, page: str):
        self.page, self.length = page, len(page)
        self.names, self.parents, self.paths, self.bad, self.marked = [""], [-1], [0], [False], [False]
        self.shade, self.outer = [0], [0]  # innermost element that may be excluded; innermost block element
        self.numbers: dict[tuple[int, str], int] = {}
        self._stop = self._gap = self._close = -1
        self._unclosed: set[int] = set()
        self.blocks: list[Block] = []
        self._read()
        for b in self.blocks:
            b.text = " ".join(html.unescape("".join(b.parts)).split())
        self.blocks = [b for b in self.blocks if b.text]
        self._exclude()

    def _greater(self, at: int) -> int:
        """The next >, or the page's end."""
        if self._close < at:
            self._close = self.page.find(">", at)
            if self._close < 0:
                self._close = self.length
        return self._close

    def _tag_end(self, at: int) -> int:
        """Where a tag that is open at `at` ends: the next > outside quotes, or just the next one where quotes stay open."""
        seen, p = [], at
        while True:
            if not self._gap <= p <= self._stop:
                m = STOP.search(self.page, p)
                self._gap, self._stop = p, m.start() if m else self.length
            p = self._stop
            if p < self.length and self.page[p] == ">":
                return p
            close = -1 if p >= self.length or p in self._unclosed else self.page.find(self.page[p], p + 1)
            if close < 0:
                self._unclosed.update(seen)
                if p < self.length:
                    self._unclosed.add(p)
                return self._greater(at)
            seen.append(p)
            p = close + 1

    def _traits(self, name: str, attrs: str, inside: bool) -> tuple[str, bool, bool]:
        """The path label of an element, whether its tag or role excludes it, and whether its class or id speaks against it."""
        label, bad, marked = name, name in DROP or name == "header" and not inside, False
        if attrs and not attrs.isspace():
            for key, a, b, c in ATTR.findall(attrs):
                key, value = key.lower(), a or b or c
                if key == "class":
                    label = f"{name}.{value.strip()}"
                if key in ("class", "id") and name not in SAFE:
                    marked = marked or any(w.lower() in MARKS for w in WORDS.findall(value))
                elif key == "role":
                    bad = bad or value.strip().lower() in ROLES
                elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and HIDDEN.search(value):
                    bad = bad or name not in SAFE
        return label, bad, marked

    def _read(self) -> None:
        """Tags to elements. Unclosed tags end with their parents; a new block element ends an open paragraph."""
        page, stack, frames = self.page, [0], []  # open elements; places of block elements in the stack
        open_at: dict[str, list[int]] = {}
        now: Block | None = None
        at, links, articles = 0, 0, 0

        def put(raw: str) -> None:
            nonlocal now
            top = stack[-1]
            if now is None:
                if raw.isspace():
                    return
                base = self.outer[top]
                now = Block(base, self.shade[base])
                self.blocks.append(now)
            into = now
            if self.shade[top] != now.shade:  # an excluded part inside a line
                into = self.blocks[-1]
                if into.shade != self.shade[top]:
                    into = Block(self.shade[top], self.shade[top])
                    self.blocks.append(into)
            into.parts.append(raw)
            if links:
                into.linked += len(raw)

        def pop_to(i: int) -> None:
            nonlocal links, articles
            while len(stack) > i:
                name = self.names[stack.pop()]
                open_at[name].pop()
                links -= name == "a"
                articles -= name in ("article", "main")
            while frames and frames[-1] >= i:
                frames.pop()

        while at < self.length:
            m = OPEN.search(page, at)
            start = m.start() if m else self.length
            if start > at:
                put(page[at:start])
            if m is None:
                break
            if m[1]:
                end = page.find("-->", m.end())
                at = end + 3 if end >= 0 else self.length
                continue
            if m[2]:
                at = self._greater(m.end()) + 1
                continue
            name, closing = m[4].lower(), m[3]
            end = self._greater(m.end()) if closing else self._tag_end(m.end())
            if end >= self.length:  # markup that never ends
                break
            attrs, at = page[m.end() : end], end + 1
            if name in CELL or name == "br":
                put(" ")
            elif name in BLOCK:
                now = None
            if closing:
                where = open_at.get(name)
                if where and (name in BLOCK or not frames or frames[-1] < where[-1]):
                    pop_to(where[-1])
                continue
            if name in BLOCK and frames:
                last = self.names[stack[frames[-1]]]
                if last == "p" or last == name and name in ("li", "dt", "dd", "tr", "option"):
                    pop_to(frames[-1])
            if name in VOID or attrs.endswith("/") and name not in BLOCK and name not in RAW:
                continue
            if name in RAW:
                m = re.compile(f"</{name}", re.I).search(page, at)
                at = self._greater(m.end()) + 1 if m else self.length
                continue
            label, bad, marked = self._traits(name, attrs, articles > 0)
            parent, me = stack[-1], len(self.names)
            self.names.append(name)
            self.parents.append(parent)
            self.paths.append(self.numbers.setdefault((self.paths[parent], label), len(self.numbers) + 1))
            self.bad.append(self.bad[parent] or bad)
            self.marked.append(marked)
            self.shade.append(me if bad or marked else self.shade[parent])
            self.outer.append(me if name in BLOCK else self.outer[parent])
            open_at.setdefault(name, []).append(len(stack))
            if name in BLOCK:
                frames.append(len(stack))
            stack.append(me)
            links += name == "a"
            articles += name in ("article", "main")

    def masses(self, blocks: list[Block]) -> list[int]:
        """By element, the text of those blocks in it."""
        mass = [0] * len(self.names)
        for b in blocks:
            mass[b.element] += len(b.text)
        for e in range(len(mass) - 1, 0, -1):
            mass[self.parents[e]] += mass[e]
        return mass

    def _exclude(self) -> None:
        mass = self.masses([b for b in self.blocks if not self.bad[b.element]])
        out = [False] * len(self.names)
        for e in range(1, len(out)):
            out[e] = out[self.parents[e]] or self.bad[e] or self.marked[e] and 10 * mass[e] < 9 * mass[0]
        for b in self.blocks:
            b.out = out[b.element]
            b.path = 2 * self.paths[b.element] + b.out

    def set_apart(self, content: list[Block]) -> bool:
        """Exclude what is outside article and main elements, where one of them (or all together) holds half of the content."""
        mass = self.masses(content)
        named = [name in ("article", "main") for name in self.names]
        inside = [n and m > 0 and 2 * m >= mass[0] for n, m in zip(named, mass, strict=True)]
        one = any(inside)
        if not one:
            inside = named
        for e in range(1, len(inside)):
            inside[e] = inside[e] or inside[self.parents[e]]
        held = sum(len(b.text) for b in content if inside[b.element])
        if not one and not 0 < mass[0] <= 2 * held:
            return False
        for b in self.blocks:
            if not inside[b.element]:
                b.out, b.path = True, b.path | 1
        return True

    def section(self, b: Block) -> int:
        """The innermost element around a block that does more than arrange it."""
        e = b.element
        if e:
            e = self.parents[e] if self.names[e] not in ("article", "main", "div", "section") else e
        while e and self.names[e] in ARRANGE:
            e = self.parents[e]
        return e


def path_weights(found: list[Block]) -> dict[int, float]:
    """Weight of each path: smoothed mean plain length times the logarithm of smoothed mean punctuation; 0 for excluded paths."""
    order: dict[int, list[float]] = {}
    for b in found:
        s = order.setdefault(b.path, [0.0, 0.0, 0.0, 0.0 if b.out else 1.0])
        s[0] += max(0, len(b.text) - b.linked) * s[3]
        s[1] += len(PUNCTUATION.findall(b.text)) * s[3]
        s[2] += 1
    total = np.array(list(order.values())).reshape(-1, 4)
    kernel = np.array([0.1, 0.8, 0.1])
    smooth = lambda x: np.convolve(np.pad(x, 1, mode="edge"), kernel, "valid")
    fused = smooth(total[:, 0] / total[:, 2]) * np.log1p(0.25 + smooth(total[:, 1] / total[:, 2])) * total[:, 3]
    return dict(zip(order, fused.tolist(), strict=True))


def strong_blocks(found: list[Block], share: float) -> tuple[dict[int, float], list[bool]]:
    """Path weights, and for each block whether its path's weight is over `share` of the spread of the blocks' weights."""
    weight = path_weights(found)
    limit = share * float(np.std([weight[b.path] for b in found]))
    return weight, [weight[b.path] > limit for b in found]


def main_text(page: str | None, share: float = 0.25) -> str:
    """The article's text: blocks joined by newlines. Empty for a null or empty page and where nothing has weight."""
    read = Page(page or "")
    found = read.blocks
    if not found:
        return ""
    weight, strong = strong_blocks(found, share)
    if read.set_apart([b for b, s in zip(found, strong, strict=True) if s]):
        weight, strong = strong_blocks(found, share)
    content = [b for b, s in zip(found, strong, strict=True) if s]
    mass, direct = read.masses(content), {read.section(b) for b in content}
    picked, leads = [], False
    for b, s in zip(reversed(found), reversed(strong), strict=True):
        if weight[b.path] <= 0:
            continue
        name, around = read.names[b.element], read.section(b)
        near = mass[around] > 0 and (around in direct or read.names[around] not in ("", "html", "body"))
        if s:
            leads = True
        elif 2 * b.linked > len(b.text) or name not in PROSE or not (near or leads and name in HEADING):
            leads = False
            continue
        picked.append(b.text)
    return "\n".join(reversed(picked))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row, from its whole html. Null and empty html give empty text.

    Null ids and urls and repeated rows stay as they are; other columns are not read, whatever their names; an empty table
    gives no rows. Pages of any length take time in proportion to it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                texts = [main_text(h.as_py()) for h in batch.column(2)[lo : lo + 256]]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo : lo + 256], batch.column(1)[lo : lo + 256], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.transform(common.arrow_map, run, "page_id long, url string, text string, n_chars long")
