"""Main text of web pages by tag-path ratios.

A page is read as blocks of text, each under the path of block elements from the root (with their classes).  Blocks of one
path share their fate: text length and punctuation are summed per path and divided by its number of blocks.  The ratios
are smoothed along the page, fused with the path's own, weakened by its share of link text, and paths above a fraction of
the scores' deviation carry the content.  The container of such a path brings every clean block below it that is not one of a list of links: lists, quotes,
tables, captions, short lines.

Clean is what is not in navigation, header, footer, aside, form, button, dialog or menu elements, nor hidden, nor in an
element that names itself as advert, notice or comment.  A name alone takes no main text away: an element that holds most
of the page's text stays, more than ``MOST`` of it if a class or id is a noise word as a whole, more than ``HALF`` if the
word is only a part (``has-sidebar``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.registry import query
from gleaner.sources.tables import table

THRESHOLD = 0.3
LINKS = 0.5
MOST, HALF = 0.8, 0.5
KERNEL = np.exp(-np.arange(-2, 3) ** 2 / 2.0)

TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/<>]*)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/<>]*)([^>]*+)>""", re.S)
#: a tag that the page ends in
TAIL = re.compile(r"</?[A-Za-z][^<>]*$|<[!?][^>]*$", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
PUNCTUATION = re.compile(r"[.,;:!?…、。，！？]")
WHITE = re.compile(r"\s+")
RAW = {t: re.compile(f"</{t}[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "select")}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
          "tbody": {"tr", "td", "th", "tbody", "thead"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}}
NOISE_TAGS = set("head nav footer aside form button dialog menu".split())
NOISE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe signup login paywall share sharing social menu nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar sidebar aside widget footer "
    "masthead comment comments commentlist reply replies respond disqus related recommended recommendations trending popular tags copyright disclaimer hidden search".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


CLEAN, PARTLY, NAMED, NOISE = range(4)
#: where text stands directly in the page's root, what may hold more of it
LISTS = set("ul ol li dl dt dd blockquote table caption thead tbody tfoot tr td th figure figcaption pre p hr".split()) | HEADINGS
ROOTS = {"", "html", "body"}


def _attributes(text: str) -> dict[str, str]:
    """Attributes by name in lower case; the first of several."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    return found


def _kind(tag: str, attributes: dict[str, str], in_article: bool) -> int:
    if tag in NOISE_TAGS or tag == "header" and not in_article or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return NOISE
    if tag in ("html", "body", "article", "main"):
        return CLEAN
    names = [x for a in ("class", "id", "role") for x in attributes.get(a, "").split()]
    if not NOISE_WORDS.isdisjoint(names):
        return NAMED
    return CLEAN if NOISE_WORDS.isdisjoint(x for n in names for x in re.split("[_-]+", n)) else PARTLY


class Page:
    """Blocks of a page in order, and its block elements: parent, kind, path; a path: parent path, tag."""

    def __init__(self, page: str):
        self.parent, self.kind, self.path = [0], [CLEAN], [0]
        self.above, self.tags, self.numbers = [0], [""], {}
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters of link text
        self._read(page)

    def _open(self, within: int, tag: str, attributes: dict[str, str], in_article: bool) -> int:
        key = (self.path[within], tag, attributes.get("class", ""))
        if key not in self.numbers:
            self.numbers[key] = len(self.tags)
            self.above.append(self.path[within])
            self.tags.append(tag)
        self.parent.append(within)
        self.kind.append(_kind(tag, attributes, in_article))
        self.path.append(self.numbers[key])
        return len(self.parent) - 1

    def _read(self, page: str) -> None:
        stack: list[tuple[str, int, bool]] = [("", 0, False)]
        text: list[str] = []
        links = in_link = position = 0
        last = page.rfind(">") + 1

        def flush() -> None:
            nonlocal links
            joined = WHITE.sub(" ", unescape("".join(text))).strip()
            if joined:
                self.blocks.append((stack[-1][1], joined, min(links, len(joined))))
            text.clear()
            links = 0

        def add(piece: str) -> None:
            nonlocal links
            if piece:
                text.append(piece)
                if in_link:
                    links += len(piece)

        def pop(tags: set[str], stop: set[str]) -> None:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in tags:
                    del stack[k:]
                    return
                if stack[k][0] in stop:
                    return

        while (m := TOKEN.search(page, position, last)) is not None:
            add(page[position : m.start()])
            position = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                if m[0].startswith("<!--") and not m[0].endswith("-->"):
                    position = len(page)
                continue
            closing, attributes = m[1] or m[4], m[3] or m[6] or ""
            if tag in RAW and not closing:
                end = RAW[tag].search(page, position)
                position = end.end() if end else len(page)
            elif tag == "br":
                add(" ")
            elif tag == "a":
                in_link = 0 if closing else 1
            elif tag in INLINE or tag in VOID and tag != "hr" or tag in RAW:
                continue
            else:
                flush()
                in_link = 0
                if closing:
                    pop({tag}, set())
                elif tag not in VOID:
                    if tag == "p" or tag not in CLOSES:
                        if stack[-1][0] == "p" or tag in HEADINGS and stack[-1][0] in HEADINGS:
                            stack.pop()
                    else:
                        if stack[-1][0] == "p":
                            stack.pop()
                        pop(CLOSES[tag], HOLDS.get(tag, {"table"}))
                    _, element, in_article = stack[-1]
                    own = self._open(element, tag, _attributes(attributes), in_article)
                    stack.append((tag, own, in_article or tag in ("article", "main")))
        add(TAIL.sub("", page[position:]) if position <= last else page[position:])
        flush()

    def clean(self) -> np.ndarray:
        """Which elements are clean, by their own kind, their share of the text and what they stand in."""
        n = len(self.parent)
        noise, held = [k == NOISE for k in self.kind], [0] * n
        for e in range(1, n):
            noise[e] = noise[e] or noise[self.parent[e]]
        for e, text, _ in self.blocks:
            held[e] += 0 if noise[e] else len(text)
        for e in range(n - 1, 0, -1):
            held[self.parent[e]] += held[e]
        for e in range(1, n):
            most = {NAMED: MOST, PARTLY: HALF}.get(self.kind[e])
            noise[e] = noise[e] or noise[self.parent[e]] or most is not None and held[e] <= most * held[0]
        return ~np.array(noise)


def main_text(page: str) -> str:
    """The content blocks of a page, joined by single spaces."""
    read = Page(page)
    if not read.blocks:
        return ""
    good = read.clean()
    element = np.array([e for e, _, _ in read.blocks])
    keys, index = np.unique(2 * np.array(read.path)[element] + good[element], return_inverse=True)
    path, clean = keys // 2, keys % 2 == 1
    length = np.array([len(t) for _, t, _ in read.blocks], float)
    signs = np.array([len(PUNCTUATION.findall(t)) for _, t, _ in read.blocks], float)
    linked = np.array([n for *_, n in read.blocks], float)
    nodes, total, marks, in_links = (np.bincount(index, w, len(keys)) for w in (np.ones(len(element)), length, signs, linked))
    text_ratio, sign_ratio = total / nodes * clean, marks / nodes * clean

    def smooth(series: np.ndarray) -> np.ndarray:
        padded = np.pad(series, 2)
        weight = np.convolve(np.pad(np.ones(len(series)), 2), KERNEL, "valid")
        return np.convolve(padded, KERNEL, "valid") / weight

    near_text, near_signs = smooth(text_ratio[index]), smooth(sign_ratio[index])
    fused = np.bincount(index, np.sqrt(near_text * (1 + near_signs)), len(keys)) / nodes * np.sqrt(text_ratio * (1 + sign_ratio)) * (1 - in_links / total)
    few_links = in_links <= LINKS * total
    content = clean & (fused > 0) & (fused >= THRESHOLD * np.std(fused[index])) & few_links
    # what a path's container brings: 2 every block below it, 1 only lists, quotes, tables and the like below the root
    brings = np.zeros(len(read.tags), int)
    holders = np.array(read.above)[path[content]]
    brings[holders] = [1 if read.tags[h] in ROOTS else 2 for h in holders]
    for p in range(1, len(brings)):  # parents come first
        if not brings[p]:
            tag, over = read.tags[p], brings[read.above[p]]
            brings[p] = 2 if over == 2 and tag != "article" else 1 if over == 1 and tag in LISTS else 0
    # what is brought must not be a list of links: links are weighed among the blocks of one parent
    within = np.array(read.parent)[element]
    listed = np.bincount(within, linked) <= LINKS * np.bincount(within, length)
    return " ".join(t for (_, t, _), k, w in zip(read.blocks, index, within) if content[k] or clean[k] and listed[w] and brings[path[k]])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row: null and empty pages give the empty text, repeated rows stay; other
    columns are left out.  Pages are read whole, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py() or "") for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


@query("op7_html_text")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return extract(table(spark, folder, "pages"))
