"""Main text: probes of names and containers, and a plain version of the rule over well-formed pages."""

import math
import random
import time
from collections import defaultdict
from html.parser import HTMLParser

import pytest

from gleaner.llm import htmltext

STORY = [f"Paragraph {k} of the story, which is long; it goes on, and on, with signs, clauses, and detail enough. It ends here, at last." for k in range(5)]
PARAGRAPHS = "".join(f"<p>{t}</p>" for t in STORY)


@pytest.mark.parametrize("attributes", ['style="overflow:hidden"', 'data-hidden="false"', 'data-id="promo"', 'class="layout has-sidebar"', 'class="no-comments"', 'class="search-results"',
                                        'class="tags-on"', 'id="related-work"', 'id="notice"', "title='a hidden thing' class=story"])
def test_names_take_no_main_text_away(attributes):
    menu = "<nav><ul><li><a href='/'>Menu, of things</a></li></ul></nav>"
    for inside in (f"<div {attributes}>{PARAGRAPHS}</div>", f"<div {attributes}><div><section>{PARAGRAPHS}</section></div></div>"):
        assert htmltext.main_text(f"<html><body>{menu}{inside}<footer>Imprint, and so on.</footer></body></html>") == " ".join(STORY)


@pytest.mark.parametrize("attributes", ["hidden", 'aria-hidden="true"', 'class="comments"', 'class="comment-list"', 'id="cookie-notice"', 'class="ad"', 'role="navigation"'])
def test_named_noise_beside_the_story_goes(attributes):
    noise = f"<div {attributes}><p>Something said, at length, that is not the story. It has signs, too; and more of them.</p></div>"
    for page in (f"<body><div>{PARAGRAPHS}</div>{noise}</body>", f"<body><article>{PARAGRAPHS}{noise}</article></body>"):
        assert htmltext.main_text(page) == " ".join(STORY)


@pytest.mark.parametrize("tag", ["article", "main", "div", "section"])
def test_lists_quotes_tables_captions_stay(tag):
    more = ("<ul><li>First point.</li><li>Second point.<ol><li>Inner point.</li></ol></li></ul><blockquote><p>A quote.</p></blockquote>"
            "<div class='wrap'><table><caption>Some figures</caption><tr><th>Head</th></tr><tr><td>Cell one</td><td>Cell two</td></tr></table></div>"
            "<figure><img src='x'><figcaption>A caption.</figcaption></figure>")
    links = "<ul>" + "".join(f'<li><a href="/{k}">Another headline, number {k}</a></li>' for k in range(5)) + "</ul>"
    text = htmltext.main_text(f"<html><body><{tag}>{PARAGRAPHS}{more}{links}</{tag}></body></html>")
    assert text == " ".join([*STORY, "First point. Second point. Inner point. A quote. Some figures Head Cell one Cell two A caption."])


def test_text_in_the_root_brings_lists_only():
    page = f"<body>{PARAGRAPHS}<ul><li>A point.</li></ul><div class='x'>Teaser</div></body>"
    assert htmltext.main_text(page) == " ".join([*STORY, "A point."])


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "x. y, z", "<" * 20_000, "<a " * 20_000, "<!--" * 20_000, "<p><" * 20_000, "<div class='a" * 20_000, "<b x=\"" * 20_000])
def test_odd_pages_are_read_in_linear_time(page):
    start = time.perf_counter()
    htmltext.main_text(page)
    assert time.perf_counter() - start < 3


class Plain(HTMLParser):
    """Elements and texts of a well-formed page: one dictionary per element, texts with their elements."""

    def __init__(self):
        super().__init__()
        self.stack, self.elements, self.texts, self.link, self.piece, self.linked = [], [], [], False, "", 0

    def flush(self):
        if text := " ".join(self.piece.split()):
            self.texts.append((list(self.stack), text, self.linked))
        self.piece, self.linked = "", 0

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.link = True
            return
        self.flush()
        self.elements.append({"tag": tag, "attrs": dict(attrs), "n": len(self.elements)})
        self.stack.append(self.elements[-1])

    def handle_endtag(self, tag):
        if tag == "a":
            self.link = False
            return
        self.flush()
        self.stack.pop()

    def handle_data(self, data):
        self.piece += data
        self.linked += len(data) if self.link else 0


def plain_text(page):
    read = Plain()
    read.feed(page)
    read.close()
    structural = lambda e: e["tag"] in htmltext.NOISE_TAGS or "hidden" in e["attrs"]
    words = lambda e: [x for a in ("class", "id") for x in e["attrs"].get(a, "").split()]

    def share(e):
        if any(w in htmltext.NOISE_WORDS for w in words(e)):
            return 0.8
        return 0.5 if any(p in htmltext.NOISE_WORDS for w in words(e) for p in w.replace("_", "-").split("-")) else None

    usable = [(s, t) for s, t, _ in read.texts if not any(map(structural, s))]
    whole = sum(len(t) for _, t in usable)
    held = lambda e: sum(len(t) for s, t in usable if e in s)
    noisy = lambda e: structural(e) or e["tag"] not in ("html", "body", "article", "main") and (m := share(e)) is not None and held(e) <= m * whole
    rows = []
    for stack, text, linked in read.texts:
        path = tuple((e["tag"], e["attrs"].get("class", "")) for e in stack)
        rows.append((path, not any(map(noisy, stack)), text, min(linked, len(text)), stack[-2]["n"] if len(stack) > 1 else -1))
    groups = defaultdict(list)
    for row in rows:
        groups[row[:2]].append(row)
    signs = lambda t: len(htmltext.PUNCTUATION.findall(t))
    ratio = {g: ((sum(len(r[2]) for r in own) / len(own), sum(signs(r[2]) for r in own) / len(own)) if g[1] else (0.0, 0.0)) for g, own in groups.items()}

    def near(k, part):
        weights = [(math.exp(-(d * d) / 2), k + d) for d in range(-2, 3) if 0 <= k + d < len(rows)]
        return sum(w * ratio[rows[j][:2]][part] for w, j in weights) / sum(w for w, _ in weights)

    fused = {}
    for g, own in groups.items():
        mean = sum(math.sqrt(near(k, 0) * (1 + near(k, 1))) for k, r in enumerate(rows) if r[:2] == g) / len(own)
        fused[g] = mean * math.sqrt(ratio[g][0] * (1 + ratio[g][1])) * (1 - sum(r[3] for r in own) / sum(len(r[2]) for r in own))
    values = [fused[r[:2]] for r in rows]
    mean = sum(values) / len(values)
    limit = 0.3 * math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))
    few = {g: sum(r[3] for r in own) <= 0.5 * sum(len(r[2]) for r in own) for g, own in groups.items()}
    content = {g for g in groups if g[1] and fused[g] > 0 and fused[g] >= limit and few[g]}
    holders = {g[0][:-1] for g in content}

    def brought(path):
        for k in range(len(path) + 1):
            if path[:k] in holders:
                below = [t for t, _ in path[k:]]
                root = k == 0 or path[k - 1][0] in ("html", "body")
                if all(t in htmltext.LISTS for t in below) if root else "article" not in below:
                    return True
        return False

    listed = lambda r: sum(x[3] for x in rows if x[4] == r[4]) <= 0.5 * sum(len(x[2]) for x in rows if x[4] == r[4])
    return " ".join(r[2] for r in rows if r[:2] in content or r[1] and listed(r) and brought(r[0]))


def random_page(rnd):
    sentence = lambda n: " ".join(rnd.choice(["word", "longer-word", "a", "text,", "end."]) for _ in range(n))
    names = ["", "", "", ' class="post"', ' class="has-sidebar"', ' class="comments"', ' id="notice"', ' class="x y"', " hidden", ' data-id="promo"', ' style="overflow:hidden"']

    def node(depth):
        kind = rnd.random()
        if depth > 4 or kind < 0.35:
            return f"<p>{sentence(rnd.randrange(1, 40))}</p>"
        if kind < 0.45:
            return "<ul>" + "".join(f'<li>{"<a>" + sentence(4) + "</a>" if rnd.random() < 0.5 else sentence(5)}</li>' for _ in range(rnd.randrange(1, 5))) + "</ul>"
        if kind < 0.52:
            return f"<blockquote><p>{sentence(8)}</p></blockquote><h2>{sentence(3)}</h2>"
        tag = rnd.choice(["div", "div", "section", "article", "nav", "aside", "main"])
        return f"<{tag}{rnd.choice(names)}>" + "".join(node(depth + 1) for _ in range(rnd.randrange(1, 6))) + f"</{tag}>"

    return "<html><body>" + "".join(node(0) for _ in range(rnd.randrange(1, 7))) + "</body></html>"


def test_plain_version():
    rnd = random.Random(2)
    filled = 0
    for _ in range(400):
        page = random_page(rnd)
        assert htmltext.main_text(page) == plain_text(page), page
        filled += bool(plain_text(page))
    assert filled > 300
