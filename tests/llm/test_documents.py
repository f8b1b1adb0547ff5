"""Deduplication, extraction, quality, language model and fingerprints against brute force."""

import hashlib
import re
import zlib
from collections import Counter
from math import isclose, log10

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.llm import fingerprints, htmltext, lm, ngramjoin, quality, suffixes, wordhash

LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


@given(st.text())
def test_words(text):
    words = split(text)
    assert len(wordhash.words(text)) == len(words)
    assert len(set(wordhash.words(text).tolist())) == len(set(words))


def test_difference_cover():
    for prime in (2, 3, 5, 7, 11):
        cover, period = suffixes.difference_cover(prime).tolist(), prime * prime + prime + 1
        assert len(cover) == prime + 1
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def brute_removed(texts, length):
    seen = Counter()
    for t in texts:
        seen.update(t[k : k + length] for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        mark = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                mark[k : k + length] = True
        rest = np.frombuffer(t, np.uint8)[~mark].tobytes()
        runs = int((np.diff(np.append(0, mark.astype(int))) == 1).sum())
        out.append((len(t), int(mark.sum()), runs, hashlib.sha256(rest).hexdigest()))
    return out


@pytest.mark.parametrize("length, prime", [(200, 11), (40, 5)])
def test_repeated_strings(docs, nothing, corpus, length, prime):
    texts = [(t or "").encode() for _, t in corpus]
    found = suffixes.repeated_spans(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), length, prime)
    got = []
    for r in found.collect():
        data = r.text.encode()
        rest, runs = suffixes._rest(data, r.spans, r.copies, length)
        got.append((r.doc_id, len(data), len(data) - len(rest), runs, hashlib.sha256(rest).hexdigest()))
    assert Counter(got) == Counter((i, *x) for (i, _), x in zip(corpus, brute_removed(texts, length)))
    if length == 200:
        assert Counter(map(tuple, suffixes.removed(docs).collect())) == Counter(got)
        assert suffixes.removed(nothing).count() == 0


def test_cleaned_keeps_columns(docs):
    out = suffixes.cleaned(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == docs.count()
    assert all((r.text is None) == (r.n_chars is None) and (r.text is None or len(r.text) == r.n_chars) for r in rows)


def brute_classes(corpus, width, percent):
    sets = []
    for _, t in corpus:
        w = split(t)
        sets.append(frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    group = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common) and group[a] != group[b]:
                old = group[a]
                group = [group[b] if g == old else g for g in group]
    out = []
    for k, (i, _) in enumerate(corpus):
        ids = [corpus[j][0] for j in range(len(sets)) if group[j] == group[k] and corpus[j][0] is not None]
        out.append((i, len(sets[k]), min(ids) if ids else i))
    return out


@pytest.mark.parametrize("width, percent", [(4, 85), (5, 80), (2, 50)])
def test_ngram_classes(docs, nothing, corpus, width, percent):
    assert Counter(map(tuple, ngramjoin.classes(docs, width, percent).collect())) == Counter(brute_classes(corpus, width, percent))
    if width == 4:
        assert ngramjoin.classes(nothing).count() == 0
        kept = ngramjoin.representatives(docs)
        assert kept.columns == docs.columns
        groups = {(c if c is not None else "none") for _, _, c in brute_classes(corpus, 4, 85)}
        assert len({r.doc_id if r.doc_id is not None else "none" for r in kept.collect()}) == len(groups)


def test_signatures_meet(monkeypatch):
    monkeypatch.setattr(ngramjoin, "FREQUENT", 3)
    rng = np.random.default_rng(0)
    pairs = 0
    for _ in range(1500):
        base = rng.choice(1 << 40, size=int(rng.integers(1, 300)), replace=False).astype(np.uint64)
        often = {int(x): int(n) for x, n in zip(base, rng.integers(1, 9, len(base)))}

        def variant():
            cut = int(rng.integers(0, int(len(base) * 0.09) + 1))
            more = rng.choice(1 << 40, size=int(rng.integers(0, cut + 1)), replace=False).astype(np.uint64)
            often.update({int(x): int(rng.integers(1, 3)) for x in more if int(x) not in often})
            return np.unique(np.concatenate([rng.permutation(base)[: len(base) - cut], more]))

        a, b = variant(), variant()
        both = np.intersect1d(a, b)
        if not len(both) or 100 * len(both) < 85 * (len(a) + len(b) - len(both)):
            continue
        often.update({int(x): max(2, often[int(x)]) for x in both})
        signs = []
        for own in (a, b):
            n = np.array([often[int(x)] for x in own])
            signs.append((len(own), int((n > 1).sum()), *ngramjoin.signatures(own[n > 1], n[n > 1], len(own), 85)))
        (size_a, all_a, one, at), (size_b, all_b, two, to) = signs
        _, i, j = np.intersect1d(one, two, return_indices=True)
        most = np.minimum(all_a - at[i], all_b - to[j])
        assert (100 * most >= 85 * (size_a + size_b - most)).any()
        pairs += 1
    assert pairs > 500


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p><p>no</p>";</script></head><body>
<header class="site"><h1>Site name</h1></header><nav><ul><li><a href="/a">A long menu entry, really</a></li></ul></nav><!-- <p>no</p> -->
<div class="ad">Buy this, buy that, buy all of it now!</div><div class="post"><h2>Caf&eacute; &amp; more</h2>
<p>First paragraph, with   <b>bold</b> text<br>and a line; it has signs, and length enough.<p>Second one, unclosed. It goes on, and on, and on.</p><p>Short.</p>
<div id="comments"><p>A reader says, at length, that this is fine. Very fine, indeed, is it not?</p></div></div>
<aside><p>Something else, of no interest. Nothing to see, here.</p></aside><form>Name: <input></form><div class="cookie-notice">We use cookies, please agree.</div>
<footer>&copy; someone &am"""


def test_main_text(spark):
    text = "Café & more First paragraph, with bold text and a line; it has signs, and length enough. Second one, unclosed. It goes on, and on, and on. Short."
    assert htmltext.main_text(PAGE) == text
    for page, want in [("", ""), ("only text &lt; here", "only text < here"), ("<p>a<p>b", "a b"), ("<script>x</script>", ""), ("<p unclosed='", ""), ("<div>x<div>y</div>z</div>", "x y z")]:
        assert htmltext.main_text(page) == want
    rows = [(1, "u", PAGE, "x"), (None, None, None, "x"), (2, "u", "", "x"), (2, "u", "", "x"), (3, "v", "<p>long. " * 20000, "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {(r.page_id, r.url, r.text[:40], r.n_chars) for r in htmltext.extract(frame).collect()}
    assert got == {(1, "u", text[:40], len(text)), (None, None, "", 0), (2, "u", "", 0), (3, "v", ("long. " * 9)[:40], 20000 * 6 - 1)}
    assert htmltext.extract(frame).count() == 5 and htmltext.extract(frame.limit(0)).count() == 0


def test_main_text_beside_teaser_articles():
    body = [f"Paragraph {k} of the story, which is long; it goes on, and on, with signs, clauses, and detail enough. It ends here, at last." for k in range(6)]
    teasers = [f"Teaser {k}, of another story, in one line. Read on, there." for k in range(3)]
    cards = "".join(f"<article><p>{t}</p></article>" for t in teasers)
    for tag in ('div class="post"', "main", "section"):
        story = f"<{tag}>" + "".join(f"<p>{t}</p>" for t in body) + f"</{tag.split()[0]}>"
        for page in (f"<html><body>{story}{cards}</body></html>", f"<html><body>{cards}{story}</body></html>"):
            text = htmltext.main_text(page)
            assert all(t in text for t in body)
    # a short line of the article stays, a list of links in it does not
    links = "<ul>" + "".join(f'<li><a href="/{k}">Another headline, number {k}</a></li>' for k in range(5)) + "</ul>"
    page = "<html><body><article>" + "".join(f"<p>{t}</p>" for t in [*body, "Short."]) + links + "</article></body></html>"
    assert htmltext.main_text(page) == " ".join([*body, "Short."])


def test_quality(spark, docs, nothing, corpus):
    rows = [(k, "good words in a row, and more of them here" if k % 2 else "BAD!! BAD!! THING!! HERE!! " * 3, k % 2) for k in range(200)] + [(900, None, None), (901, "", None)]
    own = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = own.select("doc_id", "quality", F.lit(0).alias("toxic")).unionByName(own.limit(0).select("doc_id", "quality", F.lit(1).alias("toxic")))
    out = {r.doc_id: r for r in quality.quality_scores(spark, own, labels).collect()}
    assert len(out) == len(rows)
    assert all(out[k].predicted == q for k, _, q in rows if q is not None)
    assert all(out[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= out[k].score <= 1 for k in out)
    assert out[900].score == out[901].score
    kept = quality.accepted(own, labels).collect()
    assert {r.doc_id for r in kept} >= {k for k, _, q in rows if q} and not {r.doc_id for r in kept} & {k for k, _, q in rows if q == 0}
    none = quality.quality_scores(spark, docs.select("doc_id", "text"), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5} and len(none) == len(corpus)
    assert quality.quality_scores(spark, nothing, labels).count() == 0


@given(st.lists(st.integers(0, 5000) | st.integers(0, 2**50), max_size=80), st.lists(st.integers(0, 5000) | st.integers(0, 2**50), max_size=20))
@settings(deadline=None)
def test_elias_fano(values, keys):
    values = np.array(sorted(values), np.uint64)
    own = lm.EliasFano(lm.EliasFano.pack(values))
    assert own.get(np.arange(len(values))).tolist() == values.tolist()
    assert own.successor(np.array(keys, np.uint64)).tolist() == np.searchsorted(values, np.array(keys, np.uint64)).tolist()


def test_trie_of_mapped_files(tmp_path):
    rng = np.random.default_rng(1)
    pairs = np.unique(rng.integers(0, 500, 3000).astype(np.uint64) << np.uint64(24) | rng.integers(0, 40, 3000).astype(np.uint64))
    counts = rng.integers(1, 100000, len(pairs))
    for k, level in enumerate(lm.Trie.pack(pairs, counts)):
        (tmp_path / str(k)).write_bytes(level)
    trie = lm.Trie([np.memmap(tmp_path / str(k), np.uint8, "r") for k in range(4)])
    asked = np.concatenate([pairs, pairs + np.uint64(1), np.array([0, 2**47], np.uint64)])
    known = dict(zip(pairs.tolist(), counts.tolist()))
    for pair, value in zip(asked.tolist(), lm.CODES[trie.find(asked)].tolist()):
        assert isclose(value, known.get(pair, 0), rel_tol=0.06)


def test_trie_counts_have_no_ceiling():
    counts = np.array([5, 127, 128, 9, 2**22, 2**23, 2**23 + 12345, 7, 2**31, 2**40])
    pairs = np.arange(len(counts), dtype=np.uint64) * np.uint64(3) + (np.uint64(7) << np.uint64(24))
    trie = lm.Trie([np.frombuffer(level, np.uint8) for level in lm.Trie.pack(pairs, counts)])
    order = np.array([9, 0, 6, 6, 8, 3, 5, 4, 1, 2, 7])
    asked = np.insert(pairs[order], 4, pairs[0] + np.uint64(1))
    want = np.insert(counts[order], 4, 0)
    got = lm.decoded(trie.answer(asked), len(asked))
    assert all(isclose(g, w, rel_tol=0.05) for g, w in zip(got.tolist(), want.tolist()))
    assert got[want >= 2**23].tolist() == want[want >= 2**23].tolist()
    assert lm.decoded(lm.Trie(lm.Trie.pack(pairs[:0], counts[:0])).answer(pairs), len(pairs)).tolist() == [0] * len(pairs)


def test_lm_scores(docs, nothing, corpus):
    tokens = [(i, i is None or zlib.crc32(str(i).encode()) % 10 == 0, [*split(t), None]) for i, t in corpus]
    count = Counter(w for _, held, ws in tokens if not held for w in ws)
    total, distinct = sum(count.values()), len(count)
    pairs = Counter(p for _, held, ws in tokens if not held for p in zip([0, *ws], ws))
    contexts = Counter(v for _, held, ws in tokens if not held for v in [0, *ws[:-1]])
    level = lambda n: int(np.ceil(np.log2(n + 1)))
    kinds, sums = Counter(), Counter()
    for (v, _), n in pairs.items():
        kinds[level(contexts[v])] += 1
        sums[level(contexts[v])] += n
    want = []
    for i, held, ws in tokens:
        base = [(count[w] + 0.1) / (total + 0.1 * (distinct + 1)) for w in ws]
        mixed = 0.0
        for v, w, b in zip([0, *ws], ws, base):
            k = level(contexts[v])
            loose = kinds[k] / (kinds[k] + sums[k]) if contexts[v] else 1.0
            mixed += log10((1 - loose) * pairs[v, w] / max(1, contexts[v]) + loose * b)
        want.append((i, held, len(ws), sum(count[w] > 0 for w in ws), total, sum(map(log10, base)), mixed))
    got = [tuple(r) for r in lm.scores(docs).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and isclose(a[5], b[5], rel_tol=1e-9) and isclose(a[6], b[6], rel_tol=0.02)
    assert lm.scores(nothing).count() == 0


def test_fingerprints(docs, nothing, corpus):
    out = fingerprints.compared(docs).collect()
    order = sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [t or "" for _, t in order]
    edited = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for t, n in zip(texts, texts[1:] + texts[:1])]
    want = Counter((i, len(t), hashlib.sha256(e.encode()).hexdigest()) for (i, _), t, e in zip(order, texts, edited))
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in out) == want
    of = {}
    for r, t in zip(sorted(out, key=lambda r: r.edited_sha256), sorted(zip(texts, edited), key=lambda x: hashlib.sha256(x[1].encode()).hexdigest())):
        of.setdefault(t[0], set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in of.values()) and all(len(r.fingerprint) == 256 for r in out)
    true = {}
    for t, e in zip(texts, edited):
        a, b = (Counter(x for x in re.split("[\t-\r ]+", y.lower()) if x) for y in (t, e))
        true[hashlib.sha256(e.encode()).hexdigest(), len(t)] = sum((a & b).values()) / max(1, sum((a | b).values())) if a or b else 1.0
    errors = [r.near_edited - true[r.edited_sha256, r.n_chars] for r in out]
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.09
    assert fingerprints.compared(nothing).count() == 0
    one = fingerprints.compared(docs.where("doc_id = 40")).collect()
    assert [r.near_next for r in one] == [1.0] and one[0].near_edited > 0.3
