"""Collocations against brute force over whole phrases."""

import random
import re
from collections import Counter

import pytest

from gleaner.llm import collocations

LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def brute(rows, least, best, cover):
    counts = Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 5):
                counts.update((lang or "und" if lang is None else lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    sizes = Counter()
    for (lang, phrase), f in counts.items():
        if len(phrase) == 1:
            sizes[lang] += f
    found = {p: f for p, f in counts.items() if len(p[1]) > 1 and f >= least}
    dropped = set()
    for (lang, phrase), f in found.items():
        for i in range(len(phrase)):
            for j in range(i + 2, len(phrase) + 1):
                part = (lang, phrase[i:j])
                if j - i < len(phrase) and 100 * f >= cover * found[part]:
                    dropped.add(part)
    out = {}
    for (lang, phrase), a in found.items():
        if (lang, phrase) not in dropped:
            score, _, l, r = min((2_000_000 * a // (counts[lang, phrase[:k]] + counts[lang, phrase[k:]]), k, counts[lang, phrase[:k]], counts[lang, phrase[k:]]) for k in range(1, len(phrase)))
            out.setdefault(lang, []).append((-score, -a, " ".join(phrase).encode(), l, r))
    return sorted((lang, n, p.decode(), -a, l, r, sizes[lang], -s) for lang, own in out.items() for n, (s, a, p, l, r) in enumerate(sorted(own)[:best], 1))


def corpus():
    rnd = random.Random(11)
    words = [f"w{k}" for k in range(25)] + ["É", "é", "ß", "日本", "\U0001f642", "the", "THE", "\x1c"]
    fixed = ["new york city hall", "of the of the", "a a a a a", "É é, ß", "state of the art"]
    make = lambda: "".join(rnd.choice([rnd.choice(words), rnd.choice(fixed)]) + rnd.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\x0b"]) for _ in range(rnd.randrange(60)))
    rows = [(rnd.choice(["en", "de", None, "und", ""]), make()) for _ in range(150)]
    return rows + [("en", None), ("en", ""), ("en", " \t.,\n"), ("xx", "only once here"), ("en", "w1 w2 " * 9000), ("zz", "tie a. tie b. " * 12)]


@pytest.mark.parametrize("least, best, cover", [(4, 50, 80), (12, 2000, 60), (1, 400, 80)])
def test_collocations(spark, least, best, cover):
    rows = corpus()
    frame = spark.createDataFrame([(*r, "p", 1, [1]) for r in rows], "lang string, text string, prefix string, segment int, entries array<int>").repartition(5)
    got = sorted(tuple(r) for r in collocations.collocations(frame, least, best, cover).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == brute(rows, least, best, cover)
    assert collocations.collocations(frame.limit(0)).count() == 0


def test_products_beyond_64_bits(spark):
    a = 9 * 10**15
    found = spark.sql(f"SELECT (cast({a}L as decimal(20, 0)) * {collocations.SCALE}) div (cast({a + 7}L as decimal(20, 0)) + {a + 9}L) AS score").first().score
    assert found == 2_000_000 * a // (2 * a + 16)
