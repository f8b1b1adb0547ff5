"""Tokens, sentences and overlap measures as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner import lexicons as L
from gleaner.functions.text import count_matches, let, strip


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def tokens(c: Column, stop: Sequence[str] = (), min_chars: int = 2) -> Column:
    """Lower-case ASCII words without stop words, in order, repeats kept."""
    keep = lambda t: (F.length(t) >= min_chars) & ~t.isin(*stop) if stop else F.length(t) >= min_chars
    return F.filter(words(c), keep)


def stem(t: Column) -> Column:
    n = F.length(t)
    return (F.when(t.endswith("ies") & (n > 4), F.concat(F.substring(t, F.lit(1), n - 3), F.lit("y")))
            .when(t.endswith("es") & (n > 3), F.substring(t, F.lit(1), n - 2))
            .when(t.endswith("s") & ~t.endswith("ss") & (n > 3), F.substring(t, F.lit(1), n - 1))
            .when(t.endswith("ing") & (n > 4), F.substring(t, F.lit(1), n - 3)).otherwise(t))


def rerank_tokens(c: Column) -> Column:
    return F.transform(tokens(c, L.RERANK_STOP), stem)


def long_tokens(c: Column) -> Column:
    """Distinct ASCII words of three letters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]{3,}"), F.lit(0)))


def word_set(c: Column, min_chars: int = 3) -> Column:
    """Distinct words after punctuation became blanks (letters of any script)."""
    clean = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", " ")
    return F.array_distinct(F.filter(F.split(clean, r"\s+"), lambda w: F.length(w) >= min_chars))


def simple_sentences(c: Column) -> Column:
    """Split after . ! ? followed by blanks; the marker keeps the punctuation without look-behind."""
    marked = F.regexp_replace(c, r"([.!?])\s+", "$1\x01")
    return F.filter(F.transform(F.split(marked, "\x01"), strip), lambda s: s != "")


def chunk_sentences(c: Column) -> Column:
    """Split before a capital, quote or bracket after . ! ?, and at blank lines; a single piece falls back to paragraphs."""
    text = strip(c)
    marked = F.regexp_replace(text, r"([.!?])\s+([A-Z\"'(])", "$1\x01$2")
    marked = F.regexp_replace(marked, r"\n\s*\n", "\n\x01")
    parts = F.filter(F.transform(F.split(marked, "\x01"), strip), lambda s: s != "")
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n+"), strip), lambda s: s != "")
    return let(parts, lambda found: F.when((F.size(found) <= 1) & (F.size(paragraphs) > 1), paragraphs).otherwise(found))


def overlap_coefficient(a: Column, b: Column) -> Column:
    small = F.least(F.size(a), F.size(b))
    return F.when(small > 0, F.size(F.array_intersect(a, b)) / small).otherwise(F.lit(0.0))


def word_count(c: Column) -> Column:
    return count_matches(c, r"\S+")
