"""Phrase collocations from stripes: each prefix keys an associative counter of the words that follow it.

1.  Stripes are made where the texts are, for a few megabytes at a time, and packed: a row is a language, a prefix, and the
    words that follow with their counts; the end of a piece is a following word too (null), so that a stripe's total is
    its prefix's count.  A stripe is cut in ``SEGMENTS`` by a hash of the following word, so that one word with a third of
    all text is many rows in many tasks.
2.  Merging is elementwise: rows meet by (language, prefix, segment), are unfolded and summed there without a further
    shuffle.  From the merged stripes come the extensions (entries of ``LEAST`` and more), the totals, and the largest
    entry of each, by which a phrase may be subsumed.
3.  Every word pair of a candidate is a candidate.  So the first pass makes stripes of single words only; the second one,
    of two- and three-word prefixes, follows windows whose pairs are all candidates.  A task looks them up in a bit field
    with a bit for each candidate's hash: false hits cost a row in the shuffle and no more, counts stay exact.  Its size
    follows the candidates up to ``MOST_BITS``, which bounds what is broadcast.
4.  Scores are joined to the cuts of candidates; a product is a 38-digit decimal, so nothing overflows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.llm import wordhash as H
from gleaner.llm.common import slices, stored
from gleaner.llm.registry import query
from gleaner.sources.tables import table

LEAST, BEST, COVER_PERCENT, SCALE, WORDS = 30, 2000, 80, 2_000_000, 4
SEGMENTS = 16
FEWEST_BITS, MOST_BITS, BLOCK = 20, 28, 20
SLICE_CHARS = 16_000_000
BREAKS = b".,;:!?\n\x0b\x0c\r"
TOKEN = re.compile(rb"[^ \t.,;:!?\n-\r]+|[.,;:!?\n-\r]+")
STRIPE = "lang string, prefix string, segment int, nexts array<string>, counts array<long>"


def _numbered(texts: list[str]) -> tuple[np.ndarray, list[bytes]]:
    """The words of all texts as numbers, -1 at the end of each piece; and the words."""
    tokens: list[bytes] = []
    for text in texts:
        tokens += TOKEN.findall(text.encode().lower())  # bytes: A-Z only
        tokens.append(b"\n")
    codes: dict[bytes, int] = {}
    ids = np.array([codes.setdefault(t, len(codes)) for t in tokens], np.int64)
    word = np.array([t[0] not in BREAKS for t in codes])
    number = np.where(word, np.cumsum(word) - 1, -1)
    return number[ids], [t for t, w in zip(codes, word) if w]


def _hashes(lang: str, words: list[bytes]) -> np.ndarray:
    head = lang.encode() + b"\0"
    return np.array([xxhash.xxh64_intdigest(head + w) for w in words], np.uint64)


def _place(first: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
    """Places of word pairs in a field of 2**bits, from the hashes of their words."""
    return (H.mixed(first * H.BASE + second) >> np.uint64(64 - bits)).astype(np.int64)


def _stripes(lang: str, prefixes: list[bytes], words: list[bytes], prefix: np.ndarray, following: np.ndarray) -> pa.RecordBatch:
    """Rows of ``STRIPE`` from one (prefix, following word, -1 for an end) for each place."""
    n = len(words) + 1
    keys, counts = np.unique(prefix * n + following + 1, return_counts=True)
    prefix, following = keys // n, keys % n - 1
    own = np.array([xxhash.xxh32_intdigest(w) % SEGMENTS for w in words] + [0], np.int64)[following]
    order = np.lexsort((own, prefix))
    prefix, following, own, counts = (x[order] for x in (prefix, following, own, counts))
    begins = np.flatnonzero(np.append(True, (prefix[1:] != prefix[:-1]) | (own[1:] != own[:-1])))
    offsets = pa.array(np.append(begins, len(prefix)).astype(np.int32))
    nexts = pa.array([w.decode() for w in words] + [None], pa.string()).take(pa.array(following % n))
    columns = [pa.array([lang] * len(begins), pa.string()), pa.array([p.decode() for p in prefixes], pa.string()).take(pa.array(prefix[begins])),
               pa.array(own[begins].astype(np.int32)), pa.ListArray.from_arrays(offsets, nexts), pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int64)))]
    return pa.RecordBatch.from_arrays(columns, ["lang", "prefix", "segment", "nexts", "counts"])


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, list[str]]]:
    langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    for a, b in slices(texts, SLICE_CHARS):
        groups: dict[str, list[str]] = {}
        for lang, text in zip(langs[a:b], texts[a:b]):
            groups.setdefault(lang, []).append(text)
        yield from groups.items()


def word_stripes(docs: DataFrame) -> DataFrame:
    """Stripes of single words, from (lang, text) without nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, texts in _by_lang(batch):
                ids, words = _numbered(texts)
                at = np.flatnonzero(ids >= 0)
                if len(at):
                    yield _stripes(lang, words, words, ids[at], ids[at + 1])

    return docs.mapInArrow(run, STRIPE)


def phrase_stripes(docs: DataFrame, field: bytes) -> DataFrame:
    """Stripes of two- and three-word prefixes, where all word pairs are in the bit field."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(shared.value, np.uint8)
        bits = int(np.log2(8 * len(known)))
        for batch in batches:
            for lang, texts in _by_lang(batch):
                ids, words = _numbered(texts)
                n = len(words)
                pairs, which = np.unique(np.where((ids[:-1] >= 0) & (ids[1:] >= 0), ids[:-1] * n + ids[1:], -1), return_inverse=True)
                if not n or pairs[-1] < 0:
                    continue
                hashes = _hashes(lang, words)
                first, second = pairs // n, pairs % n
                place = _place(hashes[first], hashes[second], bits)
                good = ((known[place >> 3] >> (place & 7)) & 1).astype(bool) & (pairs >= 0)
                chain = good[which]
                names: list[bytes] = []
                ends = ids[1:]  # of the pair at a place
                number, alive = which, chain
                for length in range(2, WORDS):
                    # alive[k]: the phrase of this length at k consists of candidates; number: its number
                    alive = alive[:-1] & chain[length - 1 :]
                    at = np.flatnonzero(alive)
                    if not len(at):
                        break
                    used, own = np.unique(number[at], return_inverse=True)
                    names = [words[first[p]] + b" " + words[second[p]] for p in used] if length == 2 else [names[u // n] + b" " + words[u % n] for u in longer[used]]
                    following = ends[at + length - 1]
                    yield _stripes(lang, names, words, own, following)
                    longer, inverse = np.unique(own * n + following, return_inverse=True)
                    number = np.full(len(alive), -1)
                    number[at] = inverse

    return docs.mapInArrow(run, STRIPE)


def merged(stripes: DataFrame, least: int) -> DataFrame:
    """(lang, prefix, segment, total, entries array<struct<next, f>>): sums, with the entries of ``least`` and more."""
    dealt = stripes.repartition("lang", "prefix", "segment")
    unfolded = dealt.select("lang", "prefix", "segment", F.inline(F.arrays_zip("nexts", "counts"))).toDF("lang", "prefix", "segment", "next", "count")
    summed = unfolded.groupBy("lang", "prefix", "segment", "next").agg(F.sum("count").alias("f"))
    entry = F.when(F.col("next").isNotNull() & (F.col("f") >= least), F.struct("next", "f"))
    return summed.groupBy("lang", "prefix", "segment").agg(F.sum("f").alias("total"), F.collect_list(entry).alias("entries"))


def bit_field(pairs: DataFrame) -> bytes:
    """A field of bits with one for each (lang, prefix, next); 2**FEWEST_BITS to 2**MOST_BITS bits, 16 a pair if they do."""
    bits = min(MOST_BITS, max(FEWEST_BITS, int(np.ceil(np.log2(16 * pairs.count() + 1)))))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, first, second = (c.to_pylist() for c in batch.columns)
            one, two = (np.array([xxhash.xxh64_intdigest(f"{lang}\0{w}".encode()) for lang, w in zip(langs, c)], np.uint64) for c in (first, second))
            yield pa.RecordBatch.from_arrays([pa.array(_place(one, two, bits))], ["place"])

    def block(key: tuple, rows: pa.Table) -> pa.Table:
        marks = np.zeros(1 << min(BLOCK, bits), np.uint8)
        marks[rows.column("place").to_numpy() & (len(marks) - 1)] = 1
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "field": pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())})

    placed = pairs.select("lang", "prefix", "next").mapInArrow(places, "place long").distinct()
    rows = placed.withColumn("block", F.shiftright("place", min(BLOCK, bits))).groupBy("block").applyInArrow(block, "block long, field binary").collect()
    size = 1 << (min(BLOCK, bits) - 3)
    field = bytearray(1 << (bits - 3))
    for r in rows:
        field[r.block * size : (r.block + 1) * size] = r.field
    return bytes(field)


def collocations(docs: DataFrame, least: int = LEAST, best: int = BEST, cover: int = COVER_PERCENT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of two to four words of each language.

    Reads lang and text; other columns are not looked at.  A null lang is ``und``, a null text empty.  Phrases of equal
    score go by count, then by their UTF-8 bytes, so ranks are unique.  Repeated rows count as often as they are there.  A
    language without phrases of ``least`` occurrences, or an empty table, gives no rows."""
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words = stored(merged(word_stripes(rows), least), "op11-words")
    totals = words.groupBy("lang", "prefix").agg(F.sum("total").alias("f"))
    sizes = words.groupBy("lang").agg(F.sum("total").alias("n"))
    pairs = words.select("lang", "prefix", F.inline("entries"))
    phrases = stored(merged(phrase_stripes(rows, bit_field(pairs)), least).where(F.size("entries") > 0), "op11-phrases")

    entries = pairs.unionByName(phrases.select("lang", "prefix", F.inline("entries")))
    found = stored(entries.select("lang", F.concat_ws(" ", "prefix", "next").alias("phrase"), "prefix", F.col("f").alias("a")), "op11-candidates")
    counts = found.select("lang", "phrase", F.col("a").alias("f")).unionByName(totals.where(F.col("f") >= least).withColumnRenamed("prefix", "phrase"))

    parts = F.split("phrase", " ")
    cuts = found.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.concat_ws(" ", F.slice(parts, F.lit(1), F.col("k"))).alias("head"),
                       F.concat_ws(" ", F.slice(parts, F.col("k") + 1, F.size(parts))).alias("tail"))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    score = F.expr(f"(cast(a as decimal(20, 0)) * {SCALE}) div (cast(l as decimal(20, 0)) + r)")
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    # the largest extension to the right is the largest entry of the phrase's own stripe; to the left, of those it ends
    without_first = F.expr("substring(phrase, instr(phrase, ' ') + 1)")
    extended = found.select("lang", F.col("prefix").alias("phrase"), "a").unionByName(found.select("lang", without_first.alias("phrase"), "a"))
    largest = extended.groupBy("lang", "phrase").agg(F.max("a").alias("largest"))
    own = f"largest is null or cast(largest as decimal(20, 0)) * 100 < cast(a as decimal(20, 0)) * {cover}"
    kept = lowest.join(largest, ["lang", "phrase"], "left").where(own)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
counts AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM places, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
sizes AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
found AS (SELECT lang, k AS size, phrase, string_split(phrase, ' ') AS w, f AS a FROM counts WHERE k > 1 AND f >= 30),
cuts AS (
  SELECT c.lang, c.phrase, c.a, c.k, head.f AS l, tail.f AS r, ((2000000::HUGEINT * c.a) // (head.f + tail.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM found) c
  JOIN counts head ON head.lang = c.lang AND head.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN counts tail ON tail.lang = c.lang AND tail.phrase = array_to_string(c.w[c.k + 1:], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_phrases AS (
  SELECT DISTINCT lang, array_to_string(w[b:e], ' ') AS phrase, a
  FROM (SELECT lang, w, a, size, b, unnest(range(b + 1, size + 1)) AS e FROM (SELECT *, unnest(range(1, size)) AS b FROM found))
  WHERE e - b + 1 < size),
kept AS (
  SELECT * FROM lowest x WHERE NOT EXISTS (
    SELECT 1 FROM inner_phrases y WHERE y.lang = x.lang AND y.phrase = x.phrase AND 100::HUGEINT * y.a >= 80::HUGEINT * x.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""


@query("op11_collocations", SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))
