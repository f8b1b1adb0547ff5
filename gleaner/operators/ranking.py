"""Ranking: lexical, quality, recency and hybrid scores, search-result relevance, academic ranks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gleaner import lexicons as L
from gleaner.functions import text as T
from gleaner.functions import tokens as K
from gleaner.operators.counted import _spans
from gleaner.operators.overlap import Postings
from gleaner.operators.vectors import QUERY_NUMBERS, _unit, search, top_k
from gleaner.session import cut_lineage

K1, B, AVERAGE_LENGTH = 1.5, 0.75, 150.0


def saturation(tf: Column, length: Column, average=AVERAGE_LENGTH, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * (length / average)))


def query_weights(queries: DataFrame, query_id: str, text: str = "text") -> DataFrame:
    """(query_id, token, weight, query_tokens): repeats in the query count."""
    toks = queries.select(query_id, K.rerank_tokens(F.col(text)).alias("_t")).withColumn("query_tokens", F.size("_t"))
    return toks.select(query_id, "query_tokens", F.explode("_t").alias("token")).groupBy(query_id, "query_tokens", "token").agg(
        F.count(F.lit(1)).alias("weight"))


def token_counts(docs: DataFrame, doc: str, text: str = "text", wanted: DataFrame | None = None) -> DataFrame:
    """(doc, doc_length, token, tf); with ``wanted`` (token) only those tokens leave the scan."""
    toks = docs.select(doc, K.rerank_tokens(F.col(text)).alias("_t")).select(doc, F.size("_t").alias("doc_length"), F.explode("_t").alias("token"))
    if wanted is not None:
        toks = toks.join(wanted.select("token").distinct(), "token", "left_semi")
    return toks.groupBy(doc, "doc_length", "token").agg(F.count(F.lit(1)).alias("tf"))


def lexical_scores(docs: DataFrame, queries: DataFrame, doc: str, query_id: str, text: str = "text") -> DataFrame:
    """(query_id, doc, lexical) for all pairs with a shared token, where all are asked for; the best ones are
    ``postings.top_documents``, which makes no pairs.

    Term saturation without IDF.  Only query tokens survive the explode, counts combine before the shuffle, and the
    query side stays a plain equi-join whose strategy follows its measured size.
    """
    weights = query_weights(queries, query_id)
    counts = token_counts(docs, doc, text, weights)
    gain = F.sum(F.col("weight") * saturation(F.col("tf"), F.col("doc_length")))
    pairs = counts.join(weights, "token").groupBy(query_id, "query_tokens", doc).agg(gain.alias("_g"))
    score = F.col("_g") / (F.col("query_tokens") * (K1 + 1) + 1e-9)
    return pairs.select(query_id, doc, F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias("lexical"))


def lexical_column(query_tokens: Column, doc_tokens: Column) -> Column:
    """The lexical score of one row's query against the same row's text (candidate lists are short)."""
    def score(q: Column, d: Column) -> Column:
        def gain(t: Column) -> Column:
            tf = F.size(F.filter(d, lambda x: x == t))
            return F.when(tf > 0, saturation(tf, F.size(d))).otherwise(F.lit(0.0))

        total = F.aggregate(F.transform(q, gain), F.lit(0.0), lambda acc, x: acc + x)
        return F.when((F.size(q) == 0) | (F.size(d) == 0), F.lit(0.0)).otherwise(
            F.least(total / (F.size(q) * (K1 + 1) + 1e-9), F.lit(1.0)))

    return T.let(query_tokens, lambda q: T.let(doc_tokens, lambda d: score(q, d)))


def source_quality(url: Column, domain: Column, source_type: Column, credibility: Column | None = None) -> Column:
    url, domain, kind = (F.lower(F.coalesce(c, F.lit(""))) for c in (url, domain, source_type))
    either = lambda terms: T.contains_any(url, terms) | T.contains_any(domain, terms)
    rules = (F.when(kind.isin("academic", "paper", "journal"), 1.0).when(either(L.RERANK_LOW_QUALITY), 0.1)
             .when(either(L.RERANK_HIGH_AUTHORITY), 0.95).when(kind == "news", 0.75).when(kind == "company", 0.70)
             .when(url.startswith("https://"), 0.60).otherwise(0.50))
    return rules if credibility is None else F.coalesce(credibility.cast("double"), rules)


def recency(published: Column, as_of: Column, half_life_days: float = 730.0, default: float = 0.5) -> Column:
    """Exponential decay of a timestamp's age in days."""
    days = F.greatest((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(published.cast("timestamp"))) / 86400e6, F.lit(0.0))
    decay = F.exp(days * (-math.log(2) / half_life_days))
    return F.when(published.isNull(), default).otherwise(F.least(F.greatest(decay, F.lit(0.05)), F.lit(1.0)))


def hybrid(semantic: Column, lexical: Column, quality: Column, recent: Column, context: Column,
           weights=(0.40, 0.25, 0.15, 0.10, 0.10)) -> Column:
    total = sum(weights)
    parts = (F.greatest(F.least(semantic, F.lit(1.0)), F.lit(0.0)), lexical, quality, recent, context)
    return F.round(reduce(lambda a, b: a + b, [p * (w / total) for p, w in zip(parts, weights)]), 4)


def rerank(candidates: DataFrame, query_id: str, doc: str, as_of: Column, context: Column | None = None, k: int = 5,
           weights=(0.40, 0.25, 0.15, 0.10, 0.10)) -> DataFrame:
    """Hybrid top-k with its breakdown.  Candidates: query text, content, url, domain, source_type, published_at, semantic."""
    q, d = K.rerank_tokens(F.col("query")), K.rerank_tokens(F.col("content"))
    aligned = F.lit(0.5) if context is None else F.when(F.coalesce(T.strip(context), F.lit("")) == "", 0.5).otherwise(
        lexical_column(K.rerank_tokens(context), d))
    parts = candidates.select(
        query_id, doc, F.col("semantic"), lexical_column(q, d).alias("lexical"),
        source_quality(F.col("url"), F.col("domain"), F.col("source_type")).alias("quality"),
        recency(T.parse_date(F.col("published_at")), as_of).alias("recency"), aligned.alias("context"))
    scored = parts.withColumn("hybrid", hybrid(*[F.col(c) for c in ("semantic", "lexical", "quality", "recency", "context")], weights))
    return top_k(scored, query_id, [F.desc("hybrid"), F.asc(doc)], k)


def retrieve(chunks: DataFrame, queries: DataFrame, doc: str, query_id: str, as_of: Column, k: int = 5) -> DataFrame:
    """Two stages: max(3k, 10) neighbours by vector, then the hybrid top-k of those."""
    near = search(chunks, queries, max(3 * k, 10), vec_id=doc, query_id=query_id, min_score=-1.0)
    joined = (near.select(query_id, doc, F.col("score").alias("semantic"))
              .join(queries.select(query_id, F.col("text").alias("query")), query_id).join(chunks.drop("embedding"), doc))
    return rerank(joined, query_id, doc, as_of, k=k)


def context_blocks(ranked: DataFrame, query_id: str) -> DataFrame:
    """One numbered context text per query from ranked rows (rank, title, section, page, content)."""
    place = F.concat(F.lit("Section: "), F.coalesce("section", F.lit("Body")),
                     F.coalesce(F.concat(F.lit(", Page: "), F.col("page").cast("string")), F.lit("")))
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] Title: "), F.coalesce("title", F.lit("Source Document")),
                     F.lit(" ("), place, F.lit(")\nText: "), T.strip(F.col("content")))
    ordered = F.array_sort(F.collect_list(F.struct("rank", block.alias("b"))))
    return ranked.groupBy(query_id).agg(F.array_join(F.transform(ordered, lambda x: x["b"]), "\n\n").alias("context"),
                                        F.count(F.lit(1)).alias("citations"))


def search_domain_score(url: Column) -> Column:
    url = F.lower(url)
    return (F.when(T.contains_any(url, L.SEARCH_LOW_QUALITY), 0.0).when(T.contains_any(url, L.SEARCH_HIGH_AUTHORITY), 1.0)
            .when(url.contains("wikipedia.org"), 0.75).when(url.startswith("https://"), 0.5).otherwise(0.3))


def result_relevance(query: Column, title: Column, snippet: Column, url: Column) -> Column:
    """Spam scores 0; else weighted token recall in title and snippet, snippet length and domain."""
    q = K.tokens(query, L.RANKER_STOP)

    def recall(c: Column) -> Column:
        return T.let(F.array_distinct(K.tokens(c, L.RANKER_STOP)), lambda have: T.let(q, lambda want: F.when(
            F.size(want) > 0, F.size(F.filter(want, lambda t: F.array_contains(have, t))) / F.size(want)).otherwise(F.lit(0.0))))

    score = (0.40 * recall(title) + 0.35 * recall(snippet) + 0.10 * F.least(F.length(snippet) / 300.0, F.lit(1.0))
             + 0.15 * search_domain_score(url))
    return F.when(F.concat_ws(" ", title, snippet).rlike(L.SPAM_PATTERN), 0.0).otherwise(F.round(F.least(score, F.lit(1.0)), 4))


def academic_rank(abstract: Column, pdf_url: Column, year: Column, citations: Column) -> Column:
    return (F.when(F.length(abstract) > 100, 0.5).otherwise(0.0) + F.when(F.coalesce(pdf_url, F.lit("")) != "", 0.3).otherwise(0.0)
            + F.coalesce(F.least(F.lit(0.2), year.try_cast("int") / 20000), F.lit(0.0))
            + F.least(F.lit(0.1), F.coalesce(citations, F.lit(0)) / 10000))


def academic_credibility(doi: Column, citations: Column, abstract: Column, database: Column) -> Column:
    def add(score: Column, test: Column, value) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), F.least(F.lit(1.0), score + value)).otherwise(score)

    score = add(F.lit(0.90), doi != "", F.lit(0.03))
    score = add(score, citations > 0, F.least(F.lit(0.05), citations / 2000))
    score = add(score, F.length(abstract) > 100, F.lit(0.01))
    return F.round(add(score, database.isin(*L.PEER_DATABASES), F.lit(0.01)), 4)


def recall_prior(records: DataFrame, queries: DataFrame, record_id: str, query_id: str, k: int = 3, minimum: float = 0.35) -> DataFrame:
    """(query_id, record_id, relevance, rank): earlier runs like a query, .70 cosine + .30 token Jaccard, at least ``minimum``, best k.

    Queries travel in blocks as in ``vectors.search``; each block is one pass over the records, whose tasks compare vectors and
    token sets of a batch with all queries at once and keep k rows per query.  No (query, record) pair is listed."""
    tokens = lambda: F.array_distinct(F.transform(K.rerank_tokens(F.col("text")), lambda t: F.xxhash64(t)))
    fields = [F.col("embedding").cast("array<double>").alias("_v"), F.coalesce(tokens(), F.array().cast("array<bigint>")).alias("_t")]
    base, asked = records.filter("embedding is not null").select(record_id, *fields), cut_lineage(queries.filter("embedding is not null").select(query_id, *fields))
    kinds = [df.schema[c].dataType for df, c in ((asked, query_id), (base, record_id))]
    schema, found = f"{query_id} {kinds[0].simpleString()}, {record_id} {kinds[1].simpleString()}, relevance double", None
    blocks = -(-(asked.agg(F.sum(F.size("_v") + F.size("_t"))).first()[0] or 0) // QUERY_NUMBERS)
    for n in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == n).collect()
        if rows:
            own = base.mapInArrow(_recalling(base.sparkSession, rows, k, minimum, [to_arrow_type(t) for t in kinds], [query_id, record_id, "relevance"]), schema)
            found = own if found is None else found.unionByName(own)
    if found is None:
        return base.sparkSession.createDataFrame([], f"{schema}, rank int")
    return top_k(found, query_id, [F.desc("relevance"), F.asc(record_id)], k)


def _recalling(spark, rows: list, k: int, minimum: float, types: list, names: list[str]):
    owner = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
    words = np.concatenate([np.array(r[2], np.int64) for r in rows])
    known, number = np.unique(words, return_inverse=True)
    order = np.argsort(number, kind="stable")
    cuts = np.searchsorted(number[order], np.arange(len(known) + 1))
    packed = spark.sparkContext.broadcast(([r[0] for r in rows], _unit(np.array([r[1] for r in rows], np.float64)), np.array([len(r[2]) for r in rows]), known, owner[order], cuts))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, sizes, known, asking, cuts = packed.value
        step = max(1, 4_000_000 // len(ids))
        for whole in batches:
            for begin in range(0, whole.num_rows, step):
                batch = whole.slice(begin, step)
                m = batch.num_rows
                near = _unit(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(m, -1)) @ vectors.T
                words, row = Postings._entries(pa.chunked_array([batch.column(2)]))
                at = np.searchsorted(known, words)
                hit = at < len(known)
                hit[hit] = known[at[hit]] == words[hit]
                place, entry = _spans(cuts[at[hit]], cuts[at[hit] + 1])
                shared = np.bincount(row[hit][entry] * len(ids) + asking[place], minlength=m * len(ids)).reshape(m, -1)
                union = np.bincount(row, minlength=m)[:, None] + sizes - shared
                relevance = 0.70 * np.maximum(near, 0.0) + 0.30 * (shared / np.maximum(union, 1))
                if m > k:  # all ties of the k-th stay
                    floor = np.maximum(np.partition(relevance, m - k, axis=0)[m - k], minimum)
                else:
                    floor = np.full(len(ids), minimum)
                record, query = np.nonzero(relevance >= floor)
                yield pa.RecordBatch.from_arrays([pa.array([ids[q] for q in query.tolist()], types[0]), batch.column(0).take(pa.array(record)).cast(types[1]), pa.array(relevance[record, query])], names)

    return score
