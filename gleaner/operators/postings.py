"""Best documents per query, where the documents are: posting blocks with upper bounds.

Queries travel, documents stay.  A task turns its documents block by block into postings: for each query token the
documents that have it with their term saturation, and the largest one of the block.  The sum of a query's largest ones
bounds what the block can reach; only blocks that can still pass the query's k-th score so far are opened and scored.  A
task returns its own k best per query, so what is shuffled is k rows a query and task, never a (query, document) pair,
and the documents are read once.

Queries go out in blocks of ``QUERY_TOKENS`` tokens, measured first; more of them are more passes by the same code.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import tokens as K
from gleaner.operators.vectors import top_k

K1, B, AVERAGE_LENGTH = 1.5, 0.75, 150.0
QUERY_TOKENS, BLOCK = 2_000_000, 4096


@dataclass
class Packed:
    """A block of queries: their token lists end to end, as numbers of the block's vocabulary with weights."""

    ids: list
    starts: np.ndarray
    codes: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    vocabulary: list[str]
    vectors: np.ndarray | None = None

    def rows(self, k: int) -> slice:
        return slice(self.starts[k], self.starts[k + 1])


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(length > 1e-12, length, 1.0)


def packed_queries(queries: DataFrame, query_id: str, text: str = "text", vector: str | None = None, block_tokens: int = QUERY_TOKENS) -> Iterator[Packed]:
    """The queries in blocks of about ``block_tokens`` tokens; the weight of a token is how often the query has it."""
    toks = queries.select(F.col(query_id).alias("id"), K.rerank_tokens(F.col(text)).alias("tokens"), *([F.col(vector).alias("vector")] if vector else []))
    size = toks.agg(F.sum(F.size("tokens") + 1)).first()[0] or 0
    blocks = max(1, -(-size // block_tokens))
    for k in range(blocks if size else 0):
        rows = toks.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).collect()
        numbers: dict[str, int] = {}
        codes, weights, starts = [], [], [0]
        for r in rows:
            own: dict[int, int] = {}
            for t in r.tokens or ():
                own[n] = own.get(n := numbers.setdefault(t, len(numbers)), 0) + 1
            codes += own
            weights += own.values()
            starts.append(len(codes))
        vectors = None
        if vector:
            width = max((len(r.vector) for r in rows if r.vector is not None), default=1)
            vectors = _unit(np.array([r.vector if r.vector is not None else [0.0] * width for r in rows], np.float64).reshape(len(rows), width))
        scale = np.array([len(r.tokens or ()) * (K1 + 1) + 1e-9 for r in rows])
        yield Packed([r.id for r in rows], np.array(starts), np.array(codes, np.int64), np.array(weights, np.float64), scale, list(numbers), vectors)


def _counted(tokens: pa.ListArray, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token count of each document; number, document and frequency of each posting, by number)."""
    lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    numbers = pc.fill_null(pc.index_in(tokens.flatten(), value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
    rows, hit = np.repeat(np.arange(len(lengths)), lengths), numbers >= 0
    n = max(1, len(lengths))
    keys, often = np.unique(numbers[hit].astype(np.int64) * n + rows[hit], return_counts=True)
    return lengths, keys // n, keys % n, often


class _Best:
    """The k best of each query so far, by rounded score and then by id."""

    def __init__(self, queries: int, k: int, digits: int):
        self.k, self.unit = k, 10.0**digits
        self.floor = np.full(queries, -np.inf)
        self.kept: list = [None] * queries

    def add(self, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        rounded = np.floor(scores * self.unit + 0.5)
        near = rounded >= self.floor[query]
        ids, scores, rounded = ids[near], scores[near], rounded[near]
        if self.kept[query] is not None:
            ids, scores, rounded = (np.concatenate(p) for p in zip(self.kept[query], (ids, scores, rounded)))
        order = np.lexsort((ids, -rounded))[: self.k]
        self.kept[query] = ids[order], scores[order], rounded[order]
        if len(order) == self.k:
            self.floor[query] = rounded[order[-1]]

    def may_pass(self, bounds: np.ndarray) -> np.ndarray:
        """Queries whose bound, a little raised against rounding, reaches their k-th score."""
        return np.flatnonzero(np.floor(bounds * (1 + 1e-9) * self.unit + 0.5) >= self.floor)


def statistics(docs: DataFrame, block: Packed, text: str = "text") -> tuple[int, float, np.ndarray]:
    """(documents, mean tokens, documents with each word of the block): one pass, summed before the shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(block.vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(shared.value, pa.string())
        found, rows, total = np.zeros(len(vocabulary), np.int64), 0, 0
        for batch in batches:
            lengths, numbers, _, _ = _counted(batch.column(0), vocabulary)
            found += np.bincount(numbers, minlength=len(found))
            rows, total = rows + len(lengths), total + int(lengths.sum())
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(found[at], [rows, total]))], ["number", "n"])

    sums = docs.select(K.rerank_tokens(F.col(text)).alias("tokens")).mapInArrow(count, "number long, n long").groupBy("number").agg(F.sum("n").alias("n")).collect()
    by = {r["number"]: r.n for r in sums}
    often = np.array([by.get(k, 0) for k in range(len(block.vocabulary))], np.float64)
    return by.get(-1, 0), by.get(-2, 0) / max(1, by.get(-1, 0)), often


def top_documents(docs: DataFrame, queries: DataFrame, doc: str, query_id: str, k: int, digits: int = 9, rule: str = "lexical", text: str = "text",
                  vector: str | None = None, static: str | None = None, weights: tuple[float, float] = (0.40, 0.25), block_tokens: int = QUERY_TOKENS,
                  rows: int = BLOCK) -> DataFrame:
    """(query_id, doc, score, rank): the k best documents of each query, ties of scores rounded to ``digits`` by id.

    rule ``lexical``: summed term saturation as a share of the most that the query could reach; ``bm25``: the same sum with
    inverse document frequencies and the corpus' own mean length; both list only documents with a word of the query.
    ``hybrid``: ``weights`` times (cosine of the columns ``vector``, 0 without one, and lexical) plus the column ``static``,
    over all documents."""
    spark, schema = docs.sparkSession, f"{query_id} {queries.schema[query_id].dataType.simpleString()}, {doc} {docs.schema[doc].dataType.simpleString()}, score double"
    hybrid = rule == "hybrid"
    rows_of = docs.select(F.col(doc).alias("id"), K.rerank_tokens(F.col(text)).alias("tokens"), *([F.col(vector).alias("vector"), F.col(static).alias("static")] if hybrid else []))
    parts = []
    for block in packed_queries(queries, query_id, text, vector if hybrid else None, block_tokens):
        average = AVERAGE_LENGTH
        if rule == "bm25":
            n, average, often = statistics(docs, block, text)
            block.weights = block.weights * np.log(1 + (n - often + 0.5) / (often + 0.5))[block.codes]
            block.scale = np.ones(len(block.ids))
        parts.append(rows_of.mapInArrow(_scorer(spark.sparkContext.broadcast(block), average or 1.0, k, digits, rule, weights, rows, schema, query_id, doc), schema))
    if not parts:
        return spark.createDataFrame([], f"{schema}, rank int")
    scored = parts[0]
    for more in parts[1:]:
        scored = scored.unionByName(more)
    return top_k(scored, query_id, [F.desc(F.round("score", digits)), F.asc(doc)], k)


def _scorer(shared, average: float, k: int, digits: int, rule: str, weights: tuple[float, float], size: int, schema: str, query_id: str, doc: str):
    hybrid = rule == "hybrid"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Packed = shared.value
        vocabulary = pa.array(block.vocabulary, pa.string())
        best, kind = _Best(len(block.ids), k, digits), None
        asked = np.flatnonzero(np.diff(block.starts))
        for batch in batches:
            kind = batch.column(0).type
            for a in range(0, batch.num_rows, size):
                _add(batch.slice(a, size), block, vocabulary, asked, best)
        kept = [(q, *rows[:2]) for q, rows in enumerate(best.kept) if rows is not None and len(rows[0])]
        if kept:
            owners = [block.ids[q] for q, ids, _ in kept for _ in range(len(ids))]
            yield pa.RecordBatch.from_arrays([pa.array(owners), pa.array(np.concatenate([ids for _, ids, _ in kept])).cast(kind), pa.array(np.concatenate([s for *_, s in kept]))],
                                             [query_id, doc, "score"])

    def _add(part: pa.RecordBatch, block: Packed, vocabulary: pa.Array, asked: np.ndarray, best: _Best) -> None:
        ids = part.column(0).to_numpy(zero_copy_only=False)
        lengths, numbers, rows, often = _counted(part.column(1), vocabulary)
        gain = often * (K1 + 1) / (often + K1 * (1 - B + B * (lengths[rows] / average)))
        cuts = np.searchsorted(numbers, np.arange(len(vocabulary) + 1))
        peak = np.zeros(len(vocabulary))
        if len(numbers):
            begins = np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1]))
            peak[numbers[begins]] = np.maximum.reduceat(gain, begins)
        bounds = np.zeros(len(block.ids))
        if len(asked):
            bounds[asked] = np.add.reduceat(block.weights * peak[block.codes], block.starts[asked])
        bounds = bounds / block.scale
        if rule != "bm25":
            bounds = np.minimum(bounds, 1.0)
        close = static = None
        if hybrid:
            static = part.column(3).to_numpy(zero_copy_only=False)
            width = block.vectors.shape[1]
            vectors = _unit(np.array([v if v is not None else [0.0] * width for v in part.column(2).to_pylist()], np.float64).reshape(len(ids), width))
            close = np.clip(block.vectors @ vectors.T, 0.0, 1.0)
            bounds = weights[1] * bounds + (weights[0] * close + static).max(axis=1)
        for q in best.may_pass(bounds):
            own = block.rows(q)
            spans = [(cuts[c], cuts[c + 1], w) for c, w in zip(block.codes[own], block.weights[own]) if cuts[c] < cuts[c + 1]]
            if not spans and not hybrid:
                continue
            score = np.zeros(len(ids))
            if spans:
                score = np.bincount(np.concatenate([rows[x:y] for x, y, _ in spans]), np.concatenate([gain[x:y] * w for x, y, w in spans]), len(ids))
            found = np.arange(len(ids)) if hybrid else np.flatnonzero(score)
            score = score / block.scale[q]
            if rule != "bm25":
                score = np.minimum(score, 1.0)
            if hybrid:
                score = weights[0] * close[q] + weights[1] * score + static
            best.add(q, ids[found], score[found])

    return run
