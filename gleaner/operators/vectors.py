"""Embeddings and vector search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from gleaner import lexicons as L
from gleaner.functions import tokens as K

#: numbers of query vectors that go out at once
QUERY_NUMBERS = 4_000_000


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def normalize(v: Column) -> Column:
    """Unit length; vectors of almost no length stay as they are."""
    from gleaner.functions.text import let
    return let(norm(v), lambda n: F.when(n < 1e-9, F.transform(v, lambda x: x.cast("double"))).otherwise(
        F.transform(v, lambda x: x.cast("double") / n)))


def project(v: Column, dim: int) -> Column:
    """Cut or zero-pad to ``dim``, then normalise."""
    padded = F.concat(F.slice(v, 1, dim), F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(dim) - F.size(v), F.lit(0))))
    return normalize(padded)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


#: (bits the token's hash is shifted by, weight) of its three places
PLACES = ((0, 1.0), (7, 0.5), (13, 0.25))


def _embedded(words: pa.Array, dim: int) -> pa.Array:
    """Unit vectors of a batch of token lists; each distinct token of the batch is hashed once.  Tokens stay in Arrow: only the
    distinct ones become Python strings, and 256 rows at a time meet their places."""
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    flat = words.flatten().dictionary_encode()
    tokens = flat.indices.to_numpy(zero_copy_only=False)
    slots = np.zeros((len(PLACES), len(flat.dictionary)), np.int32)
    for k, token in enumerate(flat.dictionary):
        number = int.from_bytes(hashlib.sha256(token.as_py().encode()).digest(), "big")
        for p, (shift, _) in enumerate(PLACES):
            slots[p, k] = (number >> shift) % dim
    vectors = np.zeros((len(words), dim), np.float32)
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    for k in range(0, len(words), 256):
        rows = vectors[k : k + 256]
        owner, mine = np.repeat(np.arange(len(rows)), sizes[k : k + 256]), tokens[cuts[k] : cuts[k + len(rows)]]
        for p, (_, weight) in enumerate(PLACES):
            np.add.at(rows, (owner, slots[p, mine]), np.float32(weight))
        lengths = np.linalg.norm(rows, axis=1, keepdims=True)
        rows /= np.where(lengths > 1e-9, lengths, 1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * dim), pa.array(vectors.ravel()))


def hashed_embedding(text: Column, dim: int = L.EMBEDDING_DIM) -> Column:
    """Hashed bag of words, unit length; a text without tokens gives the zero vector.  Tokens are cut on the JVM."""

    @F.arrow_udf(ArrayType(FloatType()))
    def embed(words: pa.Array) -> pa.Array:
        return _embedded(words, dim)

    return embed(K.tokens(F.coalesce(text, F.lit("")), L.EMBEDDING_STOP))


def matches(filters: dict[str, str], columns: list[str], metadata: str | None = "metadata") -> Column:
    """Case-insensitive equality on a column or, failing that, on a metadata key (also without underscores)."""
    test = F.lit(True)
    for key, value in filters.items():
        names = [key, key.replace("_", ""), key.lower(), key.upper()]
        found = [F.col(n).cast("string") for n in dict.fromkeys(names) if n in columns]
        if metadata in columns:
            found += [F.try_element_at(F.col(metadata), F.lit(n)) for n in dict.fromkeys(names)]
        test = test & F.coalesce(F.lower(F.coalesce(*found)) == str(value).lower(), F.lit(False))
    return test


def top_k(scored: DataFrame, query: str, order: list[Column], k: int) -> DataFrame:
    """Best k rows per query.  The rank filter becomes a group limit before the shuffle, so hot queries stay small."""
    window = Window.partitionBy(query).orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, k: int | None = 5, min_score: float = 0.0, where: Column | None = None,
           vec_id: str = "vec_id", query_id: str = "query_id", column: str = "embedding") -> DataFrame:
    """Exact cosine top-k: (query_id, vec_id, score, rank).

    The filter comes first.  Queries travel in blocks of ``QUERY_NUMBERS`` numbers, measured first; each block is one pass over
    the vectors, of which every Arrow batch keeps its own k best per query.
    ``k=None`` returns every pair at or above ``min_score`` and above the query's own ``floor`` column, if it has one.
    """
    base = vectors if where is None else vectors.filter(where)
    size = queries.agg(F.sum(F.size(column)).alias("numbers")).first()["numbers"]
    id_type = base.schema[vec_id].dataType.simpleString()
    q_type = queries.schema[query_id].dataType.simpleString()
    schema = f"{query_id} {q_type}, {vec_id} {id_type}, score double"
    if not size:
        return base.sparkSession.createDataFrame([], schema if k is None else f"{schema}, rank int")
    floor = F.greatest(F.col("floor") if "floor" in queries.columns else F.lit(float(min_score)), F.lit(float(min_score)))
    asked = queries.select(F.col(query_id), F.col(column).cast("array<double>"), floor)
    blocks = -(-size // QUERY_NUMBERS)
    scored = None
    for n in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == n).collect()
        if rows:
            own = base.select(vec_id, column).mapInPandas(_scorer(base.sparkSession, rows, k, vec_id, query_id, column), schema)
            scored = own if scored is None else scored.unionByName(own)
    return scored if k is None else top_k(scored, query_id, [F.desc("score"), F.asc(vec_id)], k)


def _scorer(spark, rows: list, k: int | None, vec_id: str, query_id: str, column: str):
    packed = spark.sparkContext.broadcast(([r[0] for r in rows], _unit(np.array([r[1] for r in rows], np.float64)), [r[2] for r in rows]))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix, floors = packed.value
        for batch in batches:
            if len(batch):
                yield _best(batch[vec_id].to_numpy(), np.stack(batch[column].to_numpy()), ids, matrix, k, floors).set_axis([query_id, vec_id, "score"], axis=1)

    return score


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(length > 1e-12, length, 1.0)


def _best(vec_ids, vectors, query_ids, matrix, k: int | None, floors) -> pd.DataFrame:
    scores = _unit(vectors.astype(np.float64)) @ matrix.T
    out = []
    for j, query in enumerate(query_ids):
        column = scores[:, j]
        near = np.flatnonzero(column >= floors[j])
        if k is not None and len(near) > k:  # all that reach the k-th best score, then ties by id
            near = near[column[near] >= np.partition(column[near], len(near) - k)[len(near) - k]]
        order = near[np.lexsort((vec_ids[near], -column[near]))][:k]
        out.append(pd.DataFrame({"q": [query] * len(order), "v": vec_ids[order], "s": column[order]}))
    return pd.concat(out)


def embed_missing(texts: DataFrame, cache: DataFrame, text: str = "text", dim: int = L.EMBEDDING_DIM) -> tuple[DataFrame, DataFrame]:
    """(texts with embeddings, new cache rows): only texts whose MD5 is not in the cache (md5, embedding) are embedded."""
    keyed = texts.withColumn("md5", F.md5(text))
    missing = keyed.select("md5", text).join(cache.select("md5"), "md5", "left_anti").groupBy("md5").agg(F.first(text).alias(text))
    fresh = missing.select("md5", hashed_embedding(F.col(text), dim).alias("embedding"))
    return keyed.join(cache.unionByName(fresh), "md5", "left"), fresh
