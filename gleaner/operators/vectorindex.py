"""A partitioned vector index for cosine search: trained cells, residual codes, bounds that prove the result.

``build`` trains centroids on a bounded sample and stores a table: each vector's cell, the part of the cell it is in (so
that a cell with a third of all vectors is many groups), and its residual from the centroid as one byte a dimension with
the error that the bytes make.  ``search`` sends a query to its nearest cells, ranks their vectors by the codes, and
scores the best exactly.  With ``exact`` it then goes on: the angle between query and centroid and the angular radius of a
cell bound what the cell can hold, the code's error bounds what a vector can score, and whatever may still reach the
k-th exact score is probed and scored, so the result is that of a full scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.vectors import top_k
from gleaner.session import cut_lineage

SAMPLE, MOST_CELLS, ROUNDS, PART_ROWS = 20_000, 4096, 12, 50_000


@dataclass
class Index:
    """rows: (vec_id, cell, part, code, scale, error); cells: centroids, angular radii, parts of each."""

    rows: DataFrame
    vectors: DataFrame
    centroids: np.ndarray
    radius: np.ndarray
    parts: np.ndarray
    vec_id: str
    column: str


def unit(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(length > 1e-12, length, 1.0)


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    rows = column.to_pylist()
    width = width or max((len(r) for r in rows if r), default=1)
    return np.array([r if r else [0.0] * width for r in rows], np.float64).reshape(len(rows), width)


def train(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids by spherical k-means; starts are the sample's rows far from those already taken."""
    cells = min(cells, len(sample))
    chosen = [0]
    near = sample @ sample[0]
    while len(chosen) < cells:
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, sample @ sample[chosen[-1]])
    centroids = sample[chosen]
    for _ in range(rounds):
        own = np.argmax(sample @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        empty = ~np.bincount(own, minlength=cells).astype(bool)
        sums[empty] = centroids[empty]
        centroids = unit(sums)
    return centroids


def build(vectors: DataFrame, vec_id: str = "vec_id", column: str = "embedding", cells: int | None = None, sample: int = SAMPLE, part_rows: int = PART_ROWS) -> Index:
    """The index of all vectors; the first ``sample`` ids by hash train about sqrt(n) cells, ``MOST_CELLS`` at most."""
    spark = vectors.sparkSession
    own = vectors.select(F.col(vec_id).alias("vec_id"), F.col(column).alias("vector"))
    n = own.count()
    picked = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    width = max((len(r.vector) for r in picked if r.vector), default=1)
    trained = train(unit(np.array([r.vector or [0.0] * width for r in picked], np.float64).reshape(len(picked), width)), cells or max(1, min(MOST_CELLS, round(n**0.5)))) if picked else np.zeros((1, width))
    shared = spark.sparkContext.broadcast(trained)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared.value
        for batch in batches:
            m = unit(_matrix(batch.column(1), centroids.shape[1]))
            close = m @ centroids.T
            cell = np.argmax(close, axis=1) if len(m) else np.zeros(0, np.int64)
            rest = m - centroids[cell]
            scale = np.abs(rest).max(axis=1, initial=1e-12) / 127
            code = np.rint(rest / scale[:, None]).astype(np.int8)
            error = np.linalg.norm(rest - code * scale[:, None], axis=1) + 1e-9
            angle = np.arccos(np.clip(close[np.arange(len(m)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale), pa.array(error), pa.array(angle)],
                                             ["vec_id", "cell", "code", "scale", "error", "angle"])

    kind = own.schema["vec_id"].dataType.simpleString()
    rows = cut_lineage(own.mapInArrow(assign, f"vec_id {kind}, cell int, code binary, scale double, error double, angle double"))
    radius, parts = np.zeros(len(trained)), np.ones(len(trained), np.int64)
    for r in rows.groupBy("cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).collect():  # MOST_CELLS rows
        radius[r.cell], parts[r.cell] = r.radius + 1e-9, -(-r.n // part_rows)
    of_cell = spark.createDataFrame([(k, int(p)) for k, p in enumerate(parts)], "cell int, parts bigint")
    rows = rows.join(of_cell, "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts")).drop("angle", "parts")
    return Index(rows, own, trained, radius, parts, vec_id, column)


def _asked(index: Index, queries: DataFrame, query_id: str, column: str, probes: int | None) -> DataFrame:
    """(query_id, vector, floor, cell, part): the nearest ``probes`` cells; or, with None, all cells that can still hold a
    score of the query's ``floor``."""
    shared = queries.sparkSession.sparkContext.broadcast((index.centroids, index.radius, index.parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, radius, parts = shared.value
        for batch in batches:
            m = unit(_matrix(batch.column(1), centroids.shape[1]))
            close = np.clip(m @ centroids.T, -1, 1)
            if probes is None:
                bound = np.cos(np.maximum(0.0, np.arccos(close) - radius))
                who, cell = np.nonzero(bound >= batch.column(2).to_numpy()[:, None] - 1e-9)
            else:
                cell = np.argsort(-close, axis=1, kind="stable")[:, :probes]
                who, cell = np.repeat(np.arange(len(m)), cell.shape[1]), cell.ravel()
            often = parts[cell]
            who, cell = np.repeat(who, often), np.repeat(cell, often)
            part = np.arange(len(who)) - np.repeat(np.cumsum(often) - often, often)
            take = pa.array(who)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take), pa.array(cell.astype(np.int32)), pa.array(part)],
                                             ["query_id", "vector", "floor", "cell", "part"])

    rows = queries.select(F.col(query_id).alias("query_id"), F.col(column).cast("array<double>").alias("vector"), "floor")
    kind = rows.schema["query_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"query_id {kind}, vector array<double>, floor double, cell int, part bigint")


def _by_codes(index: Index, asked: DataFrame, most: int | None) -> DataFrame:
    """(query_id, vec_id, near): by the codes, the best ``most`` of a cell's part for each query, or all that may reach its floor."""
    shared = asked.sparkSession.sparkContext.broadcast(index.centroids)
    kinds = asked.schema["query_id"].dataType.simpleString(), index.rows.schema["vec_id"].dataType.simpleString()

    def run(key: tuple, own: pa.Table, rows: pa.Table) -> pa.Table:
        if not own.num_rows or not rows.num_rows:
            return pa.table({"query_id": own.column("query_id")[:0], "vec_id": rows.column("vec_id")[:0], "near": pa.array([], pa.float64())})
        centroid = shared.value[key[0].as_py()]
        code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.int8).reshape(rows.num_rows, -1)
        q = unit(_matrix(own.column("vector"), len(centroid)))
        near = (q @ centroid)[:, None] + (q @ code.T.astype(np.float64)) * rows.column("scale").to_numpy()
        if most is None:
            who, at = np.nonzero(near + rows.column("error").to_numpy() >= own.column("floor").to_numpy()[:, None] - 1e-9)
        else:
            at = np.argpartition(-near, min(most, near.shape[1]) - 1, axis=1)[:, :most]
            who, at = np.repeat(np.arange(len(q)), at.shape[1]), at.ravel()
        return pa.table({"query_id": own.column("query_id").take(pa.array(who)), "vec_id": rows.column("vec_id").take(pa.array(at)), "near": pa.array(near[who, at])})

    return asked.groupBy("cell", "part").cogroup(index.rows.groupBy("cell", "part")).applyInArrow(run, f"query_id {kinds[0]}, vec_id {kinds[1]}, near double")


def _exact(index: Index, found: DataFrame, queries: DataFrame, query_id: str, column: str) -> DataFrame:
    """(query_id, vec_id, score) of candidate pairs, from the vectors themselves."""
    q = queries.select(F.col(query_id).alias("query_id"), F.col(column).alias("q"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    both = found.select("query_id", "vec_id").join(index.vectors, "vec_id").join(q, "query_id")
    size = F.sqrt(dot(F.col("q"), F.col("q")) * dot(F.col("vector"), F.col("vector")))
    return both.select("query_id", "vec_id", F.when(size > 1e-12, dot(F.col("q"), F.col("vector")) / size).otherwise(0.0).alias("score"))


def search(index: Index, queries: DataFrame, k: int, query_id: str = "query_id", column: str = "embedding", probes: int = 8, widen: int = 4,
           exact: bool = False) -> DataFrame:
    """(query_id, vec_id, score, rank): the k best by cosine among the ``probes`` nearest cells; with ``exact`` the k best of
    all.  ``widen`` times k candidates by code are scored exactly."""
    low = queries.withColumn("floor", F.lit(-2.0))
    coarse = top_k(_by_codes(index, _asked(index, low, query_id, column, probes), widen * k), "query_id", [F.desc("near"), F.asc("vec_id")], widen * k)
    best = top_k(_exact(index, coarse, queries, query_id, column), "query_id", [F.desc("score"), F.asc("vec_id")], k)
    if exact:
        best = cut_lineage(best)
        floors = best.filter(F.col("rank") == k).select(F.col("query_id").alias("_q"), F.col("score").alias("_f"))
        raised = queries.join(floors, F.col(query_id) == F.col("_q"), "left").withColumn("floor", F.coalesce("_f", F.lit(-2.0)))
        full = _by_codes(index, _asked(index, raised, query_id, column, None), None)
        best = top_k(_exact(index, full, queries, query_id, column), "query_id", [F.desc("score"), F.asc("vec_id")], k)
    return best.select(F.col("query_id").alias(query_id), F.col("vec_id").alias(index.vec_id), "score", "rank")
