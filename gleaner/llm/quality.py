"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Words are runs of letters, of digits and of other signs.  Features are words and pairs of neighbours, hashed to
``2**BITS`` slots; a word that repeats the one before it also fills one slot common to all repetitions.  A feature's
value is its share of the words (or pairs) of the whole text, so a score is a sparse dot product whose cost follows the
length of the text.  Training reads the labelled rows, or ``SAMPLE`` of them chosen by a hash where there are more: one
online pass (several over a small table), in one task, over bounded data.  Scoring reads all documents with the weights, ``2**BITS`` numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import wordhash as H
from gleaner.llm.common import documents
from gleaner.llm.registry import query
from gleaner.sources.tables import table

BITS = 18
SAMPLE = 12_000
#: with up to AGAIN labelled rows the pass is repeated until there are UPDATES of them
AGAIN, UPDATES = 3_000, 12_000
THRESHOLD = 0.3
REPEAT = 0
ALPHA, BETA, L1, L2, SCALE = 0.5, 1.0, 0.0005, 0.0005, 10.0

_KIND = np.full(256, 3, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values), one entry per occurrence; the empty text has none."""
    data = np.frombuffer(text.encode(), np.uint8)
    kind = _KIND[data]
    edge = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1], [True]])) if len(data) else np.zeros(1, np.int64)
    begins, ends = edge[:-1], edge[1:]
    inside = kind[begins] > 0
    word = H.span_hashes(data, begins[inside], ends[inside])
    if not len(word):
        return np.zeros(0, np.int64), np.zeros(0)
    pair = H.mixed(word[:-1] * np.uint64(3) + word[1:])
    again = np.flatnonzero(word[:-1] == word[1:])
    slots = (np.concatenate([word, pair]) >> np.uint64(64 - BITS)).astype(np.int64)
    slots = np.concatenate([np.where(slots == REPEAT, 1, slots), np.full(len(again), REPEAT)])
    values = np.full(len(slots), SCALE / max(1, len(pair)))
    values[: len(word)] = SCALE / len(word)
    return slots, values


class Leader:
    """Follow-the-regularised-leader, per coordinate; the last slot is the bias."""

    def __init__(self):
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, slots=slice(None)) -> np.ndarray:
        z, n = self.z[slots], self.n[slots]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, slots: np.ndarray, values: np.ndarray, label: float) -> None:
        slots, where = np.unique(slots, return_inverse=True)
        values = np.append(np.bincount(where, values, len(slots)), 1.0)
        slots = np.append(slots, 1 << BITS)
        w = self.weights(slots)
        gradient = (probability(w @ values) - label) * values
        step = (np.sqrt(self.n[slots] + gradient**2) - np.sqrt(self.n[slots])) / ALPHA
        self.z[slots] += gradient - step * w
        self.n[slots] += gradient**2


def probability(logit: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label") -> np.ndarray:
    """Weights (float32, bias last) from rows with a label 0 or 1; all of them are read by one task (see :func:`sampled`).

    Null texts count as empty; rows without a label are left out; without any rows every score is 0.5.
    """
    rows = labelled.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(label_col).cast("double").alias("label"))
    rows = rows.where("label is not null").withColumn("turn", F.xxhash64("doc_id"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column(0)]
            packed = [(s.astype("<u4").tobytes(), v.astype("<f4").tobytes()) for s, v in found]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.binary()) for c in zip(*packed)), batch.column(1), batch.column(2)], ["slots", "shares", "label", "turn"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, rows, n = Leader(), [], 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(3))):
                n += 1
                rows.append(row) if n <= AGAIN else rows.clear()
                leader.update(np.frombuffer(row[0], "<u4").astype(np.int64), np.frombuffer(row[1], "<f4").astype(float), row[2])
        for _ in range(UPDATES // n - 1 if rows else 0):
            for slots, shares, label in rows:
                leader.update(np.frombuffer(slots, "<u4").astype(np.int64), np.frombuffer(shares, "<f4").astype(float), label)
        yield pa.RecordBatch.from_arrays([pa.array([leader.weights().astype("<f4").tobytes()], pa.binary())], ["weights"])

    seen = rows.select("text", "label", "turn").mapInArrow(extract, "slots binary, shares binary, label double, turn long")
    model = seen.repartition(1).sortWithinPartitions("turn", "slots").mapInArrow(learn, "weights binary")
    learnt = model.first()
    return np.frombuffer(learnt["weights"], "<f4") if learnt else np.zeros((1 << BITS) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): 0 to 1, for every row; empty and null texts get the score of the bias alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logits = []
            for t in batch.column(1):
                slots, values = features(t.as_py() or "")
                logits.append(probability(float(weights[slots] @ values) + float(weights[-1])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(logits, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` (with doc_id and text, all columns kept) whose score is at least ``threshold``.

    Null and empty texts are scored by the bias and so go with the majority of the labelled documents."""
    weights = train(training_rows(docs.select("doc_id", "text"), labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py() or "") for t in batch.column(1)]
            keep = [probability(float(weights[s] @ v) + float(weights[-1])) >= threshold for s, v in found]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_()))], ["row"])

    rows = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    return rows.mapInArrow(run, f"row {docs.schema.simpleString()}").select("row.*")


def held_out(id_col: str, folds: int):
    """Whether crc32 of the id as text leaves no remainder; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, label) of labelled documents outside the held-out fold; several labels of an id are averaged."""
    labels = labels.where(~held_out("doc_id", 5)).groupBy("doc_id").agg(F.round(F.avg("quality")).alias("label"))
    return docs.select("doc_id", "text").join(sampled(labels), "doc_id")


def sampled(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` labelled ids, those with the smallest hash: few enough to be broadcast."""
    kept = labels.where("label is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return F.broadcast(kept)


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of all ``docs`` by a model of the labelled ones among them."""
    weights = train(training_rows(docs, labels))
    out = score(docs, weights)
    return out.select("doc_id", held_out("doc_id", 5).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


@query("op8_quality")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return quality_scores(spark, documents(spark, folder), table(spark, folder, "labels"))
