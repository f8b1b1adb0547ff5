"""Best-fit packing of token pieces into sequences of bounded length, in bulk-synchronous rounds.

Each round orders the unplaced pieces by size and the open sequences by their gap.  A sweep from the largest size gives
each piece its successor, the smallest gap that holds it; pieces and gaps of one size meet by rank, the k-th piece with
the k-th gap, so that no gap is promised twice.  Then the gaps are updated, and the next round starts.  If nothing fits
any more, as many sequences are opened as the rest needs at least, with the largest pieces in them.

Sizes and gaps are whole numbers up to the capacity, so both sorted lists are kept as runs of equal values: a sweep runs
over at most ``capacity`` sizes, however many pieces there are.  The pieces themselves stay in Spark: their ranks within
a size come from sorted hash buckets and the buckets' sizes (a size that a third of all pieces share is ranked in many
tasks), and each task sweeps through the matched runs to find the place of its pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gleaner.llm.common import documents, slices, stored
from gleaner.llm.pieces import KEEP, encoder
from gleaner.llm.registry import query

CAPACITY = 4096
BUCKETS = 256


def matches(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (size, first rank, pieces, pieces in a sequence, first sequence, offset) for ``counts`` pieces of each size."""
    left = {s: n for s, n in counts.items() if n}
    taken: dict[int, int] = defaultdict(int)
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, number)
    runs, sequences = [], 0

    def place(size: int, each: int, first: int, number: int, gap: int) -> None:
        runs.append((size, taken[size], each * number, each, first, capacity - gap))
        taken[size] += each * number
        left[size] -= each * number
        if not left[size]:
            del left[size]

    while left:
        keys, updated, matched = sorted(gaps), defaultdict(list), False
        room = sum(n for g in gaps.values() for _, n in g)
        for size in sorted(left, reverse=True):
            k = bisect_left(keys, size)
            while left.get(size) and k < len(keys):
                gap = keys[k]
                first, number = gaps[gap].pop()
                each = max(1, min(gap // size, left[size] // room))
                use = min(number, left[size] // each)
                place(size, each, first, use, gap)
                updated[gap - each * size].append((first, use))
                matched, room = True, room - use
                if use < number:
                    gaps[gap].append((first + use, number - use))
                if not gaps[gap]:
                    del gaps[gap]
                    keys.pop(k)
        if not matched:
            need = -(-sum(s * n for s, n in left.items()) // capacity)
            for size in sorted(left, reverse=True):
                use = min(need, left[size])
                place(size, 1, sequences, use, capacity)
                updated[capacity - size].append((sequences, use))
                need, sequences = need - use, sequences + use
                if not need:
                    break
        least = min(left, default=capacity + 1)
        for gap, more in updated.items():
            gaps.setdefault(gap, []).extend(more)
        for gap in list(gaps):
            if gap < least:  # holds nothing any more
                del gaps[gap]
                continue
            joined: list[tuple[int, int]] = []
            for first, number in sorted(gaps[gap]):
                if joined and sum(joined[-1]) == first:
                    joined[-1] = (joined[-1][0], joined[-1][1] + number)
                else:
                    joined.append((first, number))
            gaps[gap] = joined
    return runs


def place(pieces: DataFrame, order: Sequence[str], capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id long`` and ``offset long``: sequences of at most ``capacity``, gapless from 0.

    ``pieces`` must be stored (it is read more than once) and have ``length`` from 1 to ``capacity``; ``order`` settles
    ranks among equal lengths, rows that agree in it and all else are interchangeable.  An empty table stays empty.
    """
    spark = pieces.sparkSession
    bucket = F.pmod(F.xxhash64(*order), F.lit(BUCKETS)).cast("int")
    sizes = pieces.groupBy(F.col(length).alias("_size"), bucket.alias("_bucket")).agg(F.count("*").alias("_n"))
    sizes = stored(sizes, "packing-sizes")
    # one row per size reaches the driver, at most ``capacity``
    counts = {int(r["_size"]): r["n"] for r in sizes.groupBy("_size").agg(F.sum("_n").alias("n")).collect()}
    runs = np.array(sorted(matches(counts, capacity)), np.int64).reshape(-1, 6)
    before = sizes.withColumn("_before", F.sum("_n").over(W.partitionBy("_size").orderBy("_bucket")) - F.col("_n")).drop("_n")
    ranked = (
        pieces.withColumns({"_size": F.col(length), "_bucket": bucket})
        .withColumn("_within", F.row_number().over(W.partitionBy("_size", "_bucket").orderBy(*order)))
        .join(before, ["_size", "_bucket"])
        .withColumn("_rank", F.col("_before") + F.col("_within") - 1)
    )
    names = pieces.columns
    # a size with many pieces is one run or a few: (size, rank) as one ascending key
    keys = runs[:, 0] * (1 << 44) + runs[:, 1]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_size", "_rank"))
            run = runs[np.searchsorted(keys, size * (1 << 44) + rank, "right") - 1]
            inside = rank - run[:, 1]
            sequence = run[:, 4] + inside // np.maximum(run[:, 3], 1)
            offset = run[:, 5] + inside % np.maximum(run[:, 3], 1) * size
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(sequence), pa.array(offset)],
                                             [*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.select(*names, "_size", "_rank").mapInArrow(sweep, f"{fields}, sequence_id long, offset long")


def cut(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, keep_ids: bool = True, known_words: int = KEEP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids array<int>]): each document's tokens with ``end_id`` last, cut only
    where they are longer than ``capacity``.  Null texts count as empty (one token), repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, known_words)
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                rows = []
                for name, ids in zip(names[a:b], coder.encode(texts[a:b])):
                    ids = np.append(np.frombuffer(ids, coder.dtype), coder.dtype.type(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        own = ids[start : start + capacity]
                        rows.append((name, piece, start, len(own), zlib.crc32(own), own.astype(np.int32)))
                columns = list(zip(*rows))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())][: 5 + keep_ids]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids])

    fields = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, fields)


ORDER = ("doc_id", "piece", "ids_crc32")


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids array<int>, docs array<struct>) of placed pieces with ids: the packed training sequences.

    A sequence holds at most ``capacity`` tokens, so the groups are bounded."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    return placed.groupBy("sequence_id").agg(inside.alias("p")).select(
        "sequence_id", F.flatten("p.ids").alias("ids"), F.transform("p", lambda p: F.struct(p.doc_id, p.piece, p.offset, p.length)).alias("docs"))


def packed(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, known_words: int = KEEP) -> DataFrame:
    """Pieces of all documents with their places; see :func:`cut` and :func:`place`.  ``known_words`` bounds the memory that a
    worker process keeps between its tasks."""
    return place(stored(cut(docs, tokenizer, end_id, capacity, False, known_words), "packing-pieces"), ORDER, capacity)


@query("op3_packing")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return packed(documents(spark, folder), public_tokenizers.path("word_bpe_49k.json"))
