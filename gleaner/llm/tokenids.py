"""Token ids of a corpus in a compact binary file format, written in document order and read back.

Ids are replaced by their rank in the corpus-wide frequency order, so that frequent ids take one byte.  A rank takes one
to four little-endian bytes; its length (two bits) stands in a separate control stream, four to a control byte, lowest
bits first.  Decoding looks the lengths up in a table of 256 rows, adds them up to offsets and gathers, all in numpy.

A folder holds two Parquet tables with uncompressed binary columns (Spark's committers make them safe against lost tasks
on any store): ``ranks`` (rank, id, occurrences) and ``blocks`` (part, start, docs, lengths, control, data).  ``part``
numbers the ascending ranges of document ids, ``start`` counts the ids before the block in its part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import documents, slices, stored, work_folder
from gleaner.llm.pieces import encoder
from gleaner.llm.registry import query

BLOCK_TOKENS = 500_000
#: ids counted at once: a count touches the whole vocabulary, so not for each document
COUNTED_BYTES = 4_000_000
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of an array of unsigned 32-bit ranks."""
    ranks = ranks.astype("<u4", copy=False)
    size = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = size
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= size[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks of two streams."""
    sizes = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    ends = np.cumsum(sizes, dtype=np.int64)
    begins = ends - sizes
    raw = np.frombuffer(data, np.uint8)
    values = raw[begins].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(sizes > k)
        values[longer] |= raw[begins[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return values


def tokenize(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary): little-endian unsigned 32-bit or, if the vocabulary allows, 16-bit ids with ``end_id`` last.

    Null texts count as empty, null ids stay null, repeated rows stay apart; other columns are left out.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        end = np.array([end_id], coder.dtype).tobytes()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                ids = [x + end for x in coder.encode(texts[a:b])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(encode, "doc_id long, ids binary")


def frequencies(tokens: DataFrame, vocabulary: int, dtype: np.dtype) -> DataFrame:
    """(id, occurrences) over all documents, one partial row per id and task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        held, size = [], 0
        for batch in batches:
            for ids in batch.column(0):
                held.append(ids.as_py())
                size += len(held[-1])
                if size >= COUNTED_BYTES:
                    total += np.bincount(np.frombuffer(b"".join(held), dtype), minlength=vocabulary)
                    held, size = [], 0
        total += np.bincount(np.frombuffer(b"".join(held), dtype), minlength=vocabulary)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    return tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("occurrences"))


def write(tokens: DataFrame, folder: str, tokenizer: str) -> None:
    """Write (doc_id, ids) of :func:`tokenize` to ``folder`` in ascending ``doc_id`` order (nulls first; repeated ids in
    the order of their tokens)."""
    spark = tokens.sparkSession
    coder = encoder(tokenizer)
    vocabulary, dtype = coder.vocabulary, coder.dtype
    # at most one row per id of the vocabulary reaches the driver
    counted = sorted(((-r.occurrences, r.id) for r in frequencies(tokens, vocabulary, dtype).collect()))
    ranked = spark.createDataFrame([(k, i, -n) for k, (n, i) in enumerate(counted)], "rank long, id long, occurrences long")
    ranked.coalesce(1).write.parquet(f"{folder}/ranks")
    rank_of = np.zeros(vocabulary, np.uint32)
    rank_of[[i for _, i in counted]] = np.arange(len(counted))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, names, lengths, held, size = TaskContext.get().partitionId(), 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            control, data = pack(rank_of[np.concatenate(held)] if held else np.zeros(0, np.uint32))
            columns = [pa.array([part]), pa.array([start]), pa.array([names], pa.list_(pa.int64())),
                       pa.array([lengths], pa.list_(pa.int64())), pa.array([control], pa.binary()), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "start", "docs", "lengths", "control", "data"])

        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.append(np.frombuffer(ids.as_py(), dtype))
                names.append(name)
                lengths.append(len(held[-1]))
                size += len(held[-1])
                if size >= BLOCK_TOKENS:
                    yield flush()
                    start, names, lengths, held, size = start + size, [], [], [], 0
        if names:
            yield flush()

    in_order = tokens.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    schema = "part long, start long, docs array<long>, lengths array<long>, control binary, data binary"
    in_order.mapInArrow(blocks, schema).write.option("compression", "none").parquet(f"{folder}/blocks")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary of little-endian unsigned 32-bit ids) of a written folder."""
    return _decoded(spark, folder, "ids binary", lambda ids: ids.tobytes(), pa.binary())


def read_checksums(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32 long) of a written folder."""
    return _decoded(spark, folder, "ids_crc32 long", lambda ids: zlib.crc32(ids), pa.int64())


def _decoded(spark: SparkSession, folder: str, column: str, value, kind: pa.DataType) -> DataFrame:
    blocks = spark.read.parquet(f"{folder}/blocks")
    # the dictionary is bounded by the vocabulary, the totals by the number of written parts
    dictionary = np.array([r.id for r in spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()], "<u4")
    totals = blocks.select("part", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").sum("n").collect()
    offsets, before = {}, 0
    for part, n in sorted(map(tuple, totals)):
        offsets[part], before = before, before + n

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.array(row["lengths"], np.int64)
                ids = dictionary[unpack(row["control"], row["data"], int(lengths.sum()))]
                begins = np.cumsum(lengths) - lengths
                values = [value(ids[a : a + n]) for a, n in zip(begins, lengths)]
                columns = [pa.array(row["docs"], pa.int64()), pa.array(offsets[row["part"]] + row["start"] + begins),
                           pa.array(lengths), pa.array(values, kind)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", column.split()[0]])

    return blocks.mapInArrow(decode, f"doc_id long, start long, n_tokens long, {column}")


@query("op2_token_ids")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokens = stored(tokenize(documents(spark, folder), path, 2), "op2-tokens")
    target = work_folder(spark, "op2-files")
    write(tokens, target, path)
    return read_checksums(spark, target)
