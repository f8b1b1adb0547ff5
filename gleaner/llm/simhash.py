"""SimHash near-duplicates: exact pairs of 64-bit fingerprints within four bits, by vantage-point trees.

1.  Fingerprints are made where the texts are; equal ones are one node from then on, so copies cost nothing.
2.  Two fingerprints that differ in four bits at most differ in one bit at most in one of three blocks of bits.  There is a
    vantage-point tree for each block: a node cuts its points by their Hamming distance, inside the block, from a vantage
    point.  By the triangle inequality partners' distances differ by one at most, so only the points just inside a boundary
    are copied to the other side.  Whole fingerprints would need four in place of one, most of a distribution that is
    four wide, and prune next to nothing.
3.  The upper levels are fitted on a sample (``SAMPLE`` fingerprints a shard, the first by a hash) and sent to all tasks;
    their leaves are the shards.  Every fingerprint goes to its shards; the sample decides balance, never the result.
4.  A shard goes on splitting by the same rule on its own points, and compares what is left in small leaves on all bits.
    It returns a forest of links: points are taken from the leaf as they are reached, so a dense leaf of m near copies
    costs m comparisons a step with fewer and fewer points left, and returns m - 1 links and not all of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import documents, stored
from gleaner.llm.registry import query
from gleaner.operators.dedup import connected_components

WIDTH, SEED, MOST_BITS = 4, 42, 4
BLOCKS = tuple(np.uint64(m) for m in ((1 << 22) - 1, ((1 << 21) - 1) << 22, ((1 << 21) - 1) << 43))
#: bits by which partners differ at most in one of the blocks
NEAR = MOST_BITS // len(BLOCKS)
SHARD, SAMPLE, MOST_SHARDS = 16_384, 32, 32_768
LEAF, TRIALS, ROWS = 256, 8, 1 << 16


def fingerprint(text: str, width: int = WIDTH) -> int:
    """SimHash of the word n-grams of a text, repeats included; of all words if they are fewer, 0 if there are none."""
    words = text.encode().lower().split()  # bytes: A-Z only, split at 0x20 and 0x09 to 0x0D
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.append(0, ends[:-1] + 1)
    width = min(width, len(words))
    total, n = np.zeros(64, np.int64), len(words) - width + 1
    for k in range(0, n, ROWS):
        spans = zip(begins[k : min(k + ROWS, n)].tolist(), ends[width - 1 + k : width - 1 + min(k + ROWS, n)].tolist())
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], "<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py() or "", width) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _distances(points: np.ndarray, vantage: np.uint64, block: np.uint64) -> np.ndarray:
    return np.bitwise_count((points ^ vantage) & block)


def split(points: np.ndarray, block: np.uint64) -> tuple[np.uint64, int] | None:
    """(vantage point, radius) that leaves the least pairs to compare, out of ``TRIALS`` points; None if no cut is of use."""
    best = None
    for vantage in points[:: max(1, len(points) // TRIALS)][:TRIALS]:
        within = np.cumsum(np.bincount(_distances(points, vantage, block), minlength=65))
        copied = within - np.append(np.zeros(NEAR, np.int64), within[:-NEAR])
        work = within.astype(float) ** 2 + (len(points) - within + copied).astype(float) ** 2
        radius = int(np.argmin(work))
        if best is None or work[radius] < best[0]:
            best = work[radius], vantage, radius
    return best[1:] if best[0] < 0.9 * float(len(points)) ** 2 else None


def sides(points: np.ndarray, vantage: np.uint64, radius: int, block: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Masks of what goes inside, and outside: all beyond the radius and those inside that may have a partner there."""
    d = _distances(points, vantage, block)
    return d <= radius, d > radius - NEAR


def grow(sample: np.ndarray, block: np.uint64, leaves: int, tree: list) -> int:
    """Append the nodes of a tree of about ``leaves`` leaves to ``tree``; a node is (vantage, radius, inside, outside).

    Returns the place of the node, or -1 for a leaf."""
    cut = split(sample, block) if leaves > 1 and len(sample) > 1 else None
    if cut is None:
        return -1
    place = len(tree)
    tree.append(None)
    inside, outside = sides(sample, *cut, block)
    share = max(1, round(leaves * inside.sum() / (inside.sum() + outside.sum())))
    tree[place] = (*cut, grow(sample[inside], block, min(share, leaves - 1), tree), grow(sample[outside], block, max(1, leaves - share), tree))
    return place


def route(points: np.ndarray, block: np.uint64, tree: list) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, points): every two partners in this block meet in a leaf.  Leaves are numbered by their node and side."""
    todo = [(0 if tree else -1, 0, points)]
    while todo:
        place, leaf, own = todo.pop()
        if not len(own):
            continue
        if place < 0:
            yield leaf, own
            continue
        vantage, radius, inner, outer = tree[place]
        inside, outside = sides(own, vantage, radius, block)
        todo += [(inner, 2 * place + 1, own[inside]), (outer, 2 * place + 2, own[outside])]


def _reached(rest: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of a forest over the points: each point is taken out as it is reached."""
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            point = queue.pop()
            near = np.bitwise_count(rest ^ point) <= MOST_BITS
            if near.any():
                found, rest = rest[near], rest[~near]
                yield np.full(len(found), point), found
                queue.extend(found)


def links(points: np.ndarray, block: np.uint64, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect the distinct points as their pairs within ``MOST_BITS`` do, if within ``NEAR`` in the block."""
    out: list = []
    todo = [points]
    while todo:
        own = todo.pop()
        if len(own) > leaf and (cut := split(own, block)) is not None:
            inside, outside = sides(own, *cut, block)
            todo += [own[inside], own[outside]]
        elif len(own) <= leaf:
            a, b = np.nonzero(np.triu(np.bitwise_count(own[:, None] ^ own) <= MOST_BITS, 1))
            out.extend([(own[a], own[b])] if len(a) <= 2 * len(own) else _reached(own))
        else:
            out.extend(_reached(own))
    if not out:
        return (np.zeros(0, np.uint64),) * 2
    pairs = np.unique(np.array([np.concatenate(c) for c in zip(*out)]), axis=1)
    return pairs[0], pairs[1]


def near_links(nodes: DataFrame, shard: int = SHARD, leaf: int = LEAF) -> DataFrame:
    """(a, b): links that connect the distinct fingerprints of ``nodes`` (column fp) as all pairs within four bits do."""
    spark = nodes.sparkSession
    leaves = min(MOST_SHARDS, -(-nodes.count() // shard))
    sample = np.array([r.fp for r in nodes.orderBy(F.xxhash64("fp"), "fp").limit(leaves * SAMPLE).collect()], np.int64).view(np.uint64)
    forest: list[list] = []
    for block in BLOCKS:
        forest.append([])
        grow(sample, block, leaves, forest[-1])
    shared = spark.sparkContext.broadcast(forest)  # SAMPLE and MOST_SHARDS bound it
    stride = 2 * max(map(len, forest)) + 2

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k, block in enumerate(BLOCKS):
                for at, own in route(points, block, shared.value[k]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), k * stride + at, np.int32)), pa.array(own.view(np.int64))], ["shard", "fp"])

    def searched(key: tuple, table: pa.Table) -> pa.Table:
        points = np.unique(table.column("fp").to_numpy().view(np.uint64))
        a, b = links(points, BLOCKS[key[0].as_py() // stride], leaf)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return nodes.select("fp").mapInArrow(routed, "shard int, fp long").groupBy("shard").applyInArrow(searched, "a long, b long")


def classes(docs: DataFrame, width: int = WIDTH, shard: int = SHARD, leaf: int = LEAF) -> DataFrame:
    """(doc_id, fp long, component_id): documents joined by chains of fingerprints within four bits.

    component_id is the smallest doc_id of the group.  Null and empty texts have the fingerprint zero and are linked like
    any other.  Repeated rows come back as often; a null id is never the smallest, but for a group of null ids alone.  An
    empty table gives no rows.  Other columns are not read."""
    rows = stored(fingerprints(docs, width), "op12-fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "op12-nodes")
    edges = stored(near_links(nodes, shard, leaf), "op12-links")
    components = nodes.join(connected_components(edges).withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = components.groupBy("component").agg(F.min("first").alias("component_id"))
    named = components.join(smallest, "component").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


@query("op12_simhash")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    found = classes(documents(spark, folder))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
