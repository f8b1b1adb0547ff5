"""Removal of long strings that occur twice anywhere in a corpus, by blockwise suffix sorting with a difference cover.

Suffixes are compared by their first ``LENGTH`` bytes only, as fingerprints: equal prefixes are what matters, not their
order.  Sorting every suffix would move the corpus many times over, so, as in blockwise construction:

1.  Cover samples.  Of every ``v`` positions of a text those in a difference cover are sampled, ``p + 1`` of
    ``v = p * p + p + 1``.  For any two positions i and j there is one d < v such that i + d and j + d are both samples.
    So if the prefixes at i and j are equal, so are the samples' names at i + d and j + d, names of ``LENGTH - v + 1``
    bytes.  Samples are sorted by name once, and those whose rank ties with another one's are kept.
2.  Blocks.  Only suffixes with a tied sample in their first v bytes can have an equal; their stretches of text are stored.
    They are sorted one block of fingerprints at a time, which bounds disk and memory, ``BLOCKS`` times.
3.  Suffixes that are equal to another one mark their bytes, runs of marks become spans, and spans are cut from all copies.

Texts that are equal as a whole are handled once, and their copies by count.  Within a run of texts each fingerprint is
sent once: a passage that a third of all documents share makes one row per run, not one per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import wordhash as H
from gleaner.llm.common import documents, release, slices, stored
from gleaner.llm.registry import query

LENGTH = 200
PRIME = 11
BLOCKS = 4
SHARD_CHARS = 12_000_000
FOUND = "home int, texts binary, positions binary"


def difference_cover(prime: int) -> np.ndarray:
    """Positions of a perfect difference cover of the residues modulo prime**2 + prime + 1: zeros of a linear recurrence."""
    period = prime * prime + prime + 1
    for code in range(prime**3):
        a, b, c = code % prime, code // prime % prime, code // prime**2
        s = [0, 0, 1]
        while len(s) < period:
            s.append((a * s[-1] + b * s[-2] + c * s[-3]) % prime)
        zeros = [n for n, x in enumerate(s) if x == 0]
        if len(zeros) == prime + 1 and len({(x - y) % period for x in zeros for y in zeros}) == period:
            return np.array(zeros)
    raise ValueError("no cover for this number")


def fingerprints(data: np.ndarray, positions: np.ndarray, length: int) -> np.ndarray:
    """64-bit fingerprints of data[p : p + length]."""
    sums = H.prefix_sums(data)
    _, inverse = H.powers(len(data) + 1)
    return H.mixed((sums[positions + length] - sums[positions]) * inverse[positions])


def sampler(length: int, prime: int):
    """Entries of texts: (position, 40 + more bits of the sample's name)."""
    cover = difference_cover(prime)
    period = prime * prime + prime + 1
    name = length - period + 1

    def samples(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        last = len(data) - name
        if last < 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint8)
        positions = (np.arange(0, last + 1, period)[:, None] + cover).ravel()
        positions = positions[positions <= last]
        names = fingerprints(data, positions, name)
        return positions, names, (names >> np.uint64(32)).astype(np.uint8)

    return samples


def suffixes(length: int, block: int, blocks: int):
    """Entries of stretches: (position, fingerprint, one of the first half) of the suffixes of one block.

    Strings whose fingerprints agree by chance differ in both halves, so the second number tells them apart."""

    def entries(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, half = len(data) - length + 1, length // 2
        sums = H.prefix_sums(data)
        _, inverse = H.powers(len(data) + 1)
        first = H.mixed((sums[length:] - sums[:n]) * inverse[:n])
        own = np.flatnonzero(first % np.uint64(blocks) == np.uint64(block))
        second = H.mixed((sums[own + half] - sums[own]) * inverse[own])
        return own, first[own], (second >> np.uint64(32)).astype(np.uint32)

    return entries


def repeats(source: DataFrame, entries: Callable, shards: int, name_bits: int, homes: int) -> DataFrame:
    """(home, texts, positions) of all entries whose fingerprint another entry has too.

    ``source`` has text_id, start, data.  Of equal entries in one run of rows the first goes to the shard of its
    fingerprint; all of them are found on the spot.
    """
    main, extra = ("<u4", "u1") if name_bits == 40 else ("<u8", "<u4")

    def runs(batches: Iterator[pa.RecordBatch]):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)))
            fresh = []
            for text, start, data in rows:
                if (text, start) not in seen:
                    seen.add((text, start))
                    fresh.append((text, start, data))
            for a, b in slices([x[2].as_buffer() for x in fresh], 8_000_000):
                names, found = np.array([x[0] for x in fresh[a:b]], np.int64), []
                for ref, (_, start, data) in enumerate(fresh[a:b]):
                    positions, one, two = entries(np.frombuffer(data.as_buffer(), np.uint8))
                    if len(positions):
                        found.append((np.full(len(positions), ref, np.uint32), (positions + start).astype(np.uint32), one, two))
                if found:
                    refs, positions, one, two = (np.concatenate(c) for c in zip(*found))
                    yield names, refs, positions, one, two, *_ties(one, two)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, refs, positions, one, two, first, several in runs(batches):
            own = np.flatnonzero(first)
            yield from packed(names, refs, positions, own, (one[own] >> np.uint64(40)).astype(np.int64) % shards, shards, one, two)
            own = np.flatnonzero(several)
            yield from packed(names, refs, positions, own, _home(names, homes)[refs[own]], homes)

    def packed(names, refs, positions, own, part, parts, one=None, two=None) -> Iterator[pa.RecordBatch]:
        """Entries by shard, or, below 0, what is settled already by home."""
        for k, rows in _split(part, parts):
            rows = own[rows]
            used = np.zeros(len(names), bool)
            used[refs[rows]] = True
            place = np.cumsum(used, dtype=np.int64) - 1
            columns = [names[used], place[refs[rows]].astype("<u4"), positions[rows].astype("<u4")]
            columns += [np.zeros(0, "u1")] * 2 if one is None else [one[rows].astype(main), two[rows].astype(extra)]
            yield pa.RecordBatch.from_arrays([pa.array([-1 - k if one is None else k], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in columns)],
                                             ["shard", "texts", "refs", "positions", "one", "two"])

    def meet(table: pa.Table) -> pa.Table:
        read = lambda c, kind: [np.frombuffer(x.as_buffer(), kind) for x in table.column(c)]
        texts = np.concatenate([t[r] for t, r in zip(read("texts", "<i8"), read("refs", "<u4"))])
        positions = np.concatenate(read("positions", "<u4"))
        if table.column("shard")[0].as_py() < 0:
            return _by_home(texts, positions, homes)
        one, two = (np.concatenate(read(c, k)) for c, k in (("one", main), ("two", extra)))
        _, several = _ties(one, two)
        texts, positions, one, two = texts[several], positions[several], one[several], two[several]
        order = np.lexsort((positions, texts, two, one))
        texts, positions, one, two = texts[order], positions[order], one[order], two[order]
        fresh = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (texts[1:] != texts[:-1]) | (positions[1:] != positions[:-1])) if len(one) else np.zeros(0, bool)
        texts, positions, one, two = texts[fresh], positions[fresh], one[fresh], two[fresh]  # a text that several tasks met
        _, several = _ties(one, two)
        return _by_home(texts[several], positions[several], homes)

    rows = source.select("text_id", "start", "data")
    posted = rows.mapInArrow(post, "shard int, texts binary, refs binary, positions binary, one binary, two binary")
    return posted.groupBy("shard").applyInArrow(meet, FOUND)


def _ties(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of entries with both numbers equal: which is the first met, and which are not alone."""
    first, several = np.zeros(len(one), bool), np.zeros(len(one), bool)
    if not len(one):
        return first, several
    order = np.argsort(one)
    same = one[order[1:]] == one[order[:-1]]
    if (same & (two[order[1:]] != two[order[:-1]])).any():
        order = np.lexsort((two, one))
        same = (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]])
    new = np.append(True, ~same)
    first[order[new]] = True
    several[order] = ~(new & np.append(new[1:], True))
    return first, several


def _split(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """The indices of each part that has any."""
    order = np.argsort(part.astype(np.uint16 if parts <= 65536 else np.int64), kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    for k in np.flatnonzero(np.diff(cuts)):
        yield int(k), order[cuts[k] : cuts[k + 1]]


def _home(texts: np.ndarray, homes: int) -> np.ndarray:
    return (H.mixed(texts.view(np.uint64)) >> np.uint64(33)).astype(np.int64) % homes


def _by_home(texts: np.ndarray, positions: np.ndarray, homes: int) -> pa.Table:
    packed = [(k, texts[own].tobytes(), positions[own].astype("<u4").tobytes()) for k, own in _split(_home(texts, homes), homes)]
    columns = zip(*packed) if packed else [[], [], []]
    return pa.table([pa.array(list(c), k) for c, k in zip(columns, (pa.int32(), pa.binary(), pa.binary()))], names=["home", "texts", "positions"])


def _positions(table: pa.Table) -> dict[int, np.ndarray]:
    """Sorted distinct positions of each text of a home."""
    if not table.num_rows:
        return {}
    texts = np.concatenate([np.frombuffer(x.as_buffer(), "<i8") for x in table.column("texts")])
    positions = np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in table.column("positions")])
    names, refs = np.unique(texts, return_inverse=True)
    keys = np.unique(refs.astype(np.uint64) << np.uint64(32) | positions)
    cuts = np.searchsorted(keys >> np.uint64(32), np.arange(len(names) + 1))
    positions = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return {name: positions[a:b] for name, a, b in zip(names.tolist(), cuts[:-1], cuts[1:])}


def covered(positions: np.ndarray, before: int, after: int, size: int) -> np.ndarray:
    """Begins and ends, as rows, of the union of [p - before, p + after) within [0, size)."""
    begins, ends = np.maximum(positions - before, 0), np.minimum(positions + after, size)
    if not len(begins):
        return np.zeros((0, 2), np.int64)
    new = np.append(True, begins[1:] > ends[:-1])
    return np.stack([begins[new], ends[np.append(np.flatnonzero(new)[1:], len(ends)) - 1]], axis=1)


def stretches(texts: DataFrame, tied: DataFrame, length: int, period: int, homes: int) -> DataFrame:
    """(text_id, start, data): the parts of texts whose suffixes have a tied sample in their first ``period`` bytes."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            fresh = [k for k, x in enumerate(ids.tolist()) if not (x in seen or seen.add(x))]
            if fresh:
                kept = batch.take(pa.array(fresh))
                yield pa.RecordBatch.from_arrays([pa.array(_home(ids[fresh], homes), pa.int32()), kept.column(0), kept.column(2)], ["home", "text_id", "data"])

    def cut(own: pa.Table, hits: pa.Table) -> pa.Table:
        found, rows = _positions(hits), []
        for text, data in zip(own.column("text_id").to_pylist(), own.column("data")):
            positions = found.pop(text, None)
            if positions is None:
                continue
            buffer = data.as_buffer()
            for a, b in covered(positions, period - 1, 1, len(buffer) - length + 1).tolist():
                if a < b:
                    rows.append((text, a, buffer[a : b + length - 1].to_pybytes()))
        columns = zip(*rows) if rows else [[], [], []]
        return pa.table([pa.array(list(c), k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], names=["text_id", "start", "data"])

    sent = texts.select("text_id", "start", "data").mapInArrow(send, "home int, text_id long, data binary")
    return sent.groupBy("home").cogroup(tied.groupBy("home")).applyInArrow(cut, "text_id long, start long, data binary")


def spans(found: DataFrame, length: int) -> DataFrame:
    """(text_id, spans binary): begins and ends, 64 bits each, of the bytes under repeated strings."""

    def join(table: pa.Table) -> pa.Table:
        rows = [(text, covered(positions, 0, length, 1 << 62).astype("<i8").tobytes()) for text, positions in _positions(table).items()]
        columns = zip(*rows) if rows else [[], []]
        return pa.table([pa.array(list(c), k) for c, k in zip(columns, (pa.int64(), pa.binary()))], names=["text_id", "spans"])

    return found.groupBy("home").applyInArrow(join, "text_id long, spans binary")


def repeated_spans(docs: DataFrame, length: int = LENGTH, prime: int = PRIME) -> DataFrame:
    """``docs`` (with a column ``text``) and text_id long, copies long, spans binary (null: none).

    Texts of ``length`` bytes and more that occur as a whole more than once have copies > 1; all their bytes repeat.
    """
    docs = docs.withColumn("text_id", F.xxhash64("text"))
    rows = docs.select("text_id", F.lit(0).cast("long").alias("start"), F.col("text").cast("binary").alias("data")).where(F.octet_length("data") >= length)
    chars = rows.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    shards = max(1, -(-chars // SHARD_CHARS))
    period = prime * prime + prime + 1
    tied = stored(repeats(rows, sampler(length, prime), shards, 40, shards), "op1-tied")
    release(docs.sparkSession)
    parts = stored(stretches(rows, tied, length, period, shards), "op1-stretches")
    release(docs.sparkSession)
    size = parts.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    own_shards = max(1, -(-size // SHARD_CHARS))
    found = None
    for block in range(BLOCKS):
        one = stored(repeats(parts, suffixes(length, block, BLOCKS), own_shards, 96, shards), f"op1-block{block}")
        found = one if found is None else found.unionByName(one)
        release(docs.sparkSession)
    marked = stored(spans(found, length), "op1-spans")
    copies = rows.groupBy("text_id").agg(F.count("*").alias("copies")).where("copies > 1")
    facts = marked.join(copies, "text_id", "full")
    return docs.join(facts, "text_id", "left").withColumn("copies", F.coalesce("copies", F.lit(1).cast("long")))


def _rest(data: bytes, own: bytes | None, copies: int, length: int) -> tuple[bytes, int]:
    """What is left of a text, and the number of its removed runs."""
    if copies > 1 and len(data) >= length:
        return b"", 1
    if own is None:
        return data, 0
    cuts = np.frombuffer(own, "<i8").reshape(-1, 2).tolist()
    edges = [0, *(x for pair in cuts for x in pair), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])), len(cuts)


def removed(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): each text without the bytes under strings of ``length`` bytes
    that start at two places or more of the corpus, judged on the input, overlaps and places in one text included.

    Null texts count as empty, texts shorter than ``length`` stay, repeated rows are copies of one another, an empty table
    gives no rows, other columns are left out.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, own, copies in zip(batch.column(1), batch.column(2), batch.column(3)):
                data = bytes(text.as_buffer())
                rest, runs = _rest(data, own.as_py(), copies.as_py(), length)
                rows.append((len(data), len(data) - len(rest), runs, hashlib.sha256(rest).hexdigest()))
            columns = zip(*rows) if rows else [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = repeated_spans(rows, length).select("doc_id", "text", "spans", "copies")
    return found.mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cleaned(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` (with text and n_chars, all columns kept) with the repeated strings cut out of their texts.

    A character that loses a byte goes as a whole; n_chars counts what is left; null texts stay null."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for known, text, own, copies in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), batch.column(4)):
                rest, _ = _rest(bytes(text.as_buffer()), own.as_py(), copies.as_py(), length)
                texts.append(rest.decode("utf-8", errors="ignore") if known else None)
            counts = [None if t is None else len(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], ["row", "rest", "chars"])

    rows = docs.select(F.struct("*").alias("row"), F.col("text").isNotNull().alias("known"), F.coalesce("text", F.lit("")).alias("text"))
    rest = repeated_spans(rows, length).select("row", "known", "text", "spans", "copies").mapInArrow(cut, f"row {docs.schema.simpleString()}, rest string, chars long")
    new = {"text": F.col("rest"), "n_chars": F.col("chars")}
    return rest.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


@query("op1_suffix_dedup")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return removed(documents(spark, folder))
