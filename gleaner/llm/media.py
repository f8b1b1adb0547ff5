"""Media columns: ISO media containers written, walked and described without decoding their payloads.

:func:`wrap` stores bytes as one track of 8-bit samples in access units of 64, grouped into chunks; the first unit of each
chunk is a sync sample.  :func:`probe` walks nested boxes of any container, decodes the sample tables (``stts``, ``stss``,
``stsc``, ``stsz``, ``stco``/``co64``) and tells codec, duration and the byte range of each keyframe; :func:`payload` gathers
the units from their ranges.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from struct import error as StructError
from struct import pack, unpack_from

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import documents, stored
from gleaner.llm.registry import query

UNIT = 64
CHUNK_UNITS = 64
RATE = 8000
#: boxes that hold boxes, and the bytes of their own fields before them
CONTAINERS = {b"moov": 0, b"trak": 0, b"edts": 0, b"mdia": 0, b"minf": 0, b"dinf": 0, b"stbl": 0, b"mvex": 0, b"udta": 0, b"moof": 0, b"traf": 0}
IDENTITY = pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *content: bytes) -> bytes:
    body = b"".join(content)
    return pack(">I4s", len(body) + 8, kind) + body if len(body) < (1 << 32) - 8 else pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *content: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, pack(">I", version << 24 | flags), *content)


def _table(kind: bytes, form: str, rows) -> bytes:
    array = np.asarray(rows, form)
    return _full(kind, pack(">I", len(array)), array.tobytes())


def padded(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of the unit."""
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT))


def wrap(data: bytes) -> bytes:
    """A container whose one track holds ``data``, a positive multiple of 64 bytes.  Equal data give equal bytes."""
    units = len(data) // UNIT
    chunks = -(-units // CHUNK_UNITS)
    last = units - (chunks - 1) * CHUNK_UNITS
    runs = [(1, CHUNK_UNITS, 1)] if last == CHUNK_UNITS else [(1, last, 1)] if chunks == 1 else [(1, CHUNK_UNITS, 1), (chunks, last, 1)]
    entry = _box(b"raw ", bytes(6), pack(">H", 1), bytes(8), pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    wide = len(data) > 1 << 31

    def moov(first: int) -> bytes:
        offsets = first + np.arange(chunks, dtype=np.int64) * UNIT * CHUNK_UNITS
        tables = _box(
            b"stbl", _full(b"stsd", pack(">I", 1), entry), _table(b"stts", ">u4", [(units, UNIT)]),
            _table(b"stss", ">u4", 1 + np.arange(chunks) * CHUNK_UNITS), _table(b"stsc", ">u4", runs),
            _full(b"stsz", pack(">II", UNIT, units)), _table(b"co64" if wide else b"stco", ">u8" if wide else ">u4", offsets))
        source = _box(b"dinf", _full(b"dref", pack(">I", 1), _full(b"url ", flags=1)))
        times = pack(">QQIQ", 0, 0, RATE, len(data)) if wide else pack(">IIII", 0, 0, RATE, len(data))
        media = _box(b"mdia", _full(b"mdhd", times, pack(">HH", 0x55C4, 0), version=int(wide)),
                     _full(b"hdlr", bytes(4), b"soun", bytes(12), b"bytes\0"), _box(b"minf", _full(b"smhd", bytes(4)), source, tables))
        head = pack(">QQIIQ", 0, 0, 1, 0, len(data)) if wide else pack(">IIIII", 0, 0, 1, 0, len(data))
        track = _box(b"trak", _full(b"tkhd", head, bytes(8), pack(">HHHH", 0, 0, 0x0100, 0), IDENTITY, bytes(8), version=int(wide), flags=7), media)
        return _box(b"moov", _full(b"mvhd", times, pack(">IHH", 0x10000, 0x0100, 0), bytes(8), IDENTITY, bytes(24), pack(">I", 2), version=int(wide)), track)

    brand = _box(b"ftyp", b"qt  ", bytes(4), b"qt  ")
    start = len(brand) + len(moov(0)) + (16 if len(data) >= (1 << 32) - 8 else 8)
    return brand + moov(start) + _box(b"mdat", data)


def boxes(data, begin: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, begin, end) of the content of each box, parents first.  Sizes of 64 bits and 'up to the end' are understood;
    a box that goes beyond its parent ends the walk there."""
    end = len(data) if end is None else end
    while begin + 8 <= end:
        size, kind = unpack_from(">I4s", data, begin)
        head = 8
        if size == 1 and begin + 16 <= end:
            (size,), head = unpack_from(">Q", data, begin + 8), 16
        elif size == 0:
            size = end - begin
        if size < head or begin + size > end:
            return
        here = (*path, kind)
        yield here, begin + head, begin + size
        if kind in CONTAINERS:
            yield from boxes(data, begin + head + CONTAINERS[kind], begin + size, here)
        begin += size


def _rows(data, begin: int, end: int, form: str, width: int) -> np.ndarray:
    (count,) = unpack_from(">I", data, begin + 4)
    size = np.dtype(form).itemsize * width
    if begin + 8 + count * size > end:
        raise ValueError("a sample table is cut off")
    return np.frombuffer(data, form, count * width, begin + 8).astype(np.int64).reshape(count, width)


def tracks(data) -> list[dict]:
    """codec, timescale, duration, offsets, sizes, times and sync flags of the samples of each track."""
    out: list[dict] = []
    for path, begin, end in boxes(data):
        kind = path[-1]
        if kind == b"trak":
            out.append({"sync": None})
        elif not out or b"trak" not in path:
            continue
        elif kind == b"mdhd":
            out[-1]["timescale"], out[-1]["duration"] = unpack_from(">IQ", data, begin + 20) if data[begin] else unpack_from(">II", data, begin + 12)
        elif kind == b"stsd":
            out[-1]["codec"] = bytes(data[begin + 12 : begin + 16]).decode("latin-1")
        elif kind == b"stts":
            out[-1]["stts"] = _rows(data, begin, end, ">u4", 2)
        elif kind == b"stss":
            out[-1]["sync"] = _rows(data, begin, end, ">u4", 1)[:, 0] - 1
        elif kind == b"stsc":
            out[-1]["stsc"] = _rows(data, begin, end, ">u4", 3)
        elif kind == b"stsz":
            size, count = unpack_from(">II", data, begin + 4)
            out[-1]["sizes"] = np.full(count, size, np.int64) if size else _rows(data, begin + 4, end, ">u4", 1)[:, 0]
        elif kind in (b"stco", b"co64"):
            out[-1]["chunks"] = _rows(data, begin, end, ">u4" if kind == b"stco" else ">u8", 1)[:, 0]
    for track in out:
        runs, chunks, sizes = track.pop("stsc"), track.pop("chunks"), track["sizes"]
        of_chunk = np.zeros(len(chunks), np.int64)
        for (first, each, _), until in zip(runs, [*(runs[1:, 0] - 1), len(chunks)]):
            of_chunk[first - 1 : until] = each
        chunk = np.repeat(np.arange(len(chunks)), of_chunk)[: len(sizes)]
        before = np.cumsum(sizes) - sizes
        opened = before[np.minimum(np.cumsum(of_chunk) - of_chunk, max(0, len(sizes) - 1))] if len(sizes) else before
        track["offsets"] = chunks[chunk] + before - opened[chunk] if len(sizes) else before
        counts = track.pop("stts")
        lasting = np.repeat(counts[:, 1], counts[:, 0])
        track["times"] = np.cumsum(lasting) - lasting
        flags = np.ones(len(sizes), bool) if track["sync"] is None else np.isin(np.arange(len(sizes)), track["sync"])
        track["sync"] = flags
    return out


def describe(data) -> str:
    """Codec, rate, duration, samples and keyframe byte ranges (offset+length) of the first track; empty where ``data``
    is no container, lacks a track or is cut off inside its tables."""
    try:
        track = tracks(data)[0]
    except (KeyError, IndexError, ValueError, StructError):
        return ""
    keys = ",".join(f"{o}+{n}" for o, n in zip(track["offsets"][track["sync"]].tolist(), track["sizes"][track["sync"]].tolist()))
    return f"codec={track['codec'].strip()};timescale={track['timescale']};duration={track['duration']};samples={len(track['sizes'])};keyframes={keys}"


def payload(data) -> bytes:
    """The samples of the first track in order; neighbours in the file are copied together."""
    track = tracks(data)[0]
    offsets, sizes = track["offsets"], track["sizes"]
    if not len(sizes):
        return b""
    starts = np.flatnonzero(np.append(True, offsets[1:] != offsets[:-1] + sizes[:-1]))
    ends = np.append(starts[1:], len(sizes)) - 1
    return b"".join(bytes(data[a:b]) for a, b in zip(offsets[starts].tolist(), (offsets[ends] + sizes[ends]).tolist()))


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media binary): each text's bytes in a container of its own; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                data = [(t.as_py() or "").encode() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, data), pa.int64()), pa.array([wrap(padded(d)) for d in data], pa.binary())],
                                                 ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def probe(media: DataFrame, column: str = "media") -> DataFrame:
    """All columns but ``column``, and payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, read
    from the stored bytes.  Bytes that are no container have an empty feature and no payload."""
    kept = [c for c in media.columns if c != column]
    names = [*kept, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(len(kept)):
                data = memoryview(value.as_buffer()) if value.is_valid else memoryview(b"")
                feature = describe(data)
                own = payload(data) if feature else b""
                rows.append((len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *columns], names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema if f.name != column)
    return media.select(*kept, column).mapInArrow(run, f"{fields}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


@query("op5_media")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return probe(stored(store(documents(spark, folder)), "op5-media"))
