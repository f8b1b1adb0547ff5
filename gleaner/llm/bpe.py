"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

Reading a piece byte by byte, the encoding of every prefix ends in exactly one token: the suffix of the prefix that is a
token and stays apart from the last token before it when the two are merged by the ranks.  Only positions from which a
longer token may still start can matter later; what all of them share is emitted.  The rest - the undecided bytes, the
last token at each open position - is the state.  States and transitions are made when a text first needs them, are kept
per worker, and look ahead by no more than the longest tokens.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import documents, slices
from gleaner.llm.pieces import parts
from gleaner.llm.registry import query

START, CLOSED = -1, -2
MOST_TRANSITIONS = 700_000
MOST_PIECES = 500_000
DECODE_TOKENS = 65_536


class Transducer:
    """Tokens of single pieces under ``ranks`` (token bytes to rank; every single byte must be there)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.open = {t[:k] for t in ranks for k in range(1, len(t))}
        self.longest = max(map(len, ranks))
        self.apart: dict[tuple[int, int], bool] = {}
        self.forget()

    def forget(self) -> None:
        """Drop all states; they are made again when needed."""
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.ends: dict[int, tuple[int, ...]] = {}
        self._state((START, b"", ()))

    def _state(self, state: tuple) -> int:
        if (n := self.number.get(state)) is None:
            n = self.number[state] = len(self.states)
            self.states.append(state)
        return n

    def merged(self, data: bytes) -> list[int]:
        """The merges carried out one by one; only used on the bytes of two neighbouring tokens."""
        run = [data[k : k + 1] for k in range(len(data))]
        never, get = 1 << 60, self.ranks.get
        found = [get(a + b, never) for a, b in zip(run, run[1:])]
        while found and (least := min(found)) != never:
            k = found.index(least)
            run[k : k + 2] = [run[k] + run[k + 1]]
            del found[k]
            if k < len(found):
                found[k] = get(run[k] + run[k + 1], never)
            if k:
                found[k - 1] = get(run[k - 1] + run[k], never)
        return [self.ranks[t] for t in run]

    def _apart(self, left: int, right: int) -> bool:
        known = self.apart.get((left, right))
        if known is None:
            known = self.merged((self.tokens[left] if left != START else b"") + self.tokens[right]) == [t for t in (left, right) if t != START]
            if len(self.apart) > MOST_TRANSITIONS:
                self.apart.clear()
            self.apart[left, right] = known
        return known

    def _move(self, number: int, byte: int) -> tuple[int, tuple[int, ...]]:
        before, pending, last = self.states[number]
        pending += bytes([byte])
        last = (before, *last)  # the last token at position 0, 1, ..; CLOSED where nothing can start any more
        n = len(pending)
        for k in range(max(0, n - self.longest), n):
            token = self.ranks.get(pending[k:])
            if token is not None and last[k] != CLOSED and self._apart(last[k], token):
                break
        else:
            raise ValueError("the ranks lack a single byte")
        last = (*last, token)
        heads = {k for k in range(n) if last[k] != CLOSED and pending[k:] in self.open}
        first = last[0] if 0 in heads else CLOSED
        heads.add(n)
        kept = set(heads)
        while len(heads) > 1:  # up to the last position that all ways share
            k = max(heads)
            heads.discard(k)
            k -= len(self.tokens[last[k]])
            heads.add(k)
            kept.add(k)
        root = back = heads.pop()
        if root:
            first = last[root] if pending[root:] in self.open or root == n else CLOSED
        out = []
        while back:
            out.append(last[back])
            back -= len(self.tokens[out[-1]])
        state = (first, pending[root:], tuple([last[k] if k in kept else CLOSED for k in range(root + 1, n + 1)]))
        return self._state(state), tuple(out[::-1])

    def _end(self, number: int) -> tuple[int, ...]:
        _, pending, last = self.states[number]
        k, out = len(pending), []
        while k:
            out.append(last[k - 1])
            k -= len(self.tokens[out[-1]])
        return tuple(out[::-1])

    def encode(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        if len(self.moves) > MOST_TRANSITIONS:
            self.forget()
        state, out, moves = 0, [], self.moves
        for byte in piece:
            move = moves.get(state << 8 | byte)
            if move is None:
                move = moves[state << 8 | byte] = self._move(state, byte)
            state = move[0]
            out += move[1]
        if (rest := self.ends.get(state)) is None:
            rest = self.ends[state] = self._end(state)
        out += rest
        return out


class Utf8Stream:
    """Incremental UTF-8: :meth:`feed` returns the text that is complete, and holds back an unfinished sequence."""

    #: bytes that follow a lead byte
    FOLLOW = [1 if 0xC2 <= b < 0xE0 else 2 if 0xE0 <= b < 0xF0 else 3 if 0xF0 <= b < 0xF5 else 0 for b in range(256)]

    def __init__(self):
        self.held = b""

    def feed(self, data: bytes, last: bool = False) -> str:
        data = self.held + data
        cut = len(data)
        if not last:
            for back in range(1, min(3, len(data)) + 1):
                byte = data[-back]
                if byte & 0xC0 != 0x80:
                    if self.FOLLOW[byte] >= back:
                        cut -= back
                    break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", errors="replace")


class ByteBpe:
    """Encoder and decoder for whole texts.

    ``pattern`` splits a text before the merges.  Its words must take one leading space (as the public patterns do), so
    that a text may be cut before any single space that a non-space follows; parts are encoded once and kept.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
        self.transducer = Transducer(ranks)
        self.table = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.table[r] = t
        # the splitting engine of the rank files counts the separators U+001C..U+001F as ordinary characters
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.dtype = np.dtype("<u2" if len(self.table) <= 65536 else "<u4")
        self.inner: dict[str, bytes] = {}

    def _pack(self, text: str) -> bytes:
        ids: list[int] = []
        for piece in self.pattern.findall(text):
            ids += self.transducer.encode(piece.encode())
        return np.array(ids, self.dtype).tobytes()

    def encode(self, text: str) -> np.ndarray:
        head, *rest = parts(text)
        if len(self.inner) > MOST_PIECES:
            self.inner.clear()
        inner = self.inner
        try:
            data = [inner[p] for p in rest]
        except KeyError:
            for p in rest:
                if p not in inner:
                    inner[p] = self._pack(" " + p)
            data = [inner[p] for p in rest]
        return np.frombuffer(self._pack(head) + b"".join(data), self.dtype)

    def decode(self, ids: np.ndarray) -> Iterator[str]:
        """The text of ids, chunk by chunk; sequences cut by a chunk's end go into the next one."""
        stream, get = Utf8Stream(), self.table.__getitem__
        for k in range(0, len(ids), DECODE_TOKENS):
            yield stream.feed(b"".join(map(get, ids[k : k + DECODE_TOKENS].tolist())))
        yield stream.feed(b"", last=True)


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>); null texts count as empty, repeated rows stay, other columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                ids = [bpe.encode(t).astype(np.int32) for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of ids; null ids count as none, bytes that are no UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks, pattern)
        for batch in batches:
            lists = batch.column(1)
            for k in range(len(lists)):
                ids = lists[k].values.to_numpy() if lists[k].is_valid else np.zeros(0, np.int32)
                text = "".join(bpe.decode(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([text], pa.string())], ["doc_id", "text"])

    return tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): the round trip of each text in one pass, chunk by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks, pattern)
        for batch in batches:
            counts, named, decoded = [], [], []
            for t in batch.column(1):
                ids = bpe.encode(t.as_py() or "")
                plain, back = hashlib.sha256(), hashlib.sha256()
                for k in range(0, len(ids), DECODE_TOKENS):
                    plain.update((" " * (k > 0) + " ".join(map(str, ids[k : k + DECODE_TOKENS].tolist()))).encode())
                for text in bpe.decode(ids):
                    back.update(text.encode())
                counts.append(len(ids))
                named.append(plain.hexdigest())
                decoded.append(back.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(named, pa.string()), pa.array(decoded, pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


@query("op4_byte_bpe")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return digests(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
