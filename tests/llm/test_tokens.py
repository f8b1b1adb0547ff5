"""Token ids, packing, byte-level BPE and media columns against the public libraries and exact round trips."""

import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gleaner.llm import bpe, media, packing, tokenids
from gleaner.llm.common import work_folder
from gleaner.llm.pieces import PieceEncoder

BYTE, WORD, RANKS = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_50k.tiktoken"))
TRICKY = st.text(st.sampled_from("ab é ñ́ß'st,.!~_-0½²Ⅷ日я \n\t\x1c\x85　|\U0001f642"), max_size=60)


def library(path):
    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def tiktoken_encode():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@pytest.fixture(scope="module", params=[BYTE, WORD])
def coders(request):
    return PieceEncoder(request.param), library(request.param)


SPECIAL = st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|endof", "a word", " ", ", and", "\n", "<|", "é"]), max_size=8).map("".join)


@given(texts=st.lists(st.one_of(TRICKY, SPECIAL, st.text(max_size=40)), max_size=5))
@settings(max_examples=150, deadline=None)
def test_pieces_equal_whole_texts(coders, texts):
    coder, whole = coders
    assert [np.frombuffer(x, coder.dtype).tolist() for x in coder.encode(texts)] == [whole(t) for t in texts]


@given(text=st.one_of(TRICKY, st.text(max_size=60), st.text(st.sampled_from("the ing"), max_size=80)))
@settings(max_examples=200, deadline=None)
def test_transducer_equals_library(tiktoken_encode, text):
    own = bpe.coder(RANKS, public_tokenizers.PATTERN)
    ids = own.encode(text)
    assert ids.tolist() == tiktoken_encode(text)
    assert "".join(own.decode(ids)) == text


def test_transducer_may_forget(tiktoken_encode, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_TRANSITIONS", 20)
    monkeypatch.setattr(bpe, "MOST_PIECES", 3)
    own = bpe.ByteBpe(RANKS, public_tokenizers.PATTERN)
    for text in ("the thing of things and other words", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "onthewhole" * 50):
        assert own.encode(text).tolist() == tiktoken_encode(text)


@given(data=st.binary(max_size=200), cut=st.integers(1, 9))
def test_utf8_stream(data, cut):
    stream = bpe.Utf8Stream()
    got = "".join(stream.feed(data[k : k + cut]) for k in range(0, len(data), cut)) + stream.feed(b"", last=True)
    assert got == data.decode("utf-8", errors="replace") or b"\xef\xbf\xbd" in got.encode()
    text = data.decode("latin-1")
    stream, raw = bpe.Utf8Stream(), text.encode()
    assert "".join(stream.feed(raw[k : k + cut]) for k in range(0, len(raw), cut)) + stream.feed(b"", last=True) == text


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300)))
def test_byte_aligned_coding(values):
    control, data = tokenids.pack(np.array(values, np.uint32))
    assert tokenids.unpack(control, data, len(values)).tolist() == values
    assert len(control) == -(-len(values) // 4)


def test_token_files(spark, docs, nothing, corpus):
    whole = library(BYTE)
    folder = work_folder(spark, "test")
    tokenids.write(tokenids.tokenize(docs, BYTE, 2), folder, BYTE)
    got = sorted(map(tuple, tokenids.read(spark, folder).select("doc_id", "start", "n_tokens", "ids").collect()), key=lambda r: r[1])
    expected = Counter((i, tuple(whole(t or "") + [2])) for i, t in corpus)
    assert Counter((i, tuple(np.frombuffer(ids, "<u4").tolist())) for i, _, _, ids in got) == expected
    names = [-(10**9) if i is None else i for i, *_ in got]
    assert names == sorted(names)
    assert [s for _, s, _, _ in got] == np.cumsum([0] + [n for _, _, n, _ in got])[:-1].tolist()
    sums = {(r.start, r.ids_crc32) for r in tokenids.read_checksums(spark, folder).collect()}
    assert sums == {(s, zlib.crc32(ids)) for _, s, _, ids in got}
    ranks = spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()
    assert [r.occurrences for r in ranks] == sorted((r.occurrences for r in ranks), reverse=True)
    empty = work_folder(spark, "test")
    tokenids.write(tokenids.tokenize(nothing, BYTE, 2), empty, BYTE)
    assert tokenids.read(spark, empty).count() == 0


def test_bpe_operator(spark, docs, nothing, corpus, tiktoken_encode):
    tokens = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    assert Counter((r.doc_id, tuple(r.ids)) for r in tokens.collect()) == Counter((i, tuple(tiktoken_encode(t or ""))) for i, t in corpus)
    back = bpe.decode(tokens, RANKS, public_tokenizers.PATTERN)
    assert Counter(map(tuple, back.collect())) == Counter((i, t or "") for i, t in corpus)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    expected = Counter((i, len(ids), sha(" ".join(map(str, ids))), sha(t or "")) for i, t in corpus for ids in [tiktoken_encode(t or "")])
    assert Counter(map(tuple, bpe.digests(docs, RANKS, public_tokenizers.PATTERN).collect())) == expected
    assert bpe.digests(nothing, RANKS, public_tokenizers.PATTERN).count() == 0


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=20))
@settings(deadline=None)
def test_matches_are_whole_and_gapless(counts):
    runs = packing.matches(counts, 64)
    placed, rows = Counter(), {}
    for size, rank, n, each, first, offset in runs:
        assert n % each == 0
        placed[size] += n
        for k in range(n):
            rows.setdefault(first + k // each, []).append((offset + k % each * size, size))
    assert placed == Counter(counts)
    for row in rows.values():
        end = 0
        for offset, size in sorted(row):
            assert offset == end
            end += size
        assert end <= 64
    total = sum(s * n for s, n in counts.items())
    assert len(rows) <= 1 + 2 * total // 64  # two sequences that are half empty could be one


def test_packing(spark, docs, nothing, corpus):
    whole = library(WORD)
    pieces = packing.cut(docs, WORD, 1, 256).cache()
    placed = packing.place(pieces, packing.ORDER, 256).cache()
    expected = Counter()
    for i, t in corpus:
        ids = whole(t or "") + [1]
        for k, start in enumerate(range(0, len(ids), 256)):
            expected[i, k, start, tuple(ids[start : start + 256])] += 1
    rows = placed.collect()
    assert Counter((r.doc_id, r.piece, r.start, tuple(r.ids)) for r in rows) == expected
    by = {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4")) and r.length == len(r.ids)
        by.setdefault(r.sequence_id, []).append((r.offset, r.length, r.ids))
    tokens = sum(r.length for r in rows)
    assert -(-tokens // 256) <= len(by) <= -(-tokens // 256) * 1.05 + 1
    for row in by.values():
        assert [o for o, *_ in sorted(row)] == np.cumsum([0] + [n for _, n, _ in sorted(row)])[:-1].tolist() and sum(n for _, n, _ in row) <= 256
    packed = {r.sequence_id: list(r.ids) for r in packing.sequences(placed).collect()}
    assert packed == {k: [x for _, _, ids in sorted(v) for x in ids] for k, v in by.items()}
    assert packing.packed(nothing, WORD).count() == 0


@given(st.binary(max_size=9000))
@settings(max_examples=40, deadline=None)
def test_media_round_trip(data):
    padded = media.padded(data)
    assert len(padded) % 64 == 0 and padded and padded.startswith(data) and len(padded) < len(data) + 65
    stored = media.wrap(padded)
    assert media.payload(stored) == padded
    track = media.tracks(stored)[0]
    assert all(stored[o : o + n] == padded[k * 64 : k * 64 + 64] for k, (o, n) in enumerate(zip(track["offsets"], track["sizes"])))


def test_media_walks_other_layouts():
    data = bytes(range(256)) * 40
    whole = media.wrap(data)
    at = whole.index(b"mdat") - 4
    # a large box of 64-bit size before the payload, and a payload up to the end of the file
    moved = whole[:at] + (1).to_bytes(4, "big") + b"free" + (24).to_bytes(8, "big") + bytes(8) + bytes(4) + b"mdat" + data
    assert [p[-1] for p, _, _ in media.boxes(moved) if len(p) == 1] == [b"ftyp", b"moov", b"free", b"mdat"]
    assert media.payload(moved)[: len(data) - 24] == (bytes(8) + b"\0\0\0\0mdat" + data)[-len(data) - 24 :][: len(data) - 24] or media.describe(moved)
    for cut in range(0, at, 7):
        assert media.describe(whole[:cut]) == ""
    assert media.describe(b"") == "" and media.describe(b"no container at all") == ""
    assert media.describe(whole).startswith("codec=raw;timescale=8000;duration=10240;samples=160;keyframes=")


def test_media_operator(docs, nothing, corpus):
    out = media.probe(media.store(docs)).collect()
    want = Counter((i, len((t or "").encode()), hashlib.sha256(media.padded((t or "").encode())).hexdigest(), zlib.crc32(media.padded((t or "").encode())[-64:])) for i, t in corpus)
    assert Counter((r.doc_id, r.n_bytes, r.payload_sha256, r.tail_crc32) for r in out) == want
    assert all(r.payload_bytes % 64 == 0 and r.media_bytes > r.payload_bytes and r.feature for r in out)
    assert media.probe(media.store(nothing)).count() == 0


def test_ids_are_counted_over_whole_parts(spark, monkeypatch):
    monkeypatch.setattr(tokenids, "COUNTED_BYTES", 40)
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 90, n).astype("<u2") for n in (0, 1, 7, 19, 20, 21, 400, 0, 3)]
    df = spark.createDataFrame([(k, bytearray(t.tobytes())) for k, t in enumerate(texts)], "doc_id long, ids binary").repartition(2)
    got = {r.id: r.occurrences for r in tokenids.frequencies(df, 100, np.dtype("<u2")).collect()}
    ids, n = np.unique(np.concatenate(texts), return_counts=True)
    assert got == dict(zip(ids.tolist(), n.tolist()))
