"""Language-model scores: an n-gram model kept as Elias-Fano tries, built and queried in shards.

Documents are dealt to homes by a hash of their ids.  Each home counts its distinct words and word pairs first, so the
most frequent of them cost one row per home.  Words go to shards that add up the training counts and return them; pairs go
to shards by a hash of both words (no context is hot), where they become a trie of three Elias-Fano lists: the contexts,
the monotone pointers to their successors, and the successors relative to their context.  Counts are quantised to one
byte, which has no ceiling: the few too large for it are kept exactly behind the bytes.  The same shard answers the homes' pairs by successor search, and the homes add up

    p(w | v) = (1 - l) c(v, w) / c(v) + l p(w),    p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1))

with l from the training data: for contexts of a similar count, their distinct successors T over T + C, C all successors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import wordhash as H
from gleaner.llm.common import documents, release, stored
from gleaner.llm.registry import query

HOME_CHARS = 12_000_000
FOLDS = 10
END, BEGIN = np.uint64(0x0E4D), np.uint64(0xBE61)
ID_BITS = 24
LEVELS = 32


class EliasFano:
    """A non-decreasing sequence in about 2 + log2(universe / n) bits a number: high parts in unary, low parts in bytes.

    ``data`` is a flat buffer of bytes, which may be a memory-mapped file."""

    @staticmethod
    def pack(values: np.ndarray) -> bytes:
        values = values.astype(np.uint64, copy=False)
        n = len(values)
        low = max(0, int(values[-1]).bit_length() - max(n, 1).bit_length() + 1) if n else 0
        low = -(-low // 8) * 8  # low parts are whole bytes
        high = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(high[-1]) + 2 if n else 1, np.uint8)
        bits[high] = 1
        lows = values.view(np.uint8).reshape(n, 8)[:, : low // 8] if n else np.zeros((0, 0), np.uint8)
        head = np.array([n, low, len(bits)], "<i8")
        return b"".join([head.tobytes(), lows.tobytes(), np.packbits(bits).tobytes()])

    def __init__(self, data):
        self.n, self.low, size = np.frombuffer(data, "<i8", 3).tolist()
        width = self.low // 8
        lows = np.frombuffer(data, np.uint8, self.n * width, 24).reshape(self.n, width)
        self.lows = np.zeros(self.n, np.uint64)
        for k in range(width):
            self.lows |= lows[:, k].astype(np.uint64) << np.uint64(8 * k)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, -(-size // 8), 24 + self.n * width), count=size)
        zeros = np.flatnonzero(bits == 0)
        #: how many values have a high part below 0, 1, 2, ..
        self.below = np.concatenate([[0], zeros - np.arange(len(zeros))])
        self.highs = np.flatnonzero(bits) - np.arange(self.n)

    def get(self, index: np.ndarray) -> np.ndarray:
        return self.highs[index].astype(np.uint64) << np.uint64(self.low) | self.lows[index]

    def successor(self, keys: np.ndarray) -> np.ndarray:
        """Index of the first value that is at least the key, for each key; n where there is none."""
        keys = keys.astype(np.uint64, copy=False)
        high = (keys >> np.uint64(self.low)).astype(np.int64)
        rest = keys & np.uint64((1 << self.low) - 1)
        inside = np.minimum(high, len(self.below) - 2)
        a, b = self.below[inside].copy(), self.below[inside + 1].copy()
        a[high > inside] = self.n
        b[high > inside] = self.n
        while (open_ := np.flatnonzero(a < b)).size:
            middle = (a[open_] + b[open_]) // 2
            less = self.lows[middle] < rest[open_]
            a[open_[less]] = middle[less] + 1
            b[open_[~less]] = middle[~less]
        return a


LARGE = 255


def quantise(counts: np.ndarray) -> np.ndarray:
    """One byte for a count: exact below 128, then eight steps to a doubling; from about 7.4 million on ``LARGE``, which
    says that the count itself is kept elsewhere."""
    large = 128 + np.round(8 * np.log2(np.maximum(counts, 128) / 128))
    return np.where(counts < 128, counts, np.minimum(large, LARGE)).astype(np.uint8)


CODES = np.where(np.arange(256) < 128, np.arange(256), 128 * 2.0 ** ((np.arange(256) - 128) / 8))


def coded(counts: np.ndarray) -> bytes:
    """The code of each count, and after them the counts that are ``LARGE``, in their order."""
    codes = quantise(counts)
    return codes.tobytes() + counts[codes == LARGE].astype("<i8").tobytes()


def parted(data, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n codes of ``coded`` and the large counts behind them."""
    codes = np.frombuffer(data, np.uint8)
    return codes[:n], codes[n:].view("<i8") if len(codes) > n else np.zeros(0, "<i8")


def decoded(data, n: int) -> np.ndarray:
    """The n counts of ``coded``."""
    codes, large = parted(data, n)
    counts = CODES[codes]
    counts[codes == LARGE] = large
    return counts


class Trie:
    """Counts of (context, word) pairs of 24-bit ids."""

    @staticmethod
    def pack(pairs: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Levels of sorted distinct pairs (context << 24 | word)."""
        contexts = pairs >> np.uint64(ID_BITS)
        begins = np.flatnonzero(np.append(True, contexts[1:] != contexts[:-1])) if len(pairs) else np.zeros(0, np.int64)
        rank = np.repeat(np.arange(len(begins), dtype=np.uint64), np.diff(np.append(begins, len(pairs))))
        relative = rank << np.uint64(ID_BITS) | pairs & np.uint64((1 << ID_BITS) - 1)
        pointers = np.append(begins, len(pairs)).astype(np.uint64)
        return [EliasFano.pack(contexts[begins]), EliasFano.pack(pointers), EliasFano.pack(relative), coded(counts)]

    def __init__(self, levels):
        self.contexts, self.pointers, self.words = (EliasFano(x) for x in levels[:3])
        self.codes, self.large = parted(levels[3], self.words.n)
        self.large_at = np.flatnonzero(self.codes == LARGE)

    def places(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the pairs occurred, and their places among the successors."""
        if not self.contexts.n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        context = pairs >> np.uint64(ID_BITS)
        at = self.contexts.successor(context)
        known = np.flatnonzero(at < self.contexts.n)
        known = known[self.contexts.get(at[known]) == context[known]]
        relative = at[known].astype(np.uint64) << np.uint64(ID_BITS) | pairs[known] & np.uint64((1 << ID_BITS) - 1)
        place = self.words.successor(relative)
        end = self.pointers.get(at[known] + 1).astype(np.int64)
        inside = np.flatnonzero(place < end)
        inside = inside[self.words.get(place[inside]) == relative[inside]]
        return known[inside], place[inside]

    def find(self, pairs: np.ndarray) -> np.ndarray:
        """The count's code of each pair; 0 for one that never occurred."""
        out = np.zeros(len(pairs), np.uint8)
        known, place = self.places(pairs)
        out[known] = self.codes[place]
        return out

    def answer(self, pairs: np.ndarray) -> bytes:
        """The pairs' counts as ``decoded`` reads them."""
        out = np.zeros(len(pairs), np.uint8)
        known, place = self.places(pairs)
        out[known] = self.codes[place]
        large = self.large[np.searchsorted(self.large_at, place[self.codes[place] == LARGE])]
        return out.tobytes() + large.tobytes()


class Home:
    """The documents of one home as arrays that do not depend on the order of its rows."""

    def __init__(self, table: pa.Table):
        self.held = table.column("held_out").to_numpy().astype(bool)
        rows = [np.append(H.words(t.as_py()), END) for t in table.column("text")]
        self.sizes = np.array([len(r) for r in rows], np.int64)
        tokens = np.concatenate(rows)
        self.doc = np.repeat(np.arange(len(rows)), self.sizes)
        self.training = ~self.held[self.doc]
        self.words, self.word = np.unique(tokens, return_inverse=True)
        first = np.cumsum(self.sizes) - self.sizes
        self.context = np.append(0, self.word[:-1])
        self.context[first] = -1
        before = np.append(BEGIN, tokens[:-1])
        before[first] = BEGIN
        mixed = H.mixed(before * H.BASE + tokens)
        pair = (before >> np.uint64(64 - ID_BITS)) << np.uint64(ID_BITS) | tokens >> np.uint64(64 - ID_BITS)
        # 16 bits of the pair's own hash stand above its ids, from which its shard follows
        self.pairs, self.pair = np.unique((mixed >> np.uint64(48)) << np.uint64(2 * ID_BITS) | pair, return_inverse=True)
        self.docs = int((~self.held).sum())

    def counts(self, index: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(index[self.training], minlength=n)


def _pair_shard(pairs: np.ndarray, shards: int) -> np.ndarray:
    return (H.mixed(pairs) >> np.uint64(33)).astype(np.int64) % shards


def _word_shard(words: np.ndarray, shards: int) -> np.ndarray:
    return (words >> np.uint64(20)).astype(np.int64) % shards


def _split(shard: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    for k in np.flatnonzero(np.diff(cuts)):
        yield int(k), order[cuts[k] : cuts[k + 1]]


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    columns = zip(*rows) if rows else [[]] * len(names)
    return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)


ANSWERS = "home int, shard int, words binary, codes binary"


def word_counts(placed: DataFrame, shards: int) -> DataFrame:
    """(home, shard, words, codes): to each home the training counts of its words that belong to a shard; and under home
    -1 - shard three numbers: distinct words and tokens of the training documents."""

    def post(table: pa.Table) -> pa.Table:
        home = Home(table)
        counts, name = home.counts(home.word, len(home.words)), table.column("home")[0].as_py()
        rows = [(k, name, home.words[own].tobytes(), counts[own].astype("<u4").tobytes()) for k, own in _split(_word_shard(home.words, shards), shards)]
        return _table(rows, ["shard", "home", "keys", "counts"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()])

    def meet(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys = [np.frombuffer(x.as_buffer(), "<u8") for x in table.column("keys")]
        names, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(where, np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in table.column("counts")]), len(names)).astype("<i8")
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        rows = [(home, shard, total[own].tobytes(), b"") for home, own in zip(table.column("home").to_pylist(), np.split(where, cuts))]
        rows.append((-1 - shard, shard, np.array([(total > 0).sum(), total.sum()], "<i8").tobytes(), b""))
        return _table(rows, ["home", "shard", "words", "codes"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()])

    posted = placed.groupBy("home").applyInArrow(post, "shard int, home int, keys binary, counts binary")
    return posted.groupBy("shard").applyInArrow(meet, ANSWERS)


def _returned(home: Home, answers: pa.Table, shards: int) -> np.ndarray:
    """Training counts of the home's words."""
    counts = np.zeros(len(home.words), np.int64)
    parts = {s: w for s, w, c in zip(answers.column("shard").to_pylist(), answers.column("words"), answers.column("codes")) if len(w.as_buffer())}
    for k, own in _split(_word_shard(home.words, shards), shards):
        counts[own] = np.frombuffer(parts[k].as_buffer(), "<i8")
    return counts


def _level(counts: np.ndarray) -> np.ndarray:
    """The group of contexts of a similar count; 0 for those without one."""
    return np.minimum(np.ceil(np.log2(counts + 1)).astype(np.int64), LEVELS - 1)


def pair_counts(placed: DataFrame, words: DataFrame, shards: int, documents_: int) -> DataFrame:
    """(home, shard, words, codes): to each home the codes of its pairs' training counts; and under home -1 - shard the
    number of distinct pairs and of pairs by the level of their context's count."""

    def post(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table([], ["shard", "home", "pairs", "levels", "counts"], [pa.int32(), pa.int32(), *[pa.binary()] * 3])
        home = Home(table)
        counts, name = np.append(_returned(home, answers, shards), documents_), table.column("home")[0].as_py()
        level = np.zeros(len(home.pairs), np.uint8)
        level[home.pair] = _level(counts)[home.context]
        trained = home.counts(home.pair, len(home.pairs))
        rows = []
        for k, own in _split(_pair_shard(home.pairs, shards), shards):
            bytes_ = home.pairs[own].astype("<u8").view(np.uint8).reshape(-1, 8)
            rows.append((k, name, np.ascontiguousarray(bytes_[:, :6].T).tobytes(), level[own].tobytes(), trained[own].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()))
        return _table(rows, ["shard", "home", "pairs", "levels", "counts"], [pa.int32(), pa.int32(), *[pa.binary()] * 3])

    def meet(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        pairs, counts = [], []
        for packed, trained in zip(table.column("pairs"), table.column("counts")):
            planes = np.frombuffer(packed.as_buffer(), np.uint8).reshape(6, -1)
            own = np.zeros((planes.shape[1], 8), np.uint8)
            own[:, :6] = planes.T
            pairs.append(own.view("<u8").ravel())
            counts.append(np.ascontiguousarray(np.frombuffer(trained.as_buffer(), np.uint8).reshape(4, -1).T).view("<u4").ravel())
        levels = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("levels")])
        every, trained = np.concatenate(pairs), np.concatenate(counts)
        names, where = np.unique(every, return_inverse=True)
        total = np.bincount(where, trained, len(names)).astype(np.int64)
        level = np.zeros(len(names), np.int64)
        level[where] = levels
        seen = total > 0
        trie = Trie(Trie.pack(names[seen], total[seen]))
        rows = [(home, shard, b"", trie.answer(own)) for home, own in zip(table.column("home").to_pylist(), pairs)]
        sums = np.concatenate([np.bincount(level[seen], minlength=LEVELS), np.bincount(level, total, LEVELS)]).astype("<i8")
        rows.append((-1 - shard, shard, sums.tobytes(), b""))
        return _table(rows, ["home", "shard", "words", "codes"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()])

    posted = placed.groupBy("home").cogroup(words.where("home >= 0").groupBy("home")).applyInArrow(post, "shard int, home int, pairs binary, levels binary, counts binary")
    return posted.groupBy("shard").applyInArrow(meet, ANSWERS)


def _totals(answers: DataFrame) -> np.ndarray:
    """Sum of the shards' own rows: one short row for each shard reaches the driver."""
    rows = answers.where("home < 0").select("words").collect()
    return np.sum([np.frombuffer(r["words"], "<i8") for r in rows], axis=0)


def scores(docs: DataFrame, folds: int = FOLDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of all documents.

    The model learns from the documents whose crc32 of the id as text leaves a remainder modulo ``folds``; a null id is held
    out.  Null texts count as empty: their one token is the end.  Repeated rows count as often as they occur.  Without
    training documents all words share the base probability.  An empty table gives no rows.
    """
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(True))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), held.alias("held_out"))
    facts = rows.agg(F.sum(F.length("text")).alias("chars"), F.sum((~F.col("held_out")).cast("long")).alias("trained"), F.count("*").alias("n")).first()
    homes = max(1, -(-(facts["chars"] or 0) // HOME_CHARS))
    trained = facts["trained"] or 0
    placed = rows.withColumn("home", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(homes)).cast("int"))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    if not facts["n"]:
        return docs.sparkSession.createDataFrame([], schema)
    words = stored(word_counts(placed, homes), "op9-words")
    release(docs.sparkSession)
    distinct, total = _totals(words).tolist()
    pairs = stored(pair_counts(placed, words, homes, trained), "op9-pairs")
    release(docs.sparkSession)
    by_level = _totals(pairs).reshape(2, LEVELS)
    share = by_level[0] / np.maximum(by_level.sum(axis=0), 1)
    share[by_level[1] == 0] = 1.0

    def add_up(table: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        if not table.num_rows:
            return _table([], names, kinds)
        home, n = Home(table), table.num_rows
        own = _returned(home, answers, homes)
        seen = np.zeros(len(home.pairs))
        parts = {s: c for s, w, c in zip(answers.column("shard").to_pylist(), answers.column("words"), answers.column("codes")) if not len(w.as_buffer())}
        for k, index in _split(_pair_shard(home.pairs, homes), homes):
            seen[index] = decoded(parts[k].as_buffer(), len(index))
        base = (own[home.word] + 0.1) / (total + 0.1 * (distinct + 1))
        before = np.append(own, trained)[home.context]
        loose = np.where(before > 0, share[_level(before)], 1.0)
        mixed = (1 - loose) * np.minimum(1.0, seen[home.pair] / np.maximum(before, 1)) + loose * base
        sums = [np.bincount(home.doc, x, n) for x in (own[home.word] > 0, np.log10(base), np.log10(mixed))]
        columns = [table.column("doc_id"), table.column("held_out"), home.sizes, sums[0].astype(np.int64), np.full(n, total, np.int64), sums[1], sums[2]]
        return pa.table([c if isinstance(c, pa.ChunkedArray) else pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    both = words.where("home >= 0").unionByName(pairs.where("home >= 0"))
    return placed.groupBy("home").cogroup(both.groupBy("home")).applyInArrow(add_up, schema)


@query("op9_lm_scores")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return scores(documents(spark, folder))
