"""Similarity join of documents on their sets of word n-grams, by token-combination prefixes.

Documents with equal sets are one node.  The join then goes from the rare to the frequent:

1.  Postings: every (n-gram, set) goes to the shard of the n-gram, packed; a shard counts in how many sets each n-gram is.
    N-grams of one set only cannot be shared; what a set needs is returned to its home, packed again.
2.  Prefixes: with at most d n-grams of a set missing in a partner, and n-grams ordered by (sets, hash), d + 1 of them
    suffice.  Those of one set only come first and are always missing, so most sets drop out here, provably.  Up to
    ``FREQUENT`` sets an n-gram is indexed alone.  More frequent ones are divided into classes by a hash and indexed in
    pairs of one class; as a class gives no pair before its second member, the prefix is extended by one n-gram for each
    class.  The number of classes follows the size of the set; sets near a change of it index under both numbers.
3.  Verification in rounds: in each signature's bucket a few hubs are compared with all others, exactly, on the shared
    n-grams; the links found are contracted to components, and later rounds only look at buckets in which components
    differ, with more hubs, those of the smallest components first, until no pair of a bucket is left unseen.  A group of
    thousands of near copies thus costs about one comparison for each member, and no link between components is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gleaner.llm import wordhash as H
from gleaner.llm.common import documents, release, slices, stored
from gleaner.llm.registry import query
from gleaner.operators.dedup import connected_components

WIDTH = 4
PERCENT = 85
FREQUENT = 64
#: characters a shard, as far as workers have memory: fewer shards are fewer (set, shard) pairs between shards and homes
SHARD_CHARS, QUERY_SHARD_CHARS = 12_000_000, 30_000_000
EXTRA = np.uint64(40)
#: longs of a set's parity field
FIELDS = 8


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Distinct hashes of the word n-grams of a text; of all words together if they are fewer; none without words."""
    words = H.words(text)
    if not len(words):
        return words
    if len(words) < width:
        words, width = words * np.uint64(2 * len(words) + 1), len(words)
    total = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        total = total * H.BASE + words[k : k + len(total)]
    return np.unique(H.mixed(total))


def set_id(tokens: np.ndarray) -> int:
    """A 64-bit hash of a set."""
    return int(H.mixed(np.array([H.mixed(tokens * H.BASE).sum(dtype=np.uint64) + np.uint64(len(tokens))])).view(np.int64)[0])


def _home(ids: np.ndarray, homes: int) -> np.ndarray:
    return (H.mixed(ids.view(np.uint64)) >> np.uint64(33)).astype(np.int64) % homes


def _classes(size: float, percent: int) -> int:
    """Classes of frequent n-grams for sets of this size; 0: no pairs, all are indexed alone."""
    return 0 if size < 16 else 1 << int(log2(max(1.0, size * (100 - percent) / 400)))


def membership(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, node): node is the id of the set, null where it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py() or "", width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array([set_id(s) if len(s) else None for s in sets], pa.int64())],
                                             ["doc_id", "n_shingles", "node"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, node long")


def postings(docs: DataFrame, width: int, shards: int) -> DataFrame:
    """(shard, sets, tokens, extra, refs): the n-grams of a run of documents that belong to one shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for a, b in slices(texts):
                ids, found = [], []
                for text in texts[a:b]:
                    tokens = shingles(text, width)
                    if len(tokens) and (node := set_id(tokens)) not in seen:
                        seen.add(node)
                        ids.append(node)
                        found.append(tokens)
                if not ids:
                    continue
                tokens, ids = np.concatenate(found), np.array(ids, np.int64)
                refs = np.repeat(np.arange(len(ids)), [len(f) for f in found])
                shard = (tokens >> EXTRA).astype(np.int64) % shards
                order = np.argsort(shard, kind="stable")
                cuts = np.searchsorted(shard[order], np.arange(shards + 1))
                for k in np.flatnonzero(np.diff(cuts)):
                    own = order[cuts[k] : cuts[k + 1]]
                    used, ref = np.unique(refs[own], return_inverse=True)
                    part = tokens[own]
                    columns = [[int(k)], [ids[used].tobytes()], [part.astype("<u4").tobytes()], [(part >> np.uint64(32)).astype(np.uint8).tobytes()], [ref.astype("<u4").tobytes()]]
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])],
                                                     ["shard", "sets", "tokens", "extra", "refs"])

    return docs.select("text").mapInArrow(run, "shard int, sets binary, tokens binary, extra binary, refs binary")


def _numbers(column, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


def _runs(values: np.ndarray) -> np.ndarray:
    """Begins of the runs of equal values in a sorted array, and its length."""
    return np.append(np.flatnonzero(np.append(True, values[1:] != values[:-1])), len(values)) if len(values) else np.zeros(1, np.int64)


def coded(frequency: np.ndarray) -> np.ndarray:
    """Frequencies in a byte: exact below 128, then four steps for each doubling; larger ones never get a smaller code."""
    return np.where(frequency < 128, frequency, np.minimum(255, 128 + 4 * np.log2(np.maximum(frequency, 128) / 128))).astype(np.uint8)


def decoded(code: np.ndarray) -> np.ndarray:
    code = code.astype(np.int64)
    return np.where(code < 128, code, (128 * 2.0 ** ((code - 128) / 4)).astype(np.int64))


def shared(posted: DataFrame, homes: int) -> DataFrame:
    """(home, shard, sets, totals, counts, tokens, extra, codes): for each set how many n-grams it has in this shard, and the
    shared ones, one set's after the other's, with ``coded`` frequencies."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        sets = _numbers(table.column("sets"), "<i8")
        nodes = np.unique(np.concatenate(sets))
        refs = np.concatenate([np.searchsorted(nodes, ids).astype(np.int32)[ref] for ids, ref in zip(sets, _numbers(table.column("refs"), "<u4"))])
        tokens = np.concatenate([high.astype(np.uint64) << np.uint64(32) | low for low, high in zip(_numbers(table.column("tokens"), "<u4"), _numbers(table.column("extra"), "u1"))])
        order = np.argsort(tokens).astype(np.int32)
        same = tokens[order[1:]] == tokens[order[:-1]]
        several = np.zeros(len(tokens), bool)
        several[order] = np.append(False, same) | np.append(same, False)
        del order, same
        totals = np.bincount(refs[~several], minlength=len(nodes))
        tokens, refs = tokens[several], refs[several]  # few of all; the others are of one set
        order = np.lexsort((refs, tokens))
        tokens, refs = tokens[order], refs[order]
        fresh = np.append(True, (tokens[1:] != tokens[:-1]) | (refs[1:] != refs[:-1]))[: len(tokens)]  # a set that several tasks met
        tokens, refs = tokens[fresh], refs[fresh]
        totals = totals + np.bincount(refs, minlength=len(nodes))
        runs = _runs(tokens)
        frequency = np.repeat(np.diff(runs), np.diff(runs))
        kept = frequency > 1
        tokens, refs, frequency = tokens[kept], refs[kept], frequency[kept]
        home = _home(nodes, homes)
        by_node = np.lexsort((np.arange(len(nodes)), home))
        place = np.empty(len(nodes), np.int64)
        place[by_node] = np.arange(len(nodes))
        by_home = np.argsort(place[refs], kind="stable")
        tokens, refs, frequency = tokens[by_home], place[refs][by_home], frequency[by_home]
        cuts = np.searchsorted(home[by_node], np.arange(homes + 1))
        inner = np.searchsorted(refs, cuts)
        rows = []
        for k in np.flatnonzero(np.diff(cuts)):
            a, b, c, d = cuts[k], cuts[k + 1], inner[k], inner[k + 1]
            rows.append((int(k), shard, nodes[by_node[a:b]].tobytes(), totals[by_node[a:b]].astype("<u4").tobytes(), np.bincount(refs[c:d] - a, minlength=b - a).astype("<u4").tobytes(),
                         tokens[c:d].astype("<u4").tobytes(), (tokens[c:d] >> np.uint64(32)).astype(np.uint8).tobytes(), coded(frequency[c:d]).tobytes()))
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 6]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["home", "shard", "sets", "totals", "counts", "tokens", "extra", "codes"])

    return posted.groupBy("shard").applyInArrow(run, "home int, shard int, sets binary, totals binary, counts binary, tokens binary, extra binary, codes binary")


def signatures(tokens: np.ndarray, frequency: np.ndarray, size: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a set of ``size`` n-grams whose shared ones are given, none if it cannot have a partner; and how many
    shared n-grams partners must lack if this is their first common signature in the common order.

    These are the n-grams before a single one.  Before the second one of the first common pair, no class has two common
    n-grams, so all n-grams before it but one for each class are missing."""
    missing = size - -(-percent * size // 100)
    need = missing - (size - len(tokens)) + 1
    if need <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    order = np.lexsort((tokens, frequency))
    tokens, frequency = tokens[order], frequency[order]
    rare = int(np.searchsorted(frequency, FREQUENT, "right"))
    out, places = [H.mixed(tokens[: min(rare, need)])], [np.arange(min(rare, need))]
    if rare < need:
        often = tokens[rare:]
        for classes in {_classes(size * percent / 100, percent), _classes(size, percent)}:
            if not classes:
                out.append(H.mixed(often[: need - rare]))
                places.append(rare + np.arange(len(out[-1])))
                continue
            group = (H.mixed(often * H.BASE) >> np.uint64(20)).astype(np.int64) % classes
            _, first = np.unique(group, return_index=True)
            new = np.zeros(len(often), np.int64)
            new[first] = 1
            gained = np.arange(1, len(often) + 1) - np.cumsum(new)
            length = int(np.searchsorted(gained, need - rare)) + 1
            group, part = group[:length], often[:length]
            by = np.argsort(group, kind="stable")
            cuts = _runs(group[by])
            for a, b in zip(cuts[:-1], cuts[1:]):
                at = by[a:b]
                at = at[np.argsort(part[at])]
                members = part[at]
                i, j = np.triu_indices(len(members), 1)
                later = rare + np.maximum(at[i], at[j])
                out.append(H.mixed(members[i] * H.BASE + members[j] + np.uint64(classes)))
                places.append(np.maximum(0, later - classes))
    found, index = np.unique(np.concatenate(out), return_index=True)
    return found, np.concatenate(places)[index]


def parity(tokens: np.ndarray) -> np.ndarray:
    """For each of 64 * FIELDS hash values whether an odd number of n-grams has it: sets differ in as many n-grams at least
    as their fields differ in bits."""
    place = (H.mixed(tokens ^ H.BASE) % np.uint64(64 * FIELDS)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=64 * FIELDS) & 1).astype(np.uint8)).view(np.int64)


def candidates(returned: DataFrame, percent: int) -> DataFrame:
    """(node, size, weight, tokens, signatures, places, p0 ...) of the sets that can have a partner; p0 and so on: ``parity``.

    weight, the mean number of sets that an n-gram of the set is in, is largest for the common source of edited copies."""

    def run(table: pa.Table) -> pa.Table:
        nodes, totals, tokens, frequency, refs = [], [], [], [], []
        columns = (("sets", "<i8"), ("totals", "<u4"), ("counts", "<u4"), ("tokens", "<u4"), ("extra", "u1"), ("codes", "u1"))
        for shard, ids, total, count, low, high, code in zip(table.column("shard").to_pylist(), *(_numbers(table.column(c), k) for c, k in columns)):
            nodes.append(ids)
            totals.append(total)
            tokens.append(np.uint64(shard) << EXTRA | high.astype(np.uint64) << np.uint64(32) | low)
            frequency.append(decoded(code))
            refs.append(np.repeat(ids, count))
        names, where = np.unique(np.concatenate(nodes), return_inverse=True)
        sizes = np.bincount(where, np.concatenate(totals), len(names)).astype(np.int64)
        tokens, frequency, refs = np.concatenate(tokens), np.concatenate(frequency), np.searchsorted(names, np.concatenate(refs))
        order = np.argsort(refs, kind="stable")
        tokens, frequency, cuts = tokens[order], frequency[order], np.searchsorted(refs[order], np.arange(len(names) + 1))
        rows = []
        for k, name in enumerate(names.tolist()):
            own = slice(cuts[k], cuts[k + 1])
            found, places = signatures(tokens[own], frequency[own], int(sizes[k]), percent)
            if len(found):
                weight = (int(frequency[own].sum()) - int(np.count_nonzero(frequency[own]))) / int(sizes[k])
                rows.append((name, int(sizes[k]), weight, tokens[own].view(np.int64), found.view(np.int64), places, *parity(tokens[own]).tolist()))
        kinds = [pa.int64(), pa.int64(), pa.float64(), *[pa.list_(pa.int64())] * 3, *[pa.int64()] * FIELDS]
        columns = zip(*rows) if rows else [[]] * len(kinds)
        return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["node", "size", "weight", "tokens", "signatures", "places", *fields])

    fields = [f"p{k}" for k in range(FIELDS)]
    return returned.groupBy("home").applyInArrow(run, "node long, size long, weight double, tokens array<long>, signatures array<long>, places array<long>, " + ", ".join(f"{p} long" for p in fields))


def linked(sets: DataFrame, percent: int) -> DataFrame | None:
    """(node, component) of all nodes with a link, or None: the rounds of verification."""
    spark = sets.sparkSession
    slim = sets.select(F.explode(F.arrays_zip("signatures", "places")).alias("s"), "node", "size", "weight", F.size("tokens").alias("all"))
    # where a signature is the first common one, the n-grams counted by its place are not common
    slim = slim.select(F.col("s.signatures").alias("sig"), "node", "size", "weight", (F.col("all") - F.col("s.places")).alias("shared"))
    bucket = W.partitionBy("sig")
    # partners in a bucket are not smaller than its smallest set
    rows = slim.withColumn("least", F.min("size").over(bucket)).where(f"{100 + percent} * shared >= {percent} * (size + least)").drop("least")
    rows = stored(rows.withColumn("n", F.count("*").over(bucket)).where("n > 1").drop("n"), "op6-buckets")
    fields = [f"p{k}" for k in range(FIELDS)]
    fielded = sets.select("node", (F.col("size") - F.size("tokens")).alias("alone"), *fields)
    edges = tested = components = None
    hubs = 1
    while True:
        if components is None:
            rows = rows.withColumn("component", F.col("node"))
        else:  # buckets of one component stay so, hence each round goes on with what the last one left
            rows = rows.drop("component", "n", "rank").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
        rows = rows.withColumns({"low": F.min("component").over(bucket), "high": F.max("component").over(bucket), "n": F.count("*").over(bucket)}).where("low <> high").drop("low", "high")
        rows = rows.withColumn("same", F.count("*").over(W.partitionBy("sig", "component"))).withColumn("rank", F.row_number().over(bucket.orderBy("same", F.desc("weight"), "node")))
        rows = stored(rows.drop("same"), "op6-round")
        largest = rows.agg(F.max("n")).first()[0]
        if largest is None:
            return components
        # the first round compares a set with the hub of its bucket; later ones look at what is most likely no link at all
        met = rows if components is None else rows.join(fielded, "node")
        hub = met.where(F.col("rank") <= hubs).select("sig", *[F.col(c).alias(f"{c}_a") for c in met.columns if c != "sig"])
        # n-grams of one set only are never common: with at most c common ones two sets have at least all others
        common = "least(shared, shared_a)"
        test = f"component <> component_a and rank > rank_a and 100 * {common} >= {percent} * (size + size_a - {common})"
        if components is not None:
            differ = " + ".join(f"bit_count({p} ^ {p}_a)" for p in fields)
            test += f" and {100 + percent} * (alone + alone_a + {differ}) <= {100 - percent} * (size + size_a)"
        pairs = met.join(hub, "sig").where(test).select(F.least("node_a", "node").alias("a"), F.greatest("node_a", "node").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stored(pairs, "op6-pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        # few sets are in pairs: the lists of the others stay where they are
        left = sets.join(pairs.select(F.col("a").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("tokens").alias("tokens_a"))
        right = sets.join(pairs.select(F.col("b").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("tokens").alias("tokens_b"))
        shared = F.size(F.array_intersect("tokens_a", "tokens_b"))
        checked = pairs.join(right, "b").join(left, "a").withColumn("common", shared)
        found = stored(checked.where(F.col("common") * 100 >= (F.col("size_a") + F.col("size_b") - F.col("common")) * percent).select("a", "b"), "op6-links")
        new = not found.isEmpty()
        edges = found if edges is None else edges.unionByName(found)
        if new:
            components = connected_components(edges)
        if largest <= hubs + 1:
            return components
        hubs *= 16
        release(spark)


def classes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents in groups joined by chains of links.

    Two documents are linked if 100 times the common n-grams are at least ``percent`` times all of both.  component_id is
    the smallest doc_id of the group.  Null texts count as empty; texts without words are alone under their own id.
    Repeated rows come back as often; a null id does not name a group with other ids in it.  An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-chars // shard_chars))
    returned = stored(shared(postings(rows, width, shards), shards), "op6-shared", "none")
    release(rows.sparkSession)
    sets = stored(candidates(returned, percent), "op6-sets")
    release(rows.sparkSession)
    found = linked(sets, percent)
    members = membership(rows, width)
    if found is None:
        members = members.withColumn("component", F.col("node"))
    else:
        members = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    members = stored(members.select("doc_id", "n_shingles", "component"), "op6-members")
    first = members.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("smallest"))
    return members.join(first, "component", "left").select("doc_id", "n_shingles", F.coalesce("smallest", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` (with doc_id and text, all columns kept) with the smallest doc_id of their group.

    Rows that repeat both id and text count as one document."""
    kept = classes(docs, width, percent).where("doc_id <=> component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("text_hash"))
    return rows.join(kept, F.col("own_id").eqNullSafe(F.col("kept_id")), "left_semi").dropDuplicates(["own_id", "text_hash"]).select("row.*")


@query("op6_ngram_join")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return classes(documents(spark, folder), shard_chars=QUERY_SHARD_CHARS)
