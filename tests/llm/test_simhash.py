"""SimHash fingerprints and their components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gleaner.llm import simhash

LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    grams = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(points):
    """The smallest index of the group of each point, by all pairs."""
    label = list(range(len(points)))
    for _ in points:
        before = list(label)
        for a in range(len(points)):
            near = np.flatnonzero(np.bitwise_count(points ^ points[a]) <= 4)
            low = min(label[k] for k in near)
            for k in near:
                label[k] = min(label[k], low)
        if label == before:
            return label
    return label


def points(seed=1, groups=60, alone=600):
    """Single fingerprints, chains of steps of four bits, and balls around one point."""
    rnd = random.Random(seed)
    flip = lambda x, n: x ^ sum(1 << b for b in rnd.sample(range(64), n))
    out = [rnd.getrandbits(64) for _ in range(alone)]
    for _ in range(groups):
        x = rnd.getrandbits(64)
        for _ in range(rnd.randrange(2, 9)):
            out.append(x := flip(x, rnd.randrange(1, 6)))
    out += [flip(0, rnd.randrange(5)) for _ in range(150)]
    return np.unique(np.array(out, np.uint64))


def test_fingerprints(corpus):
    for _, text in corpus:
        assert simhash.fingerprint(text or "") == plain(text)


@pytest.mark.parametrize("leaf", [4, 64, 5000])
def test_links_of_a_shard(leaf):
    own = points()
    found = [simhash.links(own, block, leaf) for block in simhash.BLOCKS]
    a, b = (np.concatenate(c) for c in zip(*found))
    assert (np.bitwise_count(a ^ b) <= 4).all()
    place = {int(p): k for k, p in enumerate(own)}
    label = list(range(len(own)))
    for _ in range(len(own)):
        before = list(label)
        for x, y in zip(a.tolist(), b.tolist()):
            label[place[x]] = label[place[y]] = min(label[place[x]], label[place[y]])
        if label == before:
            break
    assert label == components(own)


def test_every_pair_meets_in_a_leaf():
    own = points(2)
    for block in simhash.BLOCKS:
        tree = []
        simhash.grow(own[::3], block, 24, tree)
        assert len(tree) > 5
        met = set()
        for _, part in simhash.route(own, block, tree):
            part = part.tolist()
            met |= {(x, y) for x in part for y in part}
        near = np.bitwise_count((own[:, None] ^ own) & block) <= simhash.NEAR
        assert all((int(own[x]), int(own[y])) in met for x, y in np.argwhere(near))


@pytest.mark.parametrize("shard, leaf", [(16_384, 256), (64, 8)])
def test_near_links(spark, shard, leaf):
    own = points(3)
    nodes = spark.createDataFrame([(int(p),) for p in own.view(np.int64)], "fp long").repartition(4)
    label = {int(p): int(p) for p in own.view(np.int64)}
    pairs = [(r.a, r.b) for r in simhash.near_links(nodes, shard, leaf).collect()]
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    groups = components(own)
    names = own.view(np.int64).tolist()
    assert len({(groups[k], label[n]) for k, n in enumerate(names)}) == len(set(groups)) == len(set(label.values()))


def test_documents(docs, corpus, nothing):
    extra = docs.withColumns({"fp": F.lit(1), "first": F.lit(2), "component": F.lit("c"), "component_id": F.lit(3), "shard": F.lit(0), "a": F.lit(0)})
    got = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.classes(extra).collect()), key=str)
    prints = np.array([plain(t) for _, t in corpus], np.uint64)
    label = components(prints)
    least = {}
    for (i, _), g in zip(corpus, label):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    assert got == sorted(((i, int(p), least.get(g)) for (i, _), p, g in zip(corpus, prints, label)), key=str)
    assert simhash.classes(nothing).count() == 0
