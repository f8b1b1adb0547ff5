"""Token-overlap joins: which texts share enough words.

The share a pair needs is turned into a prefix: a set of n tokens that must share at least m of them with its partner
shares one of its n - m + 1 rarest.  Listing only those leaves the frequent words, the hot join keys, out of one side,
and no pair is missed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.session import cut_lineage


def _exploded(sets: DataFrame, key: str, groups: list[str]) -> DataFrame:
    return sets.select(*groups, key, F.size("tokens").alias("n"), F.explode("tokens").alias("token"))


def rare_prefix(sets: DataFrame, others: DataFrame, key: str, groups: list[str], share: float) -> DataFrame:
    """(groups, key, n, token): per set the rarest tokens, judged by their frequency on the other side.

    Tokens the other side does not have cannot match, but they count: they are the rarest of all.
    """
    frequency = _exploded(others, "other", groups).groupBy(*groups, "token").agg(F.count(F.lit(1)).alias("df"))
    rows = _exploded(sets, key, groups).join(frequency.hint("merge"), [*groups, "token"], "left")
    rank = Window.partitionBy(*groups, key).orderBy(F.coalesce("df", F.lit(0)), "token")
    need = F.ceil(F.col("n") * F.lit(share) - F.lit(1e-9))
    kept = rows.withColumn("_r", F.row_number().over(rank)).filter(F.col("_r") <= F.col("n") - need + 1)
    return kept.filter("df is not null").select(*groups, key, "n", "token")


def coverage_pairs(left: DataFrame, right: DataFrame, groups: list[str], share: float) -> DataFrame:
    """(groups, left_id, right_id): pairs sharing at least ``share`` of the LEFT set.  Frames: groups, id, tokens."""
    lefts = left.select(*groups, F.col("id").alias("left_id"), "tokens")
    rights = right.select(*groups, F.col("id").alias("other"), "tokens")
    probe = rare_prefix(lefts, rights, "left_id", groups, share)
    index = _exploded(rights, "other", groups).select(*groups, F.col("other").alias("right_id"), "token")
    return probe.join(index.hint("merge"), [*groups, "token"]).select(*groups, "left_id", "right_id").distinct()


def coefficient_pairs(left: DataFrame, right: DataFrame, groups: list[str], share: float) -> DataFrame:
    """(groups, left_id, right_id): candidates whose overlap coefficient, shared / smaller size, can reach ``share``.

    The prefix of the smaller set of a pair must meet the other set.
    """
    lefts = left.select(*groups, F.col("id").alias("other"), "tokens")
    rights = right.select(*groups, F.col("id").alias("other"), "tokens")
    small_left = rare_prefix(lefts.withColumnRenamed("other", "left_id"), rights, "left_id", groups, share)
    all_right = _exploded(rights, "other", groups).select(*groups, F.col("other").alias("right_id"), F.col("n").alias("m"), "token")
    a = small_left.join(all_right.hint("merge"), [*groups, "token"]).filter("n <= m").select(*groups, "left_id", "right_id")
    small_right = rare_prefix(rights.withColumnRenamed("other", "right_id"), lefts, "right_id", groups, share)
    all_left = _exploded(lefts, "other", groups).select(*groups, F.col("other").alias("left_id"), F.col("n").alias("m"), "token")
    b = small_right.join(all_left.hint("merge"), [*groups, "token"]).filter("n < m").select(*groups, "left_id", "right_id")
    return a.unionByName(b).distinct()


def _split(c: str) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def _words(texts: DataFrame, groups: list[str]) -> DataFrame:
    return texts.select(*groups, "id", F.explode(F.array_distinct(_split("text"))).alias("word"))


def _meant(words: DataFrame, wanted: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, word, mention, whole): the words of texts that hold the longest word of a wanted mention (groups, mention;
    distinct); a mention of one word is ``whole``.

    The longest word of a mention lies inside one word of the text: at its end if others follow, at its beginning if others
    precede it.  So only the distinct words of the texts are cut into grams, never the texts.  No side is broadcast by an
    estimate: the sizes after an explode are not known to the planner."""
    longest = F.array_max(F.transform(_split("mention"), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    place = F.array_position(_split("mention"), F.col("core"))
    named = wanted.select(*groups, "mention", longest.alias("core")).filter("core is not null").withColumns({"follows": place > 1, "leads": place < F.size(_split("mention"))})
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.substring("word", i, n))))
    known = words.select(*groups, "word").distinct().select(*groups, "word", F.explode(F.array_distinct(grams)).alias("gram"))
    cores = named.select(*groups, "core").distinct().withColumn("gram", F.substring("core", 1, 3))
    inside = known.join(cores.hint("merge"), [*groups, "gram"]).filter(F.col("word").contains(F.col("core"))).select(*groups, "word", "core")
    # words meet their mentions before their texts, of which there are far more
    fits = (~F.col("leads") | F.col("word").endswith(F.col("core"))) & (~F.col("follows") | F.col("word").startswith(F.col("core")))
    return inside.join(named.hint("merge"), [*groups, "core"]).filter(fits).select(*groups, "word", "mention", (F.col("mention") == F.col("core")).alias("whole")).distinct()


def _holding(texts: DataFrame, wanted: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, id, mention), with repeats: texts (groups, id, text) that hold a wanted mention as a substring; mentions of
    several words are verified on the text."""
    words = _words(texts, groups)
    pairs = words.join(_meant(words, wanted, groups).hint("merge"), [*groups, "word"])
    several = pairs.filter("not whole").join(texts.hint("merge"), [*groups, "id"]).filter(F.col("text").contains(F.col("mention")))
    return pairs.filter("whole").select(*groups, "id", "mention").unionByName(several.select(*groups, "id", "mention"))


def mentioned(texts: DataFrame, mentions: DataFrame, groups: list[str], shortest: int = 3) -> DataFrame:
    """(groups, id, mentions array<long>): for each text the hashes of the mentions that are in it as substrings.

    texts: groups, id, text; mentions: groups, mention (of ``shortest`` letters or more); who owns them does not matter here.
    A word brings the hashes of all its mentions at once, so a text has one row per word, not per mention."""
    wanted = mentions.filter(F.length("mention") >= shortest).select(*groups, F.lower("mention").alias("mention")).distinct()
    words = _words(texts, groups)
    meant = cut_lineage(_meant(words, wanted, groups))
    lists = meant.filter("whole").groupBy(*groups, "word").agg(F.collect_list(F.xxhash64("mention")).alias("hashes"))
    one = words.join(lists.hint("merge"), [*groups, "word"]).select(*groups, "id", "hashes")
    if not meant.filter("not whole").isEmpty():
        pairs = words.join(meant.filter("not whole").hint("merge"), [*groups, "word"]).join(texts.hint("merge"), [*groups, "id"])
        one = one.unionByName(pairs.filter(F.col("text").contains(F.col("mention"))).select(*groups, "id", F.array(F.xxhash64("mention")).alias("hashes")))
    return one.groupBy(*groups, "id").agg(F.array_distinct(F.flatten(F.collect_list("hashes"))).alias("mentions"))


def best_matches(left: DataFrame, right: DataFrame, run: str, share: float, k: int, exact: float, rows: int | None = None) -> DataFrame:
    """(left_id, right_id, value): the ``k`` best of the right rows of the run for each left row, by value and then by id.

    left: run, id, tokens, key, mentions; right: run, id, tokens, key, mentions, weights, factor.  A match is the share of the
    left tokens that the right row has, plus the weights of its mentions that the left text holds; it counts from ``share``
    on, or if the keys are equal.  The value is the match times the right row's factor, or ``exact`` for equal keys.

    Rows of a run are dealt to blocks of about ``rows``; a task compares a left and a right block (``covered.best_pairs``) and
    keeps k rows per left one.  So no candidate pair is listed, however frequent its words are, and a run with a third of all
    rows is many tasks of two blocks each.  Rows of one key have the same tokens and mentions."""
    from gleaner.operators import blocks, covered

    left = cut_lineage(left.select(run, "id", "tokens", "key", "mentions"))  # each side is counted, then read
    right = cut_lineage(right.select(run, "id", "tokens", "key", "mentions", "weights", "factor"))
    found = blocks.compared(left, right, run, lambda one, two: covered.best_pairs(one, two, share, k, exact), "left_id long, right_id long, value double", rows or blocks.ROWS)
    order = Window.partitionBy("left_id").orderBy(F.desc("value"), "right_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _largest(values: np.ndarray, k: int) -> np.ndarray:
    """The places of the k largest values; of equal ones the first."""
    if len(values) <= k:
        return np.arange(len(values))
    cut = np.partition(values, len(values) - k)[len(values) - k]
    above = np.flatnonzero(values > cut)
    return np.concatenate([above, np.flatnonzero(values == cut)[: k - len(above)]])


class Postings:
    """Rows of a list column by value, with a weight for each entry."""

    def __init__(self, lists: pa.ChunkedArray, weights: pa.ChunkedArray | None = None):
        values, rows = self._entries(lists)
        self.known, number = np.unique(values, return_inverse=True)
        order = np.argsort(number, kind="stable")
        self.rows, self.cuts = rows[order], np.searchsorted(number[order], np.arange(len(self.known) + 1))
        self.weights = None if weights is None else self._entries(weights)[0][order]

    @staticmethod
    def _entries(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        lists = lists.combine_chunks()
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lengths)), lengths)

    def asked(self, lists: pa.ChunkedArray) -> list[np.ndarray]:
        """For each list the places of those of its values that are known."""
        values, owner = self._entries(lists)
        at = np.searchsorted(self.known, values)
        hit = at < len(self.known)
        hit[hit] = self.known[at[hit]] == values[hit]
        at, owner = at[hit], owner[hit]
        return np.split(at, np.searchsorted(owner, np.arange(1, len(lists)))) if len(lists) else []

    def summed(self, places: np.ndarray, n: int) -> np.ndarray:
        """The sum of the weights of each row under these places, or their number."""
        if not len(places):
            return np.zeros(n)
        spans = [slice(self.cuts[p], self.cuts[p + 1]) for p in places]
        weights = None if self.weights is None else np.concatenate([self.weights[x] for x in spans])
        return np.bincount(np.concatenate([self.rows[x] for x in spans]), weights, n)


def mention_weights(texts: DataFrame, mentions: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, left_id, right_id, bonus): texts that contain mentions as substrings, weights summed per pair.

    texts: groups, id, text; mentions: groups, id, mention (three letters or more), weight.  The distinct mentions are
    found, then become their owners; no text travels with a pair.
    """
    names = mentions.filter(F.length("mention") >= 3).groupBy(*groups, F.lower("mention").alias("mention"), F.col("id").alias("right_id")).agg(
        F.sum("weight").alias("weight"))
    hits = _holding(texts, names.select(*groups, "mention").distinct(), groups).distinct().withColumnRenamed("id", "left_id")
    return hits.join(names.hint("merge"), [*groups, "mention"]).groupBy(*groups, "left_id", "right_id").agg(F.sum("weight").alias("bonus"))


def mention_pairs(texts: DataFrame, mentions: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, left_id, right_id): texts that contain a mention of the other side."""
    return mention_weights(texts, mentions.withColumn("weight", F.lit(1.0)), groups).drop("bonus")


def hashed(tokens: Column) -> Column:
    """Tokens as 64-bit numbers: a quarter of the bytes in the pair joins, and faster to intersect."""
    return F.transform(tokens, lambda t: F.xxhash64(t))


def shared_share(a: Column, b: Column) -> Column:
    """Share of the first set that is in the second."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1))
