"""Duplicate removal: exact groups, URL merges, near duplicates and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import collapse, let, strip
from gleaner.session import cut_lineage


def content_hash(c: Column) -> Column:
    return F.sha2(strip(F.coalesce(c, F.lit(""))), 256)


def normalized_hash(c: Column) -> Column:
    """Hash after blank and case folding (`lower`, so German sharp s keeps its own form)."""
    return F.sha2(F.lower(collapse(F.coalesce(c, F.lit("")))), 256)


def keep_first(df: DataFrame, key: Column, order: str) -> DataFrame:
    """First row per key by the unique column ``order``.

    The winner is found by a `min` aggregate, which combines before the shuffle, so a key that holds a third of the rows
    costs one row per task; whole rows then meet the winners through a semi join on the unique column.
    """
    winners = df.select(key.alias("_key"), F.col(order)).groupBy("_key").agg(F.min(order).alias(order)).select(order)
    return df.join(winners, order, "left_semi")


def duplicate_groups(df: DataFrame, key: Column, order: str) -> DataFrame:
    """One row per key that occurs more than once: keeper and size."""
    return (df.groupBy(key.alias("key")).agg(F.min(order).alias("keeper"), F.count(F.lit(1)).alias("members"))
            .filter("members > 1"))


def keepers_of(df: DataFrame, key: Column, order: str) -> DataFrame:
    """Every row's keeper.  The right side is unique per key, so AQE can split a hot key of the left side."""
    keyed = df.select(F.col(order), key.alias("key"))
    return keyed.join(keyed.groupBy("key").agg(F.min(order).alias("keeper")), "key").select(order, "keeper")


def _prefix_length(n: Column, threshold: float) -> Column:
    """Two sets with Jaccard >= t share an element among the first n - ceil(t n) + 1 of any common order."""
    return n - F.ceil(n * F.lit(threshold) - F.lit(1e-9)).cast("int") + 1


def shingle_sets(df: DataFrame, order: str, text: str = "text", width: int = 3, min_chars: int = 40) -> DataFrame:
    """(order, shingles, n): sorted distinct 64-bit hashes of word runs; texts under ``min_chars`` take no part."""
    folded = df.select(order, F.lower(collapse(F.col(text))).alias("_t")).filter(F.length("_t") >= min_chars)

    def hashes(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - width + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(words, i, F.lit(width)), " ")))

    runs = folded.select(order, let(F.split("_t", " "), hashes).alias("_s"))
    return runs.select(order, F.sort_array(F.array_distinct("_s")).alias("shingles")).withColumn("n", F.size("shingles"))


def jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def prefix_listing(payload: DataFrame, threshold: float) -> DataFrame:
    """(_id, n, bucket, at): the rows of each set's prefix that another set may share; ``at`` is the place in the set's order.

    Any common order of the shingles will do.  Here those with small hashes come first, the rarest of them leading: they
    alone are counted, about two and a half prefixes of a set.  Shingles of one set need no row, and a set whose prefix is
    made of such ones has no close text.  Frequent shingles (licenses, repeated passages) stand last and are seldom listed.
    """
    share = min(1.0, 2.5 * (1 - threshold))
    low = lambda s: s <= F.lit(int(-2**63 + share * 2**64) - 1).cast("bigint")
    counted = payload.select("_id", F.explode(F.filter("shingles", low)).alias("s"))
    shared = counted.groupBy("s").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    ranked = counted.join(shared, "s").groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("m", "s"))).alias("_r"))
    size, rest = _prefix_length(F.col("n"), threshold), F.filter("shingles", lambda s: ~low(s))
    sets = payload.select("_id", "n", size.alias("_p"), F.size(F.filter("shingles", low)).alias("_k"), rest.alias("_o")).select(
        "_id", "n", "_p", "_k", F.slice("_o", F.lit(1), F.greatest(F.col("_p") - F.col("_k"), F.lit(0))).alias("_o"))
    found = sets.join(ranked, "_id", "left").withColumn("_r", F.coalesce(F.transform("_r", lambda x: x["s"]), F.array().cast("array<bigint>")))
    alone = F.col("_k") - F.size("_r")
    listed = F.concat(F.slice("_r", F.lit(1), F.greatest(F.col("_p") - alone, F.lit(0))), F.col("_o"))
    return found.select("_id", "n", alone.alias("_a"), F.posexplode(listed).alias("at", "bucket")).select(
        "_id", "n", "bucket", (F.col("_a") + F.col("at")).alias("at"))


def near_duplicate_keepers(df: DataFrame, order: str, text: str = "text", threshold: float = 0.9, width: int = 3,
                           rounds: int = 24) -> DataFrame:
    """(order, keeper) for rows dropped by the sequential rule "drop a text that is close to an already kept one".

    Texts are first collapsed to one per exact shingle set, so copies cost nothing.  Each text is listed under its
    prefix shingles, rare ones first; close texts always share one.  In every round a text that is the smallest in all of
    its buckets has no earlier rival, so it is kept for certain, and the others of its buckets are compared with it alone:
    the work is linear in the listing.  As soon as the remaining buckets hold few pairs (measured, no more than four per row
    of the first listing), or after ``rounds``, the rest is decided from its explicit, exact pairs.
    """
    digest = F.struct(F.xxhash64("shingles"), F.xxhash64(F.lit(1), "shingles"))
    sets = cut_lineage(shingle_sets(df, order, text, width).withColumnRenamed(order, "_id").withColumn("_d", digest))
    # identical sets are settled by an aggregate, so masses of copies never meet the buckets
    heads = cut_lineage(sets.groupBy("_d").agg(F.min("_id").alias("head")))
    same = sets.select("_id", "_d").join(heads, "_d").select("_id", "head")
    payload = sets.join(heads.select(F.col("head").alias("_id")), "_id", "left_semi").select("_id", "shingles", "n")
    listing = cut_lineage(prefix_listing(payload, threshold))
    # the sets of listed texts alone are compared
    payload = cut_lineage(payload.join(listing.select("_id").distinct(), "_id", "left_semi"))
    dropped = df.sparkSession.createDataFrame([], "b bigint, a bigint").select(
        F.col("b").cast(df.schema[order].dataType), F.col("a").cast(df.schema[order].dataType))

    def verified(pairs: DataFrame) -> DataFrame:
        left = payload.select(F.col("_id").alias("a"), F.col("shingles").alias("sa"))
        right = payload.select(F.col("_id").alias("b"), F.col("shingles").alias("sb"))
        joined = pairs.join(left, "a").join(right, "b")
        return joined.filter(jaccard(F.col("sa"), F.col("sb")) >= threshold).select("a", "b")

    def hopeful(shared: DataFrame) -> DataFrame:
        """Pairs, from all the buckets they share, whose common shingles and those after the last can still be enough."""
        pairs = shared.groupBy("a", "b", "na", "nb").agg(
            F.count(F.lit(1)).alias("_c"), F.max("ia").alias("ia"), F.max("ib").alias("ib"))
        most = F.col("_c") + F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) - 1
        return pairs.filter(most * (1 + threshold) >= (F.col("na") + F.col("nb")) * threshold - 1e-6).select("a", "b")

    size_ok = (F.col("na") >= F.col("nb") * threshold) & (F.col("nb") >= F.col("na") * threshold)
    few = None
    for turn in range(rounds + 1):
        # explicit pairs as soon as they cost no more than a few passes over the first listing
        sizes = listing.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"))
        load = sizes.agg(F.sum("m").alias("n"), F.sum(F.col("m") * (F.col("m") - 1) / 2).alias("pairs")).first()
        if not load["n"]:
            break
        few = few or 4 * load["n"]
        if load["pairs"] <= few or turn == rounds:
            left = listing.select(F.col("_id").alias("a"), F.col("n").alias("na"), "bucket", F.col("at").alias("ia"))
            right = listing.select(F.col("_id").alias("b"), F.col("n").alias("nb"), "bucket", F.col("at").alias("ib"))
            pairs = hopeful(left.join(right, "bucket").filter(F.col("a") < F.col("b")).filter(size_ok))
            edges = cut_lineage(verified(pairs))
            dropped = dropped.unionByName(_first_wins(edges, edges.select(F.col("a").alias("_id")).union(edges.select("b")).distinct()))
            break
        firsts = listing.groupBy("bucket").agg(F.min(F.struct("_id", "n", "at")).alias("m"))
        firsts = firsts.select("bucket", F.col("m._id").alias("a"), F.col("m.n").alias("na"), F.col("m.at").alias("ia"))
        # every bucket has one smallest text, so this join adds columns and never multiplies rows
        ranked = listing.join(firsts, "bucket")
        sure = ranked.groupBy("_id").agg(F.max(F.col("_id") != F.col("a")).alias("rival")).filter("not rival").select("_id")
        sure = cut_lineage(sure)
        # a sure text is the first of all its buckets, so these are all the buckets it shares
        met = (ranked.filter("_id <> a").withColumnRenamed("n", "nb").filter(size_ok).withColumnRenamed("at", "ib")
               .withColumnRenamed("_id", "b").join(sure.withColumnRenamed("_id", "a"), "a", "left_semi"))
        hits = cut_lineage(verified(hopeful(met)).groupBy("b").agg(F.min("a").alias("a")))
        dropped = dropped.unionByName(hits)
        done = sure.unionByName(hits.select(F.col("b").alias("_id")))
        listing = cut_lineage(listing.join(done, "_id", "left_anti"))
    out = same.join(dropped.select(F.col("b").alias("head"), F.col("a").alias("_keeper")), "head", "left")
    return (out.select(F.col("_id").alias(order), F.coalesce("_keeper", "head").alias("keeper"))
            .filter(F.col(order) != F.col("keeper")))


def _first_wins(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): b is dropped because of kept a, by the sequential first-wins rule over explicit pairs a < b."""
    out = edges.select("b", "a").limit(0)
    while not nodes.isEmpty():
        kept = cut_lineage(nodes.join(edges.select(F.col("b").alias("_id")), "_id", "left_anti"))
        hits = cut_lineage(edges.join(kept.withColumnRenamed("_id", "a"), "a", "left_semi").groupBy("b").agg(F.min("a").alias("a")))
        out = out.unionByName(hits)
        gone = kept.unionByName(hits.select(F.col("b").alias("_id")))
        nodes = cut_lineage(nodes.join(gone, "_id", "left_anti"))
        edges = cut_lineage(edges.join(gone.withColumnRenamed("_id", "a"), "a", "left_anti")
                            .join(gone.withColumnRenamed("_id", "b"), "b", "left_anti"))
    return out


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component): component is the smallest node id.

    Alternating star rounds.  Each round is two aggregates with map-side combine and joins whose one side is unique per
    key, so hubs are split by AQE; rounds grow with the logarithm of the longest chain.
    """
    pairs = edges.select(F.col(left).alias("u"), F.col(right).alias("v"))
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    labels = cut_lineage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("c")))
    both = cut_lineage(both.distinct())
    while True:
        seen = both.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("c").alias("m"))
        stepped = labels.join(seen, "u", "left").select("u", F.least("c", F.coalesce("m", "c")).alias("n"), "c")
        # pointer jump: follow the label's own label
        jump = stepped.select(F.col("u").alias("n"), F.col("n").alias("j"))
        nxt = cut_lineage(stepped.join(jump, "n").select("u", F.least("n", "j").alias("c"), F.col("c").alias("old")))
        labels = nxt.select("u", "c")
        if nxt.filter("c <> old").isEmpty():
            return labels.select(F.col("u").alias("node"), F.col("c").alias("component"))


def merge_by_url(df: DataFrame, url: Column, order: str, limit: int | None = None) -> DataFrame:
    """First row per canonical URL (rows without one stand for themselves), with an optional overall cap by order."""
    key = F.when(url != "", url).otherwise(F.concat(F.lit("id:"), F.col(order).cast("string")))
    merged = keep_first(df, key, order)
    return merged.orderBy(order).limit(limit) if limit is not None else merged


def merge_academic(df: DataFrame, group: str, order: str, title: str = "title", doi: str = "doi", title_chars: int | None = None) -> DataFrame:
    """Drop a paper when its title key or its DOI has been seen on an earlier kept paper of the same group.

    "Earlier kept" makes the rule sequential: a paper dropped by title does not reserve its DOI.  It is solved in rounds:
    a paper that is first under both of its keys is kept, everything sharing a key with it goes, repeat on the rest.
    """
    title_key = F.regexp_replace(F.lower(F.col(title)), r"[^\p{L}\p{N}_]", "")
    title_key = title_key if title_chars is None else F.substring(title_key, 1, title_chars)
    base = df.select(group, order, F.concat(F.lit("t:"), title_key).alias("_t"),
                     F.when(F.coalesce(F.col(doi), F.lit("")) != "", F.concat(F.lit("d:"), F.lower(doi))).alias("_d"))
    open_rows = cut_lineage(base)
    kept = None
    while not open_rows.isEmpty():
        first_t = open_rows.groupBy(group, "_t").agg(F.min(order).alias("_ft"))
        first_d = open_rows.filter("_d is not null").groupBy(group, "_d").agg(F.min(order).alias("_fd"))
        ranked = open_rows.join(first_t, [group, "_t"]).join(first_d, [group, "_d"], "left")
        sure = cut_lineage(ranked.filter((F.col(order) == F.col("_ft")) & (F.col("_fd").isNull() | (F.col(order) == F.col("_fd"))))
                           .select(group, order, "_t", "_d"))
        kept = sure if kept is None else kept.unionByName(sure)
        open_rows = cut_lineage(
            open_rows.join(sure.select(group, "_t"), [group, "_t"], "left_anti")
            .join(sure.filter("_d is not null").select(group, "_d"), [group, "_d"], "left_anti"))
    return df.join(kept.select(order), order, "left_semi")


def distinct_queries(df: DataFrame, group: list[str], query: str, order: str) -> DataFrame:
    """First spelling of every query per group, compared without case and outer blanks; blank ones dropped."""
    clean = df.withColumn(query, strip(F.col(query))).filter(F.col(query) != "")
    window = Window.partitionBy(*group, F.lower(query)).orderBy(order)
    return clean.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")


def unvisited(candidates: DataFrame, visited: DataFrame, url: str = "url") -> DataFrame:
    key = F.lower(strip(F.col(url)))
    return (candidates.withColumn("_k", key).join(visited.select(key.alias("_k")).distinct(), "_k", "left_anti").drop("_k"))
