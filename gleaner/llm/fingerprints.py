"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

The terms of a text are its words (runs without white space, in lower case), weighted by how often they occur.  For term
x and sample k let r and c be Gamma(2, 1) numbers and b a uniform one, all drawn from a hash of (x, k).  With weight w,
let t = floor(ln w / r + b); the sample is the pair (x, t) whose  ln c - r (t - b + 1)  is least.  Two texts draw the same
pair with a probability equal to the generalised Jaccard similarity of their weights, sum of minima over sum of maxima.
As that least number determines the pair, it stands for it; the fingerprint has 16 bits of its hash for each sample.

Everything happens where the texts lie: one exchange deals documents out by ranges of their ids, so that neighbours meet,
and the counts, minima and comparisons that follow keep that partitioning.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gleaner.llm.common import documents
from gleaner.llm.registry import query

SAMPLES = 64
TOGETHER = 8  # samples worked out in one row: small enough for generated code to be compiled
RANGE_ROWS = 256
MOST_RANGES = 4096
PART_CHARS = 4_000_000
WHITE = "[\\x09-\\x0D\\x20]+"


def draws(term: Column, k: int) -> tuple[Column, Column, Column]:
    """(r, b, ln c) of sample ``k`` of a 64-bit term."""
    drawn = F.xxhash64(term, F.lit(k))

    def uniform(shift: int, n: int) -> Column:
        return (F.shiftrightunsigned(drawn, shift).bitwiseAND(F.lit((1 << n) - 1)) + F.lit(0.5)) * F.lit(2.0**-n)

    r = -F.ln(uniform(0, 13) * uniform(13, 13))
    log_c = F.ln(-F.ln(uniform(36, 14) * uniform(50, 14)))
    return r, uniform(26, 10), log_c


def value(r: Column, b: Column, log_c: Column, log_weight: Column) -> Column:
    return log_c - r * (F.floor(log_weight / r + b) - b + 1)


def digits(minimum: Column) -> Column:
    """Four hex digits of a sample; zeros where a text has no words."""
    return F.lpad(F.lower(F.hex(F.when(minimum.isNotNull(), F.xxhash64(minimum).bitwiseAND(F.lit(0xFFFF))).otherwise(F.lit(0)))), 4, "0")


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples of two fingerprints."""
    same = [(F.substring(a, 4 * k + 1, 4) == F.substring(b, 4 * k + 1, 4)).cast("int") for k in range(samples)]
    total = same[0]
    for s in same[1:]:
        total = total + s
    return total / F.lit(float(samples))


def signatures(texts: DataFrame, keys: list[str], sides: list[str], samples: int = SAMPLES) -> DataFrame:
    """``keys`` and one column ``fp_<side>`` for each text column in ``sides``.

    ``keys`` tell rows apart.  Null texts count as empty.  Counting terms and taking minima group by ``keys`` first, so
    texts that are already partitioned by one of them are not moved.
    """
    pairs = F.array(*(F.struct(F.lit(n).alias("side"), F.coalesce(F.col(s), F.lit("")).alias("text")) for n, s in enumerate(sides)))
    rows = texts.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.side", F.lower("p.text").alias("text"))
    words = rows.select(*keys, "side", F.explode(F.split("text", WHITE)).alias("word"))
    term = F.when(F.col("word") != "", F.xxhash64("word")).alias("term")
    term = F.when(F.col("word") != "", F.xxhash64("word")).alias("term")
    counted = words.groupBy(*keys, term).agg(*(F.sum((F.col("side") == n).cast("int")).alias(f"n_{n}") for n in range(len(sides))))
    # a weight of none has no logarithm, and no value without a branch below
    logs = [F.when(F.col("term").isNotNull(), F.ln(f"n_{n}")).alias(f"log_{n}") for n in range(len(sides))]
    groups = F.explode(F.array(*(F.lit(g) for g in range(samples // TOGETHER)))).alias("group")
    seeded = counted.select(*keys, F.coalesce("term", F.lit(0)).alias("term"), *logs).select("*", groups).withColumn("term", F.xxhash64("term", "group"))
    least = []
    for k in range(TOGETHER):
        drawn = draws(F.col("term"), k)
        least += [F.min(value(*drawn, F.col(f"log_{n}"))).alias(f"m_{n}_{k}") for n in range(len(sides))]
    parts = seeded.groupBy(*keys, "group").agg(*least)
    text = [F.concat(*(digits(F.col(f"m_{n}_{k}")) for k in range(TOGETHER))).alias(f"part_{n}") for n in range(len(sides))]
    whole = parts.select(*keys, "group", *text).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("group", *(f"part_{n}" for n in range(len(sides)))))).alias("parts"))
    return whole.select(*keys, *(F.array_join(F.col(f"parts.part_{n}"), "").alias(f"fp_{s}") for n, s in enumerate(sides)))


def with_neighbours(docs: DataFrame) -> DataFrame:
    """(range, place, guest, doc_id, text, next): documents by ascending id with the text that follows, after the last
    one the first.  Equal ids are ordered by their texts, null ids come first.  Each range of ids ends with a ``guest``, a
    copy of the next range's first row, so no row has to look beyond its range."""
    docs = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("rank"))
    size = docs.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    ranges = max(1, min(MOST_RANGES, size["n"] // RANGE_ROWS))
    cuts = sorted(set(docs.where("doc_id is not null").approxQuantile("rank", [k / ranges for k in range(1, ranges)], 1 / (4 * ranges)))) if ranges > 1 else []
    number = _range(F.col("rank"), [int(c) for c in cuts])
    placed = docs.withColumn("range", number)
    # one row per range reaches the driver, at most MOST_RANGES
    firsts = sorted(map(tuple, placed.groupBy("range").agg(F.min("rank")).collect()))
    if not firsts:
        return placed.select("range", F.lit(1).alias("place"), F.lit(False).alias("guest"), "doc_id", "text", F.col("text").alias("next"))
    before = [firsts[k - 1][0] for k in range(len(firsts))]
    home = F.create_map(*(F.lit(x) for pair in zip((f for _, f in firsts), before) for x in pair))
    guests = docs.where(F.col("rank").isin([f for _, f in firsts])).withColumn("range", F.element_at(home, F.col("rank")))
    guests = guests.groupBy("range").agg(F.min(F.struct("rank", "text", "doc_id")).alias("g")).select("g.doc_id", "g.text", "g.rank", "range")
    # words and their samples are many times a text: partitions small enough not to spill
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (size["chars"] or 0) // PART_CHARS)
    both = placed.withColumn("guest", F.lit(False)).unionByName(guests.withColumn("guest", F.lit(True))).repartition(parts, "range")
    order = W.partitionBy("range").orderBy("guest", "rank", "text")
    return both.withColumns({"place": F.row_number().over(order), "next": F.lead("text").over(order)}).drop("rank")


def _range(rank: Column, cuts: list[int]) -> Column:
    """How many cuts are at most ``rank``, counted in two levels."""
    if not cuts:
        return F.lit(0)
    step = isqrt(len(cuts)) + 1
    coarse, fine = F.array(*map(F.lit, cuts[::step])), F.array(*map(F.lit, cuts))
    block = F.greatest(F.size(F.filter(coarse, lambda c: c <= rank)) - 1, F.lit(0)) * step
    return block + F.size(F.filter(F.slice(fine, block + 1, step), lambda c: c <= rank))


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all texts and of their edited texts, whose last quarter is the beginning of the next document.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).  Null texts count as empty;
    repeated rows stay apart; a single document is its own neighbour; an empty table gives no rows."""
    rows = with_neighbours(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    quarter = F.floor(F.char_length("text") / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.char_length("text") - quarter), F.substr(F.coalesce("next", F.lit("")), F.lit(1), quarter))
    rows = rows.withColumn("edited", edited)
    facts = {"n_chars": F.char_length("text").cast("long"), "edited_sha256": F.sha2(F.col("edited").cast("binary"), 256)}
    keys = ["range", "place", "guest", "doc_id", *facts]
    signed = signatures(rows.withColumns(facts).select(*keys, "text", "edited"), keys, ["text", "edited"])
    signed = signed.withColumn("fp_next", F.lead("fp_text").over(W.partitionBy("range").orderBy("place")))
    return signed.where(~F.col("guest")).select(
        "doc_id", "n_chars", "edited_sha256", F.col("fp_text").alias("fingerprint"), F.col("fp_edited").alias("edited_fingerprint"),
        likeness(F.col("fp_text"), F.col("fp_edited")).alias("near_edited"), likeness(F.col("fp_text"), F.col("fp_next")).alias("near_next"))


@query("op10_fingerprints")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return compared(documents(spark, folder))
