"""Evidence extraction.  One source's evidence depends on that source alone, so all of it is computed inside the row:
no shuffle, no per-source group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import lexicons as L
from gleaner.functions import text as T
from gleaner.functions import tokens as K
from gleaner.operators.chunks import passage_score


def leading(c: Column, first: int | None) -> Column:
    """The first elements of an array, or all of them."""
    return c if first is None else F.slice(c, 1, first)


def metrics(c: Column, first: int | None = None) -> Column:
    found = F.regexp_extract_all(c, F.lit(L.EVIDENCE_METRIC), F.lit(1))
    return F.transform(leading(found, first), T.strip)


def entities(c: Column, first: int | None = None) -> Column:
    runs = F.regexp_extract_all(c, F.lit(L.ENTITY_PATTERN), F.lit(1))
    return leading(F.filter(runs, lambda e: ~e.isin(*L.ENTITY_STOP) & (F.length(e) > 2)), first)


def is_evidence(s: Column) -> Column:
    """30-500 characters, readable, no page furniture, and a number or an empirical verb in a longer sentence."""
    n = F.length(s)
    empirical = s.rlike(L.EVIDENCE_METRIC) | (s.rlike(L.EMPIRICAL_ACTION) & (n > 50))
    return n.between(30, 500) & empirical & ~s.rlike(L.NOISE_LINE) & ~T.is_corrupted(s)


def evidence_type(s: Column, found: Column) -> Column:
    statistic = s.contains("%") | F.exists(found, lambda m: m.rlike(L.STATISTIC_METRIC))
    return F.when(statistic, "statistic").when(s.rlike(L.POLICY_WORDS), "policy_event").otherwise("empirical_finding")


def evidence_confidence(base: Column, found: Column, names: Column) -> Column:
    with_metrics = F.when(F.size(found) > 0, F.least(F.lit(0.98), base + 0.05)).otherwise(base)
    return F.round(F.when(F.size(names) >= 2, F.least(F.lit(0.98), with_metrics + 0.02)).otherwise(with_metrics), 4)


def sentence_evidence(sentences: DataFrame, sentence: str, base: Column | float = 0.90) -> DataFrame:
    """Evidence rows among sentence rows."""
    base = F.lit(base) if isinstance(base, float) else base
    s = F.col(sentence)
    return sentences.filter(is_evidence(s)).withColumn("metrics", metrics(s)).withColumn("entities", entities(s)).select(
        "*", F.regexp_replace(s, r"\.$", "").alias("claim_text"), evidence_type(s, F.col("metrics")).alias("evidence_type"),
        evidence_confidence(base, F.col("metrics"), F.col("entities")).alias("evidence_confidence"))


def sanitize(c: Column) -> Column:
    return T.repair_mojibake(T.straighten(T.decode_entities(c)))


def quote_key(c: Column) -> Column:
    return F.lower(T.collapse(sanitize(c)))


def quote_occurs(quote: Column, source: Column) -> Column:
    q = quote_key(quote)
    return (q != "") & quote_key(source).contains(q)


def claim_supported_by_quote(claim: Column, quote: Column) -> Column:
    """Two shared words longer than three letters, and every number of the claim is in the quote."""
    shared = F.size(F.array_intersect(K.tokens(claim, (), 4), K.tokens(quote, (), 4)))
    every = lambda c: F.regexp_extract_all(c, F.lit(L.EVIDENCE_METRIC), F.lit(1))
    return (shared >= 2) & (F.size(F.array_except(every(claim), every(quote))) == 0)


def eligible(metadata: Column, status: Column, *texts: Column) -> Column:
    """Evidence that may be used: own passage, not ruled out, quote checked, not disputed, readable."""
    flag = lambda k: F.coalesce(F.try_element_at(metadata, F.lit(k)), F.lit(""))
    ok = (flag("content_provenance") != "metadata-only") & (flag("evidence_eligible") != "false") & (flag("quote_validated") != "false")
    ok = ok & ~F.coalesce(status, F.lit("")).isin(*L.DISPUTED_STATUSES)
    for t in texts:
        ok = ok & ~T.is_corrupted(t)
    return ok


def extract_evidence(sources: DataFrame, topic: Column | None = None, per_passage: int | None = None, top_passages: int | None = None,
                     per_source: int | None = None, plain_sentences: int | None = None) -> DataFrame:
    """(source_id, n, claim, quote, method): distinct claims, those of the best passages first.

    ``sources`` has source_id, content, snippet and an array ``passages``; all work is inside its row.  A source without any
    gets its snippet's claims, else its readable sentences.  Each number limits what it names, to the first ones.
    """
    def claims_of(block: Column, first: int | None) -> Column:
        return leading(F.filter(K.simple_sentences(block), is_evidence), first)

    def unique(found: Column) -> Column:
        return T.let(found, lambda xs: T.let(F.transform(xs, F.lower), lambda low: F.filter(
            xs, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)))

    ranked = leading(F.sort_array(F.transform("passages", lambda p, i: F.struct(
        passage_score(p, topic).alias("s"), (-i).alias("o"), p.alias("p"))), asc=False), top_passages)
    from_text = leading(unique(F.flatten(F.transform(ranked, lambda r: claims_of(r["p"], per_passage)))), per_source)
    plain = leading(F.filter(K.simple_sentences(F.col("content")), lambda s: (F.length(s) > 35) & ~T.is_corrupted(s)), plain_sentences)
    base = sources.withColumn("_t", F.coalesce(from_text, F.array().cast("array<string>")))
    base = base.withColumn("_s", F.when(F.size("_t") > 0, F.array().cast("array<string>")).otherwise(claims_of(F.col("snippet"), per_passage)))
    chosen = F.when(F.size("_t") > 0, F.col("_t")).when(F.size("_s") > 0, F.col("_s")).otherwise(plain)
    method = F.when(F.size("_t") > 0, "heuristic").when(F.size("_s") > 0, "heuristic_snippet").otherwise("heuristic_sentence")
    return base.select("source_id", method.alias("method"), F.posexplode(chosen).alias("n", "quote")).select(
        "source_id", "n", F.regexp_replace("quote", r"\.$", "").alias("claim"), "quote", "method")


def passage_evidence(passage: Column, per_passage: int | None = None) -> Column:
    return leading(F.filter(K.simple_sentences(passage), is_evidence), per_passage)


def source_sentences(sources: DataFrame, key: str, first: int | None = None, min_chars: int = 35) -> DataFrame:
    """Second extraction rule: longer sentences of the content, else of the snippet."""
    long_ones = lambda c: F.filter(K.simple_sentences(F.coalesce(c, F.lit(""))), lambda s: F.length(s) >= min_chars)
    body, snippet = long_ones(F.col("content")), long_ones(F.col("snippet"))
    chosen = leading(F.when(F.size(body) > 0, body).otherwise(snippet), first)
    bonus = (F.when(F.col("extraction_status") == "fetched", 0.25)
             .when(F.col("extraction_status").isin("metadata", "fixture", "abstract", "snippet"), 0.2).otherwise(0.12))
    confidence = F.round(F.least(F.lit(0.96), F.greatest(F.lit(0.45), F.coalesce("relevance_score", F.lit(0.6)) * 0.65 + bonus)), 3)
    rows = sources.filter(F.coalesce("url", F.lit("")) != "").select(key, "url", confidence.alias("confidence"), F.posexplode(chosen).alias("n", "quote"))
    found = F.array_distinct(F.regexp_extract_all("quote", F.lit(L.JS_NUMBER), F.lit(0)))
    return rows.select(key, "url", "n", F.regexp_replace("quote", "[.!?]+$", "").alias("claim"), "quote", "confidence",
                       F.size(found).alias("metrics"), F.when(F.size(found) > 0, "quantitative").otherwise("contextual").alias("evidence_type"))


def theme_claims(evidence: DataFrame, run: str, order: str, first: int | None = None, themes=L.THEMES) -> DataFrame:
    """(run, theme, claim, order): distinct claims per theme with their first place; with ``first`` so many, and their rank.

    A run without market claims gets its first claims as the market theme.
    """
    low = F.lower("claim")
    hit = F.array(*[F.when(T.contains_any(low, words), F.lit(name)) for name, words in themes])
    tagged = evidence.select(run, order, "claim", F.explode(F.filter(hit, lambda t: t.isNotNull())).alias("theme"))
    has_market = tagged.filter("theme = 'market'").select(run).distinct()
    fallback = evidence.join(has_market, run, "left_anti").select(run, order, "claim", F.lit("market").alias("theme"))
    distinct = tagged.unionByName(fallback).groupBy(run, "theme", "claim").agg(F.min(order).alias(order))
    return distinct if first is None else _ranked(distinct, [run, "theme"], [order], first)


def _ranked(df: DataFrame, keys: list[str], order: list[str], first: int) -> DataFrame:
    from pyspark.sql import Window
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= first)


def category_analysis(evidence: DataFrame, sources: DataFrame, run: str) -> DataFrame:
    """Per run and category: sources, high-confidence and numeric evidence."""
    strong = (F.col("confidence") >= 0.7) & (F.col("status") != "unverified")
    left = sources.groupBy(run, "category").agg(F.count(F.lit(1)).alias("sources"))
    right = evidence.groupBy(run, "category").agg(F.count_if(strong).alias("high_confidence"), F.count_if(strong & (F.col("metrics") > 0)).alias("numeric"))
    return left.join(right, [run, "category"], "left").fillna(0, ["high_confidence", "numeric"])
