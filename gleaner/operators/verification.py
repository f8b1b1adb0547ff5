"""Support, verdicts, grounding and coverage of claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner import lexicons as L
from gleaner.functions import text as T
from gleaner.functions import tokens as K
from gleaner.operators import blocks as B
from gleaner.operators import counted
from gleaner.operators import covered as N
from gleaner.operators import overlap as O
from gleaner.operators import quality as Q
from gleaner.session import cut_lineage


def claim_text(c: Column) -> Column:
    """Lower case, punctuation to blanks."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", " ")


def _sayable(mentions: DataFrame) -> DataFrame:
    """Mentions that a ``claim_text`` can hold: those without the signs that became blanks there."""
    return mentions.filter(~F.lower("mention").rlike(r"[^\p{L}\p{N}_\s]"))


def _scored_pairs(claims: DataFrame, evidence: DataFrame, run: str, share: float, per_entity: float, per_metric: float) -> DataFrame:
    """Claim-evidence pairs that can reach ``share``, with the words shared and the mention bonus.

    Without a bonus a pair needs the share itself, which the rare-prefix join finds; with one it needs a mention, which
    the mention join finds and weighs.  Their union misses nothing, and every candidate is verified on hashed word sets.
    """
    left = claims.select(run, F.col("claim_id").alias("id"), O.hashed(K.word_set(F.col("claim"))).alias("tokens"))
    right = evidence.select(run, F.col("evidence_id").alias("id"), O.hashed(K.word_set(F.col("body"))).alias("tokens"))
    weigh = lambda c, w: evidence.select(run, F.col("evidence_id").alias("id"), F.explode(c).alias("mention"), F.lit(w).alias("weight"))
    mentions = _sayable(weigh("entities", per_entity).unionByName(weigh("metrics", per_metric)))
    texts = claims.select(run, F.col("claim_id").alias("id"), claim_text(F.col("claim")).alias("text"))
    covered = O.coverage_pairs(left, right, [run], share).withColumn("bonus", F.lit(0.0))
    key = lambda c: F.xxhash64(F.lower(T.strip(F.col(c))))
    # a claim without words is met by its equals only
    bare = claims.filter(F.size(K.word_set(F.col("claim"))) == 0).select(run, F.col("claim_id").alias("left_id"), key("claim").alias("ck"))
    equal = bare.join(evidence.select(run, F.col("evidence_id").alias("right_id"), key("evidence_claim").alias("ck")).hint("merge"), [run, "ck"]).select(run, "left_id", "right_id", F.lit(0.0).alias("bonus"))
    pairs = covered.unionByName(equal).unionByName(O.mention_weights(texts, mentions, [run])).groupBy(run, "left_id", "right_id").agg(F.max("bonus").alias("bonus"))
    c = claims.select(F.col("claim_id").alias("left_id"), O.hashed(K.word_set(F.col("claim"))).alias("ct"), key("claim").alias("ck"))
    e = evidence.select(F.col("evidence_id").alias("right_id"), O.hashed(K.word_set(F.col("body"))).alias("et"), key("evidence_claim").alias("ek"))
    joined = pairs.join(c.hint("merge"), "left_id").join(e.hint("merge"), "right_id")
    scored = joined.select(run, "left_id", "right_id", (O.shared_share(F.col("ct"), F.col("et")) + F.col("bonus")).alias("match"), (F.col("ck") == F.col("ek")).alias("exact"))
    facts = evidence.select(F.col("evidence_id").alias("right_id"), "confidence", "status", "source_id")
    return scored.filter(F.col("exact") | (F.round("match", 9) >= share)).join(facts.hint("merge"), "right_id")


def _sides(claims: DataFrame, evidence: DataFrame, run: str, per_entity: float, per_metric: float, *more: Column) -> tuple[DataFrame, DataFrame]:
    """Claims and evidence as sets of hashes: (run, id, tokens, key, mentions), with the weights of mentions and ``more`` for evidence."""
    key = lambda c: F.xxhash64(F.lower(T.strip(F.col(c))))
    texts = claims.select(run, F.col("claim_id").alias("id"), claim_text(F.col("claim")).alias("text"))
    names = _sayable(evidence.select(run, F.explode(F.concat("entities", "metrics")).alias("mention")))
    left = claims.select(run, F.col("claim_id").alias("id"), O.hashed(K.word_set(F.col("claim"))).alias("tokens"), key("claim").alias("key"))
    left = left.join(O.mentioned(texts, names, [run]).hint("merge"), [run, "id"], "left").withColumn("mentions", F.coalesce("mentions", F.array().cast("array<bigint>")))
    long = lambda c: F.transform(F.filter(c, lambda m: F.length(m) >= 3), lambda m: F.xxhash64(F.lower(m)))
    weigh = lambda c, w: F.transform(long(F.col(c)), lambda m: F.lit(w))
    right = evidence.select(run, F.col("evidence_id").alias("id"), O.hashed(K.word_set(F.col("body"))).alias("tokens"), key("evidence_claim").alias("key"),
                            F.concat(long(F.col("entities")), long(F.col("metrics"))).alias("mentions"), F.concat(weigh("entities", per_entity), weigh("metrics", per_metric)).alias("weights"), *more)
    return left, right


def _best(claims: DataFrame, evidence: DataFrame, run: str, share: float, per_entity: float, per_metric: float, k: int, exact: float, factor: Column) -> DataFrame:
    """(left_id, right_id, value, rank): the k best pieces of evidence of each claim, by ``overlap.best_matches``."""
    left, right = _sides(claims, evidence, run, per_entity, per_metric, factor.alias("factor"))
    return O.best_matches(left, right, run, share, k, exact)


def support_facts(claims: DataFrame, evidence: DataFrame, sources: DataFrame, as_of_year: int, run: str = "research_id", share: float = 0.45, rows: int = B.ROWS) -> DataFrame:
    """One row per claim with supporting evidence (``supporting_evidence``), counted without listing it: (claim_id, supporting,
    best, flagged, distinct_sources, avg_credibility, and for ``quality.assessed`` strength, quality, recency, n).

    sources: source_id (unique), url, credibility_score, published_at.  Means are those of decimals."""
    claims, known = cut_lineage(claims.select(run, "claim_id", "claim")), sources.select("source_id", "url", "credibility_score", "published_at")
    evidence = cut_lineage(evidence.join(known, "source_id", "left"))
    whole = lambda c: (c.cast("decimal(28,15)") * F.lit(10**N.SCALE).cast("decimal(16,0)")).cast("bigint")
    more = [F.xxhash64(F.coalesce("url", F.col("source_id").cast("string"))), F.when(F.col("source_id").isNotNull(), F.xxhash64("source_id")), F.col("confidence"),
            F.when(F.col("status").isin(*L.DISPUTED_STATUSES), F.xxhash64(F.concat_ws(":", "source_id", "status"))),
            whole(F.col("credibility_score")), whole(F.col("confidence")), whole(Q.recency_score(F.col("published_at"), as_of_year))]
    names = ["unit", "source", "confidence", "flag", *N.MEANS]
    left, right = _sides(claims, evidence, run, 0.15, 0.20, *[c.alias(n) for c, n in zip(more, names)])
    right = right.withColumn("unit", F.when(F.col("source").isNotNull(), F.col("unit")))
    found = N.facts(cut_lineage(left), cut_lineage(right), run, share, rows)
    return found.select(F.col("id").alias("claim_id"), F.col("n").alias("supporting"), "best", "flagged", F.col("units").alias("distinct_sources"),
                        F.coalesce("credibility", F.lit(0.85)).alias("avg_credibility"), "strength", F.col("credibility").alias("quality"), "recency", F.col("sources").alias("n"))


def supporting_evidence(claims: DataFrame, evidence: DataFrame, run: str = "research_id", share: float = 0.45, k: int | None = None) -> DataFrame:
    """(run, claim_id, evidence_id, score, rank, confidence, status, source_id): matching evidence of the run, an equal claim
    counts 1.0.  The best ``k`` come from blocks without any listing of pairs; all of them (None) are listed, unranked.
    Both sides are stored first, as their rules are dear and several steps read them."""
    claims, evidence = cut_lineage(claims.select(run, "claim_id", "claim")), cut_lineage(evidence)
    if k is not None:
        best = _best(claims, evidence, run, share, 0.15, 0.20, k, 1.0, F.lit(1.0))
        facts = evidence.select(run, F.col("evidence_id").alias("right_id"), "confidence", "status", "source_id")
        return best.join(facts.hint("merge"), "right_id").select(run, F.col("left_id").alias("claim_id"), F.col("right_id").alias("evidence_id"), F.col("value").alias("score"), "confidence", "status", "source_id", "rank")
    scored = _scored_pairs(claims, evidence, run, share, 0.15, 0.20)
    score = F.when(F.col("exact"), F.lit(1.0)).otherwise(F.col("match"))
    return scored.select(run, F.col("left_id").alias("claim_id"), F.col("right_id").alias("evidence_id"), F.round(score, 9).alias("score"),
                         "confidence", "status", "source_id").filter(F.col("score") >= share)


def compare_sources(support: DataFrame, sources: DataFrame) -> DataFrame:
    """Per claim: distinct sources and average credibility (.85 where no source is known).  The mean is taken of decimals, so
    that neither the order of the rows nor binary noise decides how an exact half is rounded."""
    joined = support.join(sources.select("source_id", "url", "credibility_score"), "source_id", "left")
    return joined.groupBy("claim_id").agg(
        F.countDistinct(F.coalesce("url", F.col("source_id").cast("string"))).alias("distinct_sources"), F.countDistinct("url").alias("distinct_urls"),
        F.coalesce(F.avg(F.col("credibility_score").cast("decimal(28,15)")).cast("double"), F.lit(0.85)).alias("avg_credibility"))


def claim_confidence(best: Column, credibility: Column, sources: Column, conflicts: Column) -> Column:
    # the tiny nudge keeps binary noise from deciding how an exact half is rounded
    score = F.coalesce(best, F.lit(0.85)) * 0.7 + credibility * 0.3
    score = score + F.when(sources >= 3, 0.08).when(sources == 2, 0.04).otherwise(0.0)
    score = score - F.least(F.lit(0.50), conflicts * 0.25)
    return F.when(sources.isNull() | (sources == 0), 0.30).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score + 1e-9)), 2))


def claim_facts(claims: DataFrame, support: DataFrame, compared: DataFrame, conflicts: DataFrame) -> DataFrame:
    """One row per claim: supporting count, sources, credibility, contradictions, confidence.

    A contradiction is a conflicting pool claim (``conflicts``: claim_id, links) or a supporting item that is itself disputed.
    """
    per = support.groupBy("claim_id").agg(F.count(F.lit(1)).alias("supporting"), F.max("confidence").alias("best"),
                                          F.countDistinct(F.when(F.col("status").isin(*L.DISPUTED_STATUSES), F.concat_ws(":", "source_id", "status"))).alias("flagged"))
    return facts_of(claims, per.join(compared, "claim_id", "full"), conflicts)


def facts_of(claims: DataFrame, found: DataFrame, conflicts: DataFrame) -> DataFrame:
    """``claim_facts`` from counted support (``support_facts``)."""
    against = conflicts.select("claim_id", F.col("links").alias("conflicting"))
    rows = claims.select("claim_id").join(found, "claim_id", "left").join(against, "claim_id", "left")
    rows = rows.fillna(0, ["supporting", "flagged", "conflicting", "distinct_sources"]).withColumn("contradictions", F.col("flagged") + F.col("conflicting"))
    return rows.withColumn("confidence", claim_confidence(F.col("best"), F.col("avg_credibility"), F.col("distinct_sources"), F.col("contradictions")))


def verdicts(facts: DataFrame, assessed: DataFrame) -> DataFrame:
    """Supported when evidence exists, confidence is .60 or more and nothing contradicts."""
    both = facts.join(assessed.select("claim_id", F.col("score").alias("assessment")), "claim_id", "left").fillna(0.3, ["assessment"])
    final = F.when(F.col("contradictions") > 0, F.least("confidence", "assessment")).otherwise(F.greatest("confidence", "assessment"))
    rows = both.select("claim_id", "supporting", "contradictions", final.alias("confidence"))
    supported = (F.col("supporting") > 0) & (F.col("confidence") >= 0.60) & (F.col("contradictions") == 0)
    return rows.withColumn("supported", supported).withColumn(
        "status", F.when(F.col("supported"), "verified").when(F.col("contradictions") > 0, "disputed").otherwise("unverified"))


# --- second rule set -----------------------------------------------------------------------------------------------------
def related_support(evidence: DataFrame, run: str, share: float = 0.55) -> DataFrame:
    """(evidence_id, related, supported, confidence): related claims overlap by .55; one of another URL supports."""
    sets = evidence.select(run, F.col("evidence_id").alias("id"), O.hashed(K.long_tokens(F.col("claim"))).alias("tokens"), F.xxhash64("source_url").alias("unit"))
    found = counted.related(sets, run, share).select(F.col("id").alias("evidence_id"), "related", F.col("other").alias("supported"))
    rows = evidence.join(found, "evidence_id", "left").fillna(0, ["related"]).fillna(False, ["supported"])
    return rows.select("evidence_id", "related", "supported",
                       F.round(F.least(F.lit(0.98), F.col("confidence") + F.when(F.col("supported"), 0.08).otherwise(0.0)), 3).alias("confidence"))


def numbers(c: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0)), lambda n: F.replace(n, F.lit(","), F.lit(""))))


def metric_numbers(c: Column) -> Column:
    return F.filter(numbers(c), lambda n: ~n.cast("double").between(1900, 2100))


def wordy(c: Column) -> Column:
    return K.long_tokens(F.regexp_replace(c, r"\d+(?:[.,]\d+)?", " "))


def independent_checks(claims: DataFrame, passages: DataFrame, run: str) -> DataFrame:
    """(claim_id, supporting, contradicting, status, confidence) against passages of other domains' pages.

    claims: run, claim_id, claim, domain, confidence; passages: run, passage_id, passage, page_url, domain.
    Support: overlap .72 without numbers, or .60 with all numbers present.  Contradiction: words overlap by .60 and none
    of the claim's measures occurs in a passage that has measures.
    """
    def features(key: str, text: str) -> list[Column]:
        c = F.col(text)
        return [run, F.col(key).alias("id"), F.xxhash64("domain").alias("domain"), O.hashed(K.long_tokens(c)).alias("tokens"), O.hashed(wordy(c)).alias("words"),
                O.hashed(numbers(c)).alias("numbers"), O.hashed(metric_numbers(c)).alias("metrics")]

    found = counted.independent(claims.select(*features("claim_id", "claim")), passages.select(*features("passage_id", "passage"), F.xxhash64("page_url").alias("unit")), run)
    per = found.withColumnRenamed("id", "claim_id")
    rows = claims.select("claim_id", F.col("confidence").alias("base")).join(per, "claim_id", "left").fillna(0, ["supporting", "contradicting"])
    score = F.col("base") + F.col("supporting") * 0.1 - F.col("contradicting") * 0.12
    return rows.select("claim_id", "supporting", "contradicting",
                       F.when(F.col("supporting") > 0, "verified").when(F.col("contradicting") > 0, "contradicted").otherwise("unverified").alias("status"),
                       F.round(F.least(F.lit(0.98), F.greatest(F.lit(0.35), score)), 3).alias("confidence"))


def first_claims(claims: DataFrame, run: str, first: int | None = None) -> DataFrame:
    """The claims worth an independent check; with ``first`` so many of each run, best confidence first."""
    if first is None:
        return claims.filter("status <> 'unverified'")
    rank = Window.partitionBy(run).orderBy(F.desc("confidence"), "claim_id")
    return claims.filter("status <> 'unverified'").withColumn("_r", F.row_number().over(rank)).filter(F.col("_r") <= first).drop("_r")


def verification_query(claim: Column, question: Column, max_chars: int | None = None) -> Column:
    """The first words of the claim and of the question."""
    head = lambda c, n: F.array_join(F.slice(F.split(c, r"\s+"), 1, n), " ")
    flat = F.regexp_replace(claim, r"[\r\n]+", " ")
    return T.head(F.concat(head(flat, 14), F.lit(" "), head(question, 6)), max_chars)


# --- report claims ----------------------------------------------------------------------------------------------------------
def report_sentences(body: Column) -> Column:
    """Assertions of a Markdown text, in order."""
    text = F.regexp_replace(body, L.BIBLIOGRAPHY_BLOCK, "")
    lines = F.filter(F.transform(F.split(text, "\n"), T.strip), lambda x: (x != "") & ~x.rlike(r"^(#|\||---|\*\*\*|```|!\[|<)"))
    bare = F.transform(lines, lambda x: F.regexp_replace(x, r"^[-*+]\s+|^\d+\.\s+", ""))
    return F.filter(F.flatten(F.transform(bare, K.simple_sentences)), lambda s: (F.length(s) >= 15) & s.rlike("[a-zA-Z]"))


def ground_claims(claims: DataFrame, evidence: DataFrame, run: str, threshold: float = 0.45, floor: float = 0.25) -> DataFrame:
    """(claim_id, grounded, confidence, evidence_id): best evidence of the run; an equal claim wins at once.

    The weight never exceeds one, so a score of ``floor`` (below it nothing is decided any more) needs a plain match of
    ``floor``: the same exact candidates as for supporting evidence.  Claims that stay below it have confidence 0.
    """
    claims, evidence = cut_lineage(claims.select(run, "claim_id", "claim")), cut_lineage(evidence)
    factor = (0.7 + 0.3 * F.col("confidence")) * F.when(F.col("status").isin(*L.DISPUTED_STATUSES), 0.3).otherwise(1.0)
    best = _best(claims, evidence, run, floor, 0.20, 0.25, 1, 10.0, factor)
    facts = evidence.select(F.col("evidence_id").alias("right_id"), "confidence")
    ranked = best.join(facts.hint("merge"), "right_id").select(F.col("left_id").alias("claim_id"), F.struct(F.col("value").alias("v"), (-F.col("right_id")).alias("e"), "confidence").alias("m"))
    score = F.when(F.col("m.v") == 10.0, F.col("m.confidence")).otherwise(F.round(F.least(F.lit(1.0), F.col("m.v") + 1e-9), 4))
    good = F.coalesce(F.col("m.v") >= threshold, F.lit(False))
    rows = claims.select("claim_id").join(ranked.hint("merge"), "claim_id", "left")
    seen = F.when(F.col("m").isNotNull() & (score >= floor), score).otherwise(0.0)
    return rows.select("claim_id", good.alias("grounded"), F.coalesce(seen, F.lit(0.0)).alias("confidence"), F.when(good, -F.col("m.e")).alias("evidence_id"))


def audit(grounded: DataFrame, report: str, allowed: float = 0.20, target: float = 0.85) -> DataFrame:
    """Per report: claims, supported, unsupported rate, coverage and what to do about it."""
    rows = grounded.groupBy(report).agg(F.count(F.lit(1)).alias("claims"), F.count_if("grounded").alias("supported"))
    share = F.col("supported") / F.col("claims")
    return rows.select(report, "claims", "supported", F.round(1 - share, 4).alias("unsupported_rate"), F.round(share, 4).alias("coverage"),
                       ((1 - share) <= allowed + 1e-12).alias("passed"), (share >= target).alias("meets_target"),
                       F.when(share >= target, "keep").when(share < 0.60, "research_again").otherwise("rewrite").alias("remediation"))


def repair_action(grounded: Column, confidence: Column, mode: str = "rewrite_or_remove") -> Column:
    """What becomes of a claim: kept if grounded; else removed, or rewritten where something speaks for it, or, in any other
    mode, flagged and left as it is."""
    if mode == "remove":
        without = F.lit("removed")
    elif mode == "rewrite_or_remove":
        without = F.when(confidence >= 0.25, "rewritten").otherwise("removed")
    else:
        without = F.lit("flagged")
    return F.when(grounded, "keep").otherwise(without)


def softened(claim: Column) -> Column:
    clean = T.strip(F.regexp_replace(claim, r"\[\d+\]", ""))
    lowered = F.concat(F.lower(F.substring(clean, 1, 1)), F.substring(clean, 2, 1 << 30))
    return F.when(clean.rlike(L.CAUTIOUS_OPENING), clean).otherwise(F.concat(F.lit("Preliminary estimates suggest that "), lowered))


def repaired_text(reports: DataFrame, grounded: DataFrame, report: str, body: str = "body") -> DataFrame:
    """Report texts with weak sentences softened and unsupported ones removed.

    grounded: report, claim, grounded, confidence.  The replacements of one report are folded over its text; a report
    has few claims and travels as one row.
    """
    action = repair_action(F.col("grounded"), F.col("confidence"))
    edits = grounded.filter(~F.col("grounded")).groupBy(report).agg(F.array_sort(F.collect_set(F.struct(
        F.col("claim").alias("old"), F.when(action == "rewritten", softened(F.col("claim"))).otherwise("").alias("new")))).alias("edits"))
    joined = reports.join(edits, report, "left")
    folded = F.aggregate(F.coalesce("edits", F.array().cast("array<struct<old:string,new:string>>")), F.col(body),
                         lambda acc, e: F.replace(acc, e["old"], e["new"]))
    tidy = F.regexp_replace(F.regexp_replace(folded, r"\n\s*[-*+]\s*\n", "\n"), r"\n{3,}", "\n\n")
    return joined.select(report, T.strip(tidy).alias("text"))


def remediation_query(claim: Column, max_chars: int | None = None) -> Column:
    clean = T.strip(F.regexp_replace(claim, r"[^\p{L}\p{N}_\s]", " "))
    words = F.filter(F.split(clean, r"\s+"), lambda w: (F.length(w) > 3) & ~F.lower(w).isin(*L.REMEDIATION_STOP))
    return (F.when(F.size(words) >= 2, F.concat(F.array_join(F.slice(words, 1, 7), " "), F.lit(" empirical data evidence")))
            .when(clean != "", F.concat(T.head(clean, max_chars), F.lit(" statistics sources"))))


def remediation_queries(grounded: DataFrame, report: str, order: str, first: int | None = None) -> DataFrame:
    """(report, order, query) of all claims without grounds; with ``first`` those of the first so many of a report."""
    weak = grounded.filter(~F.col("grounded"))
    if first is not None:
        weak = weak.withColumn("_n", F.row_number().over(Window.partitionBy(report).orderBy(order))).filter(F.col("_n") <= first)
    return weak.select(report, order, remediation_query(F.col("claim")).alias("query")).filter("query is not null")


def word_key(t: Column) -> Column:
    return (F.when(t.endswith("ies") & (F.length(t) > 4), F.concat(F.substring(t, F.lit(1), F.length(t) - 3), F.lit("y")))
            .when(t.endswith("s") & (F.length(t) > 4), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t))


def grounded_reports(reports: DataFrame, evidence: DataFrame, run: str, report: str, body: str = "body") -> DataFrame:
    """(report, lines, grounded_lines, grounded): a line is grounded when two of its words occur in the run's evidence.

    Report words meet the distinct evidence words of their run in a semi join; nothing is collected or broadcast by hand.
    """
    clean = lambda x: T.strip(F.regexp_replace(x, "[*_`>-]", ""))
    lines = F.filter(F.transform(F.filter(F.transform(F.split(F.col(body), "\n"), T.strip), lambda x: ~x.rlike(r"^$|^#|^\[")), clean), lambda x: F.length(x) >= 25)
    rows = reports.select(run, report, F.posexplode(lines).alias("line_no", "line"))
    keys = lambda c: F.array_distinct(F.transform(K.tokens(c, (), 4), word_key))
    known = evidence.select(run, F.explode(keys(F.col("text"))).alias("word")).distinct()
    hits = rows.select(run, report, "line_no", F.explode(keys(F.col("line"))).alias("word")).join(known, [run, "word"], "left_semi")
    good = hits.groupBy(report, "line_no").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").groupBy(report).agg(F.count(F.lit(1)).alias("grounded_lines"))
    total = rows.groupBy(report).agg(F.count(F.lit(1)).alias("lines"))
    joined = total.join(good, report, "left").fillna(0, ["grounded_lines"])
    return joined.withColumn("grounded", F.col("grounded_lines") >= F.greatest(F.lit(1), F.floor(F.col("lines") * 0.6)))


def outline(themes: DataFrame, findings: DataFrame, conflicts: DataFrame, run: str, order: str = "claim_id") -> DataFrame:
    """(run, section, theme, order, text): the rows of a run's outline, whose order is that of the column ``order`` in each
    section: distinct findings, claims by theme, and the likely causes of contradictions."""
    part = lambda df, section, theme, text: df.select(run, F.lit(section).alias("section"), theme.alias("theme"), order, F.col(text).alias("text"))
    none = F.lit(None).cast("string")
    first = findings.groupBy(run, "claim").agg(F.min(order).alias(order))
    return part(first, "finding", none, "claim").unionByName(part(themes, "theme", F.col("theme"), "claim")).unionByName(part(conflicts, "contradiction", none, "cause"))
