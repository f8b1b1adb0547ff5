"""Citation tables, provenance, bibliographies and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner import lexicons as L
from gleaner.functions import text as T
from gleaner.functions import tokens as K
from gleaner.operators import covered as N
from gleaner.operators import overlap as O
from gleaner.operators.numbering import numbered
from gleaner.session import cut_lineage


def url_key(c: Column) -> Column:
    return F.regexp_replace(T.strip(F.coalesce(c, F.lit(""))), "/+$", "")


def build_citations(sources: DataFrame, evidence: DataFrame, report: str = "report_id", order: str = "ord", quote_chars: int | None = None) -> DataFrame:
    """Sequential index per report over sources that are new by URL and by id; the source's first evidence is quoted.

    "New" is sequential (a source dropped by its URL does not reserve its id).  When an id always has one URL, as in a
    source table, the two first-of-key aggregates below settle it at once; both combine before the shuffle.
    """
    s = sources.withColumn("_u", F.when(url_key(F.col("url")) != "", url_key(F.col("url"))).otherwise(F.concat(F.lit("id:"), F.col("source_id").cast("string"))))
    by_id = s.groupBy(report, "source_id").agg(F.min(order).alias(order))
    s1 = s.join(by_id, [report, "source_id", order], "left_semi")
    by_url = s1.groupBy(report, "_u").agg(F.min(order).alias(order))
    kept = s1.join(by_url, [report, "_u", order], "left_semi")
    first = evidence.groupBy(report, "source_id").agg(F.min_by(F.struct("quote", "claim", "confidence"), "evidence_id").alias("e"))
    clean = lambda c: T.strip(T.head(F.regexp_replace(c, r"[\x00-\x08\x0B-\x1F\x7F]", ""), quote_chars))
    quote = F.coalesce(F.nullif(clean(F.col("e.quote")), F.lit("")), clean(F.coalesce("snippet", F.lit(""))))
    rows = numbered(kept.join(first, [report, "source_id"], "left"), report, order)
    title = F.coalesce(F.nullif(T.strip(F.col("title")), F.lit("")), F.concat(F.lit("Source "), F.col("index").cast("string")))
    return rows.select(report, "index", "source_id", "url", title.alias("title"), quote.alias("quote"), F.col("e.claim").alias("claim"),
                       F.coalesce("e.confidence", "credibility_score").alias("confidence"))


def trace(evidence: DataFrame, citations: DataFrame, sources: DataFrame, report: str = "report_id") -> DataFrame:
    """Claim → evidence → source → URL: citation by source id, else by URL, else index 1."""
    by_id = citations.select(report, "source_id", F.col("index").alias("_i1"), F.col("title").alias("_t1"), F.col("url").alias("_u1"))
    by_url = citations.groupBy(report, url_key(F.col("url")).alias("_k")).agg(F.max_by(F.struct("index", "title", "url"), "index").alias("_c"))
    src = sources.select(report, "source_id", F.col("title").alias("_t2"), F.col("url").alias("_u2")).dropDuplicates([report, "source_id"])
    rows = evidence.withColumn("_k", url_key(F.col("source_url"))).join(by_id, [report, "source_id"], "left").join(by_url, [report, "_k"], "left")
    rows = rows.join(src, [report, "source_id"], "left")
    return rows.select(report, "evidence_id", "claim", F.coalesce("_i1", "_c.index", F.lit(1)).alias("index"),
                       F.coalesce("_t1", "_c.title", "_t2", F.lit("Unknown Source")).alias("source_title"),
                       F.coalesce("_u1", "_c.url", "_u2", "source_url", F.lit("")).alias("url"))


def reference_line(index: Column, title: Column, url: Column, style: str = "standard") -> Column:
    mark = F.concat(F.lit("["), index.cast("string"), F.lit("] "))
    linked = F.concat(mark, F.lit("**["), title, F.lit("]("), url, F.lit(")**"))
    full = F.concat(mark, F.lit("["), title, F.lit("]("), url, F.lit(") — "), url)
    return linked if style == "markdown_link" else F.when(F.coalesce(url, F.lit("")) != "", full).otherwise(F.concat(mark, title))


def bibliography_lines(citations: DataFrame, report: str = "report_id", style: str = "standard") -> DataFrame:
    """(report, index, line): a bibliography as rows in order of index, for reports of any size."""
    return citations.select(report, "index", reference_line(F.col("index"), F.col("title"), F.col("url"), style).alias("line"))


def bibliography(citations: DataFrame, report: str = "report_id", style: str = "standard") -> DataFrame:
    """``bibliography_lines`` joined to one text per report, which a report with very many sources should not ask for."""
    line = reference_line(F.col("index"), F.col("title"), F.col("url"), style)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("index", line.alias("l")))), lambda x: x["l"])
    return citations.groupBy(report).agg(F.concat(F.lit("## Sources & References\n\n"), F.array_join(lines, "\n"), F.lit("\n")).alias("bibliography"))


def cited_indices(body: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"\[(\d+)\]"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("int"))))


def verify_citations(reports: DataFrame, citations: DataFrame, report: str = "report_id", body: str = "body") -> DataFrame:
    """Cited, orphan and unused indices of every report."""
    known = citations.groupBy(report).agg(F.array_sort(F.collect_set("index")).alias("available"))
    rows = reports.join(known, report, "left").select(report, cited_indices(F.col(body)).alias("cited"),
                                                      F.coalesce("available", F.array().cast("array<int>")).alias("available"))
    return rows.withColumn("orphan", F.array_except("cited", "available")).withColumn("unused", F.array_except("available", "cited")).withColumn(
        "valid", F.size("orphan") == 0)


def inline_matches(sentences: DataFrame, evidence: DataFrame, run: str, share: float = 0.55) -> DataFrame:
    """(sentence_id, evidence_id, index): first cited evidence whose claim words cover the sentence or whose number is in it.

    sentences: run, sentence_id, sentence; evidence: run, evidence_id (unique), claim, metrics, index.  A claim's words count
    when they are substrings of the sentence.  Only the first evidence of each number is kept, so the first one a sentence has
    by a number bounds those it may have by words; these are looked for block by block in the order of their ids
    (``covered.first_covered``), and no pair is listed.
    """
    fit = sentences.filter((F.length(T.strip(F.col("sentence"))) >= 20) & ~F.col("sentence").contains("["))
    texts = cut_lineage(fit.select(run, F.col("sentence_id").alias("id"), F.lower(T.strip(F.col("sentence"))).alias("text")))
    words = F.filter(F.regexp_extract_all(F.lower(F.col("claim")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: F.length(w) > 3)
    e = cut_lineage(evidence.filter("index is not null").select(run, F.col("evidence_id").alias("id"), "index", words.alias("words"), F.transform("metrics", F.lower).alias("numbers")).filter(F.size("words") > 0))
    first = e.select(run, "id", F.explode("numbers").alias("mention")).groupBy(run, "mention").agg(F.min("id").alias("first"))
    named = O._holding(texts, first.filter(F.length("mention") >= 3).select(run, "mention"), [run])
    # numbers of one or two signs have no three letters; the sentences that hold one meet them by the number itself
    signs = texts.select(run, "id", F.explode(F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(1), F.length("text")), lambda i: F.array(F.substring(F.col("text"), i, F.lit(1)), F.substring(F.col("text"), i, F.lit(2))))))).alias("mention"))
    short = first.filter(F.length("mention") < 3).select(run, "mention")
    if not short.isEmpty():
        named = named.unionByName(signs.join(short.hint("merge"), [run, "mention"]).select(run, "id", "mention"))
    by_number = cut_lineage(named.join(first.hint("merge"), [run, "mention"]).groupBy("id").agg(F.min("first").alias("first")))
    held = O.mentioned(texts, e.select(run, F.explode("words").alias("mention")), [run])
    bound = F.coalesce("first", F.lit((1 << 63) - 1))
    left = cut_lineage(held.join(by_number.hint("merge"), "id", "left").select(run, "id", F.col("mentions").alias("tokens"), bound.alias("bound")))
    by_words = N.first_covered(left, e.select(run, "id", O.hashed(F.col("words")).alias("tokens")), run, share)
    best = by_number.unionByName(by_words).groupBy(F.col("id").alias("sentence_id")).agg(F.min("first").alias("evidence_id"))
    return best.join(e.select(F.col("id").alias("evidence_id"), "index").hint("merge"), "evidence_id").select("sentence_id", "evidence_id", "index")


def with_marks(sentences: DataFrame, matches: DataFrame, report: str, order: str) -> DataFrame:
    """Texts rebuilt with [n] after matched sentences."""
    mark = F.concat(F.lit("["), F.col("index").cast("string"), F.lit("]"))
    bare = T.strip(F.col("sentence"))
    marked = F.when(bare.rlike("[.!?]$"), F.concat(F.regexp_replace(bare, r"\s*[.!?]$", ""), F.lit("."), mark)).otherwise(F.concat(bare, F.lit(" "), mark))
    rows = sentences.join(matches.select("sentence_id", "index"), "sentence_id", "left").withColumn(
        "_s", F.when(F.col("index").isNotNull(), marked).otherwise(F.col("sentence")))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_s").alias("s"))))
    return rows.groupBy(report).agg(F.array_join(F.transform(parts, lambda x: x["s"]), " ").alias("text"))


def with_bibliography(reports: DataFrame, bibliographies: DataFrame, report: str = "report_id", body: str = "body") -> DataFrame:
    """Standard bibliography at the end unless present; an ad-hoc reference block is replaced."""
    text = T.strip(F.coalesce(body, F.lit("")))
    cut = F.regexp_replace(F.regexp_replace(text, L.BIBLIOGRAPHY_BLOCK, ""), r"\s+$", "")
    joined = reports.join(bibliographies, report, "left")
    return joined.select(report, F.when(F.col("bibliography").isNull(), F.col(body)).when(text.contains("## Sources & References"), text)
                         .otherwise(F.concat(cut, F.lit("\n\n"), F.col("bibliography"))).alias("text"))


def linked_citations(sources: DataFrame, evidence: DataFrame, checks: DataFrame, run: str, order: str) -> DataFrame:
    """One citation per URL with the evidence taken from it and the claims it verifies."""
    first = sources.groupBy(run, "url").agg(F.min_by("title", order).alias("title"), F.min(order).alias(order))
    ids = evidence.groupBy(run, F.col("source_url").alias("url")).agg(F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"))
    claims = checks.groupBy(run, "url").agg(F.array_sort(F.collect_set("claim_id")).alias("verification_for"))
    rows = first.join(ids, [run, "url"], "left").join(claims, [run, "url"], "left")
    return numbered(rows, run, order).select(run, "index", "url", "title", F.coalesce(F.size("evidence_ids"), F.lit(0)).alias("evidence_count"), "evidence_ids", "verification_for")


def section_keys(question: Column) -> Column:
    """Report sections a question asks for; market and risks when it names none."""
    low = F.lower(question)
    named = F.filter(F.array(*[F.when(T.contains_any(low, terms), F.lit(key)) for key, terms in L.SECTION_TERMS]), lambda k: k.isNotNull())
    fixed = F.array(*[F.lit(k) for k in ("executive_summary", "key_findings", "evidence_analysis")])
    return F.concat(fixed, F.when(F.size(named) == 0, F.array(F.lit("market_analysis"), F.lit("risks"))).otherwise(named))
