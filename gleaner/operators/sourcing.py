"""Source records: one schema out of several writers, validity, filtered listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import lexicons as L
from gleaner.functions import urls as U
from gleaner.functions.text import strip
from gleaner.operators.dedup import content_hash, normalized_hash


def source_problem(url: Column, title: Column, snippet: Column, content: Column, query: Column, metadata_only: Column) -> Column:
    """Null for a usable source, else the first rule that rejects it."""
    placeholder = U.placeholder_reason(url, [snippet, title, content], query)
    return (F.when(~F.coalesce(url, F.lit("")).rlike("^https?://"), "bad_scheme").when(placeholder.isNotNull(), placeholder)
            .when(metadata_only, "metadata_only").when((strip(snippet) == "") & (strip(content) == ""), "empty"))


def _first(df: DataFrame, names: list[str]) -> Column:
    """First non-blank of the alias columns that exist."""
    present = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def conform_sources(*writers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources, quarantined): the writers' alias fields reconciled to one schema; rows without id or URL are set aside."""
    def one(df: DataFrame) -> DataFrame:
        url = U.canonical_url(_first(df, ["url"]))
        content = F.coalesce(_first(df, ["content", "clean_text", "raw_content", "snippet"]), F.lit(""))
        body = F.when(content != "", content).otherwise(F.coalesce(url, F.lit("")))
        kind = F.lower(_first(df, ["source_type", "type"]))
        return df.select(
            _first(df, ["source_id", "id", "_id"]).alias("source_id"), F.coalesce(_first(df, ["research_id"]), F.lit("")).alias("research_id"),
            url.alias("url"), _first(df, ["title"]).alias("title"),
            F.coalesce(_first(df, ["domain"]), U.domain_of(url)).alias("domain"), content.alias("content"),
            F.coalesce(F.when(kind.isin(*L.SOURCE_TYPES), kind), F.lit("other")).alias("source_type"),
            _first(df, ["published_at", "publication_date", "published_date"]).alias("published_at"),
            F.coalesce(_first(df, ["content_hash"]), content_hash(body)).alias("content_hash"),
            F.coalesce(_first(df, ["normalized_hash"]), normalized_hash(body)).alias("normalized_hash"))

    rows = [one(w) for w in writers]
    merged = rows[0]
    for more in rows[1:]:
        merged = merged.unionByName(more, allowMissingColumns=True)
    bad = F.col("source_id").isNull() | (F.coalesce("url", F.lit("")) == "")
    return merged.filter(~bad), merged.filter(bad)


def list_sources(sources: DataFrame, research_id=None, domain=None, source_type=None, language=None, min_relevance=None,
                 min_credibility=None) -> DataFrame:
    """Filtered listing, best relevance first.  Every filter is a plain predicate, so it reaches the scan."""
    def same(column: str, value: str) -> Column:
        return F.lower(F.trim(column)) == value.strip().lower()

    tests = [
        None if research_id is None else F.col("research_id") == research_id,
        None if domain is None else same("domain", domain), None if source_type is None else same("source_type", source_type),
        None if language is None else same("language", language),
        None if min_relevance is None else F.col("relevance_score") >= min_relevance,
        None if min_credibility is None else F.col("credibility_score") >= min_credibility]
    for test in tests:
        sources = sources if test is None else sources.filter(test)
    return sources.orderBy(F.desc("relevance_score"), F.asc("source_id"))
