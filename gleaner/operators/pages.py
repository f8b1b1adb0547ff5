"""Page extraction and screening: projections over `pages`-like frames (page_id, url, html)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner import lexicons as L
from gleaner.functions import text as T


def page_metadata(pages: DataFrame) -> DataFrame:
    html = F.col("html")
    title = F.coalesce(T.page_title(html), F.get_json_object(T.page_json_ld(html), "$.headline"))
    return pages.select("page_id", title.alias("title"), T.page_author(html).alias("author"),
                        T.page_date(html).alias("published"), T.page_description(html).alias("description"))


def page_flags(pages: DataFrame, paywall_chars: int | None = None, script_chars: int | None = None) -> DataFrame:
    """Wall and script notices anywhere in the page, or only in its first characters."""
    return pages.withColumn("is_paywall", T.head(F.col("html"), paywall_chars).rlike(L.PAYWALL_PATTERN)).withColumn(
        "is_js_required", T.head(F.col("html"), script_chars).rlike(L.JS_ONLY_PATTERN))


def extract_pages(pages: DataFrame) -> DataFrame:
    """Clean text per page; the description stands in when the body is empty; corrupted text is a failure."""
    html = F.col("html")
    body = T.main_content(html)
    flagged = page_flags(pages).select(
        "page_id", "is_paywall", "is_js_required",
        F.when(F.trim(body) == "", F.coalesce(T.page_description(html), F.lit(""))).otherwise(body).alias("text"))
    reason = T.corruption_reason(F.col("text"))
    return flagged.withColumn(
        "error", F.when(F.col("text") == "", "no_text").when(reason.isNotNull(), F.concat(F.lit("corrupted:"), reason))
    ).withColumn("success", F.col("error").isNull())


def scan_injection(texts: DataFrame, column: str = "text") -> DataFrame:
    """Add matched patterns, risk level and confidence."""
    found = texts.withColumn("matched", T.injection_matches(F.col(column)))
    n = F.size("matched")
    return found.select("*", (n > 0).alias("is_injection"), T.injection_risk(n).alias("risk_level"),
                        T.injection_confidence(n).cast("double").alias("confidence"))
