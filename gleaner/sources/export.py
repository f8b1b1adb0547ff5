"""Report exports and plain sinks.  A report row: report_id, title, summary, body, arrays findings, recommendations, risks and
citations (index, title, url; for CSV also domain and source_type); for CSV also research_id, quality_score, confidence, created_at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECTIONS = ("findings", "recommendations", "risks")


def append(df: DataFrame, folder: str, partition_by: list[str] | None = None) -> None:
    """Append records; partition columns become folders, so later filters prune."""
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(folder)


def tidy_rows(reports: DataFrame, exported_at: Column) -> DataFrame:
    """(report_id, section, n, field, value): every cell of a report as one row; the header block is section ``report``."""
    stamp = lambda c: F.date_format(c.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")

    def cell(section: str, n: Column, field: str, value: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), n.cast("int").alias("n"), F.lit(field).alias("field"), value.cast("string").alias("value"))

    header = {"research_id": F.col("research_id"), "title": F.col("title"), "quality_score": F.col("quality_score"), "confidence": F.col("confidence"),
              "created_at": stamp(F.col("created_at")), "exported_at": stamp(exported_at), "summary": F.col("summary")}
    head = F.array(*[cell("report", F.lit(0), name, value) for name, value in header.items()])
    def numbered(section: str) -> Column:
        return F.transform(section, lambda v, i: cell(section, i + 1, section.removesuffix("s"), v))

    fields = ("title", "url", "domain", "source_type")
    cites = F.flatten(F.transform("citations", lambda c: F.array(*[cell("citations", c["index"], f, F.coalesce(c[f], F.lit(""))) for f in fields])))
    return reports.select("report_id", F.explode(F.concat(head, *map(numbered, SECTIONS), cites)).alias("r")).select("report_id", "r.section", "r.n", "r.field", "r.value")


def write_csv(reports: DataFrame, folder: str, exported_at: Column) -> None:
    tidy_rows(reports, exported_at).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(folder)


def json_lines(reports: DataFrame, exported_at: Column) -> DataFrame:
    return reports.withColumn("exported_at", F.date_format(exported_at, "yyyy-MM-dd'T'HH:mm:ss")).select(F.to_json(F.struct("*")).alias("value"))


def write_json(reports: DataFrame, folder: str, exported_at: Column) -> None:
    json_lines(reports, exported_at).write.mode("overwrite").text(folder)


def markdown(reports: DataFrame) -> DataFrame:
    """(report_id, markdown): title, summary, findings, body and, unless present, the bibliography."""
    bullets = F.when(F.size("findings") > 0, F.concat(F.lit("## Key Findings\n\n"), F.array_join(F.transform("findings", lambda f: F.concat(F.lit("- "), f)), "\n")))
    lines = F.transform("citations", lambda c: F.concat(F.lit("["), c["index"].cast("string"), F.lit("] ["), c["title"], F.lit("]("), c["url"], F.lit(") — "), c["url"]))
    bib = F.when(~F.col("body").contains("## Sources & References") & (F.size("citations") > 0), F.concat(F.lit("## Sources & References\n\n"), F.array_join(lines, "\n")))
    summary = F.when(F.col("summary") != "", F.concat(F.lit("## Executive Summary\n\n"), F.col("summary")))
    return reports.select("report_id", F.concat_ws("\n\n", F.concat(F.lit("# "), F.col("title")), summary, bullets, F.nullif(F.col("body"), F.lit("")), bib).alias("markdown"))


def write_markdown(reports: DataFrame, folder: str) -> None:
    markdown(reports).select(F.col("markdown").alias("value")).write.mode("overwrite").option("lineSep", "\n\f\n").text(folder)


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    edges.write.mode("overwrite").parquet(f"{folder}/edges")
