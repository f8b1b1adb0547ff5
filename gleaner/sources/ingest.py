"""Readers of landed provider responses and feeds.

Every rule works on a frame of raw bodies (one response or one feed entry per row), so it serves files, tables and
streams alike; the ``read_*`` helpers give such frames from folders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.text import collapse, light_text, strip

RESULT = ("title", "url", "snippet", "provider")

TAVILY = "results array<struct<title:string,url:string,content:string,score:double>>"
SERPER = "organic array<struct<title:string,link:string,snippet:string>>"
WIKIPEDIA = "query struct<search:array<struct<title:string,snippet:string,pageid:bigint>>>"
SEMANTIC = ("data array<struct<title:string,abstract:string,year:int,citationCount:int,url:string,openAccessPdf:struct<url:string>,"
            "externalIds:struct<DOI:string>,authors:array<struct<name:string>>>>")
CROSSREF = ("message struct<items:array<struct<title:array<string>,abstract:string,DOI:string,URL:string,`is-referenced-by-count`:int,"
            "author:array<struct<given:string,family:string>>,`published-print`:struct<`date-parts`:array<array<int>>>>>>")
RSS_ITEM = "title string, link string, description string, pubDate string, source struct<_url:string,_VALUE:string>"
ARXIV_ENTRY = ("id string, title string, summary string, published string, author array<struct<name:string>>, "
               "link array<struct<_href:string,_title:string>>, doi string")
PUBMED_ARTICLE = ("MedlineCitation struct<PMID:string,Article:struct<ArticleTitle:string,Abstract:struct<AbstractText:array<struct<_Label:string,_VALUE:string>>>,"
                  "AuthorList:struct<Author:array<struct<LastName:string,ForeName:string>>>,Journal:struct<JournalIssue:struct<PubDate:struct<Year:string>>>>>")


def read_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON response per line."""
    return spark.read.text(folder).withColumnRenamed("value", "body")


def read_entries(spark: SparkSession, folder: str, tag: str, schema: str) -> DataFrame:
    """Feed entries straight from XML files; ``tag`` splits large files."""
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(folder)


def _results(rows: DataFrame, title: Column, url: Column, snippet: Column, provider: str) -> DataFrame:
    out = rows.select(title.alias("title"), strip(url).alias("url"), snippet.alias("snippet"), F.lit(provider).alias("provider"))
    return out.filter((F.coalesce("title", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != ""))


def web_results(bodies: DataFrame) -> DataFrame:
    """Search results of the three response shapes, one schema."""
    def rows(schema: str, path: str) -> DataFrame:
        return bodies.select(F.from_json("body", schema).alias("j")).select(F.explode(f"j.{path}").alias("r"))

    r = lambda n: F.col(f"r.{n}")
    tavily = _results(rows(TAVILY, "results"), r("title"), r("url"), r("content"), "tavily")
    serper = _results(rows(SERPER, "organic"), r("title"), r("link"), r("snippet"), "serper")
    page = F.concat(F.lit("https://en.wikipedia.org/wiki/"), F.replace(r("title"), F.lit(" "), F.lit("_")))
    wiki = _results(rows(WIKIPEDIA, "query.search"), r("title"), page, F.regexp_replace(r("snippet"), "<[^>]+>", ""), "wikipedia")
    return tavily.unionByName(serper).unionByName(wiki)


def news_items(entries: DataFrame) -> DataFrame:
    """RSS items (columns as in RSS_ITEM)."""
    return entries.select(light_text(F.col("title")).alias("title"), strip(F.col("link")).alias("url"), light_text(F.col("description")).alias("snippet"),
                          strip(F.col("pubDate")).alias("published_at"), F.col("source._url").alias("publisher_url"), F.lit("google-news").alias("provider")
                          ).filter("title <> '' and url <> ''")


def arxiv_papers(entries: DataFrame, snippet_chars: int | None = None) -> DataFrame:
    pdf = F.get(F.filter("link", lambda x: x["_title"] == "pdf"), F.lit(0))["_href"]
    abstract = collapse(F.col("summary"))
    return entries.select(collapse(F.col("title")).alias("title"), F.replace(strip(F.col("id")), F.lit("/pdf/"), F.lit("/abs/")).alias("url"), pdf.alias("pdf_url"),
                          F.transform("author", lambda a: a["name"]).alias("authors"), "doi", F.substring("published", 1, 4).alias("year"), abstract.alias("abstract"),
                          (abstract if snippet_chars is None else F.substring(abstract, 1, snippet_chars)).alias("snippet"), F.lit("arxiv").alias("source"))


def scholar_papers(bodies: DataFrame) -> DataFrame:
    rows = bodies.select(F.explode(F.from_json("body", SEMANTIC)["data"]).alias("p"))
    return rows.select(F.col("p.title").alias("title"), F.col("p.url").alias("url"), F.col("p.openAccessPdf.url").alias("pdf_url"),
                       F.transform("p.authors", lambda a: a["name"]).alias("authors"), F.col("p.externalIds.DOI").alias("doi"), F.col("p.year").cast("string").alias("year"),
                       F.col("p.abstract").alias("abstract"), F.col("p.citationCount").alias("citations"), F.lit("semantic_scholar").alias("source"))


def crossref_papers(bodies: DataFrame) -> DataFrame:
    rows = bodies.select(F.explode(F.from_json("body", CROSSREF)["message"]["items"]).alias("p"))
    year = F.get(F.get(F.col("p.published-print.date-parts"), F.lit(0)), F.lit(0))
    return rows.select(F.get("p.title", F.lit(0)).alias("title"), F.coalesce("p.URL", F.concat(F.lit("https://doi.org/"), F.col("p.DOI"))).alias("url"), F.lit(None).cast("string").alias("pdf_url"),
                       F.transform("p.author", lambda a: F.concat_ws(" ", a["given"], a["family"])).alias("authors"), F.col("p.DOI").alias("doi"), year.cast("string").alias("year"),
                       strip(F.regexp_replace("p.abstract", "<[^>]+>", "")).alias("abstract"), F.col("p.is-referenced-by-count").alias("citations"), F.lit("crossref").alias("source"))


def pubmed_papers(entries: DataFrame) -> DataFrame:
    a = F.col("MedlineCitation.Article")
    parts = F.transform(a["Abstract"]["AbstractText"], lambda t: F.when(t["_Label"].isNotNull(), F.concat(t["_Label"], F.lit(": "), t["_VALUE"])).otherwise(t["_VALUE"]))
    return entries.select(a["ArticleTitle"].alias("title"), F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), F.col("MedlineCitation.PMID"), F.lit("/")).alias("url"),
                          F.transform(a["AuthorList"]["Author"], lambda x: F.concat_ws(" ", x["ForeName"], x["LastName"])).alias("authors"),
                          a["Journal"]["JournalIssue"]["PubDate"]["Year"].alias("year"), F.array_join(parts, " ").alias("abstract"), F.lit("pubmed").alias("source"))


def parse_entries(bodies: DataFrame, schema: str) -> DataFrame:
    """Raw entry texts as entry rows."""
    return bodies.select(F.from_xml("body", schema).alias("e")).select("e.*")
