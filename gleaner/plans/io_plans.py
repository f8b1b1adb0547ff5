"""Ingest and export queries over responses and reports that Spark derives from the tables."""

import uuid

from pyspark.sql import functions as F

from gleaner.plans import inputs as I
from gleaner.plans.registry import query
from gleaner.plans.sqlkit import STRIP, sql_str
from gleaner.session import ensure_checkpoint_dir
from gleaner.sources import export as X
from gleaner.sources import ingest as N
from gleaner.sources.tables import spread, table


def turns(spark, d):
    return table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("i"), "role", "text")


_T = "(SELECT conv_id * 1000 + turn AS i, role, text FROM conversations)"


def _url(i):
    return F.concat(F.lit("https://x.org/"), i.cast("string"))


@query("io4_web_results", f"""SELECT 't' || i AS title, CASE WHEN i % 3 = 2 THEN 'https://en.wikipedia.org/wiki/t' || i ELSE 'https://x.org/' || i END AS url, CASE WHEN i % 3 = 2 THEN regexp_replace('<b>' || text || '</b>', '<[^>]+>', '', 'g') ELSE text END AS snippet,
 ['tavily', 'serper', 'wikipedia'][i % 3 + 1] AS provider FROM {_T}""")
def _(spark, d):
    i, title = F.col("i"), F.concat(F.lit("t"), F.col("i").cast("string"))
    tavily = F.to_json(F.struct(F.array(F.struct(title.alias("title"), _url(i).alias("url"), F.col("text").alias("content"))).alias("results")))
    serper = F.to_json(F.struct(F.array(F.struct(title.alias("title"), _url(i).alias("link"), F.col("text").alias("snippet"))).alias("organic")))
    wiki = F.to_json(F.struct(F.struct(F.array(F.struct(title.alias("title"), F.concat(F.lit("<b>"), "text", F.lit("</b>")).alias("snippet"))).alias("search")).alias("query")))
    return N.web_results(turns(spark, d).select(F.when(i % 3 == 0, tavily).when(i % 3 == 1, serper).otherwise(wiki).alias("body")))


def _xml(c):
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


@query("io5_news_items", f"SELECT 'N ' || i AS title, 'https://x.org/' || i AS url, 'Mon, ' || i AS published_at, 'https://p.org/' || i AS publisher_url FROM {_T}")
def _(spark, d):
    i = F.col("i").cast("string")
    body = F.concat(F.lit("<item><title>N "), i, F.lit("</title><link> https://x.org/"), i, F.lit("</link><description>&lt;b&gt;"), _xml(F.col("text")), F.lit("&lt;/b&gt;</description><pubDate>Mon, "), i,
                    F.lit('</pubDate><source url="https://p.org/'), i, F.lit('">P</source></item>'))
    items = N.news_items(N.parse_entries(turns(spark, d).select(body.alias("body")), N.RSS_ITEM))
    return items.select("title", "url", "published_at", "publisher_url")


@query("io6_arxiv_papers", f"""SELECT 'A ' || i AS title, 'http://arxiv.org/abs/' || i AS url, 'http://arxiv.org/pdf/' || i AS pdf_url, 'Ann Bee|Cy ' || role AS authors, CAST(1990 + i % 30 AS VARCHAR) AS year FROM {_T}""")
def _(spark, d):
    i = F.col("i").cast("string")
    body = F.concat(F.lit("<entry><id>http://arxiv.org/abs/"), i, F.lit("</id><title>A\n "), i, F.lit("</title><summary>"), _xml(F.col("text")), F.lit("</summary><published>"), (1990 + F.col("i") % 30).cast("string"),
                    F.lit("-01-02T00:00:00Z</published><author><name>Ann Bee</name></author><author><name>Cy "), F.col("role"), F.lit('</name></author><link href="http://arxiv.org/abs/'), i,
                    F.lit('" title="abs"/><link href="http://arxiv.org/pdf/'), i, F.lit('" title="pdf"/></entry>'))
    papers = N.arxiv_papers(N.parse_entries(turns(spark, d).select(body.alias("body")), N.ARXIV_ENTRY))
    return papers.select("title", "url", "pdf_url", F.array_join("authors", "|").alias("authors"), "year")


@query("io7_scholar_papers", f"""SELECT 's' || i AS title, '10.1/' || i AS doi, CAST(2000 + i % 20 AS VARCHAR) AS year, text AS abstract, 'Ann|' || role AS authors, CAST(i % 50 AS INTEGER) AS citations, 'semantic_scholar' AS source FROM {_T} WHERE i % 2 = 0
 UNION ALL SELECT 'c' || i, '10.2/' || i, CAST(2000 + i % 20 AS VARCHAR), {STRIP("regexp_replace('<jats:p>' || text || '</jats:p>', '<[^>]+>', '', 'g')")}, 'Ann B|C ' || role, CAST(i % 50 AS INTEGER), 'crossref' FROM {_T} WHERE i % 2 = 1""")
def _(spark, d):
    i = F.col("i")
    name = lambda p: F.concat(F.lit(p), i.cast("string"))
    year, cites = (2000 + i % 20).cast("int"), (i % 50).cast("int")
    s2 = F.to_json(F.struct(F.array(F.struct(name("s").alias("title"), F.col("text").alias("abstract"), year.alias("year"), cites.alias("citationCount"), F.struct(name("10.1/").alias("DOI")).alias("externalIds"),
                                             F.array(F.struct(F.lit("Ann").alias("name")), F.struct(F.col("role").alias("name"))).alias("authors"))).alias("data")))
    cr = F.to_json(F.struct(F.struct(F.array(F.struct(F.array(name("c")).alias("title"), F.concat(F.lit("<jats:p>"), "text", F.lit("</jats:p>")).alias("abstract"), name("10.2/").alias("DOI"), cites.alias("is-referenced-by-count"),
                                                      F.array(F.struct(F.lit("Ann").alias("given"), F.lit("B").alias("family")), F.struct(F.lit("C").alias("given"), F.col("role").alias("family"))).alias("author"),
                                                      F.struct(F.array(F.array(year, F.lit(1))).alias("date-parts")).alias("published-print"))).alias("items")).alias("message")))
    rows = turns(spark, d)
    both = N.scholar_papers(rows.filter("i % 2 = 0").select(s2.alias("body"))).unionByName(N.crossref_papers(rows.filter("i % 2 = 1").select(cr.alias("body"))))
    return both.select("title", "doi", "year", "abstract", F.array_join("authors", "|").alias("authors"), "citations", "source")


@query("io8_pubmed_papers", f"SELECT 'P ' || i AS title, 'https://pubmed.ncbi.nlm.nih.gov/' || i || '/' AS url, 'Ann ' || role AS authors, '2011' AS year, 'AIM: a' || i || ' b' AS abstract FROM {_T}")
def _(spark, d):
    i = F.col("i").cast("string")
    body = F.concat(F.lit("<PubmedArticle><MedlineCitation><PMID>"), i, F.lit("</PMID><Article><ArticleTitle>P "), i, F.lit('</ArticleTitle><Abstract><AbstractText Label="AIM">a'), i,
                    F.lit("</AbstractText><AbstractText>b</AbstractText></Abstract><AuthorList><Author><LastName>"), F.col("role"),
                    F.lit("</LastName><ForeName>Ann</ForeName></Author></AuthorList><Journal><JournalIssue><PubDate><Year>2011</Year></PubDate></JournalIssue></Journal></Article></MedlineCitation></PubmedArticle>"))
    papers = N.pubmed_papers(N.parse_entries(turns(spark, d).select(body.alias("body")), N.PUBMED_ARTICLE))
    return papers.select("title", "url", F.array_join("authors", "|").alias("authors"), "year", "abstract")


def _folder(spark):
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/export-{uuid.uuid4().hex}"


@query("io9_append", f"SELECT source, count(*) AS rows FROM documents GROUP BY 1")
def _(spark, d):
    rows, folder = table(spark, d, "documents").select("doc_id", "source"), _folder(spark)
    X.append(rows.filter("doc_id % 2 = 0"), folder)
    X.append(rows.filter("doc_id % 2 = 1"), folder)
    return spark.read.schema(rows.schema).parquet(folder).groupBy("source").agg(F.count("*").alias("rows"))


def reports(spark, d):
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    return spread(table(spark, d, "documents")).select(
        F.col("doc_id").alias("report_id"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"), F.get(lines, F.lit(0)).alias("summary"), F.col("text").alias("body"), lines.alias("findings"),
        F.array(F.col("lang")).alias("recommendations"), F.array(F.col("source"), F.lit('say "no", twice')).alias("risks"), F.array(F.struct(F.lit(1).alias("index"), F.col("source").alias("title"), F.lit("https://x.org").alias("url"))).alias("citations"))


_lines = "list_filter(string_split(text, chr(10)), lambda x: x <> '')"
_CELLS = f"""(SELECT doc_id AS report_id, 'report' AS section, 0 AS n, unnest(['research_id', 'title', 'quality_score', 'confidence', 'created_at', 'exported_at', 'summary']) AS field,
  unnest([source, 'Doc ' || doc_id, CAST(doc_id % 100 AS VARCHAR), CASE WHEN doc_id % 2 = 0 THEN 'high' ELSE 'low' END, '2025-12-31T00:00:00', '2026-01-01T00:00:00', ({_lines})[1]]) AS value FROM documents
 UNION ALL SELECT doc_id, 'findings', CAST(generate_subscripts({_lines}, 1) AS INTEGER), 'finding', unnest({_lines}) FROM documents UNION ALL SELECT doc_id, 'recommendations', 1, 'recommendation', lang FROM documents
 UNION ALL SELECT doc_id, 'risks', 1, 'risk', source FROM documents UNION ALL SELECT doc_id, 'risks', 2, 'risk', 'say "no", twice' FROM documents
 UNION ALL SELECT doc_id, 'citations', 1, unnest(['title', 'url', 'domain', 'source_type']), unnest([source, 'https://x.org', 'x.org', '']) FROM documents)"""


@query("io11_csv_export", f"SELECT report_id, section, n, field, coalesce(value, '') AS value FROM {_CELLS}")
def _(spark, d):
    folder, stamp = _folder(spark), F.lit("2026-01-01").cast("timestamp")
    cite = F.struct(F.lit(1).alias("index"), F.col("risks")[0].alias("title"), F.lit("https://x.org").alias("url"), F.lit("x.org").alias("domain"), F.lit(None).cast("string").alias("source_type"))
    rows = reports(spark, d).withColumns({"research_id": F.col("risks")[0], "quality_score": F.col("report_id") % 100, "created_at": F.lit("2025-12-31").cast("timestamp"),
                                          "confidence": F.when(F.col("report_id") % 2 == 0, "high").otherwise("low"), "citations": F.array(cite)})
    X.write_csv(rows, folder, stamp)
    back = spark.read.schema(X.tidy_rows(rows, stamp).schema).option("header", True).option("escape", '"').option("multiLine", True).csv(folder)
    return back.withColumn("value", F.coalesce("value", F.lit("")))


@query("io12_json_export", "SELECT doc_id AS report_id, 'Doc ' || doc_id AS title, text AS body, '2026-01-01T00:00:00' AS exported_at FROM documents")
def _(spark, d):
    folder = _folder(spark)
    X.write_json(reports(spark, d), folder, F.lit("2026-01-01").cast("timestamp"))
    return spark.read.schema("report_id bigint, title string, body string, exported_at string").json(folder)


@query("io13_markdown_export", f"""SELECT doc_id AS report_id, '# Doc ' || doc_id || chr(10) || chr(10) || '## Executive Summary' || chr(10) || chr(10) || ({_lines})[1] || chr(10) || chr(10) || '## Key Findings' || chr(10) || chr(10) ||
 array_to_string(list_transform({_lines}, lambda f: '- ' || f), chr(10)) || chr(10) || chr(10) || text || chr(10) || chr(10) || '## Sources & References' || chr(10) || chr(10) || '[1] [' || source || '](https://x.org) — https://x.org' AS markdown FROM documents""")
def _(spark, d):
    return X.markdown(reports(spark, d))
