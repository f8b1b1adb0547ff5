"""Working tables derived from the given ones, each as a Spark frame and as a DuckDB sub-query.

The given texts are invented words without dates, domains or trends.  Fields a rule needs are therefore added by row
number over the whole table; nothing is left out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions import tokens as K
from gleaner.plans.sqlkit import SENT, STRIP, sql_list, sql_str
from gleaner.sources.tables import spread, table

HOSTS = ("health.gov", "lab.example.edu", "arxiv.org", "reuters.com", "gartner.com", "medium.com", "reddit.com", "shop.example.com",
         "www.sec.gov", "news.example.net", "pinterest.com", "wiki.example.org")
KINDS = ("news", "government", "company", "academic", "financial", "blog", "forum", "social", "other", "web")
PHRASES = (
    "Sales in India increased 12% in 2023", "Sales in India decreased 7% in 2024", "Growth in Canada declined by 3%",
    "The market share of buses rose to 18%", "The market share of buses dropped to 9% according to a survey",
    "Growth is forecast to reach 40% by 2030", "Two-wheeler sales volume fell below 1,200,000 units",
    "Two-wheeler sales volume surged past 1,500,000 units", "The subsidy was expanded to $2.5 billion",
    "The subsidy shrank to $900 million in the adjusted dataset", "Further research is needed on this point",
    "Other reports contradict this number", "The price fell by 5% in Germany", "The price rose 5% in Germany",
    "Range of passenger cars is measured at 450 km", "The ministry published a regulation in 2022")


def pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def sql_pick(values, index: str) -> str:
    return f"([{sql_list(values)}])[({index}) % {len(values)} + 1]"


def documents(spark, d):
    return spread(table(spark, d, "documents"))


def sources(spark, d):
    i = F.col("doc_id")
    host = pick(HOSTS, i)
    return documents(spark, d).select(
        i.alias("source_id"), F.col("source").alias("research_id"),
        F.concat(F.lit("https://"), host, F.lit("/"), F.col("lang"), F.lit("/"), i.cast("string")).alias("url"),
        F.regexp_replace(host, r"^www\.", "").alias("domain"), F.substring("text", 1, 60).alias("title"),
        F.substring("text", 1, 200).alias("snippet"), F.col("text").alias("content"), pick(KINDS, F.expr("doc_id div 3")).alias("source_type"),
        F.when(F.pmod(i, F.lit(5)) == 0, None).otherwise((2015 + F.pmod(i, F.lit(12))).cast("string")).alias("published_at"),
        F.col("lang").alias("language"), (0.3 + F.pmod(i, F.lit(7)) / 10).alias("relevance_score"),
        (0.4 + F.pmod(i, F.lit(12)) / 20).alias("credibility_score"))


SOURCES = f"""(SELECT doc_id AS source_id, source AS research_id, 'https://' || {sql_pick(HOSTS, 'doc_id')} || '/' || lang || '/' || doc_id AS url,
  regexp_replace({sql_pick(HOSTS, 'doc_id')}, '^www\\.', '') AS domain, substr(text, 1, 60) AS title, substr(text, 1, 200) AS snippet,
  text AS content, {sql_pick(KINDS, 'doc_id // 3')} AS source_type,
  CASE WHEN doc_id % 5 = 0 THEN NULL ELSE CAST(2015 + doc_id % 12 AS VARCHAR) END AS published_at, lang AS language,
  0.3::DOUBLE + (doc_id % 7) / 10 AS relevance_score, 0.4::DOUBLE + (doc_id % 12) / 20 AS credibility_score FROM documents)"""


def claims(spark, d):
    """Every sentence of every conversation turn, with a phrase that carries a measure or a trend."""
    turns = spread(table(spark, d, "conversations"))
    rows = turns.select("conv_id", "turn", "role", F.posexplode(K.simple_sentences(F.col("text"))).alias("pos", "sentence"))
    n = F.col("conv_id") * 7 + F.col("turn") * 3 + F.col("pos")
    return rows.select(
        (F.col("conv_id") * 100000 + F.col("turn") * 1000 + F.col("pos")).alias("claim_id"), F.col("role").alias("research_id"),
        F.col("conv_id").alias("source_id"),
        F.concat(F.lit("https://"), pick(HOSTS, F.col("conv_id")), F.lit("/c/"), F.col("conv_id").cast("string")).alias("source_url"),
        F.concat(F.regexp_replace("sentence", r"[.!?]+$", ""), F.lit(" "), pick(PHRASES, n)).alias("claim"),
        (0.5 + F.pmod(n, F.lit(12)) / 25).alias("confidence"),
        F.when(F.pmod(n, F.lit(13)) == 0, "disputed").otherwise("verified").alias("status"))


_N = "(conv_id * 7 + turn * 3 + pos)"
CLAIMS = f"""(WITH l AS (SELECT conv_id, turn, role, list_filter(list_transform({SENT('text')}, lambda s: {STRIP('s')}), lambda s: s <> '') AS ss FROM conversations),
  x AS (SELECT conv_id, turn, role, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS pos FROM l)
  SELECT conv_id * 100000 + turn * 1000 + pos AS claim_id, role AS research_id, conv_id AS source_id,
   'https://' || {sql_pick(HOSTS, 'conv_id')} || '/c/' || conv_id AS source_url,
   regexp_replace(sentence, '[.!?]+$', '') || ' ' || {sql_pick(PHRASES, _N)} AS claim, 0.5::DOUBLE + {_N} % 12 / 25 AS confidence,
   CASE WHEN {_N} % 13 = 0 THEN 'disputed' ELSE 'verified' END AS status FROM x)"""


def sentences(spark, d):
    """Every sentence of every document."""
    return documents(spark, d).select("doc_id", "source", F.posexplode(K.simple_sentences(F.col("text"))).alias("pos", "sentence"))


SENTENCES = f"""(WITH l AS (SELECT doc_id, source, list_filter(list_transform({SENT('text')}, lambda s: {STRIP('s')}), lambda s: s <> '') AS ss FROM documents)
  SELECT doc_id, source, unnest(ss) AS sentence, CAST(generate_subscripts(ss, 1) - 1 AS INTEGER) AS pos FROM l)"""

# Heading lines set into the documents' own lines, so that sections exist.
HEADS = ("Abstract", "# Introduction", "2. Methods", "Results:", "Conclusion", "References")


def sectioned(spark, d):
    lines = F.split("text", "\n")
    body = F.transform(lines, lambda x, i: F.when(i % 5 == 0, F.concat(F.element_at(
        F.array(*[F.lit(h) for h in HEADS]), ((F.expr("doc_id") + i) % len(HEADS) + 1).cast("int")), F.lit("\n"), x)).otherwise(x))
    return documents(spark, d).select("doc_id", "source", F.array_join(body, "\n").alias("text"))


SECTIONED = f"""(SELECT doc_id, source, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i:
  CASE WHEN (i - 1) % 5 = 0 THEN ([{sql_list(HEADS)}])[(doc_id + i - 1) % {len(HEADS)} + 1] || chr(10) || x ELSE x END), chr(10)) AS text FROM documents)"""


def page_texts(spark, d):
    """Documents as pages of twelve lines; every third page opens with a heading and has a two-column table."""
    lines = F.split("text", "\n")
    pages = F.transform(F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: i % 12 == 0), lambda i: F.slice(lines, i + 1, F.lit(12)))
    rows = documents(spark, d).select("doc_id", F.posexplode(pages).alias("n", "ls"))
    head = F.when(F.pmod(F.col("doc_id") + F.col("n"), F.lit(3)) == 0, F.concat(pick(HEADS, F.col("doc_id") + F.col("n")), F.lit("\n"))).otherwise("")
    note = F.concat(F.lit("\ndoi: 10.1234/x"), F.col("doc_id").cast("string"), F.lit(" in "), (1995 + F.pmod("doc_id", F.lit(25))).cast("string"),
                    F.lit("\nname  value\nrows  "), F.col("n").cast("string"))
    return rows.select("doc_id", (F.col("n") + 1).alias("page"), F.concat(head, F.array_join("ls", "\n"), note).alias("text"))


PAGE_TEXTS = f"""(WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
  p AS (SELECT doc_id, ls, unnest(range(0, len(ls), 12)) // 12 AS n FROM l)
  SELECT doc_id, CAST(n + 1 AS INTEGER) AS page, CASE WHEN (doc_id + n) % 3 = 0 THEN {sql_pick(HEADS, 'doc_id + n')} || chr(10) ELSE '' END ||
    array_to_string(ls[n * 12 + 1 : n * 12 + 12], chr(10)) || chr(10) || 'doi: 10.1234/x' || doc_id || ' in ' || (1995 + doc_id % 25) ||
    chr(10) || 'name  value' || chr(10) || 'rows  ' || n AS text FROM p)"""


def sql_case_names(x: str, names) -> str:
    tests = " ".join("WHEN " + " OR ".join(f"contains({x}, {sql_str(w)})" for w in ws) + f" THEN {sql_str(n)}" for ws, n in names)
    return f"CASE {tests} ELSE {x} END"
