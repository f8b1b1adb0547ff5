"""Vector search and ranking queries, and the flagship."""

from pyspark.sql import functions as F

from gleaner import lexicons as L
from gleaner.functions import text as T
from gleaner.operators import dedup as D
from gleaner.operators import postings as P
from gleaner.operators import ranking as R
from gleaner.operators import vectorindex as VI
from gleaner.operators import vectors as V
from gleaner.plans import inputs as I
from gleaner.plans.chunk_plans import RTOKENS, TOKENS
from gleaner.plans.registry import query
from gleaner.plans.sqlkit import COLLAPSE, WS, any_contains, case, sql_str
from gleaner.sources.tables import spread, table


def embeddings(spark, d):
    return spread(table(spark, d, "embeddings"))


def items(spark, d):
    return table(spark, d, "benchmark").withColumnRenamed("item_id", "query_id")


# --- lexical ranks ------------------------------------------------------------------------------------------------------
def LEXICAL(docs, where=""):
    """query_id, doc_id, lexical over a (doc_id, text) sub-query."""
    return f"""(WITH q0 AS (SELECT item_id AS query_id, {RTOKENS('text')} AS ts FROM benchmark),
 q AS (SELECT query_id, nq, token, count(*) AS w FROM (SELECT query_id, len(ts) AS nq, unnest(ts) AS token FROM q0) GROUP BY ALL),
 d0 AS (SELECT doc_id, {RTOKENS('text')} AS ts FROM {docs}),
 c AS (SELECT doc_id, dl, token, count(*) AS tf FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS token FROM d0) GROUP BY ALL)
 SELECT query_id, doc_id, least(greatest(sum(w * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (dl / 150.0::DOUBLE)))) / (nq * 2.5::DOUBLE + 1e-9::DOUBLE), 0), 1) AS lexical
 FROM c JOIN q USING (token) {where} GROUP BY query_id, nq, doc_id)"""


@query("rnk1_lexical_top10", f"""SELECT query_id, doc_id, round(lexical, 6) AS lexical, CAST(rank AS INTEGER) AS rank FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(lexical, 9) DESC, doc_id) AS rank FROM {LEXICAL('documents')}) WHERE rank <= 10""")
def _(spark, d):
    best = P.top_documents(I.documents(spark, d), items(spark, d), "doc_id", "query_id", 10)
    return best.select("query_id", "doc_id", F.round("score", 6).alias("lexical"), "rank")


_DEDUPED = f"""(SELECT doc_id, {WS('text')} AS text FROM documents QUALIFY row_number() OVER (PARTITION BY lower({COLLAPSE('text')}) ORDER BY doc_id) = 1)"""


@query("flagship_top_documents", f"""SELECT query_id, doc_id, round(lexical, 6) AS lexical, CAST(rank AS INTEGER) AS rank FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(lexical, 9) DESC, doc_id) AS rank FROM {LEXICAL(_DEDUPED)}) WHERE rank <= 5""")
def _(spark, d):
    """Clean, drop copies, then rank: the five best documents for every benchmark passage."""
    docs = I.documents(spark, d).select("doc_id", T.normalize_whitespace(F.col("text")).alias("text"))
    unique = D.keep_first(docs, D.normalized_hash(F.col("text")), "doc_id")
    best = P.top_documents(unique, items(spark, d), "doc_id", "query_id", 5)
    return best.select("query_id", "doc_id", F.round("score", 6).alias("lexical"), "rank")


_QUALITY = case([("source_type IN ('academic', 'paper', 'journal')", "1.0"),
                 (f"{any_contains('lower(url)', L.RERANK_LOW_QUALITY)} OR {any_contains('domain', L.RERANK_LOW_QUALITY)}", "0.1"),
                 (f"{any_contains('lower(url)', L.RERANK_HIGH_AUTHORITY)} OR {any_contains('domain', L.RERANK_HIGH_AUTHORITY)}", "0.95"),
                 ("source_type = 'news'", "0.75"), ("source_type = 'company'", "0.70"), ("starts_with(lower(url), 'https://')", "0.60")], "0.50")


@query("rnk2_source_quality", f"SELECT source_id, CAST({_QUALITY} AS DOUBLE) AS quality FROM {I.SOURCES}")
def _(spark, d):
    return I.sources(spark, d).select("source_id", R.source_quality(F.col("url"), F.col("domain"), F.col("source_type")).alias("quality"))


@query("rnk3_recency", """SELECT o_orderkey, round(least(greatest(exp(-ln(2) / 730 * greatest(date_diff('microsecond', o_orderdate, TIMESTAMP '2001-08-02 12:00:00') / 86400e6, 0)), 0.05), 1), 6) AS recency FROM orders""")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(R.recency(F.col("o_orderdate"), F.lit("2001-08-02 12:00:00").cast("timestamp")), 6).alias("recency"))


@query("rnk4_context_alignment", f"""
WITH q0 AS (SELECT item_id AS query_id, {RTOKENS('text')} AS ts FROM benchmark),
s AS (SELECT claim_id, {RTOKENS('claim')} AS d, {RTOKENS('ctx')} AS q, ctx FROM (SELECT claim_id, claim, CASE WHEN claim_id % 7 = 0 THEN ' ' ELSE {I.sql_pick(I.PHRASES, 'claim_id')} END AS ctx FROM {I.CLAIMS}))
SELECT claim_id, round(CASE WHEN trim(ctx) = '' THEN 0.5 WHEN len(q) = 0 OR len(d) = 0 THEN 0 ELSE least(coalesce(list_sum(list_transform(q, lambda t:
  CASE WHEN len(list_filter(d, lambda x: x = t)) = 0 THEN 0::DOUBLE ELSE len(list_filter(d, lambda x: x = t)) * 2.5::DOUBLE / (len(list_filter(d, lambda x: x = t)) + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (len(d) / 150.0::DOUBLE))) END)), 0) / (len(q) * 2.5::DOUBLE + 1e-9::DOUBLE), 1) END, 6) AS context FROM s""")
def _(spark, d):
    ctx = F.when(F.pmod("claim_id", F.lit(7)) == 0, " ").otherwise(I.pick(I.PHRASES, F.col("claim_id")))
    from gleaner.functions import tokens as K
    score = F.when(T.strip(ctx) == "", 0.5).otherwise(R.lexical_column(K.rerank_tokens(ctx), K.rerank_tokens(F.col("claim"))))
    return I.claims(spark, d).select("claim_id", F.round(score, 6).alias("context"))


_EMB = "SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings"


@query("rnk6_hybrid", f"""
WITH l AS (SELECT query_id, doc_id, lexical FROM {LEXICAL('documents')}), e AS MATERIALIZED ({_EMB}),
s AS (SELECT b.item_id AS query_id, source_id AS doc_id, coalesce(lexical, 0) AS lexical, CAST({_QUALITY} AS DOUBLE) AS quality, CASE WHEN published_at IS NULL THEN 0.5::DOUBLE ELSE
   least(greatest(exp(-ln(2) / 730 * greatest(date_diff('second', CAST(published_at || '-01-01' AS TIMESTAMP), TIMESTAMP '2026-01-01') / 86400.0, 0)), 0.05), 1) END AS recency,
   CASE WHEN v.e IS NULL OR w.e IS NULL THEN 0 ELSE greatest(0, least(1, list_dot_product(v.e, w.e) / sqrt(list_dot_product(v.e, v.e) * list_dot_product(w.e, w.e)))) END AS semantic
   FROM benchmark b CROSS JOIN {I.SOURCES} x LEFT JOIN l ON l.query_id = b.item_id AND l.doc_id = x.source_id LEFT JOIN e v ON v.vec_id = x.source_id LEFT JOIN e w ON w.vec_id = b.item_id),
h AS (SELECT query_id, doc_id, round(semantic * 0.40::DOUBLE + lexical * 0.25::DOUBLE + quality * 0.15::DOUBLE + recency * 0.10::DOUBLE + 0.05::DOUBLE, 4) AS hybrid FROM s)
SELECT query_id, doc_id, round(hybrid, 3) AS hybrid FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hybrid DESC, doc_id) <= 5""")
def _(spark, d):
    """All documents for every benchmark passage; the vector of a text is the embedding with its id, where there is one."""
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    recent = R.recency(T.parse_date(F.col("published_at")), F.lit("2026-01-01").cast("timestamp"))
    rest = 0.15 * R.source_quality(F.col("url"), F.col("domain"), F.col("source_type")) + 0.10 * recent + 0.05
    docs = I.sources(spark, d).select(F.col("source_id").alias("doc_id"), F.col("content").alias("text"), rest.alias("rest"))
    docs = docs.join(vectors.withColumnRenamed("vec_id", "doc_id"), "doc_id", "left")
    queries = items(spark, d).join(vectors.withColumnRenamed("vec_id", "query_id"), "query_id", "left")
    best = P.top_documents(docs, queries, "doc_id", "query_id", 5, 4, "hybrid", vector="embedding", static="rest")
    return best.select("query_id", "doc_id", F.round(F.round("score", 4), 3).alias("hybrid"))


def embedded_documents(spark, d):
    return I.sources(spark, d).select(F.col("source_id").alias("doc_id"), "url", "domain", "source_type", "published_at", "title", "content",
                                      V.hashed_embedding(F.col("content")).alias("embedding"))


def embedded_items(spark, d):
    return items(spark, d).withColumn("embedding", V.hashed_embedding(F.col("text")))


@query("rnk7_retrieve")
def _(spark, d):
    return R.retrieve(embedded_documents(spark, d), embedded_items(spark, d), "doc_id", "query_id", F.lit("2026-01-01").cast("timestamp"))


@query("rnk8_context_blocks", f"""
WITH r AS (SELECT role AS query_id, conv_id, turn, text, row_number() OVER (PARTITION BY role, conv_id ORDER BY turn) AS rank FROM conversations)
SELECT query_id || '-' || conv_id AS query_id, count(*) AS citations, string_agg('[' || rank || '] Title: turn ' || turn || ' (Section: ' || query_id || CASE WHEN turn % 2 = 0 THEN ', Page: ' || turn ELSE '' END || ')' || chr(10) || 'Text: ' ||
  regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10) || chr(10) ORDER BY rank) AS context FROM r GROUP BY query_id, conv_id""")
def _(spark, d):
    from pyspark.sql import Window
    turns = table(spark, d, "conversations")
    ranked = turns.select(
        F.concat_ws("-", "role", "conv_id").alias("query_id"), F.row_number().over(Window.partitionBy("role", "conv_id").orderBy("turn")).alias("rank"),
        F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("title"), F.col("role").alias("section"),
        F.when(F.col("turn") % 2 == 0, F.col("turn")).alias("page"), F.col("text").alias("content"))
    return R.context_blocks(ranked, "query_id")


def _recall(x):
    h = f"list_distinct({TOKENS(x, L.RANKER_STOP)})"
    return f"CASE WHEN len(q) = 0 THEN 0::DOUBLE ELSE len(list_filter(q, lambda t: list_contains({h}, t))) / len(q) END"


_DOMAIN_SCORE = case([(any_contains("lower(url)", L.SEARCH_LOW_QUALITY), "0.0"), (any_contains("lower(url)", L.SEARCH_HIGH_AUTHORITY), "1.0"),
                      ("contains(lower(url), 'wikipedia.org')", "0.75"), ("starts_with(lower(url), 'https://')", "0.5")], "0.3")
RELEVANCE_SQL = f"""(WITH s AS (SELECT source_id, research_id, url, title, snippet, {TOKENS('content', L.RANKER_STOP)}[1:6] AS q FROM {I.SOURCES})
 SELECT source_id, research_id, CAST(CASE WHEN regexp_matches(title || ' ' || snippet, {sql_str(L.SPAM_PATTERN)}) THEN 0 ELSE round(least(0.40::DOUBLE * {_recall('title')} + 0.35::DOUBLE * {_recall('snippet')} +
  0.10::DOUBLE * least(length(snippet) / 300.0::DOUBLE, 1) + 0.15::DOUBLE * {_DOMAIN_SCORE}, 1), 4) END AS DOUBLE) AS relevance FROM s)"""


def relevances(spark, d):
    from gleaner.functions import tokens as K
    question = F.array_join(F.slice(K.tokens(F.col("content"), L.RANKER_STOP), 1, 6), " ")
    return I.sources(spark, d).select("source_id", "research_id", R.result_relevance(question, F.col("title"), F.col("snippet"), F.col("url")).alias("relevance"))


@query("rnk9_result_relevance", f"SELECT source_id, round(relevance, 3) AS relevance FROM {RELEVANCE_SQL}")
def _(spark, d):
    return relevances(spark, d).select("source_id", F.round("relevance", 3).alias("relevance"))


@query("rnk10_top_results", f"""SELECT research_id, source_id, round(relevance, 3) AS relevance FROM {RELEVANCE_SQL} WHERE relevance > 0
 QUALIFY row_number() OVER (PARTITION BY research_id ORDER BY round(relevance, 3) DESC, source_id) <= 5""")
def _(spark, d):
    kept = relevances(spark, d).filter("relevance > 0").withColumn("relevance", F.round("relevance", 3))
    return V.top_k(kept, "research_id", [F.desc("relevance"), F.asc("source_id")], 5).select("research_id", "source_id", "relevance")


# Papers: one per document.
_PAPER = """(SELECT doc_id, source, text AS abstract, CASE WHEN doc_id % 3 = 0 THEN 'https://x/' || doc_id || '.pdf' END AS pdf_url, CAST(1990 + doc_id % 36 AS VARCHAR) AS year,
  doc_id * 7 % 1500 AS citations, CASE WHEN doc_id % 4 > 0 THEN '10.1/' || doc_id ELSE '' END AS doi, ['arxiv', 'pubmed', 'crossref'][doc_id % 3 + 1] AS database FROM documents)"""


def papers(spark, d):
    i = F.col("doc_id")
    return I.documents(spark, d).select(
        i, "source", F.col("text").alias("abstract"), F.when(i % 3 == 0, F.concat(F.lit("https://x/"), i.cast("string"), F.lit(".pdf"))).alias("pdf_url"),
        (1990 + i % 36).cast("string").alias("year"), (i * 7 % 1500).alias("citations"),
        F.when(i % 4 > 0, F.concat(F.lit("10.1/"), i.cast("string"))).otherwise("").alias("doi"), I.pick(("arxiv", "pubmed", "crossref"), i).alias("database"))


_RANKSQL = "(CASE WHEN length(abstract) > 100 THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN pdf_url IS NOT NULL THEN 0.3::DOUBLE ELSE 0 END + least(0.2::DOUBLE, CAST(year AS INTEGER) / 20000.0::DOUBLE) + least(0.1::DOUBLE, citations / 10000.0::DOUBLE))"


@query("rnk11_academic_rank", f"""SELECT source, doc_id, round({_RANKSQL}, 6) AS score FROM {_PAPER}
 QUALIFY row_number() OVER (PARTITION BY source ORDER BY round({_RANKSQL}, 6) DESC, doc_id) <= 10""")
def _(spark, d):
    scored = papers(spark, d).withColumn("score", F.round(R.academic_rank(F.col("abstract"), F.col("pdf_url"), F.col("year"), F.col("citations")), 6))
    return V.top_k(scored, "source", [F.desc("score"), F.asc("doc_id")], 10).select("source", "doc_id", "score")


@query("rnk12_open_access", f"""SELECT source, doc_id, pdf_url FROM {_PAPER} WHERE pdf_url IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY source ORDER BY round({_RANKSQL}, 6) DESC, doc_id) <= 5""")
def _(spark, d):
    scored = papers(spark, d).filter("pdf_url is not null").withColumn("score", F.round(R.academic_rank(F.col("abstract"), F.col("pdf_url"), F.col("year"), F.col("citations")), 6))
    return V.top_k(scored, "source", [F.desc("score"), F.asc("doc_id")], 5).select("source", "doc_id", "pdf_url")


@query("rnk13_academic_credibility", f"""SELECT doc_id, round(least(1, least(1, least(1, 0.90::DOUBLE + CASE WHEN doi <> '' THEN 0.03 ELSE 0 END) + CASE WHEN citations > 0 THEN least(0.05::DOUBLE, citations / 2000.0::DOUBLE) ELSE 0 END)
  + CASE WHEN length(abstract) > 100 THEN 0.01 ELSE 0 END + CASE WHEN database IN ('pubmed', 'crossref') THEN 0.01 ELSE 0 END), 3) AS credibility FROM {_PAPER}""")
def _(spark, d):
    return papers(spark, d).select("doc_id", F.round(R.academic_credibility(F.col("doi"), F.col("citations"), F.col("abstract"), F.col("database")), 3).alias("credibility"))


@query("rnk14_recall_prior")
def _(spark, d):
    docs = I.documents(spark, d).select("doc_id", "text", V.hashed_embedding(F.col("text")).alias("embedding"))
    return R.recall_prior(docs, embedded_items(spark, d), "doc_id", "query_id").select("query_id", "doc_id", F.round("relevance", 4).alias("relevance"), "rank")


@query("rnk15_frequent_sources", """
SELECT regexp_replace(lower(trim(url)), '[?#].*$', '') AS url, count(*) - 1 AS reused, sum(page_id % 3)::BIGINT AS cited FROM pages GROUP BY 1""")
def _(spark, d):
    from gleaner.operators.memory import frequent_sources
    visits = table(spark, d, "pages").select(F.regexp_replace(F.lower(F.trim("url")), "[?#].*$", "").alias("url"), (F.col("page_id") % 3).alias("cited"))
    return frequent_sources(visits)


@query("rnk16_bm25_idf", f"""
WITH q0 AS (SELECT item_id AS query_id, {RTOKENS('text')} AS ts FROM benchmark),
q AS (SELECT query_id, token, count(*) AS w FROM (SELECT query_id, unnest(ts) AS token FROM q0) GROUP BY ALL),
d0 AS (SELECT doc_id, {RTOKENS('text')} AS ts FROM documents), st AS (SELECT count(*) AS n, avg(len(ts)) AS al FROM d0),
c AS (SELECT doc_id, dl, token, count(*) AS tf FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS token FROM d0) GROUP BY ALL),
f AS (SELECT token, count(*) AS df FROM c GROUP BY 1),
s AS (SELECT query_id, doc_id, round(sum(w * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (dl / al)))), 6) AS bm25
      FROM c JOIN q USING (token) JOIN f USING (token), st GROUP BY 1, 2)
SELECT query_id, doc_id, bm25 FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, doc_id) <= 10""")
def _(spark, d):
    best = P.top_documents(I.documents(spark, d), items(spark, d), "doc_id", "query_id", 10, 6, "bm25")
    return best.select("query_id", "doc_id", F.round("score", 6).alias("bm25"))


# --- vectors ------------------------------------------------------------------------------------------------------------
# a token's hash modulo 3 * 2**24, from its last 24 bits and the sum of its hexadecimal digits, gives all three places
EMBED_SQL = f"""WITH t AS (SELECT doc_id, unnest({TOKENS('text', L.EMBEDDING_STOP)}) AS token FROM documents), w AS (SELECT DISTINCT token, sha256(token) AS h FROM t),
r AS (SELECT token, ('0x' || right(h, 6))::BIGINT AS low, list_sum(list_transform(regexp_extract_all(h, '.'), lambda c: ('0x' || c)::BIGINT))::BIGINT AS digits FROM w),
n AS (SELECT token, low + 16777216 * (((digits - low) % 3 + 3) % 3) AS x FROM r),
p AS (SELECT token, unnest([x % {L.EMBEDDING_DIM}, (x // 128) % {L.EMBEDDING_DIM}, (x // 8192) % {L.EMBEDDING_DIM}]) AS place, unnest([4, 2, 1]) AS quarter FROM n),
v AS (SELECT doc_id, place, sum(quarter) AS q FROM t JOIN p USING (token) GROUP BY 1, 2),
s AS (SELECT doc_id, count(*) AS places, min(place) FILTER (q = most) AS heaviest FROM (SELECT *, max(q) OVER (PARTITION BY doc_id) AS most FROM v) GROUP BY 1)
SELECT doc_id, {L.EMBEDDING_DIM}::INTEGER AS dim, coalesce(places, 0)::INTEGER AS places, coalesce(heaviest, 0)::INTEGER AS heaviest, CASE WHEN places IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS length
FROM documents LEFT JOIN s USING (doc_id)"""


@query("vec1_hashed_embedding", EMBED_SQL)
def _(spark, d):
    v = F.col("v")
    rows = I.documents(spark, d).select("doc_id", V.hashed_embedding(F.col("text")).alias("v"))
    return rows.select("doc_id", F.size(v).alias("dim"), F.size(F.filter(v, lambda x: x != 0)).alias("places"), (F.array_position(v, F.array_max(v)) - 1).cast("int").alias("heaviest"),
                       F.round(V.norm(v), 4).alias("length"))


def _listsql(x):
    return f"array_to_string(list_transform({x}, lambda x: CAST(round(x, 4) + 0.0 AS DECIMAL(8, 4))), ' ')"


def _listcol(c):
    return F.array_join(F.transform(c, lambda x: F.format_string("%s", (F.round(x, 4) + 0.0).cast("decimal(8,4)"))), " ")


@query("vec2_project", f"""WITH p AS (SELECT vec_id, list_transform(list_concat(embedding, list_resize(CAST([] AS FLOAT[]), 32, 0.0::FLOAT))[1:48 + 48 * (vec_id % 2)], lambda x: x::DOUBLE) AS v FROM embeddings)
SELECT vec_id, {_listsql('list_transform(v, lambda y: y / sqrt(list_dot_product(v, v)))')} AS v FROM p""")
def _(spark, d):
    v = F.when(F.col("vec_id") % 2 == 0, V.project(F.col("embedding"), 48)).otherwise(V.project(F.col("embedding"), 96))
    return embeddings(spark, d).select("vec_id", _listcol(v).alias("v"))


@query("vec3_normalize", f"""WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (1 + vec_id % 5)) AS v FROM embeddings)
SELECT vec_id, {_listsql('list_transform(v, lambda y: y / sqrt(list_dot_product(v, v)))')} AS v FROM p""")
def _(spark, d):
    scaled = F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 5))
    return embeddings(spark, d).select("vec_id", _listcol(V.normalize(scaled)).alias("v"))


CENTROIDS = """(SELECT label AS query_id, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x::DOUBLE) AS m FROM
 (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1)"""


def centroids(spark, d):
    parts = embeddings(spark, d).select(F.col("label").alias("query_id"), F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("query_id", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("embedding"))


def _search_sql(where="TRUE", floor=0.0, k=5, extra=""):
    return f"""WITH v AS (SELECT *, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
 s AS (SELECT query_id, vec_id, label, round(list_dot_product(e, c) / sqrt(list_dot_product(e, e) * list_dot_product(c, c)), 6) AS score FROM v, {CENTROIDS} q WHERE {where})
SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s WHERE score >= {floor}
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {k}"""


@query("vec4_search", _search_sql(floor=0.1, k=10))
def _(spark, d):
    return V.search(embeddings(spark, d), centroids(spark, d), 10, 0.1).withColumn("score", F.round("score", 6))


@query("vec5_section_search", _search_sql(where="label IN (1, 3, 5)", floor=-1))
def _(spark, d):
    return V.search(embeddings(spark, d), centroids(spark, d), 5, -1.0, where=F.col("label").isin(1, 3, 5)).withColumn("score", F.round("score", 6))


@query("vec6_metadata_filter", f"""SELECT source_id FROM {I.SOURCES} WHERE source_type = 'news' AND language = 'en'""")
def _(spark, d):
    rows = I.sources(spark, d).select("source_id", F.upper("source_type").alias("sourcetype"), F.create_map(F.lit("language"), "language").alias("metadata"))
    return rows.filter(V.matches({"source_type": "News", "language": "EN"}, rows.columns)).select("source_id")


@query("vec7_clear_documents", "SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(spark, d):
    from gleaner.operators.memory import delete_by_key
    gone = table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("vec_id"))
    return delete_by_key(table(spark, d, "embeddings").select("vec_id", "label"), gone, "vec_id")


@query("vec8_embed_missing", f"SELECT doc_id, md5(text) AS md5, {L.EMBEDDING_DIM}::INTEGER AS dim FROM documents")
def _(spark, d):
    docs = I.documents(spark, d).select("doc_id", "text")
    known = docs.filter(F.length("text") < 500).dropDuplicates(["text"]).select(F.md5("text").alias("md5"), V.hashed_embedding(F.col("text")).alias("embedding"))
    rows, _ = V.embed_missing(docs, known)
    return rows.select("doc_id", "md5", F.size("embedding").alias("dim"))


@query("vec9_approximate_search", _search_sql(floor=-1, k=10))
def _(spark, d):
    """Through the index, with the bounds that make it exact; ``tests/test_rules.py`` measures the recall without them."""
    return VI.search(VI.build(embeddings(spark, d)), centroids(spark, d), 10, exact=True).withColumn("score", F.round("score", 6))
