"""URL, hash and duplicate queries."""

from pyspark.sql import functions as F

from gleaner import lexicons as L
from gleaner.functions import urls as U
from gleaner.functions.text import page_title
from gleaner.operators import dedup as D
from gleaner.plans.registry import query
from gleaner.plans.sqlkit import COLLAPSE, REX, RR, STRIP, case, sql_list, sql_str
from gleaner.sources.tables import spread, table


def documents(spark, d):
    return spread(table(spark, d, "documents"))


# --- oracle fragments: all page URLs have a scheme --------------------------------------------------------------------
def HOST(u):
    return f"lower({REX(u, '^[a-z]+://(?:[^/?#@]*@)?([^/?#:]*)', 1)})"


def _query_sql(u):
    return (f"array_to_string(list_sort(list_filter(string_split({REX(u, '^[^?#]*[?]([^#]*)', 1)}, '&'), "
            f"lambda p: p <> '' AND NOT regexp_matches(p, {sql_str(L.TRACKING_PREFIX)}))), '&')")


def CANON(u):
    path = RR(REX(u, "^[a-z]+://[^/?#]*([^?#]*)", 1), "/+", "/")
    path = f"CASE WHEN {path} IN ('', '/') THEN '/' ELSE {RR(path, '/$')} END"
    q = _query_sql(u)
    return (f"({REX(u, '^([a-z]+)://', 1)} || '://' || {HOST(u)} || {path} || CASE WHEN {q} = '' THEN '' ELSE '?' || {q} END)")


def BROWSER(u):
    path = REX(u, "^[a-z]+://[^/?#]*([^?#]*)", 1)
    q = _query_sql(u)
    return RR(f"({REX(u, '^([a-z]+)://', 1)} || '://' || {HOST(u)} || CASE WHEN {path} = '' THEN '/' ELSE {path} END || "
              f"CASE WHEN {q} = '' THEN '' ELSE '?' || {q} END)", "/$")


def DOMAIN(u):
    return RR(HOST(u), r"^www\.")


@query("ded1_canonical_url", f"SELECT page_id, {CANON('url')} AS canonical FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", U.canonical_url(F.col("url")).alias("canonical"))


@query("ded2_browser_url", f"""SELECT page_id, CASE WHEN page_id % 9 = 0 THEN '' ELSE {BROWSER('url')} END AS canonical FROM pages""")
def _(spark, d):
    url = F.when(F.pmod("page_id", F.lit(9)) == 0, F.regexp_replace("url", "://", "://user:pw@")).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", U.browser_url(url).alias("canonical"))


@query("ded3_domain", f"SELECT {DOMAIN('url')} AS domain, count(*) AS pages FROM pages GROUP BY 1")
def _(spark, d):
    return table(spark, d, "pages").groupBy(U.domain_of(F.col("url")).alias("domain")).agg(F.count("*").alias("pages"))


@query("ded4_content_hash", f"""SELECT doc_id, sha256({STRIP('text')}) AS content_hash,
 sha256(lower({COLLAPSE('text')})) AS normalized_hash FROM documents""")
def _(spark, d):
    return documents(spark, d).select("doc_id", D.content_hash(F.col("text")).alias("content_hash"),
                                      D.normalized_hash(F.col("text")).alias("normalized_hash"))


@query("ded5_exact_keepers", f"""
SELECT doc_id, source, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY lower({COLLAPSE('text')}) ORDER BY doc_id) = 1""")
def _(spark, d):
    return D.keep_first(documents(spark, d), D.normalized_hash(F.col("text")), "doc_id").select("doc_id", "source", "n_chars")


@query("ded5_duplicate_groups", f"""
SELECT sha256(lower({COLLAPSE('text')})) AS key, min(doc_id) AS keeper, count(*) AS members FROM documents
GROUP BY 1 HAVING count(*) > 1""")
def _(spark, d):
    return D.duplicate_groups(documents(spark, d), D.normalized_hash(F.col("text")), "doc_id")


@query("ded5_keeper_of", f"""
SELECT doc_id, min(doc_id) OVER (PARTITION BY lower({COLLAPSE('text')})) AS keeper FROM documents""")
def _(spark, d):
    return D.keepers_of(documents(spark, d), D.normalized_hash(F.col("text")), "doc_id")


# Pair table by brute force, then the sequential rule by recursion over the kept list is not SQL; the oracle below checks
# the pairs (a close earlier text exists), the unit tests check the sequential rule.
NEAR_SQL = f"""
WITH RECURSIVE f AS (SELECT doc_id, string_split(lower({COLLAPSE('text')}), ' ') AS w FROM documents
                     WHERE length(lower({COLLAPSE('text')})) >= 40),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 2, 1) + 1),
        lambda i: array_to_string(w[i:i+2], ' '))) AS g FROM f),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE shared / (na.n + nb.n - shared) >= 0.9),
-- b is dropped if some kept a is close; walk the texts in order, carrying the kept ones that matter
o AS (SELECT b, list(a) AS rivals, row_number() OVER (ORDER BY b) AS k FROM e GROUP BY b),
r AS (SELECT 0 AS k, CAST([] AS BIGINT[]) AS gone
      UNION ALL SELECT o.k, CASE WHEN len(list_filter(o.rivals, lambda x: NOT list_contains(r.gone, x))) > 0
             THEN list_append(r.gone, o.b) ELSE r.gone END FROM r JOIN o ON o.k = r.k + 1)
SELECT unnest(gone) AS doc_id FROM r WHERE k = (SELECT max(k) FROM r)"""


@query("ded6_near_duplicates", NEAR_SQL)
def _(spark, d):
    return D.near_duplicate_keepers(documents(spark, d), "doc_id").select("doc_id")


@query("ded7_merge_urls", f"SELECT page_id, {CANON('url')} AS canonical FROM pages "
       f"QUALIFY row_number() OVER (PARTITION BY {CANON('url')} ORDER BY page_id) = 1")
def _(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    merged = D.merge_by_url(pages, U.canonical_url(F.col("url")), "page_id")
    return merged.select("page_id", U.canonical_url(F.col("url")).alias("canonical"))


@query("ded7_merge_urls_top24", f"SELECT page_id, {BROWSER('url')} AS canonical FROM pages "
       f"QUALIFY row_number() OVER (PARTITION BY {BROWSER('url')} ORDER BY page_id) = 1 ORDER BY page_id LIMIT 24")
def _(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    merged = D.merge_by_url(pages, U.browser_url(F.col("url")), "page_id", limit=24)
    return merged.select("page_id", U.browser_url(F.col("url")).alias("canonical"))


@query("ded8_merge_papers")
def _(spark, d):
    docs = documents(spark, d)
    papers = docs.select("doc_id", "source", F.col("text").alias("title"),
                         F.when(F.pmod("doc_id", F.lit(3)) > 0, F.concat(F.lit("10.1/"), (F.col("doc_id") / 7).cast("bigint"))).alias("doi"))
    return D.merge_academic(papers, "source", "doc_id").select("doc_id", "source")


@query("ded9_distinct_queries", f"""
SELECT role, {STRIP('text')} AS text, conv_id * 1000 + turn AS ord FROM conversations WHERE {STRIP('text')} <> ''
QUALIFY row_number() OVER (PARTITION BY role, lower({STRIP('text')}) ORDER BY conv_id * 1000 + turn) = 1""")
def _(spark, d):
    turns = table(spark, d, "conversations").select("role", "text", (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"))
    return D.distinct_queries(turns, ["role"], "text", "ord")


# URLs of every risk class, derived from the page id.
_RISK_SQL = """CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN 'http://' || (page_id * 37 % 256) || '.' || (page_id * 11 % 256) || '.1.9/x'
 WHEN 2 THEN 'https://user:pw@host.example.com/' || page_id WHEN 3 THEN 'http://host.example.com:' || (page_id * 13 % 9000) || '/a'
 WHEN 4 THEN 'ftp://host.example.com/' || page_id ELSE 'http://localhost/' || page_id END"""


def _risky(spark, d):
    i = F.col("page_id")
    k = F.pmod(i, F.lit(6))
    url = (F.when(k == 0, F.col("url"))
           .when(k == 1, F.concat(F.lit("http://"), (i * 37) % 256, F.lit("."), (i * 11) % 256, F.lit(".1.9/x")))
           .when(k == 2, F.concat(F.lit("https://user:pw@host.example.com/"), i))
           .when(k == 3, F.concat(F.lit("http://host.example.com:"), (i * 13) % 9000, F.lit("/a")))
           .when(k == 4, F.concat(F.lit("ftp://host.example.com/"), i)).otherwise(F.concat(F.lit("http://localhost/"), i)))
    return table(spark, d, "pages").select("page_id", url.alias("url"))


_num = " + ".join(f"CAST({REX('u', r'^[a-z]+://(\d+)\.(\d+)\.(\d+)\.(\d+)', i)} AS BIGINT) * {256 ** (4 - i)}" for i in (1, 2, 3, 4))
_rng = " OR ".join(f"num BETWEEN {lo} AND {hi}" for lo, hi in U.blocked_ranges())


@query("ded10_url_risk", f"""
WITH u AS (SELECT page_id, {_RISK_SQL} AS u FROM pages),
p AS (SELECT *, TRY_CAST(nullif({REX('u', r'^[a-z]+://[^/?#]*:(\d+)(?:/|$)', 1)}, '') AS INTEGER) AS port,
  CASE WHEN regexp_matches(u, '^[a-z]+://\\d+\\.\\d+\\.\\d+\\.\\d+') THEN {_num} END AS num FROM u)
SELECT page_id, u AS url, {case([("NOT regexp_matches(u, '^https?://')", "'scheme'"),
  ("regexp_matches(u, '^[a-z]+://[^/?#]*@')", "'credentials'"),
  (f"port IS NOT NULL AND port <> 0 AND port NOT IN {L.ALLOWED_PORTS}", "'port'"),
  (f"{HOST('u')} IN ({sql_list(L.BLOCKED_HOSTS)})", "'blocked_host'"), (f"({_rng})", "'private_address'")], "NULL")} AS risk FROM p""")
def _(spark, d):
    return _risky(spark, d).select("page_id", "url", U.url_risk(F.col("url")).alias("risk"))


# Sources whose pages sometimes carry a placeholder URL or text.
_VALID_SQL = f"""
WITH s AS (SELECT page_id, CASE page_id % 7 WHEN 1 THEN 'https://techcrunch.com/news/item-' || page_id
    WHEN 2 THEN 'gopher://old/' || page_id WHEN 3 THEN 'https://site.org/topics/page-' || page_id || '-of-the-corpus' ELSE url END AS url,
  CASE WHEN page_id % 7 = 4 THEN 'Industry Update: Breakthroughs in ' ELSE '' END || left(html, 200) AS snippet,
  'page ' || page_id || ' of the corpus' AS query, page_id % 7 = 5 AS metadata_only,
  CASE WHEN page_id % 7 = 6 THEN '' ELSE html END AS content FROM pages)
SELECT page_id, {case([("NOT regexp_matches(url, '^https?://')", "'bad_scheme'"),
  ("(" + " OR ".join(f"regexp_matches(url, {sql_str(p)})" for p in L.PLACEHOLDER_URLS) + ")", "'placeholder_url'"),
  ("(" + " OR ".join(f"regexp_matches({t}, {sql_str(p)})" for t in ('snippet', 'content') for p in L.PLACEHOLDER_TEXTS) + ")", "'placeholder_text'"),
  ("length(query) > 15 AND (contains(lower(url), '/news/' || left(lower(replace(query, ' ', '-')), 30)) OR contains(lower(url), '/topics/' || left(lower(replace(query, ' ', '-')), 30)))", "'query_slug_in_path'"),
  ("metadata_only", "'metadata_only'"), (f"{STRIP('snippet')} = '' AND {STRIP('content')} = ''", "'empty'")], "NULL")} AS reason FROM s"""


@query("ded11_source_validity", _VALID_SQL)
def _(spark, d):
    from gleaner.operators.sourcing import source_problem
    i, k = F.col("page_id"), F.pmod("page_id", F.lit(7))
    url = (F.when(k == 1, F.concat(F.lit("https://techcrunch.com/news/item-"), i)).when(k == 2, F.concat(F.lit("gopher://old/"), i))
           .when(k == 3, F.concat(F.lit("https://site.org/topics/page-"), i, F.lit("-of-the-corpus"))).otherwise(F.col("url")))
    rows = table(spark, d, "pages").select(
        "page_id", url.alias("url"), F.concat(F.when(k == 4, "Industry Update: Breakthroughs in ").otherwise(""), F.substring("html", 1, 200)).alias("snippet"),
        F.concat(F.lit("page "), i, F.lit(" of the corpus")).alias("query"), (k == 5).alias("metadata_only"),
        F.when(k == 6, "").otherwise(F.col("html")).alias("content"))
    return rows.select("page_id", source_problem(F.col("url"), F.lit(""), F.col("snippet"), F.col("content"), F.col("query"),
                                                 F.col("metadata_only")).alias("reason"))


@query("ded12_unvisited", f"""
SELECT page_id, url FROM pages WHERE lower({STRIP('url')}) NOT IN
 (SELECT lower({STRIP('url')}) FROM pages WHERE {DOMAIN('url')} LIKE 'blog.%')""")
def _(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    visited = pages.filter(U.domain_of(F.col("url")).startswith("blog."))
    return D.unvisited(pages, visited)


@query("grf7_components", """
WITH RECURSIVE e AS (SELECT doc_id AS a, doc_id - doc_id % 10 AS b FROM documents UNION ALL
   SELECT doc_id AS a, doc_id // 2 AS b FROM documents WHERE doc_id % 17 = 0),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS node, a AS reach FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.reach)
SELECT node, min(reach) AS component FROM r GROUP BY 1""")
def _(spark, d):
    i = table(spark, d, "documents").select("doc_id")
    edges = i.select(F.col("doc_id").alias("a"), (F.col("doc_id") - F.col("doc_id") % 10).alias("b")).unionByName(
        i.filter("doc_id % 17 = 0").select(F.col("doc_id").alias("a"), F.expr("doc_id div 2").alias("b")))
    return D.connected_components(edges)


@query("io16_decode_redirects", """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE CASE WHEN page_id % 3 = 1 THEN url ELSE '/about?uddg=x' END END AS url FROM pages""")
def _(spark, d):
    i = F.pmod("page_id", F.lit(3))
    wrapped = (F.when(i == 0, F.concat(F.lit("https://html.duckduckgo.com/l/?uddg="), F.url_encode("url"), F.lit("&rut=1")))
               .when(i == 1, F.col("url")).otherwise("/about?uddg=x"))
    return table(spark, d, "pages").select("page_id", U.decode_redirect(wrapped).alias("url"))
