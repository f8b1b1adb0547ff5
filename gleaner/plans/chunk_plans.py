"""Token, sentence, section, chunk and passage queries."""

from pyspark.sql import functions as F

from gleaner import lexicons as L
from gleaner.functions import tokens as K
from gleaner.operators import chunks as C
from gleaner.plans import inputs as I
from gleaner.plans.registry import query
from gleaner.plans.sqlkit import ASCII_WORDS, COUNT, REX, REXALL, RR, STRIP, sql_list, sql_str

NL = "chr(10)"


def STEM(t):
    return (f"CASE WHEN ends_with({t}, 'ies') AND length({t}) > 4 THEN left({t}, length({t}) - 3) || 'y' "
            f"WHEN ends_with({t}, 'es') AND length({t}) > 3 THEN left({t}, length({t}) - 2) "
            f"WHEN ends_with({t}, 's') AND NOT ends_with({t}, 'ss') AND length({t}) > 3 THEN left({t}, length({t}) - 1) "
            f"WHEN ends_with({t}, 'ing') AND length({t}) > 4 THEN left({t}, length({t}) - 3) ELSE {t} END")


def TOKENS(x, stop, n=2):
    return f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda t: length(t) >= {n} AND t NOT IN ({sql_list(stop)}))"


def RTOKENS(x):
    return f"list_transform({TOKENS(x, L.RERANK_STOP)}, lambda t: {STEM('t')})"


@query("chk1_rerank_tokens", f"SELECT doc_id, array_to_string({RTOKENS('text')}, ' ') AS tokens FROM documents")
def _(spark, d):
    return I.documents(spark, d).select("doc_id", F.array_join(K.rerank_tokens(F.col("text")), " ").alias("tokens"))


@query("chk2_plain_tokens", f"""SELECT doc_id, array_to_string({TOKENS('text', L.RANKER_STOP)}, ' ') AS ranker,
  array_to_string({TOKENS('text', L.EMBEDDING_STOP)}, ' ') AS embedding, array_to_string({TOKENS('text', L.CONTRADICTION_STOP)}, ' ') AS contradiction,
  array_to_string({TOKENS('text', L.CREDIBILITY_STOP, 4)}, ' ') AS credibility FROM documents""")
def _(spark, d):
    t = F.col("text")
    return I.documents(spark, d).select("doc_id", *[F.array_join(K.tokens(t, stop, n), " ").alias(name) for name, stop, n in (
        ("ranker", L.RANKER_STOP, 2), ("embedding", L.EMBEDDING_STOP, 2), ("contradiction", L.CONTRADICTION_STOP, 2),
        ("credibility", L.CREDIBILITY_STOP, 4))])


@query("chk3_long_tokens", """SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}'))), ' ') AS tokens
 FROM documents""")
def _(spark, d):
    return I.documents(spark, d).select("doc_id", F.array_join(F.array_sort(K.long_tokens(F.col("text"))), " ").alias("tokens"))


def CSENT(x):
    m = RR(STRIP(x), r"([.!?])\s+([A-Z\"'(])", "\\1\x01\\2")
    m = RR(m, r"\n\s*\n", "\n\x01")
    return f"list_filter(list_transform(string_split({m}, chr(1)), lambda s: {STRIP('s')}), lambda s: s <> '')"


@query("chk4_chunk_sentences", f"""WITH s AS (SELECT doc_id, {CSENT('text')} AS ss FROM documents)
SELECT doc_id, CAST(generate_subscripts(ss, 1) - 1 AS INTEGER) AS pos, unnest(ss) AS sentence FROM s""")
def _(spark, d):
    return I.documents(spark, d).select("doc_id", F.posexplode(K.chunk_sentences(F.col("text"))).alias("pos", "sentence"))


@query("chk5_simple_sentences", f"SELECT doc_id, pos, sentence FROM {I.SENTENCES}")
def _(spark, d):
    return I.sentences(spark, d).select("doc_id", "pos", "sentence")


SECTIONS_SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, {NL})) AS line, generate_subscripts(string_split(text, {NL}), 1) AS pos FROM {I.SECTIONED}),
h AS (SELECT *, CASE WHEN length({STRIP('line')}) < 80 THEN lower({REX(STRIP('line'), L.HEADING_PATTERN, 1)}) ELSE '' END AS head FROM l),
g AS (SELECT *, sum(CASE WHEN head <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM h),
s AS (SELECT doc_id, grp, max(CASE WHEN head <> '' THEN {I.sql_case_names('head', L.SECTION_NAMES)} END) AS section,
  {STRIP(f"string_agg(CASE WHEN head = '' THEN line END, {NL} ORDER BY pos)")} AS body FROM g GROUP BY 1, 2)
SELECT doc_id, coalesce(section, 'Body') AS section, body AS section_text,
  CAST(row_number() OVER (PARTITION BY doc_id ORDER BY grp) - 1 AS INTEGER) AS section_no FROM s WHERE body <> ''"""


@query("chk6_sections", SECTIONS_SQL)
def _(spark, d):
    return C.sections(I.sectioned(spark, d), "doc_id")


@query("chk7_chunks")
def _(spark, d):
    return C.chunk_documents(C.text_blocks(I.sectioned(spark, d), "doc_id"), "doc_id")


@query("chk8_page_chunks")
def _(spark, d):
    pages = C.carry_sections(I.page_texts(spark, d), "doc_id").withColumn("tables", F.array(F.lit("| a | b |")))
    return C.chunk_documents(C.page_blocks(pages, "doc_id"), "doc_id")


@query("chk9_best_text", f"""SELECT page_id, coalesce(nullif({STRIP("CASE WHEN page_id % 3 = 0 THEN html ELSE ' ' END")}, ''),
  nullif({STRIP("CASE WHEN page_id % 3 = 1 THEN html ELSE NULL END")}, ''), nullif({STRIP('url')}, '')) AS text FROM pages""")
def _(spark, d):
    k = F.pmod("page_id", F.lit(3))
    from gleaner.sources.tables import table
    return table(spark, d, "pages").select("page_id", C.best_text(
        F.when(k == 0, F.col("html")).otherwise(" "), F.when(k == 1, F.col("html")), F.col("url")).alias("text"))


@query("chk10_section_statistics", f"""WITH s AS ({SECTIONS_SQL})
SELECT section, count(*) AS chunks, count(DISTINCT doc_id) AS documents FROM s GROUP BY ROLLUP (section)""")
def _(spark, d):
    return C.chunk_statistics(C.sections(I.sectioned(spark, d), "doc_id"), "doc_id")


def SENTENCES_OF(x):
    return f"list_filter(list_transform(string_split({RR(x, r'([.!?])' + chr(92) + 's+', chr(92) + '1' + chr(1))}, chr(1)), lambda s: {STRIP('s')}), lambda s: s <> '')"


def _joined(items):
    return f"array_to_string({items}, ' ')"


# a fold over sentences: groups that are done, the open one, its size
_folded = f"""list_reduce(list_transform({SENTENCES_OF('b')}, lambda s: {{'done': []::VARCHAR[], 'open': [s], 'n': length(s) + 1}}), lambda g, x:
  CASE WHEN g.n + x.n >= 800 THEN {{'done': list_append(g.done, {_joined('list_append(g.open, x.open[1])')}), 'open': []::VARCHAR[], 'n': 0::BIGINT}}
   ELSE {{'done': g.done, 'open': list_append(g.open, x.open[1]), 'n': g.n + x.n}} END, {{'done': []::VARCHAR[], 'open': []::VARCHAR[], 'n': 0::BIGINT}})"""
PASSAGE_LISTS = f"""(WITH c AS (SELECT doc_id, text, {STRIP(RR(RR('text', '[ ' + chr(92) + 't]+', ' '), chr(92) + 'n' + chr(92) + 's*' + chr(92) + 'n+', chr(10) + chr(10)))} AS clean FROM documents),
k AS (SELECT doc_id, text, clean, list_filter(list_transform(string_split({RR(RR('clean', chr(10) + chr(10), chr(1)), chr(92) + 'n([-*#0-9]+' + chr(92) + '.?' + chr(92) + 's)', chr(1) + chr(92) + '1')}, chr(1)), lambda x: {STRIP('x')}),
  lambda x: length(x) >= 40 AND NOT (regexp_matches(x, {sql_str(L.NOISE_LINE)}) AND length(x) < 150)) AS blocks FROM c),
u AS (SELECT doc_id, unnest(blocks) AS b, generate_subscripts(blocks, 1) AS i FROM k),
f AS (SELECT doc_id, i, b, CASE WHEN length(b) > 1500 THEN {_folded} END AS g FROM u),
m AS (SELECT doc_id, flatten(list(CASE WHEN g IS NULL THEN [b] WHEN len(g.open) > 0 THEN list_append(g.done, {_joined('g.open')}) ELSE g.done END ORDER BY i)) AS ps FROM f GROUP BY 1),
r AS (SELECT doc_id, list_filter({SENTENCES_OF('clean')}, lambda s: length(s) > 30) AS xs FROM k WHERE len(blocks) = 0 AND length(clean) >= 40)
SELECT doc_id, ps FROM m UNION ALL SELECT doc_id, list_transform(list_filter(range(len(xs)), lambda i: i % 3 = 0), lambda i: {_joined('xs[i + 1 : i + 3]')}) FROM r)"""


@query("chk11_passages", f"SELECT doc_id, CAST(generate_subscripts(ps, 1) - 1 AS INTEGER) AS passage_no, unnest(ps) AS passage FROM {PASSAGE_LISTS}")
def _(spark, d):
    return C.passages(I.documents(spark, d), "doc_id")


_w = ASCII_WORDS("sentence")


def PASSAGE_SCORE(x, topic):
    w = r"[\p{L}\p{N}_]+"
    return (f"least(1.0, 0.5 + least(0.3, {COUNT(ASCII_WORDS(x), L.EVIDENCE_METRIC)} * 0.1) + least(0.2, {COUNT(ASCII_WORDS(x), L.EMPIRICAL_ACTION)} * 0.05)"
            f" + least(0.2, len(list_intersect(list_distinct({REXALL(f'lower({topic})', w)}), {REXALL(f'lower({x})', w)})) / "
            f"greatest(len(list_distinct({REXALL(f'lower({topic})', w)})), 1) * 0.2))")


@query("chk12_passage_scores", f"SELECT claim_id, CAST(round({PASSAGE_SCORE('claim', I.sql_pick(I.PHRASES, 'claim_id'))}, 6) AS DOUBLE) AS score FROM {I.CLAIMS}")
def _(spark, d):
    return I.claims(spark, d).select("claim_id", F.round(C.passage_score(F.col("claim"), I.pick(I.PHRASES, F.col("claim_id"))), 6).alias("score"))


# --- page rules ---------------------------------------------------------------------------------------------------------
_lines = f"list_transform(string_split({STRIP('text')}, {NL})[1:5], lambda x: {STRIP('x')})"
_head = f"lower({REX(f'list_filter({_lines}, lambda x: regexp_matches(x, {sql_str(L.PAGE_HEADING_PATTERN)}))[1]', L.PAGE_HEADING_PATTERN, 1)})"
CARRY_SQL = f"""(WITH h AS (SELECT doc_id, page, text, {_head} AS head FROM {I.PAGE_TEXTS})
SELECT doc_id, page, text, coalesce(last_value(CASE WHEN head IS NOT NULL AND head <> '' THEN {I.sql_case_names('head', L.PAGE_SECTION_NAMES)} END IGNORE NULLS)
  OVER (PARTITION BY doc_id ORDER BY page), 'Body') AS section FROM h)"""


def carried(spark, d):
    return C.carry_sections(I.page_texts(spark, d), "doc_id")


@query("txt19_page_sections", f"SELECT doc_id, page, section FROM {CARRY_SQL}")
def _(spark, d):
    return carried(spark, d).select("doc_id", "page", "section")


@query("txt20_high_value_blocks", f"""SELECT doc_id, page, section, text, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY
  CASE WHEN section IN ('Abstract', 'Results', 'Discussion', 'Conclusion', 'Findings') THEN 0 ELSE 1 END, page) AS INTEGER) AS rank FROM {CARRY_SQL}
  WHERE section NOT IN ('References', 'Bibliography', 'Acknowledgments', 'Appendix') AND {COUNT('text', chr(92) + 'S+')} >= 40""")
def _(spark, d):
    return C.high_value_blocks(carried(spark, d), "doc_id")


@query("txt21_page_identifiers", f"""
WITH p AS (SELECT doc_id, page, rtrim(nullif({REX('text', r'(?:doi|DOI)[:\s]*?(10\.\d{4,}/\S+)', 1)}, ''), '.') AS doi,
  nullif({REX(ASCII_WORDS('text'), r'\b(20[0-2]\d|19[89]\d)\b', 1)}, '') AS year FROM {I.PAGE_TEXTS} WHERE page <= 2)
SELECT doc_id, arg_min(doi, page) FILTER (doi IS NOT NULL) AS doi, arg_min(year, page) FILTER (year IS NOT NULL) AS year FROM p GROUP BY 1""")
def _(spark, d):
    return C.page_identifiers(I.page_texts(spark, d), "doc_id")


@query("txt22_section_texts", f"""SELECT doc_id, section, string_agg({STRIP('text')}, {NL} || {NL} ORDER BY page) AS text FROM {CARRY_SQL} GROUP BY 1, 2""")
def _(spark, d):
    return C.section_texts(carried(spark, d), "doc_id")


@query("txt18_aligned_tables", f"""
WITH l AS (SELECT doc_id, page, unnest(string_split(text, {NL})) AS line, generate_subscripts(string_split(text, {NL}), 1) AS pos FROM {I.PAGE_TEXTS}),
c AS (SELECT *, string_split({RR(STRIP('line'), r'\s{2,}|' + chr(9), chr(1))}, chr(1)) AS cells FROM l),
f AS (SELECT *, len(cells) >= 2 AND NOT list_contains(cells, '') AS good FROM c),
g AS (SELECT *, sum(CASE WHEN good THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY pos) AS grp FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, grp ORDER BY pos) AS k, count(*) OVER (PARTITION BY doc_id, page, grp) AS n,
      max(len(cells)) OVER (PARTITION BY doc_id, page, grp) AS width FROM g WHERE good),
t AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, page ORDER BY grp) - 1 AS table_no FROM r WHERE n >= 2),
o AS (SELECT doc_id, page, table_no, CASE WHEN k = 1 THEN 0 ELSE k END AS row_no, '| ' || array_to_string(list_resize(cells, width, ''), ' | ') || ' |' AS markdown FROM t
  UNION ALL SELECT DISTINCT doc_id, page, table_no, 1, '| ' || array_to_string(list_transform(range(width), lambda x: '---'), ' | ') || ' |' FROM t)
SELECT doc_id * 1000 + page AS page_key, CAST(table_no AS INTEGER) AS table_no, CAST(row_no AS INTEGER) AS row_no, markdown FROM o""")
def _(spark, d):
    pages = I.page_texts(spark, d).select((F.col("doc_id") * 1000 + F.col("page")).alias("page_key"), "text")
    return C.aligned_tables(pages, "page_key")
