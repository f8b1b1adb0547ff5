"""Evidence, claim and contradiction queries."""

from pyspark.sql import functions as F

from gleaner import lexicons as L
from gleaner.functions import text as T
from gleaner.operators import chunks as C
from gleaner.operators import claims as CL
from gleaner.operators import conflicts as CF
from gleaner.operators import evidence as E
from gleaner.plans import inputs as I
from gleaner.plans.chunk_plans import TOKENS, PASSAGE_LISTS, SENTENCES_OF
from gleaner.plans.registry import query
from gleaner.plans.sqlkit import (ASCII_WORDS, COUNT, REXALL, RR, STRIP, any_contains, case, sql_list, sql_str)
from gleaner.plans.text_plans import _allowed, _odd

NL = "chr(10)"


def CORRUPT(x):
    """Corruption test of a sentence-sized column."""
    s = STRIP(x)
    solid = RR(s, r"\s+")
    aw = COUNT(s, "[A-Za-z]{2,}")
    vw = f"len(list_filter(regexp_extract_all({s}, '[A-Za-z]{{2,}}'), lambda w: regexp_matches(w, '(?i)[aeiouy]')))"
    return case([
        (f"length({s}) < 10", "TRUE"), (f"contains({s}, chr(65533))", "TRUE"), (f"{COUNT(s, chr(92) + 'S{2,}')} < 2", "TRUE"),
        (f"length({RR(solid, '[^' + chr(92) + 'p{L}]')}) / greatest(length({solid}), 1) < 0.55", "TRUE"),
        (f"length({RR(solid, '[' + chr(92) + 'p{L}' + chr(92) + 'p{N}]')}) / greatest(length({solid}), 1) >= 0.18", "TRUE"),
        (f"regexp_matches({s}, {sql_str(L.JUNK_SYMBOL_CLASS + '{2,}')})", "TRUE"),
        (f"regexp_matches({s}, {sql_str('[A-Za-z0-9]' + L.JUNK_SYMBOL_CLASS + '[A-Za-z0-9]')})", "TRUE"),
        (f"{aw} > 0 AND {vw} / {aw} < 0.60", "TRUE"), (f"(length({s}) - length({RR(s, _allowed)})) / greatest(length({s}), 1) < 0.85", "TRUE"),
        (f"regexp_matches({s}, {sql_str(_odd)})", "TRUE"), (f"regexp_matches({s}, {sql_str(L.MOJIBAKE_PATTERN)})", "TRUE")], "FALSE")


def METRICS(x):
    return f"list_transform({REXALL(ASCII_WORDS(x), L.EVIDENCE_METRIC, 1)}, lambda m: {STRIP('m')})"


def ENTITIES(x):
    return f"list_filter({REXALL(ASCII_WORDS(x), L.ENTITY_PATTERN, 1)}, lambda e: e NOT IN ({sql_list(L.ENTITY_STOP)}) AND length(e) > 2)"


def IS_EVIDENCE(x):
    a = ASCII_WORDS(x)
    return (f"(length({x}) BETWEEN 30 AND 500 AND (regexp_matches({a}, {sql_str(L.EVIDENCE_METRIC)}) OR (regexp_matches({a}, {sql_str(L.EMPIRICAL_ACTION)}) AND length({x}) > 50)) "
            f"AND NOT regexp_matches({x}, {sql_str(L.NOISE_LINE)}) AND NOT {CORRUPT(x)})")


@query("evd1_metrics", f"SELECT doc_id, pos, array_to_string({METRICS('sentence')}, '|') AS metrics FROM {I.SENTENCES}")
def _(spark, d):
    return I.sentences(spark, d).select("doc_id", "pos", F.array_join(E.metrics(F.col("sentence")), "|").alias("metrics"))


@query("evd2_entities", f"SELECT doc_id, pos, array_to_string({ENTITIES('sentence')}, '|') AS entities FROM {I.SENTENCES}")
def _(spark, d):
    return I.sentences(spark, d).select("doc_id", "pos", F.array_join(E.entities(F.col("sentence")), "|").alias("entities"))


EVIDENCE = f"""(SELECT claim_id, research_id, source_id, source_url, status, regexp_replace(claim, '\\.$', '') AS claim, metrics, entities,
  CASE WHEN contains(claim, '%') OR len(list_filter(metrics, lambda m: regexp_matches(m, {sql_str(L.STATISTIC_METRIC)}))) > 0 THEN 'statistic'
   WHEN regexp_matches(claim, {sql_str(L.POLICY_WORDS)}) THEN 'policy_event' ELSE 'empirical_finding' END AS evidence_type,
  round(CASE WHEN len(entities) >= 2 THEN least(0.98::DOUBLE, c1 + 0.02) ELSE c1 END, 4) AS confidence FROM (SELECT *, CASE WHEN len(metrics) > 0 THEN least(0.98::DOUBLE, confidence + 0.05) ELSE confidence END AS c1
   FROM (SELECT *, {METRICS('claim')} AS metrics, {ENTITIES('claim')} AS entities FROM {I.CLAIMS} WHERE {IS_EVIDENCE('claim')})))"""


def evidence(spark, d):
    rows = E.sentence_evidence(I.claims(spark, d), "claim", F.col("confidence"))
    return rows.select("claim_id", "research_id", "source_id", "source_url", "status", F.col("claim_text").alias("claim"), "metrics", "entities",
                       "evidence_type", F.col("evidence_confidence").alias("confidence"))


@query("evd3_sentence_evidence", f"SELECT claim_id, claim, array_to_string(metrics, '|') AS metrics, array_to_string(entities, '|') AS entities, evidence_type, confidence FROM {EVIDENCE}")
def _(spark, d):
    return evidence(spark, d).select("claim_id", "claim", F.array_join("metrics", "|").alias("metrics"), F.array_join("entities", "|").alias("entities"), "evidence_type", "confidence")


_score = (f"least(1.0::DOUBLE, 0.5::DOUBLE + least(0.3::DOUBLE, {COUNT(ASCII_WORDS('p'), L.EVIDENCE_METRIC)} * 0.1::DOUBLE) + least(0.2::DOUBLE, {COUNT(ASCII_WORDS('p'), L.EMPIRICAL_ACTION)} * 0.05::DOUBLE))")
SOURCE_EVIDENCE_SQL = f"""WITH l AS (SELECT doc_id AS source_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM {PASSAGE_LISTS}),
c AS (SELECT source_id, i, {_score} AS score, {SENTENCES_OF('p')} AS ss FROM l),
x AS (SELECT source_id, i, score, unnest(ss) AS quote, generate_subscripts(ss, 1) AS j FROM c),
e AS (SELECT source_id, lower(quote) AS low, quote, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, i, j) AS o FROM x WHERE {IS_EVIDENCE('quote')}),
t AS (SELECT source_id, quote, o, 'heuristic' AS method FROM e QUALIFY row_number() OVER (PARTITION BY source_id, low ORDER BY o) = 1),
a AS (SELECT source_id, {SENTENCES_OF('snippet')} AS ss FROM {I.SOURCES}), b AS (SELECT source_id, unnest(ss) AS quote, generate_subscripts(ss, 1) AS o FROM a),
s AS (SELECT source_id, quote, o, 'heuristic_snippet' FROM b WHERE source_id NOT IN (SELECT source_id FROM t) AND {IS_EVIDENCE('quote')}),
g AS (SELECT source_id, {SENTENCES_OF('content')} AS ss FROM {I.SOURCES}), h AS (SELECT source_id, unnest(ss) AS quote, generate_subscripts(ss, 1) AS o FROM g),
f AS (SELECT source_id, quote, o, 'heuristic_sentence' FROM h WHERE source_id NOT IN (SELECT source_id FROM t UNION SELECT source_id FROM s) AND length(quote) > 35 AND NOT {CORRUPT('quote')})
SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY o) - 1 AS INTEGER) AS n, regexp_replace(quote, '\\.$', '') AS claim, quote, method
FROM (SELECT * FROM t UNION ALL SELECT * FROM s UNION ALL SELECT * FROM f)"""


@query("evd4_source_evidence", SOURCE_EVIDENCE_SQL)
def _(spark, d):
    src = I.sources(spark, d).select("source_id", "content", "snippet").withColumn("passages", C.passage_list(F.col("content")))
    return E.extract_evidence(src)


# Passages: conversation turns with their claims' phrases.
@query("evd4_passage_evidence", f"""
WITH p AS (SELECT source_id, claim_id // 1000 AS turn_key, string_agg(claim, '. ' ORDER BY claim_id) AS passage FROM {I.CLAIMS} GROUP BY 1, 2),
s AS (SELECT turn_key, unnest(list_filter(list_transform(string_split({RR('passage', r'([.!?])' + chr(92) + 's+', chr(92) + '1' + chr(1))}, chr(1)), lambda x: {STRIP('x')}), lambda x: x <> '')) AS quote,
  generate_subscripts(list_filter(list_transform(string_split({RR('passage', r'([.!?])' + chr(92) + 's+', chr(92) + '1' + chr(1))}, chr(1)), lambda x: {STRIP('x')}), lambda x: x <> ''), 1) AS i FROM p)
SELECT turn_key, CAST(row_number() OVER (PARTITION BY turn_key ORDER BY i) - 1 AS INTEGER) AS n, quote FROM s WHERE {IS_EVIDENCE('quote')}""")
def _(spark, d):
    ordered = F.array_sort(F.collect_list(F.struct("claim_id", "claim")))
    turns = I.claims(spark, d).groupBy(F.expr("claim_id div 1000").alias("turn_key")).agg(F.array_join(F.transform(ordered, lambda x: x["claim"]), ". ").alias("passage"))
    return turns.select("turn_key", F.posexplode(E.passage_evidence(F.col("passage"))).alias("n", "quote"))


def _key(x):
    from gleaner.plans.text_plans import DECODE, _repair_sql
    x = f"translate({chain_(DECODE(x))}, chr(8217) || chr(8216) || chr(96) || chr(8220) || chr(8221), chr(39) || chr(39) || chr(39) || chr(34) || chr(34))"
    return f"lower(trim({RR(_repair_sql(x), chr(92) + 's+', ' ')}))"


def chain_(x):
    return RR(RR(x, L.ZERO_WIDTH_CLASS), L.CONTROL_CLASS)


@query("evd5_quote_occurs", f"""SELECT doc_id, {_key("replace(substr(text, 5, 80), ' ', '   ')")} <> '' AND contains({_key('text')}, {_key("replace(substr(text, 5, 80), ' ', '   ')")}) AS verbatim,
 contains({_key('text')}, {_key("'no such ' || substr(text, 1, 40)")}) AS invented FROM documents""")
def _(spark, d):
    t = F.col("text")
    return I.documents(spark, d).select("doc_id", E.quote_occurs(F.replace(F.substring(t, 5, 80), F.lit(" "), F.lit("   ")), t).alias("verbatim"),
                                        E.quote_occurs(F.concat(F.lit("no such "), F.substring(t, 1, 40)), t).alias("invented"))


def _w4(x):
    return TOKENS(x, ["\x02"], 4)


@query("evd6_claim_quote_support", f"""
WITH c AS (SELECT claim_id, claim, CASE WHEN claim_id % 2 = 0 THEN claim ELSE replace(claim, '2', '3') END AS quote FROM {I.CLAIMS})
SELECT claim_id, len(list_intersect({_w4('claim')}, {_w4('quote')})) >= 2 AND len(list_filter({REXALL(ASCII_WORDS('claim'), L.EVIDENCE_METRIC, 1)},
  lambda m: NOT list_contains({REXALL(ASCII_WORDS('quote'), L.EVIDENCE_METRIC, 1)}, m))) = 0 AS supported FROM c""")
def _(spark, d):
    quote = F.when(F.col("claim_id") % 2 == 0, F.col("claim")).otherwise(F.replace("claim", F.lit("2"), F.lit("3")))
    return I.claims(spark, d).select("claim_id", E.claim_supported_by_quote(F.col("claim"), quote).alias("supported"))


@query("evd7_eligible", f"""SELECT claim_id FROM {I.CLAIMS} WHERE status = 'verified' AND claim_id % 5 <> 1 AND claim_id % 5 <> 2 AND claim_id % 5 <> 3 AND NOT {CORRUPT('claim')}""")
def _(spark, d):
    k = F.col("claim_id") % 5
    meta = F.create_map(F.lit("content_provenance"), F.when(k == 1, "metadata-only").otherwise("fetched"), F.lit("evidence_eligible"), F.when(k == 2, "false").otherwise("true"),
                        F.lit("quote_validated"), F.when(k == 3, "false").otherwise("true"))
    return I.claims(spark, d).filter(E.eligible(meta, F.col("status"), F.col("claim"))).select("claim_id")


_STATUS = ("fetched", "snippet", "unavailable")
_long = "list_filter(list_transform(string_split({m}, chr(1)), lambda s: {s}), lambda s: length(s) >= 35)"


@query("evd8_source_sentences", f"""
WITH s AS (SELECT source_id, relevance_score, {_long.format(m=RR('content', r'([.!?])' + chr(92) + 's+', chr(92) + '1' + chr(1)), s=STRIP('s'))} AS ss, {I.sql_pick(_STATUS, 'source_id')} AS st FROM {I.SOURCES}),
x AS (SELECT source_id, relevance_score, st, unnest(ss) AS quote, generate_subscripts(ss, 1) - 1 AS n FROM s)
SELECT source_id, CAST(n AS INTEGER) AS n, regexp_replace(quote, '[.!?]+$', '') AS claim, round(least(0.96::DOUBLE, greatest(0.45::DOUBLE, relevance_score * 0.65 + CASE st WHEN 'fetched' THEN 0.25 WHEN 'snippet' THEN 0.2 ELSE 0.12 END)), 3) AS confidence,
 CASE WHEN regexp_matches(quote, {sql_str(L.JS_NUMBER)}) THEN 'quantitative' ELSE 'contextual' END AS evidence_type FROM x""")
def _(spark, d):
    rows = E.source_sentences(I.sources(spark, d).withColumn("extraction_status", I.pick(_STATUS, F.col("source_id"))), "source_id")
    return rows.select("source_id", "n", "claim", "confidence", "evidence_type")


_themes = ", ".join(f"CASE WHEN {any_contains('lower(claim)', ws)} THEN '{n}' END" for n, ws in L.THEMES)


@query("evd9_theme_claims", f"""
WITH t AS (SELECT source_id AS run, claim_id, claim, unnest(list_filter([{_themes}], lambda x: x IS NOT NULL)) AS theme FROM {I.CLAIMS}),
a AS (SELECT * FROM t UNION ALL SELECT source_id, claim_id, claim, 'market' FROM {I.CLAIMS} WHERE source_id NOT IN (SELECT run FROM t WHERE theme = 'market')),
g AS (SELECT run, theme, claim, min(claim_id) AS claim_id FROM a GROUP BY 1, 2, 3)
SELECT run AS source_id, theme, claim, claim_id FROM g""")
def _(spark, d):
    return E.theme_claims(I.claims(spark, d), "source_id", "claim_id").select("source_id", "theme", "claim", "claim_id")


@query("evd10_category_analysis", f"""
WITH s AS (SELECT research_id, source_type AS category, count(*) AS sources FROM {I.SOURCES} GROUP BY 1, 2),
e AS (SELECT source AS research_id, {I.sql_pick(I.KINDS, 'doc_id // 3')} AS category, count(*) FILTER (0.5::DOUBLE + (doc_id * 7 + pos) % 12 / 25 >= 0.7::DOUBLE AND pos % 9 <> 0) AS hc,
  count(*) FILTER (0.5::DOUBLE + (doc_id * 7 + pos) % 12 / 25 >= 0.7::DOUBLE AND pos % 9 <> 0 AND pos % 4 > 0) AS nm FROM {I.SENTENCES} GROUP BY 1, 2)
SELECT s.research_id, s.category, sources, coalesce(hc, 0) AS high_confidence, coalesce(nm, 0) AS numeric FROM s LEFT JOIN e USING (research_id, category)""")
def _(spark, d):
    n = F.col("doc_id") * 7 + F.col("pos")
    rows = I.sentences(spark, d).select(F.col("source").alias("research_id"), I.pick(I.KINDS, F.expr("doc_id div 3")).alias("category"), (0.5 + n % 12 / 25).alias("confidence"),
                                        F.when(F.col("pos") % 9 == 0, "unverified").otherwise("verified").alias("status"), (F.col("pos") % 4).alias("metrics"))
    return E.category_analysis(rows, I.sources(spark, d).withColumnRenamed("source_type", "category"), "research_id")


# --- claims ---------------------------------------------------------------------------------------------------------------
def _words_in(x, terms):
    return f"len(list_intersect({x}, [{sql_list(terms)}])) > 0"


_u = ASCII_WORDS("claim")
_ul = ASCII_WORDS("lower(claim)")
FEATURES = f"""(WITH w AS (SELECT *, regexp_extract_all(lower(claim), '[a-z0-9]+') AS ws, regexp_extract_all(lower(claim), '[a-z]+') AS ls FROM {I.CLAIMS}),
 f AS (SELECT *, {_words_in('ws', L.POSITIVE_WORDS)} AS up, {_words_in('ws', L.NEGATIVE_WORDS)} AS down FROM w)
 SELECT claim_id, research_id, source_id, source_url, claim, confidence, status, lower({STRIP('claim')}) AS claim_key,
  {case([(_words_in('ls', ws), sql_str(n)) for n, ws in L.REGION_WORDS], 'NULL')} AS region, {case([(f"regexp_matches({_ul}, {sql_str(p)})", sql_str(n)) for n, p in L.METRIC_CLASSES], 'NULL')} AS metric,
  {_words_in('ws', L.FORECAST_WORDS)} AS forecast, {_words_in('ws', L.HISTORICAL_WORDS)} AS historical,
  {case([(f"regexp_matches({_u}, {sql_str(p)})", sql_str(n)) for n, p in L.SEGMENT_PATTERNS], 'NULL')} AS segment,
  CASE WHEN up AND NOT down THEN 'positive' WHEN down AND NOT up THEN 'negative' ELSE '' END AS polarity,
  list_sort(list_distinct(list_transform({REXALL(_u, L.CLAIM_NUMBER)}, lambda n: replace(lower(n), ',', '')))) AS numbers, list_sort(list_distinct({REXALL(_u, L.YEAR_PATTERN)})) AS years,
  list_sort(list_distinct(list_filter(ws, lambda t: length(t) >= 2 AND t NOT IN ({sql_list(L.CONTRADICTION_STOP)})))) AS tokens FROM f)"""


def features(spark, d):
    return CL.claim_features(I.claims(spark, d))


@query("clm1_features", f"""SELECT claim_id, region, metric, forecast, historical, segment, polarity, array_to_string(numbers, '|') AS numbers, array_to_string(years, '|') AS years,
 array_to_string(tokens, ' ') AS tokens FROM {FEATURES}""")
def _(spark, d):
    return features(spark, d).select("claim_id", "region", "metric", "forecast", "historical", "segment", "polarity", F.array_join("numbers", "|").alias("numbers"),
                                     F.array_join("years", "|").alias("years"), F.array_join("tokens", " ").alias("tokens"))


_both = "a.claim || ' ' || b.claim"
_causes = ", ".join(f"CASE WHEN regexp_matches({ASCII_WORDS(_both)}, {sql_str(p)}) THEN '{n}' END" for n, p in L.CAUSE_PATTERNS)
CAUSE = f"""coalesce(nullif(array_to_string(list_filter([CASE WHEN len(a.years) > 0 AND len(b.years) > 0 AND a.years <> b.years THEN 'different years' END, {_causes}], lambda x: x IS NOT NULL), ', '), ''), {sql_str(L.UNKNOWN_CAUSE)})"""
_cmp = """a.research_id = b.research_id AND a.metric = b.metric AND (a.region IS NULL OR b.region IS NULL OR a.region = b.region) AND a.claim_key <> b.claim_key
  AND NOT (a.forecast AND b.historical) AND NOT (b.forecast AND a.historical) AND (a.segment IS NULL OR b.segment IS NULL OR a.segment = b.segment) AND len(list_intersect(a.tokens, b.tokens)) >= 2"""
_opp = "(a.polarity <> '' AND b.polarity <> '' AND a.polarity <> b.polarity)"
_group = "research_id, metric, region, segment, forecast, historical, polarity, status = 'disputed', claim_key"


def links_sql(right, clash, name):
    """(name) one row per text group: its first claim, its claims, the claims against it, the first of these."""
    return f"""{name}_p AS (SELECT a.claim_id, count(*) AS links, min(b.claim_id) AS first_id FROM f a JOIN {right} b ON {_cmp} WHERE {clash} GROUP BY 1),
{name} AS (SELECT research_id, min(claim_id) AS claim_id, count(*) AS claims, min(links) AS links, min(first_id) AS first_id FROM f JOIN {name}_p USING (claim_id) GROUP BY {_group})"""


CONTRA_SQL = f"""WITH f AS MATERIALIZED (SELECT * FROM {FEATURES} WHERE metric IS NOT NULL),
{links_sql('f', f"{_opp} OR a.status = 'disputed' OR b.status = 'disputed'", 'r')}"""
_LINKS = f"SELECT r.research_id, r.claim_id, claims, links, first_id, {CAUSE} AS cause FROM r JOIN f a ON a.claim_id = r.claim_id JOIN f b ON b.claim_id = first_id"


@query("clm2_contradictions", f"{CONTRA_SQL} {_LINKS}")
def _(spark, d):
    return CF.contradictions(features(spark, d))


@query("clm3_claim_contradictions", f"""WITH f AS MATERIALIZED (SELECT *, min(claim_id) OVER g AS class_id, count(*) OVER g AS claims FROM {FEATURES} WHERE metric IS NOT NULL WINDOW g AS (PARTITION BY {_group})),
p AS (SELECT a.claim_id, count(*) AS links, min(b.claim_id) AS first_id FROM f a JOIN f b ON {_cmp} WHERE {_opp} OR b.status = 'disputed' GROUP BY 1)
SELECT a.research_id, a.claim_id, a.class_id, a.claims, links, first_id, {CAUSE} AS cause FROM p JOIN f a ON a.claim_id = p.claim_id JOIN f b ON b.claim_id = first_id""")
def _(spark, d):
    f = features(spark, d)
    return CF.claims_against(f, f)


@query("clm4_causes", f"""WITH f AS (SELECT * FROM {FEATURES}) SELECT a.claim_id, {CAUSE} AS cause FROM f a JOIN f b ON b.source_id = a.source_id AND b.claim_id = a.claim_id + 1""")
def _(spark, d):
    f = features(spark, d)
    nxt = f.select((F.col("claim_id") - 1).alias("claim_id"), F.col("claim").alias("c2"), F.col("years").alias("y2"))
    return f.join(nxt, "claim_id").select("claim_id", CL.cause(F.col("claim"), F.col("c2"), F.col("years"), F.col("y2")).alias("cause"))


# --- gaps -------------------------------------------------------------------------------------------------------------------
def _gap_sql(x):
    x = STRIP(x)
    for p in L.GAP_PHRASES:
        x = STRIP(RR(x, f"(?i){p}"))
    return RR(x, r"^[ .,;]+|[ .,;]+$")


_GAPTEXT = "claim || CASE claim_id % 4 WHEN 0 THEN '; more studies needed' WHEN 1 THEN ' is UNCLEAR' WHEN 2 THEN ' conflicts with a report' ELSE '' END"
GAPS_SQL = f"""(WITH c AS (SELECT research_id, claim_id, {_GAPTEXT} AS claim FROM {I.CLAIMS}), g AS (SELECT research_id, claim_id, {_gap_sql('claim')} AS follow_up FROM c WHERE regexp_matches({ASCII_WORDS('claim')}, {sql_str(L.MISSING_PATTERN)}))
 SELECT research_id, follow_up, min(claim_id) AS claim_id FROM g WHERE follow_up <> '' AND (research_id, lower(follow_up)) NOT IN (SELECT research_id, lower(follow_up) FROM g WHERE claim_id % 3 = 0) GROUP BY 1, 2)"""


def gap_claims(spark, d):
    k = F.col("claim_id") % 4
    tail = F.when(k == 0, "; more studies needed").when(k == 1, " is UNCLEAR").when(k == 2, " conflicts with a report").otherwise("")
    return I.claims(spark, d).withColumn("claim", F.concat("claim", tail))


def planned(spark, d):
    return gap_claims(spark, d).filter((F.col("claim_id") % 3 == 0) & F.col("claim").rlike(L.MISSING_PATTERN)).select(
        "research_id", CL.gap_query(F.col("claim")).alias("query")).filter("query <> ''")


@query("clm21_information_gaps", f"SELECT research_id, follow_up, claim_id FROM {GAPS_SQL}")
def _(spark, d):
    return CL.information_gaps(gap_claims(spark, d), planned(spark, d), "research_id", "claim_id")


@query("clm22_conflict_signals", CONTRA_SQL + f""", k AS (SELECT research_id, claim_id FROM (SELECT research_id, claim_id, {_GAPTEXT} AS claim FROM {I.CLAIMS}) WHERE regexp_matches({ASCII_WORDS('claim')}, {sql_str(L.CONFLICT_PATTERN)}))
SELECT research_id, 'keyword' AS signal, claim_id AS left_id, CAST(NULL AS BIGINT) AS right_id FROM k UNION ALL SELECT research_id, 'pair', claim_id, first_id FROM r""")
def _(spark, d):
    return CL.conflict_signals(gap_claims(spark, d), CF.contradictions(features(spark, d)), "research_id", "claim_id")


@query("clm23_adaptive_tasks", CONTRA_SQL + f""", k AS (SELECT research_id, claim_id, claim FROM (SELECT research_id, claim_id, {_GAPTEXT} AS claim FROM {I.CLAIMS}) WHERE regexp_matches({ASCII_WORDS('claim')}, {sql_str(L.CONFLICT_PATTERN)})),
n AS (SELECT research_id, 1 AS priority, claim_id AS position, 'gap' AS kind, follow_up AS query FROM {GAPS_SQL} UNION ALL
 SELECT research_id, 2, claim_id, 'verify', 'Verify and resolve conflicting information about: ' || claim || ' — run ' || research_id FROM k UNION ALL
 SELECT research_id, 2, claim_id, 'verify', 'Verify and resolve conflicting information about:  — run ' || research_id FROM r UNION ALL
 SELECT DISTINCT research_id, 3, 0::BIGINT, 'diversity', 'Academic research and peer-reviewed studies on: run ' || research_id FROM {I.CLAIMS} WHERE research_id <> 'user')
SELECT research_id, priority, position, kind, query FROM n""")
def _(spark, d):
    claims = gap_claims(spark, d)
    gaps = CL.information_gaps(claims, planned(spark, d), "research_id", "claim_id")
    conflicts = CL.conflict_signals(claims, CF.contradictions(features(spark, d)), "research_id", "claim_id")
    named = conflicts.join(claims.select(F.col("claim_id").alias("left_id"), "claim"), "left_id", "left").withColumn(
        "claim", F.when(F.col("signal") == "keyword", F.col("claim")))
    runs = claims.select("research_id").distinct().withColumn("run_query", F.concat(F.lit("run "), F.col("research_id")))
    sources = claims.filter("research_id = 'user'").select("research_id", F.lit("academic").alias("source_type"))
    return CL.adaptive_tasks(gaps, named, sources, runs, planned(spark, d), "research_id", "claim_id")
