"""Question queries."""

from pyspark.sql import functions as F

from gleaner import lexicons as L
from gleaner.operators import questions as Q
from gleaner.plans import inputs as I
from gleaner.plans.registry import query
from gleaner.plans.sqlkit import ASCII_WORDS, COUNT, RR, STRIP, any_contains, case, sql_list, sql_str
from gleaner.sources.tables import spread, table

LEADS = ("What is ", "Analyze the market size of ", "Explain ", "Compare market trend and forecast: ", "How does the ", "", "who is ", "Tell me about the ")
_Q = f"{I.sql_pick(LEADS, 'conv_id * 3 + turn')} || {RR('text', '[.!?]+' + chr(92) + 's*$')} || CASE WHEN turn % 2 = 0 THEN '?' ELSE '' END"
QUESTIONS = f"(SELECT conv_id * 1000 + turn AS qid, role, conv_id, turn, {_Q} AS question FROM conversations)"


def questions(spark, d):
    q = F.concat(I.pick(LEADS, F.col("conv_id") * 3 + F.col("turn")), F.regexp_replace("text", r"[.!?]+\s*$", ""), F.when(F.col("turn") % 2 == 0, "?").otherwise(""))
    return spread(table(spark, d, "conversations")).select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), "role", "conv_id", "turn", q.alias("question"))


def _any(x, ps):
    return "(" + " OR ".join(f"regexp_matches({x}, {sql_str(p)})" for p in ps) + ")"


_low = ASCII_WORDS(f"lower({STRIP('question')})")


@query("qry1_quick_or_deep", f"SELECT qid, {case([(_any(_low, L.QUICK_COMPLEX), sql_str('deep')), (_any(_low, L.QUICK_SIMPLE), sql_str('quick')), (COUNT(STRIP('question'), chr(92) + 'S+') + ' <= 12', sql_str('quick'))], sql_str('deep'))} AS route FROM {QUESTIONS}")
def _(spark, d):
    return questions(spark, d).select("qid", Q.quick_or_deep(F.col("question")).alias("route"))


_words = COUNT("question", r"\S+")
_hits = COUNT(ASCII_WORDS("question"), "(?i)" + L.PLAN_COMPLEX)
COMPLEX = f"CASE WHEN regexp_matches({ASCII_WORDS(STRIP('question'))}, {sql_str('(?i)' + L.PLAN_SIMPLE)}) AND {_words} <= 6 THEN 'simple' WHEN {_hits} >= 3 OR {_words} >= 15 THEN 'complex' WHEN {_hits} >= 1 OR {_words} >= 8 THEN 'moderate' ELSE 'simple' END"


@query("qry2_complexity", f"SELECT qid, {COMPLEX} AS complexity FROM {QUESTIONS}")
def _(spark, d):
    return questions(spark, d).select("qid", Q.complexity(F.col("question")).alias("complexity"))


@query("qry3_task_count", f"""WITH c AS (SELECT qid, {COMPLEX} AS k, conv_id % 5 + 1 AS dep, turn % 8 + 1 AS br FROM {QUESTIONS})
SELECT qid, least(50, CASE k WHEN 'simple' THEN greatest(2, least(4, br)) WHEN 'moderate' THEN greatest(4, dep * br + br) ELSE greatest(8, dep * br * 2 + br) END) AS tasks FROM c""")
def _(spark, d):
    return questions(spark, d).select("qid", Q.task_count(Q.complexity(F.col("question")), F.col("conv_id") % 5 + 1, F.col("turn") % 8 + 1).alias("tasks"))


@query("qry4_round_robin", """WITH p AS (SELECT p_size AS run, p_brand, p_partkey, row_number() OVER (PARTITION BY p_size, p_brand ORDER BY p_partkey) AS rn, min(p_partkey) OVER (PARTITION BY p_size, p_brand) AS f FROM part)
SELECT run, p_brand, p_partkey, CAST(row_number() OVER (PARTITION BY run ORDER BY rn, f) AS INTEGER) AS rank FROM p QUALIFY row_number() OVER (PARTITION BY run ORDER BY rn, f) <= 12""")
def _(spark, d):
    parts = table(spark, d, "part").select(F.col("p_size").alias("run"), "p_brand", "p_partkey")
    return Q.round_robin(parts, "run", "p_brand", "p_partkey", F.lit(12))


_stop = "|".join(L.TOPIC_LEADING_STOP)
_bare = STRIP(RR(STRIP("question"), r"\?+$"))
_cut = RR(STRIP(RR(_bare, rf"(?i)^(?:(?:{_stop})(?:\s+|$))+")), r"\s+", " ")
TOPIC = f"CASE WHEN {_cut} = '' THEN {STRIP('question')} ELSE {_cut} END"
_cat = I.sql_pick(("web", "academic", "market"), "conv_id")
_tpl = "CASE " + " ".join(f"WHEN st = '{n}' THEN [{sql_list(ts)}]" for n, ts in L.QUERY_TEMPLATES.items()) + " END"
EXPAND = f"""(WITH t AS (SELECT qid, {TOPIC} AS tp, {_cat} AS cat FROM {QUESTIONS}), s AS (SELECT *, CASE WHEN cat IN ('academic', 'market') THEN cat WHEN regexp_matches({ASCII_WORDS('tp')}, {sql_str(L.INVESTMENT_TOPIC)}) THEN 'investment' ELSE 'general' END AS st FROM t),
 x AS (SELECT qid, tp, unnest(({_tpl})[1:6]) AS q, generate_subscripts(({_tpl})[1:6], 1) AS rank FROM s)
 SELECT qid, tp, CAST(rank AS INTEGER) AS rank, replace(replace(replace(q, '{{topic}}', tp), '{{next_year}}', '2027'), '{{year}}', '2026') AS query FROM x)"""


def categorised(spark, d):
    return questions(spark, d).withColumn("category", I.pick(("web", "academic", "market"), F.col("conv_id")))


@query("qry5_expand", f"SELECT qid, rank, query FROM {EXPAND}")
def _(spark, d):
    return Q.expand(categorised(spark, d), 6, 2026, "qid")


_ONTOPIC = f"""WITH g AS (SELECT q.qid, t.tp, generate_series AS ord, CASE WHEN (q.qid + generate_series) % 3 = 0 THEN 'unrelated phrase' ELSE split_part(t.tp, ' ', 1 + CAST(generate_series AS INTEGER)) || ' study ' || generate_series END AS query FROM {QUESTIONS} q, generate_series(0, 4), (SELECT qid, any_value(tp) AS tp FROM {EXPAND} GROUP BY 1) t WHERE t.qid = q.qid),
w AS (SELECT *, list_filter(regexp_extract_all(lower(tp), '[a-z0-9]+'), lambda x: length(x) > 2 OR x IN ('ai', 'ev', 'ml')) AS ws FROM g),
k AS (SELECT qid, tp, ord, {STRIP('query')} AS query FROM w WHERE {STRIP('query')} <> '' AND (len(ws) = 0 OR len(list_intersect(ws, regexp_extract_all(lower(query), '[a-z0-9]+'))) > 0)),
p AS (SELECT qid, 0 AS s, ord, CASE WHEN count(*) OVER (PARTITION BY qid) >= 4 OR contains(lower(query), lower(tp)) THEN query ELSE tp || ' ' || query END AS query FROM k),
b AS (SELECT * FROM p UNION ALL SELECT qid, 1, rank, query FROM {EXPAND}),
u AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY qid, lower(query) ORDER BY s, ord) = 1)
SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY s, ord) AS INTEGER) AS rank, query FROM u QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s, ord) <= 4"""


@query("qry6_keep_on_topic", _ONTOPIC)
def _(spark, d):
    qs = categorised(spark, d)
    rows = qs.select("qid", Q.topic(F.col("question")).alias("t"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("ord"))
    word = F.coalesce(F.get(F.split("t", " "), F.col("ord")), F.lit(""))
    given = rows.select("qid", "ord", F.when((F.col("qid") + F.col("ord")) % 3 == 0, "unrelated phrase").otherwise(
        F.concat(word, F.lit(" study "), F.col("ord").cast("string"))).alias("query"))
    return Q.keep_on_topic(given, qs, Q.expand(qs, 6, 2026, "qid"), "qid", 4)


_pairs = [(c, *Q.TASK_TEMPLATES[c][turn]) for turn in (0, 1) for c in ("web", "academic", "market")]


@query("qry7_plan_tasks", f"""WITH q AS (SELECT qid, question, unnest(range(greatest(3, turn % 9 + 1))) AS i FROM {QUESTIONS})
SELECT qid, CAST(i + 1 AS INTEGER) AS task_no, ([{sql_list(p[0] for p in _pairs)}])[i % 6 + 1] AS category, replace(([{sql_list(p[1] for p in _pairs)}])[i % 6 + 1], '{{query}}', question) AS question,
 replace(([{sql_list(p[2] for p in _pairs)}])[i % 6 + 1], '{{query}}', question) AS query FROM q""")
def _(spark, d):
    rows = questions(spark, d).select("qid", F.col("question").alias("query"), (F.col("turn") % 9 + 1).cast("int").alias("breadth"))
    return Q.fallback_tasks(rows, "qid", ("web", "academic", "market"))


_cats = "[' News', 'papers', 'WEB', 'sports', 'Markets', 'academia']"


@query("qry8_categories", f"""WITH c AS (SELECT qid, list_filter(list_transform(list_transform({_cats}[qid % 4 + 1 : qid % 4 + 3], lambda c: lower(trim(c))), lambda c: {case([(f"c = '{k}'", f"'{v}'") for k, v in L.CATEGORY_ALIASES.items()], 'NULL')}), lambda c: c IS NOT NULL) AS n FROM {QUESTIONS})
SELECT qid, array_to_string(list_filter(n, lambda x, i: list_position(n, x) = i), ',') AS categories FROM c""")
def _(spark, d):
    names = F.array(*[F.lit(x) for x in (" News", "papers", "WEB", "sports", "Markets", "academia")])
    return questions(spark, d).select("qid", F.array_join(Q.normal_categories(F.slice(names, (F.col("qid") % 4 + 1).cast("int"), 3)), ",").alias("categories"))


_modes = ", ".join(f"('{m[0]}', {m[1]}, {m[2]}, {m[3]}, {m[4]}, {m[5]}, {m[6]}, {m[7]})" for m in Q.MODES)


@query("qry9_mode_settings", f"""WITH m({', '.join(Q.MODE_COLUMNS)}) AS (VALUES {_modes}), j AS (SELECT o_orderkey, {I.sql_pick(('Quick', 'standard', 'DEEP', 'expert', 'turbo'), 'o_orderkey')} AS md FROM orders)
SELECT o_orderkey, m.min_sources, m.max_sources, m.depth, m.breadth, m.max_concurrency, m.fact_checking, m.verification_passes FROM j JOIN m ON m.mode = CASE WHEN lower(md) IN (SELECT mode FROM m) THEN lower(md) ELSE 'standard' END""")
def _(spark, d):
    jobs = table(spark, d, "orders").select("o_orderkey", I.pick(("Quick", "standard", "DEEP", "expert", "turbo"), F.col("o_orderkey")).alias("mode"))
    return Q.mode_settings(jobs, "o_orderkey")


_adds = (" verify claim", " decompose it", " executive summary", " classify", "", "")
_pt = f"text || {I.sql_pick(_adds, 'conv_id + turn')}"
(_f, _fw), (_p, _pw), (_b, _bw), (_s, _sw) = Q.PROMPT_CLASSES


_hints = ("Extract-fields", "sub plan", "Write up", "credibility", "Debug this", "other", "")
_systems = ("You verify claim lists.", "", "Draft section by section.", "")
_hint, _system = f"lower({I.sql_pick(_hints, 'conv_id')})", I.sql_pick(_systems, "conv_id + turn")
_text_class = case([(any_contains("low", _fw), sql_str(_f)), (any_contains("low", _pw), sql_str(_p)), (any_contains("low", _bw) + " OR length(p) > 4000", sql_str(_b)), (any_contains("low", _sw) + " OR length(p) < 400", sql_str(_s))], "'general'")
_hinted = case([("turn % 2 = 0", "NULL"), ("contains(h, 'extract') OR contains(h, 'parse') OR contains(h, 'filter') OR contains(h, 'clean')", "'simple_extraction'"),
                ("contains(h, 'plan') OR contains(h, 'decompose') OR contains(h, 'strategy')", "'complex_planning'"),
                ("contains(h, 'synth') OR contains(h, 'report') OR contains(h, 'comprehensive') OR contains(h, 'write')", "'large_synthesis'"),
                ("contains(h, 'fact') OR contains(h, 'verify') OR contains(h, 'contradict') OR contains(h, 'credib')", "'fact_checking'"),
                ("contains(h, 'code') OR contains(h, 'debug')", "'code_analysis'")], "NULL")


@query("qry10_prompt_class", f"""WITH c AS (SELECT conv_id, turn, {_pt} AS p, {_hint} AS h, lower({_system} || chr(10) || {_pt}) AS low FROM conversations)
SELECT conv_id, turn, coalesce({_hinted}, {_text_class}) AS class FROM c""")
def _(spark, d):
    i = F.col("conv_id") + F.col("turn")
    hint = F.when(F.col("turn") % 2 == 1, I.pick(_hints, F.col("conv_id")))
    kind = Q.prompt_class(F.concat("text", I.pick(_adds, i)), I.pick(_systems, i), hint)
    return table(spark, d, "conversations").select("conv_id", "turn", kind.alias("class"))
