"""Usage, metrics, work lists."""

from pyspark.sql import functions as F

from gleaner.operators import memory as M
from gleaner.operators import usage as U
from gleaner.plans import inputs as I
from gleaner.plans.registry import query
from gleaner.plans.sqlkit import any_contains, sql_list, sql_str
from gleaner.sources.tables import spread, table

AS_OF = "2024-01-25 12:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def calls(spark, d):
    """Events as API calls: tokens from the props, cost by the default rule."""
    tokens = F.get_json_object("props", "$.k").cast("bigint") * 10
    return table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value", tokens.alias("tokens"), U.token_cost(tokens).alias("cost"),
                                           (F.col("event_type") == "error").alias("is_error"))


_tok = "CAST(json_extract(props, '$.k') AS BIGINT) * 10"
CALLS = f"(SELECT event_id, ts, user_id, event_type, value, {_tok} AS tokens, round({_tok} / 1000.0::DOUBLE * 0.002::DOUBLE, 6) AS cost, event_type = 'error' AS is_error FROM events)"
STATUSES = ["F", "O", "P", "X"]


@query("agg1_status_counts", """SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P,
 count(*) FILTER (o_orderstatus = 'X') AS X, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS completion_rate FROM orders GROUP BY 1""")
def _(spark, d):
    rows = U.status_counts(table(spark, d, "orders"), STATUSES, "o_orderstatus", ["o_orderpriority"], "F")
    return rows.withColumn("completion_rate", F.round("completion_rate", 6))


@query("agg2_monthly_usage", f"SELECT user_id, count(*) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost), 6) AS cost FROM {CALLS} WHERE ts >= TIMESTAMP '2024-01-01' AND ts <= TIMESTAMP '{AS_OF}' GROUP BY 1")
def _(spark, d):
    return U.monthly_usage(calls(spark, d), ["user_id"], as_of()).withColumn("cost", F.round("cost", 6))


def keys(spark, d):
    users = table(spark, d, "events").select("user_id").distinct()
    i = F.col("user_id")
    return users.select("user_id", (40 + i % 40).alias("monthly_quota"), (20000 + i * 100).alias("monthly_token_quota"), (1 + i % 3).alias("rate_limit"), (i % 10 > 0).alias("is_active"),
                        F.when(i % 7 == 0, F.lit("2024-01-20").cast("timestamp")).alias("expires_at"))


KEYS = "(SELECT DISTINCT user_id, 40 + user_id % 40 AS monthly_quota, 20000 + user_id * 100 AS monthly_token_quota, 1 + user_id % 3 AS rate_limit, user_id % 10 > 0 AS is_active, CASE WHEN user_id % 7 = 0 THEN TIMESTAMP '2024-01-20' END AS expires_at FROM events)"
_month = f"(SELECT user_id, count(*) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens FROM {CALLS} WHERE ts >= TIMESTAMP '2024-01-01' AND ts <= TIMESTAMP '{AS_OF}' GROUP BY 1)"


@query("agg3_remaining_quota", f"SELECT user_id, greatest(0, monthly_quota - coalesce(requests, 0)) AS requests_left, greatest(0, monthly_token_quota - coalesce(tokens, 0)) AS tokens_left FROM {KEYS} LEFT JOIN {_month} USING (user_id)")
def _(spark, d):
    return U.remaining_quota(U.monthly_usage(calls(spark, d), ["user_id"], as_of()), keys(spark, d), "user_id")


@query("agg4_cost_rollup", f"SELECT event_type, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost), 6) AS cost, round(avg(is_error::INT), 6) AS error_rate FROM {CALLS} GROUP BY ROLLUP (event_type)")
def _(spark, d):
    return U.cost_rollup(calls(spark, d), "event_type").withColumn("cost", F.round("cost", 6)).withColumn("error_rate", F.round("error_rate", 6))


@query("agg5_token_cost", f"SELECT event_id, tokens, cost FROM {CALLS}")
def _(spark, d):
    return calls(spark, d).select("event_id", "tokens", "cost")


@query("agg6_labelled_counter", "SELECT event_type, user_id, count(*) AS value FROM events GROUP BY GROUPING SETS ((event_type, user_id), ())")
def _(spark, d):
    return U.labelled_counter(table(spark, d, "events").select("event_type", "user_id"), ["event_type", "user_id"])


_le = "CASE " + " ".join(f"WHEN value <= {b} THEN {b}::DOUBLE" for b in U.BUCKETS) + " ELSE 'inf'::DOUBLE END"


@query("agg7_histogram", f"""WITH b AS (SELECT event_type, {_le} AS le, count(*) AS n, sum(value) AS s FROM events GROUP BY 1, 2),
c AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY le) AS u, sum(n) OVER (PARTITION BY event_type) AS t FROM b)
SELECT event_type, CAST(sum(n) AS BIGINT) AS count, round(sum(s), 4) AS sum, round(sum(s) / sum(n), 6) AS mean, min(CASE WHEN u >= t * 0.5 THEN le END) AS p50, min(CASE WHEN u >= t * 0.95 THEN le END) AS p95, min(CASE WHEN u >= t * 0.99 THEN le END) AS p99 FROM c GROUP BY 1""")
def _(spark, d):
    return U.histogram(table(spark, d, "events"), ["event_type"], "value").withColumn("sum", F.round("sum", 4)).withColumn("mean", F.round("mean", 6))


@query("agg8_gauge", "SELECT event_type, user_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def _(spark, d):
    return U.last_value(table(spark, d, "events"), ["event_type", "user_id"], "value", "ts", "event_id")


@query("agg9_exposition", """SELECT 'events_total{event_type="' || event_type || '"} ' || count(*) AS line FROM events GROUP BY event_type""")
def _(spark, d):
    return U.exposition_lines(table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("value")), "events_total", "event_type")


@query("agg10_minute_rates", "SELECT event_type, date_trunc('minute', ts) AS minute, round(count(*) / 60.0::DOUBLE, 6) AS per_second, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2")
def _(spark, d):
    rows = U.minute_rates(table(spark, d, "events"), ["event_type"], "value")
    return rows.select("event_type", "minute", F.round("per_second", 6).alias("per_second"), F.round("mean_value", 6).alias("mean_value"))


# Answers: assistant turns, each with the longest words of its own conversation's first turn as keywords.
_TAILS = (" [source: x] because", " see https://health.gov ## 1. **", "", " (source a) therefore - however")
_ANS = f"""(SELECT c.conv_id * 1000 + c.turn AS result_id, c.text || {I.sql_pick(_TAILS, 'c.turn')} AS answer, list_filter(list_distinct(regexp_extract_all(lower(q.text), '[a-z0-9]{{3,}}')), lambda w: length(w) >= 5) AS keywords,
 CASE WHEN c.conv_id % 3 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['health.gov', 'arxiv.org'] END AS domains, c.role, c.conv_id % 17 = 0 AS failed FROM conversations c JOIN conversations q ON q.conv_id = c.conv_id AND q.turn = 0)"""


def answers(spark, d):
    from gleaner.functions import tokens as K
    c = table(spark, d, "conversations")
    q = c.filter("turn = 0").select("conv_id", F.filter(K.long_tokens(F.col("text")), lambda w: F.length(w) >= 5).alias("keywords"))
    return c.join(q, "conv_id").select((F.col("conv_id") * 1000 + F.col("turn")).alias("result_id"), F.concat("text", I.pick(_TAILS, F.col("turn"))).alias("answer"), "keywords",
                                       F.when(F.col("conv_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("health.gov"), F.lit("arxiv.org"))).alias("domains"),
                                       "role", (F.col("conv_id") % 17 == 0).alias("failed"))


_fact = "CASE WHEN len(keywords) = 0 THEN 1.0::DOUBLE ELSE round(len(list_filter(keywords, lambda k: contains(lower(answer), k))) / len(keywords), 4) END"
_marks = " + ".join(f"contains(lower(answer), {sql_str(m)})::INT" for m in U.REASONING_MARKERS)
SCORES = f"""(SELECT result_id, role, failed, {_fact} AS factual, (CASE WHEN trim(answer) = '' THEN 0 WHEN {any_contains('lower(answer)', U.CITATION_MARKERS)} THEN 1 ELSE 0.5 END)::DOUBLE AS citation,
 CASE WHEN len(keywords) = 0 THEN 0::DOUBLE ELSE round(len(list_filter(keywords, lambda k: contains(lower(answer), k) AND regexp_matches(substr(lower(answer), strpos(lower(answer), k), 200), '\\[|\\(source|http'))) / len(keywords), 4) END AS completeness,
 {_fact} AS research, CASE WHEN len(domains) = 0 THEN 0.7::DOUBLE ELSE round(len(list_filter(domains, lambda k: contains(lower(answer), k))) / len(domains), 4) END AS source,
 CASE WHEN length(answer) < 100 THEN 0::DOUBLE ELSE least(1, round(({_marks}) / 5, 4)) END AS reasoning FROM {_ANS})"""
_over = " + ".join(f"{k} * {w}::DOUBLE" for k, w in U.SCORE_WEIGHTS.items())


def scored(spark, d):
    rows = answers(spark, d)
    s = U.answer_scores(F.col("answer"), F.col("keywords"), F.col("domains"))
    return rows.select("result_id", "role", "failed", *[c.alias(k) for k, c in s.items()]).withColumn("overall", U.overall_score())


@query("agg11_answer_scores", f"SELECT result_id, {', '.join(U.SCORE_WEIGHTS)} FROM {SCORES}")
def _(spark, d):
    return scored(spark, d).select("result_id", *U.SCORE_WEIGHTS)


@query("agg12_overall", f"SELECT result_id, round({_over}, 6) AS overall FROM {SCORES}")
def _(spark, d):
    return scored(spark, d).select("result_id", F.round("overall", 6).alias("overall"))


DIMS = [*U.SCORE_WEIGHTS, "overall"]
_long = " UNION ALL ".join(f"SELECT result_id, '{x}' AS dimension, round({_over if x == 'overall' else x}, 6) AS score FROM {SCORES} WHERE NOT failed" for x in DIMS)


@query("agg13_score_report", f"""WITH l AS ({_long}), r AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY score, result_id) - 1 AS r, count(*) OVER (PARTITION BY dimension) AS n FROM l)
SELECT dimension, count(*) AS n, round(avg(score), 5) AS mean, max(CASE WHEN r = floor(n * 0.5) THEN score END) AS p50, max(CASE WHEN r = least(floor(n * 0.95), n - 1) THEN score END) AS p95, min(score) AS low, max(score) AS high FROM r GROUP BY 1""")
def _(spark, d):
    rows = scored(spark, d).withColumn("overall", F.round("overall", 6))
    return U.score_report(rows, DIMS).withColumn("mean", F.round("mean", 5))


@query("agg14_topic_pass_rate", f"SELECT role, count(*) AS n, round(avg((round({_over}, 6) >= 0.4)::INT), 6) AS pass_rate FROM {SCORES} WHERE NOT failed GROUP BY 1")
def _(spark, d):
    rows = U.pass_rate(scored(spark, d).withColumn("overall", F.round("overall", 6)), ["role"], 0.4)
    return rows.withColumn("pass_rate", F.round("pass_rate", 6))


_TASKS = "(SELECT l_orderkey, l_returnflag, epoch(l_shipdate) AS started, epoch(l_shipdate) + l_quantity * 3600 AS ended, CASE WHEN l_linestatus = 'F' THEN 'failed' ELSE 'completed' END AS status FROM lineitem)"


def tasks(spark, d):
    start = F.unix_timestamp("l_shipdate").cast("double")
    return table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", start.alias("started"), (start + F.col("l_quantity") * 3600).alias("ended"),
                                              F.when(F.col("l_linestatus") == "F", "failed").otherwise("completed").alias("status"))


@query("agg15_executor_telemetry", f"SELECT l_orderkey, count(*) AS tasks, count(*) FILTER (status = 'failed') AS failed, sum(ended - started) AS busy, max(ended) - min(started) AS wall, round(CASE WHEN max(ended) > min(started) THEN sum(ended - started) / (max(ended) - min(started)) ELSE 1 END, 6) AS speed_up FROM {_TASKS} GROUP BY 1")
def _(spark, d):
    return U.executor_telemetry(tasks(spark, d), ["l_orderkey"]).withColumn("speed_up", F.round("speed_up", 6))


@query("agg16_agent_summary", "SELECT l_orderkey, count(*) AS runs, round(sum(l_quantity * 10), 2) AS total_ms, coalesce(array_to_string(list_sort(list(DISTINCT l_returnflag) FILTER (l_linestatus = 'F')), ','), '') AS failed_agents FROM lineitem GROUP BY 1")
def _(spark, d):
    runs = table(spark, d, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("agent"), (F.col("l_quantity") * 10).alias("duration_ms"), F.when(F.col("l_linestatus") == "F", "failed").otherwise("ok").alias("status"))
    rows = U.agent_summary(runs, "l_orderkey")
    return rows.select("l_orderkey", "runs", F.round("total_ms", 2).alias("total_ms"), F.array_join("failed_agents", ",").alias("failed_agents"))


_SPANS = "(SELECT event_id AS span_id, CASE WHEN event_id < 20 THEN NULL ELSE event_id // 4 END AS parent_id, event_type AS name, value AS duration FROM events)"


@query("agg17_span_tree", f"""WITH RECURSIVE s AS (SELECT * FROM {_SPANS}), t AS (SELECT span_id, 0 AS depth, span_id AS root, name AS path, duration, [span_id] AS chain FROM s WHERE parent_id IS NULL
 UNION ALL SELECT s.span_id, t.depth + 1, t.root, t.path || '/' || s.name, s.duration, list_append(t.chain, s.span_id) FROM s JOIN t ON s.parent_id = t.span_id),
 u AS (SELECT x AS span_id, round(sum(duration), 4) AS subtree FROM (SELECT unnest(chain) AS x, duration FROM t) GROUP BY 1)
SELECT span_id, depth, root, path, duration, subtree FROM t JOIN u USING (span_id)""")
def _(spark, d):
    i = F.col("event_id")
    spans = table(spark, d, "events").select(i.alias("span_id"), F.when(i >= 20, F.expr("event_id div 4")).alias("parent_id"), F.col("event_type").alias("name"), F.lit(0.0).alias("started"), F.col("value").alias("ended"))
    return U.span_tree(spans).withColumn("subtree", F.round("subtree", 4))


@query("agg18_totals", "SELECT 'users' AS name, count(*) AS total FROM customer UNION ALL SELECT 'research', count(*) FROM orders UNION ALL SELECT 'reports', count(*) FROM lineitem")
def _(spark, d):
    parts = [table(spark, d, t).agg(F.count("*").alias("total")).select(F.lit(n).alias("name"), "total") for n, t in (("users", "customer"), ("research", "orders"), ("reports", "lineitem"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("agg19_queue_status", "SELECT count(*) FILTER (o_orderstatus = 'P') AS pending, count(*) FILTER (o_orderstatus IN ('O', 'P')) AS in_progress, count(*) AS total FROM orders")
def _(spark, d):
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").agg(F.count_if(s == "P").alias("pending"), F.count_if(s.isin("O", "P")).alias("in_progress"), F.count("*").alias("total"))


@query("agg20_latest_per_user", "SELECT o_custkey, o_orderkey, o_orderdate, CAST(row_number() OVER w AS INTEGER) AS rank FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) QUALIFY rank <= 3")
def _(spark, d):
    return U.latest_per(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", [F.desc("o_orderdate"), F.asc("o_orderkey")], 3)


@query("agg21_work_list", "SELECT o_orderkey, o_orderpriority, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 100")
def _(spark, d):
    open_ = table(spark, d, "orders").filter("o_orderstatus = 'O'").select("o_orderkey", "o_orderpriority", "o_orderdate")
    return U.page(open_, [F.asc("o_orderpriority"), F.asc("o_orderdate"), F.asc("o_orderkey")], 100)[0]


@query("agg22_unread", "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS INTEGER) AS rank FROM events WHERE event_type <> 'view' QUALIFY rank <= 5")
def _(spark, d):
    notes = table(spark, d, "events").select("user_id", "event_id", "ts", (F.col("event_type") == "view").alias("is_read"))
    return U.unread(notes, "user_id", [F.desc("ts"), F.asc("event_id")], 5).select("user_id", "event_id", "rank")


@query("agg22_mark_read", "SELECT user_id, count(*) FILTER (event_type = 'view' OR user_id % 2 = 0) AS read, count(*) AS total FROM events GROUP BY 1")
def _(spark, d):
    notes = table(spark, d, "events").select("user_id", (F.col("event_type") == "view").alias("is_read"))
    marked = U.mark_all_read(notes, notes.filter("user_id % 2 = 0"), "user_id")
    return marked.groupBy("user_id").agg(F.count_if("is_read").alias("read"), F.count("*").alias("total"))


@query("agg23_user_history", "WITH h AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events QUALIFY r <= 10) SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS pos FROM h")
def _(spark, d):
    from pyspark.sql import Window
    last = U.latest_per(table(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", [F.desc("ts"), F.desc("event_id")], 10)
    return last.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("pos"))


@query("agg24_merge_conversations", """WITH r AS (SELECT conv_id, turn // 2 AS run_id, min(turn) AS o FROM conversations GROUP BY 1, 2)
SELECT conv_id, count(*) AS messages, max(turn) AS updated_at, (SELECT string_agg(run_id, ',' ORDER BY o) FROM r WHERE r.conv_id = c.conv_id) AS run_ids FROM conversations c GROUP BY 1""")
def _(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.expr("turn div 2").alias("run_id"))
    return U.merge_conversations(rows, "conv_id", "turn").withColumn("run_ids", F.array_join(F.col("run_ids").cast("array<string>"), ","))


@query("agg25_feedback", "SELECT d.source, count(*) AS ratings, round(avg(quality * 4 + 1), 6) AS avg_rating, count(*) FILTER (toxic = 1) AS flagged FROM labels JOIN documents d USING (doc_id) GROUP BY 1")
def _(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return rows.groupBy("source").agg(F.count("*").alias("ratings"), F.round(F.avg(F.col("quality") * 4 + 1), 6).alias("avg_rating"), F.count_if(F.col("toxic") == 1).alias("flagged"))


_ROLES = ("admin", "Researcher", "analyst", "viewer", "guest")
_SEG = "CASE c_mktsegment " + " ".join(f"WHEN '{s}' THEN '{r}'" for s, r in zip(("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"), _ROLES)) + " END"
_perm = ", ".join(f"('{r}', '{p}')" for r, ps in U.ROLE_PERMISSIONS.items() for p in ps)


@query("agg26_permissions", f"""WITH p(role, permission) AS (VALUES {_perm}), m AS (SELECT c_custkey, lower({_SEG}) AS role FROM customer)
SELECT c_custkey, count(permission) AS permissions, count(*) FILTER (permission = 'research:delete') > 0 AS may_delete FROM m LEFT JOIN p USING (role) GROUP BY 1""")
def _(spark, d):
    seg = F.create_map(*[F.lit(x) for s, r in zip(("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"), _ROLES) for x in (s, r)])
    role = F.try_element_at(seg, F.col("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", F.coalesce(F.size(F.try_element_at(U.permissions(), F.lower(role))), F.lit(0)).cast("bigint").alias("permissions"), U.has_permission(role, "research:delete").alias("may_delete"))


@query("agg27_team_sizes", "SELECT n_nationkey, n_name, count(c_custkey) AS members FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def _(spark, d):
    counts = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("members"))
    return table(spark, d, "nation").select("n_nationkey", "n_name").join(counts, "n_nationkey", "left").fillna(0, ["members"])


_mv = ", ".join(f"('{m[0]}', '{m[1]}', {m[2]}, {m[3]})" for m in U.MODELS)


@query("agg28_cheapest_model", f"""WITH m(model_id, tier, ic, oc) AS (VALUES {_mv}), r AS (SELECT conv_id * 1000 + turn AS qid, greatest(10, len(regexp_extract_all(text, '\\S+')) * 2) AS it, CASE WHEN length(text) > 1000 THEN 1000 ELSE 300 END AS ot FROM conversations),
s AS (SELECT qid, model_id, it / 1e6::DOUBLE * ic + ot / 1e6::DOUBLE * oc AS cost, 100 - CASE tier WHEN 'cheap' THEN 0 WHEN 'standard' THEN 25 WHEN 'powerful' THEN 50 ELSE 75 END - (it / 1e6::DOUBLE * ic + ot / 1e6::DOUBLE * oc) * 5000 + CASE WHEN tier = 'cheap' THEN 40 ELSE 0 END AS score FROM r, m),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, model_id) AS n FROM s)
SELECT qid, max(CASE WHEN n = 1 THEN model_id END) AS model_id, round(max(CASE WHEN n = 1 THEN cost END), 8) AS cost, string_agg(model_id, ',' ORDER BY n) FILTER (n BETWEEN 2 AND 4) AS fallbacks FROM k GROUP BY 1""")
def _(spark, d):
    from gleaner.functions import tokens as K
    c = table(spark, d, "conversations").withColumn("qid", F.col("conv_id") * 1000 + F.col("turn"))
    rows = U.cheapest_model(c, "qid", F.greatest(F.lit(10), K.word_count(F.col("text")) * 2), F.when(F.length("text") > 1000, 1000).otherwise(300))
    return rows.select("qid", "model_id", F.round("cost", 8).alias("cost"), F.array_join("fallbacks", ",").alias("fallbacks"))


_ST = (200, 403, 404, 429, 500, 408, 502, 418, 200)
_cls = "CASE WHEN st = 200 THEN 'ok' WHEN st = 403 THEN 'forbidden' WHEN st = 404 THEN 'not_found' WHEN st = 408 THEN 'timeout' WHEN st = 429 THEN 'rate_limited' WHEN st = 502 THEN 'connect' WHEN st IN (500, 503, 504) THEN 'server_error' ELSE 'other' END"


@query("agg29_fetch_outcomes", f"""WITH f AS (SELECT 'host' || user_id % 20 AS domain, {list(_ST)}[event_id % {len(_ST)} + 1] AS st, event_id % 5 = 0 OR event_id % 4 = 0 AS pdf FROM events)
SELECT domain, class, count(*) AS fetches, count(*) FILTER (pdf) AS pdfs FROM (SELECT domain, {_cls} AS class, pdf FROM f) GROUP BY ROLLUP (domain, class)""")
def _(spark, d):
    i = F.col("event_id")
    log = table(spark, d, "events").select(F.concat(F.lit("host"), (F.col("user_id") % 20).cast("string")).alias("domain"), I.pick(_ST, i).alias("status"), F.when(i % 5 == 0, "Application/PDF").otherwise("text/html").alias("content_type"),
                                           F.when(i % 4 == 0, "https://x/a.PDF?b").otherwise("https://x/a").alias("url"))
    return U.fetch_outcomes(log)


@query("agg30_fan_out", """WITH t AS (SELECT DISTINCT user_id, user_id % 3 AS k FROM events WHERE user_id % 4 > 0) SELECT event_id, user_id, user_id * 10 AS target_id FROM events JOIN t USING (user_id) WHERE k = 0 OR (k = 1 AND event_type IN ('error', 'signup')) OR (k = 2 AND event_type = 'click')""")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    k = F.col("user_id") % 3
    types = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("error"), F.lit("signup"))).otherwise(F.array(F.lit("click")))
    targets = e.select("user_id").distinct().select("user_id", (F.col("user_id") * 10).alias("target_id"), (F.col("user_id") % 4 > 0).alias("enabled"), types.alias("types"))
    return U.fan_out(e, targets, "user_id", "event_type").select("event_id", "user_id", "target_id")


# --- scans and deletes ------------------------------------------------------------------------------------------------------
@query("io1_list_sources", f"SELECT source_id, research_id, round(relevance_score, 6) AS relevance_score FROM {I.SOURCES} WHERE lower(trim(source_type)) = 'news' AND language = 'en' AND relevance_score >= 0.5::DOUBLE AND credibility_score >= 0.5::DOUBLE")
def _(spark, d):
    from gleaner.operators.sourcing import list_sources
    rows = list_sources(I.sources(spark, d), source_type=" News", language="en", min_relevance=0.5, min_credibility=0.5)
    return rows.select("source_id", "research_id", F.round("relevance_score", 6).alias("relevance_score"))


@query("io2_list_evidence", f"SELECT claim_id, confidence FROM {I.CLAIMS} WHERE status = 'verified' AND confidence >= 0.8 ORDER BY claim_id LIMIT 100")
def _(spark, d):
    return U.page(I.claims(spark, d).filter("status = 'verified' and confidence >= 0.8").select("claim_id", "confidence"), [F.asc("claim_id")], 100)[0]


@query("io3_paged_listing", "SELECT c_custkey, c_name, (SELECT count(*) FROM customer) AS total FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 40")
def _(spark, d):
    rows, total = U.page(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), [F.desc("c_acctbal"), F.asc("c_custkey")], 20, 40)
    return rows.drop("c_acctbal").join(total)


@query("io10_cascade_delete", "SELECT 'orders' AS name, count(*) AS left_rows FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def _(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    out = M.cascade_delete(orders, {"lineitem": (table(spark, d, "lineitem").select("l_orderkey"), "l_orderkey")}, orders.filter("o_orderstatus = 'P'").select("o_orderkey"), "o_orderkey")
    count = lambda df, n: df.agg(F.count("*").alias("left_rows")).select(F.lit(n).alias("name"), "left_rows")
    return count(out["parents"], "orders").unionByName(count(out["lineitem"], "lineitem"))


@query("io15_event_history", "SELECT event_id, ts, event_type FROM events WHERE user_id = 8 ORDER BY ts, event_id LIMIT 200")
def _(spark, d):
    return U.page(table(spark, d, "events").filter("user_id = 8").select("event_id", "ts", "event_type"), [F.asc("ts"), F.asc("event_id")], 200)[0]


@query("io17_conform", f"""SELECT CAST(source_id AS VARCHAR) AS source_id, source_type, published_at, sha256(regexp_replace(content, '^\\s+|\\s+$', '', 'g')) AS content_hash FROM {I.SOURCES} WHERE source_id % 4 <> 3""")
def _(spark, d):
    from gleaner.operators.sourcing import conform_sources
    src = I.sources(spark, d)
    first = src.filter("source_id % 2 = 0").select("source_id", "url", "content", "source_type", "published_at")
    second = src.filter("source_id % 2 = 1").select(F.when(F.col("source_id") % 4 == 1, F.col("source_id")).alias("_id"), "url", F.col("content").alias("clean_text"), F.upper("source_type").alias("type"), F.col("published_at").alias("publication_date"))
    return conform_sources(first, second)[0].select("source_id", "source_type", "published_at", "content_hash")
