"""Stream operators, run on the event table: batch forms with oracles, and streams driven to completion."""

import uuid

from pyspark.sql import functions as F

from gleaner.operators import usage as U
from gleaner.plans import inputs as I
from gleaner.plans import usage_plans as UP
from gleaner.plans.registry import query
from gleaner.session import ensure_checkpoint_dir
from gleaner.sources.tables import table
from gleaner.streaming import streams as S


def events(spark, d):
    return table(spark, d, "events")


def event_stream(spark, d):
    schema = events(spark, d).schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(spark, stream, mode):
    """Run a stream over what is there and read its table back from the shared folder."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start()
    else:
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).foreachBatch(
            lambda df, i: df.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/out")).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


@query("str1_job_log", "SELECT user_id AS job_id, count(*) AS events, min(event_id) AS first_event FROM events GROUP BY 1")
def _(spark, d):
    log = drained(spark, S.job_log(event_stream(spark, d)), "append")
    return log.groupBy("job_id").agg(F.count("*").alias("events"), F.min("event_id").alias("first_event"))


@query("str2_recent_requests", "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS in_last_minute FROM events")
def _(spark, d):
    return S.recent_requests(events(spark, d), seconds=60)


def _mark(seconds):
    """Where a stream over all events ends: the last event's millisecond less the delay."""
    return f"(SELECT (max(epoch_us(ts)) // 1000) * 1000 - {seconds} * 1000000 FROM events)"


@query("str2_sliding_requests", f"""WITH w AS (SELECT user_id, unnest(list_transform(range(6), lambda i: (epoch_us(ts) // 10000000 - i) * 10000000)) AS us FROM events)
SELECT user_id, make_timestamp(us) AS start, count(*) AS requests FROM w WHERE us + 60000000 <= {_mark(120)} GROUP BY 1, 2""")
def _(spark, d):
    out = drained(spark, S.sliding_requests(event_stream(spark, d)), "append")
    return out.select("user_id", F.col("window.start").alias("start"), "requests")


_min = f"(SELECT user_id, count(*) AS minute_requests FROM events WHERE ts > TIMESTAMP '{UP.AS_OF}' - INTERVAL 60 SECOND AND ts <= TIMESTAMP '{UP.AS_OF}' GROUP BY 1)"


@query("str4_admission", f"""WITH k AS (SELECT k.*, coalesce(minute_requests, 0) AS m, coalesce(requests, 0) AS r, coalesce(tokens, 0) AS t FROM {UP.KEYS} k LEFT JOIN {_min} USING (user_id) LEFT JOIN {UP._month} USING (user_id))
SELECT user_id, CASE WHEN NOT is_active THEN 'inactive' WHEN expires_at < TIMESTAMP '{UP.AS_OF}' THEN 'expired' WHEN m >= rate_limit THEN 'rate_limited' WHEN r >= monthly_quota THEN 'request_quota' WHEN t >= monthly_token_quota THEN 'token_quota' ELSE 'ok' END AS verdict,
 greatest(0, rate_limit - m - 1) AS minute_left, greatest(0, monthly_quota - r) AS requests_left, greatest(0, monthly_token_quota - t) AS tokens_left FROM k""")
def _(spark, d):
    e = events(spark, d)
    recent = e.filter((F.col("ts") > UP.as_of() - F.expr("interval 60 seconds")) & (F.col("ts") <= UP.as_of())).groupBy("user_id").agg(F.count("*").alias("minute_requests"))
    month = U.monthly_usage(UP.calls(spark, d), ["user_id"], UP.as_of()).select("user_id", "requests", "tokens")
    return S.admission(UP.keys(spark, d), recent, month, "user_id", UP.as_of())


_TASK = {"view": "pending", "click": "running", "error": "failed", "purchase": "completed", "signup": "retrying"}
_st = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TASK.items()) + " END"
_ok = " OR ".join(f"(before = '{k}' AND status IN ({', '.join(repr(v) for v in vs)}))" for k, vs in S.TASK_MOVES.items() if vs)


def statuses(spark, d):
    names = F.create_map(*[F.lit(x) for kv in _TASK.items() for x in kv])
    return events(spark, d).select("user_id", "event_id", "ts", F.element_at(names, F.col("event_type")).alias("status"))


@query("str5_bad_moves", f"""WITH h AS (SELECT user_id, event_id, {_st} AS status, lag({_st}) OVER w AS before, sum(({_st} = 'retrying')::INT) OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
p AS (SELECT *, CASE WHEN before IN ('completed', 'cancelled') THEN 'terminal' WHEN NOT ({_ok}) THEN 'forbidden' WHEN status = 'retrying' AND r > 3 THEN 'too_many_retries' END AS problem FROM h WHERE before IS NOT NULL)
SELECT user_id, event_id, before, status, problem FROM p WHERE problem IS NOT NULL""")
def _(spark, d):
    return S.bad_moves(statuses(spark, d), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "before", "status", "problem")


_IDLE = 6 * 3600
REPORTS_SQL = f"""WITH h AS (SELECT user_id, event_id, epoch_us(ts) AS us, {_st} AS status FROM events),
b AS (SELECT * FROM h WHERE us < {_mark(600)}),
m AS (SELECT user_id, event_id, status, lag(status) OVER w AS before, sum((status = 'retrying')::INT) OVER w AS r FROM b WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
q AS (SELECT *, lead(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS later FROM h)
SELECT * FROM (SELECT user_id, event_id, status, CASE WHEN before IN ('completed', 'cancelled') THEN 'terminal' WHEN NOT ({_ok}) THEN 'forbidden' WHEN status = 'retrying' AND r > 3 THEN 'too_many_retries' END AS report FROM m WHERE before IS NOT NULL) WHERE report IS NOT NULL
UNION ALL SELECT user_id, event_id, status, 'silent' FROM q WHERE status IN ('pending', 'running', 'retrying') AND us + {_IDLE}::BIGINT * 1000000 < {_mark(600)} AND (later IS NULL OR later >= us + {_IDLE}::BIGINT * 1000000)"""


@query("str5_job_machine", REPORTS_SQL)
def _(spark, d):
    """STR-5 and STR-7 as a stream: forbidden moves and silent jobs, each from its job's machine."""
    names = F.create_map(*[F.lit(x) for kv in _TASK.items() for x in kv])
    stream = event_stream(spark, d).select("user_id", "event_id", "ts", F.element_at(names, F.col("event_type")).alias("status"))
    return drained(spark, S.job_machine(stream, "user_id", _IDLE), "append")


@query("str7_job_reports", REPORTS_SQL)
def _(spark, d):
    h = statuses(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    last = h.agg(F.floor(F.max(F.unix_micros("ts")) / 1000).alias("ms")).first()["ms"]
    return S.job_reports(h, "user_id", _IDLE, F.timestamp_millis(F.lit(int(last) - 600_000)))


_RUN = {"view": "queued", "click": "searching", "error": "failed", "purchase": "completed", "signup": "Quality_Check"}
_pr = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {S.RUN_PROGRESS[v.lower()]}" for k, v in _RUN.items()) + " END"


@query("str6_progress", f"SELECT event_id, {_pr} AS progress, CAST(40 + floor(20 * (count(*) FILTER (event_type = 'purchase') OVER w) / greatest(count(*) OVER w, 1)) AS INTEGER) AS share FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def _(spark, d):
    from pyspark.sql import Window
    names = F.create_map(*[F.lit(x) for kv in _RUN.items() for x in kv])
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    done, total = F.sum((F.col("event_type") == "purchase").cast("int")).over(w), F.count(F.lit(1)).over(w)
    return events(spark, d).select("event_id", S.progress(F.element_at(names, F.col("event_type"))).alias("progress"), S.task_share(done, total).alias("share"))


@query("str7_interrupted", f"""WITH l AS (SELECT user_id, arg_max({_st}, (ts, event_id)) AS status, max(ts) AS last_ts FROM events GROUP BY 1)
SELECT user_id, status FROM l WHERE status IN ('pending', 'running', 'retrying') AND last_ts <= TIMESTAMP '2024-01-30 12:00:00' AND user_id % 10 <> 0""")
def _(spark, d):
    h = statuses(spark, d)
    rows = S.interrupted(h, "user_id", F.struct("ts", "event_id"), ["pending", "running", "retrying"], h.filter("user_id % 10 = 0"), F.lit("2024-01-30 13:00:00").cast("timestamp"), 3600)
    return rows.select("user_id", "status")


@query("str10_first_seen", "SELECT DISTINCT user_id, event_type FROM events")
def _(spark, d):
    """All events lie within the delay, so each pair is seen once; which of its events comes first is the stream's order."""
    return drained(spark, S.first_seen(event_stream(spark, d), ["user_id", "event_type"], "40 days").select("user_id", "event_type"), "append")


@query("str11_driven_metrics", f"""SELECT date_trunc('minute', ts) AS minute, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors, round(avg(value), 6) AS mean_value FROM events
WHERE epoch_us(date_trunc('minute', ts)) + 60000000 <= {_mark(120)} GROUP BY 1""")
def _(spark, d):
    """The same plan as a stream: minutes that the watermark has closed."""
    return drained(spark, S.tumbling_metrics(event_stream(spark, d)), "append").withColumn("mean_value", F.round("mean_value", 6))


@query("str11_tumbling_metrics", "SELECT date_trunc('minute', ts) AS minute, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors, round(avg(value), 6) AS mean_value FROM events GROUP BY 1")
def _(spark, d):
    rows = S.tumbling_metrics(events(spark, d).withColumn("ts", F.col("ts").cast("timestamp")))
    return rows.withColumn("mean_value", F.round("mean_value", 6))
