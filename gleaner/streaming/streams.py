"""Structured Streaming operators and their batch forms over an event table (event_id, ts, user_id, event_type, value)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: allowed moves of a task, progress of a run's states
TASK_MOVES = {"pending": ("running", "cancelled"), "running": ("completed", "failed", "cancelled"), "failed": ("retrying", "cancelled"),
              "retrying": ("running", "cancelled"), "completed": (), "cancelled": ()}
RUN_PROGRESS = {"queued": 0, "planning": 15, "searching": 30, "collecting": 45, "analyzing": 60, "verifying": 75, "synthesizing": 85,
                "report_generation": 92, "quality_check": 98, "completed": 100, "failed": 0, "retry": 5, "cancelled": 0}


def read_events(spark, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


# --- event log and windows ---------------------------------------------------------------------------------------------------
def job_log(events: DataFrame, job: str = "user_id", since: Column | None = None) -> DataFrame:
    """Append-only log of every job, optionally from a moment on."""
    rows = events if since is None else events.filter(F.col("ts") >= since)
    return rows.select(F.col(job).alias("job_id"), "event_id", "ts", "event_type")


def recent_requests(events: DataFrame, key: str = "user_id", seconds: int = 60) -> DataFrame:
    """Batch: requests of the same key in the last ``seconds``, this one included."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    window = Window.partitionBy(key).orderBy(at).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return events.select("event_id", key, F.count(F.lit(1)).over(window).alias("in_last_minute"))


def sliding_requests(events: DataFrame, key: str = "user_id", late: str = "2 minutes") -> DataFrame:
    """Stream: requests per key and sliding minute."""
    return events.withWatermark("ts", late).groupBy(key, F.window("ts", "1 minute", "10 seconds")).agg(F.count(F.lit(1)).alias("requests"))


def tumbling_metrics(events: DataFrame, late: str = "2 minutes") -> DataFrame:
    """Events, errors and mean value per minute; the same plan serves batch and stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", "1 minute").alias("w")).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_type") == "error").alias("errors"), F.avg("value").alias("mean_value"))
    return out.select(F.col("w.start").alias("minute"), "events", "errors", "mean_value")


def first_seen(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Stream: the first event of every key; state leaves with the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


# --- status machines -------------------------------------------------------------------------------------------------------------
def move_allowed(before: Column, after: Column, moves=TASK_MOVES) -> Column:
    table = F.create_map(*[x for k, vs in moves.items() for x in (F.lit(k), F.array(*[F.lit(v) for v in vs]).cast("array<string>"))])
    return F.coalesce(F.array_contains(F.try_element_at(table, before), after), F.lit(False))


def bad_moves(history: DataFrame, key: str, order: list[str], status: str = "status", max_retries: int = 3) -> DataFrame:
    """Moves the task table forbids, moves out of a terminal state, and retries beyond the limit."""
    window = Window.partitionBy(key).orderBy(*order)
    retries = F.sum((F.col(status) == "retrying").cast("int")).over(window.rowsBetween(Window.unboundedPreceding, 0))
    rows = history.withColumn("before", F.lag(status).over(window)).withColumn("retries", retries)
    problem = (F.when(F.col("before").isin("completed", "cancelled"), "terminal").when(~move_allowed(F.col("before"), F.col(status)), "forbidden")
               .when((F.col(status) == "retrying") & (F.col("retries") > max_retries), "too_many_retries"))
    return rows.filter("before is not null").withColumn("problem", problem).filter("problem is not null")


IN_FLIGHT = ("pending", "running", "retrying")


def job_reports(history: DataFrame, key: str, idle_seconds: int, until: Column, max_retries: int = 3) -> DataFrame:
    """Batch: (key, event_id, status, report) of all rows before ``until``: moves as in ``bad_moves``, and ``silent`` for a state
    in flight that nothing follows for ``idle_seconds``, if that time was over before ``until``."""
    moves = bad_moves(history.filter(F.col("ts") < until), key, ["ts", "event_id"], max_retries=max_retries).select(key, "event_id", "status", F.col("problem").alias("report"))
    following = F.lead("ts").over(Window.partitionBy(key).orderBy("ts", "event_id"))
    idle = F.make_dt_interval(secs=F.lit(idle_seconds))
    quiet = history.withColumn("_n", following).filter(F.col("status").isin(*IN_FLIGHT) & (F.col("ts") + idle < until) & (F.col("_n").isNull() | (F.col("_n") >= F.col("ts") + idle)))
    return moves.unionByName(quiet.select(key, "event_id", "status", F.lit("silent").alias("report")))


def job_machine(events: DataFrame, key: str, idle_seconds: int, late: str = "10 minutes", max_retries: int = 3) -> DataFrame:
    """Stream: the rows of ``job_reports``, each as soon as the watermark proves it.

    A machine a job holds its status, its retries, the time of its last event and the events the watermark has not passed.
    Events leave that buffer in order of (ts, event_id), so the reports do not depend on how rows arrive in micro-batches;
    rows behind the watermark are late and do not count.  A timer is set to the first buffered event or to the end of the
    allowed silence, whichever is first, so a job that sends nothing more is reported too."""
    name, kind = key, events.schema[key].dataType.simpleString()
    idle, moves = idle_seconds * 1_000_000, {k: set(v) for k, v in TASK_MOVES.items()}

    def run(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, last_id, last, retries, told, times, ids, names = state.get if state.exists else (None, None, 0, 0, True, [], [], [])
        waiting = list(zip(times, ids, names))
        for batch in batches:
            waiting += zip((batch["us"].to_numpy()).tolist(), batch["event_id"].tolist(), batch["status"].tolist())
        mark = state.getCurrentWatermarkMs() * 1000
        out = []

        def silence(upto: int, strict: bool) -> None:
            nonlocal told
            if not told and (last + idle < upto or not strict and last + idle == upto):
                out.append((group[0], last_id, status, "silent"))
                told = True

        waiting.sort()
        ready = [w for w in waiting if w[0] < mark]
        for at, number, new in ready:
            silence(at, False)
            retries += new == "retrying"
            if status is not None:
                report = "terminal" if status in ("completed", "cancelled") else "forbidden" if new not in moves.get(status, ()) else "too_many_retries" if new == "retrying" and retries > max_retries else None
                if report:
                    out.append((group[0], number, new, report))
            status, last_id, last, told = new, number, at, new not in IN_FLIGHT
        silence(mark, True)
        waiting = waiting[len(ready) :]
        state.update((status, last_id, last, retries, told, *([list(c) for c in zip(*waiting)] if waiting else ([], [], []))))
        due = [w[0] for w in waiting[:1]] + ([] if told else [last + idle])
        if due:
            state.setTimeoutTimestamp(max(min(due) // 1000, state.getCurrentWatermarkMs() + 1, 1))
        yield pd.DataFrame(out, columns=[name, "event_id", "status", "report"])

    rows = events.withWatermark("ts", late).select(key, "event_id", "ts", "status", F.unix_micros("ts").alias("us"))
    held = "status string, last_id long, last long, retries int, told boolean, times array<long>, ids array<long>, names array<string>"
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, event_id long, status string, report string", held, "append", "EventTimeTimeout")


def progress(status: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in RUN_PROGRESS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(status)), F.lit(0))


def task_share(done: Column, total: Column) -> Column:
    return F.lit(40) + F.floor(F.lit(20) * done / F.greatest(total, F.lit(1))).cast("int")


def interrupted(history: DataFrame, key: str, order: Column, in_flight: list[str], active: DataFrame, as_of: Column, idle_seconds: int) -> DataFrame:
    """Jobs whose last state is in flight, that are not active and have been silent for a while."""
    last = history.groupBy(key).agg(F.max_by("status", order).alias("status"), F.max("ts").alias("last_ts"))
    silent = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("last_ts").cast("timestamp")) >= idle_seconds * 1_000_000
    return last.filter(F.col("status").isin(*in_flight) & silent).join(active.select(key).distinct(), key, "left_anti")


def admission(keys: DataFrame, minute: DataFrame, month: DataFrame, key: str, as_of: Column) -> DataFrame:
    """First rule that refuses a key, else ok, with what is left of its limits."""
    rows = keys.join(minute, key, "left").join(month, key, "left").fillna(0, ["minute_requests", "requests", "tokens"])
    verdict = (F.when(~F.col("is_active"), "inactive").when(F.col("expires_at") < as_of, "expired").when(F.col("minute_requests") >= F.col("rate_limit"), "rate_limited")
               .when(F.col("requests") >= F.col("monthly_quota"), "request_quota").when(F.col("tokens") >= F.col("monthly_token_quota"), "token_quota").otherwise("ok"))
    left = lambda cap, used: F.greatest(F.lit(0), F.col(cap) - F.col(used))
    return rows.select(key, verdict.alias("verdict"), F.greatest(F.lit(0), F.col("rate_limit") - F.col("minute_requests") - 1).alias("minute_left"),
                       left("monthly_quota", "requests").alias("requests_left"), left("monthly_token_quota", "tokens").alias("tokens_left"))
