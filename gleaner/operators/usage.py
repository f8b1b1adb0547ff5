"""Usage, cost, metric and work-list aggregates over operational tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values
BUCKETS = (5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0, 2500.0, 5000.0)
COST_PER_1000_TOKENS = 0.002
SCORE_WEIGHTS = {"factual": 0.25, "citation": 0.15, "completeness": 0.15, "research": 0.20, "source": 0.10, "reasoning": 0.15}
REASONING_MARKERS = ("##", "**", "- ", "1.", "2.", "3.", "therefore", "because", "however")
CITATION_MARKERS = ("[[", "[source", "[ref", "(source", "http://", "https://")
ROLE_PERMISSIONS = {
    "admin": ("org:manage", "org:members:manage", "org:teams:manage", "research:create", "research:read", "research:delete",
              "research:compare", "reports:export"),
    "researcher": ("org:teams:manage", "research:create", "research:read", "research:compare", "reports:export"),
    "analyst": ("research:read", "research:compare", "reports:export"),
    "viewer": ("research:read",),
}
MODEL_COLUMNS = ("model_id", "tier", "input_cost", "output_cost", "latency_ms")
MODELS = (
    ("gpt-4o-mini", "cheap", 0.15, 0.60, 450.0), ("gemini-1.5-flash", "cheap", 0.075, 0.30, 380.0), ("claude-3-haiku", "cheap", 0.25, 1.25, 400.0),
    ("o3-mini", "reasoning", 1.10, 4.40, 2500.0), ("deepseek-r1", "reasoning", 0.55, 2.19, 2800.0), ("o1", "reasoning", 15.0, 60.0, 4500.0),
    ("gpt-4o", "powerful", 2.50, 10.00, 1200.0), ("claude-3-5-sonnet", "powerful", 3.00, 15.00, 1400.0), ("gemini-1.5-pro", "powerful", 1.25, 5.00, 1300.0),
)


def status_counts(tasks: DataFrame, statuses: list[str], status: str = "status", keys: list[str] | None = None, done: str = "completed") -> DataFrame:
    """One count per known status (zeros kept), total and completion rate."""
    counts = [F.count_if(F.col(status) == s).alias(s) for s in statuses]
    rows = tasks.groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("total"), *counts)
    return rows.withColumn("completion_rate", F.when(F.col("total") > 0, F.col(done) / F.col("total")).otherwise(0.0))


def token_cost(tokens: Column, cost: Column | None = None) -> Column:
    default = F.round(tokens / 1000.0 * COST_PER_1000_TOKENS, 6)
    return default if cost is None else F.coalesce(cost, default)


def monthly_usage(calls: DataFrame, keys: list[str], as_of: Column, ts: str = "ts") -> DataFrame:
    """Requests, tokens and cost per key since the month of ``as_of`` began."""
    month = calls.filter((F.col(ts) >= F.date_trunc("month", as_of)) & (F.col(ts) <= as_of))
    return month.groupBy(*keys).agg(F.count(F.lit(1)).alias("requests"), F.sum("tokens").cast("bigint").alias("tokens"), F.sum("cost").alias("cost"))


def remaining_quota(usage: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    rows = keys.join(usage, key, "left").fillna(0, ["requests", "tokens"])
    return rows.select(key, F.greatest(F.lit(0), F.col("monthly_quota") - F.col("requests")).alias("requests_left"),
                       F.greatest(F.lit(0), F.col("monthly_token_quota") - F.col("tokens")).alias("tokens_left"))


def cost_rollup(calls: DataFrame, label: str) -> DataFrame:
    """Calls, tokens, cost and error rate per label and in total (label null)."""
    return calls.rollup(label).agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").cast("bigint").alias("tokens"), F.sum("cost").alias("cost"),
                                   F.avg(F.col("is_error").cast("double")).alias("error_rate"))


def labelled_counter(events: DataFrame, labels: list[str]) -> DataFrame:
    """Total (labels null) and one row per label combination."""
    return events.groupingSets([[F.col(c) for c in labels], []], *[F.col(c) for c in labels]).agg(F.count(F.lit(1)).alias("value"))


def bucket_of(value: Column, bounds=BUCKETS) -> Column:
    out = F.lit(float("inf"))
    for bound in reversed(bounds):
        out = F.when(value <= bound, F.lit(bound)).otherwise(out)
    return out


def histogram(events: DataFrame, keys: list[str], value: str, bounds=BUCKETS) -> DataFrame:
    """Count, sum, mean and bucket-bound percentiles.  Only bucket counts leave the first aggregate."""
    buckets = events.groupBy(*keys, bucket_of(F.col(value), bounds).alias("le")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"))
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("le").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy(*keys))
    rows = buckets.withColumn("upto", upto).withColumn("total", total)
    quantiles = [F.min(F.when(F.col("upto") >= F.col("total") * q, F.col("le"))).alias(name) for name, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))]
    return rows.groupBy(*keys).agg(F.sum("n").alias("count"), F.sum("s").alias("sum"), (F.sum("s") / F.sum("n")).alias("mean"), *quantiles)


def last_value(events: DataFrame, keys: list[str], value: str, order: str, tie: str) -> DataFrame:
    return events.groupBy(*keys).agg(F.max_by(value, F.struct(order, tie)).alias("value"))


def exposition_lines(metrics: DataFrame, name: str, label: str, value: str = "value") -> DataFrame:
    """One text line per label value in the usual metrics exposition format."""
    return metrics.select(F.format_string(f'{name}{{{label}="%s"}} %s', F.col(label), F.col(value).cast("string")).alias("line"))


def minute_rates(events: DataFrame, keys: list[str], value: str, ts: str = "ts") -> DataFrame:
    window = F.window(ts, "1 minute")
    rows = events.groupBy(*keys, window.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value"))
    return rows.select(*keys, F.col("w.start").alias("minute"), (F.col("n") / 60.0).alias("per_second"), "mean_value")


# --- answer scores -------------------------------------------------------------------------------------------------------
def answer_scores(answer: Column, keywords: Column, domains: Column) -> dict[str, Column]:
    """The six scores of one answer."""
    low = F.lower(answer)
    share = lambda xs, ok: F.round(F.size(F.filter(xs, ok)) / F.size(xs), 4)
    hit = lambda k: low.contains(F.lower(k))
    factual = F.when(F.size(keywords) == 0, 1.0).otherwise(share(keywords, hit))
    near = lambda k: hit(k) & F.substring(low, F.position(F.lower(k), low), F.lit(200)).rlike(r"\[|\(source|http")
    any_marker = reduce(lambda a, b: a | b, [low.contains(m) for m in CITATION_MARKERS])
    marks = reduce(lambda a, b: a + b, [low.contains(m).cast("int") for m in REASONING_MARKERS])
    return {
        "factual": factual, "citation": F.when(F.trim(answer) == "", 0.0).when(any_marker, 1.0).otherwise(0.5),
        "completeness": F.when(F.size(keywords) == 0, 0.0).otherwise(share(keywords, near)), "research": factual,
        "source": F.when(F.size(domains) == 0, 0.7).otherwise(share(domains, hit)),
        "reasoning": F.when(F.length(answer) < 100, 0.0).otherwise(F.least(F.lit(1.0), F.round(marks / 5, 4))),
    }


def overall_score(scores: dict[str, Column] | None = None) -> Column:
    parts = scores or {k: F.col(k) for k in SCORE_WEIGHTS}
    return reduce(lambda a, b: a + b, [parts[k] * w for k, w in SCORE_WEIGHTS.items()])


def score_report(results: DataFrame, dimensions: list[str], keys: list[str] | None = None, order: str = "result_id") -> DataFrame:
    """Mean, exact order statistics, extremes per dimension over results without an error.

    Results are counted by distinct score first; only the few distinct scores of a dimension are put in order."""
    keys = keys or []
    stack = ", ".join(f"'{d}', {d}" for d in dimensions)
    long = results.filter("not failed").selectExpr(*keys, order, f"stack({len(dimensions)}, {stack}) as (dimension, score)")
    part = Window.partitionBy(*keys, "dimension")
    counted = long.groupBy(*keys, "dimension", "score").agg(F.count(F.lit(1)).alias("_k"))
    ranked = counted.withColumn("_upto", F.sum("_k").over(part.orderBy("score"))).withColumn("_n", F.sum("_k").over(part))
    at = lambda i: F.min(F.when(F.col("_upto") > i, F.col("score")))
    return ranked.groupBy(*keys, "dimension").agg(
        F.sum("_k").alias("n"), (F.sum(F.col("score") * F.col("_k")) / F.sum("_k")).alias("mean"), at(F.floor(F.col("_n") * 0.5)).alias("p50"),
        at(F.least(F.floor(F.col("_n") * 0.95), F.col("_n") - 1)).alias("p95"), F.min("score").alias("low"), F.max("score").alias("high"))


def pass_rate(results: DataFrame, keys: list[str], threshold: float = 0.7) -> DataFrame:
    good = results.filter("not failed").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("overall") >= threshold).cast("double")).alias("pass_rate"))
    return good


# --- runs, spans, lists -----------------------------------------------------------------------------------------------------
def executor_telemetry(tasks: DataFrame, keys: list[str]) -> DataFrame:
    """Task counts, summed and wall time, speed-up."""
    wall = F.max("ended") - F.min("started")
    return tasks.groupBy(*keys).agg(F.count(F.lit(1)).alias("tasks"), F.count_if(F.col("status") == "failed").alias("failed"),
                                    F.sum(F.col("ended") - F.col("started")).alias("busy"), wall.alias("wall")).withColumn(
        "speed_up", F.when(F.col("wall") > 0, F.col("busy") / F.col("wall")).otherwise(1.0))


def agent_summary(runs: DataFrame, key: str) -> DataFrame:
    failed = F.array_sort(F.collect_set(F.when(F.col("status") == "failed", F.col("agent"))))
    return runs.groupBy(key).agg(F.count(F.lit(1)).alias("runs"), F.sum("duration_ms").alias("total_ms"), failed.alias("failed_agents"))


def span_tree(spans: DataFrame) -> DataFrame:
    """(span_id, depth, root, path, duration, subtree): each round hangs one more level under the known spans.

    spans: span_id, parent_id, name, started, ended.  Only spans with children are walked, down for the paths and up again
    for the sums, each level from the one beside it; all others, most of a tree, are hung under them in one join.  Lineage
    is cut per level, and rounds end when a level is empty.  A span whose parent is unknown is a root; spans that hang on a
    cycle have no root and come last, each for itself, at depth -1.
    """
    from gleaner.session import cut_lineage

    def plus(a: Column, b: Column) -> Column:
        return F.coalesce(a + b, a, b)

    def under(rows: DataFrame, value: str) -> DataFrame:
        return rows.filter("parent_id is not null").groupBy(F.col("parent_id").alias("span_id")).agg(F.sum(value).alias("_u"))

    columns = ["span_id", "depth", "root", "path", "duration", "subtree"]
    base = cut_lineage(spans.select("span_id", "parent_id", "name", (F.col("ended") - F.col("started")).alias("duration")))
    parents = base.select(F.col("parent_id").alias("span_id")).distinct()
    ends = base.join(parents, "span_id", "left_anti")
    inner = base.join(parents, "span_id", "left_semi").join(under(ends, "duration"), "span_id", "left")
    inner = cut_lineage(inner.withColumn("own", plus(F.col("duration"), F.col("_u"))).drop("_u"))
    level = cut_lineage(inner.join(inner.select(F.col("span_id").alias("parent_id")), "parent_id", "left_anti").select(
        "span_id", "parent_id", F.lit(0).alias("depth"), F.col("span_id").alias("root"), F.col("name").alias("path"), "duration", "own"))
    levels = []
    while not level.isEmpty():
        levels.append(level)
        up = level.select(F.col("span_id").alias("parent_id"), "root", F.col("path").alias("_p"))
        level = cut_lineage(inner.join(up, "parent_id").select(
            "span_id", "parent_id", F.lit(len(levels)).alias("depth"), "root", F.concat_ws("/", "_p", "name").alias("path"), "duration", "own"))
    known, below = level.select(*columns[:-1], F.col("own").alias("subtree")), None
    for level in reversed(levels):
        summed = level.withColumn("subtree", F.col("own")) if below is None else cut_lineage(
            level.join(below, "span_id", "left").withColumn("subtree", plus(F.col("own"), F.col("_u"))))
        known, below = known.unionByName(summed.select(*columns)), under(summed, "subtree")
    lost = inner.join(known.select("span_id"), "span_id", "left_anti")
    nowhere = F.lit(None).cast(base.schema["span_id"].dataType)
    known = known.unionByName(lost.select("span_id", F.lit(-1).alias("depth"), nowhere.alias("root"), F.col("name").alias("path"), "duration", F.col("duration").alias("subtree")))
    hung = ends.join(known.select(F.col("span_id").alias("parent_id"), F.col("depth").alias("_d"), F.col("root").alias("_r"), F.col("path").alias("_p")), "parent_id", "left")
    found = F.col("_d") >= 0
    return known.unionByName(hung.select(
        "span_id", F.when(found, F.col("_d") + 1).otherwise(F.coalesce("_d", F.lit(0))).alias("depth"), F.when(F.col("_d").isNull(), F.col("span_id")).otherwise(F.col("_r")).alias("root"),
        F.when(found, F.concat_ws("/", "_p", "name")).otherwise(F.col("name")).alias("path"), "duration", F.col("duration").alias("subtree")))


def latest_per(df: DataFrame, key: str, order: list[Column], n: int = 1) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= n)


def page(df: DataFrame, order: list[Column], limit: int, skip: int = 0) -> tuple[DataFrame, DataFrame]:
    """(rows, total): a sorted page and the full count."""
    return df.orderBy(*order).offset(skip).limit(limit), df.agg(F.count(F.lit(1)).alias("total"))


def unread(notices: DataFrame, user: str, order: list[Column], n: int) -> DataFrame:
    return latest_per(notices.filter("not is_read"), user, order, n)


def mark_all_read(notices: DataFrame, users: DataFrame, user: str) -> DataFrame:
    hit = users.select(user).distinct().withColumn("_hit", F.lit(True))
    return notices.join(hit, user, "left").withColumn("is_read", F.col("is_read") | F.coalesce("_hit", F.lit(False))).drop("_hit")


def merge_conversations(messages: DataFrame, key: str, order: str) -> DataFrame:
    """Message count, last message, distinct run ids in first-seen order."""
    seen = messages.groupBy(key, "run_id").agg(F.min(order).alias("_o")).groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_o", "run_id"))), lambda s: s["run_id"]).alias("run_ids"))
    return messages.groupBy(key).agg(F.count(F.lit(1)).alias("messages"), F.max(order).alias("updated_at")).join(seen, key)


def permissions() -> Column:
    """Role → permissions, a fixed map."""
    return F.create_map(*[x for role, ps in ROLE_PERMISSIONS.items() for x in (F.lit(role), F.array(*[F.lit(p) for p in ps]))])


def has_permission(role: Column, permission: str) -> Column:
    return F.coalesce(F.array_contains(F.try_element_at(permissions(), F.lower(role)), permission), F.lit(False))


def cheapest_model(requests: DataFrame, key: str, input_tokens: Column, output_tokens: Column, preferred: tuple[str, ...] = ("cheap", "standard", "powerful", "reasoning")) -> DataFrame:
    """(key, model_id, cost, fallbacks): cost-minimising score over the fixed model list, next three as fallbacks.

    The models are a literal array in the row, so scoring is a projection without a join.
    """
    models = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(MODEL_COLUMNS, row)]) for row in MODELS])

    def scored(m: Column) -> Column:
        cost = input_tokens / 1e6 * m["input_cost"] + output_tokens / 1e6 * m["output_cost"]
        rank = F.array_position(F.array(*[F.lit(p) for p in preferred]), m["tier"])
        score = F.lit(100.0) - F.when(rank > 0, (rank - 1) * 25.0).otherwise(50.0) - cost * 5000.0 + F.when(m["tier"] == "cheap", 40.0).otherwise(0.0)
        return F.struct((-score).alias("s"), m["model_id"].alias("model_id"), cost.alias("cost"))

    ranked = F.array_sort(F.transform(models, scored))
    return requests.select(key, ranked.alias("r")).select(key, F.get("r", F.lit(0))["model_id"].alias("model_id"), F.get("r", F.lit(0))["cost"].alias("cost"),
                                                          F.transform(F.slice("r", 2, 3), lambda x: x["model_id"]).alias("fallbacks"))


def fetch_class(status: Column) -> Column:
    return (F.when(status == 200, "ok").when(status == 403, "forbidden").when(status == 404, "not_found").when(status == 408, "timeout")
            .when(status == 429, "rate_limited").when(status == 502, "connect").when(status.isin(500, 503, 504), "server_error").otherwise("other"))


def is_pdf(content_type: Column, url: Column) -> Column:
    return F.lower(content_type).contains("application/pdf") | F.lower(F.substring_index(url, "?", 1)).endswith(".pdf")


def fetch_outcomes(log: DataFrame) -> DataFrame:
    """Counts per domain and class with totals."""
    rows = log.select("domain", fetch_class(F.col("status")).alias("class"), is_pdf(F.col("content_type"), F.col("url")).alias("pdf"))
    return rows.rollup("domain", "class").agg(F.count(F.lit(1)).alias("fetches"), F.count_if("pdf").alias("pdfs"))


def fan_out(events: DataFrame, targets: DataFrame, user: str, kind: str) -> DataFrame:
    """Events × enabled targets of their user whose type list is empty or names the event's type."""
    wanted = targets.filter("enabled").select(user, "target_id", "types")
    joined = events.join(wanted, user)
    return joined.filter((F.size("types") == 0) | F.array_contains(F.col("types"), F.col(kind))).drop("types")
