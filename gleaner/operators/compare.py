"""Comparing runs, change reports and schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators.evidence import leading

# fixed values
CHANGE_TERMS = (
    ("company", ("company", "corporation", "inc.", "corp.", "ltd", "startup", "manufacturer")),
    ("regulation", ("regulation", "law", "legislation", "policy", "directive", "compliance", "rule")),
    ("risk", ("risk", "threat", "challenge", "uncertainty", "barrier")),
    ("opportunity", ("opportunity", "growth", "potential", "investment", "upside")),
    ("market", ("market", "estimate", "cagr", "valuation", "billion", "million", "$", "%")),
)
ESTIMATE_PATTERN = r"(?i)(?:[$€£]\s?\d[\d,.]*\s?(?:m|b|million|billion)?|\d[\d,.]*\s?%)"


def value_key(c: Column) -> Column:
    return T.strip(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " "))


def difference(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, change, key, value): values added and removed, compared without case and punctuation."""
    def side(df: DataFrame) -> DataFrame:
        return df.groupBy(*keys, value_key(F.col(value)).alias("key")).agg(F.max(value).alias(value))

    a, b = side(before), side(after)
    added = b.join(a.select(*keys, "key"), [*keys, "key"], "left_anti").withColumn("change", F.lit("added"))
    removed = a.join(b.select(*keys, "key"), [*keys, "key"], "left_anti").withColumn("change", F.lit("removed"))
    return added.unionByName(removed)


def change_classes(c: Column, terms=CHANGE_TERMS) -> Column:
    low = F.lower(c)
    return F.filter(F.array(*[F.when(T.contains_any(low, words), F.lit(name)) for name, words in terms]), lambda x: x.isNotNull())


def classified(added: DataFrame, value: str) -> DataFrame:
    return added.withColumn("class", F.explode(change_classes(F.col(value))))


def merged_new(list_added: DataFrame, claims_added: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """New risks or opportunities: the list difference and the class matches among added claims, distinct."""
    matched = classified(claims_added, value).filter(F.col("class") == name).select(*keys, value)
    both = list_added.select(*keys, value).unionByName(matched).select(*keys, T.strip(F.col(value)).alias(value))
    return both.filter(F.col(value) != "").distinct()


def changed_estimate(before: Column, after: Column) -> Column:
    """'numbers' when the new estimate differs and has figures, 'classes' when it only differs, else null."""
    differs = (F.coalesce(after, F.lit("")) != "") & (F.coalesce(before, F.lit("")) != F.coalesce(after, F.lit("")))
    return F.when(differs & after.rlike(ESTIMATE_PATTERN), "numbers").when(differs, "classes")


def change_reports(runs: DataFrame, schedule: str, order: str, baseline: int | None = None, unchanged: int | None = None) -> DataFrame:
    """Every run against the previous one of its schedule: new findings (all of them for a first run and where none is
    new; the first ``baseline`` or ``unchanged`` ones if these are given), deltas, baseline flag."""
    window = Window.partitionBy(schedule).orderBy(order)
    before = F.lag("findings").over(window)
    rows = runs.withColumn("_before", before).withColumn("_ps", F.lag("sources").over(window)).withColumn("_pc", F.lag("confidence").over(window))
    fresh = F.filter("findings", lambda x: ~F.array_contains(F.col("_before"), x))
    new = (F.when(F.col("_before").isNull(), leading(F.col("findings"), baseline)).when(F.size(fresh) == 0, leading(F.col("findings"), unchanged)).otherwise(fresh))
    return rows.select(schedule, order, F.col("_before").isNull().alias("baseline"), new.alias("new_findings"),
                       (F.col("sources") - F.coalesce("_ps", F.lit(0))).alias("source_delta"), (F.col("confidence") - F.coalesce("_pc", F.lit(0.0))).alias("confidence_delta"))


def due(schedules: DataFrame, as_of: Column) -> DataFrame:
    return schedules.filter("is_active").filter(F.col("next_run_at").isNull() | (F.col("next_run_at") <= as_of))


def next_run(base: Column, frequency: Column, day: Column) -> Column:
    """Daily +1 day, monthly +30 days, else the named weekday strictly after; the time of day stays."""
    names = F.array(*[F.lit(x) for x in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")])
    target = F.coalesce(F.nullif(F.array_position(names, F.lower(day)), F.lit(0)), F.lit(1)) - 1
    ahead = (target - F.weekday(base) + 6) % 7 + 1
    days = F.when(F.lower(frequency) == "daily", 1).when(F.lower(frequency) == "monthly", 30).otherwise(ahead)
    return base + F.make_dt_interval(days.cast("int"))
