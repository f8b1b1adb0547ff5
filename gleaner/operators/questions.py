"""Question classification, query expansion and research plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner import lexicons as L
from gleaner.functions import text as T
from gleaner.functions import tokens as K

# fixed values: task templates per category, mode parameters, prompt classes
TASK_TEMPLATES = {
    "web": (("What current, source-backed facts describe {query}?", "{query} current authoritative overview evidence"),
            ("What recent developments or primary-source updates matter for {query}?", "{query} latest developments primary sources")),
    "academic": (("What do published studies and technical literature conclude about {query}?", "{query} peer reviewed research findings"),
                 ("Which methods, benchmarks, or limitations are documented for {query}?", "{query} empirical study benchmark methodology limitations")),
    "market": (("What commercial applications, participants, or adoption evidence is documented for {query}?",
                "{query} commercial applications adoption industry evidence"),
               ("What economic, pricing, or implementation risks are documented for {query}?", "{query} pricing economics implementation risks evidence")),
}
MODE_COLUMNS = ("mode", "min_sources", "max_sources", "depth", "breadth", "max_concurrency", "fact_checking", "verification_passes")
MODES = (("quick", 5, 10, 1, 2, 4, False, 1), ("standard", 15, 30, 2, 3, 6, True, 1), ("deep", 30, 100, 3, 5, 10, True, 2),
         ("expert", 100, 500, 4, 7, 16, True, 3))
DEFAULT_MODE = "standard"
PROMPT_CLASSES = (
    ("fact_checking", ("verify claim", "contradiction", "fact check", "source credibility")),
    ("complex_planning", ("decompose", "sub-questions", "subtasks", "research plan", "break down into tasks", "search strategy",
                          "dependency graph", "multi-hop")),
    ("large_synthesis", ("synthesize", "comprehensive research report", "executive summary", "in-depth report", "academic paper",
                         "full analysis", "draft section", "literature review")),
    ("simple_extraction", ("extract entities", "extract facts", "json object", "parse the following", "identify key terms",
                           "table extraction", "convert to json", "classify")),
)


def _any(c: Column, patterns) -> Column:
    return reduce(lambda a, b: a | b, [c.rlike(p) for p in patterns])


def quick_or_deep(question: Column) -> Column:
    q = F.lower(T.strip(question))
    return (F.when(_any(q, L.QUICK_COMPLEX), "deep").when(_any(q, L.QUICK_SIMPLE), "quick")
            .when(K.word_count(q) <= 12, "quick").otherwise("deep"))


def complexity(question: Column) -> Column:
    q = T.strip(question)
    words, hits = K.word_count(q), T.count_matches(q, "(?i)" + L.PLAN_COMPLEX)
    return (F.when(q.rlike("(?i)" + L.PLAN_SIMPLE) & (words <= 6), "simple").when((hits >= 3) | (words >= 15), "complex")
            .when((hits >= 1) | (words >= 8), "moderate").otherwise("simple"))


def task_count(kind: Column, depth: Column, breadth: Column) -> Column:
    count = (F.when(kind == "simple", F.greatest(F.lit(2), F.least(F.lit(4), breadth)))
             .when(kind == "moderate", F.greatest(F.lit(4), depth * breadth + breadth)).otherwise(F.greatest(F.lit(8), depth * breadth * 2 + breadth)))
    return F.least(F.lit(50), count)


def round_robin(items: DataFrame, run: str, category: str, order: str, target: Column) -> DataFrame:
    """First items of every category in turn (categories by first appearance) until the run's target is reached."""
    rn = F.row_number().over(Window.partitionBy(run, category).orderBy(order))
    first = F.min(order).over(Window.partitionBy(run, category))
    turn = items.withColumn("_rn", rn).withColumn("_first", first)
    rank = F.row_number().over(Window.partitionBy(run).orderBy("_rn", "_first"))
    return turn.withColumn("rank", rank).filter(F.col("rank") <= target).drop("_rn", "_first")


def topic(question: Column) -> Column:
    """Question without closing question mark and leading filler words."""
    bare = T.strip(F.regexp_replace(T.strip(question), r"\?+$", ""))
    stop = "|".join(L.TOPIC_LEADING_STOP)
    cut = T.strip(F.regexp_replace(bare, rf"(?i)^(?:(?:{stop})(?:\s+|$))+", ""))
    flat = F.regexp_replace(cut, r"\s+", " ")
    return F.when(flat == "", T.strip(question)).otherwise(flat)


def template_set(topic_: Column, category: Column) -> Column:
    return (F.when(category.isin("academic", "market"), category).when(topic_.rlike(L.INVESTMENT_TOPIC), "investment").otherwise("general"))


def expand(questions: DataFrame, n: int, year: int, key: str, question: str = "question", category: str = "category") -> DataFrame:
    """(key, rank, query): first n templates of the question's set.  The fixed templates sit in the row as an array."""
    sets = F.create_map(*[x for name, ts in L.QUERY_TEMPLATES.items() for x in (F.lit(name), F.array(*[F.lit(t) for t in ts]))])
    rows = questions.select(key, topic(F.col(question)).alias("_t"), F.col(category).alias("_c"))
    rows = rows.select(key, "_t", F.posexplode(F.slice(F.element_at(sets, template_set(F.col("_t"), F.col("_c"))), 1, n)).alias("_p", "_q"))
    filled = F.replace(F.replace(F.replace(F.col("_q"), F.lit("{topic}"), F.col("_t")), F.lit("{next_year}"), F.lit(str(year + 1))), F.lit("{year}"), F.lit(str(year)))
    return rows.select(key, (F.col("_p") + 1).alias("rank"), filled.alias("query"))


def keep_on_topic(expansions: DataFrame, questions: DataFrame, fill: DataFrame, key: str, n: int) -> DataFrame:
    """(key, rank, query): given expansions that share a topic word, a partial list prefixed with the topic and filled up.

    expansions: key, ord, query; questions: key, question; fill: key, rank, query.
    """
    t = topic(F.col("question"))
    words = F.filter(K.words(t), lambda w: (F.length(w) > 2) | w.isin(*L.SHORT_TOPIC_TOKENS))
    rows = expansions.join(questions.select(key, t.alias("_t"), words.alias("_w")), key).withColumn("query", T.strip(F.col("query")))
    good = rows.filter((F.col("query") != "") & ((F.size("_w") == 0) | F.arrays_overlap("_w", K.words(F.col("query")))))
    good = good.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    prefixed = F.when((F.col("_n") >= n) | F.lower("query").contains(F.lower("_t")), F.col("query")).otherwise(F.concat_ws(" ", "_t", "query"))
    both = good.select(key, F.lit(0).alias("_s"), F.col("ord").cast("int").alias("_o"), prefixed.alias("query")).unionByName(
        fill.select(key, F.lit(1).alias("_s"), F.col("rank").alias("_o"), "query"))
    first = both.withColumn("_d", F.row_number().over(Window.partitionBy(key, F.lower("query")).orderBy("_s", "_o"))).filter("_d = 1")
    rank = F.row_number().over(Window.partitionBy(key).orderBy("_s", "_o"))
    return first.withColumn("rank", rank).filter(F.col("rank") <= n).select(key, "rank", "query")


def normal_categories(categories: Column) -> Column:
    """Known category names in the user's order, without repeats."""
    names = F.create_map(*[F.lit(x) for kv in L.CATEGORY_ALIASES.items() for x in kv])
    return F.array_distinct(F.filter(F.transform(categories, lambda c: F.try_element_at(names, F.lower(F.trim(c)))), lambda c: c.isNotNull()))


def fallback_tasks(questions: DataFrame, key: str, categories: tuple[str, ...], most: int | None = None) -> DataFrame:
    """(key, task_no, category, question, query): categories in turn, templates changing with every full turn; as many as the
    breadth asks for, ``most`` at most if given, each category once at least."""
    m = len(categories)
    asked = F.coalesce("breadth", F.lit(1))
    count = F.greatest(F.lit(m), asked if most is None else F.least(F.lit(most), asked))
    rows = questions.select(key, F.col("query").alias("_q"), F.explode(F.sequence(F.lit(0), count - 1)).alias("i"))
    pairs = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(t[0]).alias("question"), F.lit(t[1]).alias("query"))
                      for turn in (0, 1) for c in categories for t in (TASK_TEMPLATES[c][turn],)])
    rows = rows.withColumn("t", F.element_at(pairs, (F.col("i") % (2 * m) + 1).cast("int")))
    fill = lambda c: F.replace(F.col(f"t.{c}"), F.lit("{query}"), F.col("_q"))
    return rows.select(key, (F.col("i") + 1).alias("task_no"), F.col("t.category").alias("category"), fill("question").alias("question"), fill("query").alias("query"))


def mode_settings(jobs: DataFrame, key: str, mode: str = "mode") -> DataFrame:
    """Parameters of every job's mode, unknown modes get the default.  The four fixed modes are a literal map."""
    fields = list(MODE_COLUMNS[1:])
    table = F.create_map(*[x for row in MODES for x in (F.lit(row[0]), F.struct(*[F.lit(v).alias(f) for f, v in zip(fields, row[1:])]))])
    picked = F.coalesce(F.try_element_at(table, F.lower(F.col(mode))), F.element_at(table, F.lit(DEFAULT_MODE)))
    return jobs.select(key, picked.alias("m")).select(key, *[F.col(f"m.{f}").alias(f) for f in fields])


# fixed values: what a caller's hint says about the class, first match counts
HINT_CLASSES = (("simple_extraction", ("extract", "parse", "filter", "clean")), ("complex_planning", ("plan", "decompose", "strategy")),
                ("large_synthesis", ("synth", "report", "comprehensive", "write")), ("fact_checking", ("fact", "verify", "contradict", "credib")),
                ("code_analysis", ("code", "debug")))


def prompt_class(prompt: Column, system: Column | None = None, hint: Column | None = None) -> Column:
    """One of six classes: by the caller's hint if it names one, else by words of the system prompt and the prompt, else by
    the prompt's length."""
    low = F.lower(prompt if system is None else F.concat(F.coalesce(system, F.lit("")), F.lit("\n"), prompt))
    (fact, fw), (plan, pw), (big, bw), (small, sw) = PROMPT_CLASSES
    by_text = (F.when(T.contains_any(low, fw), fact).when(T.contains_any(low, pw), plan)
            .when(T.contains_any(low, bw) | (F.length(prompt) > 4000), big).when(T.contains_any(low, sw) | (F.length(prompt) < 400), small).otherwise("general"))
    if hint is None:
        return by_text
    name = F.translate(F.lower(hint), "- ", "__")
    return F.coalesce(*[F.when(T.contains_any(name, words), kind) for kind, words in HINT_CLASSES], by_text)
