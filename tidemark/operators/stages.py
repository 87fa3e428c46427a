"""Stage reports: retention, pivots, sensitivity, coverage, rollups, merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import percent


def stage_summary(stages: dict[str, DataFrame]) -> DataFrame:
    """For each stage of links (event_id, company_id): rows, distinct events, pairs and companies, and the share of events kept from the stage before (null for the first)."""
    rows = [df.agg(F.lit(i).alias("stage_order"), F.lit(n).alias("stage"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct("event_id").alias("events"), F.countDistinct("event_id", "company_id").alias("pairs"), F.countDistinct("company_id").alias("companies")) for i, (n, df) in enumerate(stages.items())]
    out = reduce(DataFrame.unionByName, rows)
    before = F.lag("events").over(W.orderBy("stage_order"))
    return out.withColumn("retention_pct", F.when(before.isNotNull(), percent(F.col("events"), before, 6)))


def stage_pivot(stages: dict[str, DataFrame], dim: DataFrame, key: str) -> DataFrame:
    """dim's keys with the distinct events of each stage, 0 where there are none, and what each stage lost."""
    marked = reduce(DataFrame.unionByName, [df.select(key, "event_id", F.lit(n).alias("stage")) for n, df in stages.items()])
    names = list(stages)
    counts = marked.groupBy(key).pivot("stage", names).agg(F.countDistinct("event_id"))
    out = dim.select(key).distinct().join(counts, key, "left")
    out = out.select(key, *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in names])
    return out.select("*", *[(F.col(a) - F.col(b)).alias(f"lost_{b}") for a, b in zip(names, names[1:], strict=False)])


def sensitivity(links: DataFrame, companies: DataFrame, grid: list[tuple[float, float]], current: tuple[float, float], accept) -> DataFrame:
    """For each cell of a threshold grid (62 at most): events, pairs, covered and uncovered companies, counts by company, pairs gained and lost against the current cell.

    accept(links, x, y) is the gate as a column.  Links are read once: each becomes the set of cells that
    accept it, as bits, and sets are united by pair and by event before any cell is counted.
    """
    if len(grid) > 62:
        raise ValueError("a grid has 62 cells at most")
    bits = sum((F.when(accept(links, x, y), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (x, y) in enumerate(grid)), F.lit(0).cast("long"))
    # a pair stands in the current cell if any of its links does
    united = links.select("event_id", "company_id", bits.alias("bits"), F.coalesce(accept(links, *current), F.lit(False)).alias("now"))
    united = united.groupBy("event_id", "company_id").agg(F.bit_or("bits").alias("bits"), F.bool_or("now").alias("now"))
    cells = lambda b: F.explode(F.array_compact(F.array(*[F.when(F.getbit(b, F.lit(i)) == 1, F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))) for i, (x, y) in enumerate(grid)])))
    pairs = united.where("bits <> 0").select("company_id", "now", cells(F.col("bits")).alias("cell")).select("company_id", "now", "cell.x", "cell.y")
    per = pairs.groupBy("x", "y", "company_id").agg(F.count(F.lit(1)).alias("n"))
    events = united.groupBy("event_id").agg(F.bit_or("bits").alias("bits")).where("bits <> 0").select(cells(F.col("bits")).alias("cell")).groupBy("cell.x", "cell.y").agg(F.count(F.lit(1)).alias("events"))
    spark = links.sparkSession
    every = spark.createDataFrame(grid, "x double, y double")
    full = every.join(companies.select("company_id").distinct()).join(per, ["x", "y", "company_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    spread = full.groupBy("x", "y").agg(F.sum((F.col("n") > 0).cast("long")).alias("covered"), F.sum((F.col("n") == 0).cast("long")).alias("uncovered"), F.min("n").alias("least"), F.percentile("n", 0.5).alias("median"), F.max("n").alias("most"))
    whole = pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("pairs"), F.sum((~F.col("now")).cast("long")).alias("added"), F.sum(F.col("now").cast("long")).alias("_same"))
    total = united.agg(F.count(F.when(F.col("now"), 1)).alias("_now"))
    out = spread.join(whole, ["x", "y"], "left").join(events, ["x", "y"], "left").join(total)
    zero = lambda c: F.coalesce(c, F.lit(0))
    removed = F.col("_now") - zero(F.col("_same"))
    return out.select("x", "y", zero(F.col("events")).alias("events"), zero(F.col("pairs")).alias("pairs"), "covered", "uncovered", "least", "median", "most", zero(F.col("added")).alias("added"), removed.alias("removed"), ((zero(F.col("added")) == 0) & (removed == 0)).alias("same_as_current"))


def coverage_selection(companies: DataFrame, articles: DataFrame, target: int, least_articles: int, least_months: int) -> DataFrame:
    """companies (company_id, source_rank) with distinct articles and months, shortfalls, and status: the first `target` that qualify, by rank, are selected and numbered."""
    found = articles.groupBy("company_id").agg(F.countDistinct("article_id").alias("articles"), F.countDistinct(F.date_format("published", "yyyy-MM")).alias("months"), F.min(F.date_format("published", "yyyy-MM")).alias("first_month"), F.max(F.date_format("published", "yyyy-MM")).alias("last_month"))
    rows = companies.join(found, "company_id", "left").withColumns({"articles": F.coalesce("articles", F.lit(0)), "months": F.coalesce("months", F.lit(0))})
    few, short = F.col("articles") < least_articles, F.col("months") < least_months
    rows = rows.withColumn("shortfall", F.concat_ws("; ", F.when(few, "articles"), F.when(short, "months"))).withColumn("_ok", ~(few | short))
    n = F.sum(F.col("_ok").cast("int")).over(W.orderBy("source_rank"))
    rows = rows.withColumn("_n", n)
    status = F.when(F.col("_ok") & (F.col("_n") <= target), "SELECTED").when(F.col("_ok"), "QUALIFIED_RESERVE").otherwise("EXCLUDED_LOW_NEWS_COVERAGE")
    return rows.withColumn("status", status).withColumn("sample_order", F.when(F.col("status") == "SELECTED", F.col("_n"))).drop("_ok", "_n")


def with_total(rows: DataFrame, key: str, aggregates: list[Column], total: str = "ALL") -> DataFrame:
    """Aggregates by key, and over all in a row named `total`."""
    key_column = F.when(F.grouping(key) == 1, F.lit(total)).otherwise(F.col(key).cast("string"))
    return rows.rollup(key).agg(key_column.alias("_key"), *aggregates).drop(key).withColumnRenamed("_key", key)


def monthly(rows: DataFrame, day: str, start: str, end: str, key: DataFrame | None = None) -> DataFrame:
    """Counts for every month from start to end, 0 included; for every row of key, if given."""
    spine = rows.sparkSession.range(1).select(F.explode(F.sequence(F.trunc(F.lit(start).cast("date"), "MM"), F.trunc(F.lit(end).cast("date"), "MM"), F.expr("interval 1 month"))).alias("_m"))
    names = key.columns if key is not None else []
    spine = (key.join(spine) if key is not None else spine).withColumn("month", F.date_format("_m", "yyyy-MM")).drop("_m")
    counts = rows.where(F.col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date"))).groupBy(*names, F.date_format(day, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return spine.join(counts, [*names, "month"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def collection_windows(companies: DataFrame, start: str, end: str) -> DataFrame:
    """companies with window_start and window_end of each calendar month, clipped to the study's days."""
    first = F.explode(F.sequence(F.trunc(F.lit(start).cast("date"), "MM"), F.lit(end).cast("date"), F.expr("interval 1 month")))
    rows = companies.select("*", first.alias("_m"))
    return rows.select(*companies.columns, F.greatest("_m", F.lit(start).cast("date")).alias("window_start"), F.least(F.last_day("_m"), F.lit(end).cast("date")).alias("window_end"))


def merge_records(rows: DataFrame, key: str, same: list[str], most: list[str]) -> DataFrame:
    """One row for each key: columns `same` with whether they conflict, the greatest of columns `most`."""
    facts = F.struct(*same)
    out = rows.groupBy(key).agg(F.min(facts).alias("_f"), (F.countDistinct(facts) > 1).alias("conflict"), *[F.max(c).alias(c) for c in most])
    return out.select(key, "_f.*", *most, "conflict")


def latency(timings: DataFrame, task: str = "task_id") -> DataFrame:
    """Runs that were measured: median, 95th percentile (linear), extremes, and whether results stayed the same."""
    rows = timings.where(~F.col("is_warmup"))
    ms = F.col("client_elapsed_ms")
    return rows.groupBy(task).agg(F.count(F.lit(1)).alias("runs"), F.percentile(ms, 0.5).alias("median_ms"), F.percentile(ms, 0.95).alias("p95_ms"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"), ((F.countDistinct("result_sha256") == 1) & (F.countDistinct("result_rows") == 1)).alias("stable"))


def value_counts(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value, n): how often each value stands in each field, null as null, most often first within a field."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    return df.select(pairs.alias("p")).groupBy("p.field", "p.value").agg(F.count(F.lit(1)).alias("n")).orderBy("field", F.col("n").desc(), "value")


def requests_needed(companies: DataFrame, windows: DataFrame, cached: DataFrame, refresh: DataFrame | None = None) -> int:
    """How many (company_id, window_start, window_end) a collection has to ask for: those not cached, and all of companies to refresh."""
    keys = ["company_id", *windows.columns]
    wanted = companies.select("company_id").distinct().join(windows.distinct())
    have = cached.select(*keys).distinct()
    if refresh is not None:
        have = have.join(refresh.select("company_id").distinct(), "company_id", "left_anti")
    return wanted.join(have, keys, "left_anti").count()


def quality_check(df: DataFrame, name: str, passing: Column, of: Column | None = None, informational: bool = False) -> DataFrame:
    """One row: how many of the rows (of those where `of` holds) pass, in percent, and PASS where all do and there are any; INFO where it only informs."""
    base = F.lit(True) if of is None else of
    n = F.sum((base & F.coalesce(passing, F.lit(False))).cast("long"))
    out = df.agg(F.lit(name).alias("check_name"), F.coalesce(n, F.lit(0)).alias("numerator"), F.coalesce(F.sum(base.cast("long")), F.lit(0)).alias("denominator"))
    return out.withColumn("percentage", percent(F.col("numerator"), F.col("denominator"), 6, None)).withColumn("status", F.lit("INFO") if informational else F.when((F.col("denominator") > 0) & (F.col("numerator") == F.col("denominator")), "PASS").otherwise("FAIL"))
