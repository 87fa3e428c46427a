"""Report tables: metadata counts, briefings, use-case summaries, figure data and layouts, checks of what goes out."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import numeric, percent
from ..schema import duplicates


def event_counts(companies: DataFrame, links: DataFrame, most: int | None = None) -> DataFrame:
    """companies (company_id, source_rank) with how many links each has, 0 included; most links first, then source_rank with nulls last, then company_id."""
    n = links.groupBy("company_id").agg(F.count(F.lit(1)).alias("event_count"))
    rows = companies.join(n, "company_id", "left").withColumn("event_count", F.coalesce("event_count", F.lit(0)))
    rows = rows.orderBy(F.col("event_count").desc(), F.col("source_rank").asc_nulls_last(), F.col("company_id").asc_nulls_last())
    return rows if most is None else rows.limit(most)


def report_counts(companies: DataFrame, links: DataFrame, sources: DataFrame, market: DataFrame, checks: DataFrame) -> DataFrame:
    """(metric, value): the counts of a report's metadata.  links have event_id, company_id, source_events; checks have status."""

    def of(df: DataFrame, measures: dict[str, Column]) -> DataFrame:
        return df.agg(*[v.cast("long").alias(n) for n, v in measures.items()]).select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in measures])).alias("r")).select("r.*")

    many = F.when(numeric(F.col("source_events").cast("string")) > 1, F.col("event_id"))
    parts = [
        of(companies, {"companies": F.count(F.lit(1))}),
        of(links, {"companies_with_events": F.countDistinct("company_id"), "canonical_events": F.countDistinct("event_id"), "event_company_links": F.count(F.lit(1)), "multi_source_events": F.countDistinct(many)}),
        of(sources, {"source_articles": F.countDistinct("article_id"), "source_evidence_rows": F.count(F.lit(1))}),
        of(market, {"market_windows": F.count(F.lit(1))}),
        of(checks, {"validation_failures": F.count(F.when(F.col("status") == "FAIL", 1))}),
    ]
    return reduce(DataFrame.unionByName, parts)


def window_returns(market: DataFrame) -> DataFrame:
    """Count, mean and median of cumulative returns by window, over the returns that there are."""
    r = F.nanvl("cumulative_return", F.lit(None).cast("double"))
    return market.groupBy("window_days").agg(F.count(r).alias("n"), F.avg(r).alias("mean_return"), F.percentile(r, 0.5).alias("median_return"))


#: Headings of the two reports.
HEADINGS = {
    "en": ("Financial knowledge graph briefing", "Counts", "Companies with most events", "Events by type", "Market context", "Returns around publication are descriptive context, not estimates of causal impact."),
    "zh": ("金融知识图谱分析简报", "计数", "事件最多的公司", "按类型统计的事件", "市场背景", "发布日前后的收益仅为描述性背景，并非因果影响的估计。"),
}


def analyst_briefing(language: str, counts: DataFrame, companies: DataFrame, types: DataFrame, market: DataFrame) -> str:
    """The Markdown report in 'en' or 'zh'; each table is small by its making (counts, ten companies, types, windows)."""
    from ..sources.sinks import briefing

    title, *names, note = HEADINGS[language]
    return briefing(title, dict(zip(names, (counts, companies, types, market), strict=True))) + f"\n> {note}\n"


def use_case_summary(tasks: DataFrame, checks: DataFrame, order: str) -> DataFrame:
    """tasks (task_id, result_rows, median_ms, p95_ms) with three completeness measures from checks (task_id, metric_class, numerator, denominator, status).

    Of several checks of a class the last by `order` counts; a task passes if none of its checks fails.
    """
    classes = {"coverage": "internal_retrieval_completeness", "evidence": "evidence_completeness", "provenance": "provenance_completeness"}
    last = {n: F.max_by(F.struct("numerator", "denominator"), F.when(F.col("metric_class") == c, F.col(order))).alias(n) for n, c in classes.items()}
    seen = {n: F.count(F.when(F.col("metric_class") == c, 1)).alias(f"_{n}") for n, c in classes.items()}
    found = checks.groupBy("task_id").agg(*last.values(), *seen.values(), F.count(F.when(F.col("status") == "FAIL", 1)).alias("_failed"))
    rows = tasks.join(found, "task_id", "left")
    out = []
    for n in classes:
        there = F.col(f"_{n}") > 0
        top, of = (F.when(there, F.col(n)[f]) for f in ("numerator", "denominator"))
        out += [top.alias(f"{n}_numerator"), of.alias(f"{n}_denominator"), percent(F.coalesce(top, F.lit(0)), F.coalesce(of, F.lit(0)), 6).alias(f"{n}_pct")]
    units = F.when(F.coalesce(F.when(F.col("_coverage") > 0, F.col("coverage.denominator")), F.lit(0)) != 0, F.col("coverage.denominator")).otherwise(F.col("result_rows"))
    return rows.select(*tasks.columns, units.alias("primary_units"), *out, F.when(F.coalesce("_failed", F.lit(0)) == 0, "PASS").otherwise("FAIL").alias("status"))


def network_layout(nodes: DataFrame, centre: tuple[float, float] = (800.0, 465.0), radius: float = 345.0, lane: tuple[float, float, float] = (100.0, 1400.0, 920.0)) -> DataFrame:
    """nodes (company_id, strength) with is_isolate, x, y and node_radius: those with links on a circle from the top on, the others in a lane below.

    For graphs of entities: places are numbered over all nodes.
    """
    rows = nodes.withColumn("is_isolate", F.col("strength") == 0)
    w = W.partitionBy("is_isolate").orderBy(F.col("company_id").cast("string"))
    rows = rows.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("is_isolate"))).withColumn("_most", F.max("strength").over(W.partitionBy(F.lit(0))))
    angle = F.lit(-math.pi / 2) + F.lit(2 * math.pi) * F.col("_i") / F.col("_n")
    start, width, y = lane
    x = F.when(F.col("is_isolate"), F.lit(start) + F.lit(width) / F.col("_n") * (F.col("_i") + 0.5)).otherwise(F.lit(centre[0]) + F.lit(radius) * F.cos(angle))
    size = F.when(F.col("is_isolate"), 12.0).otherwise(13 + 18 * F.sqrt(F.col("strength") / F.col("_most")))
    return rows.select("company_id", "strength", "is_isolate", x.alias("x"), F.when(F.col("is_isolate"), F.lit(y)).otherwise(F.lit(centre[1]) + F.lit(radius) * F.sin(angle)).alias("y"), size.alias("node_radius"))


def edge_style(edges: DataFrame) -> DataFrame:
    """edges (a, b, weight) with line_width, opacity and heat, from log1p and the greatest weight."""
    most = edges.agg(F.max("weight").alias("_most"))
    rows = edges.join(most)
    return rows.select("a", "b", "weight", (0.8 + 1.4 * F.log1p("weight")).alias("line_width"), F.least(F.lit(0.85), 0.18 + F.log1p("weight") / 5).alias("opacity"), (F.col("weight") / F.col("_most")).alias("heat"))


def top_edges(edges: DataFrame, support: int, most: int = 15) -> DataFrame:
    """The `most` heaviest edges, with whether each has the support that is asked, and its bar as a share of the longest."""
    rows = edges.orderBy(F.col("weight").desc(), "a", "b").limit(most)
    share = F.col("weight") / F.max("weight").over(W.partitionBy(F.lit(0)))
    return rows.select("a", "b", "weight", (F.col("weight") >= support).alias("supported"), share.alias("bar"))


def isolate_lane(nodes: DataFrame) -> DataFrame:
    """nodes (company_id, source_rank) in one, two or three columns by how many there are, with x and y in percent."""
    n = F.count(F.lit(1)).over(W.partitionBy(F.lit(0)))
    rows = nodes.withColumn("_i", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("source_rank", "company_id")) - 1).withColumn("_n", n)
    columns = F.when(F.col("_n") > 12, 3).when(F.col("_n") > 5, 2).otherwise(1)
    rows = rows.withColumn("_rows", F.ceil(F.col("_n") / columns).cast("int")).withColumn("_columns", columns)
    column, row = F.floor(F.col("_i") / F.col("_rows")).cast("int"), F.col("_i") % F.col("_rows")
    x = F.when(F.col("_columns") == 1, 15).when(F.col("_columns") == 2, F.get(F.array(F.lit(9), F.lit(21)), column)).otherwise(F.get(F.array(F.lit(6), F.lit(16), F.lit(26)), column))
    y = F.when(F.col("_rows") == 1, 50.0).otherwise(15 + row / (F.col("_rows") - 1) * 70)
    return rows.select("company_id", "source_rank", x.alias("x"), y.alias("y"))


def size_report(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n_rows) of the tables of a graph, counted."""
    return reduce(DataFrame.unionByName, [df.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n_rows")) for n, df in tables.items()])


def bipartite_projection(companies: DataFrame, events: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes (node, label), edges (source, target)) with an edge from every company to its events; ends that are no node have no edge."""
    name = lambda label, c: F.concat(F.lit(f"{label}:"), F.col(c).cast("string"))
    nodes = companies.select(name("Company", "company_id").alias("node"), F.lit("Company").alias("label")).unionByName(events.select(name("Event", "event_id").alias("node"), F.lit("Event").alias("label")))
    own = links.join(companies.select("company_id"), "company_id", "left_semi").join(events.select("event_id"), "event_id", "left_semi").select("company_id", "event_id").distinct()
    return nodes.distinct(), own.select(name("Company", "company_id").alias("source"), name("Event", "event_id").alias("target"))


def asset_mismatches(market: DataFrame, companies: DataFrame) -> DataFrame:
    """market rows (company_id, asset_id) whose asset is not their company's, with the one expected (null where the company is unknown)."""
    expected = companies.select("company_id", F.col("asset_id").alias("expected_asset_id"))
    return market.join(expected, "company_id", "left").where(~F.col("asset_id").eqNullSafe(F.col("expected_asset_id")))


def snapshot_rejects(events: DataFrame, links: DataFrame, companies: DataFrame, first: str, last: str) -> DataFrame:
    """(reason, key) of what a snapshot may not hold: events outside the months from first to last, links to unknown ends, repeated links."""
    month = F.date_format("event_date", "yyyy-MM")
    outside = events.where(~F.coalesce(month.between(first, last), F.lit(False))).select(F.lit("outside_months").alias("reason"), F.col("event_id").cast("string").alias("key"))
    pair = F.concat_ws("/", F.col("company_id").cast("string"), F.col("event_id").cast("string")).alias("key")
    unknown = links.join(events.select("event_id"), "event_id", "left_anti").select("company_id", "event_id").unionByName(links.join(companies.select("company_id"), "company_id", "left_anti").select("company_id", "event_id")).distinct()
    twice = duplicates(links, ["company_id", "event_id"])
    return outside.unionByName(unknown.select(F.lit("unknown_end").alias("reason"), pair)).unionByName(twice.select(F.lit("repeated_link").alias("reason"), pair))


def require_clean(rejects: DataFrame, most: int = 10) -> None:
    """ValueError naming the first rejects, if there are any."""
    found = [f"{r.reason} {r.key}" for r in rejects.orderBy("reason", "key").limit(most).collect()]
    if found:
        raise ValueError("; ".join(found))


def overview(links: DataFrame, events: DataFrame, companies: DataFrame, least: float = 0.8, recent: int = 5, top: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(recent links of at least `least` probability, links by event type, companies of most events) for a dashboard's first page."""
    dated = links.join(events.select("event_id", "event_date", "event_type"), "event_id")
    late = dated.where(F.nanvl("prob", F.lit(0.0)) >= least).join(companies.select("company_id"), "company_id", "left_semi")
    late = late.orderBy(F.col("event_date").desc(), "event_id", "company_id", "l_linenumber").limit(recent)
    kinds = links.join(events.select("event_id", "event_type"), "event_id", "left").groupBy(F.coalesce("event_type", F.lit("other")).alias("event_type")).agg(F.count(F.lit(1)).alias("n"))
    return late, kinds, event_counts(companies, links.select("company_id", "event_id").distinct(), top)


def automatic_checks(companies: DataFrame, events: DataFrame, links: DataFrame, sensitivity: DataFrame, validation: DataFrame | None = None) -> DataFrame:
    """(metric, status, actual, expected) of canonical events and links, a threshold study and a graph validation.

    links have event_id, company_id, source_event_id, recommended; sensitivity has current and
    same_as_current, of which exactly one current row must agree; without a validation its check passes.
    """
    from ..functions.columns import nonblank, parse_bool

    good = F.when(parse_bool(F.col("recommended")), F.col("company_id"))
    spare = lambda df, keys: duplicates(df, keys).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("actual"))
    zero = F.lit(0).cast("long")
    now = F.col("current").cast("boolean")
    failed = validation.agg(F.count(F.when(F.col("status") == "FAIL", 1)).alias("actual")) if validation is not None else companies.agg(F.lit(0).cast("long").alias("actual"))
    rows = [
        links.agg(F.countDistinct(good).alias("actual")).join(companies.agg(F.count(F.lit(1)).alias("expected"))).select(F.lit("canonical_company_coverage").alias("metric"), "actual", "expected"),
        spare(events, ["event_id"]).select(F.lit("duplicate_canonical_event_ids").alias("metric"), "actual", zero.alias("expected")),
        spare(links, ["event_id", "company_id"]).select(F.lit("duplicate_canonical_event_company_pairs").alias("metric"), "actual", zero.alias("expected")),
        links.agg(F.count(F.when(~nonblank(F.col("source_event_id").cast("string")), 1)).alias("actual")).select(F.lit("canonical_relationships_without_source_event").alias("metric"), "actual", zero.alias("expected")),
        sensitivity.agg(((F.count(F.when(now, 1)) == 1) & F.coalesce(F.bool_and(F.when(now, F.col("same_as_current"))), F.lit(False))).cast("long").alias("actual")).select(F.lit("current_threshold_reconstruction").alias("metric"), "actual", F.lit(1).cast("long").alias("expected")),
        failed.select(F.lit("graph_validation_failures").alias("metric"), "actual", zero.alias("expected")),
    ]
    out = reduce(DataFrame.unionByName, rows)
    return out.select("metric", F.when(F.col("actual") == F.col("expected"), "PASS").otherwise("FAIL").alias("status"), "actual", "expected")


#: Pairs of measures that a graph study compares.
MEASURES = (("event_count", "coevent_degree"), ("event_count", "coevent_strength"), ("coevent_degree", "coevent_strength"), ("coevent_strength", "page_rank"))


def correlation_rows(metrics: DataFrame, pairs: tuple[tuple[str, str], ...] = MEASURES) -> DataFrame:
    """(metric_1, metric_2, n, pearson, spearman) of each pair; null with fewer than two rows or where one side does not vary."""
    from ..functions.columns import average_rank, pearson

    names = sorted({x for p in pairs for x in p})
    rows = metrics.select(*[F.col(x).cast("double").alias(x) for x in names])
    rows = rows.select("*", *[average_rank(F.col(x)).alias(f"_{x}") for x in names])
    found = rows.agg(F.count(F.lit(1)).alias("n"), *[pearson(F.col(a), F.col(b)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)], *[pearson(F.col(f"_{a}"), F.col(f"_{b}")).alias(f"s{i}") for i, (a, b) in enumerate(pairs)])
    parts = [F.struct(F.lit(a).alias("metric_1"), F.lit(b).alias("metric_2"), F.col("n"), F.when(F.col("n") > 1, F.col(f"p{i}")).alias("pearson"), F.when(F.col("n") > 1, F.col(f"s{i}")).alias("spearman")) for i, (a, b) in enumerate(pairs)]
    return found.select(F.explode(F.array(*parts)).alias("r")).select("r.*")


def event_set(links: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """For each key: distinct events, how many of each type (sorted 'type=n', joined by '; '), first and latest date."""
    rows = links.select(*keys, "event_id").distinct().join(events.select("event_id", "event_type", "event_date"), "event_id")
    by = rows.groupBy(*keys, "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_date").alias("first"), F.max("event_date").alias("latest"))
    listed = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "event_type", F.col("n").cast("string")))), "; ")
    return by.groupBy(*keys).agg(F.sum("n").alias("events"), listed.alias("types"), F.min("first").alias("first_date"), F.max("latest").alias("latest_date"))


def company_months(links: DataFrame, events: DataFrame, companies: DataFrame, start: str, end: str) -> DataFrame:
    """(company_id, month, n): every company's distinct events in every month from start to end, 0 included."""
    from .stages import monthly

    rows = links.select("company_id", "event_id").distinct().join(events.select("event_id", "event_date"), "event_id")
    return monthly(rows, "event_date", start, end, companies.select("company_id").distinct())


def timed_read(df: DataFrame) -> dict:
    """Milliseconds until the result of df is consumed, its rows and its content hash."""
    import time

    from ..sources.sinks import content_hash

    begun = time.perf_counter_ns()
    found = content_hash(df).first()
    return {"client_elapsed_ms": (time.perf_counter_ns() - begun) / 1e6, "result_rows": found["n_rows"], "result_sha256": found["content_sha256"]}


def timed_runs(tasks: dict[str, DataFrame], warm_ups: int = 2, measured: int = 10) -> DataFrame:
    """(task_id, run, is_warmup, client_elapsed_ms, result_rows, result_sha256) of every run of every task, for `latency`."""
    spark = next(iter(tasks.values())).sparkSession
    rows = [(name, i, i < warm_ups, *timed_read(df).values()) for name, df in tasks.items() for i in range(warm_ups + measured)]
    return spark.createDataFrame(rows, "task_id string, run int, is_warmup boolean, client_elapsed_ms double, result_rows bigint, result_sha256 string")
