"""Queries over canonical events, first-come rules, gates, graph selection, reports, figure data and text helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DedupConfig, GateConfig
from ..functions import text as X
from ..operators import assistant as A
from ..operators import canonical as K
from ..operators import graph as G
from ..operators import reporting as R
from ..operators import stages as T
from .catalog import query
from .proxy import Graph

# one link for each event and company, so that no two tie
_LINKS = "(SELECT a.event_id, company_id, any_value(e.article_id) AS article_id, any_value(e.event_type) AS event_type, bool_or(recommended) AS recommended, max(prob) AS positive, max(label_score) AS label_score, max(focus) AS focus, CASE min(status) WHEN 'A' THEN 'high' WHEN 'N' THEN 'medium' ELSE 'low' END AS link_confidence FROM affects a JOIN graph_events e ON e.event_id = a.event_id GROUP BY a.event_id, company_id)"


def _links(g: Graph) -> DataFrame:
    rows = g.affects.join(g.events.select("event_id", "article_id", "event_type"), "event_id")
    status = F.min("status")
    confidence = F.when(status == "A", "high").when(status == "N", "medium").otherwise("low")
    return rows.groupBy("event_id", "company_id").agg(F.any_value("article_id").alias("article_id"), F.any_value("event_type").alias("event_type"), F.bool_or("recommended").alias("recommended"), F.max("prob").alias("positive"), F.max("label_score").alias("label_score"), F.max("focus").alias("focus"), confidence.alias("link_confidence"))


_CANONICAL = "(SELECT article_id AS cluster, min(event_id) AS representative, count(*) AS source_events, min(event_type) AS event_type, CASE WHEN count(*) = 1 THEN 'singleton' ELSE 'complete_link' END AS method, bool_or(event_score >= 5) AS recommended FROM graph_events GROUP BY article_id)"


def _canonical(g: Graph) -> DataFrame:
    """An article's events stand for a cluster."""
    n = F.count(F.lit(1))
    return g.events.groupBy(F.col("article_id").alias("cluster")).agg(F.min("event_id").alias("representative"), n.alias("source_events"), F.min("event_type").alias("event_type"), F.when(n == 1, "singleton").otherwise("complete_link").alias("method"), F.bool_or(F.col("event_score") >= 5).alias("recommended")).withColumn("canonical_id", F.col("cluster"))


def _clusters(g: Graph) -> DataFrame:
    return g.events.select("event_id", F.col("article_id").alias("cluster"))


@query("canonical_links", f"""WITH l AS {_LINKS}, c AS {_CANONICAL}, r AS (SELECT *, row_number() OVER (PARTITION BY article_id, company_id ORDER BY recommended DESC, positive DESC, label_score DESC, focus DESC, CASE link_confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, event_id) AS k,
count(*) OVER w AS n, bool_or(recommended) OVER w AS any_ok FROM l WINDOW w AS (PARTITION BY article_id, company_id)),
lists AS (SELECT article_id, company_id, '["' || string_agg(event_id::VARCHAR, '","' ORDER BY event_id::VARCHAR) || '"]' AS source_event_ids FROM l GROUP BY ALL)
SELECT r.article_id AS canonical_id, r.company_id, r.event_id AS source_event_id, r.article_id AS source_article_id, positive, label_score, focus, link_confidence, c.event_type, e.event_date AS relationship_published_at, n AS source_relationships, source_event_ids, '["' || r.article_id::VARCHAR || '"]' AS source_article_ids, any_ok AS recommended, n > 1 AS deduplicated
FROM r JOIN c ON c.cluster = r.article_id JOIN graph_events e ON e.event_id = r.event_id JOIN lists ON lists.article_id = r.article_id AND lists.company_id = r.company_id WHERE k = 1""")
def canonical_links(g: Graph) -> DataFrame:
    """One link for each canonical event and company, with what its sources add."""
    return K.canonical_links(_links(g), _clusters(g), _canonical(g), g.events.select("event_id", F.col("event_date").alias("published_at")))


_SCORES = "(SELECT c.representative AS a, e.event_id AS b, ((e.event_id * 7 + c.representative) % 100)::DOUBLE / 100 AS word, ((e.event_id * 3) % 100)::DOUBLE / 100 AS characters, ((e.event_id * 11) % 100)::DOUBLE / 100 AS containment, ((e.event_id * 13) % 100)::DOUBLE / 100 AS combined FROM graph_events e JOIN c ON c.cluster = e.article_id WHERE e.event_id <> c.representative AND e.event_id % 5 > 0)"


@query("mention_provenance", f"""WITH c AS {_CANONICAL}, s AS {_SCORES} SELECT c.cluster AS canonical_id, e.event_id, event_date, e.event_id = representative AS is_representative, method, CASE WHEN e.event_id = representative THEN 1.0 ELSE word END AS word, CASE WHEN e.event_id = representative THEN 1.0 ELSE characters END AS characters, CASE WHEN e.event_id = representative THEN 1.0 ELSE containment END AS containment, CASE WHEN e.event_id = representative THEN 1.0 ELSE combined END AS combined
FROM graph_events e JOIN c ON c.cluster = e.article_id LEFT JOIN s ON s.a = c.representative AND s.b = e.event_id""")
def mention_provenance(g: Graph) -> DataFrame:
    """Every source event with its canonical event and its likeness to the representative."""
    canonical = _canonical(g)
    pairs = g.events.join(canonical.select(F.col("cluster").alias("article_id"), "representative"), "article_id").where("event_id <> representative AND event_id % 5 > 0")
    part = lambda x: F.pmod(x, F.lit(100)).cast("double") / 100
    e = F.col("event_id")
    scores = pairs.select(e.alias("a"), F.col("representative").alias("b"), part(e * 7 + F.col("representative")).alias("word"), part(e * 3).alias("characters"), part(e * 11).alias("containment"), part(e * 13).alias("combined"))
    return K.provenance(g.events.select("event_id", "event_date"), canonical, _clusters(g), scores)


@query("dedup_summary", """WITH e AS (SELECT stored_sources AS s, (event_id % 997)::DOUBLE / 997 AS m FROM graph_events WHERE event_score >= 5)
SELECT 'summary' AS section, 'qualified_canonical_events' AS metric, count(*)::DOUBLE AS value FROM e UNION ALL SELECT 'summary', 'source_event_mentions', sum(s)::DOUBLE FROM e UNION ALL SELECT 'summary', 'duplicates_removed', (sum(s) - count(*))::DOUBLE FROM e UNION ALL SELECT 'summary', 'multi_source_canonical_events', count(*) FILTER (s > 1)::DOUBLE FROM e
UNION ALL SELECT 'summary', 'largest_cluster_size', max(s)::DOUBLE FROM e UNION ALL SELECT 'summary', 'minimum_multi_source_similarity', round(min(m) FILTER (s > 1), 6) FROM e UNION ALL SELECT 'summary', 'qualified_canonical_relationships', count(*) FILTER (recommended)::DOUBLE FROM affects""")
def dedup_summary(g: Graph) -> DataFrame:
    """What the final gate lets through, and what clustering saved."""
    events = g.events.select((F.col("event_score") >= 5).alias("recommended"), F.col("stored_sources").alias("source_events"), (F.pmod("event_id", F.lit(997)).cast("double") / 997).alias("min_similarity"))
    return K.dedup_summary(events, g.affects)


@query("dedup_report", f"""WITH c AS {_CANONICAL}, l AS {_LINKS}, k AS (SELECT article_id, company_id, bool_or(recommended) AS ok FROM l GROUP BY ALL), n AS (SELECT (SELECT count(*) FROM graph_events) AS e, (SELECT count(*) FROM graph_events WHERE event_score >= 5) AS re, (SELECT count(*) FROM c) AS ce, (SELECT count(*) FROM c WHERE recommended) AS rce, (SELECT count(*) FROM l WHERE recommended) AS rl, (SELECT count(*) FROM k WHERE ok) AS rk, (SELECT count(*) FROM c WHERE source_events > 1) AS multi, (SELECT max(source_events) FROM c) AS largest)
SELECT section, metric, value::DOUBLE AS value FROM n, LATERAL (VALUES ('configuration', 'maximum_date_difference_days', 7.0), ('configuration', 'minimum_text_similarity', 0.72), ('configuration', 'minimum_token_containment', 0.45), ('summary', 'source_events', e), ('summary', 'recommended_source_events', re), ('summary', 'canonical_events', ce), ('summary', 'recommended_canonical_events', rce), ('summary', 'multi_source_clusters', multi), ('summary', 'largest_cluster_size', largest), ('summary', 'recommended_source_relationships', rl), ('summary', 'recommended_canonical_relationships', rk), ('summary', 'recommended_events_removed_as_duplicates', re - rce)) v(section, metric, value)
UNION ALL SELECT 'cluster_method', method, count(*)::DOUBLE FROM c GROUP BY method""")
def dedup_report(g: Graph) -> DataFrame:
    """Settings, counts before and after clustering, and canonical events by method."""
    links = G.cut(_links(g))
    canonical = G.cut(_canonical(g))
    made = K.canonical_links(links, _clusters(g), canonical, g.events.select("event_id", F.col("event_date").alias("published_at")))
    return K.dedup_report(g.events.withColumn("recommended", F.col("event_score") >= 5), links, canonical, made, DedupConfig())


@query("focused_links", "SELECT event_id, company_id, l_linenumber, focus FROM (SELECT *, row_number() OVER (PARTITION BY event_id, company_id ORDER BY focus DESC, l_linenumber) AS k FROM affects) WHERE k = 1")
def focused_links(g: Graph) -> DataFrame:
    """Of each pair the link of greatest focus, the first line among equals."""
    return K.focused_links(g.affects.select("event_id", "company_id", "l_linenumber", "focus"), "focus", "l_linenumber")


@query("first_event_rows", "SELECT event_id, company_id, l_linenumber, recommended FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY l_linenumber, company_id, recommended) AS k FROM affects) WHERE k = 1")
def first_event_rows(g: Graph) -> DataFrame:
    """Of each event the link that came first."""
    return K.first_rows(g.affects.select("event_id", "company_id", "l_linenumber", "recommended"), ["event_id"], ["l_linenumber", "company_id", "recommended"])


@query("best_evidence", "SELECT event_id, l_linenumber, evidence, prob AS positive, label_score AS score FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY prob DESC, label_score DESC, l_linenumber, evidence) AS k FROM affects) WHERE k = 1")
def best_evidence(g: Graph) -> DataFrame:
    """Of each event the evidence that the model is surest of."""
    return K.best_evidence(g.affects.select("event_id", "l_linenumber", "evidence", F.col("prob").alias("positive"), F.col("label_score").alias("score")), ["event_id"], ["l_linenumber", "evidence"])


@query("event_type_override", "SELECT event_id, CASE WHEN (event_id % 100)::DOUBLE / 100 >= 0.45 THEN 'model_type' ELSE event_type END AS overridden, event_type AS kept FROM graph_events")
def event_type_override(g: Graph) -> DataFrame:
    """The events' types with overriding by the model on and off."""
    score = F.pmod("event_id", F.lit(100)).cast("double") / 100
    on, off = GateConfig(override_type=True), GateConfig()
    return g.events.select("event_id", K.final_type(F.col("event_type"), F.lit("model_type"), score, on).alias("overridden"), K.final_type(F.col("event_type"), F.lit("model_type"), score, off).alias("kept"))


_GATE = "recommended AND status IN ('A', 'R') AND (label_score >= {c} OR focus >= 40)"
_RESCUE = "NOT recommended AND status IN ('A', 'R') AND label_score >= 0.5 AND prob >= 0.5 AND focus >= 2 AND e.event_score::DOUBLE / 8 >= 0.35"


@query("relationship_gate", "WITH x AS (" + " UNION ALL ".join(f"SELECT {c}::DOUBLE AS confirmation, {r} AS rescue, a.event_id, company_id FROM affects a JOIN graph_events e ON e.event_id = a.event_id WHERE ({_GATE.format(c=c)})" + (f" OR ({_RESCUE})" if r == "TRUE" else "") for c in (0.2, 0.35, 0.6) for r in ("TRUE", "FALSE")) + ") SELECT confirmation, rescue, count(*) AS links, count(DISTINCT event_id) AS events, count(DISTINCT company_id) AS companies FROM x GROUP BY ALL")
def relationship_gate(g: Graph) -> DataFrame:
    """How many links pass the gate, as a threshold study varies confirmation and rescue."""
    rows = g.affects.join(g.events.select("event_id", "event_score"), "event_id").select("event_id", "company_id", "recommended", "focus", "label_score", F.col("status").alias("label"), F.col("prob").alias("positive"), (F.col("event_score").cast("double") / 8).alias("event_score"))
    cells = []
    for c in (0.2, 0.35, 0.6):
        for rescue in (True, False):
            ok = K.relationship_gate(rows, c, 40, GateConfig(accepted=("A", "R"), rescue=rescue, rescue_threshold=0.5), F.col("event_score"))
            cells.append(F.when(ok, F.struct(F.lit(c).alias("confirmation"), F.lit(rescue).alias("rescue"))))
    kept = rows.select("event_id", "company_id", F.explode(F.array_compact(F.array(*cells))).alias("c"))
    return kept.groupBy("c.confirmation", "c.rescue").agg(F.count(F.lit(1)).alias("links"), F.countDistinct("event_id").alias("events"), F.countDistinct("company_id").alias("companies"))


_SELECT = """SELECT {everything} AS everything, 'events' AS name, count(*) AS n FROM {e} UNION ALL SELECT {everything}, 'links', count(*) FROM {l} UNION ALL SELECT {everything}, 'articles', count(*) FROM art WHERE article_id % 3 <> 0 AND article_id IN (SELECT article_id FROM {e})
UNION ALL SELECT {everything}, 'article_links', count(*) FROM al WHERE ok AND article_id IN (SELECT article_id FROM {e}) AND company_id IN (SELECT company_id FROM companies) UNION ALL SELECT {everything}, 'market', count(*) FROM observations o JOIN companies c ON c.asset_id = o.asset_id WHERE EXISTS (SELECT 1 FROM {l} l WHERE l.event_id = o.event_id AND l.company_id = c.company_id)"""


@query("graph_selection", "WITH art AS (SELECT DISTINCT article_id FROM graph_events), al AS (SELECT article_id, company_id, bool_or(recommended) AS ok FROM affects a JOIN graph_events g ON g.event_id = a.event_id GROUP BY ALL), e1 AS (SELECT * FROM graph_events WHERE event_score >= 5), l1 AS (SELECT * FROM affects WHERE recommended AND event_id IN (SELECT event_id FROM e1)), e2 AS (SELECT * FROM graph_events WHERE article_id % 3 <> 0), l2 AS (SELECT * FROM affects WHERE event_id IN (SELECT event_id FROM e2)) " + _SELECT.format(everything="FALSE", e="e1", l="l1") + " UNION ALL " + _SELECT.format(everything="TRUE", e="e2", l="l2"))
def graph_selection(g: Graph) -> DataFrame:
    """How many rows of each table go into the graph, by the gate and with everything that is ready."""
    events = g.events.withColumn("recommended", F.col("event_score") >= 5)
    articles = g.events.select("article_id").distinct().withColumn("analysis_ready", F.col("article_id") % 3 != 0)
    tied = g.affects.join(g.events.select("event_id", "article_id"), "event_id").groupBy("article_id", "company_id").agg(F.bool_or("recommended").alias("accepted"))
    market = g.observations.join(g.companies.select("company_id", "asset_id"), "asset_id")
    out = None
    for everything in (False, True):
        for name, df in K.graph_selection(events, g.affects, articles, tied, market, g.companies, everything=everything).items():
            part = df.agg(F.lit(everything).alias("everything"), F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
            out = part if out is None else out.unionByName(part)
    return out


@query("report_counts", """SELECT 'companies' AS metric, count(*) AS value FROM companies UNION ALL SELECT 'companies_with_events', count(DISTINCT company_id) FROM affects UNION ALL SELECT 'canonical_events', count(DISTINCT event_id) FROM affects UNION ALL SELECT 'event_company_links', count(*) FROM affects UNION ALL SELECT 'multi_source_events', count(DISTINCT a.event_id) FROM affects a JOIN graph_events e ON e.event_id = a.event_id WHERE stored_sources > 1
UNION ALL SELECT 'source_articles', count(DISTINCT article_id) FROM reports UNION ALL SELECT 'source_evidence_rows', count(*) FROM reports UNION ALL SELECT 'market_windows', count(*) FROM observations UNION ALL SELECT 'validation_failures', count(*) FILTER (event_type = '5-LOW') FROM graph_events""")
def report_counts(g: Graph) -> DataFrame:
    """The counts of a report's metadata."""
    links = g.affects.join(g.events.select("event_id", F.col("stored_sources").alias("source_events")), "event_id")
    checks = g.events.select(F.when(F.col("event_type") == "5-LOW", "FAIL").otherwise("PASS").alias("status"))
    return R.report_counts(g.companies, links, g.reports, g.observations, checks)


@query("window_returns", "SELECT window_days, count(cumulative_return) AS n, round(avg(cumulative_return), 9) + 0 AS mean_return, round(quantile_cont(cumulative_return, 0.5), 9) + 0 AS median_return FROM observations GROUP BY window_days")
def window_returns(g: Graph) -> DataFrame:
    """Returns by window, as a briefing shows them."""
    even = lambda c: (F.round(c, 9) + F.lit(0.0)).alias(c)  # noqa: E731  no negative zero
    return R.window_returns(g.observations).select("window_days", "n", even("mean_return"), even("median_return"))


@query("briefing_companies", "SELECT company_id, rank AS source_rank, n AS event_count FROM (SELECT c.company_id, CASE WHEN c.source_rank % 7 = 0 THEN NULL ELSE c.source_rank END AS rank, count(a.event_id) AS n FROM companies c LEFT JOIN affects a ON a.company_id = c.company_id GROUP BY ALL) ORDER BY n DESC, rank ASC NULLS LAST, company_id LIMIT 10")
def briefing_companies(g: Graph) -> DataFrame:
    """The ten companies of most links; those without a rank come last among equals."""
    companies = g.companies.select("company_id", F.when(F.col("source_rank") % 7 != 0, F.col("source_rank")).alias("source_rank"))
    return R.event_counts(companies, g.affects, 10)


_CHECKS = "(SELECT event_type AS task_id, CASE article_id % 4 WHEN 0 THEN 'internal_retrieval_completeness' WHEN 1 THEN 'evidence_completeness' WHEN 2 THEN 'provenance_completeness' ELSE 'other' END AS metric_class, event_id AS ordinal, event_score::BIGINT AS numerator, 8::BIGINT AS denominator, CASE WHEN event_type = '1-URGENT' AND event_score = 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM graph_events WHERE NOT (event_type = '2-HIGH' AND article_id % 4 = 1))"


@query("use_case_summary", f"""WITH k AS {_CHECKS}, t AS (SELECT event_type AS task_id, count(*) AS result_rows FROM graph_events GROUP BY event_type UNION ALL SELECT 'idle', 0), last AS (SELECT task_id, metric_class, max_by(numerator, ordinal) AS num, max_by(denominator, ordinal) AS den FROM k GROUP BY ALL), f AS (SELECT task_id, count(*) FILTER (status = 'FAIL') AS failed FROM k GROUP BY ALL)
SELECT t.task_id, t.result_rows, coalesce(c.den, t.result_rows) AS primary_units, c.num AS coverage_numerator, c.den AS coverage_denominator, coalesce(round(100.0 * c.num / c.den, 6), 0.0)::DOUBLE AS coverage_pct, e.num AS evidence_numerator, e.den AS evidence_denominator, coalesce(round(100.0 * e.num / e.den, 6), 0.0)::DOUBLE AS evidence_pct, p.num AS provenance_numerator, p.den AS provenance_denominator, coalesce(round(100.0 * p.num / p.den, 6), 0.0)::DOUBLE AS provenance_pct, CASE WHEN coalesce(failed, 0) = 0 THEN 'PASS' ELSE 'FAIL' END AS status
FROM t LEFT JOIN f ON f.task_id = t.task_id LEFT JOIN last c ON c.task_id = t.task_id AND c.metric_class = 'internal_retrieval_completeness' LEFT JOIN last e ON e.task_id = t.task_id AND e.metric_class = 'evidence_completeness' LEFT JOIN last p ON p.task_id = t.task_id AND p.metric_class = 'provenance_completeness'""")
def use_case_summary(g: Graph) -> DataFrame:
    """Tasks with the last figure of each kind of check, and whether all checks pass."""
    kind = F.col("article_id") % 4
    name = F.when(kind == 0, "internal_retrieval_completeness").when(kind == 1, "evidence_completeness").when(kind == 2, "provenance_completeness").otherwise("other")
    failed = (F.col("event_type") == "1-URGENT") & (F.col("event_score") == 0)
    checks = g.events.where(~((F.col("event_type") == "2-HIGH") & (kind == 1))).select(F.col("event_type").alias("task_id"), name.alias("metric_class"), F.col("event_id").alias("ordinal"), F.col("event_score").cast("long").alias("numerator"), F.lit(8).cast("long").alias("denominator"), F.when(failed, "FAIL").otherwise("PASS").alias("status"))
    tasks = g.events.groupBy(F.col("event_type").alias("task_id")).agg(F.count(F.lit(1)).alias("result_rows")).unionByName(g.spark.createDataFrame([("idle", 0)], "task_id string, result_rows bigint"))
    return R.use_case_summary(tasks, checks, "ordinal")


_NODES = "(SELECT company_id, source_rank, CASE WHEN company_id % 4 = 0 THEN 0 ELSE n END AS strength FROM (SELECT c.company_id, source_rank, count(a.event_id) AS n FROM companies c LEFT JOIN affects a ON a.company_id = c.company_id GROUP BY ALL) z)"


def _nodes(g: Graph) -> DataFrame:
    n = g.affects.groupBy("company_id").agg(F.count(F.lit(1)).alias("n"))
    return g.companies.join(n, "company_id", "left").select("company_id", "source_rank", F.when(F.col("company_id") % 4 == 0, 0).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("strength"))


@query("network_layout", f"WITH v AS {_NODES}, p AS (SELECT company_id, strength, strength = 0 AS is_isolate, row_number() OVER (PARTITION BY strength = 0 ORDER BY company_id::VARCHAR) - 1 AS i, count(*) OVER (PARTITION BY strength = 0) AS n, max(strength) OVER () AS most FROM v) SELECT company_id, strength, is_isolate, round(CASE WHEN is_isolate THEN 100 + 1400::DOUBLE / n * (i + 0.5) ELSE 800 + 345 * cos(-pi() / 2 + 2 * pi() * i / n) END, 6)::DOUBLE AS x, round(CASE WHEN is_isolate THEN 920 ELSE 465 + 345 * sin(-pi() / 2 + 2 * pi() * i / n) END, 6)::DOUBLE AS y, round(CASE WHEN is_isolate THEN 12 ELSE 13 + 18 * sqrt(strength::DOUBLE / most) END, 6)::DOUBLE AS node_radius FROM p")
def network_layout(g: Graph) -> DataFrame:
    """Companies on a circle, those without links in a lane."""
    rows = R.network_layout(_nodes(g).select("company_id", "strength"))
    return rows.select("company_id", "strength", "is_isolate", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("node_radius", 6).alias("node_radius"))


_EDGES = "(SELECT x.company_id AS a, y.company_id AS b, count(DISTINCT x.event_id) AS weight FROM affects x JOIN affects y ON x.event_id = y.event_id AND x.company_id < y.company_id GROUP BY ALL)"


def _edges(g: Graph) -> DataFrame:
    return G.cut(G.co_occurrence(g.affects, "event_id", "company_id"))


@query("edge_style", f"WITH p AS {_EDGES} SELECT a, b, weight, round(0.8 + 1.4 * ln(1 + weight), 9) AS line_width, round(least(0.85, 0.18 + ln(1 + weight) / 5), 9) AS opacity, round(weight::DOUBLE / max(weight) OVER (), 9) AS heat FROM p")
def edge_style(g: Graph) -> DataFrame:
    """Widths, opacities and heat of the edges of a figure."""
    return R.edge_style(_edges(g)).select("a", "b", "weight", *[F.round(c, 9).alias(c) for c in ("line_width", "opacity", "heat")])


@query("top_edges", f"WITH p AS (SELECT * FROM {_EDGES} q ORDER BY weight DESC, a, b LIMIT 15) SELECT a, b, weight, weight >= 5 AS supported, round(weight::DOUBLE / max(weight) OVER (), 9) AS bar FROM p")
def top_edges(g: Graph) -> DataFrame:
    """The 15 heaviest edges, as bars."""
    return R.top_edges(_edges(g), 5).withColumn("bar", F.round("bar", 9))


@query("isolate_lane", f"WITH v AS (SELECT company_id, source_rank FROM {_NODES} q WHERE strength = 0), p AS (SELECT *, row_number() OVER (ORDER BY source_rank, company_id) - 1 AS i, count(*) OVER () AS n FROM v), c AS (SELECT *, CASE WHEN n > 12 THEN 3 WHEN n > 5 THEN 2 ELSE 1 END AS k, ceil(n::DOUBLE / CASE WHEN n > 12 THEN 3 WHEN n > 5 THEN 2 ELSE 1 END)::INT AS r FROM p) SELECT company_id, source_rank, CASE WHEN k = 1 THEN 15 WHEN k = 2 THEN [9, 21][i // r + 1] ELSE [6, 16, 26][i // r + 1] END AS x, round(CASE WHEN r = 1 THEN 50.0 ELSE 15 + (i % r)::DOUBLE / (r - 1) * 70 END, 9)::DOUBLE AS y FROM c")
def isolate_lane(g: Graph) -> DataFrame:
    """Companies without links in columns."""
    return R.isolate_lane(_nodes(g).where("strength = 0").select("company_id", "source_rank")).withColumn("y", F.round("y", 9))


@query("bipartite_projection", "SELECT 'node' AS kind, label, count(*) AS n, count(DISTINCT node) AS distinct_ends FROM (SELECT 'Company' AS label, company_id AS node FROM companies UNION ALL SELECT 'Event', event_id FROM graph_events) q GROUP BY label UNION ALL SELECT 'edge', 'Company', count(*), count(DISTINCT company_id) FROM (SELECT DISTINCT company_id, event_id FROM affects a WHERE company_id IN (SELECT company_id FROM companies) AND event_id IN (SELECT event_id FROM graph_events)) z")
def bipartite_projection(g: Graph) -> DataFrame:
    """Nodes by label, and edges from companies to events."""
    nodes, edges = R.bipartite_projection(g.companies, g.events, g.affects)
    count = F.count(F.lit(1)).alias("n")
    return nodes.groupBy(F.lit("node").alias("kind"), "label").agg(count, F.countDistinct("node").alias("distinct_ends")).unionByName(edges.agg(F.lit("edge").alias("kind"), F.lit("Company").alias("label"), count, F.countDistinct("source").alias("distinct_ends")))


@query("size_report", "SELECT 'companies' AS name, count(*) AS n_rows FROM companies UNION ALL SELECT 'events', count(*) FROM graph_events UNION ALL SELECT 'affects', count(*) FROM affects UNION ALL SELECT 'observations', count(*) FROM observations")
def size_report(g: Graph) -> DataFrame:
    return R.size_report({"companies": g.companies, "events": g.events, "affects": g.affects, "observations": g.observations})


_MARKET = "(SELECT observation_id, c.company_id + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS company_id, o.asset_id FROM observations o JOIN companies c ON c.asset_id = o.asset_id)"


@query("asset_mismatches", f"WITH m AS {_MARKET} SELECT observation_id, m.company_id, m.asset_id, c.asset_id AS expected_asset_id FROM m LEFT JOIN companies c ON c.company_id = m.company_id WHERE m.asset_id IS DISTINCT FROM c.asset_id")
def asset_mismatches(g: Graph) -> DataFrame:
    """Market rows whose asset is not their company's."""
    market = g.observations.join(g.companies.select("company_id", "asset_id"), "asset_id").select("observation_id", (F.col("company_id") + F.when(F.col("event_id") % 10 == 0, 1).otherwise(0)).alias("company_id"), "asset_id")
    return R.asset_mismatches(market, g.companies).select("observation_id", "company_id", "asset_id", "expected_asset_id")


@query("snapshot_rejects", """WITH e AS (SELECT event_id, event_date FROM graph_events WHERE event_id % 11 > 0) SELECT 'outside_months' AS reason, event_id::VARCHAR AS key FROM e WHERE strftime(event_date, '%Y-%m') NOT BETWEEN '1993-01' AND '1996-06' UNION ALL SELECT DISTINCT 'unknown_end', concat(company_id, '/', event_id) FROM affects WHERE event_id NOT IN (SELECT event_id FROM e) UNION ALL SELECT 'repeated_link', concat(company_id, '/', event_id) FROM affects GROUP BY company_id, event_id HAVING count(*) > 1""")
def snapshot_rejects(g: Graph) -> DataFrame:
    """What a snapshot of some months may not hold."""
    return R.snapshot_rejects(g.events.where("event_id % 11 > 0"), g.affects, g.companies, "1993-01", "1996-06")


@query("overview_recent", "SELECT a.event_id, a.company_id, l_linenumber, event_date, prob FROM affects a JOIN graph_events e ON e.event_id = a.event_id JOIN companies c ON c.company_id = a.company_id WHERE prob >= 0.8 ORDER BY event_date DESC, a.event_id, a.company_id, l_linenumber LIMIT 5")
def overview_recent(g: Graph) -> DataFrame:
    """The five latest links of high probability."""
    return R.overview(g.affects, g.events, g.companies)[0].select("event_id", "company_id", "l_linenumber", "event_date", "prob")


@query("overview_types", "SELECT coalesce(event_type, 'other') AS event_type, count(*) AS n FROM affects a LEFT JOIN graph_events e ON e.event_id = a.event_id GROUP BY 1")
def overview_types(g: Graph) -> DataFrame:
    return R.overview(g.affects, g.events, g.companies)[1]


@query("overview_top", "SELECT c.company_id, source_rank, count(DISTINCT event_id) AS event_count FROM companies c LEFT JOIN affects a ON a.company_id = c.company_id GROUP BY ALL ORDER BY event_count DESC, source_rank, c.company_id LIMIT 7")
def overview_top(g: Graph) -> DataFrame:
    return R.overview(g.affects, g.events, g.companies.select("company_id", "source_rank"))[2]



@query("model_prompts", r"""WITH t AS (SELECT doc_id, trim(regexp_replace(split_part(coalesce(text, ''), chr(10), 1), '\s+', ' ', 'g')) AS head, coalesce(text, '') AS body, coalesce(source, '') AS source FROM documents)
SELECT doc_id, substring(concat('Evidence-grounded title: ', head, chr(10), 'Evidence span: ', trim(regexp_replace(body, '\s+', ' ', 'g'))), 1, 1800) AS event_prompt, concat('Company under assessment: ', source, '.', chr(10), 'Sentence: ', split_part(body, chr(10), 1)) AS relation_prompt, concat_ws(chr(10), nullif(source, ''), nullif(split_part(body, chr(10), 1), ''), nullif(body, '')) AS search_text FROM t""")
def model_prompts(g: Graph) -> DataFrame:
    """What models are asked, and what articles are searched by."""
    body, head = F.coalesce("text", F.lit("")), F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)
    return g.table("documents").select("doc_id", X.event_prompt(head, body).alias("event_prompt"), X.relation_prompt(F.col("source"), head).alias("relation_prompt"), X.search_text(F.col("source"), head, F.lit("<p> </p>"), body).alias("search_text"))


@query("unique_texts", r"""WITH p AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), ' ')) AS w, generate_subscripts(string_split(coalesce(text, ''), ' '), 1) AS i FROM documents), c AS (SELECT doc_id, i, substring(trim(regexp_replace(w, '\s+', ' ', 'g')), 1, 4) AS w FROM p), f AS (SELECT doc_id, i, w, row_number() OVER (PARTITION BY doc_id, lower(w) ORDER BY i) AS k FROM c WHERE w <> ''), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM f WHERE k = 1)
SELECT d.doc_id, coalesce(string_agg(n.w, '|' ORDER BY n.i), '') AS texts FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id AND r <= 12 GROUP BY d.doc_id""")
def unique_texts(g: Graph) -> DataFrame:
    """The first twelve distinct words of every text, clipped to four letters."""
    return g.table("documents").select("doc_id", F.array_join(X.unique_texts(F.split(F.coalesce("text", F.lit("")), " ", -1), 12, 4), "|").alias("texts"))


@query("simple_sentences", r"""WITH p AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1) || '|\n+')) AS s FROM documents), c AS (SELECT doc_id, trim(regexp_replace(s, '\s+', ' ', 'g')) AS s FROM p) SELECT doc_id, count(*) FILTER (s <> '') AS n, coalesce(sum(length(s)), 0)::BIGINT AS characters FROM c GROUP BY doc_id""")
def simple_sentences(g: Graph) -> DataFrame:
    """How many parts every text has between sentence ends and line breaks, and their length."""
    rows = g.table("documents").select("doc_id", X.simple_sentences(F.col("text")).alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("characters"))


ALIAS_RULES = (
    "SELECT company_id, CASE WHEN company_id % 3 = 0 THEN array('Supplier 0') ELSE array() END AS excluded, CASE WHEN company_id % 2 = 0 THEN array('brand ', ' ') ELSE array() END AS products, array('Brand', 'EXTRA', 'extra', '') AS additional, CASE WHEN company_id % 5 = 0 THEN array('Extra') ELSE array() END AS strict FROM companies"
)


@query("alias_dimension", """WITH n AS (SELECT company_id, unnest(['Supplier 0', company, upper(company), 'Brand', 'EXTRA', 'extra']) AS alias, unnest([0, 1, 2, 3, 4, 5]) AS position FROM companies), f AS (SELECT *, row_number() OVER (PARTITION BY company_id, lower(alias) ORDER BY position) AS k FROM n WHERE NOT (company_id % 3 = 0 AND lower(alias) = 'supplier 0'))
SELECT company_id, position, alias, CASE WHEN company_id % 2 = 0 AND lower(alias) = 'brand' THEN 'product' ELSE 'core' END AS kind, company_id % 5 = 0 AND lower(alias) = 'extra' AS strict_case FROM f WHERE k = 1""")
def alias_dimension(g: Graph) -> DataFrame:
    """The names that companies are matched by, after exclusions and additions."""
    names = g.companies.select("company_id", F.array(F.lit("Supplier 0"), F.col("company"), F.upper("company")).alias("aliases"))
    return X.alias_dimension(names, g.spark.sql(ALIAS_RULES.replace("companies", "{c}"), c=g.companies))


@query("queried_and_matched", """WITH q AS (SELECT event_id, company_id FROM affects WHERE recommended), m AS (SELECT event_id, company_id FROM affects WHERE prob >= 0.5), u AS (SELECT * FROM q UNION SELECT * FROM m) SELECT e.event_id, coalesce(string_agg(u.company_id::VARCHAR, '|' ORDER BY u.company_id::VARCHAR), '') AS company_ids FROM graph_events e LEFT JOIN u ON u.event_id = e.event_id GROUP BY e.event_id""")
def queried_and_matched(g: Graph) -> DataFrame:
    """The companies of each event that were asked for or named."""
    c = F.col("company_id").cast("string")
    lists = g.affects.groupBy("event_id").agg(F.collect_set(F.when(F.col("recommended"), c)).alias("q"), F.collect_set(F.when(F.col("prob") >= 0.5, c)).alias("m"))
    return g.events.select("event_id").join(lists, "event_id", "left").select("event_id", F.array_join(X.union_ids(F.col("q"), F.col("m")), "|").alias("company_ids"))


@query("unescaped", "SELECT doc_id, concat('<', coalesce(source, ''), '> & © é ', chr(128512), ' &nope;') AS plain FROM documents")
def unescaped(g: Graph) -> DataFrame:
    """Character references of every kind, decoded."""
    return g.table("documents").select("doc_id", X.unescape(F.concat(F.lit("&lt;"), F.coalesce("source", F.lit("")), F.lit("&gt; &amp; &copy; &#xE9; &#128512; &nope;"))).alias("plain"))


@query("automatic_checks", """WITH l AS (SELECT event_id, company_id, source_event_id, recommended FROM affects), d AS (SELECT coalesce(sum(n - 1), 0)::BIGINT AS n FROM (SELECT count(*) AS n FROM l GROUP BY event_id, company_id) z), c AS (SELECT 'canonical_company_coverage' AS metric, (SELECT count(DISTINCT company_id) FROM l WHERE recommended) AS actual, (SELECT count(*) FROM companies) AS expected UNION ALL SELECT 'duplicate_canonical_event_ids', (SELECT count(*) - count(DISTINCT event_id) FROM graph_events), 0 UNION ALL SELECT 'duplicate_canonical_event_company_pairs', (SELECT n FROM d), 0
UNION ALL SELECT 'canonical_relationships_without_source_event', (SELECT count(*) FROM l WHERE source_event_id IS NULL), 0 UNION ALL SELECT 'current_threshold_reconstruction', 1, 1 UNION ALL SELECT 'graph_validation_failures', (SELECT count(*) FROM graph_events WHERE event_type = '5-LOW'), 0) SELECT metric, CASE WHEN actual = expected THEN 'PASS' ELSE 'FAIL' END AS status, actual, expected FROM c""")
def automatic_checks(g: Graph) -> DataFrame:
    """Checks of canonical rows, the threshold study and the graph's validation."""
    study = g.spark.createDataFrame([(True, True), (False, False)], "current boolean, same_as_current boolean")
    validation = g.events.select(F.when(F.col("event_type") == "5-LOW", "FAIL").otherwise("PASS").alias("status"))
    return R.automatic_checks(g.companies, g.events, g.affects, study, validation)


@query("measure_correlations", f"""WITH p AS {_EDGES}, w AS (SELECT a, b, weight FROM p UNION ALL SELECT b, a, weight FROM p), m AS (SELECT c.company_id, (SELECT count(*) FROM affects x WHERE x.company_id = c.company_id)::DOUBLE AS event_count, (SELECT count(*) FROM w WHERE w.a = c.company_id)::DOUBLE AS coevent_degree, (SELECT coalesce(sum(weight), 0) FROM w WHERE w.a = c.company_id)::DOUBLE AS coevent_strength, (c.company_id * 7 % 13)::DOUBLE AS page_rank FROM companies c),
r AS (SELECT *, (rank() OVER (ORDER BY event_count) + (count(*) OVER (PARTITION BY event_count) - 1) / 2.0)::DOUBLE AS re, (rank() OVER (ORDER BY coevent_degree) + (count(*) OVER (PARTITION BY coevent_degree) - 1) / 2.0)::DOUBLE AS rd, (rank() OVER (ORDER BY coevent_strength) + (count(*) OVER (PARTITION BY coevent_strength) - 1) / 2.0)::DOUBLE AS rs, (rank() OVER (ORDER BY page_rank) + (count(*) OVER (PARTITION BY page_rank) - 1) / 2.0)::DOUBLE AS rp FROM m),
z AS (SELECT 'event_count' AS metric_1, 'coevent_degree' AS metric_2, count(*) AS n, corr(event_count, coevent_degree) AS p, corr(re, rd) AS s FROM r UNION ALL SELECT 'event_count', 'coevent_strength', count(*), corr(event_count, coevent_strength), corr(re, rs) FROM r UNION ALL SELECT 'coevent_degree', 'coevent_strength', count(*), corr(coevent_degree, coevent_strength), corr(rd, rs) FROM r UNION ALL SELECT 'coevent_strength', 'page_rank', count(*), corr(coevent_strength, page_rank), corr(rs, rp) FROM r)
SELECT metric_1, metric_2, n, CASE WHEN isnan(p) THEN NULL ELSE round(p, 6) END AS pearson, CASE WHEN isnan(s) THEN NULL ELSE round(s, 6) END AS spearman FROM z""")
def measure_correlations(g: Graph) -> DataFrame:
    """How four pairs of companies' measures go together."""
    own = g.affects.groupBy("company_id").agg(F.count(F.lit(1)).alias("event_count"))
    shape = G.structure(g.companies.select(F.col("company_id").alias("node")), _edges(g)).select(F.col("node").alias("company_id"), F.col("degree").alias("coevent_degree"), F.col("strength").alias("coevent_strength"))
    rows = g.companies.select("company_id").join(own, "company_id", "left").join(shape, "company_id").select(F.coalesce("event_count", F.lit(0)).alias("event_count"), "coevent_degree", "coevent_strength", F.pmod(F.col("company_id") * 7, F.lit(13)).alias("page_rank"))
    return R.correlation_rows(rows).select("metric_1", "metric_2", "n", F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"))


@query("company_event_sets", """WITH o AS (SELECT DISTINCT company_id, a.event_id, event_type, event_date FROM affects a JOIN graph_events e ON e.event_id = a.event_id), t AS (SELECT company_id, event_type, count(*) AS n, min(event_date) AS lo, max(event_date) AS hi FROM o GROUP BY ALL) SELECT company_id, sum(n)::BIGINT AS events, string_agg(concat(event_type, '=', n), '; ' ORDER BY concat(event_type, '=', n)) AS types, min(lo) AS first_date, max(hi) AS latest_date FROM t GROUP BY company_id""")
def company_event_sets(g: Graph) -> DataFrame:
    """What an answer about each company rests on: its events by type, and when."""
    return R.event_set(g.affects, g.events, ["company_id"])


@query("pair_event_sets", f"""WITH one AS (SELECT DISTINCT event_id, company_id FROM affects), o AS (SELECT x.company_id AS a, y.company_id AS b, x.event_id, event_type, event_date FROM one x JOIN one y ON x.event_id = y.event_id AND x.company_id < y.company_id JOIN graph_events e ON e.event_id = x.event_id), t AS (SELECT a, b, event_type, count(*) AS n, min(event_date) AS lo, max(event_date) AS hi FROM o GROUP BY ALL) SELECT a, b, sum(n)::BIGINT AS events, string_agg(concat(event_type, '=', n), '; ' ORDER BY concat(event_type, '=', n)) AS types, min(lo) AS first_date, max(hi) AS latest_date FROM t GROUP BY a, b""")
def pair_event_sets(g: Graph) -> DataFrame:
    """What an answer about each pair of companies rests on: the events that they share."""
    one = g.affects.select("event_id", "company_id").distinct()
    pairs = one.select("event_id", F.col("company_id").alias("a")).join(one.select("event_id", F.col("company_id").alias("b")), "event_id").where("a < b")
    return R.event_set(pairs, g.events, ["a", "b"])


@query("company_months", """WITH m AS (SELECT strftime(d, '%Y-%m') AS month FROM generate_series(DATE '1993-01-01', DATE '1994-12-01', INTERVAL 1 MONTH) t(d)), o AS (SELECT DISTINCT company_id, a.event_id, event_date FROM affects a JOIN graph_events e ON e.event_id = a.event_id WHERE event_date BETWEEN DATE '1993-01-05' AND DATE '1994-12-20'), c AS (SELECT company_id, strftime(event_date, '%Y-%m') AS month, count(*) AS n FROM o GROUP BY ALL)
SELECT k.company_id, m.month, coalesce(n, 0) AS n FROM companies k CROSS JOIN m LEFT JOIN c ON c.company_id = k.company_id AND c.month = m.month""")
def company_months(g: Graph) -> DataFrame:
    """Every company's events month by month."""
    return R.company_months(g.affects, g.events, g.companies, "1993-01-05", "1994-12-20")


@query("collected_articles", """WITH f AS (SELECT article_id, min(event_id) AS e, string_agg(DISTINCT company_id::VARCHAR, '|' ORDER BY company_id::VARCHAR) AS members FROM reports r JOIN affects a USING (event_id) GROUP BY article_id) SELECT article_id, members, row_number() OVER (ORDER BY e, article_id) AS place FROM (SELECT * FROM f ORDER BY e, article_id LIMIT 400) z""")
def collected_articles(g: Graph) -> DataFrame:
    """The first 400 articles of a collection with a cap, each with the companies that brought it."""
    rows = g.reports.select("article_id", "event_id").join(g.affects.select("event_id", F.col("company_id").cast("string").alias("company_id")), "event_id")
    return A.collected(rows, "article_id", "company_id", ["event_id"], 400).select("article_id", F.array_join("members", "|").alias("members"), "place")


@query("link_value_counts", "SELECT 'link_confidence' AS field, status AS value, count(*) AS n FROM affects GROUP BY status UNION ALL SELECT 'recommended', recommended::VARCHAR, count(*) FROM affects GROUP BY recommended UNION ALL SELECT 'source_event', CASE WHEN source_event_id IS NULL THEN NULL ELSE 'known' END, count(*) FROM affects GROUP BY ALL")
def link_value_counts(g: Graph) -> DataFrame:
    """How often each status, decision and kind of source stands among the links."""
    rows = g.affects.select(F.col("status").alias("link_confidence"), "recommended", F.when(F.col("source_event_id").isNotNull(), "known").alias("source_event"))
    return T.value_counts(rows, ["link_confidence", "recommended", "source_event"])


@query("shared_event_support", """WITH one AS (SELECT event_id, company_id, bool_or(trim(evidence) <> '') AS ok FROM affects GROUP BY ALL), p AS (SELECT x.company_id AS a, y.company_id AS b, count(*) AS shared, sum((x.ok AND y.ok)::INT)::BIGINT AS evidenced, string_agg(x.event_id::VARCHAR, '|' ORDER BY x.event_id::VARCHAR) AS ids FROM one x JOIN one y ON x.event_id = y.event_id AND x.company_id < y.company_id GROUP BY ALL) SELECT a, b, shared, evidenced, sha256(ids) AS ids_sha256 FROM p WHERE shared >= 2""")
def shared_event_support(g: Graph) -> DataFrame:
    """Pairs with enough shared events: the events are listed, opened again and held against both companies' links."""
    one = g.affects.groupBy("event_id", "company_id").agg(F.bool_or(F.trim("evidence") != "").alias("ok"))
    ends = one.select("event_id", "company_id")
    lists = ends.withColumnRenamed("company_id", "a").join(ends.withColumnRenamed("company_id", "b"), "event_id").where("a < b").groupBy("a", "b").agg(F.collect_set("event_id").alias("ids")).where(F.size("ids") >= 2)
    opened = lists.select("a", "b", F.explode("ids").alias("event_id"))
    left, right = (one.select("event_id", F.col("company_id").alias(c), F.col("ok").alias(f"ok_{c}")) for c in ("a", "b"))
    met = opened.join(left, ["event_id", "a"]).join(right, ["event_id", "b"])
    ids = F.array_join(F.array_sort(F.transform(F.collect_set("event_id"), lambda x: x.cast("string"))), "|")
    return met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.sum((F.col("ok_a") & F.col("ok_b")).cast("long")).alias("evidenced"), F.sha2(ids, 256).alias("ids_sha256"))
