"""Queries of the graph: summaries, evidence, market context, integrity, analyst tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import nonblank
from ..operators import graph as G
from ..operators.filters import filtered, provenance_match
from .catalog import query
from .proxy import Graph


def company_event_summary(g: Graph, **filters) -> DataFrame:
    """Every company with its distinct events, links and mean focus; filters stand inside the outer join, so none is lost."""
    links = filtered(g.affects.join(g.events.select("event_id", "event_type", "event_date"), "event_id"), **filters)
    out = g.companies.join(links.select("company_id", "event_id", "focus"), "company_id", "left").groupBy("company_id", "company", "source_rank")
    out = out.agg(F.countDistinct("event_id").alias("event_count"), F.count("event_id").alias("link_count"), F.round(F.avg("focus"), 6).alias("average_focus"))
    return out.withColumn("coverage_status", F.when(F.col("event_count") == 0, "no_qualified_events").otherwise("covered"))


SUMMARY = """SELECT c.company_id, company, source_rank, count(DISTINCT a.event_id) AS event_count, count(a.event_id) AS link_count, round(avg(focus), 6) AS average_focus,
CASE WHEN count(a.event_id) = 0 THEN 'no_qualified_events' ELSE 'covered' END AS coverage_status
FROM companies c LEFT JOIN (SELECT a.*, event_type, event_date FROM affects a JOIN graph_events e USING (event_id) WHERE {where}) a ON a.company_id = c.company_id GROUP BY c.company_id, company, source_rank"""

query("company_event_summary", SUMMARY.format(where="TRUE"))(company_event_summary)
query("company_event_summary_filtered", SUMMARY.format(where="event_type = '1-URGENT' AND event_date >= DATE '1995-01-01' AND event_date <= DATE '1995-03-31' AND prob >= 0.8"))(
    lambda g: company_event_summary(g, event_type="1-URGENT", start="1995-01-01", end="1995-03-31", least_probability=0.8)
)

MATCH = "(r.source_event_id = a.source_event_id OR (a.source_event_id IS NULL AND coalesce(r.is_representative, TRUE)))"


@query("event_evidence_trace", f"""SELECT a.event_id, title, event_type, a.company_id, company, focus, evidence, r.article_id, url FROM affects a JOIN graph_events e ON e.event_id = a.event_id JOIN companies c ON c.company_id = a.company_id
JOIN reports r ON r.event_id = a.event_id AND {MATCH} WHERE event_type = '2-HIGH' ORDER BY focus DESC, a.event_id, a.company_id, l_linenumber, r.article_id LIMIT 1500""")
def event_evidence_trace(g: Graph) -> DataFrame:
    """Links with their events, companies and matching reports; the best 1,500."""
    rows = g.affects.withColumnRenamed("source_event_id", "sid").join(g.events.where("event_type = '2-HIGH'").select("event_id", "title", "event_type"), "event_id").join(g.companies.select("company_id", "company"), "company_id")
    rows = rows.join(g.reports, "event_id").where(provenance_match(F.col("source_event_id"), F.col("sid"), F.col("is_representative")))
    rows = rows.orderBy(F.col("focus").desc(), "event_id", "company_id", "l_linenumber", "article_id").limit(1500)
    return rows.select("event_id", "title", "event_type", "company_id", "company", "focus", "evidence", "article_id", "url")


@query("event_market_summary", """SELECT c.company_id, company, event_type, window_days, count(*) AS n, round(avg(cumulative_return) * 100, 6) AS mean_pct, round(quantile_cont(cumulative_return, 0.5) * 100, 6) AS median_pct,
round(avg(CASE WHEN cumulative_return > 0 THEN 1.0 ELSE 0.0 END) * 100, 6) AS positive_pct, FALSE AS causal_claim FROM (SELECT DISTINCT event_id, company_id FROM affects) a JOIN graph_events e USING (event_id) JOIN companies c USING (company_id)
JOIN observations o ON o.event_id = a.event_id AND o.asset_id = c.asset_id GROUP BY c.company_id, company, event_type, window_days""")
def event_market_summary(g: Graph) -> DataFrame:
    """Returns by company, type and window, of observations that hang off both the event and the company's asset."""
    links = g.affects.select("event_id", "company_id").distinct().join(g.companies.select("company_id", "company", "asset_id"), "company_id")
    rows = g.observations.join(links, ["event_id", "asset_id"]).join(g.events.select("event_id", "event_type"), "event_id")
    r = F.col("cumulative_return")
    return rows.groupBy("company_id", "company", "event_type", "window_days").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(r) * 100, 6).alias("mean_pct"), F.round(F.percentile(r, 0.5) * 100, 6).alias("median_pct"), F.round(F.avg((r > 0).cast("double")) * 100, 6).alias("positive_pct"), F.lit(False).alias("causal_claim"))


@query("market_context", """SELECT a.event_id, a.company_id, window_days, baseline_close, cumulative_return FROM (SELECT DISTINCT event_id, company_id FROM affects WHERE prob >= 0.9) a JOIN companies c USING (company_id)
JOIN observations o ON o.event_id = a.event_id AND o.asset_id = c.asset_id WHERE window_days IN (-1, 1)""")
def market_context(g: Graph) -> DataFrame:
    links = g.affects.where("prob >= 0.9 AND NOT isnan(prob)").select("event_id", "company_id").distinct().join(g.companies.select("company_id", "asset_id"), "company_id")
    rows = g.observations.where(F.col("window_days").isin(-1, 1)).join(links, ["event_id", "asset_id"])
    return rows.select("event_id", "company_id", "window_days", "baseline_close", "cumulative_return")


@query("companies_with_symbol", "SELECT company_id, company, country, r_name AS sector, min(asset_id) AS symbol FROM companies JOIN region ON r_regionkey = sector_id GROUP BY ALL")
def companies_with_symbol(g: Graph) -> DataFrame:
    return g.companies.join(g.table("region"), F.col("sector_id") == F.col("r_regionkey")).groupBy("company_id", "company", "country", F.col("r_name").alias("sector")).agg(F.min("asset_id").alias("symbol"))


@query("canonical_events_minprob", """SELECT a.event_id, a.company_id, l_linenumber, prob, r.article_id IS NOT NULL AS source_report_matched, r.article_id FROM affects a LEFT JOIN reports r ON r.event_id = a.event_id AND r.source_event_id = a.source_event_id WHERE prob >= 0.8""")
def canonical_events_minprob(g: Graph) -> DataFrame:
    """Links of enough probability with the report they came from, if it stands."""
    links = g.affects.where("prob >= 0.8 AND NOT isnan(prob)").select("event_id", "company_id", "l_linenumber", "prob", "source_event_id")
    rows = links.join(g.reports.select("event_id", "source_event_id", "article_id"), ["event_id", "source_event_id"], "left")
    return rows.select("event_id", "company_id", "l_linenumber", "prob", F.col("article_id").isNotNull().alias("source_report_matched"), "article_id")


@query("source_evidence", """SELECT r.event_id, r.article_id, url, is_representative, a.company_id, CASE WHEN a.source_event_id IS NULL THEN NULL ELSE r.source_event_id = a.source_event_id END AS is_relationship_source FROM reports r JOIN (SELECT DISTINCT event_id, company_id, source_event_id FROM affects) a ON a.event_id = r.event_id""")
def source_evidence(g: Graph) -> DataFrame:
    """Every report of every linked event; whether it is the link's source is null where the link names none."""
    links = g.affects.select("event_id", "company_id", F.col("source_event_id").alias("sid")).distinct()
    return g.reports.join(links, "event_id").select("event_id", "article_id", "url", "is_representative", "company_id", (F.col("source_event_id") == F.col("sid")).alias("is_relationship_source"))


@query("label_counts", """SELECT 'Company' AS label, count(*) AS n FROM companies UNION ALL SELECT 'Event', count(*) FROM graph_events UNION ALL SELECT 'Article', count(DISTINCT article_id) FROM reports UNION ALL SELECT 'MarketObservation', count(*) FROM observations
UNION ALL SELECT 'POTENTIALLY_AFFECTS', count(*) FROM (SELECT DISTINCT event_id, company_id FROM affects) UNION ALL SELECT 'REPORTS', count(*) FROM reports UNION ALL SELECT 'ISSUES', count(*) FROM companies""")
def label_counts(g: Graph) -> DataFrame:
    """Nodes by label and relationships by type, edges as sets."""
    parts = {"Company": g.companies, "Event": g.events, "Article": g.reports.select("article_id").distinct(), "MarketObservation": g.observations, "POTENTIALLY_AFFECTS": g.affects.select("event_id", "company_id").distinct(), "REPORTS": g.reports, "ISSUES": g.companies}
    out = None
    for label, df in parts.items():
        row = df.agg(F.lit(label).alias("label"), F.count(F.lit(1)).alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def _counted(name: str, df: DataFrame) -> DataFrame:
    return df.agg(F.lit(name).alias("check_name"), F.count(F.lit(1)).alias("violations"))


@query("integrity_checks", f"""SELECT 'event_without_article' AS check_name, count(*) AS violations FROM graph_events e WHERE NOT EXISTS (SELECT 1 FROM reports r WHERE r.event_id = e.event_id)
UNION ALL SELECT 'event_without_company', count(*) FROM graph_events e WHERE NOT EXISTS (SELECT 1 FROM affects a WHERE a.event_id = e.event_id)
UNION ALL SELECT 'link_without_evidence', count(*) FROM affects WHERE trim(coalesce(evidence, '')) = ''
UNION ALL SELECT 'link_without_report', count(*) FROM affects a WHERE NOT EXISTS (SELECT 1 FROM reports r WHERE r.event_id = a.event_id AND {MATCH})
UNION ALL SELECT 'observation_without_link', count(*) FROM observations o WHERE NOT EXISTS (SELECT 1 FROM affects a JOIN companies c USING (company_id) WHERE a.event_id = o.event_id AND c.asset_id = o.asset_id)
UNION ALL SELECT 'report_without_url', count(*) FROM reports WHERE trim(url) = ''
UNION ALL SELECT 'duplicate_links', coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM affects GROUP BY event_id, company_id HAVING count(*) > 1)
UNION ALL SELECT 'source_count_mismatch', count(*) FROM (SELECT e.event_id FROM graph_events e LEFT JOIN reports r USING (event_id) GROUP BY e.event_id, stored_sources HAVING stored_sources <> count(DISTINCT coalesce(r.source_event_id, e.event_id)))
UNION ALL SELECT 'unknown_company', count(*) FROM affects a WHERE NOT EXISTS (SELECT 1 FROM companies c WHERE c.company_id = a.company_id)""")
def integrity_checks(g: Graph) -> DataFrame:
    links = g.affects.withColumnRenamed("source_event_id", "sid")
    r = g.reports.select(F.col("event_id").alias("rid"), "source_event_id", "is_representative")
    unmatched = links.join(r, (F.col("event_id") == F.col("rid")) & provenance_match(F.col("source_event_id"), F.col("sid"), F.col("is_representative")), "left_anti")
    held = g.affects.join(g.companies.select("company_id", "asset_id"), "company_id").select("event_id", "asset_id")
    repeats = g.affects.groupBy("event_id", "company_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.lit("duplicate_links").alias("check_name"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations"))
    sources = g.events.select("event_id", "stored_sources").join(g.reports.select("event_id", "source_event_id"), "event_id", "left").groupBy("event_id", "stored_sources").agg(F.countDistinct(F.coalesce("source_event_id", "event_id")).alias("n")).where("stored_sources <> n")
    out = _counted("event_without_article", g.events.join(g.reports, "event_id", "left_anti"))
    for more in (
        _counted("event_without_company", g.events.join(g.affects, "event_id", "left_anti")),
        _counted("link_without_evidence", g.affects.where(~nonblank(F.col("evidence")))),
        _counted("link_without_report", unmatched),
        _counted("observation_without_link", g.observations.join(held, ["event_id", "asset_id"], "left_anti")),
        _counted("report_without_url", g.reports.where(~nonblank(F.col("url")))),
        repeats,
        _counted("source_count_mismatch", sources),
        _counted("unknown_company", g.affects.join(g.companies, "company_id", "left_anti")),
    ):
        out = out.unionByName(more)
    return out


@query("validation_report", """WITH actual AS (SELECT 'Company' AS item, count(*) AS actual FROM companies UNION ALL SELECT 'Event', count(*) FROM graph_events UNION ALL SELECT 'Market', count(*) FROM observations),
expected AS (SELECT 'Company' AS item, count(*) AS expected FROM supplier UNION ALL SELECT 'Event', count(*) FROM orders UNION ALL SELECT 'Person', 3)
SELECT coalesce(a.item, e.item) AS item, coalesce(expected, 0) AS expected, coalesce(actual, 0) AS actual, CASE WHEN coalesce(expected, 0) = coalesce(actual, 0) THEN 'PASS' ELSE 'FAIL' END AS status FROM actual a FULL JOIN expected e ON a.item = e.item""")
def validation_report(g: Graph) -> DataFrame:
    """Expected against loaded counts; what either side lacks counts 0."""
    count = lambda name, df: df.agg(F.lit(name).alias("item"), F.count(F.lit(1)).alias("n"))
    actual = count("Company", g.companies).unionByName(count("Event", g.events)).unionByName(count("Market", g.observations)).withColumnRenamed("n", "actual")
    expected = count("Company", g.table("supplier")).unionByName(count("Event", g.table("orders"))).unionByName(g.spark.range(1).select(F.lit("Person").alias("item"), F.lit(3).cast("long").alias("n"))).withColumnRenamed("n", "expected")
    both = expected.join(actual, "item", "full_outer").select("item", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual"))
    return both.withColumn("status", F.when(F.col("expected") == F.col("actual"), "PASS").otherwise("FAIL"))


@query("database_totals", "SELECT (SELECT count(*) FROM graph_events) + (SELECT count(*) FROM companies) AS nodes, (SELECT count(*) FROM affects) AS relationships")
def database_totals(g: Graph) -> DataFrame:
    """Both totals in one row, 0 where there is nothing."""
    n = g.events.select("event_id").unionByName(g.companies.select(F.col("company_id").alias("event_id"))).agg(F.count(F.lit(1)).alias("nodes"))
    return n.join(g.affects.agg(F.count(F.lit(1)).alias("relationships")))


@query("task1_screening", """SELECT c.company_id, company, source_rank, min(asset_id) AS symbol, count(DISTINCT event_id) AS event_count, count(DISTINCT CASE WHEN trim(evidence) <> '' THEN event_id END) AS evidenced_event_count FROM companies c LEFT JOIN affects a USING (company_id) GROUP BY c.company_id, company, source_rank""")
def task1_screening(g: Graph) -> DataFrame:
    """Every company with its events, and those with evidence; links become one row for each pair before anything is counted."""
    one = g.affects.groupBy("company_id", "event_id").agg(F.bool_or(nonblank(F.col("evidence"))).alias("evidenced"))
    n = one.groupBy("company_id").agg(F.count("event_id").alias("event_count"), F.count(F.when(F.col("evidenced"), F.col("event_id"))).alias("evidenced_event_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return g.companies.join(n, "company_id", "left").select("company_id", "company", "source_rank", F.col("asset_id").alias("symbol"), zero("event_count"), zero("evidenced_event_count"))


@query("task2_dossier", f"""SELECT a.company_id, a.event_id, a.l_linenumber, evidence, count(r.article_id) AS matching_source_count, count(DISTINCT CASE WHEN trim(url) <> '' THEN url END) AS source_url_count, coalesce(string_agg(DISTINCT CASE WHEN trim(url) <> '' THEN url END, ' ' ORDER BY CASE WHEN trim(url) <> '' THEN url END), '') AS urls
FROM affects a LEFT JOIN reports r ON r.event_id = a.event_id AND {MATCH} WHERE a.company_id = 7 GROUP BY a.company_id, a.event_id, a.l_linenumber, evidence""")
def task2_dossier(g: Graph) -> DataFrame:
    """One company's events with the reports behind each."""
    links = g.affects.where("company_id = 7").select("company_id", "event_id", "l_linenumber", "evidence", F.col("source_event_id").alias("sid"))
    r = g.reports.select(F.col("event_id").alias("rid"), "source_event_id", "is_representative", "article_id", F.when(nonblank(F.col("url")), F.col("url")).alias("url"))
    rows = links.join(r, (F.col("event_id") == F.col("rid")) & provenance_match(F.col("source_event_id"), F.col("sid"), F.col("is_representative")), "left")
    return rows.groupBy("company_id", "event_id", "l_linenumber", "evidence").agg(F.count("article_id").alias("matching_source_count"), F.countDistinct("url").alias("source_url_count"), F.array_join(F.array_sort(F.collect_set("url")), " ").alias("urls"))


@query("task3_alerts", """SELECT a.company_id, a.event_id, l_linenumber, prob, evidence, r.article_id IS NOT NULL AS source_report_matched, url AS source_url FROM affects a JOIN graph_events e ON e.event_id = a.event_id LEFT JOIN reports r ON r.event_id = a.event_id AND r.source_event_id = a.source_event_id WHERE event_type = '1-URGENT' AND prob >= 0.8""")
def task3_alerts(g: Graph) -> DataFrame:
    """Links of high probability of one type; a probability that is null or not a number is none."""
    links = g.affects.where("prob >= 0.8 AND NOT isnan(prob)").join(g.events.where("event_type = '1-URGENT'").select("event_id"), "event_id")
    rows = links.join(g.reports.select("event_id", "source_event_id", "article_id", "url"), ["event_id", "source_event_id"], "left")
    return rows.select("company_id", "event_id", "l_linenumber", "prob", "evidence", F.col("article_id").isNotNull().alias("source_report_matched"), F.col("url").alias("source_url"))


@query("task4_market_trace", """SELECT a.event_id, window_days, count(*) AS n, round(avg(cumulative_return), 6) AS mean_return, FALSE AS causal_claim FROM (SELECT DISTINCT event_id, company_id FROM affects WHERE company_id = 7) a JOIN companies c USING (company_id) JOIN observations o ON o.event_id = a.event_id AND o.asset_id = c.asset_id GROUP BY a.event_id, window_days""")
def task4_market_trace(g: Graph) -> DataFrame:
    links = g.affects.where("company_id = 7").select("event_id", "company_id").distinct().join(g.companies.select("company_id", "asset_id"), "company_id")
    return g.observations.join(links, ["event_id", "asset_id"]).groupBy("event_id", "window_days").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("cumulative_return"), 6).alias("mean_return"), F.lit(False).alias("causal_claim"))


@query("task4_window_check", """SELECT event_id, string_agg(DISTINCT window_days::VARCHAR, ',' ORDER BY window_days::VARCHAR) AS windows, count(DISTINCT window_days) = 6 AS complete FROM observations GROUP BY event_id""")
def task4_window_check(g: Graph) -> DataFrame:
    """Whether each event has exactly the windows expected."""
    rows = g.observations.groupBy("event_id").agg(F.array_sort(F.collect_set("window_days")).alias("w"))
    expected = F.array(*map(F.lit, (-7, -3, -1, 1, 3, 7)))
    return rows.select("event_id", F.array_join(F.array_sort(F.transform("w", lambda x: x.cast("string"))), ",").alias("windows"), (F.col("w") == expected).alias("complete"))


@query("task5_shared_pairs", """WITH one AS (SELECT event_id, company_id, bool_or(trim(evidence) <> '') AS evidenced FROM affects GROUP BY event_id, company_id), size AS (SELECT company_id, count(*) AS n FROM one GROUP BY company_id),
pair AS (SELECT x.company_id AS company1_id, y.company_id AS company2_id, count(*) AS shared_event_count, sum((x.evidenced AND y.evidenced)::INT)::BIGINT AS evidenced_count FROM one x JOIN one y ON x.event_id = y.event_id AND x.company_id < y.company_id GROUP BY ALL)
SELECT company1_id, company2_id, shared_event_count, evidenced_count, round(shared_event_count / (a.n + b.n - shared_event_count)::DOUBLE, 6) AS jaccard FROM pair JOIN size a ON a.company_id = company1_id JOIN size b ON b.company_id = company2_id""")
def task5_shared_pairs(g: Graph) -> DataFrame:
    """Company pairs by shared events, how many are evidenced on both sides, and their Jaccard."""
    one = g.affects.groupBy("event_id", "company_id").agg(F.max(nonblank(F.col("evidence"))).alias("evidenced"))
    size = one.groupBy("company_id").agg(F.count(F.lit(1)).alias("n"))
    x, y = one.select("event_id", F.col("company_id").alias("company1_id"), F.col("evidenced").alias("e1")), one.select("event_id", F.col("company_id").alias("company2_id"), F.col("evidenced").alias("e2"))
    pair = x.join(y, "event_id").where("company1_id < company2_id").groupBy("company1_id", "company2_id").agg(F.count(F.lit(1)).alias("shared_event_count"), F.sum((F.col("e1") & F.col("e2")).cast("int")).alias("evidenced_count"))
    both = pair.join(size.select(F.col("company_id").alias("company1_id"), F.col("n").alias("n1")), "company1_id").join(size.select(F.col("company_id").alias("company2_id"), F.col("n").alias("n2")), "company2_id")
    return both.select("company1_id", "company2_id", "shared_event_count", "evidenced_count", F.round(F.col("shared_event_count") / (F.col("n1") + F.col("n2") - F.col("shared_event_count")), 6).alias("jaccard"))


PAIRS = "pairs AS (SELECT x.company_id AS a, y.company_id AS b, count(DISTINCT x.event_id) AS weight FROM affects x JOIN affects y ON x.event_id = y.event_id AND x.company_id < y.company_id GROUP BY ALL)"


def _pairs(g: Graph) -> DataFrame:
    return G.co_occurrence(g.affects, "event_id", "company_id")


def _nodes(g: Graph) -> DataFrame:
    return g.companies.select(F.col("company_id").alias("node"))


@query("coevent_edges", f"WITH {PAIRS} SELECT a, b, weight FROM pairs")
def coevent_edges(g: Graph) -> DataFrame:
    return _pairs(g)


@query("coevent_projection", f"WITH {PAIRS}, ways AS (SELECT a, b, weight FROM pairs UNION ALL SELECT b, a, weight FROM pairs) SELECT company_id AS node, b AS neighbour, weight FROM companies LEFT JOIN ways ON a = company_id")
def coevent_projection(g: Graph) -> DataFrame:
    """Both directions of the edges, companies without any kept."""
    ways = G.both_ways(_pairs(g))
    return _nodes(g).join(ways, F.col("node") == F.col("a"), "left").select("node", F.col("b").alias("neighbour"), "weight")


@query("event_company_distribution", "SELECT companies AS company_count, count(*) AS event_count FROM (SELECT e.event_id, count(DISTINCT company_id) AS companies FROM graph_events e LEFT JOIN affects a USING (event_id) GROUP BY e.event_id) GROUP BY companies")
def event_company_distribution(g: Graph) -> DataFrame:
    per = g.events.select("event_id").join(g.affects.select("event_id", "company_id"), "event_id", "left").groupBy("event_id").agg(F.countDistinct("company_id").alias("company_count"))
    return per.groupBy("company_count").agg(F.count(F.lit(1)).alias("event_count"))


@query("structural_metrics", f"WITH {PAIRS}, ways AS (SELECT a, b, weight FROM pairs UNION ALL SELECT b, a, weight FROM pairs) SELECT company_id AS node, count(DISTINCT b) AS degree, coalesce(sum(weight), 0)::DOUBLE AS strength, count(b) = 0 AS isolate FROM companies LEFT JOIN ways ON a = company_id GROUP BY company_id")
def structural_metrics(g: Graph) -> DataFrame:
    return G.structure(_nodes(g), _pairs(g))


@query("jaccard_similarity", f"""WITH {PAIRS}, size AS (SELECT company_id, count(DISTINCT event_id) AS n FROM affects GROUP BY company_id), scored AS (SELECT a, b, weight / (x.n + y.n - weight)::DOUBLE AS s FROM pairs JOIN size x ON x.company_id = a JOIN size y ON y.company_id = b),
ways AS (SELECT a, b, s FROM scored UNION ALL SELECT b, a, s FROM scored), top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS rn FROM ways) WHERE rn <= 24)
SELECT least(a, b) AS a, greatest(a, b) AS b, round(max(s), 9) AS similarity FROM top GROUP BY ALL""")
def jaccard_similarity(g: Graph) -> DataFrame:
    """Each company's 24 most similar by shared events, pairs once."""
    return G.similarity(g.affects, "event_id", "company_id", top_k=24).select("a", "b", F.round("similarity", 9).alias("similarity"))


@query("weakly_connected", f"""WITH RECURSIVE {PAIRS}, ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach AS (SELECT company_id AS node, company_id AS root FROM companies UNION SELECT w.b, r.root FROM reach r JOIN ways w ON w.a = r.node)
SELECT node, min(root) AS component FROM reach GROUP BY node""")
def weakly_connected(g: Graph) -> DataFrame:
    return G.components(_nodes(g), _pairs(g))


REACH = "ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach AS (SELECT company_id AS node, company_id AS root FROM companies UNION SELECT w.b, r.root FROM reach r JOIN ways w ON w.a = r.node)"


@query("component_membership", f"""WITH RECURSIVE {PAIRS}, {REACH}, comp AS (SELECT node, min(root) AS component FROM reach GROUP BY node), sized AS (SELECT component, count(*) AS size, min(node) AS first FROM comp GROUP BY component),
named AS (SELECT component, size, concat('C', CASE WHEN k < 10 THEN '0' ELSE '' END, k) AS label FROM (SELECT *, row_number() OVER (ORDER BY size DESC, first) AS k FROM sized) z) SELECT label, size, string_agg(company, ' | ' ORDER BY node) AS members FROM comp JOIN named USING (component) JOIN companies ON company_id = node GROUP BY label, size""")
def component_membership(g: Graph) -> DataFrame:
    """Components named by size, with their members."""
    groups = G.relabel(G.components(_nodes(g), _pairs(g)), "C")
    return G.membership(groups, g.companies.select(F.col("company_id").alias("node"), F.col("company").alias("name")))


@query("graph_threshold_study", f"""WITH RECURSIVE {PAIRS}, t AS (SELECT unnest([20, 25, 30, 35]) AS threshold), ways AS (SELECT threshold, a, b FROM pairs JOIN t ON weight >= threshold UNION SELECT threshold, b, a FROM pairs JOIN t ON weight >= threshold), reach AS (SELECT threshold, company_id AS node, company_id AS root FROM companies, t UNION SELECT r.threshold, w.b, r.root FROM reach r JOIN ways w ON w.threshold = r.threshold AND w.a = r.node),
comp AS (SELECT threshold, node, min(root) AS c FROM reach GROUP BY ALL), sizes AS (SELECT threshold, c, count(*) AS size FROM comp GROUP BY ALL), s AS (SELECT threshold, count(*) AS n_components, max(size) AS largest, sum((size = 1)::INT)::BIGINT AS isolates, sum(size)::DOUBLE AS n FROM sizes GROUP BY threshold), e AS (SELECT t.threshold, count(p.a) AS n_edges FROM t LEFT JOIN pairs p ON weight >= threshold GROUP BY t.threshold)
SELECT s.threshold, n_edges, round(n_edges / (n * (n - 1) / 2), 6) AS density, n_components, largest, isolates FROM s JOIN e ON e.threshold = s.threshold""")
def graph_threshold_study(g: Graph) -> DataFrame:
    return G.threshold_study(_nodes(g), G.cut(_pairs(g)), [20, 25, 30, 35])


def _pagerank_sql(rounds: int) -> str:
    steps = ["r0 AS (SELECT company_id AS node, 0.15::DOUBLE AS score FROM companies)"]
    for i in range(rounds):
        steps.append(f"r{i + 1} AS MATERIALIZED (SELECT c.company_id AS node, 0.15 + 0.85 * coalesce(sum(share * score), 0) AS score FROM companies c LEFT JOIN (SELECT b, share, score FROM moves JOIN r{i} ON r{i}.node = a) m ON m.b = c.company_id GROUP BY c.company_id)")
    return f"WITH {PAIRS}, ways AS (SELECT a, b, weight FROM pairs UNION ALL SELECT b, a, weight FROM pairs), moves AS MATERIALIZED (SELECT a, b, weight / (sum(weight) OVER (PARTITION BY a))::DOUBLE AS share FROM ways), " + ", ".join(steps) + f" SELECT node, round(score, 6) AS score FROM r{rounds}"


@query("pagerank", _pagerank_sql(20))
def pagerank(g: Graph) -> DataFrame:
    """Twenty weighted rounds without an early stop."""
    return G.pagerank(_nodes(g), _pairs(g), rounds=20, tolerance=None).select("node", F.round("score", 6).alias("score"))


@query("louvain_communities")
def louvain_communities(g: Graph) -> DataFrame:
    """Weighted communities, and whether the unweighted run puts each company into the same set."""
    nodes, edges = _nodes(g), G.cut(_pairs(g))
    G.forget(g.spark)
    parts = G.edge_components(edges)
    heavy = G.cut(G.louvain(nodes, edges, parts=parts))
    light = G.cut(G.louvain(nodes, edges, weighted=False, parts=parts))
    G.forget(g.spark, edges)
    return heavy.join(G.changed_communities(heavy, light), "node")


@query("graph_fingerprint", """SELECT kind, count(*) AS n, sha256(string_agg(key, '|' ORDER BY key)) AS content_sha256 FROM (SELECT 'Company' AS kind, company_id::VARCHAR AS key FROM companies UNION ALL SELECT 'Asset', asset_id FROM companies) GROUP BY kind""")
def graph_fingerprint(g: Graph) -> DataFrame:
    """A hash of the sorted keys of each small node label."""
    keys = g.companies.select(F.lit("Company").alias("kind"), F.col("company_id").cast("string").alias("key")).unionByName(g.companies.select(F.lit("Asset").alias("kind"), F.col("asset_id").alias("key")))
    return keys.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("key")), "|"), 256).alias("content_sha256"))


