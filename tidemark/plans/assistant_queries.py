"""Queries of the assistant: tool choice, evidence bundles, reconciliation, scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import assistant as A
from .catalog import query
from .proxy import Graph


_TOP = f"regexp_matches(question, '{A.PAIR}') AND regexp_matches(question, '{A.MOST}') AND (regexp_matches(question, '{A.OVERLAP}') OR (regexp_matches(question, '{A.RELATION}') AND regexp_matches(question, '{A.EVENT}')))"
_NAMED = "contains(question, name) OR (length(name) >= 4 AND contains(question, name)) OR regexp_matches(question, concat('(^|[^a-z0-9])', symbol, '([^a-z0-9]|$)'))"


@query("assistant_tool_choice", f"""WITH q AS (SELECT concat(conv_id, '-', turn) AS question_id, coalesce(text, '') AS raw, trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')) AS question FROM conversations), c AS (SELECT n_nationkey, trim(regexp_replace(lower(n_name), '\\s+', ' ', 'g')) AS name, lower(substr(n_name, 1, 3)) AS symbol FROM nation),
m AS (SELECT question_id, count(*) AS n FROM (SELECT DISTINCT question_id, question FROM q) d JOIN c ON {_NAMED} GROUP BY question_id), r AS (SELECT q.*, coalesce(n, 0) AS n FROM q LEFT JOIN m ON m.question_id = q.question_id)
SELECT question_id, n, CASE WHEN n >= 2 THEN 'explain_connection' WHEN {_TOP} THEN 'explain_top_connection' WHEN regexp_matches(raw, '{A.ASKS_TERM}') AND n = 0 THEN 'explain_snapshot' WHEN regexp_matches(raw, '{A.ASKS_CONNECTION}') AND n = 1 THEN 'explain_company' WHEN regexp_matches(raw, '{A.ASKS_EVENT}') THEN 'explain_event' WHEN n > 0 THEN 'explain_company' ELSE 'explain_snapshot' END AS tool FROM r""")
def assistant_tool_choice(g: Graph) -> DataFrame:
    """The tool that each turn of the conversations would be answered by."""
    q = g.table("conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("question_id"), F.coalesce("text", F.lit("")).alias("question"))
    companies = g.table("nation").select(F.col("n_nationkey").alias("company_id"), F.col("n_name").alias("name"), F.substring("n_name", 1, 3).alias("symbol"), F.array().cast("array<string>").alias("aliases"))
    n = A.mentions(q, companies).groupBy("question_id").agg(F.count(F.lit(1)).alias("n"))
    rows = q.join(n, "question_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.select("question_id", "n", A.choose_tool(F.col("question"), F.col("n"), F.col("n") > 0, F.lit(False)).alias("tool"))


@query("assistant_event_evidence", """WITH i AS (SELECT DISTINCT company_id, event_id FROM affects WHERE company_id = 7), s AS (SELECT i.company_id, i.event_id, r.article_id, url, max(coalesce(r.source_event_id = a.source_event_id, FALSE)) AS own, r.is_representative AS rep FROM i JOIN affects a ON a.company_id = i.company_id AND a.event_id = i.event_id JOIN reports r ON r.event_id = i.event_id GROUP BY ALL),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY company_id, event_id ORDER BY CASE WHEN own AND rep THEN 0 WHEN own THEN 1 WHEN rep THEN 2 ELSE 3 END, article_id) = 1),
m AS (SELECT i.company_id, i.event_id, count(*) AS n_windows, round(sum(cumulative_return), 6) + 0 AS total FROM i JOIN observations o ON o.event_id = i.event_id AND o.asset_id = concat('AST_', i.company_id::VARCHAR) GROUP BY ALL)
SELECT i.company_id, i.event_id, b.article_id, b.url, coalesce(n_windows, 0)::INT AS n_windows, total FROM i LEFT JOIN b ON b.company_id = i.company_id AND b.event_id = i.event_id LEFT JOIN m ON m.company_id = i.company_id AND m.event_id = i.event_id""")
def assistant_event_evidence(g: Graph) -> DataFrame:
    """Each event of one company with its best source and its windows."""
    impacts = g.affects.where("company_id = 7").select("company_id", "event_id").distinct()
    links = g.affects.where("company_id = 7").select("company_id", "event_id", F.col("source_event_id").alias("sid"))
    sources = links.join(g.reports, "event_id").groupBy("company_id", "event_id", "article_id", "url", "is_representative").agg(F.max(F.coalesce(F.col("source_event_id") == F.col("sid"), F.lit(False))).alias("is_relationship_source"))
    market = g.observations.join(impacts.withColumn("asset_id", F.concat(F.lit("AST_"), F.col("company_id").cast("string"))), ["event_id", "asset_id"]).withColumn("causal_claim", F.lit(False))
    out = A.event_evidence(impacts, sources, market)
    total = F.aggregate("market", F.lit(0.0), lambda a, m: a + m["cumulative_return"])
    return out.select("company_id", "event_id", "article_id", "url", F.when(F.col("market").isNull(), 0).otherwise(F.size("market")).alias("n_windows"), (F.round(total, 6) + F.lit(0.0)).alias("total"))


@query("candidate_reconciliation", "SELECT concat('T', c_custkey::VARCHAR) AS source_ticker, CASE WHEN c_custkey % 7 = 0 THEN 'absent' WHEN c_custkey % 5 = 0 THEN 'rank' WHEN c_custkey % 3 = 0 THEN 'market_cap' END AS problem FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 5 = 0 OR c_custkey % 3 = 0")
def candidate_reconciliation(g: Graph) -> DataFrame:
    """Candidates against a ranking with gaps, other ranks and other values."""
    k = F.col("c_custkey")
    c = g.table("customer").select(F.concat(F.lit("T"), k.cast("string")).alias("source_ticker"), k.alias("rank"), (k * 1000.0).alias("market_cap_usd"), "c_custkey")
    ranking = c.where(k % 7 != 0).select("source_ticker", F.when(k % 5 == 0, k + 1).otherwise(k).alias("rank"), F.when((k % 3 == 0) & (k % 5 != 0), k * 1000.0 + 5).otherwise(k * 1000.0 + 0.5).alias("market_cap_usd"))
    return A.reconcile(c, ranking)


@query("scope_counts", "SELECT 'events' AS item, TRUE AS agree, (SELECT count(*) FROM orders) AS least, (SELECT count(*) FROM orders) AS most UNION ALL SELECT 'links', (SELECT count(*) FROM affects) = (SELECT count(*) FROM (SELECT DISTINCT event_id, company_id FROM affects)), (SELECT count(*) FROM (SELECT DISTINCT event_id, company_id FROM affects)), (SELECT count(*) FROM affects)")
def scope_counts(g: Graph) -> DataFrame:
    """Whether counts of the same thing agree across tables."""
    n = lambda source, item, df: df.agg(F.lit(source).alias("source"), F.lit(item).alias("item"), F.count(F.lit(1)).alias("n"))
    rows = n("graph", "events", g.events).unionByName(n("orders", "events", g.table("orders"))).unionByName(n("rows", "links", g.affects)).unionByName(n("pairs", "links", g.affects.select("event_id", "company_id").distinct()))
    return A.scope_counts(rows)


@query("capped_collection", "SELECT article_id, event_id FROM reports QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY event_id) = 1 ORDER BY event_id, article_id LIMIT 500")
def capped_collection(g: Graph) -> DataFrame:
    """The first 500 distinct articles, as a collection with a cap takes them."""
    return A.first_unique(g.reports.select("article_id", "event_id"), "article_id", ["event_id", "article_id"], 500)


@query("relation_table", "WITH p AS (SELECT x.company_id AS a, y.company_id AS b, count(DISTINCT x.event_id) AS n FROM affects x JOIN affects y ON x.event_id = y.event_id AND x.company_id < y.company_id GROUP BY ALL), s AS (SELECT company_id, count(DISTINCT event_id) AS k FROM affects GROUP BY company_id) SELECT a, b, n, round(n / (u.k + v.k - n)::DOUBLE, 9) AS similarity FROM p JOIN s u ON u.company_id = a JOIN s v ON v.company_id = b WHERE n >= 30")
def relation_table(g: Graph) -> DataFrame:
    """Pairs with enough shared events and how alike they are."""
    from ..functions.columns import jaccard
    from ..operators import graph as G

    size = g.affects.groupBy("company_id").agg(F.countDistinct("event_id").alias("k"))
    pairs = G.co_occurrence(g.affects, "event_id", "company_id").where("weight >= 30")
    both = pairs.join(size.select(F.col("company_id").alias("a"), F.col("k").alias("ka")), "a").join(size.select(F.col("company_id").alias("b"), F.col("k").alias("kb")), "b")
    return both.select("a", "b", F.col("weight").alias("n"), F.round(jaccard(F.col("weight"), F.col("ka"), F.col("kb")), 9).alias("similarity"))
