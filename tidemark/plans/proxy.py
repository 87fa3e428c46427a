"""The event graph, as views of the driver's test tables.

Suppliers stand for companies, orders for events, customers for articles, order lines for event-company
links, and the event stream for daily prices.  The mapping is SQL that Spark and the oracle both read.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS = {
    "companies": """SELECT s_suppkey AS company_id, s_name AS company, n_name AS country, n_nationkey AS industry_id, n_regionkey AS sector_id, concat('AST_', CAST(s_suppkey AS STRING)) AS asset_id, CAST(row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS INT) AS source_rank FROM {supplier} s JOIN {nation} n ON s_nationkey = n_nationkey""",
    "graph_events": """SELECT o_orderkey AS event_id, CAST(o_orderdate AS DATE) AS event_date, o_orderpriority AS event_type, concat('order ', CAST(o_orderkey AS STRING)) AS title, o_custkey AS article_id, CAST(o_orderkey % 9 AS INT) AS event_score, CAST(1 + o_orderkey % 2 AS BIGINT) AS stored_sources FROM {orders} o""",
    "affects": """SELECT l_orderkey AS event_id, l_suppkey AS company_id, l_linenumber, CAST(l_quantity AS INT) AS focus, l_discount * 10 AS prob, l_tax * 10 AS label_score, l_returnflag AS status, CASE WHEN l_returnflag = 'N' THEN '' ELSE concat('line ', CAST(l_linenumber AS STRING)) END AS evidence, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_orderkey * 10 + l_linenumber % 2 END AS source_event_id, l_linestatus = 'O' AS recommended FROM {lineitem} l""",
    "reports": """SELECT o_custkey AS article_id, o_orderkey AS event_id, o_orderkey * 10 AS source_event_id, TRUE AS is_representative, concat('https://news.example/', CAST(o_custkey AS STRING)) AS url FROM {orders} o UNION ALL SELECT o_custkey + 1000000 AS article_id, o_orderkey AS event_id, o_orderkey * 10 + 1 AS source_event_id, FALSE AS is_representative, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat('https://wire.example/', CAST(o_custkey AS STRING)) END AS url FROM {orders} p WHERE o_orderkey % 2 = 0""",
    "observations": """SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_suppkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(w AS STRING)) AS observation_id, l_orderkey AS event_id, concat('AST_', CAST(l_suppkey AS STRING)) AS asset_id, w AS window_days, l_extendedprice AS baseline_close, CAST((l_extendedprice - 30000) * w / 207919 AS DOUBLE) AS cumulative_return FROM {lineitem} l JOIN (SELECT -7 AS w UNION ALL SELECT -3 UNION ALL SELECT -1 UNION ALL SELECT 1 UNION ALL SELECT 3 UNION ALL SELECT 7) v ON l_linenumber > 0""",
    "prices": """SELECT user_id, day AS date, open, high, low, close, volume FROM (SELECT user_id, CAST(ts AS DATE) AS day, min_by(value, event_id) AS open, max(value) AS high, min(value) AS low, max_by(value, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume FROM {events} e GROUP BY user_id, CAST(ts AS DATE)) d""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def with_views(sql: str) -> str:
    """Oracle SQL with the views that it names in front."""
    bare = {n: v.format(**{t: t for t in TABLES}) for n, v in VIEWS.items() if n in sql}
    head = ", ".join(f"{n} AS ({v})" for n, v in bare.items())
    body = sql.strip()
    if not head:
        return body
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") and not body.upper().startswith("WITH RECURSIVE") else (f"WITH RECURSIVE {head}, {body[15:]}" if body.upper().startswith("WITH RECURSIVE") else f"WITH {head} {body}")


class Graph:
    """The views as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str, **instead: DataFrame) -> DataFrame:
        used = {t: instead[t] if t in instead else self.table(t) for t in TABLES if "{" + t + "}" in VIEWS[name]}
        return self.spark.sql(VIEWS[name], **used)

    companies = cached_property(lambda self: self.view("companies"))
    events = cached_property(lambda self: self.view("graph_events"))
    affects = cached_property(lambda self: self.view("affects"))
    reports = cached_property(lambda self: self.view("reports"))
    observations = cached_property(lambda self: self.view("observations"))

    @cached_property
    def prices(self) -> DataFrame:
        """The oracle's min_by and max_by pass over rows without a value, Spark's over rows without an order."""
        events = self.table("events")
        return self.view("prices", events=events.withColumn("event_id", F.when(F.col("value").isNotNull(), F.col("event_id"))))
