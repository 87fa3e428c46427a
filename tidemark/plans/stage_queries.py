"""Queries of the pipeline's stages: retention, pivots, coverage, market alignment, windows, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import dedup as D
from ..operators import market as M
from ..operators import scoring as S
from ..operators import stages as T
from ..operators.canonical import relationship_gate
from .catalog import query
from .proxy import Graph


def _stages(g: Graph) -> dict[str, DataFrame]:
    links = g.affects.join(g.events.select("event_id", "event_type"), "event_id")
    rule = links.where("recommended")
    return {"all_links": links, "rule_gate": rule, "model_gate": rule.where("prob >= 0.5 AND NOT isnan(prob)")}


STAGES = "links AS (SELECT a.*, event_type FROM affects a JOIN graph_events e USING (event_id)), staged AS (SELECT 0 AS o, 'all_links' AS stage, * FROM links UNION ALL SELECT 1, 'rule_gate', * FROM links WHERE recommended UNION ALL SELECT 2, 'model_gate', * FROM links WHERE recommended AND prob >= 0.5)"


@query("stage_ablation", f"WITH {STAGES}, c AS (SELECT o AS stage_order, stage, count(*) AS n_rows, count(DISTINCT event_id) AS events, count(DISTINCT (event_id, company_id)) AS pairs, count(DISTINCT company_id) AS companies FROM staged GROUP BY o, stage) SELECT *, round(events * 100.0::DOUBLE / lag(events) OVER (ORDER BY stage_order), 6) AS retention_pct FROM c")
def stage_ablation(g: Graph) -> DataFrame:
    return T.stage_summary(_stages(g))


def _pivot_sql(dim: str, key: str) -> str:
    return f"WITH {STAGES}, p AS (SELECT d.{key}, count(DISTINCT CASE WHEN o = 0 THEN event_id END) AS all_links, count(DISTINCT CASE WHEN o = 1 THEN event_id END) AS rule_gate, count(DISTINCT CASE WHEN o = 2 THEN event_id END) AS model_gate FROM (SELECT DISTINCT {key} FROM {dim}) d LEFT JOIN staged s ON s.{key} = d.{key} GROUP BY d.{key}) SELECT *, all_links - rule_gate AS lost_rule_gate, rule_gate - model_gate AS lost_model_gate FROM p"


@query("company_stage_pivot", _pivot_sql("companies", "company_id"))
def company_stage_pivot(g: Graph) -> DataFrame:
    return T.stage_pivot(_stages(g), g.companies, "company_id")


@query("type_stage_pivot", _pivot_sql("graph_events", "event_type"))
def type_stage_pivot(g: Graph) -> DataFrame:
    return T.stage_pivot(_stages(g), g.events, "event_type")


DECIDE = """CASE WHEN recommended AND status IN ('A', 'R') AND label_score >= 0.35 THEN 'rule_and_nlp_agree' WHEN recommended AND status IN ('A', 'R') AND focus >= 40 THEN 'strong_rule_fallback' WHEN recommended THEN 'nlp_rejected_rule_candidate'
WHEN status IN ('A', 'R') AND label_score >= 0.65 AND prob >= 0.65 AND prob >= 0.35 AND focus >= 2 THEN 'nlp_rescued_rule_candidate' ELSE 'rule_and_nlp_do_not_support' END"""


@query("decision_reasons", f"SELECT reason, count(*) AS n, sum((reason IN ('rule_and_nlp_agree', 'strong_rule_fallback', 'nlp_rescued_rule_candidate'))::INT)::BIGINT AS accepted, count(DISTINCT event_id) AS events, count(DISTINCT company_id) AS companies FROM (SELECT *, {DECIDE} AS reason FROM affects) GROUP BY reason")
def decision_reasons(g: Graph) -> DataFrame:
    """How the hybrid gate decided, with rescue switched on."""
    gate = S.GateConfig(accepted=("A", "R"), rescue=True, strong_focus=40)
    ok, reason = S.hybrid_decision(F.col("recommended"), F.col("focus"), F.col("prob"), F.col("status"), F.col("label_score"), F.col("prob"), gate)
    rows = g.affects.select("event_id", "company_id", ok.alias("ok"), reason.alias("reason"))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("ok").cast("long")).alias("accepted"), F.countDistinct("event_id").alias("events"), F.countDistinct("company_id").alias("companies"))


GRID = [(c, r) for c in (0.2, 0.35, 0.5, 0.65) for r in (0.5, 0.65, 0.8)]
_CELLS = " UNION ALL ".join(f"SELECT {c}::DOUBLE AS x, {r}::DOUBLE AS y" for c, r in GRID)


@query("threshold_sensitivity", f"""WITH grid AS ({_CELLS}), links AS (SELECT a.*, e.event_score::DOUBLE / 8 AS sure FROM affects a JOIN graph_events e ON e.event_id = a.event_id WHERE status IN ('A', 'R')),
kept AS (SELECT DISTINCT x, y, event_id, company_id FROM links, grid WHERE (recommended AND (label_score >= x OR focus >= 40)) OR (NOT recommended AND label_score >= y AND prob >= y AND focus >= 2 AND sure >= 0.35)),
cur AS (SELECT DISTINCT event_id, company_id FROM links WHERE (recommended AND (label_score >= 0.35 OR focus >= 40)) OR (NOT recommended AND label_score >= 0.65 AND prob >= 0.65 AND focus >= 2 AND sure >= 0.35)),
per AS (SELECT g.x, g.y, c.company_id, count(DISTINCT k.event_id) AS n FROM grid g CROSS JOIN companies c LEFT JOIN kept k ON k.x = g.x AND k.y = g.y AND k.company_id = c.company_id GROUP BY ALL),
spread AS (SELECT x, y, count(*) FILTER (n > 0) AS covered, count(*) FILTER (n = 0) AS uncovered, min(n) AS least, quantile_cont(n, 0.5)::DOUBLE AS median, max(n) AS most FROM per GROUP BY x, y),
whole AS (SELECT k.x, k.y, count(DISTINCT k.event_id) AS events, count(*) AS pairs, count(*) FILTER (c.event_id IS NULL) AS added, count(c.event_id) AS same FROM kept k LEFT JOIN cur c ON c.event_id = k.event_id AND c.company_id = k.company_id GROUP BY k.x, k.y)
SELECT x, y, coalesce(events, 0) AS events, coalesce(pairs, 0) AS pairs, covered, uncovered, least, median, most, coalesce(added, 0) AS added, (SELECT count(*) FROM cur) - coalesce(same, 0) AS removed, coalesce(added, 0) = 0 AND (SELECT count(*) FROM cur) = coalesce(same, 0) AS same_as_current FROM spread LEFT JOIN whole USING (x, y)""")
def threshold_sensitivity(g: Graph) -> DataFrame:
    """The hybrid gate over a grid of confirmation and rescue thresholds."""
    sure = g.events.select("event_id", (F.col("event_score").cast("double") / 8).alias("sure"))
    links = g.affects.join(sure, "event_id").select("event_id", "company_id", "recommended", "focus", "label_score", F.col("status").alias("label"), F.col("prob").alias("positive"), "sure")
    gate = S.GateConfig(accepted=("A", "R"), rescue=True)

    def accept(_: DataFrame, x: float, y: float):
        return relationship_gate(links, x, 40, gate, F.col("sure"), y)

    return T.sensitivity(links, g.companies, GRID, (0.35, 0.65), accept)


@query("pairs_added_removed", """WITH a AS (SELECT DISTINCT event_id, company_id FROM affects WHERE prob >= 0.35), b AS (SELECT DISTINCT event_id, company_id FROM affects WHERE label_score >= 0.35)
SELECT 'added' AS change, count(*) AS n FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT 'removed', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'both', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)""")
def pairs_added_removed(g: Graph) -> DataFrame:
    a, b = (g.affects.where(f"{c} >= 0.35").select("event_id", "company_id").distinct() for c in ("prob", "label_score"))
    count = lambda n, df: df.agg(F.lit(n).alias("change"), F.count(F.lit(1)).alias("n"))
    return count("added", b.exceptAll(a)).unionByName(count("removed", a.exceptAll(b))).unionByName(count("both", a.intersect(b)))


@query("coverage_selection", """WITH found AS (SELECT company_id, count(DISTINCT e.article_id) AS articles, count(DISTINCT strftime(event_date, '%Y-%m')) AS months, min(strftime(event_date, '%Y-%m')) AS first_month, max(strftime(event_date, '%Y-%m')) AS last_month FROM affects a JOIN graph_events e USING (event_id) WHERE recommended GROUP BY company_id),
r AS (SELECT c.company_id, source_rank, coalesce(articles, 0) AS articles, coalesce(months, 0) AS months, first_month, last_month, coalesce(articles, 0) >= 130 AND coalesce(months, 0) >= 60 AS ok FROM companies c LEFT JOIN found USING (company_id)), n AS (SELECT *, (sum(ok::INT) OVER (ORDER BY source_rank))::BIGINT AS k FROM r)
SELECT company_id, source_rank, articles, months, first_month, last_month, concat_ws('; ', CASE WHEN articles < 130 THEN 'articles' END, CASE WHEN months < 60 THEN 'months' END) AS shortfall, CASE WHEN ok AND k <= 25 THEN 'SELECTED' WHEN ok THEN 'QUALIFIED_RESERVE' ELSE 'EXCLUDED_LOW_NEWS_COVERAGE' END AS status, CASE WHEN ok AND k <= 25 THEN k END AS sample_order FROM n""")
def coverage_selection(g: Graph) -> DataFrame:
    rows = g.affects.where("recommended").join(g.events.select("event_id", "article_id", F.col("event_date").alias("published")), "event_id")
    return T.coverage_selection(g.companies.select("company_id", "source_rank"), rows, target=25, least_articles=130, least_months=60)


@query("cleaning_rollup", "SELECT coalesce(event_type, 'ALL') AS event_type, count(*) AS links, sum(recommended::INT)::BIGINT AS accepted, count(DISTINCT a.event_id) AS events FROM affects a JOIN graph_events USING (event_id) GROUP BY ROLLUP (event_type)")
def cleaning_rollup(g: Graph) -> DataFrame:
    rows = g.affects.join(g.events.select("event_id", "event_type"), "event_id")
    return T.with_total(rows, "event_type", [F.count(F.lit(1)).alias("links"), F.sum(F.col("recommended").cast("long")).alias("accepted"), F.countDistinct("event_id").alias("events")])


@query("event_company_lists", """SELECT event_id, string_agg(DISTINCT company_id::VARCHAR, '|' ORDER BY company_id::VARCHAR) AS company_ids, count(DISTINCT company_id) AS company_count, bool_and(status = 'N') AS all_status_n, coalesce(string_agg(DISTINCT CASE WHEN recommended THEN company_id::VARCHAR END, '|' ORDER BY CASE WHEN recommended THEN company_id::VARCHAR END), '') AS recommended_ids FROM affects GROUP BY event_id""")
def event_company_lists(g: Graph) -> DataFrame:
    c = F.col("company_id").cast("string")
    join = lambda x: F.array_join(F.array_sort(F.collect_set(x)), "|")
    return g.affects.groupBy("event_id").agg(join(c).alias("company_ids"), F.countDistinct("company_id").alias("company_count"), F.bool_and(F.col("status") == "N").alias("all_status_n"), join(F.when(F.col("recommended"), c)).alias("recommended_ids"))


@query("article_acceptance", """SELECT r.article_id, count(DISTINCT CASE WHEN recommended THEN company_id END) AS accepted_companies, count(DISTINCT CASE WHEN NOT recommended THEN company_id END) AS rejected_companies, max(CASE WHEN recommended AND status = 'A' THEN 3 WHEN recommended THEN 2 WHEN company_id IS NOT NULL THEN 1 ELSE 0 END) AS best FROM reports r LEFT JOIN affects a USING (event_id) GROUP BY r.article_id""")
def article_acceptance(g: Graph) -> DataFrame:
    rows = g.reports.select("article_id", "event_id").join(g.affects.select("event_id", "company_id", "recommended", "status"), "event_id", "left")
    ok = F.col("recommended")
    best = F.when(ok & (F.col("status") == "A"), 3).when(ok, 2).when(F.col("company_id").isNotNull(), 1).otherwise(0)
    return rows.groupBy("article_id").agg(F.countDistinct(F.when(ok, F.col("company_id"))).alias("accepted_companies"), F.countDistinct(F.when(~ok, F.col("company_id"))).alias("rejected_companies"), F.max(best).alias("best"))


@query("month_activity", """WITH m AS (SELECT strftime(d, '%Y-%m') AS month FROM generate_series(DATE '1994-11-01', DATE '1996-02-01', INTERVAL 1 MONTH) t(d)), k AS (SELECT DISTINCT event_type FROM graph_events), c AS (SELECT event_type, strftime(event_date, '%Y-%m') AS month, count(*) AS n FROM graph_events WHERE event_date BETWEEN DATE '1994-11-10' AND DATE '1996-02-20' GROUP BY ALL)
SELECT k.event_type, m.month, coalesce(n, 0) AS n FROM k CROSS JOIN m LEFT JOIN c ON c.event_type = k.event_type AND c.month = m.month""")
def month_activity(g: Graph) -> DataFrame:
    return T.monthly(g.events, "event_date", "1994-11-10", "1996-02-20", g.events.select("event_type").distinct())


@query("shared_event_matrix", "WITH p AS (SELECT x.company_id AS a, y.company_id AS b, count(DISTINCT x.event_id) AS n FROM affects x JOIN affects y ON x.event_id = y.event_id AND x.company_id <> y.company_id GROUP BY ALL) SELECT a, b, n, max(n) OVER () AS most FROM p")
def shared_event_matrix(g: Graph) -> DataFrame:
    from ..operators import graph as G

    cells = G.both_ways(G.co_occurrence(g.affects, "event_id", "company_id"))
    return cells.join(cells.agg(F.max("weight").alias("most"))).select("a", "b", F.col("weight").alias("n"), "most")


@query("canonical_merge", "SELECT event_id, min(status) AS status, max(focus) AS focus, max(prob) AS prob, count(DISTINCT status) > 1 AS conflict FROM affects GROUP BY event_id")
def canonical_merge(g: Graph) -> DataFrame:
    return T.merge_records(g.affects, "event_id", ["status"], ["focus", "prob"])


@query("impact_type_counts", "SELECT event_type, status, count(*) AS impacts, count(DISTINCT company_id) AS companies, min(event_date) AS first_date, max(event_date) AS last_date FROM affects a JOIN graph_events USING (event_id) GROUP BY event_type, status")
def impact_type_counts(g: Graph) -> DataFrame:
    rows = g.affects.join(g.events.select("event_id", "event_type", "event_date"), "event_id")
    return rows.groupBy("event_type", "status").agg(F.count(F.lit(1)).alias("impacts"), F.countDistinct("company_id").alias("companies"), F.min("event_date").alias("first_date"), F.max("event_date").alias("last_date"))


@query("latency_percentiles", "SELECT event_type AS task_id, count(*) AS runs, quantile_cont(value, 0.5) AS median_ms, quantile_cont(value, 0.95) AS p95_ms, min(value) AS min_ms, max(value) AS max_ms, count(DISTINCT user_id % 1) = 1 AND count(DISTINCT event_type) = 1 AS stable FROM events WHERE user_id % 6 <> 0 GROUP BY event_type")
def latency_percentiles(g: Graph) -> DataFrame:
    e = g.table("events").select(F.col("event_type").alias("task_id"), F.col("value").alias("client_elapsed_ms"), (F.col("user_id") % 6 == 0).alias("is_warmup"), (F.col("user_id") % 1).alias("result_rows"), F.col("event_type").alias("result_sha256"))
    return T.latency(e)


@query("quality_checks", """SELECT 'evidence_present' AS check_name, sum((trim(evidence) <> '')::INT)::BIGINT AS numerator, count(*) AS denominator, round(sum((trim(evidence) <> '')::INT) * 100.0::DOUBLE / count(*), 6) AS percentage, 'FAIL' AS status FROM affects
UNION ALL SELECT 'company_known', count(*), count(*), 100.0::DOUBLE, 'PASS' FROM affects UNION ALL SELECT 'none', 0, 0, NULL, 'FAIL'""")
def quality_checks(g: Graph) -> DataFrame:
    a = T.quality_check(g.affects, "evidence_present", C.nonblank(F.col("evidence")))
    b = T.quality_check(g.affects.join(g.companies.select("company_id", "company"), "company_id", "left"), "company_known", F.col("company").isNotNull())
    return a.unionByName(b).unionByName(T.quality_check(g.affects.where("focus < 0"), "none", F.lit(True)))


@query("midrank", "SELECT company_id, n, (rank() OVER (ORDER BY n DESC) + (count(*) OVER (PARTITION BY n) - 1) / 2.0)::DOUBLE AS mid_rank FROM (SELECT company_id, count(DISTINCT event_id) AS n FROM affects GROUP BY company_id)")
def midrank(g: Graph) -> DataFrame:
    rows = g.affects.groupBy("company_id").agg(F.countDistinct("event_id").alias("n"))
    return rows.select("company_id", "n", C.average_rank(F.col("n"), descending=True).alias("mid_rank"))


@query("correlations", """WITH m AS (SELECT company_id, count(*)::DOUBLE AS a, sum(focus)::DOUBLE AS b, company_id::DOUBLE AS c, 1.0::DOUBLE AS k FROM affects GROUP BY company_id), r AS (SELECT (rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0)::DOUBLE AS ra, (rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0)::DOUBLE AS rb, * FROM m)
SELECT 'links_focus' AS pair, round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman FROM r UNION ALL SELECT 'links_constant', NULL, NULL""")
def correlations(g: Graph) -> DataFrame:
    """Pearson and Spearman; null where one side does not vary."""
    m = g.affects.groupBy("company_id").agg(F.count(F.lit(1)).cast("double").alias("a"), F.sum("focus").cast("double").alias("b")).withColumn("k", F.lit(1.0))
    r = m.withColumn("ra", C.average_rank(F.col("a"))).withColumn("rb", C.average_rank(F.col("b"))).withColumn("rk", C.average_rank(F.col("k")))
    row = lambda n, x, y, rx, ry: r.agg(F.lit(n).alias("pair"), F.round(C.pearson(F.col(x), F.col(y)), 6).alias("pearson"), F.round(C.pearson(F.col(rx), F.col(ry)), 6).alias("spearman"))
    return row("links_focus", "a", "b", "ra", "rb").unionByName(row("links_constant", "a", "k", "ra", "rk"))


BEST = "row_number() OVER (PARTITION BY {keys} ORDER BY recommended DESC, prob DESC, label_score DESC, focus DESC, CASE status WHEN 'A' THEN 3 WHEN 'R' THEN 2 ELSE 1 END DESC, {last}) = 1"


@query("best_link_per_pair", f"SELECT event_id, company_id, l_linenumber, prob, focus FROM affects QUALIFY {BEST.format(keys='event_id, company_id', last='l_linenumber')}")
def best_link_per_pair(g: Graph) -> DataFrame:
    grade = F.when(F.col("status") == "A", "high").when(F.col("status") == "R", "medium").otherwise("low")
    rows = g.affects.select(F.col("event_id").alias("event"), "company_id", F.col("l_linenumber").alias("event_id"), "recommended", F.col("prob").alias("positive"), "label_score", "focus", grade.alias("link_confidence"))
    return D.best_links(rows, ["event", "company_id"]).select(F.col("event").alias("event_id"), "company_id", F.col("event_id").alias("l_linenumber"), F.col("positive").alias("prob"), "focus")


@query("representative_mention", """WITH f AS (SELECT event_id, sum(recommended::INT) AS r, max(prob) AS p, max(label_score) AS s, max(focus) AS f FROM affects GROUP BY event_id)
SELECT article_id AS cluster, event_id AS representative FROM graph_events e LEFT JOIN f USING (event_id) QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY coalesce(r, 0) DESC, coalesce(p, 0) DESC, coalesce(s, 0) DESC, coalesce(f, 0) DESC, event_score DESC, least(length(title), 700) DESC, -length(title) DESC, event_id DESC) = 1""")
def representative_mention(g: Graph) -> DataFrame:
    members = g.events.select(F.col("article_id").alias("cluster"), "event_id", "event_score", F.col("title").alias("evidence"))
    return D.representatives(members, g.affects.select("event_id", "recommended", F.col("prob").alias("positive"), "label_score", "focus"))


@query("topk_neighbours", "WITH p AS (SELECT x.company_id AS a, y.company_id AS b, count(DISTINCT x.event_id) AS n FROM affects x JOIN affects y ON x.event_id = y.event_id AND x.company_id <> y.company_id GROUP BY ALL) SELECT a, b, n, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS place, count(*) OVER (PARTITION BY a, n) AS ties FROM p QUALIFY place <= 5")
def topk_neighbours(g: Graph) -> DataFrame:
    """Each company's five nearest by shared events, with how many tie."""
    from ..operators import graph as G

    ways = G.both_ways(G.co_occurrence(g.affects, "event_id", "company_id"))
    rows = ways.select("a", "b", F.col("weight").alias("n"), F.row_number().over(W.partitionBy("a").orderBy(F.col("weight").desc(), "b")).alias("place"), F.count(F.lit(1)).over(W.partitionBy("a", "weight")).alias("ties"))
    return rows.where("place <= 5")


@query("keep_last_daily", "SELECT user_id, ts::DATE AS date, max_by(value, event_id) AS close FROM events GROUP BY ALL")
def keep_last_daily(g: Graph) -> DataFrame:
    from ..sources.tables import daily_prices

    e = g.table("events")
    rows = e.select("user_id", F.col("ts").alias("date"), *[F.col("value").alias(c) for c in ("open", "high", "low", "close", "volume")], "event_id")
    return daily_prices(rows, ["user_id"], "event_id").select("user_id", "date", "close")


@query("market_quality", """WITH p AS (SELECT *, coalesce(date - lag(date) OVER (PARTITION BY user_id ORDER BY date), 0) AS gap FROM prices), b AS (SELECT min(date) AS lo, max(date) AS hi FROM prices),
q AS (SELECT user_id, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date, max(gap)::INT AS largest_gap, 0.0::DOUBLE AS missing_ratio, (min(date) - DATE '2024-01-01')::INT AS start_delay, (DATE '2024-01-30' - max(date))::INT AS end_delay FROM p GROUP BY user_id)
SELECT *, concat_ws('; ', CASE WHEN n_rows < 20 THEN 'too few rows' END, CASE WHEN start_delay > 7 THEN 'starts late' END, CASE WHEN end_delay > 7 THEN 'ends early' END, CASE WHEN largest_gap > 2 THEN 'gap too long' END) AS reasons, NOT (n_rows < 20 OR start_delay > 7 OR end_delay > 7 OR largest_gap > 2) AS eligible FROM q""")
def market_quality(g: Graph) -> DataFrame:
    return M.series_quality(g.prices, "user_id", "2024-01-01", "2024-01-30", least_rows=20, most_gap=2)


def _published(g: Graph) -> DataFrame:
    return g.table("events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("published_at"))


ALIGN = """s AS (SELECT user_id, date, (row_number() OVER (PARTITION BY user_id ORDER BY date) - 1)::INT AS pos, close FROM prices), p AS (SELECT event_id, user_id, timezone('America/New_York', timezone('UTC', ts)) AS local FROM events),
q AS (SELECT p.*, local::DATE AS local_date, x.pos AS same, (SELECT min(pos) FROM s WHERE s.user_id = p.user_id AND s.date > local::DATE) AS later FROM p LEFT JOIN s x ON x.user_id = p.user_id AND x.date = local::DATE),
aligned AS (SELECT event_id, user_id, local_date, CASE WHEN same IS NOT NULL AND local::TIME <= TIME '16:00:00' THEN same ELSE later END AS anchor_pos, CASE WHEN same IS NULL THEN 'next_session_non_trading_day' WHEN local::TIME <= TIME '16:00:00' THEN 'same_session_before_close' ELSE 'next_session_after_close' END AS rule FROM q)"""
WINDOWS = """w AS (SELECT unnest([-7, -3, -1, 1, 3, 7])::INT AS window_days), returns AS (SELECT a.event_id, a.user_id, window_days, b.date AS baseline_date, b.close AS baseline_close, e.date AS window_end_date, e.close AS window_end_close FROM aligned a CROSS JOIN w
JOIN s b ON b.user_id = a.user_id AND b.pos = CASE WHEN window_days > 0 THEN anchor_pos - 1 ELSE anchor_pos - 1 + window_days END JOIN s e ON e.user_id = a.user_id AND e.pos = CASE WHEN window_days > 0 THEN anchor_pos - 1 + window_days ELSE anchor_pos - 1 END)"""


@query("asof_session", f"WITH {ALIGN} SELECT event_id, local_date, anchor_pos, rule, (SELECT date FROM s WHERE s.user_id = a.user_id AND s.pos = anchor_pos) AS anchor_date FROM aligned a")
def asof_session(g: Graph) -> DataFrame:
    return M.align_sessions(_published(g), g.prices, "user_id").select("event_id", "local_date", "anchor_pos", "rule", "anchor_date")


@query("signed_returns", f"WITH {ALIGN}, {WINDOWS} SELECT event_id, window_days, baseline_date, window_end_date, baseline_close, window_end_close, round(window_end_close / baseline_close - 1, 9) AS cumulative_return FROM returns")
def signed_returns(g: Graph) -> DataFrame:
    rows = M.return_windows(M.align_sessions(_published(g), g.prices, "user_id"), g.prices, "user_id")
    return rows.select("event_id", "window_days", "baseline_date", "window_end_date", "baseline_close", "window_end_close", C.rounded(F.col("cumulative_return"), 9).alias("cumulative_return"))


@query("alignment_report", f"""WITH {ALIGN}, {WINDOWS}, n AS (SELECT event_id, count(*) AS k FROM returns GROUP BY event_id) SELECT status, count(*) AS n FROM (SELECT CASE WHEN anchor_pos IS NULL THEN 'NO_TRADING_SESSION_AFTER_EVENT' WHEN anchor_pos = 0 THEN 'NO_BASELINE_SESSION' WHEN coalesce(k, 0) = 6 THEN 'ALIGNED' ELSE 'PARTIAL_WINDOWS' END AS status FROM aligned LEFT JOIN n USING (event_id)) GROUP BY status""")
def alignment_report(g: Graph) -> DataFrame:
    aligned = M.align_sessions(_published(g), g.prices, "user_id")
    found = M.return_windows(aligned, g.prices, "user_id")
    return M.alignment_status(aligned, found, ["event_id"]).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("collection_windows", """SELECT company_id, greatest(d::DATE, DATE '2025-07-10') AS window_start, least(last_day(d)::DATE, DATE '2026-06-20') AS window_end FROM companies, generate_series(DATE '2025-07-01', DATE '2026-06-20', INTERVAL 1 MONTH) t(d)""")
def collection_windows(g: Graph) -> DataFrame:
    return T.collection_windows(g.companies.select("company_id"), "2025-07-10", "2026-06-20")


@query("stable_ids", """SELECT event_id, company_id, l_linenumber, concat('EML_', upper(substr(sha1(concat(event_id::VARCHAR, '|', company_id::VARCHAR)), 1, 14))) AS link_id, concat('EVT_', upper(substr(sha1(concat(event_id::VARCHAR, chr(10), trim(lower(regexp_replace(evidence, '[^\\w]+', ' ', 'g'))))), 1, 14))) AS mention_id FROM affects""")
def stable_ids(g: Graph) -> DataFrame:
    return g.affects.select("event_id", "company_id", "l_linenumber", C.market_link_id(F.col("event_id"), F.col("company_id")).alias("link_id"), C.mention_id(F.col("event_id"), F.col("evidence")).alias("mention_id"))


@query("canonical_ids", """SELECT article_id, concat('CEVT_', upper(substr(sha1(string_agg(DISTINCT event_id::VARCHAR, '|' ORDER BY event_id::VARCHAR)), 1, 14))) AS canonical_id, count(*) AS members FROM graph_events GROUP BY article_id""")
def canonical_ids(g: Graph) -> DataFrame:
    return g.events.groupBy("article_id").agg(C.canonical_id(F.collect_list(F.col("event_id").cast("string"))).alias("canonical_id"), F.count(F.lit(1)).alias("members"))


@query("dimension_ids", "SELECT n_nationkey, concat('IND_', substr(trim(regexp_replace(upper(n_name), '[^A-Z0-9]+', '_', 'g'), '_'), 1, 48), '_', upper(substr(sha1(lower(n_name)), 1, 8))) AS dimension_id FROM nation")
def dimension_ids(g: Graph) -> DataFrame:
    return g.table("nation").select("n_nationkey", C.dimension_id("IND", F.col("n_name")).alias("dimension_id"))
