import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark import schema
from tidemark.config import GateConfig, MarketConfig, RuleConfig, check_capacity, iso_date, positive_int, unit_interval
from tidemark.functions import columns as C
from tidemark.functions import text as X
from tidemark.operators import dedup as D
from tidemark.operators import graph as G
from tidemark.operators import market as M
from tidemark.operators import scoring as S
from tidemark.operators import stages as T
from tidemark.sources import sinks, tables


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_coercions(spark):
    rows = spark.createDataFrame([(" Yes ",), ("12",), ("12.5",), ("",), (None,), ("NaN",), ("504506813533.50",)], "t string")
    got = rows.select(C.parse_bool(F.col("t")), C.integer_text(F.col("t")), C.rounded_integer_text(F.col("t")), C.scalar_kind(F.col("t"))).collect()
    assert [r[0] for r in got] == [True, False, False, False, False, False, False]
    assert [r[1] for r in got] == [None, "12", None, None, None, None, None]
    assert got[6][2] == "504506813534" and got[5][2] is None
    assert [r[3] for r in got] == ["text", "integer", "number", "null", "null", "null", "number"]


def test_ids_do_not_depend_on_order(spark):
    a = one(spark, C.canonical_id(F.array(F.lit("b"), F.lit("a"), F.lit("b"))), C.canonical_id(F.array(F.lit("a"), F.lit("b"))))
    assert a[0] == a[1] and a[0].startswith("CEVT_") and len(a[0]) == 19
    assert one(spark, C.dimension_id("IND", F.lit("Banks & Co.")))[0].startswith("IND_BANKS_CO_")


def test_average_ranks_and_correlation(spark):
    rows = spark.createDataFrame([(30, 1.0), (10, 1.0), (20, 1.0), (20, 1.0)], "v int, k double")
    ranks = {tuple(r) for r in rows.select("v", C.average_rank(F.col("v"))).collect()}
    assert ranks == {(30, 4.0), (10, 1.0), (20, 2.5)}
    got = rows.agg(C.pearson(F.col("v"), F.col("v") * 2), C.pearson(F.col("v"), F.col("k"))).first()
    assert got[0] == pytest.approx(1) and got[1] is None


def test_market_windows_follow_positions(spark):
    days = [dt.date(2026, 1, 1) + dt.timedelta(d) for d in (0, 1, 4, 5, 6, 7, 8, 11, 12, 13)]
    prices = spark.createDataFrame([("A", d, 100.0 + i) for i, d in enumerate(days)], "k string, date date, close double")
    aligned = spark.createDataFrame([("A", 5)], "k string, anchor_pos int")
    got = {r.window_days: r.cumulative_return for r in M.return_windows(aligned, prices, "k").collect()}
    assert got == {-1: pytest.approx(104 / 103 - 1), -3: pytest.approx(104 / 101 - 1), 1: pytest.approx(105 / 104 - 1), 3: pytest.approx(107 / 104 - 1)}
    with pytest.raises(ValueError):
        MarketConfig(windows=(0,))


def test_sessions_by_close_and_holiday(spark):
    prices = spark.createDataFrame([("A", dt.date(2026, 1, d), 1.0) for d in (5, 6, 8)], "k string, date date, close double")
    at = lambda n, d, h, m: (n, "A", dt.datetime(2026, 1, d, h, m))
    pubs = spark.createDataFrame([at(1, 5, 21, 0), at(2, 5, 21, 1), at(3, 7, 15, 0), at(4, 8, 22, 0), (5, "A", None)], "n int, k string, published_at timestamp")
    got = {r.n: (r.anchor_pos, r.rule) for r in M.align_sessions(pubs, prices, "k").collect()}
    assert got == {1: (0, "same_session_before_close"), 2: (1, "next_session_after_close"), 3: (2, "next_session_non_trading_day"), 4: (None, "next_session_after_close"), 5: (None, None)}


def test_hybrid_gate_truth_table(spark):
    rows = spark.createDataFrame([(True, 4, "direct_subject", 0.5, 0.9), (True, 8, "direct_target", 0.1, 0.9), (True, 4, "unrelated", 0.9, 0.1), (False, 4, "direct_subject", 0.9, 0.9), (True, 4, "direct_subject", float("nan"), 0.1)], "r boolean, f int, l string, s double, p double")
    ok, why = S.hybrid_decision(F.col("r"), F.col("f"), F.lit(0.9), F.col("l"), F.col("s"), F.col("p"))
    assert [tuple(x) for x in rows.select(ok, why).collect()] == [(True, "rule_and_nlp_agree"), (True, "strong_rule_fallback"), (False, "nlp_rejected_rule_candidate"), (False, "rule_and_nlp_do_not_support"), (False, "nlp_rejected_rule_candidate")]
    ok, why = S.hybrid_decision(F.col("r"), F.col("f"), F.lit(0.9), F.col("l"), F.col("s"), F.col("p"), GateConfig(rescue=True))
    assert rows.select(why).collect()[3][0] == "nlp_rescued_rule_candidate"


@pytest.mark.parametrize(
    ("text", "label", "want"),
    [
        ("Rivals including Acme fell sharply.", "direct_subject", ("incidental_mention", "grammar_contextual_example")),
        ("Acme announced a new product.", "unrelated", ("direct_subject", "grammar_company_is_subject")),
        ("Acme chief executive told investors to wait.", "unrelated", ("direct_subject", "grammar_company_representative_is_subject")),
        ("Regulators said Acme was fined.", "unrelated", ("direct_target", "grammar_company_is_target")),
        ("The regulator sued Acme yesterday.", "unrelated", ("direct_target", "grammar_company_is_active_clause_target")),
        ("Shares moved.", "unrelated", ("unrelated", "nlp_label_unchanged")),
    ],
)
def test_grammar(spark, text, label, want):
    new, why = S.calibrate(S.names_pattern(["Acme", "Acme Inc"]), F.lit(text), F.lit(label))
    assert tuple(one(spark, new, why)) == want


def test_sentences_units_and_spans(spark):
    articles = spark.createDataFrame([(1, "Acme buys Beta.", "", 'Acme buys Beta. It said "yes." Profit rose.\n\nOther news. Acme expects a merger. Last words.', "Business")], "article_id int, headline string, trail_text string, body_text string, section_name string")
    rows = X.sentences(articles, "article_id").orderBy("position").collect()
    assert [r.sentence for r in rows] == ["Acme buys Beta.", 'It said "yes."', "Profit rose.", "Other news.", "Acme expects a merger.", "Last words."]
    assert [r.source for r in rows][:2] == ["headline", "body_text"]
    units = X.evidence_units(X.sentences(articles, "article_id"), "article_id", 2, 700)
    assert units.where("n = 2").count() == 3  # none crosses a paragraph or a source
    links = spark.createDataFrame([(1, "C1", ["Acme"], [], "true")], "article_id int, company_id string, core_aliases array<string>, product_aliases array<string>, query_returned string")
    spans = S.select_spans(articles, links, "article_id").collect()
    assert [s.evidence for s in spans] == ["Acme expects a merger."]


def test_boundary_match_and_title(spark):
    got = one(spark, X.term_hits(F.lit("Nato-led, profits rose; éprofit"), ["nato", "profit", "profits"]), X.title(F.lit("word " * 60)), X.english_aliases(F.lit("Acme|ACME|Ñu|  Beta  Co |12"), F.lit("x")))
    assert got[0] == ["nato", "profits"] and len(got[1]) <= 180 and got[1].endswith("word…") and got[2] == ["Acme", "Beta Co"]


def test_classification_ties_and_priority(spark):
    rules = RuleConfig(keywords={"a": ("merger",), "b": ("war",)}, section_hints={})
    got = S.classify_span(spark.createDataFrame([("merger and war",), ("nothing",)], "t string"), "t", rules=rules).collect()
    assert (got[0].event_type, got[0].event_score, got[0].tie, got[0].secondary_types) == ("a", 3, True, ["b"])
    assert (got[1].event_type, got[1].event_score, got[1].confidence) == ("corporate_event", 0, "low")


def _mentions(spark, rows):
    events = spark.createDataFrame([(i, a, t, dt.date(2026, 1, d), f"2026-01-{d:02d}T09:00:00Z", x, x, 5, r) for i, a, t, d, x, _, r in rows], "event_id string, article_id string, event_type string, event_date date, published_at string, event_title string, evidence string, event_score int, recommended string")
    links = spark.createDataFrame([(i, c, r, "0.9", "0.8", "5", "high") for i, _, _, _, _, c, r in rows], "event_id string, company_id string, recommended string, positive string, label_score string, focus string, link_confidence string")
    return events, links


def test_dedup_gates(spark):
    same = "Acme agreed to acquire Beta Robotics for four billion dollars in cash"
    rows = [
        ("E1", "A1", "x", 1, same, "C1", "true"), ("E2", "A2", "x", 3, same, "C1", "true"),  # merged
        ("E3", "A1", "x", 3, same, "C1", "true"),  # an article of the cluster
        ("E4", "A4", "x", 20, same, "C1", "true"),  # too late
        ("E5", "A5", "x", 2, same, "C9", "true"),  # another company
        ("E6", "A6", "y", 2, same, "C1", "true"),  # another type
        ("E7", "A7", "x", 2, same, "C1", "false"),  # not recommended
        ("E8", "A8", "x", 2, "Gamma opened a factory near the old harbour this spring", "C1", "true"),
    ]
    events, links = _mentions(spark, rows)
    clusters = {r.event_id: r.cluster for r in D.cluster_events(events.repartition(3), links).collect()}
    assert clusters["E2"] == "E1" and all(clusters[x] == x for x in ("E1", "E3", "E4", "E5", "E6", "E7", "E8"))
    made = D.canonical_events(events, D.cluster_events(events, links), links)
    first = made.where("cluster = 'E1'").first()
    assert (first.source_events, first.source_articles, first.method, first.date_span) == (2, 2, "exact_text", 2)


def test_graph_operators(spark):
    nodes = spark.createDataFrame([(i,) for i in range(1, 8)], "node int")
    edges = spark.createDataFrame([(1, 2, 2), (2, 3, 1), (4, 5, 3)], "a int, b int, weight int")
    parts = G.components(nodes, edges)
    assert {r.node: r.component for r in parts.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7}
    labels = {r.node: r.label for r in G.relabel(parts, "G").collect()}
    assert labels[3] == "G01" and labels[5] == "G02" and labels[6] == "G03"
    s = {r.node: (r.degree, r.strength, r.isolate) for r in G.structure(nodes, edges).collect()}
    assert s[2] == (2, 3.0, False) and s[7] == (0, 0.0, True)
    ranks = {r.node: r.score for r in G.pagerank(nodes, edges).collect()}
    assert ranks[7] == pytest.approx(0.15) and ranks[4] == pytest.approx(1 - 0.85**21, abs=1e-6)
    found = G.louvain(nodes, edges)
    groups = {r.node: r.community for r in found.collect()}
    assert groups[4] == groups[5] and groups[1] != groups[4]
    assert G.modularity(found, edges).first()[0] == pytest.approx(found.first().modularity)


def test_stage_reports(spark):
    links = spark.createDataFrame([("E1", "C1"), ("E1", "C1"), ("E2", "C2")], "event_id string, company_id string")
    got = T.stage_summary({"all": links, "kept": links.where("event_id = 'E1'")}).orderBy("stage_order").collect()
    assert [(r.n_rows, r.events, r.retention_pct) for r in got] == [(3, 2, None), (2, 1, 50.0)]
    dim = spark.createDataFrame([("C1",), ("C2",), ("C3",)], "company_id string")
    assert {tuple(r) for r in T.stage_pivot({"all": links, "kept": links.where("event_id = 'E1'")}, dim, "company_id").collect()} == {("C1", 1, 1, 0), ("C2", 1, 0, 1), ("C3", 0, 0, 0)}
    months = T.monthly(spark.createDataFrame([(dt.date(2026, 1, 5),)], "d date"), "d", "2026-01-01", "2026-02-28").orderBy("month").collect()
    assert [tuple(r) for r in months] == [("2026-01", 1), ("2026-02", 0)]
    companies = spark.createDataFrame([("C1", 1), ("C2", 2), ("C3", 3)], "company_id string, source_rank int")
    articles = spark.createDataFrame([(c, a, dt.date(2026, m, 1)) for c, a, m in (("C1", "a", 1), ("C1", "b", 2), ("C2", "c", 1), ("C3", "d", 1), ("C3", "e", 3))], "company_id string, article_id string, published date")
    status = {r.company_id: (r.status, r.sample_order) for r in T.coverage_selection(companies, articles, 2, 2, 2).collect()}
    assert status == {"C1": ("SELECTED", 1), "C2": ("EXCLUDED_LOW_NEWS_COVERAGE", None), "C3": ("SELECTED", 2)}


def test_contracts(spark):
    rows = spark.createDataFrame([(1, "a"), (1, ""), (2, "b")], "k int, v string")
    with pytest.raises(ValueError, match="lacks"):
        schema.require_columns(rows, ["k", "z"], "rows")
    with pytest.raises(ValueError, match="repeats"):
        schema.ensure_unique(rows, ["k"], "rows")
    with pytest.raises(ValueError, match="without"):
        schema.ensure_nonblank(rows, ["v"], "rows")
    with pytest.raises(ValueError, match="unknown"):
        schema.ensure_references(rows, rows.where("k = 1"), "k")
    assert iso_date("2026-01-31", "d") == "2026-01-31" and unit_interval(1, "p") == 1.0 and positive_int(3, "n") == 3
    for bad in (lambda: iso_date("2026-1-1", "d"), lambda: unit_interval(1.5, "p"), lambda: positive_int(True, "n"), lambda: check_capacity(10, 3, 2, 2)):
        with pytest.raises(ValueError):
            bad()


def test_sources_and_sinks(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_bytes('﻿a,b\n1,"two\nlines"\n,\n'.encode())
    df = tables.read_text_csv(spark, str(path))
    assert df.columns == ["a", "b"] and tables.data_rows(df) == 1 and df.collect()[0]["b"] == "two\nlines"
    raw = spark.createDataFrame([(json.dumps({"id": "x", "webTitle": "T", "fields": {"trailText": "<b>Hi</b> &amp; bye"}, "tags": [{"id": "t1", "webTitle": "One"}]}),)], "value string")
    a = tables.flatten_articles(raw).first()
    assert (a.headline, a.trail_text, a.tag_ids) == ("T", "Hi & bye", ["t1"])
    rows = spark.createDataFrame([("2026-01-01", "1", 1), ("2026-01-01", "2", 2), ("bad", "3", 3)], "date string, close string, seq int").selectExpr("'A' AS k", "date", "close AS open", "close AS high", "close AS low", "close", "close AS volume", "seq")
    assert [r.close for r in tables.daily_prices(rows, ["k"], "seq").collect()] == [2.0]
    out = spark.createDataFrame([(1, ["b", "a"])], "k int, l array<string>")
    sinks.write_csv(out, str(tmp_path / "out"), ["l", "k"], single=True)
    assert spark.read.csv(str(tmp_path / "out"), header=True, quote='"', escape='"').first()["l"] == '["a","b"]'
    h = lambda d: sinks.content_hash(d).first()
    assert h(out) == h(spark.createDataFrame([(1, ["a", "b"])], "k int, l array<string>")) != h(out.union(out))
    assert sinks.split_statements("// no\nA;\nB ;") == ["A", "B"]
    with pytest.raises(ValueError):
        sinks.check_read_only("MATCH (n) DETACH DELETE n")
    with pytest.raises(ValueError):
        sinks.strict_json({"x": float("nan")})
    assert sinks.find_credentials({"a": [{"api_key": "x"}]}) == ["$.a[0].api_key"]
    with pytest.raises(ValueError):
        tables.inside("/data", "../etc")
    assert sinks.write_package({"t": out}, str(tmp_path / "pkg"), {"t": 1}) == {"t": 1}
    with pytest.raises(ValueError):
        sinks.write_package({"t": out.where("k > 5")}, str(tmp_path / "pkg"))
    changes = spark.createDataFrame([(1, ["z"], 1), (2, ["y"], 1), (1, ["w"], 2)], "k int, l array<string>, seq int")
    assert {(r.k, r.l[0]) for r in sinks.upsert(out, changes, ["k"], "seq").collect()} == {(1, "w"), (2, "y")}


def test_latency_and_checks(spark):
    rows = spark.createDataFrame([("T1", float(x), w, 1, "h") for x, w in ((9, True), (1, False), (2, False), (3, False))], "task_id string, client_elapsed_ms double, is_warmup boolean, result_rows int, result_sha256 string")
    r = T.latency(rows).first()
    assert (r.runs, r.median_ms, r.stable) == (3, 2.0, True) and r.p95_ms == pytest.approx(2.9)
    got = T.quality_check(rows, "n", F.lit(True), F.lit(False)).first()
    assert (got.percentage, got.status) == (None, "FAIL")


def test_assistant_intents(spark):
    from tidemark.operators import assistant as A

    cases = [("Which two companies share the most events?", True), ("哪两家公司共同事件最多?", True), ("Which company has the most related events?", False), ("Tell me about Acme", False)]
    rows = spark.createDataFrame([(q,) for q, _ in cases], "q string")
    assert [r[0] for r in rows.select(A.asks_top_pair(F.col("q"))).collect()] == [want for _, want in cases]
    companies = spark.createDataFrame([("C1", "Acme Holdings", "AC", ["the anvil firm"]), ("C2", "Beta Company", "BT", [])], "company_id string, name string, symbol string, aliases array<string>")
    asked = spark.createDataFrame([("1", "How is acme doing?"), ("2", "BT and the anvil firm"), ("3", "abt nothing")], "question_id string, question string")
    got = {(r.question_id, r.company_id, r.place) for r in A.mentions(asked, companies).collect()}
    assert got == {("1", "C1", 1), ("2", "C1", 1), ("2", "C2", 2)}


def test_mentions_compare_whole_texts_of_any_ids(spark, tmp_path):
    from tidemark.plans.proxy import Graph
    from tidemark.plans.text_queries import canonical_events, similar_mentions

    opening = "one title\nsecond line\nthird line\n"
    bodies = ["\n".join(f"{c}{i} {c}{i + 1} word{c}{i}" for i in range(60)) for c in "pqr"]
    texts = {1: opening + bodies[0], 2: opening + bodies[1], 16: opening + bodies[0], 40: "other title\nnew\nlines\n" + bodies[2], 55: "last title\nmore\nrows\n" + bodies[2]}
    rows = [(i, t, "en", "src0", len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    g = Graph(spark, str(tmp_path))
    found = {(int(r.a[1:]), int(r.b[1:])): r.exact for r in similar_mentions(g).collect()}
    assert found == {(1, 16): True, (40, 55): False}
    assert canonical_events(g).count() == 3


def test_louvain_by_component(spark):
    cliques = [(10 * k + x, 10 * k + y, 3) for k in range(6) for x in range(4) for y in range(x + 1, 4)]
    edges = spark.createDataFrame([*cliques, (0, 10, 1), (30, 40, 1)], "a int, b int, weight int")
    nodes = spark.createDataFrame([(10 * k + x,) for k in range(6) for x in range(4)] + [(99,)], "node int")
    found = G.louvain(nodes, edges)
    assert {r.node: r.community for r in found.collect()} == {10 * k + x: 10 * k for k in range(6) for x in range(4)} | {99: 99}
    assert G.modularity(found, edges).first()[0] == pytest.approx(found.first().modularity)
    assert found.select("modularity").distinct().count() == 1 and G.louvain(nodes, edges.where("weight > 9")).where("node <> community").isEmpty()


def test_louvain_holds_no_component_in_memory(spark, monkeypatch):
    """Edges of one component stay in files: a task takes far less memory than they have bytes, and finds the same."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from tidemark.operators import community as K

    size, rng = 1200, np.random.default_rng(3)
    a, b = np.triu_indices(size, 1)
    order = rng.permutation(len(a))
    a, b = a[order], b[order]
    w = np.where(a // 300 == b // 300, 9.0, 1.0)
    batch = lambda k: pa.RecordBatch.from_pydict({"component": np.zeros(len(a[k : k + 5000]), np.int64), "a": a[k : k + 5000], "b": b[k : k + 5000], "weight": w[k : k + 5000]})
    move = K.local_moves(10, 10, 2 * w.sum(), True, True, chunk=5_000, bins=64)
    tracemalloc.start()
    found = pa.Table.from_batches(move(map(batch, range(0, len(a), 5000))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    last = found.filter(found["last"])
    assert dict(zip(last["node"].to_pylist(), last["community"].to_pylist(), strict=True)) == {i: i // 300 * 300 for i in range(size)}
    assert peak < 32 * len(a) / 4
    linked = pa.Table.from_batches(K.spanning(chunk=5_000)(map(batch, range(0, len(a), 5000))))
    assert linked.num_rows == size - 1
    edges = spark.createDataFrame([(x, y, 1 + (x + y) % 3) for x in range(40) for y in range(x + 1, 40) if (x * y + x + y) % 5 == 0], "a int, b int, weight int")
    nodes = spark.range(42).select(F.col("id").cast("int").alias("node"))
    whole = G.louvain(nodes, edges).collect()
    monkeypatch.setattr(G, "local_moves", lambda *args: K.local_moves(*args, chunk=7, bins=3))
    monkeypatch.setattr(G, "spanning", lambda: K.spanning(chunk=7))
    assert sorted(G.louvain(nodes, edges).collect()) == sorted(whole)


def test_copies_are_compared_once_as_a_class(spark):
    from tidemark.config import DedupConfig

    text = " ".join(f"term{i} other{i % 7}" for i in range(40))
    near = text.replace("term3 ", "changed ")
    rows = [(f"E{i:03d}", f"A{i}", "x", 1 + i % 3, near if i == 30 else text if i < 30 else f"alone{i} stands{i} apart{i}", "C1", "true") for i in range(40)]
    events, links = _mentions(spark, rows)
    pairs, _ = D.class_pairs(events, D.text_classes(events, DedupConfig()), DedupConfig())
    assert pairs.count() == 1
    found = D.similar_pairs(events).collect()
    assert len(found) == 30 * 29 // 2 + 30 and sum(r.exact for r in found) == 30 * 29 // 2
    clusters = {r.event_id: r.cluster for r in D.cluster_events(events, links).collect()}
    assert {clusters[f"E{i:03d}"] for i in range(31)} == {clusters["E000"]} and len(set(clusters.values())) == 10
