"""Canonical rows, gates, reports, paging and text helpers on small cases, nulls and ties among them."""

import html
import json

import pytest
from pyspark.sql import functions as F

from tidemark.config import GateConfig
from tidemark.functions import columns as C
from tidemark.functions import text as X
from tidemark.operators import canonical as K
from tidemark.operators import reporting as R
from tidemark.operators import scoring as S
from tidemark.operators import stages as T
from tidemark.sources import sinks, tables

LINK = "event_id string, company_id string, article_id string, event_type string, recommended string, positive string, label_score string, focus string, link_confidence string"


def test_canonical_links_take_the_best_and_keep_what_all_add(spark):
    links = spark.createDataFrame([("e1", "c", "a1", "x", "false", "0.9", "0.9", "9", "high"), ("e2", "c", "a2", "x", "true", "0.4", "0.5", "3", "low"), ("e3", "c", "a2", "x", "true", "0.4", "0.5", "3", "medium"), ("e1", "d", "a1", "x", "false", "NaN", "", "", None)], LINK)
    clusters = spark.createDataFrame([("e1", "k"), ("e2", "k"), ("e3", "k")], "event_id string, cluster string")
    canonical = spark.createDataFrame([("k", "CEVT_1", "merged")], "cluster string, canonical_id string, event_type string")
    published = spark.createDataFrame([("e1", "2025-07-01"), ("e2", "2025-07-02"), ("e3", "2025-07-03")], "event_id string, published_at string")
    got = {r.company_id: r for r in K.canonical_links(links, clusters, canonical, published).collect()}
    assert got["c"].source_event_id == "e3" and got["c"].recommended and got["c"].source_relationships == 3 and got["c"].deduplicated
    assert got["c"].source_event_ids == '["e1","e2","e3"]' and got["c"].source_article_ids == '["a1","a2"]' and got["c"].event_type == "merged" and got["c"].relationship_published_at == "2025-07-03"
    assert not got["d"].recommended and not got["d"].deduplicated
    assert K.canonical_links(links.limit(0), clusters, canonical, published).count() == 0


def test_summaries_of_nothing(spark):
    none = spark.createDataFrame([], "recommended string, source_events int, min_similarity double")
    got = {r.metric: r.value for r in K.dedup_summary(none, none).collect()}
    assert got["qualified_canonical_events"] == 0 and got["largest_cluster_size"] == 0 and got["minimum_multi_source_similarity"] is None


def test_gate_simulation(spark):
    """Label, score or strong focus; and rescue by all of score, probability, focus and event."""
    rows = spark.createDataFrame([(1, "true", "direct_subject", "0.4", "0.1", "1", 0.9), (2, "yes", "direct_target", "0.1", "0.1", "8", 0.9), (3, "true", "unrelated", "0.9", "0.9", "9", 0.9), (4, "false", "direct_subject", "0.7", "0.7", "2", 0.4), (5, "false", "direct_subject", "0.7", "0.7", "2", 0.3), (6, "false", "direct_subject", "0.7", "0.6", "2", 0.4), (7, "true", None, None, None, None, None), (8, "true", "direct_subject", "NaN", "NaN", "1", None)], "i int, recommended string, label string, label_score string, positive string, focus string, event double")
    ok = lambda gate: {r.i for r in rows.where(K.relationship_gate(rows, 0.35, 7, gate, F.col("event"))).collect()}
    assert ok(GateConfig()) == {1, 2} and ok(GateConfig(rescue=True)) == {1, 2, 4}


def test_first_come_rules(spark):
    rows = spark.createDataFrame([("e", "c", 3, 0), ("e", "c", 5, 1), ("e", "c", 5, 2), ("f", "c", None, 3)], "event_id string, company_id string, focus int, n int")
    assert {(r.event_id, r.n) for r in K.focused_links(rows, "focus", "n").collect()} == {("e", 1), ("f", 3)}
    assert {(r.event_id, r.n) for r in K.first_rows(rows, ["event_id"], ["n"]).collect()} == {("e", 0), ("f", 3)}
    scored = spark.createDataFrame([("e", "one", 0.5, 0.9, 0), ("e", "two", 0.7, 0.1, 1), ("e", "three", 0.7, 0.2, 2), ("e", "four", 0.7, 0.2, 3)], "event_id string, sentence string, positive double, score double, n int")
    assert K.best_evidence(scored, ["event_id"], ["n"]).first().sentence == "three"


def test_type_override_is_off_by_default(spark):
    df = spark.createDataFrame([("rule", "model", 0.45), ("rule", "model", 0.44), ("rule", "model", None)], "t string, l string, s double")
    on = [r[0] for r in df.select(K.final_type(F.col("t"), F.col("l"), F.col("s"), GateConfig(override_type=True))).collect()]
    off = [r[0] for r in df.select(K.final_type(F.col("t"), F.col("l"), F.col("s"))).collect()]
    assert on == ["model", "rule", "rule"] and off == ["rule"] * 3


def test_grammar(spark):
    name = S.names_pattern(["Acme", "Acme Corp"])
    cases = {"Firms such as Acme fell.": "incidental_mention", "Acme Corp said profits rose.": "direct_subject", "Acme's chief executive told staff.": "direct_subject", "Acme was fined.": "direct_target", "Regulators sued Acme.": "direct_target", "Nothing here about it": "unrelated"}
    for text, want in cases.items():
        label, reason = spark.range(1).select(*S.calibrate(name, F.lit(text), F.lit("unrelated"))).first()
        assert label == want and (reason == "nlp_label_unchanged") == (want == "unrelated")
    assert spark.range(1).select(*S.calibrate(name, F.lit("Acme was fined."), F.lit("direct_target"))).first()[1] == "nlp_label_unchanged"


def test_event_counts_keep_companies_without_events(spark):
    companies = spark.createDataFrame([("a", None), ("b", 2), ("c", 1)], "company_id string, source_rank int")
    links = spark.createDataFrame([("b", 1), ("b", 2)], "company_id string, event_id int")
    assert [(r.company_id, r.event_count) for r in R.event_counts(companies, links).collect()] == [("b", 2), ("c", 0), ("a", 0)]


def test_rejects(spark):
    companies = spark.createDataFrame([("c", "s")], "company_id string, asset_id string")
    events = spark.createDataFrame([("e", "2025-07-01"), ("late", "2026-08-01"), ("none", None)], "event_id string, d string").select("event_id", F.col("d").cast("date").alias("event_date"))
    links = spark.createDataFrame([("c", "e"), ("c", "e"), ("x", "e"), ("c", "gone")], "company_id string, event_id string")
    found = R.snapshot_rejects(events, links, companies, "2025-07", "2026-06")
    assert {(r.reason, r.key) for r in found.collect()} == {("outside_months", "late"), ("outside_months", "none"), ("repeated_link", "c/e"), ("unknown_end", "x/e"), ("unknown_end", "c/gone")}
    with pytest.raises(ValueError, match="late"):
        R.require_clean(found)
    R.require_clean(found.limit(0))
    market = spark.createDataFrame([("o1", "c", "s"), ("o2", "c", "t"), ("o3", "x", "s"), ("o4", "c", None)], "observation_id string, company_id string, asset_id string")
    assert {r.observation_id for r in R.asset_mismatches(market, companies).collect()} == {"o2", "o3", "o4"}


def test_briefings(spark):
    df = spark.createDataFrame([("companies", 2)], "metric string, value long")
    for language in ("en", "zh"):
        text = R.analyst_briefing(language, df, df, df, df)
        assert text.startswith(f"# {R.HEADINGS[language][0]}") and text.count("| companies | 2 |") == 4 and text.rstrip().endswith(R.HEADINGS[language][-1])


def test_layout(spark):
    nodes = spark.createDataFrame([("a", 4), ("b", 1), ("z", 0)], "company_id string, strength int")
    got = {r.company_id: r for r in R.network_layout(nodes).collect()}
    assert (got["a"].x, got["a"].y) == pytest.approx((800, 120)) and got["a"].node_radius == 31 and (got["z"].x, got["z"].y, got["z"].is_isolate) == (800, 920, True)


def test_character_references(spark):
    texts = ["a &amp; b &lt;x&gt; &eacute; &#233; &#xE9; &#128512; &#x1F600; &#150; &nope; & &&amp;; &copy 2 &hellip;", "plain", "&#0; &#xD800; &#1114112;", "&notin; &CounterClockwiseContourIntegral;", ""]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", X.unescape(F.col("t")).alias("u")).collect()
    assert [r.u for r in rows] == [None if r.t is None else html.unescape(r.t) for r in rows]


def test_stopwords_are_ninety_five():
    assert len(X.STOPWORDS) == len(set(X.STOPWORDS)) == 95 and not {"where", "your"} & set(X.STOPWORDS)


def test_text_helpers(spark):
    df = spark.range(1)
    pick = lambda c: df.select(c).first()[0]
    assert pick(X.unique_texts(F.array(*map(F.lit, [" One  two", "one TWO", "", "three", "four"])), 2, 20)) == ["One two", "three"]
    assert pick(X.unique_texts(F.lit(None).cast("array<string>"), 2, 20)) is None
    assert pick(X.search_text(F.lit("t"), F.lit(""), F.lit("<b>trail</b>"), F.lit(None).cast("string"))) == "t\ntrail"
    assert pick(X.event_prompt(F.lit("a  b"), F.lit("x" * 3000))).startswith("Evidence-grounded title: a b\nEvidence span: xxx") and len(pick(X.event_prompt(F.lit("a"), F.lit("x" * 3000)))) == 1800
    assert pick(X.simple_sentences(F.lit("One. Two!  Three\n\nFour? "))) == ["One.", "Two!", "Three", "Four?"]
    assert pick(X.union_ids(F.array(F.lit("b"), F.lit("a")), F.lit(None).cast("array<string>"))) == ["a", "b"]
    names = spark.createDataFrame([("c", ["Acme", "ACME", "Widget", "Old"])], "company_id string, aliases array<string>")
    rules = spark.createDataFrame([("c", ["old"], ["widget", "Gadget"], [" Gadget ", ""], ["acme"])], "company_id string, excluded array<string>, products array<string>, additional array<string>, strict array<string>")
    assert [(r.alias, r.kind, r.strict_case) for r in X.alias_dimension(names, rules).orderBy("position").collect()] == [("Acme", "core", True), ("Widget", "product", False), ("Gadget", "product", False)]
    assert [r.alias for r in X.alias_dimension(names, rules.limit(0)).orderBy("position").collect()] == ["Acme", "Widget", "Old"]


def test_attempts_budget_and_pages():
    waits, calls = [], []

    def page(key, n):
        calls.append((key, n))
        if len(calls) in (1, 2):
            raise tables.Transient("busy")
        return {"pages": 2 if key == ("a",) else 1, "n": n}

    budget = tables.Budget(6)
    got = list(tables.paged([("a",), ("b",)], page, budget, backoff=2.0, sleep=waits.append))
    assert [(k, n) for k, n, _ in got] == [(("a",), 1), (("a",), 2), (("b",), 1)] and waits == [2.0, 4.0] and budget.used == 5
    known = list(tables.paged([("a",)], page, tables.Budget(1), have=lambda key, n: {"pages": 1}))
    assert len(known) == 1 and len(calls) == 5
    with pytest.raises(tables.Exhausted):
        list(tables.paged([("a",)], page, tables.Budget(1)))
    with pytest.raises(tables.Transient):
        tables.attempt(lambda: (_ for _ in ()).throw(tables.Transient("down")), tables.Budget(0), retries=1, sleep=waits.append)


def test_snapshot_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", None)], "i int, s string, d double")
    whole = sinks.write_snapshot({"t": df}, str(tmp_path / "snap"), {"from": "2025-07-01"})
    assert spark.read.json(str(tmp_path / "snap" / "t")).count() == 1 and whole["outputs"]["t"]["n_rows"] == 1
    with pytest.raises(ValueError, match="read_only"):
        sinks.check_manifest(whole | {"read_only": False})
    with pytest.raises(ValueError, match="more than 0"):
        sinks.write_snapshot({"t": df}, str(tmp_path / "other"), {}, most_rows=0)
    with pytest.raises(ValueError, match="credential"):
        sinks.check_manifest(whole | {"parameters": {"api_key": "x"}})


def test_csv_with_a_byte_order_mark(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([("a", "é")], "k string, v string"), str(tmp_path / "out"), ["k", "v"], single=True, bom=True)
    raw = next((tmp_path / "out").glob("part-*.csv")).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf") and tables.read_text_csv(spark, str(tmp_path / "out")).first().asDict() == {"k": "a", "v": "é"}


def test_automatic_checks_need_one_current_row_that_agrees(spark):
    companies = spark.createDataFrame([("a",), ("b",)], "company_id string")
    events = spark.createDataFrame([("e",), ("e",)], "event_id string")
    links = spark.createDataFrame([("e", "a", "s", "true"), ("e", "b", " ", "false")], "event_id string, company_id string, source_event_id string, recommended string")
    study = lambda *rows: spark.createDataFrame(list(rows), "current boolean, same_as_current boolean")
    got = {r.metric: (r.status, r.actual) for r in R.automatic_checks(companies, events, links, study((True, True), (False, False))).collect()}
    assert got == {"canonical_company_coverage": ("FAIL", 1), "duplicate_canonical_event_ids": ("FAIL", 1), "duplicate_canonical_event_company_pairs": ("PASS", 0), "canonical_relationships_without_source_event": ("FAIL", 1), "current_threshold_reconstruction": ("PASS", 1), "graph_validation_failures": ("PASS", 0)}
    for rows in (((True, False),), ((True, True), (True, True)), ((False, True),)):
        bad = {r.metric: r.status for r in R.automatic_checks(companies, events, links, study(*rows)).collect()}
        assert bad["current_threshold_reconstruction"] == "FAIL"


def test_correlations_of_constants_are_null(spark):
    rows = spark.createDataFrame([(1.0, 2.0, 3.0, 1.0), (2.0, 2.0, 1.0, 2.0)], "event_count double, coevent_degree double, coevent_strength double, page_rank double")
    got = {(r.metric_1, r.metric_2): (r.pearson, r.spearman) for r in R.correlation_rows(rows).collect()}
    assert got["event_count", "coevent_degree"] == (None, None) and got["event_count", "coevent_strength"] == pytest.approx((-1.0, -1.0))
    assert all(r.pearson is None for r in R.correlation_rows(rows.limit(1)).collect())


def test_timed_runs_feed_the_latency_table(spark):
    from tidemark.operators.stages import latency

    runs = R.timed_runs({"t": spark.range(3)}, warm_ups=1, measured=3)
    row = latency(runs).first()
    assert runs.count() == 4 and row.runs == 3 and row.stable and row.min_ms <= row.median_ms <= row.p95_ms <= row.max_ms


def test_user_queries_are_read_only_and_keep_columns(spark):
    df = spark.createDataFrame([(1, "a")], "i int, s string")
    out = tables.read_query(spark, "SELECT s, i FROM {t} WHERE i > :least", {"t": df}, {"least": 5})
    assert out.columns == ["s", "i"] and out.count() == 0
    with pytest.raises(ValueError):
        tables.read_query(spark, "DROP TABLE x", {})


def test_package_keeps_a_backup(spark, tmp_path):
    at = str(tmp_path / "pkg")
    assert sinks.write_package({"t": spark.range(2)}, at) == {"t": 2}
    assert sinks.write_package({"t": spark.range(3)}, at, {"t": 3}) == {"t": 3}
    assert spark.read.parquet(f"{at}/t").count() == 3 and spark.read.parquet(f"{at}.backup/t").count() == 2
    with pytest.raises(ValueError):
        sinks.write_package({"t": spark.range(1)}, at, {"t": 3})
    assert spark.read.parquet(f"{at}/t").count() == 3


def test_typed_json(spark):
    cases = {"": None, " None ": None, "TRUE": True, "12": 12, "-0.5e3": -500.0, "007": "007", "2025-07-01": "2025-07-01", '["1", "x", "true", "", "nan", "2.5", "3"]': [1, "x", True, None, None, 2.5, 3], '{"1": "2", "k": {"z": ["-4"]}, "t": "say \\"5\\", ok"}': {"1": 2, "k": {"z": [-4]}, "t": 'say "5", ok'}, "[not json]": "[not json]", 'quote "q"': 'quote "q"'}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", C.typed_json(F.col("t")).alias("j")).collect()
    assert {r.t: json.loads(r.j) for r in rows} == cases
    assert spark.range(1).select(C.typed_json(F.lit(None).cast("string"))).first()[0] == "null"


def test_short_names(spark):
    names = ["Microsoft Corporation", "Acme Company", "JPMorgan Chase & Co.", "Company Inc.", "Plain"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(X.short_name(F.col("n"))).collect()]
    assert got == ["Microsoft", "Acme", "JPMorgan", "Company", "Plain"]


def test_requests_needed_and_informational_checks(spark):
    companies = spark.createDataFrame([("a",), ("b",)], "company_id string")
    windows = spark.createDataFrame([("1", "2"), ("3", "4")], "window_start string, window_end string")
    cached = spark.createDataFrame([("a", "1", "2"), ("b", "1", "2"), ("x", "1", "2")], "company_id string, window_start string, window_end string")
    assert T.requests_needed(companies, windows, cached) == 2 and T.requests_needed(companies, windows, cached, companies.where("company_id = 'b'")) == 3
    df = spark.createDataFrame([(True,), (False,)], "ok boolean")
    assert [T.quality_check(df, "x", F.col("ok"), informational=i).first().status for i in (True, False)] == ["INFO", "FAIL"]


def test_unique_texts_of_many_words(spark):
    import time

    words = [f"{'aB'[i % 2]}{i}" for i in range(30_000)]
    row = spark.createDataFrame([(words + [w.upper() for w in words],)], "w array<string>")
    began = time.time()
    assert row.select(X.unique_texts(F.col("w"), 4, 40)).first()[0] == ["a0", "B1", "a2", "B3"]
    assert time.time() - began < 30


def test_html_text_is_as_its_sql_on_odd_pages(spark, tmp_path):
    import duckdb

    import tidemark.plans.text_queries  # noqa: F401  registers its queries
    from tidemark.plans.catalog import ORACLE, QUERIES

    pages = ["a&&&amp p<b>x</b>&amp;lt;", None, "", "&eacute; &lt &lt; x\u00a0\u00a0y\x0bz \x85", "<!-- a\n> -->&nbsp; &#39;&#x27; <p\n>q", "a\u2003 b"]
    spark.createDataFrame(list(enumerate(pages)), "page_id bigint, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert dict(map(tuple, QUERIES["html_text"](spark, str(tmp_path)).collect())) == dict(con.sql(ORACLE["html_text"]).fetchall())


def test_returns_over_a_close_of_zero(spark):
    import datetime as dt

    from tidemark.operators import market as M

    closes = [0.0, 2.0, 0.0, 0.0]
    prices = spark.createDataFrame([("k", dt.date(2024, 1, 1 + i), c) for i, c in enumerate(closes)], "k string, date date, close double")
    aligned = spark.createDataFrame([("k", i) for i in (1, 2, 3)], "k string, anchor_pos int")
    got = {r.anchor_pos: r.cumulative_return for r in M.return_windows(aligned, prices, "k", (1,)).collect()}
    assert got[1] == float("inf") and got[2] == -1.0 and got[3] != got[3]


def test_signed_returns_are_rounded_as_their_sql(spark, tmp_path):
    """Returns a hair below half of the ninth place, over closes of 0, and under it."""
    import datetime as dt

    import duckdb

    import tidemark.plans.stage_queries  # noqa: F401  registers its queries
    from tidemark.plans.catalog import ORACLE, QUERIES

    closes = [51.2, 23.91, 51.2, 24.01, 358.4, 262.71, 0.0, 0.0, 5.0, 10.24, 0.01, 10.24, 560.21, 1e300, 1e-9, 5e9, 5e9 - 1e-6]
    rows = [(i, dt.datetime(2024, 1, 1 + i, 12, 0, i), 1, c) for i, c in enumerate(closes)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want, found = con.sql(ORACLE["signed_returns"]).fetchall(), QUERIES["signed_returns"](spark, str(tmp_path)).collect()
    assert len(want) > 60 and sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in found)
    odd = [0.5330078125, -0.5330078125, 1e300, -1e-12, 0.0, -0.0, float("inf"), float("-inf"), float("nan"), 2.5e-9, -3.5e-9, None]
    got = [r.x for r in spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "i int, x double").select("i", C.rounded(F.col("x"), 9).alias("x")).orderBy("i").collect()]
    assert list(map(repr, got)) == [repr(con.execute("SELECT round(?::DOUBLE, 9)", [x]).fetchone()[0]) for x in odd]


def test_signed_returns_without_a_time_or_a_value(spark, tmp_path):
    import datetime as dt

    import duckdb

    import tidemark.plans.stage_queries  # noqa: F401  registers its queries
    from tidemark.plans.catalog import ORACLE, QUERIES

    days = [dt.datetime(2024, 1, 1 + i % 16, 9 + i % 12, i) for i in range(48)]
    rows = [(i, None if i % 19 == 7 else d, i % 2, None if i % 7 == 3 else 1.0 + i) for i, d in enumerate(days)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want, found = con.sql(ORACLE["signed_returns"]).fetchall(), QUERIES["signed_returns"](spark, str(tmp_path)).collect()
    assert len(want) > 90 and sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in found)
