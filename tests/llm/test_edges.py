"""Cases that are easily lost: clashing names, repeated batches, long runs of one letter, single-document languages, hot passages."""

import collections
import hashlib
import math
import os
import random
import re
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import EDGE, LONG, brute_components, brute_hits, corpus, frame, needs_tokenizers, words

import corpus_pipeline
from tidemark.llm import hmm_lm, jaccard_join, language_id, license_scan, pieces, token_counts
from tidemark.llm.common import word_array
from tidemark.llm.decontaminate import contaminated_words, drop_contaminated
from tidemark.llm.fingerprint import edited, fingerprint_edits, lexicon, likeness, with_next
from tidemark.llm.jaccard_join import keep_one, near_duplicates
from tidemark.llm.license_texts import TEMPLATES
from tidemark.llm.line_dedup import drop_common_lines
from tidemark.llm.queries import ORACLE, QUERIES
from tidemark.llm.secret_scan import BlobLedger, spans_text
from tidemark.llm.token_counts import TokenLedger

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def clash(docs):
    """Columns with the names that operators use within themselves."""
    for c in ("_id", "_th", "_dh", "_drop", "_lines", "_hits", "_w", "_blob", "_spans", "_gone", "_p", "th", "n", "pos", "key", "h", "g", "b", "q"):
        docs = docs.withColumn(c, F.lit(c))
    return docs


def test_clashing_columns_pass_through(spark):
    rows = [(i, f"Header\nown {i} a b c d e f g h i j k") for i in range(4)] + EDGE
    bench = spark.createDataFrame([(1, "own 2 a b c d e f g h i")], "item_id bigint, text string")
    docs = clash(frame(spark, rows))
    for made in (drop_common_lines(docs, min_docs=4), contaminated_words(docs, bench), drop_contaminated(docs, bench), keep_one(docs)):
        got = made.collect()
        assert got and all(r._id == "_id" and r._th == "_th" and r.key == "key" and r._gone == "_gone" for r in got) and made.columns[: len(docs.columns)] == docs.columns
    assert contaminated_words(docs, bench).where("contaminated").count() == 1


def test_clashing_columns_in_the_ledger(spark, tmp_path):
    out = BlobLedger(spark, str(tmp_path)).scan(clash(frame(spark, EDGE)), "doc_id", "a")
    assert out.count() == len(EDGE) and out.first()._blob == "_blob"


def test_a_batch_of_the_ledger_may_come_again(spark, tmp_path):
    ledger = BlobLedger(spark, str(tmp_path))
    docs = frame(spark, [*[(1, "token=abcdefgh99")] * 5, (2, "token=abcdefgh99"), (3, "nothing")])
    for _ in range(3):
        out = ledger.scan(docs, "doc_id", "same")
        assert collections.Counter((r.doc_id, r.s) for r in out.select("doc_id", spans_text(F.col("spans")).alias("s")).collect()) == {(1, "assign:0:16"): 5, (2, "assign:0:16"): 1, (3, ""): 1}
        assert ledger.scanned().count() == 2 and ledger.findings().count() == 1
    ledger.scan(frame(spark, [(9, "secret: zyxwvuts1")]), "doc_id", "same")
    assert ledger.scanned().count() == 3 and ledger.findings().count() == 2
    (tmp_path / "scans" / "half").mkdir()  # a scan that broke off has no marker
    assert ledger.scanned().count() == 3
    with pytest.raises(ValueError):
        ledger.scan(docs, "doc_id", "../x")


def test_many_matches_in_one_text(spark, tmp_path):
    n = 60_000
    text = "".join(f"token={i:08d}x; " for i in range(n))
    start = time.time()
    spans = BlobLedger(spark, str(tmp_path)).scan(frame(spark, [(1, text)]), "doc_id", "a").first().spans
    assert [(s.start, s.stop) for s in spans] == [(m.start(), m.end()) for m in re.finditer(r"token=\w+", text)]
    assert time.time() - start < 60


def test_near_duplicates_of_string_ids(spark):
    rows = corpus(8, 40)
    named = spark.createDataFrame([(f"d{i:05d}", t) for i, t in rows], "doc_id string, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates(named).collect()} == {f"d{i:05d}": f"d{c:05d}" for i, c in brute_components(rows).items()}


def test_copies_bring_their_keys_whichever_task_meets_them(spark, monkeypatch):
    """Exact copies over many partitions, their least doc_id last, near copies beside them, and a task that remembers nothing."""
    rng = random.Random(31)
    base = [f"w{i}" for i in range(50)]
    near = [*base[:49], "other"]
    rows = [(500 - i, " ".join(base)) for i in range(60)] + [(1000 + i, " ".join(near)) for i in range(30)] + [(2000 + i, " ".join(rng.choices(base, k=40))) for i in range(20)] + [(3, "  ".join(base).upper())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(9)
    want = brute_components(rows)
    assert {r.doc_id: r.component_id for r in near_duplicates(docs).collect()} == want
    monkeypatch.setattr(jaccard_join, "REMEMBERED", 0)
    assert {r.doc_id: r.component_id for r in near_duplicates(docs).collect()} == want


def passage_rows(n, seed=7):
    """n texts around one passage, each with words of its own, most of them just below the threshold against each other."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(120)]
    return [(i, " ".join([f"a{i}x{k}" for k in range(rng.randint(0, 16))] + passage + [f"b{i}x{k}" for k in range(rng.randint(0, 16))])) for i in range(n)]


def test_a_passage_in_all_texts(spark, monkeypatch):
    """Nothing is lost, and what is tested grows with the number of texts and not with its square."""
    tested, own = [], jaccard_join._linked
    monkeypatch.setattr(jaccard_join, "_linked", lambda docs, pairs, *a: (tested.append(pairs.count()), own(docs, pairs, *a))[1])
    sizes = {}
    for n in (150, 600):
        rows = passage_rows(n)
        tested.clear()
        got = {r.doc_id: r.component_id for r in near_duplicates(frame(spark, rows)).collect()}
        assert got == brute_components(rows)
        sizes[n] = sum(tested)
    assert sizes[600] < 8 * sizes[150] and sizes[600] < 600 * 20


def test_sketches_bound_the_overlap():
    rng = np.random.default_rng(3)
    for n in (3, 60, 400, 3000):
        a, b = (np.unique(rng.integers(0, 4 * n, n).astype(np.uint64)) for _ in range(2))
        apart = sum(int(x).bit_count() for x in (jaccard_join.sketch(a) ^ jaccard_join.sketch(b)).view(np.uint64))
        assert (len(a) + len(b) - apart) / 2 >= len(np.intersect1d(a, b))


def test_language_models_lose_no_language(spark):
    rng = random.Random(2)
    make = lambda letters, n=30: " ".join("".join(rng.choices(letters, k=rng.randint(2, 6))) for _ in range(n))
    for seed in range(6):
        rows = [(i + 100 * seed, make("abcde"), "one") for i in range(40)] + [(9000 + seed, make("fghij"), "two"), (9100 + seed, make("klmno", 4000), "three"), (9200, "12 !?", "none"), (9300, None, "null")]
        model = language_id.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), max_chars=5000)
        assert model.languages == ["one", "three", "two"] and set(model.limits) == set(model.languages)
    names = model.classify(["abc ade", "fgh jih", "mno klm", "", None, "́̂", "�￿", "123"])
    assert list(names[0]) == ["one", "two", "three", *["und"] * 5] and not names[1][3:].any() and names[3][3:].all()
    many = [(i, make("abcde", 5 + i), f"l{i:02d}") for i in range(9)]
    assert language_id.train(spark.createDataFrame(many, "doc_id bigint, text string, lang string"), max_languages=4).languages == ["l05", "l06", "l07", "l08"]
    empty = language_id.train(spark.createDataFrame([], "doc_id bigint, text string, lang string"))
    assert empty.languages == [] and language_id.identify(frame(spark, []), empty).count() == 0
    assert list(language_id.letters("\U00010400 á")) == [0xFFFF, 32, ord("a"), 0x301]


def test_language_models_learn_every_label(spark, monkeypatch):
    """More labels than a group holds: all are learnt, and the grouping changes no result."""
    rng = random.Random(8)
    alphabets = ["".join(chr(0x4E00 + 7 * i + k) for k in range(7)) for i in range(150)]
    make = lambda letters, n: " ".join("".join(rng.choices(letters, k=rng.randint(2, 6))) for _ in range(n))
    rows = [(1000 * j + i, make(letters, 20 if j else 200), f"l{j:03d}") for j, letters in enumerate(alphabets) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    answers = lambda model: {r.doc_id: (r.lang_pred, r.score, r.cross_entropy, r.rejected) for r in language_id.identify(docs, model).collect()}
    model = language_id.train(docs)
    assert model.languages == [f"l{j:03d}" for j in range(150)] and set(model.limits) == set(model.languages)
    found = answers(model)
    assert {i: a[0] for i, a in found.items()} == {i: lang for i, _, lang in rows}
    monkeypatch.setattr(language_id, "CELLS", 1 << 40)
    whole = language_id.train(docs, group=1000)
    assert len(model.groups) >= 3 and len(whole.groups) == 1 and whole.temperature == model.temperature
    for i, (lang, score, entropy, rejected) in answers(whole).items():
        assert (lang, rejected) == (found[i][0], found[i][3]) and (score, entropy) == pytest.approx(found[i][1:3], rel=1e-4)
    mixed = [make(alphabets[0] + alphabets[149], 30), "", None, *[t for _, t, _ in rows[::50]]]
    for a, b in zip(model.classify(mixed), whole.classify(mixed), strict=True):
        assert list(a) == (list(b) if isinstance(a, list) else pytest.approx(list(b), rel=1e-4))
    parts = language_id._count_grams(iter(docs.select("text", "lang").toArrow().to_batches()), most=500)
    counted = collections.Counter()
    for lang, gram, n in (x for batch in parts for x in zip(*(c.to_pylist() for c in batch.columns), strict=True)):
        counted[lang, gram] += n
    assert sum(counted.values()) == sum(len(t) + 1 for _, t, _ in rows)


def test_foreign_and_random_texts_are_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet") if os.path.isdir(SF) else pytest.skip("no test tables")
    model = language_id.train(docs)
    rng = random.Random(4)
    noise = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz    ", k=300))
    assert all(model.classify([noise, "Это русский текст о том, что происходит в мире, и дальше", "αυτό είναι ένα ελληνικό κείμενο για δοκιμή"])[3])
    assert language_id.identify(docs, model).where("rejected").count() == 0


def test_base_places_of_licences_by_brute_force():
    index = license_scan.LicenseIndex()
    rng = random.Random(12)
    for _ in range(200):
        text = " ".join(rng.choices(["MIT", "license", "Apache", "general", "public", "x", "mit", "é"], k=rng.randint(0, 30)))
        w, places, labels = words(text), [], set()
        for phrase, label in license_scan.PHRASES:
            p = phrase.split()
            own = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            places += own
            labels |= {label} if own else set()
        got = index.scan(text)
        assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"], got["base_labels"]) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))


def test_licence_texts_edited_and_embedded():
    index = license_scan.LicenseIndex()
    rng = random.Random(13)
    for label, text in TEMPLATES:
        own = text.split()
        if len(own) < 40:
            assert label in index.scan(f"see below {text} thanks")["labels"].split(",")
            continue
        for k in range(0, len(own), 25):  # a word in 25 is another
            own[k] = f"edit{k}"
        got = index.scan(" ".join([f"pre{i}" for i in range(9)] + own + ["post"] * 9))
        span = next(s for s in got["license_spans"] if s["label"] == label)
        assert label in got["labels"].split(",") and 0.6 <= span["share"] <= 1 and span["first"] >= 9 and span["stop"] <= 9 + len(words(" ".join(own)))
    shuffled = " ".join(rng.sample(TEMPLATES[1][1].split(), len(TEMPLATES[1][1].split())))
    assert index.scan(shuffled)["labels"] == ""
    start = time.time()
    assert index.scan("mit license " * 100_000)["n_base"] == 100_000 and time.time() - start < 10


def likeness_of(a, b):
    """By hand, of two fingerprints."""
    if a == b:
        return 1.0
    (la, *xa), (lb, *xb) = a.split("/"), b.split("/")
    at = lambda level, slots: {int(level) + i: s.split("-") for i, s in enumerate(slots)}
    x, y = at(la, xa), at(lb, xb)
    pairs = [p for level in x.keys() & y.keys() for p in zip(x[level], y[level], strict=True)]
    told = sum(p != ("", "") for p in pairs)
    return sum(p[0] == p[1] != "" for p in pairs) / told if told else 0.0


def test_lexicon_and_likeness_by_brute_force(spark):
    rows = corpus(17, 80) + [(7000 + i, "copies of one text count once") for i in range(30)] + [(8000, None)]
    docs = frame(spark, rows)
    distinct = {t or "" for _, t in rows}
    df = collections.Counter(w for t in distinct for w in set(words(t)))
    low, high = max(2.0, 0.02 * len(distinct)), max(0.4 * len(distinct), 2.0)
    got = {r.term for r in lexicon(docs.select(F.coalesce("text", F.lit("")).alias("text")), 0.02, 0.4).collect()}
    assert got == {w for w, n in df.items() if low <= n <= high}
    out = fingerprint_edits(docs, low=0.02, high=0.4).collect()
    assert all(r.near_edited == pytest.approx(likeness_of(r.fingerprint, r.edited_fingerprint)) for r in out)
    order = sorted(out, key=lambda r: -r.doc_id)
    prints = {r.doc_id: r.fingerprint for r in out}
    for r, n in zip(order, order[1:] + order[:1], strict=True):
        if [x.doc_id for x in out].count(n.doc_id) == 1:
            assert r.near_next == pytest.approx(likeness_of(r.fingerprint, prints[n.doc_id]))
    # texts of the same band terms have the same fingerprint, others nearly always another: a term may miss all sub-lexicons
    terms = {r.doc_id: frozenset(w for w in words(dict(rows)[r.doc_id]) if w in got) for r in out}
    same = collections.defaultdict(set)
    for r in out:
        if terms[r.doc_id]:
            same[terms[r.doc_id]].add(r.fingerprint)
    assert all(len(x) == 1 for x in same.values()) and len({min(x) for x in same.values()}) > 0.95 * len(same)


def test_next_rows_over_many_ranges(spark):
    rng = random.Random(5)
    ids = rng.sample(range(10_000), 300)
    rows = [(i, f"text {i}") for i in ids] + [(ids[0], f"more {k}") for k in range(25)] + [(None, "none a"), (None, "none b")]
    out = with_next(frame(spark, rows), rows_per_bucket=7).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.sha256(r[1].encode()).hexdigest()))
    by = {r.text: r for r in out}
    assert len(out) == len(rows) and len({r._rid for r in out}) == len(rows)
    for (_, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        assert by[t]._next_text == n and by[t]._next_rid == by[n]._rid


def test_edited_text_of_short_and_empty_followers(spark):
    df = spark.createDataFrame([("abcdef", "X"), ("abcdef", None), (None, "x"), ("ab", "yy"), ("🎉🎉🎉", "é")], "a string, b string")
    assert [r.e for r in df.select(edited(F.col("a"), F.col("b")).alias("e")).collect()] == ["abcdX", "abcd", "", "ab", "🎉🎉é"]
    assert df.select(likeness(F.lit("0/a/b"), F.lit("0/a/")).alias("x")).first().x == 0.5


def test_training_does_not_depend_on_partitions(spark):
    rows = corpus(9, 80)
    docs = frame(spark, [*rows, (9001, None), (9002, ""), (9003, LONG), (None, "no id")])
    got = []
    for n in (1, 7):
        out = hmm_lm.score_texts(docs, spark.createDataFrame(rows, "doc_id bigint, text string").repartition(n), states=3, rounds=3, symbols=20).collect()
        got.append(sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), r.score) for r in out))
    for a, b in zip(*got, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-3)
    by = {x[0]: x for x in got[0]}
    assert by[9001][1:5] == by[9002][1:5] and by[9001][1] == 1 and by[9003][1] == 30_001 and by[-1][1] == 3


@needs_tokenizers
def test_token_totals_by_brute_force_and_compaction(spark, tmp_path):
    schema = "doc_id bigint, source string, lang string, text string"
    rng = random.Random(6)
    rows = [(i, f"s{i % 3}", rng.choice(["en", None]), t) for i, t in corpus(10, 40)] + [(500, "s0", "en", None), (None, "s1", "en", "no id")]
    ledger = TokenLedger(spark, str(tmp_path / "ledger"))

    def direct(rows):
        out = collections.defaultdict(lambda: [0, 0, 0])
        for _, source, lang, text in rows:
            for name in token_counts.VERSIONS:
                n = len(token_counts.encoding(token_counts.TOKENIZER_DIR, name).encode_ordinary(text or ""))
                for k, x in enumerate((1, n, len(text or ""))):
                    out[source, lang, name][k] += x
        return {k: tuple(v) for k, v in out.items()}

    def totals():
        return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens, r.n_chars) for r in ledger.totals().collect()}

    ledger.commit("one", inserts=spark.createDataFrame(rows, schema))
    assert totals() == direct(rows)
    revised = [(i, "s9", "en", f"{t} revised") for i, _, _, t in rows if i is not None and i % 5 == 0 and i < 100]
    gone = {i for i, *_ in rows if i is not None and i % 7 == 0}
    touched = gone | {r[0] for r in revised}
    for _ in range(2):
        ledger.commit("two", deletes=spark.createDataFrame([(i,) for i in gone], "doc_id bigint"), revisions=spark.createDataFrame(revised, schema))
    stands = [r for r in rows if r[0] not in touched] + revised
    assert totals() == direct(stands)
    ledger.compact()
    ledger.compact()
    assert totals() == direct(stands) and not ledger.commit("two", inserts=spark.createDataFrame(rows, schema))
    ledger.commit("three", deletes=spark.createDataFrame([(r[0],) for r in revised], "doc_id bigint"))
    assert totals() == direct([r for r in rows if r[0] not in touched])


@needs_tokenizers
@pytest.mark.parametrize("text", ["a" * 100_000, "ha" * 50_000, "=" * 50_000, "é" * 20_000, "ab " * 30_000])
def test_long_runs_are_encoded_at_once(text):
    model = pieces.load()
    start = time.time()
    ids, best = model.encode(text)
    assert model.decode(np.frombuffer(ids, np.int32).tolist()) == text and time.time() - start < 10
    scores = [s for s, _ in best]
    assert scores == sorted(scores, reverse=True)


@needs_tokenizers
def test_chunks_searched_together_and_singly_agree():
    rng = random.Random(8)
    model = pieces.load()
    made = ["".join(rng.choices("abcdefghilmnorstu▁éè.,", k=rng.randint(1, 40))) for _ in range(3000)]
    cuts = model.cut_all(made)
    for chunks, at in cuts:
        for c, i in zip(chunks, at.tolist(), strict=True):
            ids, score, loss = model.parts(c)
            assert (model.best[i], model.score[i], model.loss[i]) == (ids, score, loss)
            if len(c) < 12:
                two = model.search(c, 2)
                assert two[0][0] == pytest.approx(score) and (loss == math.inf) == (len(two) == 1)
                assert len(two) == 1 or two[0][0] - two[1][0] == pytest.approx(loss, abs=1e-9)


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    """Each stage by itself on small texts, nulls and ties among them."""
    rng = random.Random(14)
    bench = [(i, " ".join(f"q{i}w{k}" for k in range(14))) for i in range(3)]
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(i, t, "en", "s", len(t)) for i, t in corpus(15, 60)] + [(900 + i, f"start of it {t} end", "en", "s", 1) for i, t in bench]
    rows += [(2000 + i, f"Shared line\n{' '.join(rng.choices('abcdefgh', k=9))}\n shared LINE", "en", "s", 7) for i in range(12)] + [(5000, None, None, None, None), (5001, "", "en", None, 0), (5002, "12 !", "en", "s", 4), (5002, "12 !", "en", "s", 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    out = stage("language_id")(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.collect()}
    assert kept <= {r[0] for r in rows if any(c.isalpha() for c in r[1] or "")} and len(kept) > 0.95 * len({r[0] for r in rows if any(c.isalpha() for c in r[1] or "")})

    out = stage("line_dedup")(spark, docs, str(tmp_path)).collect()
    held = collections.defaultdict(set)
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            held[line.strip(" \t\n\x0b\f\r").lower()].add(i)
    common = {k for k, v in held.items() if len(v) >= 10 and k}
    want = collections.Counter()
    for i, t, _, _, n in rows:
        own = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\f\r").lower() not in common]
        dropped = len(own) < len((t or "").split("\n"))
        want[i, "\n".join(own) if dropped else t, len("\n".join(own)) if dropped else n] += 1
    assert common and collections.Counter((r.doc_id, r.text, r.n_chars) for r in out) == want

    out = stage("near_duplicates")(spark, docs, str(tmp_path))
    roots = brute_components([(i, t) for i, t, *_ in rows])
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == sorted(i for i, *_ in rows if roots[i] == i)

    out = stage("decontamination")(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == sorted(i for i, t, *_ in rows if not brute_hits(t, bench)[1])

    out = stage("sentencepiece")(spark, docs, str(tmp_path))
    assert out.count() == len(rows) and out.where("NOT round_trip").count() == 0


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name, query in QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name


@needs_tables
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_on_whole_tables(spark, name):
    """Every query runs as registered and gives a row for each document; what its contract fixes is held against brute force elsewhere."""
    out = QUERIES[name](spark, SF)
    ids = sorted(r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
    if name == "op2_token_counts":
        texts = [(r.source, r.lang, r.text.replace("\n", " ")) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r.text or "") >= 100]
        want = collections.Counter()
        for source, lang, text in texts:
            for tokenizer in token_counts.VERSIONS:
                want[source, lang, tokenizer] += len(token_counts.encoding(token_counts.TOKENIZER_DIR, tokenizer).encode_ordinary(text))
        assert {(r.source, r.lang, r.tokenizer): r.n_tokens for r in out.collect()} == dict(want)
    else:
        assert sorted(r.doc_id for r in out.select("doc_id").collect()) == ids


@needs_tables
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, rel = QUERIES[name](spark, SF), con.sql(ORACLE[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    got = sorted(tuple(r) for r in df.select(*columns).collect())
    assert got == sorted(rel.project(", ".join(columns)).fetchall())


@needs_tables
def test_near_duplicates_on_whole_tables_by_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert {r.doc_id: r.component_id for r in QUERIES["op5_ngram_jaccard_join"](spark, SF).collect()} == brute_components(rows)


def test_word_arrays(spark):
    rows = frame(spark, EDGE).select("text", word_array(F.col("text")).alias("w")).collect()
    assert all(r.w == words(r.text) for r in rows)
