"""The corpus operators against brute force, and on the edge cases that each docstring names."""

import collections
import hashlib
import itertools
import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import hmm_lm, language_id, pieces
from tidemark.llm.common import stored
from tidemark.llm.components import components
from tidemark.llm.decontaminate import contaminated_words, drop_contaminated
from tidemark.llm.fingerprint import fingerprint_edits
from tidemark.llm.jaccard_join import keep_one, near_duplicates
from tidemark.llm.license_scan import LicenseIndex, scan_licenses
from tidemark.llm.line_dedup import drop_common_lines
from tidemark.llm.queries import QUERIES
from tidemark.llm.secret_scan import BlobLedger, spans_text
from tidemark.llm.shingles import shingle_sets
from tidemark.llm.token_counts import TokenLedger

SCHEMA = "doc_id bigint, text string"
LONG = "word " * 30_000
EDGE = [(1, None), (2, ""), (3, "  \n\t "), (4, "x"), (5, "same text here"), (5, "same text here"), (6, "Ünïcode – ß ✓ 🎉 ▁ text"), (7, LONG), (None, "no id")]
needs_tokenizers = pytest.mark.skipif(not os.path.isdir("/opt/tokenizers"), reason="no tokenizer files")


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(80)]
    texts = [" ".join(rng.choices(vocab, k=rng.choice([0, 1, 3, 4, 8, 30, 80]))) for _ in range(n)]
    for _ in range(n):
        t = rng.choice(texts).split(" ")
        for _ in range(rng.choice([0, 0, 1, 2])):
            t[rng.randrange(len(t))] = rng.choice(vocab)
        texts.append(" ".join(t))
    return [(i, t) for i, t in enumerate(texts)]


def test_line_dedup(spark):
    rows = [(i, f"Header \nown {i}\n header\t\n") for i in range(4)] + EDGE
    got = collections.defaultdict(list)
    for r in drop_common_lines(frame(spark, rows).withColumn("n_lines", F.lit("clash")), min_docs=4).collect():
        got[r.doc_id].append((r.text, r.n_lines, r.n_dropped))
    assert got[0] == [("own 0\n", 4, 2)]
    assert got[1] == [(None, 1, 0), ("own 1\n", 4, 2)] or sorted(got[1], key=str) == sorted([(None, 1, 0), ("own 1\n", 4, 2)], key=str)
    assert got[5] == [("same text here", 1, 0)] * 2 and got[7] == [(LONG, 1, 0)]
    assert drop_common_lines(frame(spark, []), min_docs=1).count() == 0


def brute_hits(text, items, window=10):
    w, hit, found = words(text), set(), set()
    for name, item in items:
        own = words(item)
        n = min(window, len(own))
        grams = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(name)
    return len(w), len(hit), found


@pytest.mark.parametrize("seed", [1, 2])
def test_decontamination(spark, seed):
    rows = corpus(seed)
    rng = random.Random(seed)
    items = [(i, " ".join(rng.choice(rows)[1].split(" ")[: rng.choice([1, 2, 9, 10, 40])])) for i in range(12)] + [(98, None), (99, "")]
    rows += [(1000 + i, f"x {LONG if i == 3 else ''} {t} y") for i, (_, t) in enumerate(items)] + EDGE
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    out = contaminated_words(frame(spark, rows).withColumn("items", F.lit(1)), bench).collect()
    want = collections.Counter((i, *brute_hits(t, items)[:2], frozenset(brute_hits(t, items)[2])) for i, t in rows)
    assert collections.Counter((r.doc_id, r.n_words, r.n_hit, frozenset(r["items"])) for r in out) == want
    kept = drop_contaminated(frame(spark, rows), bench)
    assert kept.columns == ["doc_id", "text"] and kept.count() == sum(not brute_hits(t, items)[1] for _, t in rows)
    assert contaminated_words(frame(spark, rows), bench.where("item_id > 500")).where("contaminated").count() == 0


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.setdefault(i, []).append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    root = {i: i for i in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(root, 2):
        if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_near_duplicates(spark, seed):
    rows = corpus(seed, 80) + [(500 + i, "copy of one text that many share, whole and exact") for i in range(20)] + [(2000 + (i or 0), t) for i, t in EDGE if i] + [(None, "no id"), (3000, "two texts of one id a b c d e"), (3000, rows_text := "copy of one text that many share, whole and exact")]
    assert rows_text
    out = near_duplicates(frame(spark, rows)).collect()
    want = brute_components(rows)
    assert {r.doc_id: r.component_id for r in out if r.doc_id is not None} == want and len(out) == len(rows)
    kept = keep_one(frame(spark, rows), 75).where("doc_id IS NOT NULL").select("doc_id").distinct().collect()
    assert {r.doc_id for r in kept} == {i for i, c in want.items() if i == c}
    assert near_duplicates(frame(spark, [])).count() == 0


def test_near_duplicate_groups_of_frequent_shingles(spark):
    """Large groups around common passages: the frequent class and its token pairs must lose nothing."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(300):
        t = list(base)
        for _ in range(rng.choice([0, 1, 2, 4])):
            t[rng.randrange(60)] = f"e{i}x{rng.random()}"
        rows.append((i, " ".join(t + [f"t{i}-{k}" for k in range(rng.choice([0, 3, 20, 60]))])))
    out = near_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in out} == brute_components(rows)


def test_shingles_hash_alike_in_any_company():
    a = list(shingle_sets(["a b c d e f", None, "A  b\tC d e"], 5))
    b = list(shingle_sets(["zz " * 2000, "a b c d e"], 5, chunk=10))
    assert len(a[0]) == 2 and len(a[1]) == 0 and a[2][0] in a[0] and b[1][0] == a[2][0] and len(b[0]) == 1


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 130)}}


def test_secrets_and_ledger(spark, tmp_path):
    samples = ["é🎉 token = 'abcdefgh12' and TOKEN:short password=\"x\"", "AKIA" + "A" * 16 + " AKIAshort", "f" * 40 + " " + "a" * 31, "token=token:abcdefghij", "see https://bob:secret99@host.example/ -----BEGIN RSA PRIVATE KEY-----", "api_key:" + "k" * 9 + " apikey=zzzzzzzz"]
    rows = list(enumerate(samples, 10)) + EDGE
    ledger = BlobLedger(spark, str(tmp_path / "ledger"))
    out = ledger.scan(frame(spark, rows), "doc_id", "0").select("doc_id", "text", spans_text(F.col("spans")).alias("s")).collect()
    assert len(out) == len(rows)

    def base(t):
        t, found = t or "", []
        pattern = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
        for n, (kind, p, least) in enumerate((("assign", pattern, 8), ("access", "AKIA[A-Z0-9]+", 16), ("hex", "[0-9a-f]+", 32))):
            found += [(m.start(), n, kind, m.end()) for m in re.finditer(p, t) if len(m[m.lastindex or 0]) >= least]
        return [f"{k}:{a}:{b}" for a, _, k, b in sorted(found)]

    for r in out:
        assert [x for x in r.s.split(",") if x.split(":")[0] in ("assign", "access", "hex")] == base(r.text)
    assert any("url_login" in r.s and "pem" in r.s for r in out)
    before = ledger.scanned().count()
    again = ledger.scan(frame(spark, [*rows, (99, "new token=" + "q" * 10)]), "doc_id", "1")
    assert ledger.scanned().count() == before + 1 and again.count() == len(rows) + 1
    assert BlobLedger(spark, str(tmp_path / "ledger"), rule_version="other").scanned().count() == 0


def test_fingerprints(spark):
    rows = corpus(6, 100) + [(5000, None), (5001, ""), (5002, "ß✓🎉"), (5003, LONG)] + [(7000, "tie b"), (7000, "tie a"), (7001, "twin of it"), (7002, "twin of it")]
    out = fingerprint_edits(frame(spark, rows), low=0.01, high=0.5).collect()
    order = sorted(rows, key=lambda r: (-r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()))
    want = collections.Counter()
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        t, n = t or "", n or ""
        k = len(t) // 3
        want[i, len(t), hashlib.sha256((t[: len(t) - k] + n[:k]).encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in out) == want
    by = {r.doc_id: r for r in out}
    assert by[7001].fingerprint == by[7002].fingerprint and by[7002].near_next == 1.0
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    assert fingerprint_edits(frame(spark, [(1, "alone here")])).first().near_next == 1.0
    assert fingerprint_edits(frame(spark, [])).count() == 0


def prose(rng, vocab, n):
    return " ".join(rng.choices(vocab, k=n))


def test_fingerprints_of_long_and_short_texts(spark):
    rng = random.Random(21)
    vocab = [f"w{i}" for i in range(4000)]
    rows = [(i, prose(rng, vocab, 900 if i % 2 else 20)) for i in range(120)]
    out = {r.doc_id: r for r in fingerprint_edits(frame(spark, rows), low=0.001, high=0.9).collect()}
    for part in (0, 1):  # two thirds of a text stay, half of all terms of both
        near = sorted(r.near_edited for i, r in out.items() if i % 2 == part)
        assert near[len(near) // 2] > 0.2 and near[len(near) // 10] > 0
    assert max(r.near_next for r in out.values()) < 0.5
    # a lexicon that is too large to broadcast is joined whole
    shuffled = {r.doc_id: r for r in fingerprint_edits(frame(spark, rows), low=0.001, high=0.9, max_terms=0).collect()}
    assert shuffled == out


def test_fingerprints_where_copies_hold_a_third(spark):
    rng = random.Random(22)
    vocab = [f"w{i}" for i in range(200)]
    hot = "hot copies with words of their own and " + prose(rng, vocab, 30)
    rows = [(i, hot) for i in range(60)] + [(100 + i, prose(rng, vocab, 40)) for i in range(120)]
    rows += [(900, "unlike anything"), (901, "wholly other words"), (902, "!!"), (903, "??"), (904, None), (905, "")]
    out = {r.doc_id: r for r in fingerprint_edits(frame(spark, rows), low=0.01, high=0.25).collect()}
    assert out[5].near_next == 1.0 and len({out[i].fingerprint for i in range(60)}) == 1
    # the hot text is told by the words it shares with others, though 60 rows hold them
    assert "".join(out[5].fingerprint.split("/")[1:]).strip("-") and out[5].fingerprint != out[100].fingerprint
    assert all(r.near_edited > 0.2 for i, r in out.items() if 0 < i < 60)  # two thirds stay
    told = [out[i].fingerprint for i in range(900, 906)]
    assert len(set(told)) == 5 and told[4] == told[5]
    assert out[901].near_next == 0 and out[903].near_next == 0


def test_licenses(spark):
    index = LicenseIndex()
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the 'Software'), to deal in the Software without restriction"
    rows = [(1, "MIT license MIT License"), (2, f"intro words {mit} tail"), (3, "the apache licensed GENERAL public license"), (4, None), (9, LONG)]
    got = {r.doc_id: r for r in scan_licenses(frame(spark, [(i + 10, t) for i, t in rows]).withColumn("labels", F.lit(0))).collect()}
    assert (got[11].n_base, got[11].first_word, got[11].last_word, got[11].base_labels) == (2, 0, 2, "mit")
    assert (got[14].n_base, got[14].first_word, got[14].base_labels, got[14].n_words) == (0, None, "", 0)
    assert got[13].base_labels == "gpl" and got[13].first_word == 3
    assert index.scan(mit)["score"] > 0.3 and index.scan(None)["n_words"] == 0
    whole = index.scan("x y z This work is licensed under the GNU General Public License, version 3. z")
    assert whole["labels"] == "gpl" and whole["license_spans"][0]["first"] == 3 and whole["license_spans"][0]["share"] == 1.0
    texts = ["a b c a b d".split(), "b c a c".split()]
    ids = {w: i for i, w in enumerate("abcd")}
    from tidemark.llm.license_scan import SuffixAutomaton

    sam = SuffixAutomaton([[ids[w] for w in t] for t in texts])
    rng = random.Random(1)
    for _ in range(50):
        s = rng.choices("abcd", k=12)
        for i, (n, _) in enumerate(sam.statistics([ids[w] for w in s])):
            runs = [k for k in range(1, i + 2) if any(s[i - k + 1 : i + 1] == t[j : j + k] for t in texts for j in range(len(t)))]
            assert n == max(runs, default=0)


def test_language_model_is_a_distribution_and_tells_languages(spark):
    rng = random.Random(3)
    make = lambda letters: " ".join("".join(rng.choices(letters, k=rng.randint(2, 6))) for _ in range(30))
    rows = [(i, make("abcde" if i % 2 else "fghij"), "one" if i % 2 else "two") for i in range(400)]
    labelled = spark.createDataFrame([*rows, (9000, None, "one"), (9001, "x", None), (9002, "x", "")], "doc_id bigint, text string, lang string")
    model = language_id.train(labelled)
    assert model.languages == ["one", "two"]
    packed = np.array([(ord("a") << 48) | (ord("b") << 32) | (ord("c") << 16) | c for c in [*range(97, 123), 32]], np.uint64)
    assert np.exp(model.log_probabilities(packed).astype(float))[:, 0].sum() == pytest.approx(1, abs=0.02)
    docs = frame(spark, [(1, "abc ade bcd"), (2, "FGH! hij 12"), *[(i, t) for i, t in EDGE if i != 1]]).withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert got[1].lang_pred == "one" and got[3].lang_pred == "und" and got[3].rejected and got[3].score == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language_id.identify(frame(spark, []), model).count() == 0
    bare = language_id.identify(docs, language_id.train(labelled.where("lang IS NULL"))).collect()
    assert {(r.lang_pred, r.score) for r in bare} == {("und", 0.0)} and all(r.rejected == (not any(c.isalpha() for c in r.text or "")) for r in bare)


def test_hidden_markov_model_against_all_paths(spark):
    rng = np.random.default_rng(2)
    model = hmm_lm.HiddenMarkov.initial(rng.uniform(1, 5, 5), 3)
    symbols, lengths = np.array([0, 3, 2, 4, 1, 4]), np.array([4, 2])
    got = model.forward(symbols, lengths)
    for like, seq in zip(got, ([0, 3, 2, 4], [1, 4]), strict=True):
        total = sum(model.start[p[0]] * model.emit[seq[0], p[0]] * math.prod(model.move[a, b] * model.emit[s, b] for a, b, s in zip(p, p[1:], seq[1:], strict=False)) for p in itertools.product(range(3), repeat=len(seq)))
        assert like == pytest.approx(math.log(total))
    like, starts, moves, emits = model.expected(symbols, lengths)
    assert (starts.sum(), moves.sum(), emits.sum()) == pytest.approx((2, 4, 6)) and like == pytest.approx(got.sum())


def test_scores_count_exactly_and_training_helps(spark):
    rows = corpus(7, 100)
    docs = frame(spark, [*rows, *[(i, t) for i, t in EDGE if i != 7]])
    learn = [(i, t) for i, t in rows if i % 7 != 2]
    out = hmm_lm.score_texts(docs, frame(spark, learn), states=3, rounds=3, symbols=30).collect()
    counts = collections.Counter(w for _, t in learn for w in [*t.encode().lower().split(), 0])
    n, v = sum(counts.values()), len(counts)
    texts = dict(rows)
    for r in out:
        if r.doc_id in texts and r.doc_id > 7:
            own = [*texts[r.doc_id].encode().lower().split(), 0]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), n)
            assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own))
    assert len(out) == len(rows) + len(EDGE) - 1 and sum(r.score for r in out) > sum(r.base_score for r in out)
    empty = hmm_lm.score_texts(docs, frame(spark, []), states=2, rounds=1).first()
    assert empty.train_tokens == 0 and empty.n_known == 0


@needs_tokenizers
def test_every_training_token_has_its_own_emissions(spark):
    rng = random.Random(11)
    left, right = ([f"{c}{i}" for i in range(30)] for c in "lr")
    learn = frame(spark, [(i, " ".join(rng.choices(left if i % 2 else right, k=12))) for i in range(200)])
    pure, mixed = " ".join(left[:12]), " ".join(x for p in zip(left[:6], right[:6], strict=True) for x in p)
    docs = frame(spark, [(1, pure), (2, mixed), (3, "never seen"), (None, None), (5, pure), (5, pure)])
    few, all_ = ({(r.doc_id, r.n_tokens): r for r in hmm_lm.score_texts(docs, learn, states=2, rounds=6, symbols=n).collect()} for n in (4, 1000))
    assert len(few) == 5 and few[1, 13].n_known == 13 and few[3, 3].n_known == 1
    for k, r in few.items():  # what is broadcast does not change what is learnt
        assert r.score == pytest.approx(all_[k].score, rel=1e-4) and r.base_score == pytest.approx(all_[k].base_score)
    assert few[1, 13].score > few[2, 13].score + 1


def test_token_ledger(spark, tmp_path):
    schema = "doc_id bigint, source string, lang string, text string"
    ledger = TokenLedger(spark, str(tmp_path / "ledger"))
    total = lambda: {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens, r.n_chars) for r in ledger.totals().collect()}
    assert total() == {}
    docs = spark.createDataFrame([(1, "s", "en", "hello world"), (2, "s", "en", "again"), (2, "s", "en", "again"), (3, None, None, None)], schema)
    assert ledger.commit("a", inserts=docs) and not ledger.commit("a", inserts=docs)
    first = total()
    assert first["s", "en", "byte_bpe_50k.tiktoken"][0::2] == (3, 21) and first[None, None, "byte_bpe_50k.tiktoken"] == (1, 0, 0)
    ledger.commit("b", deletes=spark.createDataFrame([(2,), (77,)], "doc_id bigint"), revisions=spark.createDataFrame([(1, "t", "en", "hello world, revised")], schema))
    fresh = TokenLedger(spark, str(tmp_path / "other"))
    fresh.commit("x", inserts=spark.createDataFrame([(1, "t", "en", "hello world, revised"), (3, None, None, None)], schema))
    assert total() == {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens, r.n_chars) for r in fresh.totals().collect()}
    ledger.commit("c")
    with pytest.raises(ValueError):
        ledger.commit("../x")


@needs_tokenizers
def test_nbest_against_all_segmentations(spark):
    model = pieces.load()

    def every(line):
        """All segmentations, from the vocabulary alone."""
        if not line:
            return [(0.0, [])]
        out = []
        for n in range(1, len(line) + 1):
            own = [(model.scores[line[:n]], [model.ids[line[:n]]])] if line[:n] in model.ids else []
            if n == 1 and not own:
                raw = "▁".encode() if line[0] == pieces.LITERAL else line[0].encode()
                own = [(model.byte_score * len(raw), [model.byte_ids[x] for x in raw])]
            out += [(s + t, [*ids, *more]) for s, ids in own for t, more in every(line[n:])]
        return sorted(out, key=lambda x: -x[0])

    rng = random.Random(5)
    for _ in range(150):
        text = "".join(rng.choices("ab e  th\n▁éé漢🎉ing.,", k=rng.randint(1, 10)))
        raw, best = model.encode(text)
        ids = np.frombuffer(raw, np.int32).tolist()
        got = []
        for score, edits in best:
            own = list(ids)
            for at, drop, put in sorted(edits, reverse=True):
                own[at : at + drop] = put
            got.append((score, own))
            assert model.decode(own) == text
        want = every("▁" + text.replace("▁", pieces.LITERAL).replace(" ", "▁"))[:4]
        assert [s for s, _ in got] == pytest.approx([s for s, _ in want]) and len({tuple(x) for _, x in got}) == len(want)
    out = pieces.decode_pieces(pieces.encode_pieces(frame(spark, EDGE))).collect()
    assert all(r.decoded == (r.text or "") for r in out) and len(out) == len(EDGE)
    assert pieces.encode_pieces(frame(spark, [])).count() == 0


@needs_tokenizers
def test_nbest_query_returns_ids_that_give_the_text(spark, tmp_path):
    frame(spark, [e for e in EDGE if e[0] != 7]).write.parquet(str(tmp_path / "documents.parquet"))
    rows = QUERIES["op10_sentencepiece_nbest"](spark, str(tmp_path))
    texts = {i: t or "" for i, t in EDGE}
    model = pieces.load(None)
    assert all(model.decode(r.ids) == texts[r.doc_id] and r.n_tokens == len(r.ids) and r.round_trip for r in rows.collect())


@needs_tokenizers
def test_pipeline_decodes_what_it_encodes(spark):
    name, stage = corpus_pipeline.STAGES[-1]
    rows = stage(spark, frame(spark, [e for e in EDGE if e[0] != 7]), "").collect()
    assert name == "sentencepiece" and len(rows) == len(EDGE) - 1 and all(r.round_trip for r in rows)


def test_stored_rereads_what_was_written(spark):
    assert stored(frame(spark, EDGE), "t").count() == len(EDGE)
