"""Rule scoring: classification of spans and articles, span choice, focus, gates, grammar calibration."""

from __future__ import annotations

import re
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import GateConfig, RuleConfig
from ..functions.columns import nonblank, parse_bool
from ..functions.text import ANAPHORA, array_hits, evidence_units, sentences, term_hits


def _verdict(scores: dict[str, Column], rules: RuleConfig) -> dict[str, Column]:
    """Type, score, confidence, others and tie of scores in order of priority."""
    best = F.greatest(*scores.values(), F.lit(0))
    chosen = F.lit(rules.default_type)
    for name in reversed(list(scores)):
        chosen = F.when((scores[name] == best) & (best > 0), F.lit(name)).otherwise(chosen)
    ties = sum([(s == best).cast("int") for s in scores.values()], F.lit(0))
    return {
        "event_type": chosen,
        "event_score": best,
        "confidence": F.when(best >= rules.high_score, "high").when(best >= rules.medium_score, "medium").otherwise("low"),
        "secondary_types": F.array_compact(F.array(*[F.when((s > 0) & (chosen != n), F.lit(n)) for n, s in scores.items()])),
        "tie": (best > 0) & (ties > 1),
    }


def _hint(section: Column, name: str, rules: RuleConfig) -> Column:
    own = [s for s, t in rules.section_hints.items() if t == name]
    return F.when(section.isin(own), rules.section_weight).otherwise(0) if own else F.lit(0)


def classify_span(df: DataFrame, span: str, section: str | None = None, rules: RuleConfig = RuleConfig()) -> DataFrame:
    """df with event_type, event_score, confidence, secondary_types and tie of the span's own words."""
    place = F.col(section) if section else F.lit(None).cast("string")
    scores = {n: rules.span_weight * F.size(term_hits(F.col(span), words)) + F.coalesce(_hint(place, n, rules), F.lit(0)) for n, words in rules.keywords.items()}
    return df.withColumns({f"_s{i}": s for i, s in enumerate(scores.values())}).withColumns(_verdict({n: F.col(f"_s{i}") for i, n in enumerate(scores)}, rules)).drop(*[f"_s{i}" for i in range(len(scores))])


def _count(words: tuple[str, ...], column: str) -> Column:
    return F.size(term_hits(F.col(column), words))


def classify_article(df: DataFrame, rules: RuleConfig = RuleConfig(), section: str = "section_name") -> DataFrame:
    """The same from headline, trail_text and body_text, each with its weight; body hits count up to a limit."""
    scores = {}
    for i, (name, words) in enumerate(rules.keywords.items()):
        hits = partial(_count, words)
        scores[name] = (f"_s{i}", rules.headline_weight * hits("headline") + rules.trail_weight * hits("trail_text") + rules.body_weight * F.least(hits("body_text"), F.lit(rules.body_most)) + F.coalesce(_hint(F.col(section), name, rules), F.lit(0)))
    out = df.withColumns({c: s for c, s in scores.values()})
    return out.withColumns(_verdict({n: F.col(c) for n, (c, _) in scores.items()}, rules)).drop(*[c for c, _ in scores.values()])


def select_spans(articles: DataFrame, links: DataFrame, key: str, rules: RuleConfig = RuleConfig()) -> DataFrame:
    """The strongest spans of each (article, company) link: links have key, company_id, core_aliases, product_aliases, query_returned.

    Units that name the company are scored; the best are taken in turn unless they overlap one taken
    before, up to spans_per_link.  Without any keyword the best single sentence is taken alone.
    """
    units = evidence_units(sentences(articles, key), key, rules.sentences_per_span, rules.span_characters)
    aliases = F.array_distinct(F.concat("core_aliases", "product_aliases"))
    rows = links.withColumn("_aliases", aliases).join(units, key)
    rows = rows.where(F.exists("_aliases", lambda a: F.regexp_like(F.col("evidence"), F.concat(F.lit("(?iU)(?<!\\w)\\Q"), a, F.lit("\\E(?!\\w)")))))
    rows = rows.withColumn("keywords", term_hits(F.col("evidence"), rules.all_keywords))
    rows = rows.withColumn("_words", F.transform("sentences", lambda s: F.size(term_hits(s, rules.all_keywords)) > 0)).withColumn("_named", F.transform("sentences", lambda s: F.size(array_hits(s, F.col("_aliases"))) > 0)).withColumn("_ana", F.transform("sentences", lambda s: s.rlike(ANAPHORA)))
    same = F.exists(F.arrays_zip("_words", "_named"), lambda z: z["_words"] & z["_named"])
    spots = F.sequence(F.lit(0), F.col("n") - 1)
    linked = F.exists(spots, lambda i: F.get("_named", i) & F.exists(spots, lambda j: (i < j) & F.get("_words", j) & F.get("_ana", j)))
    many, any_word = F.col("n") > 1, F.size("keywords") > 0
    rows = rows.withColumn("_same", same).where(~(many & F.col("_same")) & ~(many & any_word & ~linked))
    source = F.when(F.col("source") == "headline", rules.headline_weight).when(F.col("source") == "trail_text", rules.trail_weight).otherwise(rules.body_weight)
    bonus = F.when(F.col("_same"), rules.same_sentence_bonus).when(any_word & many, rules.adjacent_bonus).otherwise(0)
    score = 10 * any_word.cast("int") + 2 * F.least(F.size("keywords"), F.lit(3)) + bonus + source + (F.size("core_aliases") > 0).cast("int") + parse_bool(F.col("query_returned")).cast("int") - (F.col("n") - 1)
    rows = rows.withColumn("selection_score", score)
    pair = [key, "company_id"]
    best = [F.col("selection_score").desc(), F.col("_same").desc(), F.col("n").asc(), F.col("position").asc()]
    w = W.partitionBy(*pair)
    rows = rows.withColumn("_any", F.max(any_word).over(w)).where((F.col("_any") & any_word) | (~F.col("_any") & (F.col("n") == 1)))
    rows = rows.withColumn("_rank", F.row_number().over(w.orderBy(*best))).where(F.col("_any") | (F.col("_rank") == 1))
    keep = F.struct("_rank", "source", "position", "n", "evidence", "keywords", "selection_score", F.sequence(F.col("position"), F.col("position") + F.col("n") - 1).alias("places"))
    listed = rows.groupBy(*pair).agg(F.array_sort(F.collect_list(keep)).alias("_all"))
    empty = F.slice("_all", 1, 0)
    taken = F.aggregate("_all", empty, lambda acc, x: F.when((F.size(acc) < rules.spans_per_link) & ~F.exists(acc, lambda y: F.arrays_overlap(y["places"], x["places"])), F.concat(acc, F.array(x))).otherwise(acc))
    return listed.select(*pair, F.posexplode(taken).alias("rank", "s")).select(*pair, (F.col("rank") + 1).alias("rank"), "s.source", "s.position", "s.n", "s.evidence", "s.keywords", "s.selection_score")


def focus_score(headline_alias: Column, trail_alias: Column, same_sentence: Column, adjacent: Column, query: Column, core: Column, rules: RuleConfig = RuleConfig()) -> Column:
    """How much a relationship is in focus, from six yes-or-no facts."""
    weights = ((headline_alias, rules.focus_headline), (trail_alias, rules.focus_trail), (same_sentence, rules.focus_same_sentence), (adjacent, rules.focus_adjacent), (query, rules.focus_query), (core, rules.focus_core))
    return sum([F.when(c, w).otherwise(0) for c, w in weights], F.lit(0))


def rule_gate(event_score: Column, focus: Column, product_only: Column, section: Column, rules: RuleConfig = RuleConfig()) -> tuple[Column, Column]:
    """(event recommended, relationship recommended) by score, focus and the low-relevance sections."""
    low = F.coalesce(section.isin(*rules.low_relevance_sections), F.lit(False))
    event = (event_score >= F.when(product_only, rules.least_product_score).otherwise(rules.least_score)) & ~(low & (event_score < rules.high_score))
    return event, event & (focus >= F.when(product_only, rules.least_product_focus).otherwise(rules.least_core_focus))


def link_status(core: Column, product: Column, queried: Column) -> Column:
    """What ties a company to an article; null where nothing does."""
    return F.when(core & product, "verified_core_and_product").when(core, "verified_core").when(product, "verified_product").when(queried, "query_only_rejected")


def hybrid_decision(rule: Column, focus: Column, event_score: Column, label: Column, label_score: Column, positive: Column, gate: GateConfig = GateConfig()) -> tuple[Column, Column]:
    """(accepted, reason) of a relationship by rule and model; scores that are NaN count as 0."""
    safe = lambda c: F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0))
    good = F.coalesce(label.isin(*gate.accepted), F.lit(False))
    agree = rule & good & (safe(label_score) >= gate.confirmation)
    strong = rule & good & (focus >= gate.strong_focus)
    rescued = F.lit(gate.rescue) & ~rule & good & (safe(label_score) >= gate.rescue_threshold) & (safe(positive) >= gate.rescue_threshold) & (safe(event_score) >= gate.event_confidence) & (focus >= gate.least_rescue_focus)
    reason = F.when(agree, "rule_and_nlp_agree").when(strong, "strong_rule_fallback").when(rule, "nlp_rejected_rule_candidate").when(rescued, "nlp_rescued_rule_candidate").otherwise("rule_and_nlp_do_not_support")
    return agree | strong | rescued, reason


def positive_probability(scores: Column, gate: GateConfig = GateConfig()) -> Column:
    """The sum of accepted labels' scores in a map."""
    kept = F.map_values(F.map_filter(scores, lambda k, _: k.isin(*gate.accepted)))
    return F.aggregate(kept, F.lit(0.0), lambda a, x: a + x)


#: Verbs, and the patterns by which grammar corrects a label, first one first; NAME stands for any of a company's names.
SUBJECT_VERBS = "said|says|announced|reported|expects?|forecast|forecasts|raised|cut|launched|acquired|plans?|invests?|signed|agreed|posted|recorded|sold|bought|leads?|leading|missed|misses|donated|donates|gave|gives|provided|provides|reports?|expanded|expands|funded|funds|lowered|lowers|will"
TARGET_VERBS = "sued|fined|targeted|banned|blocked|restricted|investigated|charged|penalized|penalised|sanctioned"
ACTIVE_VERBS = "sue|sues|sued|suing|fine|fines|fined|target|targets|targeted|ban|bans|banned|block|blocks|blocked|restrict|restricts|restricted|investigate|investigates|investigated|charge|charges|charged|sanction|sanctions|sanctioned"
GRAMMAR = (
    ("incidental_mention", "grammar_contextual_example", r"\b(?:including|such as|alongside|among|like|pointing to)\b[^.;:!?]{0,80}(?<!\w)NAME(?!\w)"),
    ("direct_subject", "grammar_company_is_subject", rf"^\W*(?:the\s+)?NAME(?:\s*,[^,]{{0,50}},)?\s+(?:(?:has|have|had|is|are|was|were)\s+)?(?:{SUBJECT_VERBS})\b"),
    ("direct_subject", "grammar_company_representative_is_subject", r"(?<!\w)NAME(?:['’]s)?\s+(?:chief executive|ceo|chair|spokes(?:person|man|woman)|company)[^.;:!?]{0,80}\b(?:said|says|told|announced|reported|warned)\b"),
    ("direct_target", "grammar_company_is_target", rf"(?<!\w)NAME(?!\w).{{0,35}}\b(?:was|were|is|are|has been|have been)\s+(?:{TARGET_VERBS})\b"),
    ("direct_target", "grammar_company_is_active_clause_target", rf"\b(?:{ACTIVE_VERBS})\s+(?:the\s+)?(?<!\w)NAME(?!\w)"),
)
UNCHANGED = "nlp_label_unchanged"


def calibrate(name_pattern: str, text: Column, label: Column, grammar: tuple[tuple[str, str, str], ...] = GRAMMAR) -> tuple[Column, Column]:
    """(label, reason) after grammar: the first pattern found that asks for another label gives it."""
    verdicts = []
    for to, reason, pattern in grammar:
        found = text.rlike("(?iU)" + pattern.replace("NAME", f"(?:{name_pattern})"))
        verdicts.append(F.when(found & (label != to), F.struct(F.lit(to).alias("label"), F.lit(reason).alias("reason"))))
    verdict = F.coalesce(*verdicts, F.struct(label.alias("label"), F.lit(UNCHANGED).alias("reason")))
    return verdict["label"], verdict["reason"]


def names_pattern(names: list[str]) -> str:
    """Any of the names, longer ones first."""
    return "|".join(re.sub(r"([^\w\s])", r"\\\1", n) for n in sorted(dict.fromkeys(x.strip() for x in names if x.strip()), key=len, reverse=True))


def lexical_scores(text: Column, labels: dict[str, tuple[str, ...]]) -> Column:
    """A map of label to score, summing to 1: (1 + hits) shares.  The stand-in for a model; any column of such maps will do."""
    hits = {k: F.lit(1.0) + F.size(term_hits(text, v)) for k, v in labels.items()}
    total = sum(hits.values(), F.lit(0.0))
    return F.create_map(*[x for k, h in hits.items() for x in (F.lit(k), h / total)])


def best_label(scores: Column) -> Column:
    """The label of the greatest score, the first by name among equals."""
    entries = F.array_sort(F.transform(F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("s"), e["key"].alias("k"))))
    return F.get(entries, 0)["k"]


def score_texts(rows: DataFrame, cache: DataFrame, scorer, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """(rows with scores, new cache): scorer maps a DataFrame (key, text) to (key, scores) and sees only what the cache lacks."""
    missing = rows.select(key, "text").dropDuplicates([key]).join(cache.select(key), key, "left_anti")
    fresh = scorer(missing)
    grown = cache.unionByName(fresh.select(*cache.columns))
    return rows.join(grown, key, "left"), grown


def select_evidence(span: Column, headline: Column, most: int = 700) -> Column:
    """A link's evidence for a model: its span, clipped, else the headline."""
    return F.when(nonblank(F.substring(span, 1, most)), F.substring(span, 1, most)).otherwise(headline)
