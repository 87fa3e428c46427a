"""I-Match fingerprints over randomised lexicons, in DataFrame operations only.

The lexicon holds the terms whose inverse document frequency, over distinct texts, lies in a band.  At
level L each of several random sub-lexicons keeps 2 ** -L of it, and what it keeps at a level it also
keeps at those below.  A text is told at the level at which a sub-lexicon keeps half a term to one term
of it, and at the next, so long and short texts both have few terms in each.  Its fingerprint is, for
each level and sub-lexicon, a hash of the sorted distinct terms kept of the text; likeness is the share
of sub-lexicons that agree at the levels that two texts have in common.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stored, word_array

#: A lexicon of more terms is not broadcast: the join shuffles both sides.
MAX_LEXICON = 50_000
#: A text without lexicon terms is told by as many of its own, those of least hash.
OWN_TERMS = 32


def lexicon(texts: DataFrame, low: float = 0.002, high: float = 0.05) -> DataFrame:
    """(term, known) for terms found in a share of low to high of all distinct texts.

    Copies of a text count as one: each of n copies adds 1 / n.  No texts or no terms in the band: no rows.
    """
    rows = texts.select("text", F.xxhash64("text").alias("_h"), F.xxhash64(F.reverse("text")).alias("_g"))
    groups = stored(rows.groupBy("_h", "_g").agg(F.count(F.lit(1)).alias("_n")), "texts")
    total = groups.count()
    rows = rows.join(groups.where("_n > 1"), ["_h", "_g"], "left").withColumn("_w", 1.0 / F.coalesce("_n", F.lit(1)))
    terms = rows.select("_w", F.explode(F.array_distinct(word_array(F.col("text")))).alias("term"))
    counts = terms.groupBy("term").agg(F.round(F.sum("_w"), 6).alias("df"))
    return stored(counts.where((F.col("df") >= max(2.0, low * total)) & (F.col("df") <= max(high * total, 2.0))).select("term", F.lit(True).alias("known")), "lexicon")


def term_id(term: Column) -> Column:
    """Terms are told apart by 32 bits."""
    return F.hash(term)


def _let(value: Column, then) -> Column:
    """then(value), with value computed once however often then names it."""
    return F.get(F.transform(F.array(value), then), 0)


def fingerprint(ids: Column, subsets: int) -> Column:
    """level/hashes/hashes, of a text's distinct term ids, not empty: at the level and the next, the last 8 hex digits of a hash for each sub-lexicon, joined by '-', '' where it keeps none."""
    width = F.lit((1 << subsets) - 1)

    def bits(t: Column, i: Column) -> Column:  # each set with probability 1/2
        return F.xxhash64(t, i).bitwiseAND(width)

    def kept(level: Column, t: Column) -> Column:
        one = F.aggregate(F.sequence(F.lit(0), level), width, lambda m, i: F.when(i == 0, m).otherwise(m.bitwiseAND(bits(t, i))))
        return F.struct(t.alias("t"), one.alias("m"))

    def hashes(terms: Column) -> Column:
        def one(r: Column) -> Column:
            kept = F.filter(terms, lambda x: F.getbit(x["m"], r) == 1)
            return _let(kept, lambda own: F.when(F.size(own) > 0, F.substring(F.lower(F.hex(F.xxhash64(own["t"]))), -8, 8)).otherwise(""))

        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(subsets - 1)), one), "-")

    def at(level: Column, ids: Column) -> Column:
        here = F.filter(F.transform(ids, lambda t: kept(level, t)), lambda x: x["m"] != 0)

        def both(terms: Column) -> Column:
            above = F.filter(F.transform(terms, lambda x: F.struct(x["t"].alias("t"), x["m"].bitwiseAND(bits(x["t"], level + 1)).alias("m"))), lambda x: x["m"] != 0)
            return F.concat_ws("/", level.cast("string"), hashes(terms), _let(above, hashes))

        return _let(here, both)

    return _let(F.array_sort(ids), lambda own: _let(F.ceil(F.log2(F.size(own))).cast("int"), lambda level: at(level, own)))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, else the share of agreeing among the sub-lexicons in which either is not empty, at the common levels; 0 without any."""
    x, y = F.split(a, "/", -1), F.split(b, "/", -1)
    apart = F.get(y, 0).cast("int") - F.get(x, 0).cast("int")
    none = F.lit(None).cast("string")
    left = F.when(apart == 0, F.concat_ws("-", F.get(x, 1), F.get(x, 2))).when(apart == 1, F.get(x, 2)).when(apart == -1, F.get(x, 1)).otherwise(none)
    right = F.when(apart == 0, F.concat_ws("-", F.get(y, 1), F.get(y, 2))).when(apart == 1, F.get(y, 1)).when(apart == -1, F.get(y, 2)).otherwise(none)
    pairs = F.arrays_zip(F.split(left, "-", -1).alias("x"), F.split(right, "-", -1).alias("y"))
    told = F.size(F.filter(pairs, lambda p: (p["x"] != "") | (p["y"] != "")))
    same = F.size(F.filter(pairs, lambda p: (p["x"] != "") & (p["x"] == p["y"])))
    return F.when(a == b, F.lit(1.0)).when(F.abs(apart) > 1, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(same.cast("double"), told.cast("double")), F.lit(0.0)))


def _ranges(docs: DataFrame, rows_per_bucket: int, max_buckets: int) -> tuple[Column, Column]:
    """(bucket, whether the doc_id heads its bucket): descending ranges of doc_id of about equal numbers of rows, nulls in the last.

    Bounds are quantiles of a sample by hash, some 32 doc_ids to a bucket; they are found in two steps
    through their square root, so a row costs little however many there are.
    """
    buckets = max(1, min(max_buckets, -(-docs.count() // rows_per_bucket)))
    bounds: list = []
    if buckets > 1:
        share = int((1 << 30) * min(1.0, 32 * buckets / (buckets * rows_per_bucket)))
        sample = docs.where(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64(F.lit("ranges"), "doc_id"), F.lit(1 << 30)) < share)).select("doc_id").distinct()
        ids = sorted((r[0] for r in sample.collect()), reverse=True)
        # the greatest doc_id of a bucket is its bound; the first bucket needs none
        bounds = [ids[i] for i in sorted({len(ids) * k // buckets for k in range(1, buckets)} - {0})] if ids else []
    if not bounds:
        return F.lit(0), F.lit(False)
    size = math.isqrt(len(bounds)) + 1
    parts = [bounds[i : i + size] for i in range(0, len(bounds), size)]
    kind = dict(docs.dtypes)["doc_id"]
    table = lambda x, t: F.from_json(F.lit(json.dumps(x)), F.lit(t))  # noqa: E731  a constant
    rows, lasts = table(parts, f"array<array<{kind}>>"), table([p[-1] for p in parts], f"array<{kind}>")
    reached = lambda edges: F.size(F.filter(edges, lambda b: F.col("doc_id") <= b))
    part = reached(lasts)
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(bounds))).when(part == len(parts), F.lit(len(bounds))).otherwise(part * size + reached(F.get(rows, part)))
    before = bucket - 1
    heads = (bucket > 0) & (F.get(F.get(rows, F.floor(before / size).cast("int")), before % size) == F.col("doc_id"))
    return bucket, F.coalesce(heads, F.lit(False))


def with_next(docs: DataFrame, rows_per_bucket: int = 2000, max_buckets: int = 1 << 17) -> DataFrame:
    """docs (doc_id, text) with a unique _rid, and _next_rid and _next_text of the row that follows.

    Order: doc_id descending (nulls last), then the text's SHA-256; after the last comes the first.
    Rows are dealt into ranges of doc_id, each range is ordered by itself, and the rows at the head of
    every range are sent to the range before it as well; no task sees all rows.  Rows that share one
    doc_id are one range at least: they are ordered in one task, on disk where memory ends.
    """
    rows = docs.select("doc_id", "text")
    bucket, heads = _ranges(rows, rows_per_bucket, max_buckets)
    top = rows.agg(F.max("doc_id")).first()[0]
    rows = rows.select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("_sha"), bucket.alias("_b"), heads.alias("_head"))
    first, heads = F.col("doc_id").eqNullSafe(F.lit(top)), F.col("_head")
    last = rows.agg(F.max("_b")).first()[0] or 0
    copies = F.array_compact(F.array(F.struct(F.col("_b").alias("b"), F.lit(0).alias("guest")), F.when(heads & (F.col("_b") > 0), F.struct((F.col("_b") - 1).alias("b"), F.lit(1).alias("guest"))), F.when(first, F.struct(F.lit(last).alias("b"), F.lit(2).alias("guest")))))
    rows = rows.select("doc_id", "text", "_sha", F.explode(copies).alias("_c")).select("doc_id", "text", "_sha", F.col("_c.b").alias("_b"), F.col("_c.guest").alias("_guest"))
    order = W.partitionBy("_b").orderBy("_guest", F.col("doc_id").desc_nulls_last(), "_sha")
    width = F.lit(1 << 40)
    own = F.col("_b").cast("long") * width + F.row_number().over(order)
    ahead = F.lead("_guest").over(order)
    nxt = F.when(ahead == 0, own + 1).when(ahead == 1, (F.col("_b") + 1).cast("long") * width + 1).otherwise(F.lit(1).cast("long"))
    out = rows.select("doc_id", "text", "_guest", own.alias("_rid"), nxt.alias("_next_rid"), F.lead("text").over(order).alias("_next_text"))
    return out.where(F.col("_guest") == 0).drop("_guest")


def edited(text: Column, following: Column) -> Column:
    """text with its last floor(n / 3) code points replaced by the first as many (or all) of the following text."""
    text, following = F.coalesce(text, F.lit("")), F.coalesce(following, F.lit(""))
    n = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.left(text, F.length(text) - n), F.left(following, n))


def fingerprint_edits(docs: DataFrame, low: float = 0.002, high: float = 0.05, subsets: int = 32, max_terms: int = MAX_LEXICON) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints, near_edited and near_next for every row of docs.

    Null text is empty; texts without lexicon terms are told by their own, and texts without any term by
    themselves; a single document is its own next.  Repeated rows each count and follow one another.
    """
    docs = docs.select("doc_id", "text")
    lex = lexicon(docs.select(F.coalesce("text", F.lit("")).alias("text")), low, high)
    if lex.count() <= max_terms:
        lex = F.broadcast(lex)
    rows = with_next(docs)
    change = edited(F.col("text"), F.col("_next_text"))
    rows = rows.select("doc_id", "_rid", "_next_rid", F.coalesce("text", F.lit("")).alias("text"), change.alias("edited"))
    rows = rows.select("*", F.array_distinct(word_array(F.col("text"))).alias("_x"), F.array_distinct(word_array(F.col("edited"))).alias("_y"))
    none = F.array(F.lit(None).cast("string"))

    def terms(c: str, which: int) -> Column:
        return F.transform(c, lambda t: F.struct(F.lit(which).alias("which"), t.alias("term")))

    def own(words: str, text: str) -> Column:
        ids = F.slice(F.array_sort(F.array_distinct(F.transform(words, term_id))), 1, OWN_TERMS)
        return F.when(F.size(words) > 0, ids).otherwise(F.array(term_id(F.concat(F.lit(" "), F.col(text)))))

    rows = rows.select("*", own("_x", "text").alias("_own_a"), own("_y", "edited").alias("_own_b"))
    head = F.transform(none, lambda t: F.struct(F.lit(2).alias("which"), t.alias("term")))
    facts = F.struct("doc_id", "_next_rid", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "_own_a", "_own_b")
    spread = rows.select("_rid", F.posexplode(F.concat(head, terms("_x", 0), terms("_y", 1))).alias("_i", "_t"), facts.alias("_facts"))
    spread = spread.select("_rid", F.col("_t.which").alias("which"), F.col("_t.term").alias("term"), F.when(F.col("_i") == 0, F.col("_facts")).alias("_facts"))
    marked = spread.join(lex, "term", "left").where(F.col("known") | (F.col("which") == 2))
    ids = lambda which: F.collect_set(F.when(F.col("which") == which, term_id(F.col("term"))))
    made = marked.groupBy("_rid").agg(F.array_compact(F.collect_list("_facts")).alias("_f"), ids(0).alias("_a"), ids(1).alias("_b"))
    pick = lambda c, fallback: F.when(F.size(c) > 0, F.col(c)).otherwise(F.get("_f", 0)[fallback])
    made = made.select("_rid", F.get("_f", 0).alias("_f"), pick("_a", "_own_a").alias("_a"), pick("_b", "_own_b").alias("_b"))
    made = made.select("_rid", "_f.doc_id", "_f._next_rid", "_f.n_chars", "_f.edited_sha256", fingerprint(F.col("_a"), subsets).alias("fingerprint"), fingerprint(F.col("_b"), subsets).alias("edited_fingerprint"))
    made = stored(made, "fingerprints")
    following = made.select(F.col("_rid").alias("_next_rid"), F.col("fingerprint").alias("_next"))
    out = made.join(following, "_next_rid", "left")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("_next")).alias("near_next"))
