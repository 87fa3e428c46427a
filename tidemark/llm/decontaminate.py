"""Benchmark decontamination by winnowing, in DataFrame operations only.

Of the hashes of all K-word grams the minimum of every WINDOW - K + 1 neighbours is kept, so any
span of WINDOW words that two texts share has a kept gram in common, at the same place.  Documents
and items are joined on kept grams; each hit is then extended over the windows around it by comparing
words, so what is reported rests on the words and not on hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_key, unused, word_array

#: Up to so many benchmark grams are broadcast (some 200 bytes each); beyond, the join shuffles both sides.
MAX_BROADCAST_GRAMS = 200_000


def grams(words: Column, k: int) -> Column:
    """Hashes of the k words from each position on; the last k - 1 positions have none."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    of = lambda h: F.transform(F.slice(h, 1, F.greatest(F.size(h) - (k - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, k)]))
    return F.get(F.transform(F.array(hashes), of), 0)


def winnowed(hashes: Column, span: int) -> Column:
    """(pos, gram) of every hash that is the least of some window of `span` neighbours; ties all stay."""

    def pick(h: Column) -> Column:
        lows = F.transform(h, lambda x, i: F.least(x, *[F.get(h, i + j) for j in range(1, span)]) if span > 1 else x)

        def select(m: Column) -> Column:
            best = lambda x, i: F.greatest(F.get(m, i), *[F.when(i >= j, F.get(m, i - j)) for j in range(1, span)]) if span > 1 else x
            marked = F.transform(h, lambda x, i: F.when(x == best(x, i), F.struct(i.alias("pos"), x.alias("gram"))))
            return F.filter(marked, lambda s: s.isNotNull())

        return F.get(F.transform(F.array(lows), select), 0)

    return F.get(F.transform(F.array(hashes), pick), 0)


def every_gram(words: Column, n: int) -> Column:
    """(n, pos, gram) at each position from which n words follow, for items of n words."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def of(h: Column) -> Column:
        starts = F.slice(h, 1, F.greatest(F.size(h) - (n - 1), F.lit(0)))
        return F.transform(starts, lambda x, i: F.struct(F.lit(n).alias("n"), i.alias("pos"), F.xxhash64(x, *[F.get(h, i + j) for j in range(1, n)]).alias("gram")))

    return F.get(F.transform(F.array(hashes), of), 0)


def benchmark_index(benchmark: DataFrame, window: int, k: int) -> DataFrame:
    """(item_id, n, gram, shift, around): n words hash to gram, shift words into the words `around`.

    Items of window words or more give their winnowed grams with up to window - k words on either side;
    shorter ones give one row with all their words.  Items without words give none.
    """
    items = benchmark.select("item_id", word_array(F.col("text")).alias("_w")).where(F.size("_w") > 0)
    back = window - k
    long = items.where(F.size("_w") >= window).select("item_id", "_w", F.explode(winnowed(grams(F.col("_w"), k), window - k + 1)).alias("_f"))
    start = F.greatest(F.col("_f.pos") - back, F.lit(0))
    long = long.select("item_id", F.lit(0).alias("n"), F.col("_f.gram").alias("gram"), (F.col("_f.pos") - start).alias("shift"), F.slice("_w", start + 1, F.col("_f.pos") - start + window).alias("around"))
    short = items.where(F.size("_w") < window).select("item_id", F.size("_w").alias("n"), F.xxhash64(F.transform("_w", lambda w: F.xxhash64(w))).alias("gram"), F.lit(0).alias("shift"), F.col("_w").alias("around"))
    return long.unionByName(short).distinct()


def contaminated_words(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """docs with n_words, hit_starts (array of struct(start, n, items)) and what follows from them: n_hit, items, contaminated.

    A window is `window` consecutive words of an item, or a shorter item's whole; a document word is
    hit if it lies in an occurrence of a window.  Null texts have no words; an empty benchmark hits
    nothing.  Rows that share a doc_id each get their own result; other columns pass through.  A null
    item_id never counts as an item but its windows hit.
    """
    if not 1 <= k <= window:
        raise ValueError("k must lie between 1 and window")
    own = ("n_words", "hit_starts", "n_hit", "items", "contaminated")
    docs = docs.drop(*own)
    index = benchmark_index(benchmark, window, k)
    sizes = [tuple(r) for r in index.groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()]
    total, short = sum(c for _, c in sizes), sorted(n for n, _ in sizes if n)
    th, i, dh, found_at, own_words = unused(docs, "_th", "_id", "_dh", "_hits", "_w")
    words = docs.select("doc_id", text_key().alias("th"), word_array(F.col("text")).alias("w"))
    found = [F.transform(winnowed(grams(F.col("w"), k), window - k + 1), lambda f: F.struct(F.lit(0).alias("n"), f["pos"].alias("pos"), f["gram"].alias("gram")))]
    found += [every_gram(F.col("w"), n) for n in short]
    marks = words.select("doc_id", "th", F.explode(F.concat(*found)).alias("f")).select("doc_id", "th", "f.n", "f.pos", "f.gram")
    places = index.groupBy("n", "gram", "shift", "around").agg(F.collect_set("item_id").alias("item_ids"))
    places = F.broadcast(places) if total <= MAX_BROADCAST_GRAMS else places
    hits = marks.join(places, ["n", "gram"])
    hits = hits.groupBy("doc_id", "th").agg(F.collect_list(F.struct("pos", "n", "shift", "around", "item_ids")).alias(found_at))
    hits = hits.select(F.col("doc_id").alias(i), F.col("th").alias(dh), found_at).hint("shuffle_hash")
    both = docs.select("*", text_key().alias(th)).join(hits, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(th) == F.col(dh)), "left")
    both = both.select(*docs.columns, found_at, word_array(F.col("text")).alias(own_words))

    def extend(hit: Column) -> Column:
        """The windows around a hit of which every word agrees."""
        whole = F.array(F.struct(hit["pos"].alias("start"), hit["n"].alias("n"), hit["item_ids"].alias("item_ids")))
        same = F.slice(F.col(own_words), hit["pos"] + 1, F.greatest(hit["n"], F.lit(1))) == hit["around"]
        steps = F.filter(F.sequence(F.lit(0), F.lit(window - k)), lambda s: (s <= hit["shift"]) & (hit["pos"] >= hit["shift"] - s) & (s + window <= F.size(hit["around"])))
        at = lambda s: hit["pos"] - hit["shift"] + s
        steps = F.filter(steps, lambda s: F.slice(F.col(own_words), at(s) + 1, F.lit(window)) == F.slice(hit["around"], s + 1, F.lit(window)))
        wide = F.transform(steps, lambda s: F.struct(at(s).alias("start"), F.lit(window).alias("n"), hit["item_ids"].alias("item_ids")))
        return F.when(hit["n"] > 0, F.when(same, whole).otherwise(F.slice(whole, 1, 0))).otherwise(wide)

    starts = F.when(F.col(found_at).isNotNull(), F.flatten(F.transform(found_at, extend)))
    both = both.select(*docs.columns, F.size(own_words).cast("long").alias("n_words"), starts.alias("hit_starts"))
    covered = F.array_distinct(F.flatten(F.transform("hit_starts", lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1))))
    items = F.array_distinct(F.flatten(F.transform("hit_starts", lambda s: s["item_ids"])))
    n_hit = F.coalesce(F.when(F.size("hit_starts") > 0, F.size(covered)), F.lit(0)).cast("long")
    out = both.select(*docs.columns, "n_words", "hit_starts", n_hit.alias("n_hit"), F.coalesce(items, F.array().cast(f"array<{dict(index.dtypes)['item_id']}>")).alias("items"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """The documents in which no benchmark window occurs, in the columns of docs."""
    return contaminated_words(docs, benchmark, window, k).where(~F.col("contaminated")).select(*docs.columns)
