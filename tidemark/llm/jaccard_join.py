"""Exact n-gram Jaccard self-join by token-combination prefixes, and its connected components.

Tokens are hashed word shingles.  All of them are counted in a table of fixed size; a token whose slot
is crowded is of the frequent class.  Tokens are ordered rare first.  Two sets of Jaccard t or more
share a token within the prefix of n - ceil(t n) + 1 tokens of both.  If that token is rare, it is
their common key.  If it is frequent, the sets share no rare token at all, so nearly all their
frequent tokens agree, and some two of them stand next to each other in the frequent lists of both:
prefixes extended to 2 f - 2 t n + 2 frequent tokens (f of n tokens frequent) are certain to hold such
a combination, which is then the key.  Sets that share a key are verified on their texts.

Equal sets are one class before anything is joined.  Of a key's classes each is first held against the
key's pivot, the class of fewest rare tokens: classes that link by frequent tokens with any other mostly
link with it.  Classes already connected need no further test.  What is still apart is tested pair by
pair, if its overlap can still reach the threshold: 512 bits of a class's frequent tokens bound it from
above.  So a group of m near copies, or of m texts around one passage, costs about m tests and not m
squared, and no link is lost.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, lean, ship, stored, unused
from .components import components
from .shingles import mixed, shingle_sets, signature

#: Tokens are counted in 2 ** bits slots, one for each 128 bytes of input or so, in these bounds.
LEAST_BITS, MOST_BITS = 18, 25
PIECE = 1 << 14
BITMAP_BITS = 26
#: Rows of a batch that Python takes up at a time.
ROWS = 256
SKETCH = [f"b{i}" for i in range(8)]
#: Distinct sets that a task remembers, so that their further copies bring no keys again.
REMEMBERED = 500_000


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of ROWS rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _packed(counts: np.ndarray) -> bytes:
    """Counts as one byte each, and the places and values of those above 254."""
    over = np.flatnonzero(counts > 254)
    head = np.array([len(over)], np.int64).tobytes() + over.astype(np.int64).tobytes() + counts[over].astype(np.int64).tobytes()
    return zlib.compress(head + np.minimum(counts, 255).astype(np.uint8).tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    raw = zlib.decompress(raw)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    out = np.frombuffer(raw, np.uint8, offset=8 + 16 * n).astype(np.int64)
    out[np.frombuffer(raw, np.int64, n, 8)] = np.frombuffer(raw, np.int64, n, 8 + 8 * n)
    return out


def _level(counts):
    """A count on a scale of six steps to each doubling, in one byte."""
    return np.minimum(np.rint(6 * np.log2(1 + np.asarray(counts, float))), 255).astype(np.uint8)


def _slot_bits(docs: DataFrame) -> int:
    """How many slots the tokens of docs are counted in, by Spark's estimate of their size."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    size = 1 << 29 if size >= 1 << 60 else size  # Spark does not know the size of rows that come from Python
    return min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, size) / 128))))


def _token_levels(docs: DataFrame, width: int, bits: int) -> np.ndarray:
    """The level of how many documents' tokens fall into each of 2 ** bits slots; a byte for each, whatever the corpus."""
    pieces = 1 << bits - 14

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, part = np.zeros(1 << bits, np.int32), TaskContext.get().partitionId() % 16
        for batch in _texts(batches):
            hashes = list(shingle_sets(batch.column(0).to_pylist(), width))
            np.add.at(slots, (np.concatenate(hashes) >> np.uint64(64 - bits)).astype(np.int64), 1)
        for i in range(pieces):
            yield pa.RecordBatch.from_pydict({"piece": pa.array([i], pa.int32()), "part": pa.array([part], pa.int32()), "counts": pa.array([_packed(slots[i * PIECE : (i + 1) * PIECE])], pa.binary())})

    def added(last: bool):
        @lean
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for i, part, raw in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    key = (i, 0 if last else part)
                    sums[key] = sums.get(key, 0) + _unpacked(raw)
            for (i, part), x in sums.items():
                yield pa.RecordBatch.from_pydict({"piece": pa.array([i], pa.int32()), "part": pa.array([part], pa.int32()), "counts": pa.array([zlib.compress(_level(x).tobytes(), 1) if last else _packed(x)], pa.binary())})

        return add

    schema = "piece int, part int, counts binary"
    parts = docs.select("text").mapInArrow(count, schema)
    # in two steps, so that no task gets a piece of every task before it
    parts = parts.repartition("piece", "part").mapInArrow(added(False), schema).repartition("piece").mapInArrow(added(True), schema)
    out = np.zeros(1 << bits, np.uint8)
    for row in parts.select("piece", "counts").collect():
        out[row["piece"] * PIECE : (row["piece"] + 1) * PIECE] = np.frombuffer(zlib.decompress(row["counts"]), np.uint8)
    return out


def prefix_keys(tokens: np.ndarray, levels: np.ndarray, crowded: int, percent: int) -> tuple[np.ndarray, int, np.ndarray]:
    """(keys, singles, common) of one set of ascending tokens: first the `singles` keys that are tokens of the
    prefix, then those of neighbouring frequent tokens of the extended prefix, both by place; and its frequent tokens."""
    n = len(tokens)
    if n == 0:
        return tokens, 0, tokens
    own = levels[(tokens >> np.uint64(65 - len(levels).bit_length())).astype(np.int64)]
    order = np.argsort(own, kind="stable")
    ranked = tokens[order]
    f = int((own >= crowded).sum())
    length = n - -(-percent * n // 100) + 1
    t = percent / 100
    tiny = n * (3 * t / (1 + t) - 1) < 2  # so small that neighbours may not agree
    singles = ranked[:length] if tiny else ranked[: min(length, n - f)]
    common = ranked[n - f :]
    reach = 2 * f - -(-2 * percent * n // 100) + 3
    if reach < 2:
        return singles, len(singles), common
    part = common[:reach]
    pairs = mixed(part[:-1] * np.uint64(0x9E3779B97F4A7C15) + mixed(part[1:]))
    return np.concatenate((singles, pairs)), len(singles), common


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Eight 64-bit integers: for each of 512 bits, whether an odd number of tokens falls on it."""
    return np.packbits(np.bincount((mixed(tokens) >> np.uint64(55)).astype(np.int64), minlength=512).astype(np.uint8) & 1).view(np.int64)


def _sets(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, n, sig, singles, f, keys, sketch) of every row; of equal sets, the first that a task meets brings the keys."""
    levels = _token_levels(docs, width, _slot_bits(docs))
    usual = 2 ** (float(np.median(levels)) / 6) - 1  # what tokens of one document each bring into a slot, by chance
    crowded = int(_level(usual + 6 * usual**0.5 + 16))
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    @lean
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, seen = shared.value, set()
        for batch in _texts(batches):
            n, sig, keys, singles, frequent, bits = [], [], [], [], [], []
            for tokens in shingle_sets(batch.column(1).to_pylist(), width):
                name = signature(tokens)
                first = name not in seen
                if first and len(seen) < REMEMBERED:
                    seen.add(name)
                own, k, common = prefix_keys(tokens, levels, crowded, percent)
                n.append(len(tokens))
                sig.append(name)
                keys.append(own.view(np.int64) if first else None)
                singles.append(k)
                frequent.append(len(common))
                bits.append(sketch(common))
            table = np.stack(bits)
            flat = pa.array(np.concatenate([k for k in keys if k is not None] or [np.empty(0, np.int64)]))
            offsets = np.concatenate(([0], np.cumsum([0 if k is None else len(k) for k in keys]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), flat, mask=pa.array([k is None for k in keys]))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(singles, pa.int32()), pa.array(frequent, pa.int32()), lists, *[pa.array(table[:, i]) for i in range(8)]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "sig", "singles", "f", "keys", *SKETCH])

    return docs.mapInArrow(make, f"doc_id {dict(docs.dtypes)['doc_id']}, n bigint, sig binary, singles int, f int, keys array<bigint>, " + ", ".join(f"{b} bigint" for b in SKETCH))


def _may_match(x: str, y: str, percent: int) -> Column:
    """Whether two classes that share a key can reach the threshold by what the key tells of them.

    o is the overlap that their sizes ask for.  A pair's first shared token stands, in either, where o
    tokens can still follow; so a single key further on need not be looked at.  A pair found by frequent
    tokens alone shares no more than the lesser number of them; it has two shared neighbours among the
    first f_x + f_y - 2 o + 2 shared tokens, before which either has f - o others at most.
    """
    c = lambda side, name: F.col(f"{side}.{name}")
    o = F.ceil(percent * (c(x, "n") + c(y, "n")) / (100 + percent))
    single = (c(x, "pos") >= 0) & (c(y, "pos") >= 0) & (c(x, "pos") <= c(x, "n") - o) & (c(y, "pos") <= c(y, "n") - o)
    reach = lambda p, q: -1 - c(p, "pos") <= 2 * c(p, "f") + c(q, "f") - 3 * o
    double = (c(x, "pos") < 0) & (c(y, "pos") < 0) & (F.least(c(x, "f"), c(y, "f")) >= o) & reach(x, y) & reach(y, x)
    return (F.least(c(x, "n"), c(y, "n")) >= o) & (single | double)


def _overlap_left(x: str, y: str, percent: int) -> Column:
    """Whether two classes that share frequent tokens alone can reach the threshold by their sketches.

    Each bit that differs is a frequent token that only one of them has, at least.
    """
    apart = sum((F.bit_count(F.col(f"{x}.{b}").bitwiseXOR(F.col(f"{y}.{b}"))) for b in SKETCH), F.lit(0))
    o = F.ceil(percent * (F.col(f"{x}.n") + F.col(f"{y}.n")) / (100 + percent))
    return (F.col(f"{x}.pos") >= 0) | (F.col(f"{y}.pos") >= 0) | (F.col(f"{x}.f") + F.col(f"{y}.f") - apart >= 2 * o)


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id may be among ids, by a bitmap of fixed size (8 MB); others are few."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << BITMAP_BITS))
    bits = ids.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m"))
    table = np.zeros((1 << BITMAP_BITS) // 8 + 8192, np.uint8)
    for row in bits.toLocalIterator():
        part = np.frombuffer(row["m"], np.uint8)
        at = (row["b"] - 1) * 4096 if row["b"] > 0 else len(table) - 4096
        table[at : at + len(part)] = part
    shared = docs.sparkSession.sparkContext.broadcast(table)
    place = docs.select("doc_id", "text", slot.alias("s")).select("doc_id", "text", F.bitmap_bucket_number("s").alias("b"), F.bitmap_bit_position("s").alias("p"))

    @lean
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in batches:
            b, p = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            base = np.where(b > 0, (b - 1) * 4096, len(bitmap) - 4096)
            hit = (bitmap[base + (p >> 3)] >> (p & 7).astype(np.uint8)) & 1
            yield batch.select([0, 1]).filter(pa.array(hit.astype(bool)))

    return place.mapInArrow(keep, f"doc_id {dict(docs.dtypes)['doc_id']}, text string")


def _linked(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose texts' sets have Jaccard of percent / 100 or more."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = _only(docs, ids)
    with_b = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    @lean
    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tokens = None, None
        for batch in _texts(batches):
            keep = []
            left = batch.column(2).to_pylist()
            for text, other in zip(left, shingle_sets(batch.column(3).to_pylist(), width), strict=True):
                if last != text or tokens is None:
                    last, tokens = text, next(shingle_sets([text], width))
                common = len(np.intersect1d(tokens, other, assume_unique=True))
                keep.append(100 * common >= percent * (len(tokens) + len(other) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    kind = dict(pairs.dtypes)["a"]
    return both.mapInArrow(test, f"a {kind}, b {kind}").distinct()


def near_duplicates(docs: DataFrame, percent: int = 75, width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text).

    Two documents link when 100 * |intersection| >= percent * |union| of their sets of distinct
    `width`-word shingles; a text of fewer words is one shingle; one without words, or null, links with
    nothing, equal texts included.  component_id is the least doc_id that links lead to.  Rows that
    share a doc_id are one document, which links where any of its texts does.  A null doc_id links with
    nothing and is its own (null) component.
    """
    if not 60 <= percent <= 100:
        raise ValueError("percent must lie between 60 and 100")
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    sets = stored(_sets(docs, width, percent), "shingle-sets")
    there = sets.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    # a class has a document that stands for it, its least one, and one that brings its keys
    brings = F.min(F.when(F.col("keys").isNotNull(), F.col("doc_id"))).alias("brings")
    reps = stored(there.groupBy("sig").agg(F.min("doc_id").alias("rep"), brings, F.min("n").alias("n"), F.min("f").alias("f"), *[F.min(b).alias(b) for b in SKETCH]), "classes")
    place = F.when(F.col("i") < F.col("singles"), F.col("i")).otherwise(F.col("singles") - F.col("i") - 1)
    entries = there.select(F.posexplode("keys").alias("i", "key"), "singles", F.col("doc_id").alias("brings")).select("key", "brings", place.alias("pos"))
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1).select("key")
    met = entries.join(shared, "key", "left_semi")
    # a document with several texts keeps the bounds that let most through
    sizes = reps.groupBy("rep").agg(F.max("n").alias("n"), F.max("f").alias("f"), F.count(F.lit(1)).alias("texts"), *[F.max(b).alias(b) for b in SKETCH])
    met = met.join(reps.select("brings", "rep").distinct(), "brings").groupBy("key", "rep").agg(F.min_by("pos", F.abs("pos")).alias("pos"))
    met = stored(met.join(sizes.select("rep", "n", "f", "texts"), "rep").select("key", "rep", "n", "f", "texts", "pos"), "shared-keys")
    pivots = met.groupBy("key").agg(F.min_by(F.struct("rep", "n", "f", "texts", "pos"), F.struct(F.col("n") - F.col("f"), "rep")).alias("p")).select("key", "p.*")
    loose = lambda x, y: (F.col(f"{x}.texts") > 1) | (F.col(f"{y}.texts") > 1) | _may_match(x, y, percent)
    stars = met.alias("x").join(pivots.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") != F.col("y.rep")) & loose("x", "y"))
    stars = stored(stars.groupBy(F.col("y.rep").alias("a"), F.col("x.rep").alias("b")).agg(F.count(F.lit(1)).alias("c")), "stars")
    best = stars.groupBy("b").agg(F.min_by("a", F.struct((-F.col("c")).alias("c"), "a")).alias("a")).select("a", "b")
    tested, roots = stored(best, "pairs"), None

    def label(rows: DataFrame, node: str, name: str) -> DataFrame:
        own = roots.select(F.col("node").alias(node), F.col("root").alias("_r"))
        return rows.join(own, node, "left").select(*rows.columns, F.coalesce("_r", node).alias(name))

    def grow(pairs: DataFrame) -> DataFrame:
        """The roots with the links among pairs."""
        found = stored(_linked(docs, pairs, width, percent), "links")
        known = found if roots is None else found.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        after = components(known)
        drop_stored(found, *([] if roots is None else [roots]))
        return after

    roots = grow(tested)
    todo = label(label(stars.select("a", "b").join(tested, ["a", "b"], "left_anti"), "a", "la"), "b", "lb")
    pairs = stored(todo.where(F.col("la") != F.col("lb")).select("a", "b"), "pairs")
    if not pairs.isEmpty():
        roots = grow(pairs)
    named = label(met, "rep", "label")
    split = named.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h")).where(F.col("l") != F.col("h")).select("key")
    apart = stored(named.join(split, "key", "left_semi").join(sizes.select("rep", *SKETCH), "rep"), "apart")
    x, y = apart.alias("x"), apart.alias("y")
    several = (F.col("x.texts") > 1) | (F.col("y.texts") > 1)
    rest = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.label") != F.col("y.label")) & loose("x", "y") & (several | _overlap_left("x", "y", percent)))
    rest = rest.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    for known in (tested, pairs):  # a pivot may stand on either side
        rest = rest.join(known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    rest = stored(rest, "pairs")
    drop_stored(met, stars, tested, pairs, apart)
    if not rest.isEmpty():
        roots = grow(rest)
    drop_stored(rest)
    # every row of a document stands for it: its classes are one
    own = there.select("doc_id", "sig").join(reps.select("sig", "rep"), "sig").select("doc_id", "rep").distinct()
    many = own.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where(F.col("a") != F.col("b")).select("doc_id")
    if not many.isEmpty():
        ties = own.join(many, "doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        roots = components(ties.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    classes = label(reps.select("sig", "rep"), "rep", "label").select(F.col("sig").alias("_sig"), "label")
    out = sets.select("doc_id", "n", "sig").join(classes, (F.col("sig") == F.col("_sig")) & (F.col("n") > 0) & F.col("doc_id").isNotNull(), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, percent: int = 75, width: int = 5) -> DataFrame:
    """docs less all but the document of least doc_id of each group of near duplicates.

    Rows that share a doc_id are one document: all of them stay or go.  Columns of docs keep their
    names and order.
    """
    (gone,) = unused(docs, "_gone")
    groups = near_duplicates(docs, percent, width).where(~F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(groups, F.col("doc_id") == F.col(gone), "left_anti")
