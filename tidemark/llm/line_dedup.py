"""Removal of lines that many documents share.

Lines are exploded and normalised, hashed to 128 bits, counted by distinct documents, and documents
are put together again from the positions that stay.  Only hashes and positions are shuffled by key;
the counts combine before their shuffle, so a line of a third of all documents is one row per task.  The
hashes of common lines are broadcast where their number is within a bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, stored, text_key, unused

#: Up to so many common lines are broadcast (some 60 bytes each); beyond, the join shuffles both sides.
MAX_BROADCAST_LINES = 200_000


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_length: int = 1) -> DataFrame:
    """docs with `text` less the lines whose key stands in at least min_docs distinct documents.

    Adds n_lines (before) and n_dropped.  Keys shorter than min_length code points always stay.
    Null and empty texts are one empty line and come back as they are.  Rows that share a doc_id are
    one document when documents are counted; a null doc_id is a document of its own.  Other columns
    of docs pass through.
    """
    docs = docs.drop("n_lines", "n_dropped")
    th, i, dh, drop, own = unused(docs, "_th", "_id", "_dh", "_drop", "_lines")
    split = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    lines = docs.select("doc_id", text_key().alias("th"), F.posexplode(split).alias("pos", "line")).select("doc_id", "th", "pos", line_key(F.col("line")).alias("key"))
    lines = lines.where(F.length("key") >= max(1, min_length)).select("doc_id", "th", "pos", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(7), "key").alias("g"))
    common = lines.select("doc_id", "h", "g").distinct().groupBy("h", "g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs)
    common = stored(common.select("h", "g"), "common-lines")
    if common.count() <= MAX_BROADCAST_LINES:  # then no line moves, however many documents hold it
        common = F.broadcast(common)
    drops = lines.join(common, ["h", "g"], "left_semi").groupBy("doc_id", "th").agg(F.collect_set("pos").alias(drop))
    drops = drops.select(F.col("doc_id").alias(i), F.col("th").alias(dh), drop).hint("shuffle_hash")
    on = F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(th) == F.col(dh))
    both = docs.select("*", text_key().alias(th)).join(drops, on, "left")
    both = both.select(*docs.columns, drop, F.when(F.col(drop).isNotNull(), split).alias(own), F.size(split).cast("long").alias("n_lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col(drop))
    kept = F.array_join(F.transform(stay, lambda k: F.get(F.col(own), k)), "\n")
    text = F.when(F.col(drop).isNull(), F.col("text")).otherwise(kept)
    n_dropped = F.when(F.col(drop).isNull(), F.lit(0)).otherwise(F.size(drop)).cast("long")
    return both.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns], "n_lines", n_dropped.alias("n_dropped"))
