"""The corpus pipeline: language ID, line dedup, near-duplicate removal, decontamination, encoding.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage before it kept, and is
written as Parquet in the shared folder before the next one reads it, so a lost executor costs a stage
at most.  All but the last return the columns of documents; the last adds the pieces and their round trip.

Every stage takes an empty table and gives an empty one.  Null and empty texts go in the first stage, as
they have no letters; taken by itself, each later stage keeps them.  Rows that share a doc_id are one
document to line dedup and near duplicates, and rows of their own to the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language_id
from tidemark.llm.common import documents, drop_stored, stored
from tidemark.llm.decontaminate import drop_contaminated
from tidemark.llm.jaccard_join import keep_one
from tidemark.llm.line_dedup import drop_common_lines
from tidemark.llm.pieces import encode_pieces


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language cannot be told: no letters, or text unlike any learned language.

    Where nothing is labelled, only documents without letters go.
    """
    model = language_id.train(docs.select("doc_id", "text", "lang"))
    return language_id.identify(docs, model).where(~F.col("rejected")).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that ten documents or more share; n_chars follows the text. Null texts stay null."""
    kept = drop_common_lines(docs, min_docs=10, min_length=1)
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.select(*[n_chars.alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id of each group of near duplicates (five-word shingles, 0.75).

    Texts without words and rows without doc_id are like nothing, and stay.
    """
    return keep_one(docs, percent=75, width=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark window; an empty benchmark drops nothing, and null texts stay."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10, k=5)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds each text's piece ids and its best segmentations, and whether the ids give the text back; null texts have no ids."""
    out = encode_pieces(docs, into="decoded")
    return out.withColumn("round_trip", F.col("decoded").eqNullSafe(F.coalesce("text", F.lit("")))).drop("decoded")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("sentencepiece", encode),
]

#: SQL can express neither the language models nor the pieces; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop_stored(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
