"""The operators' registered queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, scratch
from .decontaminate import contaminated_words
from .fingerprint import fingerprint_edits
from .hmm_lm import score_texts
from .jaccard_join import near_duplicates
from .language_id import identify, train
from .license_scan import scan_licenses
from .line_dedup import drop_common_lines
from .pieces import encode_pieces
from .secret_scan import BASE, BlobLedger, spans_text
from .token_counts import TokenLedger

WORDS_SQL = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    model = train(docs.where(~held_out).select("doc_id", "text", "lang"))
    out = identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after a load of all documents, and a batch that unwraps those of several lines and takes out the shortest."""
    ledger = TokenLedger(spark, scratch(spark, "token-ledger"))
    docs = documents(spark, sf_dir).select("doc_id", "source", "lang", "text")
    ledger.commit("load", inserts=docs)
    short = F.length(F.coalesce("text", F.lit(""))) < 100
    unwrapped = docs.where(~short & F.contains("text", F.lit("\n"))).withColumn("text", F.translate("text", "\n", " "))
    ledger.commit("unwrap", deletes=docs.where(short), revisions=unwrapped)
    ledger.commit("unwrap", deletes=docs.where(short), revisions=unwrapped)  # a batch that is delivered twice counts once
    return ledger.totals()


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir).select("doc_id", "text")).drop("text", "license_spans")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_common_lines(documents(spark, sf_dir).select("doc_id", "text"), min_docs=10, min_length=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
common AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(c.k)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common c USING (k) GROUP BY doc_id
"""


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), percent=75, width=5)


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g
      FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
ways AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT z.b, r.root FROM reach r JOIN ways z ON z.a = r.node),
roots AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM documents d JOIN roots ON node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = BlobLedger(spark, scratch(spark, "secret-ledger"))
    out = ledger.scan(documents(spark, sf_dir).select("doc_id", "text"), "doc_id", batch="0")
    base = F.filter("spans", lambda s: s["ord"] < len(BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", *[count(r.kind) for r in BASE], F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(documents(spark, sf_dir))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contaminated_words(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10, k=5)
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), "contaminated")


OP8_SQL = rf"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s
        FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, s, dw.n FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2
    out = score_texts(docs, ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_pieces(documents(spark, sf_dir).select("doc_id", "text"), into="decoded")
    scores = F.transform("nbest", lambda x: x["score"])
    exact = F.col("decoded").eqNullSafe(F.coalesce("text", F.lit("")))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.xxhash64("ids").alias("ids_hash"), scores.alias("scores"), "nbest", exact.alias("round_trip"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_token_counts": op2_token_counts,
    "op3_license_scan": op3_license_scan,
    "op4_line_dedup": op4_line_dedup,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_secret_scan": op6_secret_scan,
    "op7_document_fingerprints": op7_document_fingerprints,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_sentencepiece_nbest": op10_sentencepiece_nbest,
}
ORACLE = {"op4_line_dedup": OP4_SQL, "op5_ngram_jaccard_join": OP5_SQL, "op8_benchmark_decontamination": OP8_SQL}
