"""Token counts kept up to date by signed deltas.

A batch inserts, deletes or revises documents.  What it changes is written as signed rows by document,
summed to signed totals by source, language and tokenizer version, and then committed by a marker that
is written last.  Totals are the sums over committed batches; a batch id that is committed already
changes nothing, and one that broke off half way is written anew.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship

TOKENIZER_DIR = "/opt/tokenizers"
#: Tokenizer versions: files of byte-level BPE ranks in the tokenizers' folder.
VERSIONS = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")
#: Fixed value: how these vocabularies cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_encodings: dict[str, object] = {}


def encoding(folder: str, name: str):
    """The tokenizer of a ranks file; loaded once in a process."""
    path = str(Path(folder) / name)
    if path not in _encodings:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        _encodings[path] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def count_tokens(docs: DataFrame, versions: tuple[str, ...] = VERSIONS, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_tokens, n_chars): a row for every row of docs and tokenizer.

    Null text has 0 tokens and 0 characters; null source and lang stay null.
    """
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "source", "lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 512) for whole in batches for at in range(0, whole.num_rows, 512)):
            texts = batch.column(3).to_pylist()
            chars = pa.array([len(t or "") for t in texts], pa.int64())
            for name in versions:
                own = encoding(folder, name)
                tokens = pa.array([len(own.encode_ordinary(t)) if t else 0 for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([name] * len(texts), pa.string()), tokens, chars], ["doc_id", "source", "lang", "tokenizer", "n_tokens", "n_chars"])

    kinds = dict(docs.dtypes)
    return docs.mapInArrow(count, f"doc_id {kinds['doc_id']}, source {kinds['source']}, lang {kinds['lang']}, tokenizer string, n_tokens bigint, n_chars bigint")


class TokenLedger:
    """Totals of documents, tokens and characters by (source, lang, tokenizer), kept under `path` in shared storage.

    Repeated rows are a multiset: a document inserted twice counts twice, and deleting or revising a
    doc_id takes back everything that stands under it; a doc_id both deleted and revised stands revised.
    Deleting an unknown doc_id changes nothing.  Null doc_ids are inserted and never match a delete.
    """

    KEYS = ("source", "lang", "tokenizer")

    def __init__(self, spark: SparkSession, path: str, versions: tuple[str, ...] = VERSIONS, folder: str = TOKENIZER_DIR):
        self.spark, self.path, self.versions, self.folder = spark, path.rstrip("/"), versions, folder

    def _there(self, what: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{what}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _names(self, what: str) -> list[str]:
        """The folders under `what` that have been written whole."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{what}")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = sorted(str(s.getPath().getName()) for s in fs.listStatus(at)) if fs.exists(at) else []
        return [n for n in names if self._there(f"{what}/{n}/_SUCCESS")]

    def _covered(self) -> tuple[str | None, set[str]]:
        """The base that covers most batches, and those batches."""
        base = max(self._names("bases"), default=None)
        return base, {r[0] for r in self.spark.read.parquet(f"{self.path}/bases/{base}").collect()} if base else set()

    def _batches(self, what: str) -> DataFrame | None:
        """The rows of committed batches: of the base, and of those that it does not cover."""
        base, covered = self._covered()
        folders = [f"{self.path}/{what}/{n}" for n in self._names("committed") if n not in covered] + ([f"{self.path}/{what}-{base}"] if base else [])
        return self.spark.read.parquet(*folders) if folders else None

    def compact(self) -> None:
        """Folds all committed batches into one base, so that reads no longer open every batch; their ids stay committed.

        The base is in force when its list of batches is written, last.  Batches committed meanwhile are
        not covered by it.
        """
        names = self._names("committed")
        if not names or set(names) <= self._covered()[1]:
            return
        base = f"{len(names):012d}-{uuid.uuid4().hex}"
        live = self.live()
        live.withColumnRenamed("n", "sign").write.parquet(f"{self.path}/deltas-{base}")
        self.totals().coalesce(1).write.parquet(f"{self.path}/totals-{base}")
        if names != self._names("committed"):  # a batch came in between: what was written may hold it or not
            return
        self.spark.createDataFrame([(n,) for n in names], "batch string").coalesce(1).write.parquet(f"{self.path}/bases/{base}")

    def live(self) -> DataFrame | None:
        """The counted rows of documents that stand, each with its multiplicity n."""
        rows = self._batches("deltas")
        if rows is None:
            return None
        keys = [c for c in rows.columns if c != "sign"]
        return rows.groupBy(*keys).agg(F.sum("sign").alias("n")).where(F.col("n") > 0)

    def commit(self, batch: str, inserts: DataFrame | None = None, deletes: DataFrame | None = None, revisions: DataFrame | None = None) -> bool:
        """Applies a batch; False if its id was committed before.  deletes has doc_id; the others doc_id, source, lang, text."""
        if not re.fullmatch(r"\w[\w.-]*", batch):
            raise ValueError("a batch id has letters, digits, '_', '.' and '-' only")
        if self._there(f"committed/{batch}/_SUCCESS"):
            return False
        parts = [count_tokens(x, self.versions, self.folder).withColumn("sign", F.lit(1).cast("long")) for x in (inserts, revisions) if x is not None]
        live = self.live()
        gone = [x.select("doc_id") for x in (deletes, revisions) if x is not None]
        if gone and live is not None:
            ids = gone[0] if len(gone) == 1 else gone[0].unionByName(gone[1])
            back = live.join(ids.distinct(), "doc_id", "left_semi").withColumn("sign", -F.col("n")).drop("n")
            parts.append(back)
        if not parts:
            parts = [count_tokens(self.spark.createDataFrame([], "doc_id bigint, source string, lang string, text string"), self.versions, self.folder).withColumn("sign", F.lit(1).cast("long"))]
        delta = parts[0]
        for more in parts[1:]:
            delta = delta.unionByName(more)
        delta.write.mode("overwrite").parquet(f"{self.path}/deltas/{batch}")
        written = self.spark.read.schema(delta.schema).parquet(f"{self.path}/deltas/{batch}")
        sums = written.groupBy(*self.KEYS).agg(F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"), F.sum(F.col("sign") * F.col("n_chars")).alias("n_chars"))
        sums.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/totals/{batch}")
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/committed/{batch}")
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens, n_chars over all committed batches; groups that have emptied are gone."""
        rows = self._batches("totals")
        if rows is None:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint, n_chars bigint")
        return rows.groupBy(*self.KEYS).agg(*[F.sum(c).alias(c) for c in ("n_docs", "n_tokens", "n_chars")]).where("n_docs != 0 OR n_tokens != 0 OR n_chars != 0")
