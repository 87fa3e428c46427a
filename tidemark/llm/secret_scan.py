"""Secret scanning over content-addressed blobs with an incremental ledger, in DataFrame operations only.

Every version of every document is addressed by the SHA-256 of its text.  A ledger in shared storage
remembers which (blob, rule version) pairs were scanned and what was found; a scan reads only the texts
of pairs it has not seen, one row of each blob, and joins the findings back to all paths of the blob.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import unused

RULE_VERSION = "2"
#: Matches whose positions are summed up together.
BLOCK = 256


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, the group whose length must reach least, and texts (lower case) one of which every match contains."""

    kind: str
    pattern: str
    group: int
    least: int
    needs: tuple[str, ...]


#: The base kinds, in their listed order, then the kinds this operator adds.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, ("passw", "secret", "token", "apikey", "api_key")),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, ("akia",)),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, ()),
)
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, ("private key-----",)),
    Rule("repo_token", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1, ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-")),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, (".eyj",)),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:[^\s:/@]{1,128}@", 0, 1, ("://",)),
)
RULES = BASE + ADDED


def rule_spans(text: Column, lowered: Column, rule: Rule, order: int) -> Column:
    """The rule's matches, leftmost and not overlapping, as struct(start, ord, kind, stop); code points, stop exclusive.

    Positions come from lengths alone: what stands between two matches is what a split by the pattern
    leaves.  They are summed up within blocks of matches and then over the blocks, since Spark copies an
    array to add to it: the cost of a text with m matches is some 100 m steps.
    """
    kind = "struct<start:int,ord:int,kind:string,stop:int>"
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda s: F.length(s))
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    sizes = F.transform(whole, lambda s: F.length(s))

    def within(block: Column) -> Column:
        """(length of the block, its spans from its own start)."""
        return F.aggregate(
            block,
            F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out")),
            lambda acc, z: F.struct(
                (acc["at"] + z["gap"] + z["size"]).alias("at"),
                F.when(z["ok"], F.array_append(acc["out"], F.struct((acc["at"] + z["gap"]).alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), (acc["at"] + z["gap"] + z["size"]).alias("stop")))).otherwise(acc["out"]).alias("out"),
            ),
        )

    def moved(spans: Column, by: Column) -> Column:
        return F.transform(spans, lambda s: F.struct((s["start"] + by).alias("start"), s["ord"].alias("ord"), s["kind"].alias("kind"), (s["stop"] + by).alias("stop")))

    def place(zipped: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(zipped) - 1) / BLOCK).cast("int")), lambda i: within(F.slice(zipped, i * BLOCK + 1, BLOCK)))
        return F.aggregate(
            blocks,
            F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out")),
            lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.array_append(acc["out"], moved(b["out"], acc["at"])).alias("out")),
            lambda acc: F.flatten(acc["out"]),
        )

    oks = F.transform(part, lambda s: F.length(s) >= rule.least)
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(sizes)).alias("gap"), sizes.alias("size"), oks.alias("ok"))
    test = None
    for needle in rule.needs:
        test = F.contains(lowered, F.lit(needle)) if test is None else test | F.contains(lowered, F.lit(needle))
    if test is None:
        test = text.rlike(rule.pattern)
    # the array is bound once, by a lambda: each slice would compute it anew
    found = F.flatten(F.transform(F.array(pairs), lambda z: F.when(F.size(z) > 0, place(z)).otherwise(F.array().cast(f"array<{kind}>"))))
    return F.when(test, found).otherwise(F.array().cast(f"array<{kind}>"))


def all_spans(text: Column, lowered: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Every rule's spans by start, then by the rules' order."""
    return F.array_sort(F.concat(*[rule_spans(text, lowered, r, i) for i, r in enumerate(rules)]))


class BlobLedger:
    """Scanned (blob, rule version) pairs with what was found, as Parquet under `path`.

    Each scan writes to a folder of its own, a row for every blob it scanned, with or without findings,
    and is committed by a marker that is written last; only committed folders are read.  So a scan that
    was lost half way is simply scanned again, and one that comes twice finds nothing unseen: nothing is
    ever overwritten.
    """

    SCANNED = "blob binary, rule_version string, spans array<struct<start:int,ord:int,kind:string,stop:int>>"

    def __init__(self, spark: SparkSession, path: str, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION):
        self.spark, self.path, self.rules, self.rule_version = spark, path.rstrip("/"), rules, rule_version

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def scanned(self) -> DataFrame:
        """What this rule version has scanned; a blob may stand more than once, with equal spans, if scans ran at the same time."""
        path, fs = self._at("committed")
        names = sorted(str(s.getPath().getName()) for s in fs.listStatus(path)) if fs.exists(path) else []
        if not names:
            return self.spark.createDataFrame([], self.SCANNED)
        return self.spark.read.schema(self.SCANNED).parquet(*[f"{self.path}/scans/{n}" for n in names]).where(F.col("rule_version") == self.rule_version)

    def findings(self) -> DataFrame:
        return self.scanned().where(F.size("spans") > 0).dropDuplicates(["blob"])

    def scan(self, versions: DataFrame, path_column: str, batch: str) -> DataFrame:
        """Scans what is unseen among versions (path_column, text) and returns versions with blob and spans.

        Null text is the empty text.  Of equal texts only those under the least path are scanned, and
        recorded once; repeated rows come back as often as they came.  A batch id only names the files; one that comes
        again adds what is still unseen.  Columns named blob or spans are replaced.
        """
        if not re.fullmatch(r"\w[\w.-]*", batch):
            raise ValueError("a batch id has letters, digits, '_', '.' and '-' only")
        if path_column in ("blob", "spans"):
            raise ValueError("the path's column must not be named blob or spans")
        versions = versions.drop("blob", "spans")
        own, found_spans = unused(versions, "_blob", "_spans")
        text = F.coalesce(F.col("text"), F.lit(""))
        addressed = versions.select("*", F.unhex(F.sha2(text, 256)).alias("blob"))
        plain = addressed.select(F.col(path_column).alias("p"), "blob", text.alias("text"))
        unseen = plain.groupBy("blob").agg(F.min("p").alias("q")).join(self.scanned().select("blob"), "blob", "left_anti")
        unseen = unseen.select("q", F.col("blob").alias("b")).hint("shuffle_hash")
        todo = plain.join(unseen, F.col("p").eqNullSafe(F.col("q")) & (F.col("blob") == F.col("b")), "left_semi")
        todo = todo.select("blob", "text", F.lower("text").alias("lowered"))
        # no filter on spans here: it would be pushed below the join, and every text scanned
        found = todo.select("blob", F.lit(self.rule_version).alias("rule_version"), all_spans(F.col("text"), F.col("lowered"), self.rules).alias("spans"))
        found = found.dropDuplicates(["blob"])  # of a row that came several times
        name = f"{batch}-{uuid.uuid4().hex}"
        found.write.parquet(f"{self.path}/scans/{name}")
        path, fs = self._at(f"committed/{name}")
        fs.create(path).close()
        back = self.findings().select(F.col("blob").alias(own), F.col("spans").alias(found_spans))
        joined = addressed.join(back, F.col("blob") == F.col(own), "left")
        return joined.select(*addressed.columns, F.coalesce(found_spans, F.array().cast(dict(back.dtypes)[found_spans])).alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:stop of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


__all__ = ["BASE", "ADDED", "RULES", "RULE_VERSION", "BlobLedger", "Rule", "all_spans", "spans_text"]
