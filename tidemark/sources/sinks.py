"""Writers: CSV with nested cells as JSON, graph packages, strict JSON, manifests, briefings."""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


def flat(df: DataFrame) -> DataFrame:
    """Lists (sorted), maps and structs as JSON text; other columns as they are."""
    out = []
    for f in df.schema:
        if isinstance(f.dataType, T.ArrayType):
            out.append(F.to_json(F.array_sort(f.name)).alias(f.name))
        elif isinstance(f.dataType, T.MapType):
            out.append(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(f.name)))).alias(f.name))
        elif isinstance(f.dataType, T.StructType):
            out.append(F.to_json(f.name).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


BOM = "\ufeff"


def write_csv(df: DataFrame, path: str, fields: list[str], single: bool = False, bom: bool = False) -> None:
    """The named fields in that order, others left out; one file only on request, for tables that are known to be small.

    With bom every file begins with a byte-order mark, which spreadsheets ask for and read_text_csv takes off.
    """
    out = flat(df.select(*fields))
    if bom:
        out = out.toDF(BOM + fields[0], *fields[1:])
    (out.coalesce(1) if single else out).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """current with changes merged in: for each key the last change by order wins, others stay."""
    last = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(order).desc()))
    fresh = changes.withColumn("_n", last).where("_n = 1").drop("_n", order)
    return current.join(fresh, keys, "left_anti").unionByName(fresh.select(*current.columns))


def write_package(tables: dict[str, DataFrame], path: str, expected: dict[str, int] | None = None) -> dict[str, int]:
    """Every table as Parquet under path; ValueError for an empty one, or a count other than expected, before anything is final.

    Written into a staging folder and then moved, so readers see whole packages; what stood there before
    stays beside it as a backup, and comes back if the moved tables do not count as they should.
    """
    spark = next(iter(tables.values())).sparkSession
    counts: dict[str, int] = {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}.staging/{name}")
        counts[name] = spark.read.parquet(f"{path}.staging/{name}").count()
        if not counts[name]:
            raise ValueError(f"{name} is empty")
        if expected and expected.get(name, counts[name]) != counts[name]:
            raise ValueError(f"{name} has {counts[name]} rows, not {expected[name]}")
    where = spark._jvm.org.apache.hadoop.fs.Path
    fs = where(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(where(path)):
        fs.delete(where(f"{path}.backup"), True)
        fs.rename(where(path), where(f"{path}.backup"))
    fs.rename(where(f"{path}.staging"), where(path))
    moved = {name: spark.read.parquet(f"{path}/{name}").count() for name in tables}
    if moved != counts:
        fs.delete(where(path), True)
        if fs.exists(where(f"{path}.backup")):
            fs.rename(where(f"{path}.backup"), where(path))
        raise ValueError(f"the moved package counts {moved}, not {counts}")
    return counts


def split_statements(text: str) -> list[str]:
    """Statements between semicolons, without lines of // comments."""
    lines = [x for x in text.splitlines() if not x.strip().startswith("//")]
    return [x.strip() for x in "\n".join(lines).split(";") if x.strip()]


def check_read_only(text: str) -> str:
    """text, or ValueError if it holds a word that writes."""
    found = re.search(r"(?i)\b(create|merge|set|delete|detach|remove|drop|load|insert|update|alter|truncate)\b", text)
    if found:
        raise ValueError(f"a read-only query may not hold {found[0].upper()}")
    return text


def strict_json(value: object) -> str:
    """JSON without NaN and infinities; ValueError where there are any."""

    def walk(x: object) -> None:
        if isinstance(x, float) and not math.isfinite(x):
            raise ValueError("a number is not finite")
        for y in x.values() if isinstance(x, dict) else x if isinstance(x, (list, tuple)) else ():
            walk(y)

    walk(value)
    return json.dumps(value, ensure_ascii=False, sort_keys=True, default=str)


def find_credentials(value: object, path: str = "$") -> list[str]:
    """Where a nested document holds a key or text that looks like a credential."""
    found = []
    if isinstance(value, dict):
        for k, v in value.items():
            if re.search(r"(?i)(api_?key|password|secret|token|credential)$", str(k)):
                found.append(f"{path}.{k}")
            found += find_credentials(v, f"{path}.{k}")
    elif isinstance(value, (list, tuple)):
        for i, v in enumerate(value):
            found += find_credentials(v, f"{path}[{i}]")
    elif isinstance(value, str) and re.search(r"(?i)\b(bearer\s+\S{12,}|[a-z][a-z0-9+.-]*://[^\s/:@]+:[^\s/@]+@)", value):
        found.append(path)
    return found


def content_hash(df: DataFrame) -> DataFrame:
    """One row: how many rows, and a SHA-256 that neither row nor list order changes.

    Rows are hashed where they are; equal hashes are counted, and the sums over 4 x 60 bits of all rows
    are hashed at the end, so no task sees all rows.
    """
    rows = flat(df)
    h = F.sha2(F.to_json(F.struct(*[F.col(c).alias(c) for c in sorted(rows.columns)]), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(4)]
    sums = rows.agg(F.count(F.lit(1)).alias("n_rows"), *parts)
    text = F.concat_ws("|", *[F.coalesce(F.col(f"p{i}"), F.lit(0)).cast("string") for i in range(4)], F.col("n_rows").cast("string"))
    return sums.select("n_rows", F.sha2(text, 256).alias("content_sha256"))


def manifest(tables: dict[str, DataFrame], parameters: dict) -> dict:
    """Counts and content hashes of tables, with the parameters that made them; read-only by contract."""
    found = {name: content_hash(df).first().asDict() for name, df in tables.items()}
    return {"read_only": True, "parameters": parameters, "outputs": found}


def check_manifest(written: dict) -> dict:
    """written, or ValueError unless it says that its outputs are read-only, and names them with counts and hashes."""
    if written.get("read_only") is not True:
        raise ValueError("a manifest must say read_only")
    outputs = written.get("outputs")
    if not isinstance(outputs, dict) or not outputs:
        raise ValueError("a manifest names its outputs")
    for name, facts in outputs.items():
        if not isinstance(facts, dict) or not {"n_rows", "content_sha256"} <= set(facts):
            raise ValueError(f"{name} lacks its count or hash")
    found = find_credentials(written)
    if found:
        raise ValueError(f"a manifest holds what looks like a credential: {', '.join(found)}")
    return written


def write_snapshot(tables: dict[str, DataFrame], path: str, parameters: dict, most_rows: int = 100_000) -> dict:
    """Every table as JSON lines under path, and a manifest beside them, written last; returns the manifest.

    For dashboards: ValueError if a table has more than most_rows rows, before anything is written.
    """
    whole = check_manifest(manifest(tables, parameters))
    for name, facts in whole["outputs"].items():
        if facts["n_rows"] > most_rows:
            raise ValueError(f"{name} has {facts['n_rows']} rows, more than {most_rows}")
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.coalesce(1).write.mode("overwrite").json(f"{path}/{name}", ignoreNullFields=False)
    spark.createDataFrame([(strict_json(whole),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return whole


def verify_manifest(tables: dict[str, DataFrame], written: dict) -> list[str]:
    """Names of tables whose content differs from the manifest's."""
    return [n for n, df in tables.items() if content_hash(df).first().asDict() != written["outputs"].get(n)]


def briefing(title: str, sections: dict[str, DataFrame], spark: SparkSession | None = None, most: int = 20) -> str:
    """A Markdown report with a table of at most `most` rows for each section."""
    out = [f"# {title}", ""]
    for name, df in sections.items():
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in df.limit(most).collect()]
        out.append("")
    return "\n".join(out)
