"""Table contracts: required columns, unique and filled keys, references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.columns import nonblank

#: Node tables with their keys, and relationship tables with the node keys they refer to.
NODES = {"company": "company_id", "sector": "sector_id", "industry": "industry_id", "asset": "asset_id", "article": "article_id", "event": "event_id", "market_observation": "observation_id"}
EDGES = {"issues": ("company", "asset"), "belongs_to": ("company", "industry"), "part_of": ("industry", "sector"), "reports": ("article", "event"), "mentions": ("article", "company"), "affects": ("event", "company"), "event_observation": ("event", "market_observation"), "asset_observation": ("asset", "market_observation")}


def require_columns(df: DataFrame, names: list[str], label: str) -> DataFrame:
    """df, or ValueError naming what it lacks; no job runs."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{label} lacks the columns {', '.join(missing)}")
    return df


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand more than once, with how often."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def blanks(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a | b, [~nonblank(F.col(k).cast("string")) for k in keys]))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str | None = None) -> DataFrame:
    """Distinct filled keys of child that parent lacks."""
    keys = child.select(F.col(child_key).alias("key")).where("key IS NOT NULL").distinct()
    return keys.join(parent.select(F.col(parent_key or child_key).alias("key")), "key", "left_anti")


def _first(df: DataFrame, column: str, most: int = 10) -> list[str]:
    return [str(r[0]) for r in df.select(column).orderBy(column).limit(most).collect()]


def ensure_unique(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    found = _first(duplicates(df, keys).select(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key")), "key")
    if found:
        raise ValueError(f"{label} repeats {', '.join(keys)}: {', '.join(found)}")
    return df


def ensure_nonblank(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    if not blanks(df, keys).isEmpty():
        raise ValueError(f"{label} has rows without {', '.join(keys)}")
    return df


def ensure_references(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str | None = None, label: str = "table") -> DataFrame:
    found = _first(orphans(child, parent, child_key, parent_key), "key")
    if found:
        raise ValueError(f"{label} refers to unknown {child_key}: {', '.join(found)}")
    return child


def graph_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(check, violations) of a graph package: unique node keys, unique edges, both ends of each edge there."""
    out = []
    for name, key in NODES.items():
        out.append(duplicates(tables[name], [key]).agg(F.lit(f"unique {name}").alias("check"), F.count(F.lit(1)).alias("violations")))
    for name, (left, right) in EDGES.items():
        keys = [NODES[left], NODES[right]]
        out.append(duplicates(tables[name], keys).agg(F.lit(f"unique {name}").alias("check"), F.count(F.lit(1)).alias("violations")))
        for end in (left, right):
            out.append(orphans(tables[name], tables[end], NODES[end]).agg(F.lit(f"{name} {end}").alias("check"), F.count(F.lit(1)).alias("violations")))
    return reduce(DataFrame.unionByName, out)
