"""Readers: all-text CSV, daily market files, nested articles, cached fetches."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

ARTICLE_SCHEMA = "id string, webTitle string, webPublicationDate string, sectionName string, webUrl string, fields struct<headline:string,trailText:string,bodyText:string,byline:string,wordcount:string>, tags array<struct<id:string,webTitle:string>>"
SERIES_SCHEMA = "meta struct<symbol:string,exchange:string>, status string, message string, values array<struct<datetime:string,open:string,high:string,low:string,close:string,volume:string>>"


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with every column text, blanks as '', a byte-order mark taken off the first name."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, quote='"', escape='"', nullValue="\x00", emptyValue="")
    return df.toDF(*[c.lstrip("﻿") for c in df.columns]).na.fill("")


def data_rows(df: DataFrame) -> int:
    """Rows in which any cell is filled."""
    filled = F.coalesce(*[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in df.columns])
    return df.where(filled.isNotNull()).count()


def daily_prices(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, date, open, high, low, close, volume: casts that fail are null, rows without date or close go, the last row of a date (by order) stays."""
    price = lambda c: F.trim(F.col(c).cast("string")).try_cast("double").alias(c)
    typed = rows.select(*keys, F.substring(F.col("date").cast("string"), 1, 10).try_cast("date").alias("date"), *[price(c) for c in ("open", "high", "low", "close", "volume")], F.col(order).alias("_order"))
    last = F.row_number().over(W.partitionBy(*keys, "date").orderBy(F.col("_order").desc()))
    return typed.where("date IS NOT NULL AND close IS NOT NULL").withColumn("_n", last).where("_n = 1").drop("_n", "_order")


def flatten_articles(raw: DataFrame, column: str = "value") -> DataFrame:
    """One row of plain columns for each article's JSON; tags become lists of ids and titles."""
    from ..functions.text import strip_html

    a = raw.select(F.from_json(column, ARTICLE_SCHEMA).alias("a")).select("a.*")
    return a.select(
        F.col("id").alias("article_id"), F.coalesce("fields.headline", "webTitle").alias("headline"), strip_html(F.coalesce("fields.trailText", F.lit(""))).alias("trail_text"),
        F.coalesce("fields.bodyText", F.lit("")).alias("body_text"), F.col("sectionName").alias("section_name"), F.try_to_timestamp("webPublicationDate").alias("publication_timestamp"), F.col("webUrl").alias("web_url"),
        F.coalesce(F.transform("tags", lambda t: t["id"]), F.array().cast("array<string>")).alias("tag_ids"), F.coalesce(F.transform("tags", lambda t: t["webTitle"]), F.array().cast("array<string>")).alias("tag_titles"),
    )


def flatten_series(raw: DataFrame, column: str = "value") -> DataFrame:
    """Daily rows of time-series responses, and how each response ended: ok, rate_limit, auth, unavailable."""
    s = raw.select(F.from_json(column, SERIES_SCHEMA).alias("s")).select("s.*")
    message = F.lower(F.coalesce("message", F.lit("")))
    outcome = F.when(F.col("status") == "ok", "ok").when(message.rlike("limit|credits"), "rate_limit").when(message.rlike("api ?key|unauthori"), "auth").otherwise("unavailable")
    s = s.select(F.col("meta.symbol").alias("symbol"), F.col("meta.exchange").alias("exchange"), outcome.alias("outcome"), F.explode_outer("values").alias("v"))
    return s.select("symbol", "exchange", "outcome", F.substring("v.datetime", 1, 10).try_cast("date").alias("date"), *[F.col(f"v.{c}").try_cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")])


def fetch_missing(spark: SparkSession, wanted: DataFrame, keys: list[str], cache: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """cache with what fetch brings for the keys of wanted that it lacks; fetch sees those alone."""
    missing = wanted.select(*keys).distinct().join(cache.select(*keys).distinct(), keys, "left_anti")
    return cache.unionByName(fetch(missing))


class Exhausted(RuntimeError):
    """No more attempts are allowed; what has been fetched stays, so a later run goes on from there."""


class Transient(RuntimeError):
    """A failure that may pass: a broken connection, a rate limit, a fault of the server."""


@dataclass
class Budget:
    """Attempts that may be made, retries among them; 0 sets no bound."""

    most: int
    used: int = 0

    def spend(self) -> None:
        if 0 < self.most <= self.used:
            raise Exhausted(f"{self.used} of {self.most} attempts are used")
        self.used += 1


def attempt(call: Callable[[], dict], budget: Budget, retries: int = 3, backoff: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> dict:
    """What call returns; a transient failure is tried again after backoff, then twice as long, and so on, `retries` times."""
    for turn in range(retries + 1):
        budget.spend()
        try:
            return call()
        except Transient:
            if turn == retries:
                raise
            sleep(backoff * 2**turn)
    raise AssertionError("unreachable")


def paged(keys: Iterable[tuple], page: Callable[[tuple, int], dict], budget: Budget, have: Callable[[tuple, int], dict | None] = lambda key, n: None, retries: int = 3, backoff: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Iterator[tuple[tuple, int, dict]]:
    """(key, page number, response) for every page of every key, from 1 to what the response gives as `pages`.

    have is asked first, and what it knows costs no attempt.  Keys are few (companies by windows); rows of
    responses become a table by flatten_articles or flatten_series.
    """
    for key in keys:
        n, last = 1, 1
        while n <= last:
            known = have(key, n)
            response = attempt(lambda key=key, n=n: page(key, n), budget, retries, backoff, sleep) if known is None else known
            last = max(1, int(response.get("pages", 1)))
            yield key, n, response
            n += 1


def load_config(text: str) -> dict:
    """A settings document (JSON, or YAML where a parser is installed); ValueError unless it is a mapping."""
    try:
        found = json.loads(text)
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("settings are not JSON, and no YAML parser is installed") from e
        found = yaml.safe_load(text)
    if not isinstance(found, dict):
        raise ValueError("settings must be a mapping")
    return found


def inside(root: str, relative: str) -> str:
    """root/relative; ValueError if that leaves root."""
    path = PurePosixPath(relative)
    if path.is_absolute() or ".." in path.parts:
        raise ValueError(f"{relative} leaves {root}")
    return f"{root.rstrip('/')}/{path}"


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(w[:1].upper() + w[1:] for w in rest)


def camel_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[camel(c) for c in df.columns])


def typed(df: DataFrame, schema: T.StructType | str) -> DataFrame:
    """df's text columns cast as declared; what does not parse is null."""
    fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return df.select(*[F.nullif(F.trim(F.col(f.name)), F.lit("")).try_cast(f.dataType).alias(f.name) for f in fields])


def read_query(spark: SparkSession, sql: str, tables: dict[str, DataFrame], parameters: dict | None = None) -> DataFrame:
    """A user's query over named tables ({name} in the text) with named parameters (:name); it may not write, and an empty result keeps its columns."""
    from .sinks import check_read_only

    return spark.sql(check_read_only(sql), args=parameters or {}, **tables)
