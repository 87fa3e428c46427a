"""Trading-session alignment: as-of sessions, signed return windows, statuses, series quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import MarketConfig


def positions(prices: DataFrame, key: str) -> DataFrame:
    """prices with pos: the session's place in its series, from 0; one without a date is last."""
    return prices.withColumn("pos", F.row_number().over(W.partitionBy(key).orderBy(F.col("date").asc_nulls_last())).cast("int") - 1)


def align_sessions(publications: DataFrame, prices: DataFrame, key: str, timestamp: str = "published_at", config: MarketConfig = MarketConfig()) -> DataFrame:
    """publications with local_date, anchor_pos, anchor_date and rule: the session at which each reaches the market.

    The day's own session up to the close, inclusive; else the next session.  Both sides are dealt by
    key and ordered by date once; the nearest session ahead is a running value, not a range join.
    """
    sessions = positions(prices, key).select(key, F.col("date").alias("_d"), "pos")
    local = F.from_utc_timestamp(F.col(timestamp), config.timezone)
    pubs = publications.withColumn("_local", local).withColumn("local_date", F.to_date("_local"))
    late = F.date_format("_local", "HH:mm:ss.SSSSSS") > F.lit(config.close + ":00.000000")
    asked = pubs.select(F.struct(*publications.columns, "local_date", late.alias("_late")).alias("_p"), F.col(key), F.col("local_date").alias("_d"), F.lit(None).cast("int").alias("pos"))
    both = sessions.select(F.lit(None).cast(asked.schema["_p"].dataType).alias("_p"), key, "_d", "pos").unionByName(asked)
    by_day = W.partitionBy(key, "_d")
    same = F.max("pos").over(by_day)
    both = both.withColumn("_same", same)
    ahead = W.partitionBy(key).orderBy(F.col("_d").desc_nulls_first(), F.col("pos").isNull().cast("int").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    both = both.withColumn("_later", F.min(F.when(F.col("_d").isNotNull(), F.col("pos"))).over(ahead))
    out = both.where("_p IS NOT NULL").select("_p.*", "_same", "_later")
    rule = F.when(F.col("_same").isNull(), "next_session_non_trading_day").when(F.col("_late"), "next_session_after_close").otherwise("same_session_before_close")
    pos = F.when(F.col("local_date").isNotNull(), F.when(F.col("_same").isNotNull() & ~F.col("_late"), F.col("_same")).otherwise(F.col("_later")))
    out = out.withColumn("anchor_pos", pos).withColumn("rule", F.when(F.col("local_date").isNotNull(), rule)).drop("_same", "_later", "_late")
    return out.join(sessions.select(F.col(key), F.col("pos").alias("anchor_pos"), F.col("_d").alias("anchor_date")), [key, "anchor_pos"], "left").select(*publications.columns, "local_date", "anchor_pos", "anchor_date", "rule")


def _ratio(a: Column, b: Column) -> Column:
    """a / b in floating point: over a zero infinite, or NaN if a is zero or NaN."""
    endless = F.when((a == 0) | F.isnan(a), float("nan")).otherwise(F.signum(a) * F.when(b.cast("string") == "-0.0", float("-inf")).otherwise(float("inf")))
    return F.when(a.isNotNull() & (b == 0), endless).otherwise(F.try_divide(a, b))


def return_windows(aligned: DataFrame, prices: DataFrame, key: str, windows: tuple[int, ...] = MarketConfig().windows) -> DataFrame:
    """A row for every window that the series holds: window_days, baseline and end date and close, cumulative_return.

    Positive windows start at the close before the anchor session; negative ones end there.  A return over a
    close of 0 is infinite, or NaN if both are 0.
    """
    if 0 in windows:
        raise ValueError("a market window of 0 sessions has no meaning")
    series = positions(prices, key).select(key, "pos", "date", "close")
    rows = aligned.where("anchor_pos IS NOT NULL").withColumn("window_days", F.explode(F.array(*map(F.lit, windows))))
    before = F.col("anchor_pos") - 1
    rows = rows.withColumn("_a", F.when(F.col("window_days") > 0, before).otherwise(before + F.col("window_days"))).withColumn("_b", F.when(F.col("window_days") > 0, before + F.col("window_days")).otherwise(before))
    start = series.select(F.col(key), F.col("pos").alias("_a"), F.col("date").alias("baseline_date"), F.col("close").alias("baseline_close"))
    end = series.select(F.col(key), F.col("pos").alias("_b"), F.col("date").alias("window_end_date"), F.col("close").alias("window_end_close"))
    rows = rows.join(start, [key, "_a"]).join(end, [key, "_b"]).drop("_a", "_b")
    return rows.withColumn("cumulative_return", _ratio(F.col("window_end_close").cast("double"), F.col("baseline_close").cast("double")) - 1).withColumn("causal_claim", F.lit(False))


def alignment_status(aligned: DataFrame, found: DataFrame, keys: list[str], windows: int = 6, timestamp: str = "published_at") -> DataFrame:
    """aligned with n_windows and status."""
    n = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_windows"))
    out = aligned.join(n, keys, "left").withColumn("n_windows", F.coalesce("n_windows", F.lit(0)))
    status = (
        F.when(F.col(timestamp).isNull(), "INVALID_PUBLICATION_TIMESTAMP")
        .when(F.col("anchor_pos").isNull(), "NO_TRADING_SESSION_AFTER_EVENT")
        .when(F.col("anchor_pos") == 0, "NO_BASELINE_SESSION")
        .when(F.col("n_windows") == windows, "ALIGNED")
        .otherwise("PARTIAL_WINDOWS")
    )
    return out.withColumn("status", status)


def series_quality(prices: DataFrame, key: str, start: str, end: str, least_rows: int = 1, most_gap: int = 10, most_missing: float = 0.02, most_delay: int = 7) -> DataFrame:
    """For each series: rows, first and last date, delays against the study, largest gap in days, share of missing cells, reasons against it."""
    w = W.partitionBy(key).orderBy("date")
    cells = ("open", "high", "low", "close", "volume")
    rows = prices.withColumn("_gap", F.datediff("date", F.lag("date").over(w)))
    absent = sum([F.col(c).isNull().cast("int") for c in cells], F.lit(0))
    out = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.coalesce(F.max("_gap"), F.lit(0)).alias("largest_gap"), (F.sum(absent) / (F.count(F.lit(1)) * len(cells))).alias("missing_ratio"))
    out = out.withColumn("start_delay", F.datediff("first_date", F.lit(start).cast("date"))).withColumn("end_delay", F.datediff(F.lit(end).cast("date"), "last_date"))
    reasons = F.concat_ws("; ", F.when(F.col("n_rows") < least_rows, "too few rows"), F.when(F.col("start_delay") > most_delay, "starts late"), F.when(F.col("end_delay") > most_delay, "ends early"), F.when(F.col("largest_gap") > most_gap, "gap too long"), F.when(F.col("missing_ratio") > most_missing, "cells missing"))
    return out.withColumn("reasons", reasons).withColumn("eligible", F.col("reasons") == "")


def first_eligible(ranked: DataFrame, rank: str, most: int) -> DataFrame:
    """The first `most` eligible rows by rank, numbered from 1."""
    return ranked.where("eligible").orderBy(rank).limit(most).withColumn("sample_order", F.row_number().over(W.orderBy(rank)))
