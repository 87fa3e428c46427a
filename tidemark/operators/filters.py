"""Optional filters and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import iso_date, unit_interval


def filtered(df: DataFrame, company_id=None, event_type: str | None = None, start: str | None = None, end: str | None = None, least_probability: float | None = None) -> DataFrame:
    """df under those filters that are given; dates inclusive; a null or NaN probability never passes."""
    if company_id is not None:
        df = df.where(F.col("company_id") == company_id)
    if event_type is not None:
        df = df.where(F.col("event_type") == event_type)
    if start is not None:
        df = df.where(F.col("event_date") >= F.lit(iso_date(start, "start")).cast("date"))
    if end is not None:
        df = df.where(F.col("event_date") <= F.lit(iso_date(end, "end")).cast("date"))
    if least_probability is not None:
        df = df.where((F.col("prob") >= unit_interval(least_probability, "least_probability")) & ~F.isnan("prob"))
    return df


def provenance_match(report_source: Column, link_source: Column, representative: Column) -> Column:
    """The report that a link came from; a link that names none is backed by representative reports."""
    return (report_source == link_source) | (link_source.isNull() & F.coalesce(representative, F.lit(True)))


def analysis_ready(accepted: Column, complete: Column, published: Column, start: str, end: str) -> Column:
    """Accepted, complete, and published within the study's days (inclusive)."""
    day = F.substring(published.cast("string"), 1, 10)
    return accepted & complete & (F.length(day) == 10) & (day >= start) & (day <= end)
