"""Incremental forms for unbounded input. The batch operators define the results; these bound their state by time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_seen(stream: DataFrame, key: str, ts: str, lateness: str) -> DataFrame:
    """First row of each key; a key is remembered for ``lateness`` of event time."""
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


def windowed_totals(stream: DataFrame, ts: str, key: str, value: str, width: str, lateness: str) -> DataFrame:
    """Count and sum of each (window, key); late rows beyond ``lateness`` are dropped."""
    return stream.withWatermark(ts, lateness).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
