"""Time alignment: next-session as-of join, horizon exits, holding paths, calendars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXCHANGE_ZONE = "America/New_York"


def local_date(ts: Column) -> Column:
    """Exchange-local date of a UTC timestamp without zone (daylight saving included; independent of the session's zone)."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(EXCHANGE_ZONE), ts))


def open_utc(date: Column) -> Column:
    """UTC timestamp of 09:30 exchange time on a date."""
    opening = F.to_timestamp_ntz(F.concat(date.cast("string"), F.lit(" 09:30:00")))
    return F.convert_timezone(F.lit(EXCHANGE_ZONE), F.lit("UTC"), opening)


def adjusted_open(prices: DataFrame) -> Column:
    """Open on the scale of the adjusted close; null where close isn't positive."""
    return F.when(F.col("close") > 0, F.col("open") * F.col("adjusted_close") / F.col("close"))


def usable_sessions(prices: DataFrame) -> DataFrame:
    """Prices without the sessions on which open, close, adjusted close or volume isn't positive: they aren't in the calendar at all."""
    return prices.where(F.least("open", "close", "adjusted_close", F.col("volume").cast("double")) > 0)


def sessions(prices: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Prices with a 0-based session index a ticker and, for each horizon h, the date and adjusted close of session index + h - 1."""
    w = Window.partitionBy("ticker").orderBy("date")
    out = prices.withColumn("session", F.row_number().over(w).cast("long") - 1).withColumn("adj_open", adjusted_open(prices))
    out = out.withColumn("prev_date", F.lag("date").over(w))
    for h in horizons:
        out = out.withColumn(f"exit_date_{h}d", F.lead("date", h - 1).over(w)).withColumn(f"exit_close_{h}d", F.lead("adjusted_close", h - 1).over(w))
    return out


def next_session(articles: DataFrame, timeline: DataFrame) -> DataFrame:
    """Left as-of join: each article (ticker, pub_date) gets the first session dated strictly after pub_date.

    A session serves the publication dates [previous session, its own date).
    These intervals are cut by month, so both sides meet by equality on
    (ticker, month): the join is hashed, never ranged over a whole ticker, and
    a hot ticker's months are spread over tasks. No session: nulls.
    """
    first = articles.select(F.trunc(F.min("pub_date"), "month").alias("first_month"))
    served = timeline.crossJoin(F.broadcast(first)).withColumn("since", F.coalesce("prev_date", F.least("first_month", "date")))
    months = F.sequence(F.greatest(F.trunc("since", "month"), F.col("first_month")), F.trunc("date", "month"), F.expr("interval 1 month"))
    months = F.when(F.trunc("date", "month") >= F.greatest(F.trunc("since", "month"), F.col("first_month")), months)
    right = served.withColumn("month", F.explode(months)).drop("first_month", "prev_date").withColumnRenamed("ticker", "_ticker")
    left = articles.withColumn("_month", F.trunc("pub_date", "month"))
    on = (left.ticker == right._ticker) & (left._month == right.month) & (left.pub_date >= right.since) & (left.pub_date < right.date)
    return left.join(right, on, "left").drop("_month", "month", "_ticker", "since").withColumnRenamed("date", "entry_date")


def forward_returns(aligned: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """future_return_{h}d = exit close over adjusted entry open - 1; null where the horizon is out of range."""
    for h in horizons:
        aligned = aligned.withColumn(f"future_return_{h}d", F.try_divide(F.col(f"exit_close_{h}d"), F.col("adj_open")) - 1)
    return aligned


def holding_days(positions: DataFrame, timeline: DataFrame, holding: int) -> DataFrame:
    """One row for each session of a position's path: entry at a session, ``holding`` sessions; only complete paths.

    The path is an equality join on (ticker, session), position by position; ``pos`` counts from 0.
    """
    entry = timeline.select("ticker", F.col("date").alias("entry_date"), F.col("session").alias("entry_session"))
    last = timeline.groupBy("ticker").agg(F.max("session").alias("last_session"))
    whole = positions.join(entry, ["ticker", "entry_date"]).join(last, "ticker").where(F.col("entry_session") + holding - 1 <= F.col("last_session"))
    steps = whole.drop("last_session").withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(holding - 1)))).withColumn("session", F.col("entry_session") + F.col("pos"))
    day = timeline.select("ticker", "session", "date", "open", "close", "adjusted_close", "adj_open", "volume")
    return steps.join(day, ["ticker", "session"])


def position_returns(days: DataFrame) -> DataFrame:
    """Return of each path day: close over adjusted open on the first, close over the previous close after."""
    before = F.lag("adjusted_close").over(Window.partitionBy("article_id").orderBy("pos"))
    return days.withColumn("day_return", F.col("adjusted_close") / F.when(F.col("pos") == 0, F.col("adj_open")).otherwise(before) - 1)


def densify(daily: DataFrame, calendar: DataFrame, fill: Sequence[str]) -> DataFrame:
    """Every calendar date, with zeros where nothing was held."""
    return calendar.join(daily, "date", "left").fillna(0, list(fill))
