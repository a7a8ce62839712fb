"""Weight-based daily books: overlap suppression, weights, turnover, exposures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def suppress_overlaps(events: DataFrame, timeline: DataFrame, holding: int) -> DataFrame:
    """Events kept when at most one position a ticker is open.

    Events of a ticker in order of (entry date, article_id); one is kept if its
    entry lies after the last kept one's exit. An event whose path runs past the
    data neither counts nor blocks. Of a ticker's events of one session only the
    first can be kept, so the walk, a fold over a ticker's sorted array inside
    the plan, is as long as the calendar at most: parallel by ticker, no Python.
    """
    entry = timeline.select("ticker", F.col("date").alias("entry_date"), F.col("session").alias("entry_session"))
    last = timeline.groupBy("ticker").agg(F.max("session").alias("_last"))
    whole = events.join(entry, ["ticker", "entry_date"]).join(last, "ticker").where(F.col("entry_session") + holding - 1 <= F.col("_last"))
    whole = whole.groupBy("ticker", "entry_date", "entry_session").agg(F.min("article_id").alias("article_id"))
    ordered = F.array_sort(F.collect_list(F.struct("entry_date", "article_id", "entry_session")))
    start = F.struct(F.lit(-1).cast("long").alias("until"), F.array().cast("array<string>").alias("kept"))

    def step(state: Column, event: Column) -> Column:
        free = event["entry_session"] > state["until"]
        return F.struct(F.when(free, event["entry_session"] + holding - 1).otherwise(state["until"]).alias("until"), F.when(free, F.concat(state["kept"], F.array(event["article_id"]))).otherwise(state["kept"]).alias("kept"))

    kept = whole.groupBy("ticker").agg(F.aggregate(ordered, start, step)["kept"].alias("kept")).select(F.explode("kept").alias("article_id"))
    return events.join(kept, "article_id", "left_semi")


def weights(days: DataFrame, *, mode: str, cap: float) -> DataFrame:
    """``weight`` of each open position a date.

    long_only: 1 / longs, at most ``cap``; shorts weigh nothing. market_neutral:
    half a side shared among its names, at most ``cap``; both sides or nothing.
    """
    w = Window.partitionBy("date")
    out = days.withColumn("_long", F.sum((F.col("direction") > 0).cast("long")).over(w)).withColumn("_short", F.sum((F.col("direction") < 0).cast("long")).over(w))
    if mode == "long_only":
        size = F.when(F.col("direction") > 0, F.least(F.lit(1.0) / F.col("_long"), F.lit(cap))).otherwise(0.0)
    elif mode == "market_neutral":
        side = F.when(F.col("direction") > 0, F.col("_long")).otherwise(F.col("_short"))
        size = F.when((F.col("_long") > 0) & (F.col("_short") > 0), F.col("direction") * F.least(F.lit(0.5) / side, F.lit(cap))).otherwise(0.0)
    else:
        raise ValueError(f"unknown mode: {mode}")
    return out.withColumn("weight", size).drop("_long", "_short")


def daily_book(weighted: DataFrame, calendar: DataFrame) -> DataFrame:
    """One row a calendar date: gross return, turnover, exposures, positions and concentration; zeros on idle dates.

    Turnover is the sum over names of the change of weight from the calendar
    session before; the close-out after the last session isn't charged. Each
    weight counts +w on its date and -w on the next, so no name is paired with
    its past.
    """
    index = calendar.select("date", F.row_number().over(Window.orderBy("date")).alias("_i"))
    held = weighted.join(F.broadcast(index), "date")
    moves = held.select("_i", "ticker", F.col("weight").alias("_w")).union(held.select(F.col("_i") + 1, "ticker", -F.col("weight")))
    turnover = moves.groupBy("_i", "ticker").agg(F.sum("_w").alias("_w")).groupBy("_i").agg(F.sum(F.abs("_w")).alias("turnover"))
    size = F.abs("weight")
    book = held.groupBy("_i").agg(
        F.sum(F.col("weight") * F.col("day_return")).alias("gross_return"), F.sum(F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0)).alias("long_exposure"),
        F.sum(F.when(F.col("weight") < 0, -F.col("weight")).otherwise(0.0)).alias("short_exposure"), F.count(F.when(F.col("weight") != 0, 1)).alias("positions"),
        F.coalesce(F.try_divide(F.sum(F.col("weight") * F.col("weight")), F.pow(F.sum(size), 2)), F.lit(0.0)).alias("hhi"),
    )
    fill = ["gross_return", "turnover", "long_exposure", "short_exposure", "positions", "hhi"]
    return index.join(book, "_i", "left").join(turnover, "_i", "left").fillna(0, fill).drop("_i")


def net_returns(book: DataFrame, cost_bps: float, out: str = "net_return") -> DataFrame:
    """Gross return less turnover at a one-way cost."""
    return book.withColumn(out, F.col("gross_return") - F.col("turnover") * cost_bps / 10_000)


def attribution(weighted: DataFrame, book: DataFrame, cost_bps: float) -> DataFrame:
    """One row: where a book's gross return came from and what turnover took: contributions of longs and shorts, drag, ratios a position and a unit of turnover, activity."""
    part = lambda sign: F.coalesce(F.sum(F.when(F.signum("weight") == sign, F.col("weight") * F.col("day_return"))), F.lit(0.0))
    sides = weighted.agg(F.count_distinct("article_id").alias("accepted"), part(1).alias("long_contribution"), part(-1).alias("short_contribution"))
    on = F.col("positions") > 0
    days = book.agg(F.sum("gross_return").alias("gross"), F.sum("turnover").alias("turnover"), F.count("*").alias("calendar_days"), F.count(F.when(on, 1)).alias("active_days"), F.sum("positions").alias("position_days"), F.max("positions").alias("maximum_positions"), F.avg("positions").alias("average_all_days"), F.avg(F.when(on, F.col("positions"))).alias("average_active_days"))
    both = sides.join(days)
    drag = F.col("turnover") * cost_bps / 10_000
    made = {"cost_drag_bps": drag * 10_000, "gross_bps_per_position": F.try_divide(F.col("gross"), F.col("accepted")) * 10_000, "cost_bps_per_position": F.try_divide(drag, F.col("accepted")) * 10_000, "gross_bps_per_turnover": F.try_divide(F.col("gross"), F.col("turnover")) * 10_000}
    return both.withColumns(made)
