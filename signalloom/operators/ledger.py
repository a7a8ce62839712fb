"""Trade ledgers: orders, fills, position days and profit from accepted trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .costs import Scenario, bps_of, borrow, commission, impact


def mark(days: DataFrame) -> DataFrame:
    """Marked profit and notional of each path day: from the adjusted open, then from the previous adjusted close."""
    w = Window.partitionBy("article_id").orderBy("pos")
    before = F.when(F.col("pos") == 0, F.col("adj_open")).otherwise(F.lag("adjusted_close").over(w))
    out = days.withColumn("entry_open", F.first("adj_open").over(w))
    shares = F.col("notional") / F.col("entry_open")
    return out.withColumn("pnl", F.col("direction") * shares * (F.col("adjusted_close") - before)).withColumn("marked", F.col("direction") * shares * F.col("adjusted_close")).drop("entry_open")


def fills(days: DataFrame, holding: int, scenario: Scenario) -> DataFrame:
    """Two fills a trade: entry at the open of its first day, exit at the close of its last, with costs of either."""
    ends = days.where((F.col("pos") == 0) | (F.col("pos") == holding - 1))
    first = F.struct(F.lit("entry").alias("side"), F.col("open").alias("price"), F.col("direction").alias("sign"))
    last = F.struct(F.lit("exit").alias("side"), F.col("close").alias("price"), (-F.col("direction")).alias("sign"))
    sides = F.filter(F.array(F.when(F.col("pos") == 0, first), F.when(F.col("pos") == holding - 1, last)), lambda x: x.isNotNull())
    w = Window.partitionBy("article_id")
    out = ends.withColumn("shares", F.col("notional") / F.max(F.when(F.col("pos") == 0, F.col("open"))).over(w)).withColumn("s", F.explode(sides))
    out = out.select("article_id", "ticker", "research_split", "date", F.col("s.side").alias("side"), (F.col("s.sign") * F.col("shares")).alias("quantity"), F.col("s.price").alias("price"), "volume")
    q, p, v = F.col("quantity"), F.col("price"), F.col("volume")
    cost = commission(q, scenario) + bps_of(q, p, scenario.half_spread_bps) + bps_of(q, p, scenario.slippage_bps) + impact(q, p, v, scenario) + F.when(F.col("side") == "entry", scenario.research).otherwise(0.0)
    return out.withColumn("cost", cost)


def daily_pnl(marked: DataFrame, filled: DataFrame, scenario: Scenario) -> DataFrame:
    """Profit, exposures, borrow and turnover of each (split, date)."""
    side = lambda sign, c: F.sum(F.when(F.col("direction") == sign, c).otherwise(0.0))
    day = marked.groupBy("research_split", "date").agg(F.sum("pnl").alias("gross_pnl"), side(1, F.col("marked")).alias("long_exposure"), side(-1, -F.col("marked")).alias("short_exposure"), side(-1, borrow(F.col("marked"), scenario, 1)).alias("borrow"))
    traded = filled.groupBy("research_split", "date").agg(F.sum(F.abs("quantity") * F.col("price")).alias("turnover"), F.sum("cost").alias("cost"))
    both = day.join(traded, ["research_split", "date"], "left").fillna(0, ["turnover", "cost"])
    return both.withColumn("net_pnl", F.col("gross_pnl") - F.col("cost") - F.col("borrow"))


def concentration(marked: DataFrame) -> DataFrame:
    """Largest ticker's share of absolute profit in each split; null where there is none."""
    per = marked.groupBy("research_split", "ticker").agg(F.abs(F.sum("pnl")).alias("p"))
    return per.groupBy("research_split").agg(F.when(F.sum("p") > 0, F.max("p") / F.sum("p")).alias("largest_share"), F.count("*").alias("tickers"))
