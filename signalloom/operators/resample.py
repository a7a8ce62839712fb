"""Bootstrap intervals: resamples as weights.

A resample is a table of (draw, entity, weight): how often an entity was drawn.
Which entity a place of a draw holds is a hash of (seed, draw, place), so any
engine draws the same and a lost task draws the same again. Statistics are
weighted aggregates by draw; rows are never repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import hashed_pick
from .metrics import TRADING_DAYS


def _slots(df: DataFrame, entity: str) -> DataFrame:
    """(entity, slot, n): entities in order; they are few beside the rows."""
    return df.select(entity).where(F.col(entity).isNotNull()).distinct().select(entity, (F.row_number().over(Window.orderBy(entity)) - 1).cast("long").alias("slot"), F.count("*").over(Window.partitionBy()).alias("n"))


def _every(draws: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long")))


def entity_weights(df: DataFrame, entity: str, *, draws: int, seed: int) -> DataFrame:
    """(draw, entity, w): as many entities as there are, drawn with replacement; none under two entities."""
    slots = _slots(df, entity)
    drawn = slots.where("n >= 2").select(_every(draws).alias("draw"), "slot", "n").select("draw", hashed_pick(seed, F.col("n"), F.col("draw"), F.col("slot")).alias("slot"))
    return drawn.groupBy("draw", "slot").agg(F.count("*").alias("w")).join(slots.select(entity, "slot"), "slot").select("draw", entity, "w")


def block_weights(df: DataFrame, entity: str, *, block: int, draws: int, seed: int, least_blocks: int = 2) -> DataFrame:
    """(draw, entity, w): blocks of consecutive entities, cut off at their number; none where there are fewer than ``least_blocks`` blocks."""
    slots = _slots(df, entity)
    blocks = slots.where(f"slot % {block} = 0 and n >= {max(block, block * least_blocks)}").select(_every(draws).alias("draw"), (F.col("slot") / block).cast("long").alias("b"), "n")
    start = hashed_pick(seed, F.col("n") - block + 1, F.col("draw"), F.col("b"))
    cells = blocks.withColumn("start", start).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(block - 1)))).where(F.col("b") * block + F.col("j") < F.col("n"))
    drawn = cells.groupBy("draw", (F.col("start") + F.col("j")).alias("slot")).agg(F.count("*").alias("w"))
    return drawn.join(slots.select(entity, "slot"), "slot").select("draw", entity, "w")


def weighted_rank(df: DataFrame, value: str, out: str, *keys: str) -> DataFrame:
    """Average ranks of ``value`` where each row stands ``w`` times; the ordered window holds one row a value."""
    values = df.groupBy(*keys, value).agg(F.sum("w").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy(value))
    return df.join(values.withColumn(out, upto - (F.col("_n") - 1) / 2.0).drop("_n"), [*keys, value])


def weighted_correlation(x: Column, y: Column) -> Column:
    """Pearson correlation of rows that stand ``w`` times; null under three of them or where a side is constant."""
    n = F.sum("w")
    mean = lambda c: F.sum(F.col("w") * c) / n
    vx, vy = mean(x * x) - mean(x) * mean(x), mean(y * y) - mean(y) * mean(y)
    return F.when((n >= 3) & (vx > 1e-18) & (vy > 1e-18), (mean(x * y) - mean(x) * mean(y)) / F.sqrt(vx * vy))


def intervals(stats: DataFrame, *names: str) -> DataFrame:
    """statistic, lower_95, upper_95 and draws (those in which it is defined) of columns of one row a draw; nulls where no draw defines it."""
    made = stats.agg(*(F.struct(F.percentile(c, 0.025).alias("lower_95"), F.percentile(c, 0.975).alias("upper_95"), F.count(c).alias("draws")).alias(c) for c in names))
    return made.select(F.explode(F.array(*(F.struct(F.lit(c).alias("statistic"), f"{c}.*") for c in names))).alias("r")).select("r.*")


def mean_interval(df: DataFrame, value: str, entity: str, *, draws: int = 200, seed: int = 12345) -> DataFrame:
    """95% interval of the mean of entity means under resampling of entities."""
    means = df.where(F.col(value).isNotNull()).groupBy(entity).agg(F.avg(value).alias("m"))
    stat = means.join(entity_weights(means, entity, draws=draws, seed=seed), entity).groupBy("draw").agg((F.sum(F.col("w") * F.col("m")) / F.sum("w")).alias("stat"))
    return intervals(stat, "stat").drop("statistic")


def _associations(rows: DataFrame, signal: str, ret: str, tag: str = "") -> DataFrame:
    """draw, pearson and spearman of weighted rows."""
    pairs = rows.select("draw", "w", F.col(signal).alias("_x"), F.col(ret).alias("_y"))
    half = pairs.groupBy("draw").agg((F.sum("w") / 2).alias("_half"))
    ranked = weighted_rank(weighted_rank(pairs, "_x", "_rx", "draw"), "_y", "_ry", "draw").join(F.broadcast(half), "draw")
    # Ranks are taken from the middle, so that squares stay small.
    return ranked.groupBy("draw").agg(weighted_correlation(F.col("_x"), F.col("_y")).alias(f"{tag}pearson_ic"), weighted_correlation(F.col("_rx") - F.col("_half"), F.col("_ry") - F.col("_half")).alias(f"{tag}spearman_ic"))


def company_intervals(df: DataFrame, *, score: str, weighted: str, ret: str, label: str, entity: str, draws: int, seed: int) -> DataFrame:
    """Intervals of five statistics under resampling of companies: plain and weighted correlations, and the spread of returns between labels."""
    rows = df.where(F.col(ret).isNotNull() & F.col(score).isNotNull()).select(entity, score, weighted, ret, label)
    rows = rows.join(entity_weights(rows, entity, draws=draws, seed=seed), entity)
    mean = lambda name: F.try_divide(F.sum(F.when(F.col(label) == name, F.col("w") * F.col(ret))), F.sum(F.when(F.col(label) == name, F.col("w"))))
    spread = rows.groupBy("draw").agg((mean("bullish") - mean("bearish")).alias("bullish_minus_bearish_spread"))
    stats = spread.join(_associations(rows, score, ret), "draw").join(_associations(rows, weighted, ret, "weighted_"), "draw")
    return intervals(stats, "pearson_ic", "spearman_ic", "weighted_pearson_ic", "weighted_spearman_ic", "bullish_minus_bearish_spread")


def date_block_intervals(df: DataFrame, *, signal: str, ret: str, date: str, horizon: int, draws: int, seed: int) -> DataFrame:
    """Intervals of correlations and signed return under resampling of blocks of dates as long as the horizon, five at least."""
    rows = df.where(F.col(ret).isNotNull() & F.col(signal).isNotNull()).select(date, signal, ret)
    rows = rows.join(block_weights(rows, date, block=max(5, horizon), draws=draws, seed=seed), date)
    signed = rows.groupBy("draw").agg((F.sum(F.col("w") * F.signum(signal) * F.col(ret)) / F.sum("w")).alias("signed_return"))
    return intervals(signed.join(_associations(rows, signal, ret), "draw"), "pearson_ic", "spearman_ic", "signed_return")


def block_sharpe_interval(daily: DataFrame, ret: str, *, block: int = 5, draws: int = 200, seed: int = 12345, days: int = TRADING_DAYS) -> DataFrame:
    """95% interval of the Sharpe ratio under resampling of blocks of consecutive sessions; draws without deviation are left out."""
    rows = daily.select("date", F.col(ret).alias("r"))
    rows = rows.join(block_weights(rows, "date", block=block, draws=draws, seed=seed, least_blocks=1), "date")
    n, mean = F.sum("w"), F.sum(F.col("w") * F.col("r")) / F.sum("w")
    var = (F.sum(F.col("w") * F.col("r") * F.col("r")) - n * mean * mean) / (n - 1)
    stat = rows.groupBy("draw").agg(F.when((n >= 2) & (var > 1e-24), mean / F.sqrt(var) * F.sqrt(F.lit(float(days)))).alias("stat"))
    return intervals(stat, "stat").drop("statistic")
