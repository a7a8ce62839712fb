"""Signals: products of scores, development-fitted scaling, company-day aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Name of each rung: the scores it multiplies.
LADDER = {"raw": ("score",), "confidence": ("score", "confidence"), "weighted": ("score", "confidence", "materiality"), "novel": ("score", "confidence", "materiality", "novelty")}


def signal(name: str) -> Column:
    """A rung of the ladder; an unknown name is an error."""
    if name not in LADDER:
        raise ValueError(f"unknown signal: {name}")
    first, *rest = LADDER[name]
    out = F.col(first)
    for c in rest:
        out = out * F.col(c)
    return out


def with_ladder(df: DataFrame) -> DataFrame:
    return df.withColumns({f"signal_{name}": signal(name) for name in LADDER})


def label_of(score: Column) -> Column:
    """bullish above 0.25, bearish below -0.25, else neutral."""
    return F.when(score > 0.25, "bullish").when(score < -0.25, "bearish").otherwise("neutral")


def realised_class(ret: Column, band: float) -> Column:
    return F.when(ret > band, "bullish").when(ret < -band, "bearish").otherwise("neutral")


def half_open(value: Column, cuts: list[float]) -> Column:
    """Label of the half-open interval that holds a value."""
    edges = [f"{c:.2f}" for c in cuts]
    out = F.lit(f">={edges[-1]}")
    for i in range(len(cuts) - 1, -1, -1):
        name = f"<{edges[i]}" if i == 0 else f"{edges[i - 1]}-{edges[i]}"
        out = F.when(value < cuts[i], name).otherwise(out)
    return F.when(value.isNotNull(), out)


def standardise(df: DataFrame, column: str, out: str) -> DataFrame:
    """z-score by mean and sample deviation of the development split; a deviation that isn't positive counts as 1."""
    fitted = df.where(F.col("research_split") == "development").agg(F.avg(column).alias("_mean"), F.stddev_samp(column).alias("_std"))
    scaled = (F.col(column) - F.col("_mean")) / F.when(F.col("_std") > 0, F.col("_std")).otherwise(1.0)
    return df.crossJoin(F.broadcast(fitted)).withColumn(out, scaled).drop("_mean", "_std")


def surprise(df: DataFrame, direction: str, reference: str) -> DataFrame:
    """Residual features of a direction score against a reference score; all zero on abstention."""
    z = standardise(standardise(df, direction, "_d"), reference, "_r")
    residual = F.col("_d") - F.col("_r")
    made = {"llm_z": F.col("_d"), "reference_z": F.col("_r"), "residual": residual, "residual_size": F.abs(residual), "event_surprise_signal": residual * F.col("relevance") * F.col("materiality") * F.col("novelty") * F.col("confidence")}
    return z.withColumns({k: F.when(F.col("abstain"), 0.0).otherwise(v) for k, v in made.items()}).drop("_d", "_r")


def strongest(df: DataFrame, by: str, *keys: str) -> DataFrame:
    """The row of each key with the largest absolute value; ties go to the smaller article_id."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(F.abs(by)), "article_id")
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def company_day(df: DataFrame) -> DataFrame:
    """One row a (split, ticker, entry date): means of signals and scores; the smallest article_id stands for the rest."""
    means = [F.avg(f"signal_{n}").alias(f"signal_{n}") for n in LADDER] + [F.avg(c).alias(c) for c in ("confidence", "relevance", "materiality")]
    first = [F.min_by(c, "article_id").alias(c) for c in ("sector", "event_type", "future_return_5d")]
    flags = [F.bool_or("tradable").alias("tradable"), F.bool_and("abstain").alias("abstain"), F.min("ts").alias("first_ts"), F.count("*").alias("n")]
    out = df.groupBy("research_split", "ticker", "entry_date").agg(*means, *first, *flags)
    return out.withColumn("label", label_of(F.col("signal_raw")))
