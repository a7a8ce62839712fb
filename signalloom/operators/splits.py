"""Chronological splits, purging, walk-forward folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chronological_index(df: DataFrame, ts: str, *ties: str) -> DataFrame:
    """``chronological_index``, 0-based rank over (ts, *ties), and ``_total``, the number of rows.

    Ranked within days, plus the number of rows of earlier days: the only
    unpartitioned window is over one row a day.
    """
    day = F.to_date(ts)
    counts = df.groupBy(day.alias("_day")).agg(F.count("*").alias("_n"))
    before = counts.select("_day", (F.sum("_n").over(Window.orderBy("_day")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    ranked = df.withColumn("_day", day).withColumn("_nth", F.row_number().over(Window.partitionBy("_day").orderBy(ts, *ties)) - 1)
    return ranked.join(before, "_day").withColumn("chronological_index", F.col("_before") + F.col("_nth")).drop("_day", "_nth", "_before")


def assign_splits(df: DataFrame, ts: str, *ties: str, development: int = 60, validation: int = 20) -> DataFrame:
    """``research_split``: first ``development`` percent, next ``validation`` percent, the rest holdout."""
    ranked = chronological_index(df, ts, *ties)
    place = F.col("chronological_index") * 100
    name = F.when(place < F.col("_total") * development, "development").when(place < F.col("_total") * (development + validation), "validation").otherwise("holdout")
    return ranked.withColumn("research_split", name).drop("_total")


def next_boundary(df: DataFrame) -> DataFrame:
    """``next_split_entry_date``: first entry of the following split; null for the last."""
    first = lambda s: F.min(F.when(F.col("research_split") == s, F.col("entry_date")))
    starts = df.agg(first("validation").alias("_v"), first("holdout").alias("_h"))
    boundary = F.when(F.col("research_split") == "development", F.col("_v")).when(F.col("research_split") == "validation", F.col("_h"))
    return df.crossJoin(F.broadcast(starts)).withColumn("next_split_entry_date", boundary).drop("_v", "_h")


def unpurged(horizon: int) -> Column:
    """Rows whose outcome window ends strictly before the next split begins."""
    return F.col("next_split_entry_date").isNull() | (F.col(f"exit_date_{horizon}d") < F.col("next_split_entry_date"))


def walk_forward(df: DataFrame, ts: str, end: str, *ties: str, folds: int, embargo_days: int) -> DataFrame:
    """One row a fold after the first: bounds of its validation rows, how many there are, how many earlier rows may teach it.

    Rows are ordered by ``ts``; a fold has floor(n / folds) rows and the last
    takes the remainder. Training rows come before the fold and end before it
    starts. The embargo's end is told, not applied.
    """
    ranked = chronological_index(df, ts, *ties)
    size = F.floor(F.col("_total") / folds)
    placed = ranked.withColumn("fold", F.least(F.floor(F.col("chronological_index") / size), F.lit(folds - 1)).cast("int"))
    bounds = placed.groupBy("fold").agg(F.min(ts).alias("validation_start"), F.max(ts).alias("validation_end"), F.count("*").alias("n_validation")).where("fold > 0")
    # A row teaches every later fold that starts after its end: folds are few, so they are the broadcast side.
    teach = placed.select(F.col("fold").alias("_own"), F.col(end).alias("_end")).join(F.broadcast(bounds.select("fold", "validation_start")), (F.col("_own") < F.col("fold")) & (F.col("_end") < F.col("validation_start")))
    counts = teach.groupBy("fold").agg(F.count("*").alias("n_train"))
    out = bounds.join(counts, "fold", "left").fillna(0, ["n_train"])
    return out.withColumn("embargo_end", F.col("validation_end") + F.expr(f"interval {embargo_days} days"))
