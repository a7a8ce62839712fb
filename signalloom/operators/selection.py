"""Greedy samples whose next pick depends on the picks before: folds over bounded groups.

Only the first few rows of a cell of equal counts can ever be picked, so each
group is cut to them by a window before the fold: no group grows with the data.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How many rows each calibration bucket asks for, in the order of the passes.
BUCKET_TARGETS = {"high_confidence_bullish": 40, "high_confidence_bearish": 40, "local_abstention": 40, "low_confidence": 40, "rare_event_type": 50, "general_calibration": 40}
RESERVED = ("earnings", "guidance")


def calibration_buckets(rare: Column, *, high: float = 0.80, low: float = 0.55) -> Column:
    """Every bucket that a row (label, confidence, abstain) belongs to, ['general_calibration'] where none; ``rare``: whether its event type is."""
    sure = F.col("confidence") >= high
    made = F.array(F.when((F.col("label") == "bullish") & sure, "high_confidence_bullish"), F.when((F.col("label") == "bearish") & sure, "high_confidence_bearish"), F.when(F.col("abstain"), "local_abstention"), F.when(F.col("confidence") < low, "low_confidence"), F.when(rare, "rare_event_type"))
    found = F.filter(made, lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("general_calibration")))


def rare_types(df: DataFrame, column: str, least: int = 50) -> DataFrame:
    """The values of ``column`` that fewer than ``least`` rows and less than one in a hundred hold."""
    counts = df.groupBy(column).agg(F.count("*").alias("_n")).withColumn("_all", F.sum("_n").over(Window.partitionBy()))
    return counts.where(F.col("_n") < F.greatest(F.lit(least), F.floor(F.col("_all") / 100))).select(column)


def _first_of(df: DataFrame, count: int, *cell: str) -> DataFrame:
    """The first ``count`` rows of each cell by (score descending, hash, article_id)."""
    w = Window.partitionBy(*cell).orderBy(F.desc("score"), "hash", "article_id")
    return df.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= count).drop("_nth")


def _best(rows: list, key) -> int:
    return min(range(len(rows)), key=lambda i: key(rows[i]))


def yearly_pick(candidates: DataFrame, *, count: int, reserve: int) -> DataFrame:
    """Up to ``count`` rows of each (ticker, year).

    First the ``reserve`` best of earnings and guidance; then each time a named
    event type before 'other', the type picked least, the quarter picked least,
    the best score, the smallest hash. Needs ticker, article_id, ts, event_type,
    score and hash.
    """
    rows = candidates.withColumns({"year": F.year("ts"), "quarter": F.quarter("ts")}).select("ticker", "year", "quarter", "article_id", "event_type", "score", "hash")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        left = sorted(group.itertuples(index=False), key=lambda r: (-r.score, r.hash, r.article_id))
        taken = [r for r in left if r.event_type in RESERVED][: min(reserve, count)]
        chosen = {r.article_id for r in taken}
        left = [r for r in left if r.article_id not in chosen]
        types, quarters = Counter(r.event_type for r in taken), Counter(r.quarter for r in taken)
        while left and len(taken) < count:
            r = left.pop(_best(left, lambda r: (r.event_type == "other", types[r.event_type], quarters[r.quarter], -r.score, r.hash, r.article_id)))
            taken.append(r)
            types[r.event_type] += 1
            quarters[r.quarter] += 1
        return pd.DataFrame([(r.ticker, r.year, r.article_id, i) for i, r in enumerate(taken)], columns=["ticker", "year", "article_id", "pick"])

    return _first_of(rows, count, "ticker", "year", "event_type", "quarter").groupBy("ticker", "year").applyInPandas(run, "ticker string, year int, article_id string, pick int")


def backfill_pick(candidates: DataFrame, selected: DataFrame, *, total: int) -> DataFrame:
    """Rows that fill each ticker's selection up to ``total``: each time the year held least, named types, the type held least, the best score."""
    columns = ["ticker", "year", "article_id", "event_type", "score", "hash"]
    rows = candidates.withColumn("year", F.year("ts")).select(*columns)
    held = rows.join(selected.select("article_id"), "article_id", "left_semi").select(*columns)
    rest = _first_of(rows.join(selected.select("article_id"), "article_id", "left_anti").select(*columns), total, "ticker", "year", "event_type")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        have = [r for r in group.itertuples(index=False) if r.held]
        left = [r for r in group.itertuples(index=False) if not r.held]
        years, types, out = Counter(r.year for r in have), Counter(r.event_type for r in have), []
        while left and len(have) + len(out) < total:
            r = left.pop(_best(left, lambda r: (years[r.year], r.event_type == "other", types[r.event_type], -r.score, r.hash, r.article_id)))
            out.append(r)
            years[r.year] += 1
            types[r.event_type] += 1
        return pd.DataFrame([(r.ticker, r.article_id, i) for i, r in enumerate(out)], columns=["ticker", "article_id", "pick"])

    both = held.withColumn("held", F.lit(True)).unionByName(rest.withColumn("held", F.lit(False)))
    return both.groupBy("ticker").applyInPandas(run, "ticker string, article_id string, pick int")


def quota_sample(candidates: DataFrame, *, most: int, per_ticker: int, per_sector: int, targets: dict[str, int] = BUCKET_TARGETS) -> DataFrame:
    """A sample by buckets with caps a ticker and a sector over all of it, then filled up in order of rank.

    Needs article_id, ticker, sector, buckets (array) and rank; rows in no other
    bucket than the general one come last. The caps span tickers, so the fold is
    one task; it gets 2 * per_ticker rows a ticker and bucket at most, as a
    ticker's later rows can't be reached before its cap.
    """
    general = (F.size("buckets") == 1) & (F.element_at("buckets", 1) == "general_calibration")
    rows = candidates.select("article_id", "ticker", "sector", "buckets", "rank", general.alias("last"))
    order = ("last", "rank", "article_id")
    nth = lambda *cell: F.row_number().over(Window.partitionBy(*cell).orderBy(*order))
    by_bucket = rows.withColumn("bucket", F.explode("buckets")).withColumn("_n", nth("ticker", "bucket")).where(F.col("_n") <= 2 * per_ticker).drop("_n", "bucket")
    by_ticker = rows.withColumn("_n", nth("ticker")).where(F.col("_n") <= 2 * per_ticker).drop("_n")
    few = by_bucket.unionByName(by_ticker).dropDuplicates(["article_id"])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        left = sorted(group.itertuples(index=False), key=lambda r: (r.last, r.rank, r.article_id))
        taken: dict[str, str] = {}
        tickers, sectors, held = Counter(), Counter(), Counter()
        for name, target in [*targets.items(), ("fill", most)]:
            for r in left:
                if len(taken) >= most or held[name] >= target:
                    break
                if (name == "fill" or name in r.buckets) and r.article_id not in taken and tickers[r.ticker] < per_ticker and sectors[r.sector] < per_sector:
                    taken[r.article_id] = name
                    tickers[r.ticker] += 1
                    sectors[r.sector] += 1
                    held.update(r.buckets)
        return pd.DataFrame([(a, p, i) for i, (a, p) in enumerate(taken.items())], columns=["article_id", "picked_for", "pick"])

    return few.groupBy().applyInPandas(run, "article_id string, picked_for string, pick int")


def sample_contract(sample: DataFrame, *, size: int, least_reserved: int, most_other: float, least_years: int) -> dict[str, Column]:
    """Conditions of a finished sample (article_id, cluster_id, ticker, event_type, ts) as aggregates over one row a ticker; null counts as failed."""
    return {"size": F.sum("n") == size, "unique_ids": F.sum("n") == F.sum("ids"), "unique_clusters": F.sum("n") == F.sum("clusters"), "reserved": F.sum("reserved") >= least_reserved, "other": F.sum("other") <= most_other * F.sum("n"), "years": F.min("years") >= least_years}


def check_sample(sample: DataFrame, **limits) -> DataFrame:
    """One row: whether a finished sample keeps each of its conditions."""
    per = sample.groupBy("ticker").agg(F.count("*").alias("n"), F.count_distinct("article_id").alias("ids"), F.count_distinct("cluster_id").alias("clusters"), F.count(F.when(F.col("event_type").isin(*RESERVED), 1)).alias("reserved"), F.count(F.when(F.col("event_type") == "other", 1)).alias("other"), F.count_distinct(F.year("ts")).alias("years"))
    return per.agg(*(F.coalesce(ok, F.lit(False)).alias(k) for k, ok in sample_contract(sample, **limits).items()))
