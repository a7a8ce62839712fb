"""Order-dependent algorithms that no set operation expresses: folds in grouped Python, one task a group.

Each is parallel over its independent key (split, ticker, company, component);
what can be decided without the state is decided in columns before.
"""

from __future__ import annotations

import heapq
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import stage
from .costs import BPS, Scenario
from .graph import components

REASONS = ("missing_holding_path", "split_boundary", "entry_price_mismatch", "same_ticker_overlap", "portfolio_capacity", "development_calibration_not_directionally_positive", "insufficient_cost_buffer")


#: Reasons that say an event can't be evaluated, whatever the book.
STRUCTURAL = REASONS[:3]


def evaluable() -> Column:
    """Predictions that count in the evaluation: accepted or rejected for reasons of the book."""
    return F.col("rejection_reason").isNull() | ~F.col("rejection_reason").isin(*STRUCTURAL)


def capacity_book(events: DataFrame, *, capital: float, weight: float, side_limit: float, gross_limit: float, participation: float, multiple: float, slope: float, scenario: Scenario, holding: int) -> DataFrame:
    """Accept or reject events of each split in order of (entry date, |signal| descending, article_id).

    Needs research_split, ticker, article_id, entry_date, exit_date (null: no
    path), signal, reason (known without state, or null), open and volume. An
    event must earn ``multiple`` times its estimated round trip: both ways at the
    entry's open, borrow of a short over the holding, research once. Returns
    article_id, research_split, accepted, rejection_reason, notional and expected_return.
    """
    s = scenario

    def round_trip(notional: float, price: float, volume: float, direction: int) -> float:
        shares = notional / price
        value = abs(shares * price)
        part = min(abs(shares) / volume, s.participation)
        way = (max(s.minimum, abs(shares) * s.per_share) if shares else 0.0) + value * (s.half_spread_bps + s.slippage_bps) / BPS + value * s.impact * part * part
        return 2 * way + (notional * s.borrow_rate * holding / 252.0 if direction < 0 else 0.0) + s.research

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(size=group.signal.abs()).sort_values(["entry_date", "size", "article_id"], ascending=[True, False, True])
        active, out = [], []
        for row in group.itertuples(index=False):
            active = [t for t in active if t[0] >= row.entry_date]
            direction, reason, notional = (1 if row.signal > 0 else -1), row.reason, 0.0
            if not isinstance(reason, str):
                reason = None
                if any(t[1] == row.ticker for t in active):
                    reason = "same_ticker_overlap"
                else:
                    side = sum(t[3] for t in active if t[2] == direction)
                    gross = sum(t[3] for t in active)
                    notional = max(0.0, min(weight * capital, side_limit * capital - side, gross_limit * capital - gross, row.volume * row.open * participation))
                    if notional <= 0:
                        reason = "portfolio_capacity"
                    elif slope <= 0:
                        reason = "development_calibration_not_directionally_positive"
                    elif abs(row.signal * slope) * notional < multiple * round_trip(notional, row.open, row.volume, direction):
                        reason = "insufficient_cost_buffer"
            if reason is None:
                active.append((row.exit_date, row.ticker, direction, notional))
            out.append((row.article_id, row.research_split, reason is None, reason, notional if reason is None else 0.0, row.signal * slope))
        return pd.DataFrame(out, columns=["article_id", "research_split", "accepted", "rejection_reason", "notional", "expected_return"])

    need = ["research_split", "ticker", "article_id", "entry_date", "exit_date", "signal", "reason", "open", "volume"]
    return events.select(*need).groupBy("research_split").applyInPandas(run, "article_id string, research_split string, accepted boolean, rejection_reason string, notional double, expected_return double")


def balanced_pick(candidates: DataFrame, key: str, count: int) -> DataFrame:
    """Up to ``count`` rows of each key, each time from the bucket used least, then the month used least, then the smallest hash.

    A heap a (bucket, month) cell holds its rows by hash; only cells are compared at each pick.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        cells: dict[tuple[str, str], list] = {}
        for row in group.itertuples(index=False):
            cells.setdefault((row.bucket, row.month), []).append((row.hash, row.article_id))
        for cell in cells.values():
            heapq.heapify(cell)
        used_bucket, used_month, out = {}, {}, []
        while cells and len(out) < count:
            best = min(cells, key=lambda c: (used_bucket.get(c[0], 0), used_month.get(c[1], 0), cells[c][0]))
            digest, article = heapq.heappop(cells[best])
            if not cells[best]:
                del cells[best]
            used_bucket[best[0]] = used_bucket.get(best[0], 0) + 1
            used_month[best[1]] = used_month.get(best[1], 0) + 1
            out.append((group[key].iloc[0], article, best[0], best[1], len(out)))
        return pd.DataFrame(out, columns=[key, "article_id", "bucket", "month", "pick"])

    return candidates.select(key, "article_id", "bucket", "month", "hash").groupBy(key).applyInPandas(run, f"{key} string, article_id string, bucket string, month string, pick long")


def rebalance(targets: DataFrame, *, participation: float, multiple: float, scenario: Scenario) -> DataFrame:
    """Targets against inventory, a ticker at a time in order of date.

    A missing (null) target exits to zero. Fills are capped by volume; a short
    target needs a locate; a fill whose edge (a share) is below ``multiple``
    times its one-way cost is refused; what the cap cuts off is told. Returns ticker,
    date, target, filled, position, remainder and reason.
    """
    s = scenario

    def cost(quantity: float, price: float, volume: float) -> float:
        value, part = quantity * price, min(quantity / volume, s.participation)
        return max(s.minimum, quantity * s.per_share) + value * (s.half_spread_bps + s.slippage_bps) / BPS + value * s.impact * part * part

    def run(group: pd.DataFrame) -> pd.DataFrame:
        position, out = 0.0, []
        for row in group.sort_values("date").itertuples(index=False):
            target = 0.0 if pd.isna(row.target) else row.target
            want = target - position
            filled, reason = 0.0, None
            if want == 0:
                pass
            elif not (row.price > 0 and row.volume > 0):
                reason = "missing_market_data"
            elif target < 0 and not row.located:
                reason = "locate_unavailable"
            else:
                size = min(abs(want), row.volume * participation)
                if row.edge * size < multiple * cost(size, row.price, row.volume):
                    reason = "edge_below_cost"
                else:
                    filled = size if want > 0 else -size
                    reason = "volume_limit" if size < abs(want) else None
            position += filled
            out.append((row.ticker, row.date, target, filled, position, want - filled if reason == "volume_limit" else 0.0, reason))
        return pd.DataFrame(out, columns=["ticker", "date", "target", "filled", "position", "remainder", "reason"])

    return targets.groupBy("ticker").applyInPandas(run, "ticker string, date date, target double, filled double, position double, remainder double, reason string")


def leader_clusters(articles: DataFrame, edges: DataFrame, days: int | None = None) -> DataFrame:
    """First-come clusters: an article joins the smallest cluster id among representatives it matches, else becomes one.

    ``edges``: (article_id, other), matches between articles or, if these have a
    ``cell`` (the id of one of its articles) and its size ``n``, between cells; articles of
    one cell match. Those more than ``days`` apart don't. Articles of one
    connected component are walked together, components apart; cluster ids are
    hashes of their founder. A cell's matches stand once, at its first article.
    """
    if "cell" not in articles.columns:
        articles = articles.select("article_id", "ts", F.col("article_id").alias("cell"), F.lit(1).alias("n"))
    edges = stage(edges.select("article_id", "other"), "matches")
    both = edges.union(edges.select(F.col("other"), F.col("article_id"))).distinct()
    roots = components(edges.select(F.col("article_id").alias("u"), F.col("other").alias("v"))).select(F.col("node").alias("cell"), F.col("root").alias("component"))
    known = both.groupBy(F.col("article_id").alias("own")).agg(F.collect_list("other").alias("others"))
    rows = articles.select("article_id", "ts", "cell", "n").join(roots, "cell", "left").withColumns({"component": F.coalesce("component", "cell"), "own": F.when(F.col("article_id") == F.col("cell"), F.col("cell"))}).join(known, "own", "left").drop("own")
    span = None if days is None else pd.Timedelta(days=days)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        beside = {r.cell: r.others for r in group[group.others.notna()].itertuples(index=False)}
        founded: dict[str, list] = {}
        out = []
        for row in group.sort_values(["ts", "article_id"]).itertuples(index=False):
            mine = [k for c in (row.cell, *beside.get(row.cell, ())) for ts, k in founded.get(c, ()) if span is None or row.ts - ts <= span]
            cluster = min(mine) if mine else sha256(row.article_id.encode()).hexdigest()[:20]
            if not mine:
                founded.setdefault(row.cell, []).append((row.ts, cluster))
            out.append((row.article_id, cluster, not mine))
        return pd.DataFrame(out, columns=["article_id", "story_cluster_id", "representative"])

    # An article without a match or a copy is its own cluster; it needs no walk.
    alone = (F.col("n") == 1) & F.col("others").isNull()
    plain = rows.where(alone).select("article_id", F.sha2("article_id", 256).substr(1, 20).alias("story_cluster_id"), F.lit(True).alias("representative"))
    walked = rows.where(~alone).drop("n").groupBy("component").applyInPandas(run, "article_id string, story_cluster_id string, representative boolean")
    return plain.unionByName(walked)
