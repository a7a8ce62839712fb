"""Specification search: every combination of signal, aggregation and thresholds, from one row an event."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import correlation_p
from ..staging import stage
from . import splits
from .metrics import benjamini_hochberg, correlation

AGGREGATIONS = ("event_level", "strongest_company_day", "company_day_aggregate")
HORIZONS = (5, 21)


@dataclass(frozen=True)
class Grid:
    """What is searched; ``least_n`` and ``least_coverage`` are the gates of a candidate."""

    signals: tuple[str, ...] = ("signal_raw", "signal_confidence", "signal_weighted", "signal_novel")
    aggregations: tuple[str, ...] = AGGREGATIONS
    confidence: tuple[float, ...] = (0.0, 0.5, 0.7)
    relevance: tuple[float, ...] = (0.0, 0.5, 0.7)
    materiality: tuple[float, ...] = (0.0, 0.25, 0.5)
    least_n: int = 100
    least_coverage: float = 0.25


#: Rows of a series that one task holds (under 100 bytes each); the ranks of splits with a longer one are windows, which spill.
HELD = 6_000_000


def _cells(grid: Grid) -> list[tuple[int, int, int]]:
    """Places of the thresholds (ci, ri, mi), the last running fastest."""
    return list(product(range(len(grid.confidence)), range(len(grid.relevance)), range(len(grid.materiality))))


def _mask(grid: Grid, cells: Sequence[tuple[int, int, int]]) -> Column:
    """Bit i is set where a row meets the thresholds of cell i."""
    out = F.lit(0).cast("long")
    for i, (c, r, m) in enumerate(cells):
        met = (F.col("confidence") >= grid.confidence[c]) & (F.col("relevance") >= grid.relevance[r]) & (F.col("materiality") >= grid.materiality[m])
        out = out.bitwiseOR(F.when(met, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def _runs(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1]))


def _company_days(table: pa.Table, signals: int, cells: int) -> pa.Table:
    """Items of whole company-days, which stand together, each in order of article_id; see ``items``."""
    n, keys = len(table), [table[c].combine_chunks() for c in ("research_split", "ticker", "entry_date")]
    new = np.append(True, np.zeros(n - 1, bool))
    for k in keys:
        x, y = k[1:], k[:-1]
        new[1:] |= pc.if_else(pc.and_(x.is_null(), y.is_null()), False, pc.fill_null(pc.not_equal(x, y), True)).to_numpy(zero_copy_only=False)
    group = np.cumsum(new) - 1
    alone = np.bincount(group)[group] == 1
    mask = table["mask"].to_numpy()
    xs = [table[f"x{s}"].to_numpy() for s in range(signals)]
    given = [table[f"x{s}"].is_valid().to_numpy() for s in range(signals)]
    size = [np.where(g, np.where(np.isnan(x), np.inf, np.abs(x)), -1.0) for x, g in zip(xs, given, strict=True)]
    strong, found = [np.where(alone, mask, 0) for _ in xs], []
    shared = np.flatnonzero(~alone)
    for c in range(cells):
        rows = shared[(mask[shared] >> c) & 1 == 1]
        if not len(rows):
            continue
        start = _runs(group[rows])
        at = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(rows))))
        means = {}
        for s in range(signals):
            a = size[s][rows]
            hit = np.flatnonzero(a == np.maximum.reduceat(a, start)[at])
            strong[s][rows[hit[_runs(at[hit])]]] |= 1 << c
            with np.errstate(invalid="ignore", divide="ignore"):
                count = np.add.reduceat(given[s][rows].astype("int64"), start)
                # One after the other, as reduceat doesn't add: equal sums must tie.
                means[f"x{s}"] = np.bincount(at, np.where(given[s][rows], xs[s][rows], 0.0)) / count
            means[f"given{s}"] = count > 0
        found.append(pd.DataFrame({"first": rows[start], **means, "mask": 1 << c}))
    own = table.drop_columns(["ticker", "entry_date", "mask"])
    out = own.append_column("event", pa.array(mask))
    for s in range(signals):
        out = out.append_column(f"strongest{s}", pa.array(strong[s]))
    out = out.append_column("mean", pa.array(np.where(alone, mask, 0)))
    if not found:
        return out
    # Cells that the same articles meet have the same means: they are one item.
    by = [c for c in found[0].columns if c != "mask"]
    means = pd.concat(found).groupby(by, dropna=False, sort=False, as_index=False)["mask"].sum()
    more = own.take(pa.array(means["first"].to_numpy()))
    for s in range(signals):
        more = more.set_column(more.column_names.index(f"x{s}"), f"x{s}", pa.array(means[f"x{s}"].to_numpy(), mask=~means[f"given{s}"].to_numpy()))
    none = pa.array(np.zeros(len(means), "int64"))
    for name in ("event", *(f"strongest{s}" for s in range(signals))):
        more = more.append_column(name, none)
    return pa.concat_tables([out, more.append_column("mean", pa.array(means["mask"].to_numpy()))])


def items(events: DataFrame, grid: Grid, cells: Sequence[tuple[int, int, int]]) -> DataFrame:
    """One row an event, and one for each set of articles of a company-day that meet the same thresholds together.

    research_split, y of each horizon (null where purged), x of each signal, and
    the cells in which the row counts, as bits: ``event``, ``strongest`` of each
    signal, ``mean``. One shuffle by company-day; an event never stands once a
    combination.
    """
    signals, ys = len(grid.signals), [f"y{h}" for h in HORIZONS]
    rows = events.where("tradable and not abstain and research_split <> 'holdout'")
    rows = rows.select("research_split", "ticker", "entry_date", "article_id", *(F.when(splits.unpurged(h), F.col(f"future_return_{h}d")).cast("double").alias(f"y{h}") for h in HORIZONS), *(F.col(c).cast("double").alias(f"x{s}") for s, c in enumerate(grid.signals)), _mask(grid, cells).alias("mask")).where("mask <> 0")
    day = ("research_split", "ticker", "entry_date")
    placed = rows.repartition(*day).sortWithinPartitions(*day, "article_id").drop("article_id")
    masks = ["event", *(f"strongest{s}" for s in range(signals)), "mean"]
    schema = ", ".join(["research_split string", *(f"{y} double" for y in ys), *(f"x{s} double" for s in range(signals)), *(f"{m} long" for m in masks)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, least = [], 100_000

        def whole(table: pa.Table) -> Iterator[pa.RecordBatch]:
            yield from _company_days(table.combine_chunks(), signals, len(cells)).to_batches()

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < least:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            last, n = table.slice(len(table) - 1).to_pylist()[0], len(table)
            # The last company-day may go on in the next batch.
            same = np.ones(n, bool)
            for k in day:
                same &= (table[k].is_null() if last[k] is None else pc.fill_null(pc.equal(table[k], pa.scalar(last[k], table[k].type)), False)).to_numpy()
            cut = int(np.flatnonzero(same)[0])
            if cut:
                yield from whole(table.slice(0, cut))
            held, least = table.slice(cut).to_batches(), max(100_000, 2 * (n - cut))
        if sum(map(len, held)):
            yield from whole(pa.Table.from_batches(held))

    return placed.mapInArrow(run, schema)


def _correlations(x: np.ndarray, y: np.ndarray, mask: np.ndarray, cells: int) -> list[tuple]:
    """(cell, n, ic, signed return) of each cell that any row counts in; average ranks of ties within the cell."""
    own, places = np.sign(x) * y, [np.unique(v, return_inverse=True)[1].astype("int32") for v in (x, y)]
    out = []
    for c in range(cells):
        at = np.flatnonzero((mask >> c) & 1)
        n, ranks = len(at), []
        if not n:
            continue
        for p in places:
            count = np.bincount(p[at])
            ranks.append((np.cumsum(count) - (count - 1) / 2 - (n + 1) / 2)[p[at]])
        a, b = ranks
        spread = np.sqrt(a @ a) * np.sqrt(b @ b)
        out.append((c, n, float(np.clip(a @ b / spread, -1, 1)) if n >= 3 and spread > 0 else None, float(own[at].mean())))
    return out


def associations(events: DataFrame, grid: Grid, held: int = HELD) -> DataFrame:
    """(spec_id, research_split, horizon, n, ic, p, signed_return) of every combination that any row meets.

    A series is a signal, an aggregation, a split and a horizon. One task sorts
    a series once and reads the ranks within every threshold cell off it; where a
    series of a split may be longer than ``held``, its ranks are windows over exploded cells.
    """
    out, every = None, _cells(grid)
    for base in range(0, len(every), 62):  # a mask is one long
        part = _part(events, grid, every[base : base + 62], base, held)
        out = part if out is None else out.unionByName(part)
    return out.withColumns({"p": correlation_p("ic", "n"), "signed_return": F.when(F.col("ic").isNotNull(), F.col("signed_return"))})


def _part(events: DataFrame, grid: Grid, cells: Sequence[tuple[int, int, int]], base: int, held: int) -> DataFrame:
    rows, signals, total = stage(items(events, grid, cells), "items"), len(grid.signals), len(_cells(grid))
    longest = F.greatest(F.count(F.when(F.col("event") != 0, 1)), F.count(F.when(F.col("mean") != 0, 1)))
    size = dict(map(tuple, rows.groupBy("research_split").agg(longest).collect()))
    names = sorted(size)
    named = {"event_level": ["event"] * signals, "strongest_company_day": [f"strongest{s}" for s in range(signals)], "company_day_aggregate": ["mean"] * signals}
    series = [(s, a, h) for s in range(signals) for a in range(len(grid.aggregations)) for h in HORIZONS]
    split = F.coalesce(*(F.when(F.col("research_split") == name, i) for i, name in enumerate(names)), F.lit(0))
    made = [F.struct((split * len(series) + i).alias("series"), F.col(f"x{s}").alias("x"), F.col(f"y{h}").alias("y"), F.col(named[grid.aggregations[a]][s]).alias("mask")) for i, (s, a, h) in enumerate(series)]

    def spread(these: list[str]) -> DataFrame:
        return rows.where(F.col("research_split").isin(these)).select(F.inline(F.array(*made))).where("mask <> 0 and x is not null and y is not null")

    def run(table: pa.Table) -> pa.Table:
        found = _correlations(*(table[c].to_numpy() for c in ("x", "y", "mask")), len(cells))
        columns = list(zip(*found, strict=True)) or [(), (), (), ()]
        return pa.table({"series": pa.array([table["series"][0].as_py()] * len(found), "int32"), **{k: pa.array(v, t) for k, v, t in zip(("cell", "n", "ic", "signed_return"), columns, ("int32", "int64", "float64", "float64"), strict=True)}})

    def windowed(df: DataFrame) -> DataFrame:
        long = df.select("series", "x", "y", F.explode(F.filter(F.sequence(F.lit(0), F.lit(len(cells) - 1)), lambda i: F.getbit(F.col("mask"), i) == 1)).alias("cell"))

        def rank(c: str) -> Column:
            w = Window.partitionBy("series", "cell").orderBy(c)
            return (F.rank().over(w) + F.count("*").over(w)) / 2.0  # the count reaches to the last of equal values

        ranked = long.withColumns({"rx": rank("x")}).withColumns({"ry": rank("y")})
        return ranked.groupBy("series", "cell").agg(F.count("*").alias("n"), correlation(F.col("rx"), F.col("ry")).alias("ic"), F.avg(F.signum("x") * F.col("y")).alias("signed_return"))

    found = spread([k for k in names if size[k] <= held]).groupBy("series").applyInArrow(run, "series int, cell int, n long, ic double, signed_return double")
    if large := [k for k in names if size[k] > held]:
        found = found.unionByName(windowed(spread(large)))
    at = F.floor(F.col("series") % len(series) / len(HORIZONS))  # signal and aggregation
    place = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    return found.select((at * total + base + F.col("cell")).cast("long").alias("spec_id"), place(names or [""], F.floor(F.col("series") / len(series))).alias("research_split"), place(HORIZONS, F.col("series") % len(HORIZONS)).alias("horizon"), "n", "ic", "signed_return")


def search(events: DataFrame, grid: Grid = Grid()) -> DataFrame:  # noqa: B008
    """Every candidate with its measures, q-value, gates, and which one is selected; holdout rows are never read.

    Utility weighs mean validation and development correlations, signed return
    and coverage, and is cut where not all four correlations are positive. The
    selected one is the eligible candidate of most utility, of equal ones the
    first; its neighbours differ by one step of one threshold.
    """
    spark = events.sparkSession
    total = events.where("research_split = 'validation'").agg(F.count("*").alias("total"))
    at = lambda split, h, c: F.max(F.when((F.col("research_split") == split) & (F.col("horizon") == h), F.col(c)))
    short = {"development": "dev", "validation": "val"}
    wide = associations(events, grid).groupBy("spec_id").agg(*(at(s, h, c).alias(f"{short[s]}_{c}_{h}d") for s in short for h in HORIZONS for c in ("n", "ic", "p", "signed_return")))
    shape = [len(grid.signals), len(grid.aggregations), len(grid.confidence), len(grid.relevance), len(grid.materiality)]
    size = 1
    for k in shape:
        size *= k
    place = lambda values, below, n: F.element_at(F.array(*map(F.lit, values)), (F.floor(F.col("spec_id") / below) % n + 1).cast("int"))
    below = [size // shape[0], size // shape[0] // shape[1], shape[3] * shape[4], shape[4], 1]
    named = spark.range(size).withColumnRenamed("id", "spec_id").join(F.broadcast(wide), "spec_id", "left").join(F.broadcast(total))
    for name, values, b, n in zip(("signal", "aggregation", "minimum_confidence", "minimum_relevance", "minimum_materiality"), (grid.signals, grid.aggregations, grid.confidence, grid.relevance, grid.materiality), below, shape, strict=True):
        named = named.withColumn(name, place(values, b, n))
    mean = lambda a, b: (F.col(a) + F.col(b)) / 2
    ics = [F.col(f"{s}_ic_{h}d") for s in ("val", "dev") for h in HORIZONS]
    consistent = F.coalesce(ics[0] > 0, F.lit(False))
    for c in ics[1:]:
        consistent = consistent & F.coalesce(c > 0, F.lit(False))
    n = F.least(*(F.coalesce(f"val_n_{h}d", F.lit(0)) for h in HORIZONS))
    named = named.withColumns({"n": n, "coverage": F.coalesce(F.try_divide(n, F.col("total")), F.lit(0.0)), "consistent": consistent})
    utility = 0.45 * mean("val_ic_5d", "val_ic_21d") + 0.25 * mean("dev_ic_5d", "dev_ic_21d") + 20 * mean("val_signed_return_5d", "val_signed_return_21d") + 0.10 * F.col("coverage") - F.when(F.col("consistent"), 0.0).otherwise(0.25)
    combined = F.when(F.col("val_p_5d").isNotNull() & F.col("val_p_21d").isNotNull(), F.least(F.lit(1.0), 2 * F.least("val_p_5d", "val_p_21d")))
    named = named.withColumns({"utility": utility, "p": combined}).drop("total")
    out = benjamini_hochberg(named, "p")
    out = out.withColumn("eligible", F.col("utility").isNotNull() & (F.col("coverage") >= grid.least_coverage) & (F.col("n") >= grid.least_n))
    best = out.where("eligible").agg(F.max_by("spec_id", F.struct("utility", -F.col("spec_id"))).alias("best"))
    step = lambda b, m: F.abs(F.floor(F.col("spec_id") / b) % m - F.floor(F.col("best") / b) % m)
    out = out.join(F.broadcast(best))
    near = (step(below[1], shape[0] * shape[1]) == 0) & (step(below[2], shape[2]) + step(below[3], shape[3]) + step(below[4], shape[4]) == 1)
    return out.withColumns({"selected": F.coalesce(F.col("spec_id") == F.col("best"), F.lit(False)), "neighbour": F.coalesce(near & F.col("eligible"), F.lit(False)), "neighbour_positive": F.coalesce(near & F.col("eligible") & (F.col("val_ic_5d") > 0) & (F.col("val_ic_21d") > 0), F.lit(False))}).drop("best")


def neighbourhood(candidates: DataFrame) -> DataFrame:
    """One row: how many neighbours the selected candidate has and which share of them is positive."""
    count = F.count(F.when(F.col("neighbour"), 1))
    return candidates.agg(F.max(F.when(F.col("selected"), F.col("spec_id"))).alias("spec_id"), count.alias("nearby_candidate_count"), F.coalesce(F.try_divide(F.count(F.when(F.col("neighbour_positive"), 1)), count), F.lit(0.0)).alias("nearby_positive_fraction"))


def portfolio_specification(selected: dict, grid: Grid, *, weight: float = 0.02, base_bps: float = 10.0, conservative_bps: float = 25.0) -> dict:
    """What a portfolio takes over from the selected candidate; an event-level one trades the strongest event of a company-day."""
    aggregation = selected["aggregation"] if selected["aggregation"] != "event_level" else "strongest_company_day"
    named = {k: selected[k] for k in ("signal", "minimum_confidence", "minimum_relevance", "minimum_materiality")}
    return {**named, "aggregation": aggregation, "holding_periods": list(HORIZONS), "maximum_company_weight": weight, "base_cost_bps": base_bps, "conservative_cost_bps": conservative_bps}


def check(grid: Grid, columns: Sequence[str]) -> None:
    """Unknown signals or aggregations, empty or repeated thresholds are errors."""
    if set(grid.signals) - set(columns) or set(grid.aggregations) - set(AGGREGATIONS):
        raise ValueError("unknown signal or aggregation")
    for cuts in (grid.signals, grid.aggregations, grid.confidence, grid.relevance, grid.materiality):
        if not cuts or len(set(cuts)) != len(cuts):
            raise ValueError("empty or repeated values in the grid")
