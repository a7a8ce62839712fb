"""Association, accuracy, agreement and performance statistics, all as plans of aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import finite, normal_p

TRADING_DAYS = 252


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation; null under three pairs or where either side is constant."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    n = F.count(x)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when((n >= 3) & (F.stddev_pop(x) > 1e-12) & (F.stddev_pop(y) > 1e-12), F.try_divide(F.covar_pop(x, y), spread))


def average_rank(df: DataFrame, column: str, out: str, *keys: str) -> DataFrame:
    """Average ranks of ties within keys.

    Distinct values are counted first, so the ordered window holds one row a
    value and the rows of one value are never sorted.
    """
    values = df.groupBy(*keys, column).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy(column))
    ranked = values.withColumn(out, upto - (F.col("_n") - 1) / 2.0).drop("_n")
    return df.join(ranked, [*keys, column])


def association(df: DataFrame, signal: str, ret: str, *keys: str) -> DataFrame:
    """n, pearson and spearman of each key."""
    pairs = df.where(F.col(signal).isNotNull() & F.col(ret).isNotNull()).select(*keys, signal, ret)
    ranked = average_rank(average_rank(pairs, signal, "_rx", *keys), ret, "_ry", *keys)
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), correlation(F.col(signal), F.col(ret)).alias("pearson"), correlation(F.col("_rx"), F.col("_ry")).alias("spearman"))


def long_returns(df: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """One row an (article, horizon): horizon and ret in place of the columns of each horizon."""
    pairs = ", ".join(f"{h}, future_return_{h}d" for h in horizons)
    rest = [c for c in df.columns if not c.startswith(("future_return_", "exit_date_", "exit_close_"))]
    return df.select(*rest, F.expr(f"stack({len(horizons)}, {pairs}) as (horizon, ret)"))


def usable() -> Column:
    """Tradable, not abstained, with a return."""
    return F.col("tradable") & ~F.col("abstain") & F.col("ret").isNotNull()


def horizon_metrics(df: DataFrame, *keys: str) -> DataFrame:
    """Metrics of each key over usable rows: hit rate, signed return, means by label and their spread."""
    on = lambda c: F.when(usable(), c)
    sign = F.signum("score")
    moved = usable() & (F.abs("score") > 1e-12)
    mean = lambda name: F.avg(F.when(usable() & (F.col("label") == name), F.col("ret")))
    return df.groupBy(*keys).agg(
        F.count(on(F.lit(1))).alias("n"),
        F.avg(usable().cast("double")).alias("coverage"),
        F.avg(on(sign * F.col("ret"))).alias("signed_return"),
        F.avg(F.when(moved, (F.signum("ret") == sign).cast("double"))).alias("accuracy"),
        mean("bullish").alias("bullish_mean"), mean("bearish").alias("bearish_mean"),
        (mean("bullish") - mean("bearish")).alias("spread"),
    )


def breakdown(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Counts and conditional means by each of several columns, in one pass over grouping sets."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(g).alias("dimension"), F.col(g).cast("string").alias("value")) for g in groups))).alias("g"), "*")
    return long.groupBy(F.col("g.dimension").alias("dimension"), F.col("g.value").alias("value")).agg(
        F.count("*").alias("n"), F.sum(F.col("tradable").cast("long")).alias("n_tradable"), F.avg("score").alias("mean_score"),
        F.count(F.when(F.col("eligible"), 1)).alias("n_eligible"), F.avg(F.when(F.col("eligible"), F.signum("score") * F.col("ret"))).alias("signed_return"),
    )


def origin_slope(x: str, y: str) -> Column:
    """Slope of a least-squares line through the origin; null where x is all zero."""
    return F.try_divide(F.sum(F.col(x) * F.col(y)), F.sum(F.col(x) * F.col(x)))


def clustered_slope(df: DataFrame, x: str, y: str, first: str, second: str) -> DataFrame:
    """Slope of y on x with standard errors clustered by each of two columns and by both, with the small-sample factor.

    Each comes with its t statistic and two-sided p-value (normal distribution).
    All null under ten rows or where x is constant.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y, first, second)
    enough = (F.count("*") >= 10) & (F.stddev_pop(x) > 1e-12)
    fit = rows.agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.when(enough, F.try_divide(F.covar_pop(x, y), F.var_pop(x))).alias("slope"), F.when(enough, F.var_pop(x) * F.count("*")).alias("sxx"))
    u = rows.crossJoin(F.broadcast(fit)).withColumn("u", (F.col(x) - F.col("mx")) * (F.col(y) - F.col("my") - F.col("slope") * (F.col(x) - F.col("mx"))))

    def meat(tag: str, *keys: str) -> DataFrame:
        sums = u.groupBy(*keys).agg(F.sum("u").alias("s"))
        g = F.count("*").cast("double")
        return sums.agg(F.try_divide(g, g - 1).alias(f"f_{tag}"), F.sum(F.col("s") * F.col("s")).alias(f"m_{tag}"))

    out = fit.crossJoin(meat("a", first)).crossJoin(meat("b", second)).crossJoin(meat("ab", first, second))
    factor = (F.col("n") - 1) / (F.col("n") - 2)
    var = {t: F.col(f"f_{t}") * factor * F.col(f"m_{t}") / (F.col("sxx") * F.col("sxx")) for t in ("a", "b", "ab")}
    both = var["a"] + var["b"] - var["ab"]
    out = out.withColumns({"se_first": F.sqrt(var["a"]), "se_second": F.sqrt(var["b"]), "se_both": F.when(both > 0, F.sqrt(both))})
    names = ("first", "second", "both")
    out = out.withColumns({f"t_{k}": F.try_divide(F.col("slope"), F.col(f"se_{k}")) for k in names})
    return out.select("n", "slope", *(c for k in names for c in (f"se_{k}", f"t_{k}", normal_p(f"t_{k}").alias(f"p_{k}"))))


def sharpe(ret: str, days: int = TRADING_DAYS) -> Column:
    """Mean over sample deviation, annualised; null under two rows or without deviation."""
    return F.when((F.count(ret) >= 2) & (F.stddev_samp(ret) > 0), F.avg(ret) / F.stddev_samp(ret) * F.sqrt(F.lit(float(days))))


def equity(df: DataFrame, ret: str, *keys: str) -> DataFrame:
    """``equity`` (compounded), ``drawdown`` from its running peak; the peak starts with the first equity, not at 1."""
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("equity", F.product(F.col(ret) + 1).over(w))
    return out.withColumn("drawdown", F.col("equity") / F.max("equity").over(w) - 1)


def performance(df: DataFrame, ret: str, *keys: str, days: int = TRADING_DAYS) -> DataFrame:
    """Sessions, total return, growth rate, volatility, Sharpe, Sortino and deepest drawdown of each key."""
    curve = equity(df, ret, *keys)
    n = F.count("*")
    total = F.max_by("equity", "date")
    down = F.stddev_samp(F.when(F.col(ret) < 0, F.col(ret)))
    return curve.groupBy(*keys).agg(
        n.alias("sessions"), (total - 1).alias("total_return"), F.when(total > 0, F.pow(total, F.lit(float(days)) / n) - 1).alias("cagr"),
        (F.stddev_samp(ret) * F.sqrt(F.lit(float(days)))).alias("volatility"), sharpe(ret, days).alias("sharpe"),
        F.when(down > 0, F.avg(ret) / down * F.sqrt(F.lit(float(days)))).alias("sortino"), F.min("drawdown").alias("max_drawdown"),
    )


def winsorised_mean(df: DataFrame, value: str, *keys: str, share: float = 0.01) -> DataFrame:
    """Quartiles, exact and linear, and the mean after clipping at the outer quantiles."""
    cut = df.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(share), F.lit(0.25), F.lit(0.5), F.lit(0.75), F.lit(1 - share))).alias("q"))
    rows = df.join(F.broadcast(cut), list(keys))
    return rows.groupBy(*keys).agg(F.avg(F.least(F.greatest(F.col(value), F.col("q")[0]), F.col("q")[4])).alias("winsorised_mean"), F.first(F.col("q")[1]).alias("p25"), F.first(F.col("q")[2]).alias("median"), F.first(F.col("q")[3]).alias("p75"))


def mean_of_means(df: DataFrame, value: str, entity: str, *keys: str) -> DataFrame:
    """Every entity weighs the same."""
    return df.groupBy(*keys, entity).agg(F.avg(value).alias("_m")).groupBy(*keys).agg(F.avg("_m").alias("equal_mean"), F.count("*").alias("entities"))


def benjamini_hochberg(df: DataFrame, p: str) -> DataFrame:
    """``q_value``: running minimum from the largest p of p * m / rank, at most 1; null p is left out of the count and stays null."""
    some = df.where(F.col(p).isNotNull())
    m = some.agg(F.count("*").alias("_m"))
    ranked = some.withColumn("_k", F.row_number().over(Window.orderBy(p, "spec_id"))).crossJoin(F.broadcast(m))
    q = F.min(F.col(p) * F.col("_m") / F.col("_k")).over(Window.orderBy("_k").rowsBetween(0, Window.unboundedFollowing))
    return ranked.withColumn("q_value", F.least(F.lit(1.0), q)).drop("_k", "_m").unionByName(df.where(F.col(p).isNull()).withColumn("q_value", F.lit(None).cast("double")))


def permute_within(df: DataFrame, column: str, out: str, *, key: str, seed: int, group: str) -> DataFrame:
    """``out``: the values of ``column`` dealt anew among the rows of each group, by a seeded hash of ``key``."""
    own = Window.partitionBy(group).orderBy(key)
    dealt = Window.partitionBy(group).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), key).cast("binary")), key)
    right = df.select(group, F.col(column).alias(out), F.row_number().over(dealt).alias("_n"))
    return df.withColumn("_n", F.row_number().over(own)).join(right, [group, "_n"]).drop("_n")


def ledger_performance(df: DataFrame, ret: str, *, days: int = TRADING_DAYS) -> DataFrame:
    """One row: sessions, total return, mean and deviation a year, Sharpe, deepest drawdown; no sessions give zero and nulls."""
    curve = equity(df, ret)
    return curve.agg(F.count("*").alias("sessions"), F.coalesce(F.max_by("equity", "date") - 1, F.lit(0.0)).alias("total_return"), (F.avg(ret) * days).alias("annualized_return"), (F.stddev_samp(ret) * F.sqrt(F.lit(float(days)))).alias("annualized_volatility"), sharpe(ret, days).alias("sharpe"), F.min("drawdown").alias("maximum_drawdown"))


def finite_pairs(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose columns are all finite numbers."""
    for c in columns:
        df = df.where(finite(F.col(c)).isNotNull())
    return df


def prediction_metrics(df: DataFrame, score: str, horizons: Sequence[int]) -> DataFrame:
    """Benchmark bundle of each horizon over tradable rows with finite score and return."""
    rows = long_returns(df, horizons).where("tradable and not abstain")
    pairs = finite_pairs(rows, score, "ret")
    moved = F.col(score) != 0
    own = pairs.groupBy("horizon").agg(F.count(F.when(moved, 1)).alias("directional_n"), F.avg(F.when(moved, F.signum(score) * F.col("ret"))).alias("average_signed_return"), F.avg(F.when(moved, (F.signum(score) == F.signum("ret")).cast("double"))).alias("directional_accuracy"))
    ic = association(pairs, score, "ret", "horizon").withColumnsRenamed({"pearson": "pearson_ic", "spearman": "spearman_ic"})
    coverage = df.agg(F.avg((F.col("tradable") & ~F.col("abstain")).cast("double")).alias("tradable_coverage"))
    return ic.join(own, "horizon").join(F.broadcast(coverage))


def permissiveness(df: DataFrame, measure: str, threshold: float, *, sample: Column) -> DataFrame:
    """One row over pairs of raters (second one's columns end in 2): their distributions where labels agree, and the gap of their coverage.

    ``policy_gap``: first less second rater on the ``sample``; ``selection_shift``:
    the first rater on all rows less on the sample; both in percentage points.
    """
    agreed = F.col("label") == F.col("label2")
    a, b = F.col("tradable"), F.col("tradable2")
    share = lambda c, where=agreed: F.avg(F.when(where, c.cast("double")))
    count = lambda c: F.count(F.when(agreed & c, 1))
    x, y = F.col(measure), F.col(f"{measure}2")
    return df.agg(
        count(F.lit(True)).alias("agreed"), share(a).alias("first_tradable"), share(b).alias("second_tradable"), count(a & b).alias("both_tradable"), count(a & ~b).alias("first_only"), count(~a & b).alias("second_only"), count(~a & ~b).alias("neither"),
        F.avg(F.when(agreed, x - y)).alias("paired_difference"), F.percentile(F.when(agreed, x), 0.5).alias("first_median"), F.percentile(F.when(agreed, y), 0.5).alias("second_median"), share(x >= threshold).alias("first_share"), share(y >= threshold).alias("second_share"),
        (100 * (share(a, sample) - share(b, sample))).alias("policy_gap"), (100 * (F.avg(a.cast("double")) - share(a, sample))).alias("selection_shift"),
    )


def subset_bundle(df: DataFrame, signal: str, horizons: Sequence[int]) -> DataFrame:
    """Metrics of each (subset, research_split, horizon) over rows whose outcome ends before the next split."""
    pairs = ", ".join(f"{h}, future_return_{h}d, exit_date_{h}d" for h in horizons)
    rows = df.select("subset", "research_split", "label", signal, "next_split_entry_date", F.expr(f"stack({len(horizons)}, {pairs}) as (horizon, ret, ends)"))
    rows = rows.where("ret is not null and (next_split_entry_date is null or ends < next_split_entry_date)")
    keys = ("subset", "research_split", "horizon")
    mean = lambda name: F.avg(F.when(F.col("label") == name, F.col("ret")))
    own = rows.groupBy(*keys).agg(F.avg(F.signum(signal) * F.col("ret")).alias("average_signed_return"), (mean("bullish") - mean("bearish")).alias("spread"), F.avg(F.when(F.abs(signal) > 1e-12, (F.signum(signal) == F.signum("ret")).cast("double"))).alias("directional_accuracy"))
    return association(rows, signal, "ret", *keys).withColumnsRenamed({"pearson": "pearson_ic", "spearman": "spearman_ic"}).join(own, list(keys))
