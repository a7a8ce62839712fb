"""Every query over the driver's tables, with its SQL where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import correlation_p, is_close
from ..operators import align, cascade, contracts, costs, ledger, metrics, portfolio, resample, screen, sequential, signals, specification, splits
from ..staging import stage
from . import decisions, views
from .oracle import with_base

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
HOLDING, CAPITAL = 5, 1_000_000.0


#: Names of result columns that hold dates or timestamps: both engines give them as text.
DATES = ("date", "pub_date", "entry_date", "exit_date", "exit_date_1d", "exit_date_5d", "exit_date_21d", "next_split_entry_date", "window_start", "window_end", "day")
STAMPS = ("entry_ts", "first_ts", "last_ts", "validation_start", "validation_end", "embargo_end")


def as_text(df: DataFrame) -> DataFrame:
    """Dates as yyyy-MM-dd and timestamps as yyyy-MM-dd HH:mm:ss."""
    kinds = {"date": "yyyy-MM-dd", "timestamp_ntz": "yyyy-MM-dd HH:mm:ss"}
    return df.select(*(F.date_format(c, kinds[t]).alias(c) if t in kinds else F.col(c) for c, t in df.dtypes))


def query(sql: str | None = None, *, base: bool = True, recursive: bool = False, text: str = ""):
    """Register a query. ``text``: names of its date and timestamp columns, for its SQL."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, d: str) -> DataFrame:
            return as_text(f(spark, d))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            full = with_base(sql, recursive) if base else sql.strip()
            shown = [f"strftime({c}, '{'%Y-%m-%d' if c in DATES else '%Y-%m-%d %H:%M:%S'}') as {c}" for c in text.split()]
            ORACLE_SQL[f.__name__] = f"select * replace ({', '.join(shown)}) from ({full})" if shown else full
        return f

    return put


def r8(column: str | Column) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, 8)


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _pearson(x: str, y: str) -> str:
    return f"case when count(*) >= 3 and stddev_pop({x}) > 1e-12 and stddev_pop({y}) > 1e-12 then covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) end"


# --- alignment and returns -------------------------------------------------


@query("select article_id, ticker, pub_date, entry_date, (cast(entry_date as timestamp) + interval '9 hours 30 minutes') at time zone 'America/New_York' at time zone 'UTC' as entry_ts from aligned", text="pub_date entry_date entry_ts")
def asof_entry(spark, d):
    """JOI-4, SCA-22, PRJ-22."""
    return views.aligned(spark, d).select("article_id", "ticker", "pub_date", "entry_date", align.open_utc(F.col("entry_date")).alias("entry_ts"))


@query("select article_id, entry_date, exit_date_1d, exit_date_5d, exit_date_21d, round(future_return_1d, 8) as future_return_1d, round(future_return_5d, 8) as future_return_5d, round(future_return_21d, 8) as future_return_21d, exit_date_21d is not null as complete from aligned", text="entry_date exit_date_1d exit_date_5d exit_date_21d")
def forward_returns(spark, d):
    """JOI-5, PRJ-5, FIL-5."""
    out = views.aligned(spark, d).select("article_id", "entry_date", *(f"exit_date_{h}d" for h in views.HORIZONS), *(f"future_return_{h}d" for h in views.HORIZONS))
    return rounded(out.withColumn("complete", F.col("exit_date_21d").isNotNull()))


@query(f""", u as (select * from long_events where tradable and ret is not null), rk as (
  select *, rank() over (partition by horizon order by signal_weighted) + (count(*) over (partition by horizon, signal_weighted) - 1) / 2.0 as rx, rank() over (partition by horizon order by ret) + (count(*) over (partition by horizon, ret) - 1) / 2.0 as ry from u
), a as (select horizon, round({_pearson('signal_weighted', 'ret')}, 8) as pearson, round({_pearson('rx', 'ry')}, 8) as spearman from rk group by horizon), m as (
  select horizon, count(case when tradable and ret is not null then 1 end) as n, round(avg(case when tradable and ret is not null then 1.0 else 0.0 end), 8) as coverage, round(avg(case when tradable then sign(score)::double * ret end), 8) as signed_return,
    round(avg(case when tradable and ret is not null and abs(score) > 1e-12 then case when sign(ret) = sign(score) then 1.0 else 0.0 end end), 8) as accuracy,
    round(avg(case when tradable and label = 'bullish' then ret end), 8) as bullish_mean, round(avg(case when tradable and label = 'bearish' then ret end), 8) as bearish_mean, round(avg(case when tradable and label = 'bullish' then ret end) - avg(case when tradable and label = 'bearish' then ret end), 8) as spread
  from long_events group by horizon
) select m.*, a.pearson, a.spearman from m join a using (horizon)""")
def event_metrics(spark, d):
    """FIL-6, AGG-12/13, PRJ-11; flagship."""
    rows = metrics.long_returns(signals.with_ladder(views.events(spark, d)), views.HORIZONS)
    ic = metrics.association(rows.where(metrics.usable()), "signal_weighted", "ret", "horizon").drop("n")
    return rounded(metrics.horizon_metrics(rows, "horizon").join(ic, "horizon"))


# --- signals ---------------------------------------------------------------


@query(""", f as (select avg(score) as ms, stddev_samp(score) as ss, avg(keyed) as mk, stddev_samp(keyed) as sk from (select *, ((k * 43) % 201 - 100) / 100.0::double as keyed from events) where research_split = 'development'), z as (
  select article_id, research_split, abstain, (score - ms) / case when ss > 0 then ss else 1 end as zd, (((k * 43) % 201 - 100) / 100.0::double - mk) / case when sk > 0 then sk else 1 end as zr, relevance * materiality * novelty * confidence as w from events, f
) select article_id, research_split, round(case when abstain then 0.0 else zd end, 8) as llm_z, round(case when abstain then 0.0 else zr end, 8) as reference_z, round(case when abstain then 0.0 else zd - zr end, 8) as residual, round(case when abstain then 0.0 else abs(zd - zr) end, 8) as residual_size, round(case when abstain then 0.0 else (zd - zr) * w end, 8) as event_surprise_signal from z""")
def surprise_signals(spark, d):
    """PRJ-3/4, VAL-8, MIS-17."""
    df = views.events(spark, d).withColumn("keyed", ((F.col("k") * 43) % 201 - 100) / F.lit(100.0))
    contracts.require_columns(df, "score", "keyed", "relevance", "materiality", "novelty", "confidence", "abstain")
    out = signals.surprise(df, "score", "keyed").select("article_id", "research_split", "llm_z", "reference_z", "residual", "residual_size", "event_surprise_signal")
    return rounded(out).select(*(F.when(F.col(c) == 0, 0.0).otherwise(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


@query("select article_id, ticker, entry_date, research_split, round(signal_weighted, 8) as signal_weighted from ladder where tradable qualify row_number() over (partition by research_split, ticker, entry_date order by abs(signal_weighted) desc, article_id) = 1", text="entry_date")
def strongest_company_day(spark, d):
    """WIN-2, SEL-1, PRJ-1."""
    df = signals.with_ladder(views.events(spark, d)).where("tradable")
    return rounded(signals.strongest(df, "signal_weighted", "research_split", "ticker", "entry_date").select("article_id", "ticker", "entry_date", "research_split", "signal_weighted"))


@query("""select research_split, ticker, entry_date, round(avg(signal_raw), 10) as signal_raw, round(avg(signal_confidence), 10) as signal_confidence, round(avg(signal_weighted), 10) as signal_weighted, round(avg(signal_novel), 10) as signal_novel,
  round(avg(confidence), 10) as confidence, round(avg(relevance), 10) as relevance, round(avg(materiality), 10) as materiality, arg_min(sector, article_id) as sector, arg_min(event_type, article_id) as event_type, round(arg_min(future_return_5d, article_id), 10) as future_return_5d,
  bool_or(tradable) as tradable, bool_and(abstain) as abstain, min(ts) as first_ts, count(*) as n, case when round(avg(signal_raw), 10) > 0.25 then 'bullish' when round(avg(signal_raw), 10) < -0.25 then 'bearish' else 'neutral' end as label from ladder group by 1, 2, 3""", text="entry_date first_ts")
def company_day_mean(spark, d):
    """AGG-1/2, PRJ-9."""
    df = rounded(signals.company_day(signals.with_ladder(views.events(spark, d).withColumn("future_return_5d", F.coalesce("future_return_5d", F.lit(float("nan")))))), 10)
    df = df.withColumn("future_return_5d", F.when(~F.isnan("future_return_5d"), F.col("future_return_5d")))
    return df.withColumn("label", signals.label_of(F.col("signal_raw")))


ORACLE_SQL["company_day_mean"] = ORACLE_SQL["company_day_mean"].replace("round(arg_min(future_return_5d, article_id), 10)", "round(arg_min_null(future_return_5d, article_id), 10)")

# --- splits ----------------------------------------------------------------


@query("select research_split, count(*) as n, min(ts) as first_ts, max(ts) as last_ts, arg_min(article_id, chronological_index) as first_id, arg_max(article_id, chronological_index) as last_id, min(chronological_index) as first_index, max(chronological_index) as last_index from events group by 1", text="first_ts last_ts")
def chrono_splits(spark, d):
    """PRJ-17/18, AGG-8/10."""
    i = "chronological_index"
    return views.events(spark, d).groupBy("research_split").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min_by("article_id", i).alias("first_id"), F.max_by("article_id", i).alias("last_id"), F.min(i).alias("first_index"), F.max(i).alias("last_index"))


@query("select article_id, research_split, exit_date_5d, next_split_entry_date from events where next_split_entry_date is null or exit_date_5d < next_split_entry_date", text="exit_date_5d next_split_entry_date")
def split_purge(spark, d):
    """PRJ-8, FIL-8."""
    return views.events(spark, d).where(splits.unpurged(5)).select("article_id", "research_split", "exit_date_5d", "next_split_entry_date")


@query("""select dimension, value, count(*) as n, sum(case when tradable then 1 else 0 end)::bigint as n_tradable, round(avg(score), 8) as mean_score, count(case when ok then 1 end) as n_eligible, round(avg(case when ok then sign(score)::double * future_return_5d end), 8) as signed_return from (
  select *, coalesce(tradable and future_return_5d is not null and (next_split_entry_date is null or exit_date_5d < next_split_entry_date), false) as ok from events) e, lateral (select unnest([
    {'dimension': 'event_type', 'value': e.event_type}, {'dimension': 'sector', 'value': e.sector}, {'dimension': 'label', 'value': e.label}, {'dimension': 'year', 'value': cast(year(e.ts) as varchar)},
    {'dimension': 'confidence_bucket', 'value': case when e.confidence < 0.5 then '<0.50' when e.confidence < 0.7 then '0.50-0.70' when e.confidence < 0.85 then '0.70-0.85' else '>=0.85' end},
    {'dimension': 'materiality_bucket', 'value': case when e.materiality < 0.25 then '<0.25' when e.materiality < 0.5 then '0.25-0.50' when e.materiality < 0.75 then '0.50-0.75' else '>=0.75' end}], recursive := true)) g group by 1, 2""")
def breakdowns(spark, d):
    """AGG-3, PRJ-6/7."""
    df = views.events(spark, d).withColumns({"year": F.year("ts"), "confidence_bucket": signals.half_open(F.col("confidence"), [0.5, 0.7, 0.85]), "materiality_bucket": signals.half_open(F.col("materiality"), [0.25, 0.5, 0.75]), "ret": F.col("future_return_5d")})
    df = df.withColumn("eligible", metrics.usable() & splits.unpurged(5))
    return rounded(metrics.breakdown(df, ["event_type", "sector", "label", "year", "confidence_bucket", "materiality_bucket"]))


@query("""select ticker, horizon, count(case when tradable and ret is not null then 1 end) as n, round(avg(case when tradable and ret is not null then 1.0 else 0.0 end), 8) as coverage, round(avg(case when tradable then sign(score)::double * ret end), 8) as signed_return,
  round(avg(case when tradable and ret is not null and abs(score) > 1e-12 then case when sign(ret) = sign(score) then 1.0 else 0.0 end end), 8) as accuracy, round(avg(case when tradable and label = 'bullish' then ret end), 8) as bullish_mean, round(avg(case when tradable and label = 'bearish' then ret end), 8) as bearish_mean,
  round(avg(case when tradable and label = 'bullish' then ret end) - avg(case when tradable and label = 'bearish' then ret end), 8) as spread from long_events group by ticker, horizon""")
def metrics_by_ticker(spark, d):
    """AGG-4."""
    return rounded(metrics.horizon_metrics(metrics.long_returns(views.events(spark, d), views.HORIZONS), "ticker", "horizon"))


@query("""select ticker, date, round(lag(adjusted_close, 1) over w / lag(adjusted_close, 22) over w - 1, 8) as momentum, round(-(lag(adjusted_close, 1) over w / lag(adjusted_close, 6) over w - 1), 8) as reversal from prices window w as (partition by ticker order by date)""", text="date")
def price_features(spark, d):
    """WIN-1."""
    w = Window.partitionBy("ticker").orderBy("date")
    lag = lambda n: F.lag("adjusted_close", n).over(w)
    return rounded(views.prices(spark, d).select("ticker", "date", (lag(1) / lag(22) - 1).alias("momentum"), (-(lag(1) / lag(6) - 1)).alias("reversal")))


@query(""", m as (select event_type, avg(future_return_5d) as mean from events where research_split = 'development' and tradable and (next_split_entry_date is null or exit_date_5d < next_split_entry_date) and event_type <> '5-LOW' group by 1)
select article_id, event_type, round(coalesce(mean, 0.0), 8) as encoded from events left join m using (event_type)""")
def event_type_encoding(spark, d):
    """AGG-11, JOI-3, FIL-11."""
    df = views.events(spark, d)
    means = df.where((F.col("research_split") == "development") & F.col("tradable") & splits.unpurged(5) & (F.col("event_type") != "5-LOW")).groupBy("event_type").agg(F.avg("future_return_5d").alias("mean"))
    return df.join(F.broadcast(means), "event_type", "left").select("article_id", "event_type", r8(F.coalesce("mean", F.lit(0.0))).alias("encoded"))


# --- portfolio -------------------------------------------------------------


@query(""", e as (select e.ticker, e.article_id, e.entry_date, t.session as s, row_number() over (partition by e.ticker order by e.entry_date, e.article_id) as rn from (select * from ladder where tradable and abs(signal_weighted) > 0.3) e join timeline t on t.ticker = e.ticker and t.date = e.entry_date
  where t.session + 4 <= (select max(session) from timeline x where x.ticker = e.ticker)), walk(ticker, rn, article_id, keep, until) as (
  select ticker, rn, article_id, true, s + 4 from e where rn = 1 union all select e.ticker, e.rn, e.article_id, e.s > w.until, case when e.s > w.until then e.s + 4 else w.until end from walk w join e on e.ticker = w.ticker and e.rn = w.rn + 1
) select article_id, ticker from walk where keep""", recursive=True)
def overlap_suppression(spark, d):
    """STA-1, JOI-6, WIN-4, FIL-15."""
    line = views.timeline(spark, d)
    return portfolio.suppress_overlaps(_signals(spark, d, line), line, HOLDING).select("article_id", "ticker")


def _signals(spark: SparkSession, d: str, line: DataFrame) -> DataFrame:
    return signals.with_ladder(views.events(spark, d, line)).where("tradable and abs(signal_weighted) > 0.3")


def _days(spark: SparkSession, d: str) -> DataFrame:
    line = views.timeline(spark, d)
    held = signals.strongest(_signals(spark, d, line), "signal_weighted", "ticker", "entry_date").withColumn("direction", F.signum("signal_weighted"))
    rows = held.select("article_id", "ticker", "entry_date", "research_split", "direction", "signal_weighted")
    return stage(align.position_returns(align.holding_days(rows, line.drop("prev_date"), HOLDING)), "position-days")


_POSITIONS = """, held as (select article_id, ticker, entry_date, research_split, signal_weighted, sign(signal_weighted)::double as direction from ladder where tradable and abs(signal_weighted) > 0.3 qualify row_number() over (partition by ticker, entry_date order by abs(signal_weighted) desc, article_id) = 1
), days as (select h.*, p.pos, x.date, x.open, x.close, x.adjusted_close, x.adj_open, x.volume from held h join timeline t on t.ticker = h.ticker and t.date = h.entry_date cross join (select unnest(range(5)) as pos) p join timeline x on x.ticker = h.ticker and x.session = t.session + p.pos
  where t.session + 4 <= (select max(session) from timeline m where m.ticker = h.ticker)
), ret as (select *, adjusted_close / case when pos = 0 then adj_open else lag(adjusted_close) over (partition by article_id order by pos) end - 1 as day_return from days)"""


@query(_POSITIONS + " select article_id, ticker, pos, date, direction, round(day_return, 8) as day_return from ret", text="date")
def position_days(spark, d):
    """JOI-6, WIN-5."""
    return rounded(_days(spark, d).select("article_id", "ticker", F.col("pos").cast("long").alias("pos"), "date", "direction", "day_return"))


_BOOK = _POSITIONS + """, cal as (select date, row_number() over (order by date) as i from (select distinct date from prices)
), c as (select *, sum(case when direction > 0 then 1 else 0 end) over (partition by date) as nl, sum(case when direction < 0 then 1 else 0 end) over (partition by date) as ns from ret
), w as (select c.*, cal.i, case when nl > 0 and ns > 0 then direction * least(0.5 / case when direction > 0 then nl else ns end, 0.05) else 0.0 end as weight from c join cal using (date)
), mv as (select i, sum(abs(m)) as turnover from (select i, ticker, sum(m) as m from (select i, ticker, weight as m from w union all select i + 1, ticker, -weight from w) group by 1, 2) group by 1
), b as (select i, sum(weight * day_return) as gross_return, sum(case when weight > 0 then weight else 0 end) as long_exposure, sum(case when weight < 0 then -weight else 0 end) as short_exposure, count(case when weight <> 0 then 1 end) as positions, coalesce(sum(weight * weight) / nullif(pow(sum(abs(weight)), 2), 0), 0) as hhi from w group by 1
), book as (select date, coalesce(gross_return, 0) as gross_return, coalesce(turnover, 0) as turnover, coalesce(long_exposure, 0) as long_exposure, coalesce(short_exposure, 0) as short_exposure, coalesce(positions, 0) as positions, coalesce(hhi, 0) as hhi, coalesce(gross_return, 0) - coalesce(turnover, 0) * 10.0::double / 10000 as net_return from cal left join b using (i) left join mv using (i))"""


def _book(spark: SparkSession, d: str) -> DataFrame:
    calendar = views.prices(spark, d).select("date").distinct()
    return portfolio.net_returns(portfolio.daily_book(portfolio.weights(_days(spark, d), mode="market_neutral", cap=0.05), calendar), 10.0)


@query(_BOOK + " select date, round(gross_return, 8) as gross_return, round(turnover, 8) as turnover, round(long_exposure, 8) as long_exposure, round(short_exposure, 8) as short_exposure, positions, round(hhi, 8) as hhi, round(net_return, 8) as net_return from book", text="date")
def daily_book(spark, d):
    """AGG-39/40/41, WIN-7, JOI-9, SET-5."""
    return rounded(_book(spark, d))


@query(_BOOK + """, y as (select *, year(date) as year from book), q as (select *, product(1 + net_return) over (partition by year order by date) as eq from y), dd as (select *, eq / max(eq) over (partition by year order by date) - 1 as dd from q)
select cast(year as integer) as year, count(*) as sessions, round(arg_max(eq, date) - 1, 8) as total_return, round(case when arg_max(eq, date) > 0 then pow(arg_max(eq, date), 252.0 / count(*)) - 1 end, 8) as cagr, round(stddev_samp(net_return) * sqrt(252), 8) as volatility,
  round(case when count(*) >= 2 and stddev_samp(net_return) > 0 then avg(net_return) / stddev_samp(net_return) * sqrt(252) end, 8) as sharpe, round(case when stddev_samp(case when net_return < 0 then net_return end) > 0 then avg(net_return) / stddev_samp(case when net_return < 0 then net_return end) * sqrt(252) end, 8) as sortino, round(min(dd), 8) as max_drawdown from dd group by year""")
def book_performance(spark, d):
    """WIN-3, AGG-26/27/28."""
    return rounded(metrics.performance(_book(spark, d).withColumn("year", F.year("date")), "net_return", "year"))


@query("""select l_orderkey, l_linenumber, l_partkey, round(sum(case when l_quantity = 0 then 0 else greatest(1.0, l_quantity * 0.005) end), 12) as commissions, round(sum(abs(l_quantity * p) * 2 / 10000), 12) as half_spread, round(sum(abs(l_quantity * p) * 3 / 10000), 12) as slippage,
  round(sum(abs(l_quantity * p) * 0.1 * least(l_quantity / 1000.0, 0.01) * least(l_quantity / 1000.0, 0.01)), 12) as volume_impact, round(sum(case when l_returnflag = 'R' then l_quantity * p * 0.03 * 5 / 252 else 0 end), 12) as borrow from (select *, l_extendedprice / l_quantity as p from lineitem) group by 1, 2, 3""", base=False)
def cost_models(spark, d):
    """CST-1..7."""
    rows = views.table(spark, d, "lineitem").withColumn("p", F.col("l_extendedprice") / F.col("l_quantity"))
    parts = costs.one_way(F.col("l_quantity"), F.col("p"), F.lit(1000.0), costs.BASE)
    parts["borrow"] = costs.borrow(F.when(F.col("l_returnflag") == "R", F.col("l_quantity") * F.col("p")).otherwise(0.0), costs.BASE, HOLDING)
    return rows.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(*(F.round(F.sum(c), 12).alias(k) for k, c in parts.items()))


def _trades(spark: SparkSession, d: str) -> DataFrame:
    return _days(spark, d).withColumn("notional", F.lit(10_000.0))


_TRADES = _POSITIONS + """, mk as (select *, first_value(adj_open) over (partition by article_id order by pos) as eo, first_value(open) over (partition by article_id order by pos) as e1, case when pos = 0 then adj_open else lag(adjusted_close) over (partition by article_id order by pos) end as pv from days
), marked as (select *, direction * (10000.0::double / eo) * (adjusted_close - pv) as pnl, direction * (10000.0::double / eo) * adjusted_close as marked from mk
), fl as (select article_id, ticker, research_split, date, 'entry' as side, direction * (10000.0::double / e1) as quantity, open as price, volume from mk where pos = 0 union all select article_id, ticker, research_split, date, 'exit', -direction * (10000.0::double / e1), close, volume from mk where pos = 4
), fills as (select *, greatest(1.0, abs(quantity) * 0.005) + abs(quantity * price) * 2 / 10000 + abs(quantity * price) * 3 / 10000 + abs(quantity * price) * 0.1 * least(abs(quantity) / volume, 0.01) * least(abs(quantity) / volume, 0.01) + case when side = 'entry' then 0.5 else 0 end as cost from fl)"""


@query(_TRADES + " select article_id, ticker, research_split, date, side, round(quantity, 6) as quantity, round(price, 6) as price, volume, round(cost, 6) as cost from fills", text="date")
def trade_ledger(spark, d):
    """STA-7, CST-8/9, MIS-9."""
    out = ledger.fills(_trades(spark, d), HOLDING, costs.BASE)
    return out.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


@query(_TRADES + """, dy as (select research_split, date, sum(pnl) as gross_pnl, sum(case when direction = 1 then marked else 0 end) as long_exposure, sum(case when direction = -1 then -marked else 0 end) as short_exposure, sum(case when direction = -1 then abs(marked) * 0.03 * 1 / 252.0 else 0 end) as borrow from marked group by 1, 2
), tr as (select research_split, date, sum(abs(quantity) * price) as turnover, sum(cost) as cost from fills group by 1, 2)
select research_split, date, round(gross_pnl, 6) as gross_pnl, round(long_exposure, 6) as long_exposure, round(short_exposure, 6) as short_exposure, round(borrow, 6) as borrow, round(coalesce(turnover, 0), 6) as turnover, round(coalesce(cost, 0), 6) as cost, round(gross_pnl - coalesce(cost, 0) - borrow, 6) as net_pnl from dy left join tr using (research_split, date)""", text="date")
def daily_pnl(spark, d):
    """AGG-5/6, WIN-6."""
    trades = _trades(spark, d)
    out = ledger.daily_pnl(ledger.mark(trades), ledger.fills(trades, HOLDING, costs.BASE), costs.BASE)
    return out.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


@query(_TRADES + ", p as (select research_split, ticker, abs(sum(pnl)) as p from marked group by 1, 2) select research_split, round(case when sum(p) > 0 then max(p) / sum(p) end, 8) as largest_share, count(*) as tickers from p group by 1")
def pnl_concentration(spark, d):
    """AGG-7."""
    return rounded(ledger.concentration(ledger.mark(_trades(spark, d))))


def _book_events(spark: SparkSession, d: str) -> DataFrame:
    """Strongest company-days with what the acceptance fold needs; reasons that need no state are columns already.

    Every 13th of a month has no volume, so that session isn't in the book's
    calendar; one entry price in 23 is off; the target has a planted edge.
    """
    line = views.timeline(spark, d)
    volume = F.when(F.dayofmonth("date") == 13, 0).otherwise(F.col("volume")).cast("double")
    usable = align.sessions(align.usable_sessions(views.prices(spark, d).withColumn("volume", volume)), [HOLDING])
    path = usable.select("ticker", F.col("date").alias("entry_date"), "open", "volume", F.col("adj_open").alias("path_open"), F.col(f"exit_date_{HOLDING}d").alias("exit_date"))
    frozen = F.col("adj_open") * F.when(F.col("k") % 23 == 0, 1.001).otherwise(1.0)
    rows = signals.strongest(_signals(spark, d, line), "signal_weighted", "research_split", "ticker", "entry_date").select("article_id", "ticker", "entry_date", "research_split", "next_split_entry_date", F.col("signal_weighted").alias("signal"), frozen.alias("frozen_open"), (F.col("future_return_5d") + 0.2 * F.col("signal_weighted")).alias("target"))
    rows = rows.join(path, ["ticker", "entry_date"], "left")
    reason = screen.first_failing([("missing_holding_path", F.col("exit_date").isNull()), ("split_boundary", F.coalesce(F.col("exit_date") >= F.col("next_split_entry_date"), F.lit(False))), ("entry_price_mismatch", ~is_close(F.col("path_open"), F.col("frozen_open")))])
    return stage(rows.withColumn("reason", reason), "book-events")


_BOOK_EVENTS = """, up as (select * replace (case when day(date) = 13 then 0 else volume end as volume) from prices where day(date) <> 13 and least(open, close, adjusted_close) > 0 and volume > 0
), us as (select ticker, date as entry_date, open, volume::double as volume, open * adjusted_close / close as path_open, lead(date, 4) over (partition by ticker order by date) as exit_date from up
), be as (select l.article_id, l.ticker, l.entry_date, l.research_split, l.next_split_entry_date, signal_weighted as signal, adj_open * case when k % 23 = 0 then 1.001::double else 1.0 end as frozen_open, future_return_5d + 0.2::double * signal_weighted as target from ladder l where tradable and abs(signal_weighted) > 0.3 qualify row_number() over (partition by research_split, ticker, entry_date order by abs(signal_weighted) desc, article_id) = 1
), e as (select be.*, us.open, us.volume, us.exit_date, case when us.exit_date is null then 'missing_holding_path' when us.exit_date >= next_split_entry_date then 'split_boundary' when abs(path_open - frozen_open) > greatest(1e-8 * greatest(abs(path_open), abs(frozen_open)), 1e-8) then 'entry_price_mismatch' end as reason,
  row_number() over (partition by research_split order by be.entry_date, abs(signal) desc, article_id) as rn from be left join us using (ticker, entry_date)
), sl as (select sum(signal * target) / sum(signal * signal) as slope from e where research_split = 'development' and target is not null and exit_date < next_split_entry_date
), walk as (select research_split, 0::bigint as rn, []::struct(x date, t varchar, d integer, n double)[] as active, null::varchar as article_id, null::varchar as reason, 0.0::double as notional, 0.0::double as expected from (select distinct research_split from e)
  union all select research_split, rn, case when out is null then act || [{'x': exit_date, 't': ticker, 'd': dir, 'n': n}] else act end, article_id, out, case when out is null then n else 0 end, expected from (
    select *, case when reason is not null then reason when overlap then 'same_ticker_overlap' when n <= 0 then 'portfolio_capacity' when slope <= 0 then 'development_calibration_not_directionally_positive'
      when abs(expected) * n < 1.5 * (2 * (greatest(1.0, n / open * 0.005) + n * 5 / 10000 + n * 0.1 * pow(least(n / open / volume, 0.01), 2)) + case when dir < 0 then n * 0.03 * 5 / 252.0 else 0 end + 0.5) then 'insufficient_cost_buffer' end as out from (
      select *, greatest(0, least(20000, 500000 - coalesce(list_sum(list_transform(list_filter(act, lambda a: a.d = dir), lambda a: a.n)), 0), 1000000 - coalesce(list_sum(list_transform(act, lambda a: a.n)), 0), volume * open * 0.5)) as n, len(list_filter(act, lambda a: a.t = ticker)) > 0 as overlap from (
        select e.research_split, e.rn, e.article_id, e.ticker, e.exit_date, e.reason, e.open, e.volume, e.signal * sl.slope as expected, sl.slope, case when e.signal > 0 then 1 else -1 end as dir, list_filter(w.active, lambda a: a.x >= e.entry_date) as act from walk w join e on e.research_split = w.research_split and e.rn = w.rn + 1, sl)))
), bk as (select * from walk where rn > 0)"""


def _capacity(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(events, their acceptance) with the slope fitted on development outcomes that end before validation."""
    rows = _book_events(spark, d)
    purged = rows.where("research_split = 'development' and target is not null and exit_date < next_split_entry_date")
    slope = purged.agg(metrics.origin_slope("signal", "target").alias("slope")).first()["slope"]
    if slope is None:
        raise ValueError("development data are required for edge calibration")
    return rows, sequential.capacity_book(rows, capital=CAPITAL, weight=0.02, side_limit=0.5, gross_limit=1.0, participation=0.5, multiple=1.5, slope=slope, scenario=costs.BASE, holding=HOLDING)


@query(_BOOK_EVENTS + " select article_id, research_split, reason is null as accepted, reason as rejection_reason, round(notional, 6) as notional, round(expected, 8) as expected_return from bk", recursive=True)
def capacity_book(spark, d):
    """STA-2, CST-8, FIL-14, PRJ-16, SCA-26: a fold over each split."""
    out = _capacity(spark, d)[1]
    return out.withColumns({"notional": F.round("notional", 6), "expected_return": r8("expected_return")})


@query(_BOOK_EVENTS + f""", j as (select bk.research_split, bk.reason, bk.expected, e.signal, e.target, rank() over (partition by bk.research_split, ev order by e.signal) as rx, count(*) over (partition by bk.research_split, ev, e.signal) as tx, rank() over (partition by bk.research_split, ev order by e.target) as ry, count(*) over (partition by bk.research_split, ev, e.target) as ty, ev from bk join e using (article_id), lateral (select coalesce(bk.reason not in ('missing_holding_path', 'split_boundary', 'entry_price_mismatch'), true) and e.target is not null as ev))
select research_split, count(*) as candidate_events, count(case when coalesce(reason not in ('missing_holding_path', 'split_boundary', 'entry_price_mismatch'), true) then 1 end) as evaluation_events, count(case when reason is null then 1 end) as accepted_trades, count(case when reason is null and signal > 0 then 1 end) as long_trades,
  round(max(s.ic), 8) as event_spearman from j left join (select research_split, {_pearson('rx + (tx - 1) / 2.0', 'ry + (ty - 1) / 2.0')} as ic from j where ev group by 1) s using (research_split) group by 1""", recursive=True)
def book_evaluation(spark, d):
    """FIL-12, AGG-43: evaluable predictions and their association, of each split."""
    rows, book = _capacity(spark, d)
    joined = stage(book.drop("research_split").join(rows, "article_id"), "book-evaluation")
    ic = metrics.association(joined.where(sequential.evaluable()), "signal", "target", "research_split").select("research_split", "spearman")
    out = joined.groupBy("research_split").agg(F.count("*").alias("candidate_events"), F.count(F.when(sequential.evaluable(), 1)).alias("evaluation_events"), F.count(F.when(F.col("accepted"), 1)).alias("accepted_trades"), F.count(F.when(F.col("accepted") & (F.col("signal") > 0), 1)).alias("long_trades"))
    return rounded(out.join(ic.withColumnRenamed("spearman", "event_spearman"), "research_split", "left"))


# --- statistics ------------------------------------------------------------


@query("""select research_split, count(*) as n, round(sum(signal_weighted * future_return_5d) / sum(signal_weighted * signal_weighted), 8) as slope from ladder where tradable and future_return_5d is not null and (next_split_entry_date is null or exit_date_5d < next_split_entry_date) group by 1""")
def edge_slope(spark, d):
    """AGG-16, FIL-10."""
    rows = signals.with_ladder(views.events(spark, d)).where(F.col("tradable") & splits.unpurged(5)).dropna(subset=["future_return_5d"])
    return rounded(rows.groupBy("research_split").agg(F.count("*").alias("n"), metrics.origin_slope("signal_weighted", "future_return_5d").alias("slope")))


def _normal_p(z: str) -> str:
    """Two-sided normal p-value by the series of positive terms of the error function; below 1e-12 beyond seven deviations."""
    half = f"abs({z}) / sqrt(2)"
    return f"case when abs({z}) > 7 then 0 else 1 - 2 / sqrt(pi()) * exp(-pow({half}, 2)) * list_sum(list_transform(range(150), lambda k: exp(k * ln(2) + (2 * k + 1) * ln(greatest({half}, 1e-300)) - (lgamma(2.0 * k + 2) - k * ln(2) - lgamma(k + 1.0))))) end"


@query(f""", x as (select signal_weighted as x, future_return_5d as y, ticker, entry_date from ladder where tradable and future_return_5d is not null), f as (select count(*) as n, avg(x) as mx, avg(y) as my, covar_pop(x, y) / var_pop(x) as b, var_pop(x) * count(*) as sxx from x
), u as (select *, (x - mx) * (y - my - b * (x - mx)) as u from x, f), a as (select count(*)::double as g, sum(s * s) as m from (select sum(u) as s from u group by ticker)), c as (select count(*)::double as g, sum(s * s) as m from (select sum(u) as s from u group by entry_date)), t as (select count(*)::double as g, sum(s * s) as m from (select sum(u) as s from u group by ticker, entry_date))
select n, round(b, 8) as slope, round(sqrt(va), 8) as se_first, round(b / sqrt(va), 6) as t_first, round({_normal_p('b / sqrt(va)')}, 6) as p_first, round(sqrt(vc), 8) as se_second, round(b / sqrt(vc), 6) as t_second, round({_normal_p('b / sqrt(vc)')}, 6) as p_second, round(sqrt(vb), 8) as se_both, round(b / sqrt(vb), 6) as t_both, round({_normal_p('b / sqrt(vb)')}, 6) as p_both
from (select *, case when va + vc - vt > 0 then va + vc - vt end as vb from (select f.n, b, a.g / (a.g - 1) * ((f.n - 1) / (f.n - 2)::double) * a.m / (sxx * sxx) as va, c.g / (c.g - 1) * ((f.n - 1) / (f.n - 2)::double) * c.m / (sxx * sxx) as vc, t.g / (t.g - 1) * ((f.n - 1) / (f.n - 2)::double) * t.m / (sxx * sxx) as vt from f, a, c, t))""")
def clustered_ols(spark, d):
    """AGG-17."""
    rows = signals.with_ladder(views.events(spark, d)).where("tradable")
    out = rounded(metrics.clustered_slope(rows, "signal_weighted", "future_return_5d", "ticker", "entry_date"))
    return out.select(*(F.round(c, 6).alias(c) if c[:2] in ("t_", "p_") else F.col(c) for c in out.columns))


@query("""select horizon, research_split, round(avg(least(greatest(ret, lo), hi)), 8) as winsorised_mean, round(any_value(p25), 8) as p25, round(any_value(p50), 8) as median, round(any_value(p75), 8) as p75 from (select *, quantile_cont(ret, 0.01) over w as lo, quantile_cont(ret, 0.25) over w as p25, quantile_cont(ret, 0.5) over w as p50, quantile_cont(ret, 0.75) over w as p75, quantile_cont(ret, 0.99) over w as hi
  from long_events where tradable and ret is not null window w as (partition by horizon, research_split)) group by 1, 2""")
def quantile_winsor(spark, d):
    """AGG-18, PRJ-12."""
    rows = metrics.long_returns(views.events(spark, d), views.HORIZONS).where(metrics.usable())
    return rounded(metrics.winsorised_mean(rows, "ret", "horizon", "research_split"))


@query("select sector, horizon, round(avg(m), 8) as equal_mean, count(*) as entities from (select sector, horizon, ticker, avg(sign(score)::double * ret) as m from long_events where tradable and ret is not null group by 1, 2, 3) group by 1, 2")
def company_equal_means(spark, d):
    """AGG-21."""
    rows = metrics.long_returns(views.events(spark, d), views.HORIZONS).where(metrics.usable()).withColumn("signed", F.signum("score") * F.col("ret"))
    return rounded(metrics.mean_of_means(rows, "signed", "ticker", "sector", "horizon"))


_PICK = "('0x' || substr(md5('12345:' || {draw} || ':' || {slot}), 1, 15))::bigint % ({n})"
_BOUNDS = "round(quantile_cont({0}, 0.025), 6) as lower_95, round(quantile_cont({0}, 0.975), 6) as upper_95, count({0}) as draws"


@query(f""", m as (select ticker, avg(sign(score)::double * future_return_5d) as m from events where tradable and future_return_5d is not null group by 1), s as (select m, row_number() over (order by ticker) - 1 as slot, count(*) over () as n from m
), g as (select r.draw, {_PICK.format(draw='r.draw', slot='s.slot', n='s.n')} as pick from s, (select unnest(range(200)) as draw) r), st as (select draw, avg(m) as stat from g join s on s.slot = g.pick group by 1)
select {_BOUNDS.format('stat')} from st""")
def bootstrap_ci(spark, d):
    """AGG-22: resamples of companies."""
    rows = views.events(spark, d).where("tradable").withColumn("signed", F.signum("score") * F.col("future_return_5d"))
    return rounded(resample.mean_interval(rows, "signed", "ticker"), 6)


_RANKED = "(rank() over (partition by draw order by {0}) + count(*) over (partition by draw order by {0})) / 2.0"
_UNPIVOT = "select statistic, " + _BOUNDS.format("value") + " from (unpivot st on columns(* exclude draw) into name statistic value value) group by 1"


@query(f""", u as (select ticker, score, signal_weighted as weighted, future_return_5d as ret, label from ladder where tradable and research_split = 'holdout' and future_return_5d is not null), s as (select ticker, row_number() over (order by ticker) - 1 as slot, count(*) over () as n from (select distinct ticker from u)
), g as (select r.draw, {_PICK.format(draw='r.draw', slot='s.slot', n='s.n')} as pick from s, (select unnest(range(40)) as draw) r), x as (select g.draw, u.* from g join s on s.slot = g.pick join u using (ticker)
), rk as (select *, {_RANKED.format('score')} as rs, {_RANKED.format('weighted')} as rw, {_RANKED.format('ret')} as ry from x), st as (select draw, {_pearson('score', 'ret')} as pearson_ic, {_pearson('rs', 'ry')} as spearman_ic, {_pearson('weighted', 'ret')} as weighted_pearson_ic, {_pearson('rw', 'ry')} as weighted_spearman_ic,
  avg(case when label = 'bullish' then ret end) - avg(case when label = 'bearish' then ret end) as bullish_minus_bearish_spread from rk group by 1) {_UNPIVOT}""")
def company_bootstrap(spark, d):
    """AGG-23: five statistics of the holdout under resampling of companies."""
    rows = signals.with_ladder(views.events(spark, d)).where("tradable and research_split = 'holdout'")
    return rounded(resample.company_intervals(rows, score="score", weighted="signal_weighted", ret="future_return_5d", label="label", entity="ticker", draws=40, seed=12345), 6)


@query(f""", u as (select entry_date, signal_weighted as x, future_return_21d as ret from ladder where tradable and research_split = 'holdout' and future_return_21d is not null), s as (select entry_date, row_number() over (order by entry_date) - 1 as slot, count(*) over () as n from (select distinct entry_date from u)
), b as (select r.draw, b.b, {_PICK.format(draw='r.draw', slot='b.b', n='b.n - 21 + 1')} as start, b.n from (select distinct n, unnest(range(cast(ceil(n / 21.0) as bigint))) as b from (select any_value(n) as n from s) where n >= 42) b, (select unnest(range(40)) as draw) r
), x as (select b.draw, u.* from b, (select unnest(range(21)) as j) j join s on s.slot = b.start + j.j join u using (entry_date) where b.b * 21 + j.j < b.n
), rk as (select *, {_RANKED.format('x')} as rx, {_RANKED.format('ret')} as ry from x), st as (select draw, {_pearson('x', 'ret')} as pearson_ic, {_pearson('rx', 'ry')} as spearman_ic, avg(sign(x)::double * ret) as signed_return from rk group by 1) {_UNPIVOT}""")
def date_block_bootstrap(spark, d):
    """AGG-24: blocks of 21 dates of the holdout."""
    rows = signals.with_ladder(views.events(spark, d)).where("tradable and research_split = 'holdout'")
    return rounded(resample.date_block_intervals(rows, signal="signal_weighted", ret="future_return_21d", date="entry_date", horizon=21, draws=40, seed=12345), 6)


def _sql_p(r: str, n: str) -> str:
    """Two-sided p-value of a correlation r of n pairs by the finite sums for whole degrees of freedom."""
    even = f"abs({r}) * list_sum(list_transform(range(cast(({n} - 2) / 2 as bigint)), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1.0) - lgamma(0.5)) * pow(1 - {r} * {r}, k)))"
    odd = f"2 / pi() * (asin(abs({r})) + abs({r}) * sqrt(1 - {r} * {r}) * coalesce(list_sum(list_transform(range(cast(({n} - 3) / 2 as bigint)), lambda k: exp(lgamma(k + 1.0) + lgamma(1.5) - lgamma(k + 1.5)) * pow(1 - {r} * {r}, k))), 0))"
    return f"case when {n} < 3 or {r} is null then null when abs({r}) >= 1 then 0 when {n} % 2 = 0 then 1 - {even} else 1 - {odd} end"


_GRID = specification.Grid()


@query(f""", cell as (select c.i as ci, c.v as c, r.i as ri, r.v as r, m.i as mi, m.v as m from (values (0, 0.0), (1, 0.5), (2, 0.7)) c(i, v), (values (0, 0.0), (1, 0.5), (2, 0.7)) r(i, v), (values (0, 0.0), (1, 0.25), (2, 0.5)) m(i, v)
), e as (select l.*, cell.* from ladder l, cell where tradable and not abstain and research_split <> 'holdout' and confidence >= c and relevance >= r and materiality >= m
), sg as (select *, 0 as signal, signal_raw as x from e union all select *, 1, signal_confidence from e union all select *, 2, signal_weighted from e union all select *, 3, signal_novel from e
), ag as (select *, 0 as agg, x as v from sg union all select *, 1, x from sg qualify row_number() over (partition by ci, ri, mi, signal, research_split, ticker, entry_date order by abs(x) desc, article_id) = 1
  union all select *, 2, avg(x) over (partition by ci, ri, mi, signal, research_split, ticker, entry_date) from sg qualify row_number() over (partition by ci, ri, mi, signal, research_split, ticker, entry_date order by article_id) = 1
), lg as (select (((signal * 3 + agg) * 3 + ci) * 3 + ri) * 3 + mi as spec_id, research_split, 5 as horizon, v as x, future_return_5d as y from ag where next_split_entry_date is null or exit_date_5d < next_split_entry_date
  union all select (((signal * 3 + agg) * 3 + ci) * 3 + ri) * 3 + mi, research_split, 21, v, future_return_21d from ag where next_split_entry_date is null or exit_date_21d < next_split_entry_date
), rk as (select *, rank() over (partition by spec_id, research_split, horizon order by x) + (count(*) over (partition by spec_id, research_split, horizon, x) - 1) / 2.0 as rx, rank() over (partition by spec_id, research_split, horizon order by y) + (count(*) over (partition by spec_id, research_split, horizon, y) - 1) / 2.0 as ry from lg where x is not null and y is not null
), a as (select spec_id, research_split, horizon, count(*) as n, {_pearson('rx', 'ry')} as ic, avg(sign(x)::double * y) as sr from rk group by 1, 2, 3), ap as (select *, {_sql_p('ic', 'n')} as p from a
), w as (select spec_id, max(case when research_split = 'validation' and horizon = 5 then n end) as n5, max(case when research_split = 'validation' and horizon = 21 then n end) as n21, max(case when research_split = 'validation' and horizon = 5 then ic end) as v5, max(case when research_split = 'validation' and horizon = 21 then ic end) as v21,
  max(case when research_split = 'development' and horizon = 5 then ic end) as d5, max(case when research_split = 'development' and horizon = 21 then ic end) as d21, max(case when research_split = 'validation' and horizon = 5 then p end) as p5, max(case when research_split = 'validation' and horizon = 21 then p end) as p21,
  max(case when research_split = 'validation' and horizon = 5 and ic is not null then sr end) as s5, max(case when research_split = 'validation' and horizon = 21 and ic is not null then sr end) as s21 from ap group by 1
), f as (select i as spec_id, w.* exclude spec_id, least(coalesce(n5, 0), coalesce(n21, 0)) as n, coalesce(least(coalesce(n5, 0), coalesce(n21, 0)) / (select count(*) from events where research_split = 'validation')::double, 0) as coverage, coalesce(v5 > 0 and v21 > 0 and d5 > 0 and d21 > 0, false) as consistent, case when p5 is not null and p21 is not null then least(1.0, 2 * least(p5, p21)) end as p from range(324) t(i) left join w on w.spec_id = i
), u as (select *, 0.45::double * (v5 + v21) / 2 + 0.25::double * (d5 + d21) / 2 + 20 * (s5 + s21) / 2 + 0.1::double * coverage - case when consistent then 0 else 0.25::double end as utility from f
), k as (select *, row_number() over (order by p, spec_id) as k, count(*) over () as m from u where p is not null), q as (select spec_id, least(1.0, min(p * m / k) over (order by k rows between current row and unbounded following)) as q_value from k
), z as (select u.*, q.q_value, utility is not null and coverage >= 0.25 and n >= 100 as eligible from u left join q using (spec_id)), best as (select spec_id as b from z where eligible order by utility desc, spec_id limit 1)
select z.spec_id, n, round(v5, 6) as val_ic_5d, round(v21, 6) as val_ic_21d, round(d5, 6) as dev_ic_5d, round(d21, 6) as dev_ic_21d, round(p, 6) as p, round(q_value, 6) as q_value, round(coverage, 6) as coverage, consistent, round(utility, 6) as utility, eligible, spec_id = b as selected,
  eligible and spec_id // 27 = b // 27 and abs(spec_id // 9 % 3 - b // 9 % 3) + abs(spec_id // 3 % 3 - b // 3 % 3) + abs(spec_id % 3 - b % 3) = 1 as neighbour from z, best""")
def spec_search(spark, d):
    """JOI-12, SEL-4/6, WIN-8, FIL-7, AGG-2/14: 324 candidates in one grouped pass."""
    rows = signals.with_ladder(views.events(spark, d))
    specification.check(_GRID, rows.columns)
    out = specification.search(rows, _GRID)
    return rounded(out.select("spec_id", "n", "val_ic_5d", "val_ic_21d", "dev_ic_5d", "dev_ic_21d", "p", "q_value", "coverage", "consistent", "utility", "eligible", "selected", "neighbour"), 6)


@query(""", o as (select *, row_number() over (order by ts, article_id) - 1 as i, count(*) over () as n from events where exit_date_5d is not null), f as (select *, least(floor(i / floor(n / 5)), 4)::integer as fold from o), b as (select fold, min(ts) as validation_start, max(ts) as validation_end, count(*) as n_validation from f where fold > 0 group by 1)
select b.fold, validation_start, validation_end, n_validation, (select count(*) from f where f.fold < b.fold and cast(f.exit_date_5d as timestamp) < b.validation_start) as n_train, validation_end + interval 3 days as embargo_end from b""", text="validation_start validation_end embargo_end")
def walk_forward_folds(spark, d):
    """WIN-13."""
    rows = views.events(spark, d).where("exit_date_5d is not null").withColumn("outcome_end", F.col("exit_date_5d").cast("timestamp_ntz")).drop("chronological_index")
    return splits.walk_forward(rows, "ts", "outcome_end", "article_id", folds=5, embargo_days=3)


@query(""", r as (select ticker, date, session, adjusted_close, ln(adjusted_close / lag(adjusted_close) over (partition by ticker order by date)) as dl from timeline), m as (select ticker, date, session, adjusted_close, avg(adjusted_close) over (partition by ticker order by date rows 99 preceding) as mean, stddev_samp(dl) over (partition by ticker order by date rows 98 preceding) as vol from r)
select ticker, date, case when session < 101 then null when adjusted_close >= mean then case when vol > 0.9 then 0.5 else 1.0 end else 0.0 end::double as regime from m""", text="date")
def regime(spark, d):
    """WIN-9."""
    w = Window.partitionBy("ticker").orderBy("date")
    rows = views.timeline(spark, d).withColumn("dl", F.log(F.col("adjusted_close") / F.lag("adjusted_close").over(w)))
    mean, vol = F.avg("adjusted_close").over(w.rowsBetween(-99, 0)), F.stddev_samp("dl").over(w.rowsBetween(-98, 0))
    state = F.when(F.col("session") < 101, None).when(F.col("adjusted_close") >= mean, F.when(vol > 0.9, 0.5).otherwise(1.0)).otherwise(0.0)
    return rows.select("ticker", "date", state.cast("double").alias("regime"))


@query(f""", b as (select cast(o_orderkey as varchar) as article_id, ((o_orderkey * 43) % 201 - 100) / 100.0::double as score2, o_orderkey % 7 <> 0 as tradable2, case when o_orderkey % 3 = 0 then '5-LOW' else o_orderpriority end as event_type2, case when (o_orderkey * 43) % 201 - 100 > 25 then 'bullish' when (o_orderkey * 43) % 201 - 100 < -25 then 'bearish' else 'neutral' end as label2 from orders
), j as (select * from events join b using (article_id)) select research_split, count(*) as n, round(avg((label = label2)::int), 8) as label_agreement, round(avg((tradable = tradable2)::int), 8) as tradable_agreement, round(avg((event_type = event_type2)::int), 8) as event_type_agreement,
  count(case when label <> 'neutral' and label2 <> 'neutral' then 1 end) as directional_n, round(avg(case when label <> 'neutral' and label2 <> 'neutral' then (label = label2)::int end), 8) as directional_agreement, round({_pearson('score', 'score2')}, 8) as score_correlation,
  count(case when tradable and tradable2 then 1 end) as both_tradable, count(case when tradable and not tradable2 then 1 end) as first_only, count(case when not tradable and tradable2 then 1 end) as second_only, round(avg(confidence - relevance), 8) as mean_difference from j group by 1""")
def rater_agreement(spark, d):
    """AGG-31, JOI-1."""
    j = contracts.one_to_one(views.events(spark, d), views.second_rater(spark, d), "article_id")
    share = lambda ok: F.avg(ok.cast("double"))
    directional = (F.col("label") != "neutral") & (F.col("label2") != "neutral")
    same = F.col("label") == F.col("label2")
    cross = lambda a, b: F.count(F.when((F.col("tradable") == a) & (F.col("tradable2") == b), 1))
    return rounded(j.groupBy("research_split").agg(
        F.count("*").alias("n"), share(same).alias("label_agreement"), share(F.col("tradable") == F.col("tradable2")).alias("tradable_agreement"), share(F.col("event_type") == F.col("event_type2")).alias("event_type_agreement"),
        F.count(F.when(directional, 1)).alias("directional_n"), F.avg(F.when(directional, same.cast("double"))).alias("directional_agreement"), metrics.correlation(F.col("score"), F.col("score2")).alias("score_correlation"),
        cross(True, True).alias("both_tradable"), cross(True, False).alias("first_only"), cross(False, True).alias("second_only"), F.avg(F.col("confidence") - F.col("relevance")).alias("mean_difference"),
    ))


@query("""select event_type, count(*) as n, count(*) < greatest(50, (select count(*) from events) // 100) as rare from events group by 1""")
def rare_event_types(spark, d):
    """AGG-34, AGG-9."""
    df = views.events(spark, d)
    total = df.agg(F.count("*").alias("t"))
    return df.groupBy("event_type").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("event_type", "n", (F.col("n") < F.greatest(F.lit(50), F.floor(F.col("t") / 100))).alias("rare"))


@query("""select user_id, round(sum(energy), 6) as energy, round(avg(value), 8) as mean_power, max(value) as max_power from (select user_id, value, (value + lag(value) over w) / 2 * epoch(ts - lag(ts) over w) as energy from events_raw window w as (partition by user_id order by ts, event_id)) group by 1""".replace("events_raw", "events"), base=False)
def energy_integral(spark, d):
    """AGG-30."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))) / 1e6
    rows = views.table(spark, d, "events").withColumn("energy", (F.col("value") + F.lag("value").over(w)) / 2 * seconds)
    return rows.groupBy("user_id").agg(F.round(F.sum("energy"), 6).alias("energy"), r8(F.avg("value")).alias("mean_power"), F.max("value").alias("max_power"))


@query(_BOOK + f""", s as (select net_return as r, row_number() over (order by date) - 1 as slot, count(*) over () as n from book), g as (select d.draw, {_PICK.format(draw='d.draw', slot='b.b', n='b.n - 5 + 1')} + j.j as slot from (select distinct n, unnest(range(cast(ceil(n / 5.0) as bigint))) as b from (select any_value(n) as n from s)) b, (select unnest(range(200)) as draw) d, (select unnest(range(5)) as j) j where b.b * 5 + j.j < b.n
), st as (select draw, case when count(*) >= 2 and stddev_samp(r) > 1e-12 then avg(r) / stddev_samp(r) * sqrt(252) end as stat from g join s using (slot) group by 1) select {_BOUNDS.format('stat')} from st""")
def sharpe_interval(spark, d):
    """AGG-25: session blocks."""
    return rounded(resample.block_sharpe_interval(_book(spark, d), "net_return"), 6)


@query(""", p as (select article_id, ticker, score, row_number() over (partition by ticker order by article_id) as n, row_number() over (partition by ticker order by md5('9:' || article_id), article_id) as m from events) select a.article_id, b.score as placebo from p a join p b on a.ticker = b.ticker and a.n = b.m""")
def placebo_signal(spark, d):
    """WIN-10."""
    return metrics.permute_within(views.events(spark, d).select("article_id", "ticker", "score"), "score", "placebo", key="article_id", seed=9, group="ticker").select("article_id", "placebo")


@query(f""", u as (select research_split, horizon, signal_weighted as x, score * confidence as c, ret from long_events where tradable and not abstain and ret is not null), rk as (select *, rank() over w as rx0, count(*) over (partition by research_split, horizon, x) as tx, rank() over v as ry0, count(*) over (partition by research_split, horizon, ret) as ty from u window w as (partition by research_split, horizon order by x), v as (partition by research_split, horizon order by ret)
), a as (select research_split, horizon, count(*) as n, {_pearson('x', 'ret')} as pearson, {_pearson('rx0 + (tx - 1) / 2.0', 'ry0 + (ty - 1) / 2.0')} as spearman, {_pearson('c', 'ret')} as confidence_pearson from rk group by 1, 2)
select research_split, horizon, n, round(pearson, 8) as pearson, round(spearman, 8) as spearman, round(confidence_pearson, 8) as confidence_pearson, round({_sql_p('pearson', 'n')}, 6) as pearson_p, round({_sql_p('spearman', 'n')}, 6) as spearman_p from a""")
def ic_pvalues(spark, d):
    """AGG-14/15: p-values of each split's correlations, and the confidence-weighted one."""
    rows = metrics.long_returns(signals.with_ladder(views.events(spark, d)), views.HORIZONS).where(metrics.usable())
    ic = metrics.association(rows, "signal_weighted", "ret", "research_split", "horizon")
    own = rows.groupBy("research_split", "horizon").agg(metrics.correlation(F.col("signal_confidence"), F.col("ret")).alias("confidence_pearson"))
    out = ic.join(own, ["research_split", "horizon"]).withColumns({f"{c}_p": correlation_p(c, "n") for c in ("pearson", "spearman")})
    return rounded(out).withColumns({f"{c}_p": F.round(f"{c}_p", 6) for c in ("pearson", "spearman")})
