"""DuckDB text of the canonical tables, put before each query's own SQL."""

from __future__ import annotations

BASE = """
prices as (
  select 'S' || lpad(cast(l_suppkey as varchar), 5, '0') as ticker, cast(l_shipdate as date) as date, min(l_extendedprice / l_quantity) as open, max(l_extendedprice / l_quantity) as high,
    min(l_extendedprice / l_quantity) as low, max(l_extendedprice / l_quantity) as close, max(l_extendedprice / l_quantity * (1 - l_discount / 10)) as adjusted_close, cast(sum(cast(l_quantity as bigint)) as bigint) as volume
  from lineitem where l_quantity > 0 group by 1, 2
), timeline as (
  select *, row_number() over w - 1 as session, case when close > 0 then open * adjusted_close / close end as adj_open,
    date as exit_date_1d, adjusted_close as exit_close_1d, lead(date, 4) over w as exit_date_5d, lead(adjusted_close, 4) over w as exit_close_5d, lead(date, 20) over w as exit_date_21d, lead(adjusted_close, 20) over w as exit_close_21d
  from prices window w as (partition by ticker order by date)
), articles as (
  select cast(o_orderkey as varchar) as article_id, o_orderkey as k, 'S' || lpad(cast(s_suppkey as varchar), 5, '0') as ticker, r_name as sector, o_orderpriority as event_type,
    o_orderdate + to_seconds((o_orderkey * 7919) % 86400) as ts, ((o_orderkey * 37) % 201 - 100) / 100.0::double as score, ((o_orderkey * 17) % 101) / 100.0::double as confidence, ((o_orderkey * 29) % 101) / 100.0::double as relevance,
    ((o_orderkey * 41) % 101) / 100.0::double as materiality, ((o_orderkey * 53) % 101) / 100.0::double as novelty, o_orderkey % 5 = 0 as abstain, o_orderkey % 5 <> 0 as tradable,
    case when ((o_orderkey * 37) % 201 - 100) > 25 then 'bullish' when ((o_orderkey * 37) % 201 - 100) < -25 then 'bearish' else 'neutral' end as label,
    cast(((o_orderdate + to_seconds((o_orderkey * 7919) % 86400)) at time zone 'UTC') at time zone 'America/New_York' as date) as pub_date
  from orders left join supplier on s_suppkey = o_orderkey % (select count(*) from supplier) left join nation on n_nationkey = s_nationkey left join region on r_regionkey = n_regionkey
), aligned as (
  select a.*, t.date as entry_date, t.session, t.adj_open, t.exit_date_1d, t.exit_date_5d, t.exit_date_21d, t.exit_close_1d / t.adj_open - 1 as future_return_1d, t.exit_close_5d / t.adj_open - 1 as future_return_5d, t.exit_close_21d / t.adj_open - 1 as future_return_21d
  from articles a asof left join timeline t on a.ticker = t.ticker and a.pub_date < t.date
), ranked as (
  select *, row_number() over (order by ts, ticker, article_id) - 1 as chronological_index, count(*) over () as total from aligned where entry_date is not null
), parted as (
  select *, case when chronological_index * 100 < total * 60 then 'development' when chronological_index * 100 < total * 80 then 'validation' else 'holdout' end as research_split from ranked
), events as (
  select *, case research_split when 'development' then (select min(entry_date) from parted where research_split = 'validation') when 'validation' then (select min(entry_date) from parted where research_split = 'holdout') end as next_split_entry_date from parted
), ladder as (
  select *, score as signal_raw, score * confidence as signal_confidence, score * confidence * materiality as signal_weighted, score * confidence * materiality * novelty as signal_novel from events
), long_events as (
  select e.*, h.horizon, case h.horizon when 1 then future_return_1d when 5 then future_return_5d else future_return_21d end as ret from ladder e cross join (select unnest([1, 5, 21]) as horizon) h
)"""


def with_base(sql: str, recursive: bool = False) -> str:
    """``sql`` after the canonical tables; its own CTEs, if any, begin with a comma."""
    return f"with {'recursive ' if recursive else ''}{BASE.strip()}\n{sql.strip()}"
