"""Queries over the study's records: samples, contracts, decisions, caches, ledgers, frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import cascade, contracts, frames, metrics, portfolio, selection, signals
from ..staging import stage
from . import decisions, views
from .catalog import _BOOK, _days, _pearson, query, rounded
from .catalog_text import _REQUESTS, _requests

# --- samples ---------------------------------------------------------------

_TYPES = ("earnings", "guidance", "other", "product", "litigation", "merger")
_CANDIDATES = """, cand as (select article_id, ticker, sector, label, confidence, abstain, ts, year(ts) as year, quarter(ts) as quarter, ['earnings', 'guidance', 'other', 'product', 'litigation', 'merger'][k * 7 % 11 % 6 + 1] as event_type, relevance as score, sha256('7:' || article_id) as hash from articles)"""
_RANK = "'s': -c.score, 'h': c.hash, 'w': c.article_id"
_STRUCT = "{'a': c.article_id, 'e': c.event_type, 'q': c.quarter, 'y': c.year}"
_YEARLY = _CANDIDATES + f""", yres as (select ticker, year, list({_STRUCT} order by -score, hash, article_id)[:2] as picked from cand c where event_type in ('earnings', 'guidance') group by 1, 2
), ypick as (select g.ticker, g.year, coalesce(len(r.picked), 0)::integer as n, coalesce(r.picked, []) as picked from (select distinct ticker, year from cand) g left join yres r using (ticker, year)
  union all select p.ticker, p.year, p.n + 1, any_value(p.picked) || [arg_min({_STRUCT}, {{'o': c.event_type = 'other', 'x': len(list_filter(p.picked, lambda x: x.e = c.event_type)), 'z': len(list_filter(p.picked, lambda x: x.q = c.quarter)), {_RANK}}})] from ypick p join cand c using (ticker, year) where p.n < 5 and not list_contains(list_transform(p.picked, lambda x: x.a), c.article_id) group by p.ticker, p.year, p.n
), yearly as (select ticker, year, u.a as article_id, u.e as event_type, i - 1 as pick from (select ticker, year, unnest(picked) as u, generate_subscripts(picked, 1) as i from (select ticker, year, picked from ypick qualify row_number() over (partition by ticker, year order by n desc) = 1)))"""


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("k") * 7 % 11 % 6 + 1).cast("int"))
    return views.articles(spark, d).select("article_id", "ticker", "sector", "label", "confidence", "abstain", "ts", kind.alias("event_type"), F.col("relevance").alias("score"), tx.seeded_rank_key(7, F.col("article_id")).alias("hash"))


@query(_YEARLY + " select ticker, cast(year as integer) as year, article_id, pick from yearly", recursive=True)
def yearly_sample(spark, d):
    """SEL-8, SCA-23, STA-3."""
    return selection.yearly_pick(_candidates(spark, d), count=5, reserve=2)


@query(_YEARLY + f""", bheld as (select ticker, list({{'a': article_id, 'e': event_type, 'y': year}}) as held, count(*) as n0 from yearly where pick < 2 group by 1
), bpick as (select ticker, n0 as n, 0 as m, held, []::varchar[] as added from bheld
  union all select p.ticker, p.n + 1, p.m + 1, any_value(p.held) || [arg_min({{'a': c.article_id, 'e': c.event_type, 'y': c.year}}, {{'x': len(list_filter(p.held, lambda x: x.y = c.year)), 'o': c.event_type = 'other', 'z': len(list_filter(p.held, lambda x: x.e = c.event_type)), {_RANK}}})], any_value(p.added) || [arg_min(c.article_id, {{'x': len(list_filter(p.held, lambda x: x.y = c.year)), 'o': c.event_type = 'other', 'z': len(list_filter(p.held, lambda x: x.e = c.event_type)), {_RANK}}})] from bpick p join cand c using (ticker)
  where p.n < 20 and not list_contains(list_transform(p.held, lambda x: x.a), c.article_id) group by p.ticker, p.n, p.m
) select ticker, unnest(added) as article_id, generate_subscripts(added, 1) - 1 as pick from (select ticker, added from bpick qualify row_number() over (partition by ticker order by m desc) = 1)""", recursive=True)
def backfill_sample(spark, d):
    """SEL-9, JOI-7/8, STA-3."""
    rows = _candidates(spark, d)
    yearly = selection.yearly_pick(rows, count=5, reserve=2).where("pick < 2")
    return selection.backfill_pick(rows, stage(yearly, "yearly-sample"), total=20)


_BUCKETS = _CANDIDATES + """, rare as (select event_type from cand group by 1 having count(*) < greatest(50, (select count(*) from cand) // 100)), bk as (select *, case when len(f) > 0 then f else ['general_calibration'] end as buckets from (select *, list_filter([case when label = 'bullish' and confidence >= 0.8 then 'high_confidence_bullish' end, case when label = 'bearish' and confidence >= 0.8 then 'high_confidence_bearish' end, case when abstain then 'local_abstention' end, case when confidence < 0.55 then 'low_confidence' end, case when event_type in (select event_type from rare) then 'rare_event_type' end], lambda x: x is not null) as f from cand))"""


def _bucketed(spark: SparkSession, d: str) -> DataFrame:
    rows = _candidates(spark, d)
    rare = selection.rare_types(rows, "event_type").withColumn("rare", F.lit(True))
    rows = rows.join(F.broadcast(rare), "event_type", "left").withColumn("buckets", selection.calibration_buckets(F.coalesce("rare", F.lit(False))))
    return rows.withColumn("rank", tx.seeded_rank_key(11, F.col("article_id"), F.col("ticker"), F.array_join("buckets", ",")))


@query(_BUCKETS + " select article_id, array_to_string(buckets, ',') as buckets, sha256('11:' || article_id || ':' || ticker || ':' || array_to_string(buckets, ',')) as rank from bk")
def calibration_buckets(spark, d):
    """SCA-16, AGG-34, SEL-2."""
    return _bucketed(spark, d).select("article_id", F.array_join("buckets", ",").alias("buckets"), "rank")


@query()
def quota_sample(spark, d):
    """SEL-10, STA-3: caps over all tickers and sectors; tested against the rule itself."""
    return selection.quota_sample(_bucketed(spark, d), most=250, per_ticker=4, per_sector=60)


@query(_YEARLY + """, s as (select y.ticker, y.article_id, y.article_id || 'c' as cluster, y.event_type, y.year from yearly y), p as (select ticker, count(*) as n, count(distinct article_id) as ids, count(distinct cluster) as clusters, count(case when event_type in ('earnings', 'guidance') then 1 end) as reserved, count(case when event_type = 'other' then 1 end) as other, count(distinct year) as years from s group by 1)
select sum(n) = 1000 as size, sum(n) = sum(ids) as unique_ids, sum(n) = sum(clusters) as unique_clusters, sum(reserved) >= 100 as reserved, sum(other) <= 0.25 * sum(n) as other, min(years) >= 2 as years from p""", recursive=True)
def sample_invariants(spark, d):
    """VAL-10."""
    rows = _candidates(spark, d)
    chosen = rows.join(selection.yearly_pick(rows, count=5, reserve=2).select("article_id"), "article_id").withColumn("cluster_id", F.concat("article_id", F.lit("c")))
    return selection.check_sample(chosen, size=1000, least_reserved=100, most_other=0.25, least_years=2)


# --- contracts -------------------------------------------------------------

_LIST = "array_to_string(list_filter([{0}], lambda x: x is not null), ',')"


def _broken(rules: dict[str, str]) -> str:
    return _LIST.format(", ".join(f"case when not coalesce({ok}, false) then '{name}' end" for name, ok in rules.items()))


_SIGN = "case label when 'bullish' then score > 0 when 'bearish' then score < 0 when 'neutral' then abs(score) <= 0.25 else false end"
_UNITS = {f"{c}_range": f"{c} between 0 and 1" for c in ("confidence", "relevance", "materiality", "novelty")}
_JUDGED = """, j as (select *, case when k % 5 = 0 and k % 4 <> 0 then ' too  thin ' when k % 19 = 0 then 'none' when k % 5 = 0 and k % 8 = 0 then '  ' end as abstain_reason, repeat('word ', (k % 31)::integer) as reasoning, case when k % 6 = 0 then null else 'Acme' end as company, case k % 4 when 0 then 'positive' when 1 then 'negative' when 2 then 'none' else 'unclear' end as direction, case when k % 7 = 0 then '' else 'facts' end as facts, ((k * 59) % 101) / 100.0::double as specificity, case when k % 9 = 0 then 'other' else event_type end as kind from articles)"""


def _judged(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    reason = F.when((k % 5 == 0) & (k % 4 != 0), " too  thin ").when(k % 19 == 0, "none").when((k % 5 == 0) & (k % 8 == 0), "  ")
    return views.articles(spark, d).withColumns({
        "abstain_reason": reason, "reasoning": F.repeat(F.lit("word "), (k % 31).cast("int")), "company": F.when(k % 6 != 0, "Acme"), "direction": F.element_at(F.array(*map(F.lit, ("positive", "negative", "none", "unclear"))), (k % 4 + 1).cast("int")),
        "facts": F.when(k % 7 == 0, "").otherwise("facts"), "specificity": ((k * 59) % 101) / F.lit(100.0), "kind": F.when(k % 9 == 0, "other").otherwise(F.col("event_type")),
    })


_REASON = "nullif(trim(regexp_replace(abstain_reason, '\\s+', ' ', 'g')), '')"


@query(_JUDGED + f" select article_id, {_broken({'score_range': 'score between -1 and 1', **_UNITS, 'label_sign': _SIGN, 'tradable_abstain': 'tradable <> abstain', 'reasoning_words': 'len(list_filter(split(trim(reasoning), chr(32)), lambda x: x <> chr(32) and length(x) > 0)) between 1 and 25', 'reason_if_abstaining': f'abstain = ({_REASON} is not null)'})} as violations from j")
def local_contract(spark, d):
    """VAL-2/3, SCA-29."""
    return _judged(spark, d).select("article_id", F.array_join(contracts.violations(contracts.local_rules()), ",").alias("violations"))


_WEAK = "(kind = 'other' or company is null or company = '' or specificity < 0.7 or relevance < 0.7 or materiality < 0.7 or facts is null or facts = '' or direction in ('none', 'unclear'))"


_SURPRISE = {"weak_must_abstain": f"not {_WEAK} or abstain", "reason_if_abstaining": f"abstain = ({_REASON} is not null)", "direction_sign": "case when direction = 'positive' then score > 0 when direction = 'negative' then score < 0 else true end"}


@query(_JUDGED + f" select article_id, {_broken(_SURPRISE)} as violations from j")
def surprise_contract(spark, d):
    """VAL-4."""
    return _judged(spark, d).select("article_id", F.array_join(contracts.violations(contracts.surprise_rules()), ",").alias("violations"))


_USAGE = """with u as (select conv_id, turn, octet_length(encode(coalesce(text, '')))::bigint as input_tokens, (octet_length(encode(coalesce(text, ''))) * (conv_id % 5) // 3)::bigint as cached_input_tokens, (turn * 40)::bigint as output_tokens, (turn * 40 + conv_id % 7 - 5)::bigint as reasoning_tokens from conversations)"""


def _usage(spark: SparkSession, d: str) -> DataFrame:
    n = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    turn, conv = F.col("turn").cast("long"), F.col("conv_id")
    return views.table(spark, d, "conversations").select("conv_id", "turn", n.alias("input_tokens"), F.floor(n * (conv % 5) / 3).cast("long").alias("cached_input_tokens"), (turn * 40).alias("output_tokens"), (turn * 40 + conv % 7 - 5).cast("long").alias("reasoning_tokens"))


@query(_USAGE + f" select conv_id, turn, {_broken({'input_tokens_negative': 'input_tokens >= 0', 'cached_input_tokens_negative': 'cached_input_tokens >= 0', 'output_tokens_negative': 'output_tokens >= 0', 'reasoning_tokens_negative': 'reasoning_tokens >= 0', 'cached_exceed_input': 'cached_input_tokens <= input_tokens', 'reasoning_exceed_output': 'reasoning_tokens <= output_tokens'})} as violations, round((input_tokens - least(cached_input_tokens, input_tokens)) * 0.25 / 1e6 + least(cached_input_tokens, input_tokens) * 0.025 / 1e6 + output_tokens * 2.0 / 1e6, 12)::double as billed, round(input_tokens * 0.25 / 1e6 + 400 * 2.0 / 1e6, 12)::double as ceiling from u", base=False)
def usage_contract(spark, d):
    """VAL-5, SCA-30."""
    rows = _usage(spark, d)
    cached = F.least("cached_input_tokens", "input_tokens")
    return rows.select("conv_id", "turn", F.array_join(contracts.violations(contracts.usage_rules()), ",").alias("violations"), F.round(tx.billed_cost(F.col("input_tokens"), cached, F.col("output_tokens"), 0.25, 0.025, 2.0), 12).alias("billed"), F.round((F.col("input_tokens") * 0.25 + 400 * 2.0) / 1e6, 12).alias("ceiling"))


@query(_JUDGED + f""", r as (select article_id, sha256(article_id) as h0, case when k % 10 = 0 then left(sha256(article_id), 60) else sha256(article_id) end as article_hash, case when k % 17 = 0 then 1.5 else confidence end as confidence, relevance, materiality, novelty, score, case when k % 13 = 0 then 'odd' else event_type end as event_type, abstain, reasoning, k % 29 <> 0 as valid_json from j)
select article_id, {_broken({'valid_json': 'valid_json', 'article_hash': 'length(article_hash) = 64', **_UNITS, 'score_range': 'score between -1 and 1', 'event_type': "event_type in ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW')", 'abstain': 'abstain is not null', 'evidence': 'reasoning is not null', 'source_hash': 'article_hash = h0'})} as errors from r""")
def inference_contract(spark, d):
    """VAL-6/7, JOI-15: row contract and the hash of the source."""
    k = F.col("k")
    rows = _judged(spark, d).withColumn("source_hash", F.sha2("article_id", 256))
    rows = rows.withColumns({"article_hash": F.when(k % 10 == 0, F.substring("source_hash", 1, 60)).otherwise(F.col("source_hash")), "confidence": F.when(k % 17 == 0, 1.5).otherwise(F.col("confidence")), "event_type": F.when(k % 13 == 0, "odd").otherwise(F.col("event_type")), "valid_json": k % 29 != 0})
    types = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    return rows.select("article_id", F.array_join(contracts.violations(contracts.inference_rules(types) | {"source_hash": F.col("article_hash") == F.col("source_hash")}), ",").alias("errors"))


@query("""with r as (select o_orderpriority as run, o_orderkey % 37 = 0 as failed, o_orderkey % 3 = 0 as other, o_orderkey % 5 <> 0 as tradable, case when o_orderkey % 11 < 9 then 'bullish' else 'bearish' end as label, (o_orderkey * 7919 % 1000) / 10.0::double as seconds from orders), l as (select run, max(n) as top from (select run, label, count(*) as n from r where not failed group by 1, 2) group by 1
), m as (select run, count(*) as processed, count(case when failed then 1 end) as bad, count(case when not failed and other then 1 end) as other, count(case when not failed and tradable then 1 end) as tradable, count(case when not failed then 1 end) as ok, sum(seconds) as elapsed from r group by 1)
select run, processed, array_to_string(case when processed < 500 then [] else list_filter([case when bad / processed > 0.02 then 'invalid_output' end, case when other / ok > 0.30 then 'other_share' end, case when tradable / ok < 0.25 then 'tradable_share' end, case when top / ok > 0.80 then 'label_share' end, case when elapsed / processed * 100000 / 86400 > 50 then 'projected_days' end], lambda x: x is not null) end, ',') as failures from m join l using (run)""", base=False)
def run_gates(spark, d):
    """VAL-9."""
    k = F.col("o_orderkey")
    rows = views.table(spark, d, "orders").select(F.col("o_orderpriority").alias("run"), (k % 37 == 0).alias("failed"), F.when(k % 3 == 0, "other").otherwise("named").alias("event_type"), (k % 5 != 0).alias("tradable"), F.when(k % 11 < 9, "bullish").otherwise("bearish").alias("label"), ((k * 7919 % 1000) / 10.0).alias("seconds"))
    return contracts.run_gates(rows, "run", total=100_000, most_other=0.30, most_label=0.80, most_days=50.0)


# --- decisions -------------------------------------------------------------

_METRICS = """with m as (select o_orderkey as id, (o_orderkey * 37 % 41 - 10) / 40.0::double as ic5, (o_orderkey * 43 % 41 - 10) / 40.0::double as ic21, (o_orderkey * 47 % 41 - 8) / 40.0::double as sr5, (o_orderkey * 53 % 41 - 8) / 40.0::double as sr21, (o_orderkey * 59 % 41 - 25) / 40.0::double as base5, case when o_orderkey % 13 = 0 then null else (o_orderkey * 61 % 41 - 25) / 40.0::double end as base21, (o_orderkey * 67 % 41 - 6) / 40.0::double as ret5, (o_orderkey * 71 % 41 - 6) / 40.0::double as ret21,
  (o_orderkey * 73 % 41 - 4) / 20.0::double as sharpe5, (o_orderkey * 79 % 41 - 4) / 20.0::double as sharpe21, (o_orderkey * 83 % 41) / 40.0::double as coverage, (o_orderkey * 89 % 41 - 5) / 40.0::double as low5, case when o_orderkey % 17 = 0 then null else (o_orderkey * 97 % 41 - 5) / 40.0::double end as low21, (o_orderkey * 101 % 41) / 40.0::double as nearby, (o_orderkey * 103 % 41) / 100.0::double as hhi, o_orderkey * 107 % 61 as trades, (o_orderkey * 109 % 41) / 40.0::double as abstention from orders)"""


def _metric_rows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    v = lambda m, less, by, n=41: (k * m % n - less) / F.lit(float(by))
    made = {"ic5": v(37, 10, 40), "ic21": v(43, 10, 40), "sr5": v(47, 8, 40), "sr21": v(53, 8, 40), "base5": v(59, 25, 40), "base21": F.when(k % 13 != 0, v(61, 25, 40)), "ret5": v(67, 6, 40), "ret21": v(71, 6, 40), "sharpe5": v(73, 4, 20), "sharpe21": v(79, 4, 20), "coverage": v(83, 0, 40), "low5": v(89, 5, 40), "low21": F.when(k % 17 != 0, v(97, 5, 40)), "nearby": v(101, 0, 40), "hhi": v(103, 0, 100), "trades": k * 107 % 61, "abstention": v(109, 0, 40)}
    return views.table(spark, d, "orders").select(k.alias("id"), *(c.alias(n) for n, c in made.items()))


@query(_METRICS + """, g as (select *, coalesce(ic5 > 0 and ic21 > 0 and sr5 > 0 and sr21 > 0, false) as g1, ic5 > greatest(coalesce(base5, 0), 0) and ic21 > greatest(coalesce(base21, 0), 0) as g2, ret5 > 0 and ret21 > 0 as g3, coverage >= 0.25 as g4, low5 > 0 and coalesce(low21, 0) > 0 as g5, nearby >= 0.6 as g6, case when hhi = 0 then 1.0 else hhi end <= 0.25 as g7 from m)
select id, case when g1 and g2 and g3 and g4 and g5 and g6 and g7 then case when sharpe5 >= 0.75 and sharpe21 >= 0.75 then 'PASS: Expand to 25,000' else 'PASS: Expand to 10,000' end when ic5 <= 0 and ic21 <= 0 and sr5 <= 0 and sr21 <= 0 and not g3 then 'FAIL: Stop at 5,000' else 'INCONCLUSIVE: Stop at 5,000' end as research,
  g1::int + g2::int + g3::int + g4::int + g5::int + g6::int + g7::int as gates_passed, case when not coalesce((ic5 > 0 and low5 > 0) or (ic21 > 0 and coalesce(low21, 0) > 0), false) then 'STOP' when abstention > 0.5 or nearby > 0.5 then 'REVISE' else 'PROCEED' end as evidence,
  array_to_string(list_filter([case when not trades >= 30 then 'minimum_trades' end, case when not sharpe5 >= 0.75 then 'minimum_sharpe' end, case when not coalesce(low21 > 0, false) then 'interval_positive' end, case when not sharpe21 >= 0 then 'conservative_sharpe' end, case when not ret21 > 0 then 'validation_return' end, case when not hhi <= 0.2 then 'concentration' end], lambda x: x is not null), ',') as promotion_failed from g""", base=False)
def decision_rules(spark, d):
    """DEC-1/2/3: every gate over many rows of metrics."""
    rows = _metric_rows(spark, d)
    c = F.col
    pair = lambda name: (c(f"{name}5"), c(f"{name}21"))
    gates = decisions.research_gates(ic=pair("ic"), signed=pair("sr"), baselines=[pair("base")], conservative_return=pair("ret"), coverage=c("coverage"), intervals=[pair("low")], nearby=c("nearby"), concentration=[c("hhi")])
    out = decisions.gates(rows, gates).withColumn("gates_passed", sum((c(g).cast("int") for g in gates), F.lit(0)))
    research = decisions.research_decision(list(gates), ic=pair("ic"), signed=pair("sr"), conservative_sharpe=pair("sharpe"))
    promoted = decisions.gates(out.drop("passed", "failed"), decisions.promotion_gates(trades=c("trades"), sharpe=c("sharpe5"), lower=c("low21"), conservative_sharpe=c("sharpe21"), validation_return=c("ret21"), concentration=c("hhi")))
    useful = decisions.useful_evidence([(c("ic5"), c("low5")), (c("ic21"), c("low21"))])
    return promoted.select("id", research.alias("research"), "gates_passed", decisions.evidence_decision(useful, c("abstention"), c("nearby")).alias("evidence"), F.array_join("failed", ",").alias("promotion_failed"))


@query(_METRICS + """, s as (select id, least(1.0, greatest(0.0, ((ic5 + ic21) / 2 + 0.05) / 0.2)) as predictive, (coverage + (coalesce(base21, 0) + 1) / 2 + nearby + abstention) / 4 as agreement, 0.75 * coverage + 0.25 * nearby as valid, greatest(0.0, 1 - abs(coverage - abstention) / 0.75) as spread, least(1.0, trades / 40.0) as runtime, least(1.0, 0.05 / greatest(hhi, 1e-12)) as cost from m
), t as (select *, 0.35 * predictive + 0.25 * agreement + 0.15 * valid + 0.1 * spread + 0.1 * runtime + 0.05 * cost as total from s) select id, round(predictive::double, 8) as predictive_performance, round(agreement::double, 8) as agreement, round(valid::double, 8) as valid_output, round(spread::double, 8) as tradable_coverage, round(runtime::double, 8) as runtime, round(cost::double, 8) as electricity_cost, round(total::double, 8) as total, id = (select arg_max(id, {'t': round(total::double, 10), 'i': -id}) from t) as chosen from t""", base=False)
def model_selection(spark, d):
    """SEL-11, DEC-4: six bounded components, the best row."""
    c = F.col
    parts = decisions.selection_components(spearman=(c("ic5") + c("ic21")) / 2, floor=-0.05, target=0.15, agreement=[c("coverage"), (F.coalesce("base21", F.lit(0.0)) + 1) / 2, c("nearby"), c("abstention")], final_valid=c("coverage"), first_valid=c("nearby"), coverage=c("coverage"), other_coverage=c("abstention"), speed=c("trades"), speed_target=40.0, cost=c("hhi"), cost_target=0.05)
    weights = {"predictive_performance": 0.35, "agreement": 0.25, "valid_output": 0.15, "tradable_coverage": 0.10, "runtime": 0.10, "electricity_cost": 0.05}
    return rounded(decisions.select_best(_metric_rows(spark, d), parts, weights, "id").select("id", *weights, "total", "chosen"))


# --- caches and requests ---------------------------------------------------

_CACHE = _REQUESTS + """, t as (select *, conv_id, row_number() over (partition by cache_key order by article_id) as nth from r where conv_id % 3 = 0), cache as (select cache_key, role || ':' || length(cache_key) as result, case when try_cast(left(cache_key, 1) as integer) = 7 then 'bad' else sha256(role || ':' || length(cache_key)) end as result_hash, article_id as first_id from t where nth = 1)"""


def _cache(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    requests = _requests(spark, d)[0]
    known = requests.where("conv_id % 3 = 0").groupBy("cache_key").agg(F.min_by("role", "article_id").alias("role"), F.min("article_id").alias("first_id"))
    result = F.concat_ws(":", "role", F.length("cache_key").cast("string"))
    return requests, known.select("cache_key", result.alias("result"), F.when(F.substring("cache_key", 1, 1) == "7", "bad").otherwise(F.sha2(result, 256)).alias("result_hash"), "first_id")


@query(_CACHE + " select r.article_id, cache.result, r.article_id as bound_to, 'first_pass' as stage, true as from_cache from r join cache using (cache_key) where result_hash = sha256(result)", base=False)
def cache_rebind(spark, d):
    """MIS-1/2, JOI-14: hits whose stored digest holds, bound to the article that asks."""
    requests, cache = _cache(spark, d)
    hits = cascade.verified(cache, "result", "result_hash")
    return cascade.rebind(requests.select("article_id", "cache_key"), hits.select("cache_key", "result", F.col("first_id").alias("bound_to")), stage="first_pass").select("article_id", "result", "bound_to", "stage", "from_cache")


@query(_REQUESTS + """, p as (select *, row_number() over (partition by cache_key order by article_id) as nth from r) select s.prefix || substr(cache_key, 1, 24) as custom_id, cache_key, article_id, s.stage, 'Classify the following ' || role || ' turn.' || chr(10) || 'Answer with JSON only.' as system, 'article_id: ' || article_id || chr(10) || 'tokens: ' || tokens as message from p, (values ('fp-', 'first_pass'), ('esc-', 'escalation')) s(prefix, stage) where nth = 1""", base=False)
def request_rows(spark, d):
    """MIS-4, SCA-19/21: one request a distinct content and stage."""
    requests = _requests(spark, d)[0]
    return cascade.prepare(requests, "role", system="Classify the following {role} turn.\nAnswer with JSON only.", fields=("article_id", "tokens")).select("custom_id", "cache_key", "article_id", "stage", "system", "message")


@query(_REQUESTS + """, x as (select *, case when tokens % 3 = 0 then 'fp-' else 'esc-' end || left(cache_key, 24) as custom_id, tokens * 0.25 / 1e6 as cost, (tokens * 0.25 + 400 * 2.0) / 1e6 as preflight from r) select left(custom_id, strpos(custom_id, '-') - 1) as stage, count(*) as rows, count(distinct custom_id) as distinct_ids, sum(tokens)::bigint as tokens, round(sum(cost)::double, 8) as cost, round(max(preflight)::double, 8) as max_preflight, round(sum(preflight)::double, 8) > 0.02 as over_budget from x group by 1""", base=False)
def usage_audit(spark, d):
    """AGG-36, GOV-7: saved batches by stage, distinct ids, the largest preflight, and the gate."""
    requests = _requests(spark, d)[0]
    rows = requests.withColumns({"custom_id": F.concat(F.when(F.col("tokens") % 3 == 0, "fp-").otherwise("esc-"), F.substring("cache_key", 1, 24)), "cost": F.col("tokens") * 0.25 / 1e6, "preflight": (F.col("tokens") * 0.25 + 400 * 2.0) / 1e6})
    return rounded(cascade.audit(rows, limit=0.02))


# --- statistics ------------------------------------------------------------


@query(""", x as (select *, sign(score)::double * ret as signed from long_events), a as (select event_type, horizon, count(*) as n, count(case when tradable then 1 end) as n_tradable, count(case when abstain then 1 end) as n_abstain, round(avg(score), 8) as mean_score, count(case when tradable and ret is not null and abs(score) > 1e-12 then 1 end) as signal_n, round(avg(case when tradable then ret end), 8) as mean_return, round(median(case when tradable and label = 'bullish' then ret end), 8) as bullish_median, round(median(case when tradable and label = 'bearish' then ret end), 8) as bearish_median,
  round(avg(case when tradable and ret is not null then (case when ret > 0.5 then 'bullish' when ret < -0.5 then 'bearish' else 'neutral' end = label)::int end), 8) as class_accuracy, round(avg(case when tradable then signed end), 8) as signed_return from x group by 1, 2) select * from a""")
def group_metrics(spark, d):
    """AGG-4/19/20, PRJ-10."""
    rows = metrics.long_returns(views.events(spark, d), views.HORIZONS)
    on = lambda c: F.when(metrics.usable(), c)
    same = (signals.realised_class(F.col("ret"), 0.5) == F.col("label")).cast("double")
    median = lambda name: F.median(F.when(metrics.usable() & (F.col("label") == name), F.col("ret")))
    return rounded(rows.groupBy("event_type", "horizon").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("tradable"), 1)).alias("n_tradable"), F.count(F.when(F.col("abstain"), 1)).alias("n_abstain"), F.avg("score").alias("mean_score"), F.count(F.when(metrics.usable() & (F.abs("score") > 1e-12), 1)).alias("signal_n"), F.avg(on(F.col("ret"))).alias("mean_return"),
        median("bullish").alias("bullish_median"), median("bearish").alias("bearish_median"), F.avg(on(same)).alias("class_accuracy"), F.avg(on(F.signum("score") * F.col("ret"))).alias("signed_return"),
    ))


@query(f""", t as (select * from long_events where tradable and not abstain and horizon in (5, 21)), f as (select * from t where ret is not null and score is not null and abs(ret) < 'inf'::double), rk as (select *, rank() over (partition by horizon order by score) + (count(*) over (partition by horizon, score) - 1) / 2.0 as rx, rank() over (partition by horizon order by ret) + (count(*) over (partition by horizon, ret) - 1) / 2.0 as ry from f)
select cast(horizon as integer) as horizon, count(*) as n, round({_pearson('score', 'ret')}, 8) as pearson_ic, round({_pearson('rx', 'ry')}, 8) as spearman_ic, count(case when score <> 0 then 1 end) as directional_n, round(avg(case when score <> 0 then sign(score)::double * ret end), 8) as average_signed_return, round(avg(case when score <> 0 then (sign(score) = sign(ret))::int end), 8) as directional_accuracy, round((select count(*) from events where tradable and not abstain) / (select count(*) from events)::double, 8) as tradable_coverage from rk group by 1""")
def prediction_metrics(spark, d):
    """AGG-44, FIL-13, FIL-18."""
    return rounded(metrics.prediction_metrics(views.events(spark, d), "score", (5, 21)))


@query(f""", b as (select article_id, ((k * 43) % 201 - 100) / 100.0::double as score2, k % 7 <> 0 as tradable2, case when (k * 43) % 201 - 100 > 25 then 'bullish' when (k * 43) % 201 - 100 < -25 then 'bearish' else 'neutral' end as label2, ((k * 31) % 101) / 100.0::double as relevance2 from articles), j as (select events.*, b.* exclude article_id from events join b using (article_id)), a as (select * from j where label = label2)
select count(*) as agreed, round(avg(tradable::int), 8) as first_tradable, round(avg(tradable2::int), 8) as second_tradable, count(case when tradable and tradable2 then 1 end) as both_tradable, count(case when tradable and not tradable2 then 1 end) as first_only, count(case when not tradable and tradable2 then 1 end) as second_only, count(case when not tradable and not tradable2 then 1 end) as neither, round(avg(relevance - relevance2), 8) as paired_difference, round(quantile_cont(relevance, 0.5), 8) as first_median, round(quantile_cont(relevance2, 0.5), 8) as second_median, round(avg((relevance >= 0.7)::int), 8) as first_share, round(avg((relevance2 >= 0.7)::int), 8) as second_share,
  round((select 100 * (avg(tradable::int) - avg(tradable2::int)) from j where research_split = 'holdout'), 6) as policy_gap, round((select 100 * avg(tradable::int) from j) - (select 100 * avg(tradable::int) from j where research_split = 'holdout'), 6) as selection_shift from a""")
def permissiveness(spark, d):
    """AGG-18/32, JOI-1: distributions where two raters agree, and the coverage gap decomposed."""
    second = views.second_rater(spark, d).withColumn("relevance2", ((F.col("article_id").cast("long") * 31) % 101) / F.lit(100.0))
    j = contracts.one_to_one(views.events(spark, d), second, "article_id")
    out = metrics.permissiveness(j, "relevance", 0.7, sample=F.col("research_split") == "holdout")
    return rounded(out).withColumns({"policy_gap": F.round("policy_gap", 6), "selection_shift": F.round("selection_shift", 6)})


@query(_BOOK + """, t as (select sum(gross_return) as gross, sum(turnover) as turnover, sum(turnover) * 10 / 10000 as drag, count(*) as days, count(case when positions > 0 then 1 end) as active, sum(positions) as position_days, max(positions) as most, avg(positions) as mean_all, avg(case when positions > 0 then positions end) as mean_active from book), p as (select count(distinct article_id) as accepted from ret), s as (select sum(case when weight > 0 then weight * day_return else 0 end) as long_part, sum(case when weight < 0 then weight * day_return else 0 end) as short_part from w)
select p.accepted, round(gross, 8) as gross, round(long_part, 8) as long_contribution, round(short_part, 8) as short_contribution, round(turnover, 8) as turnover, round(drag * 10000, 6) as cost_drag_bps, round(gross / p.accepted * 10000, 6) as gross_bps_per_position, round(drag / p.accepted * 10000, 6) as cost_bps_per_position, round(gross / turnover * 10000, 6) as gross_bps_per_turnover, days as calendar_days, active as active_days, position_days::bigint as position_days, most as maximum_positions, round(mean_all, 8) as average_all_days, round(mean_active, 8) as average_active_days from t, p, s""")
def cost_attribution(spark, d):
    """AGG-33."""
    days = _days(spark, d)
    weighed = stage(portfolio.weights(days, mode="market_neutral", cap=0.05), "weighed")
    book = portfolio.daily_book(weighed, views.prices(spark, d).select("date").distinct())
    out = portfolio.attribution(weighed, book, 10.0)
    return out.select(*(F.round(c, 6 if "bps" in c else 8).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


@query(_BOOK + """, lw as (select c.*, cal.i, case when direction > 0 then least(1.0 / nl, 0.05) else 0.0 end as weight from c join cal using (date)), lm as (select i, sum(abs(m)) as turnover from (select i, ticker, sum(m) as m from (select i, ticker, weight as m from lw union all select i + 1, ticker, -weight from lw) group by 1, 2) group by 1), lb as (select i, sum(weight * day_return) as g, count(case when weight <> 0 then 1 end) as n from lw group by 1), bk as (select date, coalesce(g, 0) as r, coalesce(turnover, 0) as turnover, coalesce(n, 0) as positions from cal left join lb using (i) left join lm using (i)), q as (select *, product(1 + r) over (order by date) as eq from bk), z as (select *, eq / max(eq) over (order by date) - 1 as dd from q)
select count(*) as sessions, round(arg_max(eq, date) - 1, 8) as total_return, round(avg(r) * 252, 8) as annualized_return, round(stddev_samp(r) * sqrt(252), 8) as annualized_volatility, round(case when stddev_samp(r) > 0 then avg(r) / stddev_samp(r) * sqrt(252) end, 8) as sharpe, round(min(dd), 8) as maximum_drawdown, round(sum(turnover), 8) as turnover from z""")
def long_only_book(spark, d):
    """AGG-27/41: long-only weights and the ledger's performance."""
    calendar = views.prices(spark, d).select("date").distinct()
    book = stage(portfolio.daily_book(portfolio.weights(_days(spark, d), mode="long_only", cap=0.05), calendar), "long-only")
    return rounded(metrics.ledger_performance(book, "gross_return").crossJoin(book.agg(F.sum("turnover").alias("turnover"))))


_TAGS = ("exclude_event_type_other", "high_relevance_ge_0_7", "high_materiality_ge_0_5", "high_confidence_ge_0_7", "strongest_event_per_company_day", "earnings_and_guidance_only", "two_rater_agreement")


@query(f""", u as (select l.*, ((k * 43) % 201 - 100) / 100.0::double as score2, k % 7 <> 0 as tradable2, row_number() over (partition by research_split, ticker, entry_date order by abs(signal_weighted) desc, article_id) = 1 as strongest from ladder l where tradable and not abstain
), x as (select unnest(list_filter([case when event_type <> '5-LOW' then '{_TAGS[0]}' end, case when relevance >= 0.7 then '{_TAGS[1]}' end, case when materiality >= 0.5 then '{_TAGS[2]}' end, case when confidence >= 0.7 then '{_TAGS[3]}' end, case when strongest then '{_TAGS[4]}' end, case when event_type in ('1-URGENT', '2-HIGH') then '{_TAGS[5]}' end, case when label <> 'neutral' and tradable2 and ((label = 'bullish' and score2 > 0.25) or (label = 'bearish' and score2 < -0.25)) then '{_TAGS[6]}' end], lambda x: x is not null)) as subset, * from u
), y as (select subset, research_split, h as horizon, signal_weighted as x, score, label, case h when 5 then future_return_5d else future_return_21d end as ret, case h when 5 then exit_date_5d else exit_date_21d end as ed, next_split_entry_date as nb from x, (select unnest([5, 21]) as h)), z as (select * from y where nb is null or ed < nb), r as (select *, rank() over (partition by subset, research_split, horizon order by x) + (count(*) over (partition by subset, research_split, horizon, x) - 1) / 2.0 as rx, rank() over (partition by subset, research_split, horizon order by ret) + (count(*) over (partition by subset, research_split, horizon, ret) - 1) / 2.0 as ry from z where ret is not null)
select subset, research_split, horizon, count(*) as n, round(avg(sign(x)::double * ret), 8) as average_signed_return, round(avg(case when label = 'bullish' then ret end) - avg(case when label = 'bearish' then ret end), 8) as spread, round({_pearson('rx', 'ry')}, 8) as spearman_ic, round({_pearson('x', 'ret')}, 8) as pearson_ic, round(avg(case when abs(x) > 1e-12 then (sign(x) = sign(ret))::int end), 8) as directional_accuracy from r group by 1, 2, 3""")
def subset_metrics(spark, d):
    """FIL-9/17, MIS-8: seven fixed subsets, purged, each split and horizon."""
    k = F.col("k")
    other = signals.label_of(((k * 43) % 201 - 100) / F.lit(100.0))
    rows = signals.with_ladder(views.events(spark, d)).where("tradable and not abstain")
    w = Window.partitionBy("research_split", "ticker", "entry_date").orderBy(F.desc(F.abs("signal_weighted")), "article_id")
    rows = rows.withColumn("strongest", F.row_number().over(w) == 1)
    tags = frames.subset_tags({_TAGS[0]: F.col("event_type") != "5-LOW", _TAGS[1]: F.col("relevance") >= 0.7, _TAGS[2]: F.col("materiality") >= 0.5, _TAGS[3]: F.col("confidence") >= 0.7, _TAGS[4]: F.col("strongest"), _TAGS[5]: F.col("event_type").isin("1-URGENT", "2-HIGH"), _TAGS[6]: (F.col("label") != "neutral") & (k % 7 != 0) & (F.col("label") == other)})
    return rounded(metrics.subset_bundle(rows.withColumn("subset", F.explode(tags)), "signal_weighted", (5, 21)))


# --- frames ----------------------------------------------------------------

_EVENT_MAP = {"click": "engagement", "view": "engagement", "purchase": "conversion", "signup": "conversion"}


@query("""select event_id as src_event_id, case event_type when 'click' then 'engagement' when 'view' then 'engagement' when 'purchase' then 'conversion' when 'signup' then 'conversion' else event_type end as src_event_type, nullif(trim(props), '') as src_props, cast(value as double) as src_value, cast(user_id as bigint) as src_user_id, 'synthetic' as provider, 'v1' as schema_version, quarter(ts) - 1 as quarter_index, strftime(ts, '%Y-%m') as month, cast(cast(ts as date) + 3 * 21 + 10 as varchar) as price_window_end from events""", base=False)
def canonical_events(spark, d):
    """PRJ-13/14/15/20/21, SCA-23/25, MIS-10: recoded, typed, prefixed, with provenance; operational columns left out."""
    rows = views.table(spark, d, "events").withColumns({"cache_state": F.lit("hit"), "elapsed_ms": F.lit(3)})
    rows = rows.withColumn("event_type", frames.recode("event_type", _EVENT_MAP))
    typed = frames.canonical(rows, {"event_id": "bigint", "event_type": "string", "props": "string", "value": "double", "user_id": "bigint"}, extra=("ts", "cache_state", "elapsed_ms"))
    scientific = frames.without_operational(typed, ("cache_state", "elapsed_ms"))
    out = frames.prefixed(scientific, "src_", ("event_id", "event_type", "props", "value", "user_id"))
    out = frames.with_literals(out, provider="synthetic", schema_version="v1")
    return out.select("src_event_id", "src_event_type", "src_props", "src_value", "src_user_id", "provider", "schema_version", (F.quarter("ts") - 1).cast("long").alias("quarter_index"), F.date_format("ts", "yyyy-MM").alias("month"), frames.price_window_end(F.to_date("ts"), (1, 5, 21), 10).cast("string").alias("price_window_end"))


@query("""with a as (select s_suppkey as key, cast(s_nationkey as integer) as v, s_acctbal as x from supplier), b as (select s_suppkey as key, s_nationkey + 0.5 as v, s_name as name from supplier where s_suppkey % 3 = 0)
select key, v::double as v, x, null as name from a union all by name select key, v::double as v, null as x, name from b""", base=False)
def relaxed_union(spark, d):
    """SET-1/2: types widened, missing columns null."""
    s = views.table(spark, d, "supplier")
    a = s.select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").cast("int").alias("v"), F.col("s_acctbal").alias("x"))
    b = s.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("key"), (F.col("s_nationkey") + F.lit(0.5).cast("double")).alias("v"), F.col("s_name").alias("name"))
    return frames.relaxed_union(a, b)


@query("""with a as (select p_partkey as key, sha256(p_name) as h from part), b as (select p_partkey as key, case when p_partkey % 50 = 0 then sha256('x') else sha256(p_name) end as h from part where p_partkey % 70 <> 0), j as (select a.key as ka, b.key as kb, a.h as ha, b.h as hb from a full join b on a.key = b.key)
select count(case when ka is null then 1 end) as only_right, count(case when kb is null then 1 end) as only_left, count(case when ka is not null and kb is not null and ha <> hb then 1 end) as differing, count(*) = count(case when ha = hb then 1 end) as equal, (select count(*) from (select * from a except all select * from b)) as left_rows, (select count(*) from (select * from b except all select * from a)) as right_rows, (select count(*) from a join b on a.key = b.key) as paired from j""", base=False)
def frame_equality(spark, d):
    """JOI-11/15/16, SET-6: maps and row sets compared both ways, and frames zipped by identity."""
    part = views.table(spark, d, "part")
    k = F.col("p_partkey")
    a = part.select(k.alias("key"), F.sha2("p_name", 256).alias("h"))
    b = part.where("p_partkey % 70 <> 0").select(k.alias("key"), F.when(k % 50 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.sha2("p_name", 256)).alias("h"))
    paired = frames.zipped(a.join(b.select("key"), "key", "left_semi"), b, "key", check=())
    return frames.map_equality(a, b, "key", "h").crossJoin(frames.row_difference(a, b)).crossJoin(paired.agg(F.count("*").alias("paired")))
