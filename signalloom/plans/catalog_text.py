"""Queries over texts, events and conversations: screening, contracts, caches, decisions, sets, sequential picks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import align, cascade, contracts, costs, screen, sequential
from ..staging import small_batches, stage
from . import decisions, views
from .catalog import query, r8, rounded

_ARTICLES = """select doc_id, cast(doc_id as varchar) as article_id, split_part(coalesce(text, ''), chr(10), 1) as title, coalesce(text, '') as body, timestamp '2024-01-01 00:00:00' + to_days(cast(doc_id % 60 as integer)) + to_seconds((doc_id * 7919) % 86400) as ts, source, lang from documents"""
_STORIES = f"stories as ({_ARTICLES})"
_WORDS = "regexp_extract_all(lower(body), '[a-z]+')"


def _in(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _count(words: tuple[str, ...]) -> str:
    return f"len(list_filter({_WORDS}, lambda x: list_contains({_in(words)}, x)))"


@query(f"with {_STORIES} select doc_id, round(coalesce(({_count(tx.POSITIVE)} - {_count(tx.NEGATIVE)}) / nullif({_count(tx.POSITIVE)} + {_count(tx.NEGATIVE)}, 0)::double, 0.0), 8) as sentiment, len(list_filter({_WORDS}, lambda x: list_contains({_in(tx.CONTRAST)}, x))) > 0 and {_count(tx.GOOD)} > 0 and {_count(tx.BAD)} > 0 as contradictory from stories", base=False)
def keyword_sentiment(spark, d):
    """SCA-13/14, UDF-1."""
    return views.stories(spark, d).select("doc_id", r8(tx.keyword_sentiment(F.col("body"))).alias("sentiment"), tx.contradictory(F.col("body")).alias("contradictory"))


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_MEMBERS = ", ".join(f"({i}, {_text(t)}, {_text(n)}, [{', '.join(map(_text, x))}]::varchar[])" for i, (t, n, x) in enumerate(views.UNIVERSE))
_NEWS = f"""universe as (select * from (values {_MEMBERS}) u(i, ticker, company, names)), shown as (select doc_id as id, s.title as head, s.body as own, ts, source, lang, u.ticker, u.company, case doc_id % 5 when 0 then '$' || split_part(u.ticker, '.', 1) when 1 then 'Somebody' else u.company end as shown from stories s join universe u on u.i = doc_id % {len(views.UNIVERSE)}
), news as (select id, ticker, replace([{', '.join(map(_text, views.HEADLINES))}][id // 8 % {len(views.HEADLINES)} + 1], '{{c}}', shown) || ' - ' || left(head, 40) as title, case id % 3 when 0 then company || ' said so. ' || own when 1 then own || ' Both ' || company || ' and again ' || company || ' were named.' else own end as body,
  case when id % 9 = 0 then [] else [ticker] end || list_transform(range(1, id % 7 + 2), lambda i: 'X' || i) as symbols, ts, source, lang from shown)"""
_FOLDED = "replace(lower({0}), 'ß', 'ss')"
_TOKENS = "regexp_extract_all(" + _FOLDED + ", '[a-z0-9]+(?:''[a-z]+)?')"
_NORMAL = "array_to_string(" + _TOKENS + ", ' ')"
_COLLAPSED = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
_MATCHES = ", ".join("case when " + " or ".join(f"regexp_matches(t, '{p}')" for p in pats) + f" then '{name}' end" for name, pats in tx.EVENT_PATTERNS.items())
_GENERIC = f"(regexp_matches(title, '{tx.GENERIC_TITLE}') or regexp_matches(title, '{tx.LISTICLE}'))"


@query(f"with {_STORIES}, {_NEWS} select id, array_to_string(case when len(f) > 0 then f else ['other'] end, ',') as candidates, bucket from (select id, list_filter([{_MATCHES}], lambda x: x is not null) as f, bucket from (select *, {_NORMAL.format("title || ' ' || left(body, 6000)")} as t, case {' '.join('when ' + ' or '.join(f"contains(lower(title || ' ' || left(body, 3000)), '{w}')" for w in terms) + f" then '{name}'" for name, terms in tx.BUCKET_TERMS.items())} else 'other' end as bucket from news))", base=False)
def event_candidates(spark, d):
    """SCA-1/3/5/15/18: 17 groups of patterns over documents."""
    return views.news(spark, d).select("id", F.array_join(tx.event_candidates(F.col("title"), F.col("body")), ",").alias("candidates"), tx.sampling_bucket(F.col("title"), F.col("body")).alias("bucket"))


@query(f"""with {_STORIES}, {_NEWS}, al as (select ticker, list_distinct(list(a)) as aliases from (select ticker, {_NORMAL.format('x')} as a from (select ticker, unnest([company] || names || [regexp_replace(company, '{tx.LEGAL_SUFFIX}', ' ', 'g')]) as x from universe)) where length(a) >= 3 group by 1
), n as (select news.*, aliases, {_NORMAL.format('title')} as nt, {_NORMAL.format('body')} as nb, {_NORMAL.format("title || ' ' || left(body, 6000)")} as t, lower(split_part(ticker, '.', 1)) as base from news join al using (ticker)
), c as (select *, len(list_filter(aliases, lambda a: contains(nt, a))) > 0 as head, len(list_filter(aliases, lambda a: contains(array_to_string(split(nb, ' ')[:120], ' '), a))) > 0 as opening, list_sum(list_transform(aliases, lambda a: (length(nb) - length(replace(nb, a, ''))) // length(a))) as mentions,
  length(base) >= 3 and regexp_matches(title, '(?i)(?:\\$|\\b)' || base || '\\b') as sym_title, list_contains(symbols, ticker) as sym, length({_COLLAPSED.format('body')}) < 400 as low, {_GENERIC} as generic, len(symbols) > 5 as many, len(list_filter([{_MATCHES}], lambda x: x is not null)) > 0 as specific from n
), s as (select *, head and (opening or mentions >= 2) as subject from c), r as (select *, greatest(0, least(1, case when head then 0.30 else 0 end + case when sym_title then 0.10 else 0 end + case when opening then 0.20 else 0 end + case when mentions >= 2 then 0.10 else 0 end + case when subject then 0.10 else 0 end + case when specific then 0.15 else 0 end + case when not low then 0.05 else 0 end + case when generic then -0.25 else 0 end + case when many then -0.20 else 0 end + case when not sym then -0.40 else 0 end)) as score from s)
select id, round(score::double, 8) as score, score >= 0.55 and not low and sym and subject as eligible, array_to_string(list_filter([case when not sym then 'provider_symbol_missing' end, case when not (head or sym_title) then 'target_not_in_headline' end, case when not opening then 'target_not_in_opening' end, case when low then 'low_information_text' end, case when generic then 'generic_or_listicle' end, case when many then 'too_many_unrelated_symbols' end, case when not subject then 'target_not_primary_subject' end], lambda x: x is not null), ',') as reasons from r""", base=False)
def relevance_score(spark, d):
    """SCA-4/6/7/8/9, FIL-2: ten components."""
    return tx.company_relevance(views.news(spark, d), views.universe(spark)).select("id", r8("score").alias("score"), "eligible", F.array_join("reasons", ",").alias("reasons"))


@query(f"with {_STORIES} select sha256({_COLLAPSED.format(_FOLDED.format('body'))}) as body_hash, count(*) as copies, arg_min(doc_id, {{'t': ts, 'd': doc_id}}) as first_id, count(distinct sha256({_COLLAPSED.format('title')} || chr(10) || {_COLLAPSED.format('body')})) as contents from stories group by 1", base=False)
def first_seen_dedupe(spark, d):
    """WIN-12, SCA-1/2, SET-4."""
    rows = views.stories(spark, d).withColumns({"body_hash": tx.body_hash(F.col("body")), "content": tx.content_hash(F.col("title"), F.col("body"))})
    kept = screen.first_seen(rows.select("body_hash", "ts", "doc_id"), "body_hash", "ts", "doc_id")
    copies = rows.groupBy("body_hash").agg(F.count("*").alias("copies"), F.count_distinct("content").alias("contents"))
    return kept.select("body_hash", F.col("doc_id").alias("first_id")).join(copies, "body_hash")


@query(f"""with {_STORIES}, {_NEWS}, f as (select ticker, case when not (cast((ts at time zone 'UTC') at time zone 'America/New_York' as date) between date '2024-01-05' and date '2024-02-20') then 'outside_dates' when not list_contains(symbols, ticker) then 'symbol_missing'
  when length({_COLLAPSED.format('body')}) < 400 or {_COLLAPSED.format(_FOLDED.format('body'))} = {_COLLAPSED.format(_FOLDED.format('title'))} then 'headline_only' when len(symbols) >= 4 and regexp_matches(title, '{tx.GENERIC_TITLE}') then 'market_summary' else 'kept' end as reason from news)
select reason, ticker, count(*) as n from f group by rollup (reason, ticker) having reason is not null""", base=False)
def filter_funnel(spark, d):
    """FIL-1/2/3/4/19, AGG-29."""
    day = align.local_date(F.col("ts"))
    rules = [("outside_dates", ~day.between(F.lit("2024-01-05").cast("date"), F.lit("2024-02-20").cast("date"))), ("symbol_missing", ~F.array_contains("symbols", F.col("ticker"))), ("headline_only", tx.text_type(F.col("title"), F.col("body"), 400) == "headline_only"), ("market_summary", tx.is_market_summary(F.col("title"), F.col("symbols"), 4))]
    return screen.funnel(views.news(spark, d).withColumn("reason", screen.first_failing(rules)), "reason", "ticker")


@query("""with e as (select event_id, user_id, ts, cast(ts as date) as day, case when event_type in ('purchase', 'signup') then 1 else 2 end as grp from events), r as (select *, row_number() over (partition by grp, day order by ts, event_id) as rn from e), q as (select day, least(count(*), 3) as taken from e where grp = 1 group by 1)
select event_id, grp, day from (select r.*, case when grp = 1 then 3 else 3 - coalesce(taken, 0) end as quota from r left join q using (day)) where rn <= quota order by grp, rn, day, ts, event_id limit 60""", base=False, text="day")
def diverse_pick(spark, d):
    """WIN-11, SEL-3."""
    rows = views.table(spark, d, "events").select("event_id", "ts", F.to_date("ts").alias("day"), F.when(F.col("event_type").isin("purchase", "signup"), 1).otherwise(2).alias("grp"))
    return screen.diverse_pick(rows, group="grp", day="day", cap=3, limit=60, order=["ts", "event_id"]).select("event_id", "grp", "day")


@query("select event_type, event_id, rank from (select event_type, event_id, row_number() over (partition by event_type order by sha256('17:' || cast(event_id as varchar)), event_id) as rank from events) where rank <= 5", base=False)
def seeded_sample(spark, d):
    """SEL-2, PRJ-12 rank form."""
    w = Window.partitionBy("event_type").orderBy(tx.seeded_rank_key(17, F.col("event_id").cast("string")), "event_id")
    return views.table(spark, d, "events").withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 5").select("event_type", "event_id", "rank")


@query("""with v as (select article_id, list_filter([case when not (score between -1 and 1) then 'score_range' end, case when not (label = label2) then 'label_sign' end, case when tradable = abstain then 'tradable_abstain' end, case when not (event_type <> '5-LOW' and relevance >= 0.7 and materiality >= 0.7 or abstain) then 'weak_must_abstain' end], lambda x: x is not null) as x
  from (select cast(o_orderkey as varchar) as article_id, ((o_orderkey * 37) % 201 - 100) / 100.0 as score, case when (o_orderkey * 37) % 201 - 100 > 25 then 'bullish' when (o_orderkey * 37) % 201 - 100 < -25 then 'bearish' else 'neutral' end as label, case when (o_orderkey * 37) % 201 - 100 > 25 then 'bullish' when (o_orderkey * 37) % 201 - 100 < -25 then 'bearish' else 'neutral' end as label2,
  o_orderkey % 5 = 0 as abstain, o_orderkey % 5 <> 0 as tradable, case when o_orderpriority = '5-LOW' then '5-LOW' else o_orderpriority end as event_type, ((o_orderkey * 29) % 101) / 100.0 as relevance, ((o_orderkey * 41) % 101) / 100.0 as materiality from orders)) select article_id, array_to_string(x, ',') as violations from v""", base=False)
def contract_violations(spark, d):
    """VAL-2."""
    rows = views.articles(spark, d).withColumn("event_type", F.when(F.col("event_type") == "5-LOW", "other").otherwise(F.col("event_type")))
    return rows.select("article_id", F.array_join(contracts.violations(contracts.assessment_rules() | contracts.sparse_rules()), ",").alias("violations"))


@query("select count(*) as n, count(distinct ticker || cast(date as varchar)) as distinct_keys, 0::bigint as null_keys, count(case when not (open > 0 and high > 0 and low > 0 and close > 0 and adjusted_close > 0 and volume >= 0 and high >= low) then 1 end) as violating from prices")
def table_contract(spark, d):
    """VAL-1/7, AGG-37."""
    rows = views.prices(spark, d).withColumn("key", F.concat("ticker", F.col("date").cast("string"))).withColumn("violations", contracts.violations(contracts.price_rules()))
    return contracts.table_contract(rows, "key")


def _requests(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = views.table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("article_id"), "role", tx.key_of(F.col("role"), F.coalesce("text", F.lit(""))).alias("cache_key"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("tokens"), "conv_id")
    cache = rows.where("conv_id % 3 = 0").select("cache_key").distinct()
    return rows, cache


_REQUESTS = """with r as (select cast(conv_id as varchar) || '-' || cast(turn as varchar) as article_id, role, sha256(role || chr(31) || coalesce(text, '')) as cache_key, octet_length(encode(coalesce(text, '')))::bigint as tokens, conv_id from conversations), c as (select distinct cache_key from r where conv_id % 3 = 0)"""


@query(_REQUESTS + " select cache_key, min(article_id) as article_id, count(*) as waiting from r where cache_key not in (select cache_key from c) group by 1", base=False)
def cache_misses(spark, d):
    """JOI-14, JOI-7, SCA-19."""
    requests, cache = _requests(spark, d)
    return cascade.split_cache(requests, cache)[1]


_LEDGER = _REQUESTS + """, l as (select r.*, c.cache_key is not null as from_cache, row_number() over (partition by r.cache_key order by article_id) as nth from r left join c using (cache_key)), o as (select *, case when from_cache then 'cache_hit' when tokens < 20 then 'api_failure' when nth > 1 then 'duplicate_request' else 'api_success' end as outcome, case when not from_cache and nth = 1 then tokens * 0.25 / 1e6 else 0 end as cost from l)"""


def _ledger(spark: SparkSession, d: str) -> DataFrame:
    requests, cache = _requests(spark, d)
    return cascade.ledger(requests, cache, F.col("tokens") < 20, F.col("tokens") * 0.25 / 1e6)


@query(_LEDGER + " select article_id, outcome, from_cache, round(cost::double, 10) as run_cost_usd from o", base=False)
def request_ledger(spark, d):
    """MIS-3."""
    return _ledger(spark, d).select("article_id", "outcome", "from_cache", F.round("run_cost_usd", 10).alias("run_cost_usd"))


@query(_LEDGER + " select role, count(*) as requests, count(case when outcome = 'cache_hit' then 1 end) as hits, count(case when outcome = 'api_failure' then 1 end) as failures, sum(tokens)::bigint as tokens, round(sum(cost)::double, 8) as run_cost_usd, count(distinct cache_key) as distinct_keys from o group by 1", base=False)
def usage_ledger(spark, d):
    """AGG-35."""
    return rounded(cascade.usage_totals(_ledger(spark, d), "role"))


@query("""select article_id, array_to_string(case when label = 'neutral' and materiality < 0.3 then [] else list_filter([case when confidence < 0.6 then 'confidence_below_threshold' end, case when materiality >= 0.75 then 'high_materiality' end, case when not abstain and materiality > 0 and relevance >= 0.6 and materiality >= 0.3 and k % 11 = 0 then 'contradictory_article_evidence' end], lambda x: x is not null) end, ',') as reasons from articles""")
def escalations(spark, d):
    """SCA-17."""
    return views.articles(spark, d).withColumn("contradictory", F.col("k") % 11 == 0).select("article_id", F.array_join(cascade.escalation_reasons(), ",").alias("reasons"))


@query("select article_id from (select article_id, row_number() over (order by case when materiality >= 0.9 then 0 when confidence < 0.2 then 1 when event_type = '1-URGENT' then 2 when tradable then 3 else 4 end, article_id) as rn from articles) where rn <= 500")
def priority_cap(spark, d):
    """SEL-5, STA-6."""
    p = F.when(F.col("materiality") >= 0.9, 0).when(F.col("confidence") < 0.2, 1).when(F.col("event_type") == "1-URGENT", 2).when(F.col("tradable"), 3).otherwise(4)
    return cascade.capped_by_priority(views.articles(spark, d), p, "article_id", 500).where("selected").select("article_id")


@query(""", m as (select research_split, count(*) as n, avg(sign(score)::double * future_return_5d) as s5, avg(sign(score)::double * future_return_21d) as s21, avg(case when tradable then 1.0 else 0.0 end) as coverage, avg(case when event_type = '5-LOW' then 1.0 else 0.0 end) as other, avg(case when abstain then 1.0 else 0.0 end) as abst from events group by 1)
select research_split, n >= 100 as enough, s5 > 0 and s21 > 0 as positive, coverage >= 0.25 as covered, n >= 100 and s5 > 0 and s21 > 0 and coverage >= 0.25 as passed, array_to_string(list_filter([case when n < 100 then 'enough' end, case when not (s5 > 0 and s21 > 0) then 'positive' end, case when coverage < 0.25 then 'covered' end], lambda x: x is not null), ',') as failed,
  case when not (s5 > 0 and s21 > 0) then 'STOP' when abst > 0.5 or other > 0.5 then 'REVISE' else 'PROCEED' end as evidence, case when n >= 100 and s5 > 0 and s21 > 0 and coverage >= 0.25 then case when s5 > 0.75 then 'PASS: expand to 25,000' else 'PASS: expand to 10,000' end when s5 <= 0 and s21 <= 0 then 'FAIL' else 'INCONCLUSIVE' end as scale from m""")
def gate_decisions(spark, d):
    """AGG-42: gates of each split in small."""
    signed = lambda h: F.avg(F.signum("score") * F.col(f"future_return_{h}d"))
    m = views.events(spark, d).groupBy("research_split").agg(F.count("*").alias("n"), signed(5).alias("s5"), signed(21).alias("s21"), F.avg(F.col("tradable").cast("double")).alias("coverage"), F.avg((F.col("event_type") == "5-LOW").cast("double")).alias("other"), F.avg(F.col("abstain").cast("double")).alias("abst"))
    positive = (F.col("s5") > 0) & (F.col("s21") > 0)
    g = decisions.gates(m, {"enough": F.col("n") >= 100, "positive": positive, "covered": F.col("coverage") >= 0.25})
    return g.select("research_split", "enough", "positive", "covered", "passed", F.array_join("failed", ",").alias("failed"), decisions.evidence_decision(positive, F.col("abst"), F.col("other")).alias("evidence"), F.when(F.col("passed") & (F.col("s5") > 0.75), "PASS: expand to 25,000").when(F.col("passed"), "PASS: expand to 10,000").when((F.col("s5") <= 0) & (F.col("s21") <= 0), "FAIL").otherwise("INCONCLUSIVE").alias("scale"))


@query("""with b as (select event_type, avg(value) as v, count(*) as n from events group by 1), s as (select event_type, least(1.0, greatest(0.0, (v - 10.0) / 90.0)) as predictive, least(1.0, n / 2500.0) as runtime from b), t as (select *, 0.6 * predictive + 0.4 * runtime as total from s) select event_type, round(predictive::double, 8) as predictive, round(runtime::double, 8) as runtime, round(total::double, 8) as total, event_type = (select arg_max(event_type, total) from t) as chosen from t""", base=False)
def weighted_selection(spark, d):
    """SEL-4."""
    b = views.table(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("v"), F.count("*").alias("n"))
    t = b.select("event_type", decisions.bounded(F.col("v"), 10.0, 100.0).alias("predictive"), F.least(F.lit(1.0), F.col("n") / 2500.0).alias("runtime")).withColumn("total", 0.6 * F.col("predictive") + 0.4 * F.col("runtime"))
    best = t.agg(F.max_by("event_type", "total").alias("_best"))
    return rounded(t.crossJoin(F.broadcast(best)).withColumn("chosen", F.col("event_type") == F.col("_best")).drop("_best"))


@query("""with a as (select o_custkey as id from orders where o_orderstatus = 'F'), b as (select o_custkey as id from orders where o_orderpriority = '1-URGENT'), u as (select id from a union all select id from b), i as (select id from a intersect select id from b), x as (select id from a except select id from b) select 'union' as op, count(*) as n, count(distinct id) as distinct_n, sum(id)::bigint as total from u union all select 'intersect', count(*), count(distinct id), sum(id)::bigint from i union all select 'except', count(*), count(distinct id), sum(id)::bigint from x""", base=False)
def set_ops(spark, d):
    """SET-3/6/7."""
    orders = views.table(spark, d, "orders")
    a, b = (orders.where(c).select(F.col("o_custkey").alias("id")) for c in ("o_orderstatus = 'F'", "o_orderpriority = '1-URGENT'"))
    made = {"union": a.unionByName(b), "intersect": a.intersect(b), "except": a.subtract(b)}
    out = None
    for name, df in made.items():
        row = df.agg(F.lit(name).alias("op"), F.count("*").alias("n"), F.count_distinct("id").alias("distinct_n"), F.sum("id").alias("total"))
        out = row if out is None else out.unionByName(row)
    return out


@query("""with r as (select event_type, sha256(cast(event_id as varchar) || chr(31) || event_type || chr(31) || cast(user_id as varchar)) as h from events), b as (select event_type, left(h, 4) as bucket, sha256(string_agg(h, '' order by h)) as digest, count(*) as n from r group by 1, 2)
select event_type, sha256(string_agg(digest, '' order by bucket)) as dataset_hash, sum(n)::bigint as n from b group by 1""", base=False)
def dataset_hash(spark, d):
    """AGG-38, GOV-3: a digest of digests."""
    rows = views.table(spark, d, "events").select("event_type", tx.key_of(F.col("event_id").cast("string"), F.col("event_type"), F.col("user_id").cast("string")).alias("h"))
    return contracts.dataset_hash(rows, "h", "event_type")


@query("""with q as (select unnest(generate_series(date_trunc('quarter', date '2022-02-15'), date '2023-11-20', interval 3 months)) as s) select cast(greatest(s, date '2022-02-15') as date) as window_start, cast(least(s + interval 3 months - interval 1 day, date '2023-11-20') as date) as window_end from q""", base=False, text="window_start window_end")
def quarter_windows(spark, d):
    """SCA-24."""
    start, end = F.lit("2022-02-15").cast("date"), F.lit("2023-11-20").cast("date")
    q = spark.range(1).select(F.explode(F.sequence(F.trunc(start, "quarter"), end, F.expr("interval 3 months"))).alias("s"))
    return q.select(F.greatest("s", start).alias("window_start"), F.least(F.date_sub(F.add_months("s", 3), 1), end).alias("window_end"))


@query("""select event_type, count(*) as n, count(case when json_extract_string(props, '$.k') is not null then 1 end) as with_key, min(length(props)) as shortest, max(length(props)) as longest from events group by 1""", base=False)
def json_fields(spark, d):
    """SCA-28."""
    rows = views.table(spark, d, "events")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count(F.get_json_object("props", "$.k")).alias("with_key"), F.min(F.length("props")).cast("long").alias("shortest"), F.max(F.length("props")).cast("long").alias("longest"))


@query("select article_id, try_cast(substr(h, 1, 2) as bigint) as prefix from (select cast(o_orderkey as varchar) as article_id, sha256(cast(o_orderkey as varchar)) as h from orders) where try_cast(substr(h, 1, 2) as bigint) % 13 = 0", base=False)
def hash_prefix_sample(spark, d):
    """FIL-16."""
    rows = views.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("article_id"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("h"))
    # Two hex digits are a number only if both are decimal; a trailing d or f would make Spark's cast accept a float.
    digits = F.when(F.substring("h", 1, 2).rlike("^[0-9]{2}$"), F.substring("h", 1, 2)).try_cast("long")
    return rows.withColumn("prefix", digits).where("prefix % 13 = 0").select("article_id", "prefix")


def _fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Written once: cells, rare words and decisions all read it."""
    made = views.stories(spark, d).select("article_id", "ts", tx.story_prints(F.col("title"), F.col("body")).alias("p"))
    words = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))
    small_batches(spark)
    return stage(made.select("article_id", "ts", words("p.title").alias("title_words"), words("p.body").alias("body_words"), "p.fingerprint"), "stories")


@query()
def near_duplicate_stories(spark, d):
    """JOI-13, SCA-10/11/12: pairs."""
    return screen.near_duplicate_pairs(_fingerprints(spark, d), bands=4, bits=16)


@query()
def story_clusters(spark, d):
    """STA-5."""
    members, links = screen.near_duplicate_cells(_fingerprints(spark, d), bands=4, bits=16)
    return sequential.leader_clusters(members, links.select(F.col("a").alias("article_id"), F.col("b").alias("other")), days=14)


@query("""with recursive c as (select 'S' || lpad(cast(s_suppkey as varchar), 5, '0') as ticker, cast(o_orderkey as varchar) as article_id, o_orderpriority as bucket, strftime(o_orderdate + to_seconds((o_orderkey * 7919) % 86400), '%Y-%m') as month, sha256('5:' || o_orderkey) as hash from orders join supplier on s_suppkey = o_orderkey % (select count(*) from supplier)
), pick as (select ticker, 0 as n, []::struct(a varchar, b varchar, g varchar)[] as picked from (select distinct ticker from c)
  union all select p.ticker, p.n + 1, any_value(p.picked) || [arg_min({'a': c.article_id, 'b': c.bucket, 'g': c.month}, {'x': len(list_filter(p.picked, lambda x: x.b = c.bucket)), 'y': len(list_filter(p.picked, lambda x: x.g = c.month)), 'z': c.hash, 'w': c.article_id})] from pick p join c on c.ticker = p.ticker where p.n < 8 and not list_contains(list_transform(p.picked, lambda x: x.a), c.article_id) group by p.ticker, p.n
), last as (select ticker, picked from pick qualify row_number() over (partition by ticker order by n desc) = 1) select ticker, u.a as article_id, u.b as bucket, u.g as month, i - 1 as pick from (select ticker, unnest(picked) as u, generate_subscripts(picked, 1) as i from last)""", base=False)
def balanced_sample(spark, d):
    """SEL-7, STA-3."""
    rows = views.articles(spark, d).select("ticker", "article_id", F.col("event_type").alias("bucket"), F.date_format("ts", "yyyy-MM").alias("month"), tx.seeded_rank_key(5, F.col("article_id")).alias("hash"))
    return sequential.balanced_pick(rows, "ticker", 8)


@query(""", t as (select ticker, date, close as price, volume::double as volume, case when day(date) % 3 = 0 then null when day(date) % 5 = 0 then 0.0 else day(date) * 2.0 - 25.0 end as target, day(date) % 2 = 0 as located, case when day(date) % 7 = 0 then 0.01 else 50.0 end as edge, row_number() over (partition by ticker order by date) as rn from prices
), walk as (select ticker, 0::bigint as rn, null::date as date, 0.0::double as target, 0.0::double as filled, 0.0::double as position, 0.0::double as remainder, null::varchar as reason from (select distinct ticker from t)
  union all select ticker, rn, date, goal, filled, position + filled, case when reason = 'volume_limit' then want - filled else 0 end, reason from (
    select *, case when reason is null or reason = 'volume_limit' then case when want = 0 then 0 when want > 0 then size else -size end else 0 end as filled from (
      select *, case when want = 0 then null when not (price > 0 and volume > 0) then 'missing_market_data' when goal < 0 and not located then 'locate_unavailable' when edge * size < 2.0 * (greatest(1.0, size * 0.005) + size * price * 5 / 10000 + size * price * 0.1 * pow(least(size / volume, 0.01), 2)) then 'edge_below_cost' when size < abs(want) then 'volume_limit' end as reason from (
        select t.ticker, t.rn, t.date, t.price, t.volume, t.located, t.edge, w.position, coalesce(t.target, 0)::double as goal, coalesce(t.target, 0)::double - w.position as want, least(abs(coalesce(t.target, 0)::double - w.position), t.volume * 0.5) as size from walk w join t on t.ticker = w.ticker and t.rn = w.rn + 1)))
) select ticker, date, target, round(filled, 8) as filled, round(position, 8) as position, round(remainder, 8) as remainder, reason from walk where rn > 0""", recursive=True, text="date")
def rebalance_engine(spark, d):
    """STA-4, CST-5."""
    day = F.dayofmonth("date")
    rows = views.prices(spark, d).select("ticker", "date", F.col("close").alias("price"), F.col("volume").cast("double").alias("volume"), F.when(day % 3 == 0, None).when(day % 5 == 0, 0.0).otherwise(day * 2.0 - 25.0).alias("target"), (day % 2 == 0).alias("located"), F.when(day % 7 == 0, 0.01).otherwise(50.0).alias("edge"))
    return rounded(sequential.rebalance(rows, participation=0.5, multiple=2.0, scenario=costs.BASE))
