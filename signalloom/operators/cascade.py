"""Two-stage classification with a content-keyed cache: misses, escalations, ledgers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage as staged

# Event types that are always escalated.
ALWAYS_ESCALATE = ("earnings_results", "guidance", "merger_acquisition", "regulatory_action", "fraud_accounting", "bankruptcy")


def split_cache(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with the cached columns, misses once a key): equal content is sent once."""
    hits = requests.join(cache, "cache_key")
    misses = requests.join(cache, "cache_key", "left_anti").groupBy("cache_key").agg(F.min("article_id").alias("article_id"), F.count("*").alias("waiting"))
    return hits, misses


def verified(cache: DataFrame, result: str, digest: str) -> DataFrame:
    """Cached rows whose digest is that of their result; others count as misses."""
    return cache.where(F.sha2(F.col(result), 256) == F.col(digest))


def rebind(requests: DataFrame, hits: DataFrame, *, stage: str) -> DataFrame:
    """Cached results bound to the article that asks: identity and stage are the request's, the result and its usage the cache's."""
    return requests.join(hits.drop("bound_to", "stage", "article_id"), "cache_key").withColumns({"bound_to": F.col("article_id"), "stage": F.lit(stage), "from_cache": F.lit(True)})


# Prefixes of custom ids, by stage.
STAGES = {"first_pass": "fp-", "escalation": "esc-"}


def prepare(requests: DataFrame, role: str, *, system: str, fields: tuple[str, ...]) -> DataFrame:
    """One request a distinct content and stage: custom id, system text and message of named fields; the least article stands for equal contents."""
    first = requests.groupBy("cache_key").agg(F.min_by(F.struct(*requests.columns), "article_id").alias("r")).select("r.*")
    stages = F.explode(F.array(*(F.struct(F.lit(k).alias("stage"), F.lit(p).alias("prefix")) for k, p in STAGES.items())))
    message = F.concat_ws("\n", *(F.concat(F.lit(f"{f}: "), F.col(f).cast("string")) for f in fields))
    rows = first.withColumn("_s", stages).withColumns({"stage": F.col("_s.stage"), "custom_id": F.concat("_s.prefix", F.substring("cache_key", 1, 24)), "system": F.replace(F.lit(system), F.lit("{role}"), F.col(role)), "message": message})
    return rows.drop("_s")


def audit(rows: DataFrame, *, limit: float) -> DataFrame:
    """Saved usage by stage (the prefix of custom ids): rows, distinct ids, tokens, cost, the largest preflight, and whether all preflights exceed the budget."""
    stage = F.substring_index("custom_id", "-", 1).alias("stage")
    return rows.groupBy(stage).agg(F.count("*").alias("rows"), F.count_distinct("custom_id").alias("distinct_ids"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"), F.max("preflight").alias("max_preflight"), (F.round(F.sum("preflight"), 8) > limit).alias("over_budget"))


def ledger(requests: DataFrame, cache: DataFrame, failed: Column, price: Column) -> DataFrame:
    """One row a request: outcome and what this run pays. Hits pay nothing; of equal misses only the first pays."""
    known = cache.select("cache_key", F.lit(True).alias("from_cache"))
    nth = F.row_number().over(Window.partitionBy("cache_key").orderBy("article_id"))
    rows = requests.join(known, "cache_key", "left").withColumn("from_cache", F.coalesce("from_cache", F.lit(False))).withColumn("_nth", nth)
    outcome = F.when(F.col("from_cache"), "cache_hit").when(failed, "api_failure").when(F.col("_nth") > 1, "duplicate_request").otherwise("api_success")
    return rows.withColumn("outcome", outcome).withColumn("run_cost_usd", F.when(~F.col("from_cache") & (F.col("_nth") == 1), price).otherwise(0.0)).drop("_nth")


def escalation_reasons(confidence: float = 0.6, materiality: float = 0.75, relevance: float = 0.6, ambiguous: float = 0.3) -> Column:
    """Why a first pass is escalated, in order; nothing for immaterial neutrals; needs the flag ``contradictory``."""
    c, m = F.col("confidence"), F.col("materiality")
    made = F.array(
        F.when(c < confidence, "confidence_below_threshold"), F.when(m >= materiality, "high_materiality"),
        F.when(F.col("event_type").isin(*ALWAYS_ESCALATE), F.concat(F.lit("event_type:"), F.col("event_type"))),
        F.when((F.col("event_type") == "litigation") & (m >= materiality), "event_type:major_litigation"),
        F.when(~F.col("abstain") & (m > 0) & (F.col("relevance") >= relevance) & (m >= ambiguous) & F.col("contradictory"), "contradictory_article_evidence"),
    )
    quiet = (F.col("label") == "neutral") & (m < ambiguous)
    return F.when(quiet, F.array().cast("array<string>")).otherwise(F.filter(made, lambda x: x.isNotNull()))


def capped_by_priority(df: DataFrame, priority: Column, order: str, keep: int) -> DataFrame:
    """``selected``: the first ``keep`` rows by (priority, order)."""
    chosen = df.withColumn("_p", priority).orderBy("_p", order).limit(keep).select(order, F.lit(True).alias("selected"))
    return df.join(F.broadcast(chosen), order, "left").withColumn("selected", F.coalesce("selected", F.lit(False)))


def usage_totals(rows: DataFrame, *keys: str) -> DataFrame:
    """Requests, hits, failures, tokens and cost of each stage."""
    return rows.groupBy(*keys).agg(F.count("*").alias("requests"), F.count(F.when(F.col("outcome") == "cache_hit", 1)).alias("hits"), F.count(F.when(F.col("outcome") == "api_failure", 1)).alias("failures"), F.sum("tokens").alias("tokens"), F.sum("run_cost_usd").alias("run_cost_usd"), F.count_distinct("cache_key").alias("distinct_keys"))


def cascade(requests: DataFrame, first: Callable[[DataFrame], DataFrame], second: Callable[[DataFrame], DataFrame], keep: int) -> DataFrame:
    """First pass over all, escalation of the most pressing ``keep``, the second opinion in place of the first.

    ``first`` and ``second`` map rows to rows with the same assessment columns
    (mapInPandas over a client, or a lookup); the first pass ends, written, before any escalation.
    """
    passed = staged(first(requests), "first-pass")
    reasons = passed.withColumn("reasons", escalation_reasons())
    chosen = capped_by_priority(reasons.where(F.size("reasons") > 0), -F.size("reasons"), "article_id", keep).where("selected").drop("selected")
    again = second(chosen.drop("reasons"))
    return passed.join(again.select("article_id"), "article_id", "left_anti").withColumn("stage", F.lit("first_pass")).unionByName(again.withColumn("stage", F.lit("escalation")))
