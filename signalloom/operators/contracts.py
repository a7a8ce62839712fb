"""Row and table contracts: what a row violates, as an array of rule names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapsed, word_limit


def violations(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks, in order; a rule that can't be judged (null) counts as broken."""
    return F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items())), lambda x: x.isNotNull())


def unit(column: str) -> Column:
    return F.col(column).between(0, 1)


def assessment_rules() -> dict[str, Column]:
    """Ranges, agreement of label and score, tradable against abstain."""
    s, label = F.col("score"), F.col("label")
    sign = F.when(label == "bullish", s > 0).when(label == "bearish", s < 0).when(label == "neutral", F.abs(s) <= 0.25).otherwise(F.lit(False))
    return {"score_range": s.between(-1, 1), **{f"{c}_range": unit(c) for c in ("confidence", "relevance", "materiality", "novelty")}, "label_sign": sign, "tradable_abstain": F.col("tradable") == ~F.col("abstain")}


def price_rules() -> dict[str, Column]:
    return {**{f"{c}_positive": F.col(c) > 0 for c in ("open", "high", "low", "close", "adjusted_close")}, "volume_not_negative": F.col("volume") >= 0, "high_low": F.col("high") >= F.col("low")}


def sparse_rules(least: float = 0.7) -> dict[str, Column]:
    """Weak evidence must abstain: other events, low relevance or materiality."""
    weak = (F.col("event_type") == "other") | (F.col("relevance") < least) | (F.col("materiality") < least)
    return {"weak_must_abstain": ~weak | F.col("abstain")}


def _said(column: str) -> Column:
    """Whether a text says anything."""
    return F.coalesce(collapsed(F.col(column)) != "", F.lit(False))


def local_rules(words: int = 25) -> dict[str, Column]:
    """An assessment with a short reasoning, and a reason exactly where it abstains."""
    return assessment_rules() | {"reasoning_words": word_limit(F.col("reasoning"), words), "reason_if_abstaining": F.col("abstain") == _said("abstain_reason")}


def surprise_rules(least: float = 0.7) -> dict[str, Column]:
    """What is generic, of no company, unspecific, immaterial, without facts or direction must abstain; a direction has its sign."""
    weak = (F.col("kind") == "other") | ~_said("company") | (F.col("specificity") < least) | (F.col("relevance") < least) | (F.col("materiality") < least) | ~_said("facts") | F.col("direction").isin("none", "unclear")
    sign = F.when(F.col("direction") == "positive", F.col("score") > 0).when(F.col("direction") == "negative", F.col("score") < 0).otherwise(F.lit(True))
    return {"weak_must_abstain": ~weak | F.col("abstain"), "reason_if_abstaining": F.col("abstain") == _said("abstain_reason"), "direction_sign": sign}


def usage_rules() -> dict[str, Column]:
    """Token counts aren't negative, and parts don't exceed the whole."""
    names = ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_tokens")
    return {**{f"{c}_negative": F.col(c) >= 0 for c in names}, "cached_exceed_input": F.col("cached_input_tokens") <= F.col("input_tokens"), "reasoning_exceed_output": F.col("reasoning_tokens") <= F.col("output_tokens")}


def inference_rules(event_types: Sequence[str]) -> dict[str, Column]:
    """An inference row: valid JSON, a hash of 64 digits, ranges, a known event type, flags and evidence present."""
    return {"valid_json": F.col("valid_json"), "article_hash": F.length("article_hash") == 64, **{f"{c}_range": unit(c) for c in ("confidence", "relevance", "materiality", "novelty")}, "score_range": F.col("score").between(-1, 1), "event_type": F.col("event_type").isin(*event_types), "abstain": F.col("abstain").isNotNull(), "evidence": F.col("reasoning").isNotNull()}


def run_gates(rows: DataFrame, run: str, *, total: int, least: int = 500, most_invalid: float = 0.02, most_other: float = 0.40, least_tradable: float = 0.25, most_label: float = 0.85, most_days: float = 7.0) -> DataFrame:
    """Quality gates of each run (failed, event_type, tradable, label, seconds): names of those that fail; none under ``least`` rows.

    Shares are of the rows that didn't fail; the run's time is projected to ``total`` rows.
    """
    ok = ~F.col("failed")
    top = rows.where(ok).groupBy(run, "label").agg(F.count("*").alias("_n")).groupBy(run).agg(F.max("_n").alias("_top"))
    count = lambda c: F.count(F.when(c, 1))
    m = rows.groupBy(run).agg(F.count("*").alias("processed"), count(F.col("failed")).alias("_bad"), count(ok).alias("_ok"), count(ok & (F.col("event_type") == "other")).alias("_other"), count(ok & F.col("tradable")).alias("_tradable"), F.sum("seconds").alias("_s")).join(top, run, "left")
    share = lambda c: F.try_divide(F.col(c), F.col("_ok"))
    fails = {"invalid_output": F.col("_bad") / F.col("processed") > most_invalid, "other_share": share("_other") > most_other, "tradable_share": share("_tradable") < least_tradable, "label_share": share("_top") > most_label, "projected_days": F.col("_s") / F.col("processed") * total / 86_400 > most_days}
    found = F.array_join(F.filter(F.array(*(F.when(bad, name) for name, bad in fails.items())), lambda x: x.isNotNull()), ",")
    return m.select(run, "processed", F.when(F.col("processed") < least, "").otherwise(found).alias("failures"))


def table_contract(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, distinct keys, null keys and rows with any violation (column ``violations``)."""
    return df.agg(F.count("*").alias("n"), F.count_distinct(key).alias("distinct_keys"), F.count(F.when(F.col(key).isNull(), 1)).alias("null_keys"), F.count(F.when(F.size("violations") > 0, 1)).alias("violating"))


def dataset_hash(rows: DataFrame, digest: str, *keys: str) -> DataFrame:
    """``dataset_hash`` of each key, the same for any order of rows, and n.

    Row digests (hexadecimal) are sorted and hashed within 65,536 buckets by
    their first digits, and the buckets' digests in order once more, so no row
    holds more than a bucket's digests.
    """
    buckets = rows.groupBy(*keys, F.substring(digest, 1, 4).alias("_b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(digest)), ""), 256).alias("_d"), F.count("*").alias("_n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_b", "_d"))), lambda x: x["_d"])
    return buckets.groupBy(*keys).agg(F.sha2(F.array_join(ordered, ""), 256).alias("dataset_hash"), F.sum("_n").alias("n"))


def require_columns(df: DataFrame, *names: str) -> None:
    """Error on missing columns, before anything runs."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def one_to_one(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Inner join that fails at run time if either side repeats a key."""
    def guarded(df: DataFrame, tag: str) -> DataFrame:
        counts = df.groupBy(on).agg(F.count("*").alias("_c"))
        checked = counts.select(on, F.when(F.col("_c") > 1, F.raise_error(F.concat(F.lit(f"repeated key on the {tag}: "), F.col(on).cast("string")))).otherwise(F.lit(1)).alias("_ok"))
        return df.join(checked.where("_ok = 1").drop("_ok"), on)

    return guarded(left, "left").join(guarded(right, "right"), on)
