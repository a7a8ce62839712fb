"""Schemas of the canonical tables, and closed value sets."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _L, _B = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


ARTICLES = _schema(article_id=_S, provider_timestamp=T.TimestampNTZType(), retrieved_at=T.TimestampNTZType(), title=_S, content=_S, link=_S, symbols=T.ArrayType(_S), tags=T.ArrayType(_S), provider_sentiment_polarity=_D, raw_response_hash=_S)
PRICES = _schema(ticker=_S, date=T.DateType(), open=_D, high=_D, low=_D, close=_D, adjusted_close=_D, volume=_L)
ASSESSMENT = _schema(sentiment_label=_S, sentiment_score=_D, confidence=_D, relevance=_D, materiality=_D, novelty=_D, event_type=_S, expected_horizon=_S, concise_reasoning=_S, tradable=_B, abstain=_B)
USAGE = _schema(input_tokens=_L, cached_tokens=_L, output_tokens=_L, reasoning_tokens=_L, estimated_cost_usd=_D)
LEDGER = _schema(cache_key=_S, article_id=_S, ticker=_S, stage=_S, outcome=_S, from_cache=_B, run_cost_usd=_D, usage=USAGE)
FILLS = _schema(ticker=_S, date=T.DateType(), quantity=_D, price=_D, cost=_D)

SPLITS = ("development", "validation", "holdout")
LABELS = ("bullish", "neutral", "bearish")
