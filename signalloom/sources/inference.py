"""Model outputs as a source: only what the cache lacks is asked, with repairs; the client is injected.

A client factory runs once a Python worker. Misses are distinct contents, so
equal articles are asked once; what comes back is bound to them by the key.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Attempts at a valid answer: the first and two repairs.
ATTEMPTS = 3
Ask = Callable[[dict, list[str]], tuple[str, int]]


def repaired(row: dict, ask: Ask, errors_of: Callable[[Any], list[str]], attempts: int = ATTEMPTS) -> tuple[str | None, int, int, str | None]:
    """(valid JSON or None, attempts made, tokens over all of them, last errors).

    ``ask(row, errors)`` gives a text and its tokens; errors of the answer before
    are handed to the next attempt. A text that isn't a JSON object counts as an error.
    """
    errors, tokens = [], 0
    for n in range(1, attempts + 1):
        text, used = ask(row, errors)
        tokens += used
        try:
            value = json.loads(text)
            errors = errors_of(value) if isinstance(value, dict) else ["not an object"]
        except ValueError:
            errors = ["not JSON"]
        if not errors:
            return json.dumps(value, sort_keys=True, separators=(",", ":")), n, tokens, None
    return None, attempts, tokens, "; ".join(errors)


def classify(requests: DataFrame, cache: DataFrame, client: Callable[[], Ask], errors_of: Callable[[Any], list[str]], *, attempts: int = ATTEMPTS) -> DataFrame:
    """One row a request: article_id, cache_key, result, attempts, tokens, error and from_cache.

    ``requests``: article_id, cache_key and what the client reads. ``cache``:
    cache_key and result. Tokens of a content asked for several articles count
    with the least article only. An error leaves result null. No requests give no rows.
    """
    columns = [c for c in requests.columns if c != "article_id"]
    misses = requests.join(cache.select("cache_key"), "cache_key", "left_anti").groupBy("cache_key").agg(F.min_by(F.struct(*columns), "article_id").alias("r"), F.min("article_id").alias("first_id")).select("r.*", "first_id")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = client()
        for part in parts:
            out = [(row["cache_key"], row["first_id"], *repaired(row, ask, errors_of, attempts)) for row in part.to_dict("records")]
            yield pd.DataFrame(out, columns=["cache_key", "first_id", "result", "attempts", "tokens", "error"])

    asked = misses.mapInPandas(run, "cache_key string, first_id string, result string, attempts int, tokens long, error string")
    known = cache.select("cache_key", F.lit(None).cast("string").alias("first_id"), "result", F.lit(0).alias("attempts"), F.lit(0).cast("long").alias("tokens"), F.lit(None).cast("string").alias("error"), F.lit(True).alias("from_cache"))
    both = known.unionByName(asked.withColumn("from_cache", F.lit(False)))
    return requests.select("article_id", "cache_key").join(both, "cache_key").select("article_id", "cache_key", "result", "attempts", F.when(F.col("article_id") == F.col("first_id"), F.col("tokens")).otherwise(0).alias("tokens"), "error", "from_cache")


def score(articles: DataFrame, cache: DataFrame, scorer: Callable[[], Callable[[list[str]], list[tuple[float, float, float]]]], *, allow: bool, batch: int = 32) -> DataFrame:
    """article_id, score (positive less negative probability) and from_cache, by article_id.

    ``articles``: article_id, cache_key, text. The scorer gives three logits
    (positive, negative, neutral) a text; probabilities are their softmax. Unless
    allowed, a content that the cache (cache_key, score) lacks fails when it runs.
    """
    missing = articles.join(cache.select("cache_key"), "cache_key", "left_anti").groupBy("cache_key").agg(F.min_by("text", "article_id").alias("text"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        model = scorer()
        for part in parts:
            for a in range(0, len(part), batch):
                cut = part.iloc[a : a + batch]
                x = np.asarray(model(cut["text"].fillna("").tolist()), dtype=float)
                p = np.exp(x - x.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                yield pd.DataFrame({"cache_key": cut["cache_key"].to_numpy(), "score": p[:, 0] - p[:, 1]})

    if allow:
        fresh = missing.mapInPandas(run, "cache_key string, score double")
    else:
        fresh = missing.select("cache_key", F.raise_error(F.concat(F.lit("not in the cache: "), F.col("cache_key"))).cast("double").alias("score"))
    both = cache.select("cache_key", "score", F.lit(True).alias("from_cache")).unionByName(fresh.withColumn("from_cache", F.lit(False)))
    return articles.select("article_id", "cache_key").join(both, "cache_key").select("article_id", "score", "from_cache").orderBy("article_id")
