"""Resampling, specification search, greedy samples, configuration, inference sources and frames against plain versions."""

import datetime as dt
import json
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalloom import config
from signalloom.functions.stats import correlation_p, hashed_pick, is_close, normal_p
from signalloom.functions import text as tx
from signalloom.operators import contracts, frames, graph, metrics, resample, selection
from signalloom.plans import decisions
from signalloom.sources import inference, landing


def test_resamples_are_resamples(spark):
    rng = np.random.default_rng(3)
    means = rng.normal(size=80)
    df = spark.createDataFrame([(f"e{i:03}", float(v)) for i, v in enumerate(means)], "entity string, v double")
    w = resample.entity_weights(df, "entity", draws=200, seed=1).toPandas()
    assert (w.groupby("draw").w.sum() == 80).all() and w.draw.nunique() == 200
    # The share of entities that a draw leaves out is near 1 / e, and no two draws are alike.
    assert abs(1 - w.groupby("draw").entity.nunique().mean() / 80 - math.exp(-1)) < 0.02
    got = resample.mean_interval(df, "v", "entity", draws=800).first()
    own = np.quantile([means[rng.integers(0, 80, 80)].mean() for _ in range(4000)], [0.025, 0.975])
    assert np.allclose([got.lower_95, got.upper_95], own, atol=0.06) and got.draws == 800
    assert resample.mean_interval(df.limit(1), "v", "entity").first().lower_95 is None


def test_blocks_are_consecutive(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(23)]
    df = spark.createDataFrame([(d,) for d in days], "date date")
    w = resample.block_weights(df, "date", block=5, draws=50, seed=2).toPandas()
    assert (w.groupby("draw").w.sum() == 23).all()
    starts = Counter()
    for _, part in w.groupby("draw"):
        starts.update(days.index(d) for d in part.date)
    assert len(starts) == 23
    assert resample.block_weights(df.limit(9), "date", block=5, draws=5, seed=2).count() == 0


def test_intervals_of_correlations_against_rows_repeated(spark):
    rng = np.random.default_rng(5)
    rows = [(f"c{i % 9}", float(x), float(x * 0.5), float(round(x + e, 1)), ["bullish", "bearish", "neutral"][i % 3]) for i, (x, e) in enumerate(rng.normal(size=(120, 2)))]
    df = spark.createDataFrame(rows, "ticker string, score double, weighted double, ret double, label string")
    w = {(r.draw, r.ticker): r.w for r in resample.entity_weights(df, "ticker", draws=15, seed=4).collect()}
    ranks = lambda v: np.array([np.mean(np.flatnonzero(np.sort(v) == x)) for x in v])
    stats = []
    for d in range(15):
        part = [r for r in rows for _ in range(w.get((d, r[0]), 0))]
        x, y = np.array([r[1] for r in part]), np.array([r[3] for r in part])
        stats.append((np.corrcoef(x, y)[0, 1], np.corrcoef(ranks(x), ranks(y))[0, 1]))
    got = {r.statistic: (r.lower_95, r.upper_95) for r in resample.company_intervals(df, score="score", weighted="weighted", ret="ret", label="label", entity="ticker", draws=15, seed=4).collect()}
    for name, i in (("pearson_ic", 0), ("spearman_ic", 1)):
        assert np.allclose(got[name], np.quantile([s[i] for s in stats], [0.025, 0.975]), atol=1e-9)


def test_picks_and_p_values(spark):
    row = spark.range(1000).select(hashed_pick(1, F.lit(7).cast("long"), F.col("id")).alias("p")).groupBy("p").count().collect()
    assert len(row) == 7 and all(100 < r["count"] < 190 for r in row)
    p = spark.createDataFrame([(0.5, 20), (1.0, 9), (None, 9), (0.1, 2)], "r double, n long").select(correlation_p("r", "n").alias("p")).collect()
    assert abs(p[0].p - 0.02478) < 1e-4 and p[1].p == 0 and p[2].p is None and p[3].p is None
    z = spark.createDataFrame([(1.959963984540054,), (0.0,), (None,)], "z double").select(normal_p("z").alias("p")).collect()
    assert abs(z[0].p - 0.05) < 1e-12 and z[1].p == 1 and z[2].p is None
    assert spark.range(1).select(is_close(F.lit(1.0), F.lit(1.0 + 5e-9)).alias("x")).first().x


def test_quota_sample_against_the_rule(spark):
    random.seed(1)
    names = list(selection.BUCKET_TARGETS)[:5]
    rows = []
    for i in range(900):
        buckets = [b for b in names if random.random() < 0.1] or ["general_calibration"]
        rows.append((f"a{i:04}", f"t{random.randint(0, 14) ** 2 // 14}", f"s{random.randint(0, 4)}", buckets, f"{random.random():.12f}"))
    targets = dict.fromkeys(selection.BUCKET_TARGETS, 9)
    order = sorted(rows, key=lambda r: (r[3] == ["general_calibration"], r[4], r[0]))
    taken, tickers, sectors, held = {}, Counter(), Counter(), Counter()
    for name, target in [*targets.items(), ("fill", 70)]:
        for r in order:
            if len(taken) >= 70 or held[name] >= target:
                break
            if (name == "fill" or name in r[3]) and r[0] not in taken and tickers[r[1]] < 6 and sectors[r[2]] < 18:
                taken[r[0]] = name
                tickers[r[1]] += 1
                sectors[r[2]] += 1
                held.update(r[3])
    df = spark.createDataFrame(rows, "article_id string, ticker string, sector string, buckets array<string>, rank string")
    got = selection.quota_sample(df, most=70, per_ticker=6, per_sector=18, targets=targets).orderBy("pick").collect()
    assert [(r.article_id, r.picked_for) for r in got] == list(taken.items()) and len(taken) > 60


def test_components_reach_a_fixed_point(spark):
    links = [(f"n{i:03}", f"n{i + 1:03}") for i in range(70)] + [("x", "y"), ("y", "x"), ("z", "z")]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "u string, v string")).collect()}
    assert set(got.values()) == {"n000", "x"} and len(got) == 73
    assert graph.components(spark.createDataFrame([], "u string, v string")).count() == 0


def test_frames(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    r = frames.row_difference(a, b).first()
    assert (r.left_rows, r.right_rows) == (1, 0)
    assert frames.map_equality(b, b, "k", "v").first().equal
    assert not frames.map_equality(b, spark.createDataFrame([(1, None), (3, "z")], "k int, v string"), "k", "v").first().equal
    with pytest.raises(Exception, match="line up"):
        frames.zipped(b, spark.createDataFrame([(1, "x"), (2, "q")], "k int, v string"), "k", ("v",)).collect()
    assert frames.zipped(b, b, "k", ("v",)).count() == 2
    wide = frames.relaxed_union(spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(2.5, "n")], "k double, w string"))
    assert wide.dtypes == [("k", "double"), ("w", "string")] and wide.count() == 2
    with pytest.raises(ValueError):
        frames.relaxed_union(spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([("1",)], "k string"))
    typed = frames.canonical(spark.createDataFrame([(" ", "7x")], "a string, n string"), {"a": "string", "n": "int", "m": "double"}).first()
    assert typed.a is None and typed.n is None and typed.m is None


def test_one_to_one_and_contracts(spark):
    left = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(Exception, match="repeated key"):
        contracts.one_to_one(left, left.limit(1), "k").collect()
    assert contracts.dataset_hash(spark.createDataFrame([("ab",), ("cd",)], "h string"), "h").first() == contracts.dataset_hash(spark.createDataFrame([("cd",), ("ab",)], "h string"), "h").first()
    clean = spark.createDataFrame([("", 1)], "s string, x int").select(tx.word_limit(F.col("s"), 3).alias("a"), tx.word_limit(F.lit(" one  two "), 2).alias("b"), tx.word_limit(F.lit("a b c"), 2).alias("c")).first()
    assert (clean.a, clean.b, clean.c) == (False, True, False)
    with pytest.raises(ValueError):
        decisions.select_best(left, {"a": F.lit(1.0)}, {"a": 0.5}, "k")
    empty = metrics.ledger_performance(spark.createDataFrame([], "date date, r double"), "r").first()
    assert (empty.sessions, empty.total_return, empty.sharpe) == (0, 0.0, None)


def test_configuration():
    good = {"sample": {"tickers": ["A", "B"], "start": "2024-01-01", "end": "2024-02-01", "size": 80}, "models": [{"name": "m-mini", "input_price": 1, "output_price": 2.0}], "weights": {"a": 0.5, "b": 0.5}}
    made = config.load(config.Study, json.dumps(good), {"STUDY_DATA_ROOT": "elsewhere"})
    assert made.data_root == "elsewhere" and made.sample.horizons == (1, 5, 21) and made.models[0].input_price == 1.0
    for place, value in ((("sample", "size"), 81), (("sample", "tickers"), ["A", "A"]), (("sample", "horizons"), [1, 5]), (("sample", "end"), "2023-01-01"), (("sample", "odd"), 1), (("weights",), {"a": 0.4}), (("input_hashes",), {"x": "no"}), (("models",), [good["models"][0]] * 2), (("models",), [{"name": "m-pro", "input_price": 1, "output_price": 1}]), (("sample", "per_company"), "forty")):
        bad = json.loads(json.dumps(good))
        at = bad
        for step in place[:-1]:
            at = at[step]
        at[place[-1]] = value
        with pytest.raises(ValueError):
            config.load(config.Study, json.dumps(bad), {})
    assert config.extract({"a": {"b": 3}}, {"x": "a.b"}) == {"x": 3}
    with pytest.raises(ValueError):
        config.extract({"a": 1}, {"x": "a.b"})
    assert config.redacted({"api_key": "s", "x": [{"token": 1, "y": 2}]}) == {"api_key": "***", "x": [{"token": "***", "y": 2}]}


def test_only_cache_misses_are_asked_and_repaired(spark):
    def client():
        def ask(row, errors):
            n = row["body"]
            return ('{"v": 1}' if n == "good" or (n == "mends" and errors) else "no json"), 10

        return ask

    errors_of = lambda v: [] if v.get("v") == 1 else ["v"]
    requests = spark.createDataFrame([("1", "k1", "good"), ("2", "k1", "good"), ("3", "k2", "mends"), ("4", "k3", "bad"), ("5", "k4", "cached")], "article_id string, cache_key string, body string")
    cache = spark.createDataFrame([("k4", "{}")], "cache_key string, result string")
    got = {r.article_id: (r.result, r.attempts, r.tokens, r.error, r.from_cache) for r in inference.classify(requests, cache, client, errors_of).collect()}
    assert got == {"1": ('{"v":1}', 1, 10, None, False), "2": ('{"v":1}', 1, 0, None, False), "3": ('{"v":1}', 2, 20, None, False), "4": (None, 3, 30, "not JSON", False), "5": ("{}", 0, 0, None, True)}
    scorer = lambda: lambda texts: [(1.0, 0.0, 0.0) if t == "good" else (0.0, 1.0, 0.0) for t in texts]
    articles = requests.select("article_id", "cache_key", F.col("body").alias("text"))
    known = spark.createDataFrame([("k4", 0.25)], "cache_key string, score double")
    rows = inference.score(articles, known, scorer, allow=True).collect()
    assert [r.article_id for r in rows] == list("12345") and rows[0].score == rows[1].score > 0 > rows[2].score and rows[4].score == 0.25
    with pytest.raises(Exception, match="not in the cache"):
        inference.score(articles, known, scorer, allow=False).collect()


def test_landing_zone(spark, tmp_path):
    root = f"file://{tmp_path}/raw"
    body = json.dumps([{"date": "2024-01-02T00:00:00", "title": " T ", "content": "c", "link": "l", "symbols": ["b.us", "A.US"], "tags": []}])
    first = landing.land(root, "/news", {"s": "A", "api_token": "1"}, body)
    assert landing.land(root, "/news", {"s": "A", "api_token": "2"}, body) == first
    landing.land(root, "/news", {"s": "B"}, body)
    assert landing.landed(spark, root).count() == 1
    rows = spark.createDataFrame([("A", json.dumps(x)) for x in json.loads(body) * 2], "ticker string, body string")
    assert [r.title for r in landing.paged_articles(rows).collect()] == ["T"]


def test_specifications_from_one_row_an_event(spark):
    """Against every combination taken by itself, with ties, nulls and crowded company-days; an event isn't repeated a combination."""
    import pandas as pd

    from signalloom.operators import specification

    rng, day = random.Random(3), dt.date(2024, 1, 1)
    rows = []
    for i in range(240):
        entry = day + dt.timedelta(days=rng.randrange(12))
        x = lambda: rng.choice([None, -0.5, -0.25, 0.0, 0.25, 0.5, rng.random()])
        rows.append((f"{i:03}", rng.choice("ABCD"), entry, rng.choice(["development", "validation", "holdout"]), None if i % 3 else day + dt.timedelta(days=20), rng.random() < 0.9, rng.random() < 0.1, *(rng.choice([0.0, 0.5, 0.7, 0.9]) for _ in range(3)), entry + dt.timedelta(days=5), entry + dt.timedelta(days=21), rng.choice([None, 0.1, -0.1, rng.random()]), rng.choice([0.0, rng.random()]), x(), x()))
    names = "article_id ticker entry_date research_split next_split_entry_date tradable abstain confidence relevance materiality exit_date_5d exit_date_21d future_return_5d future_return_21d one two".split()
    kinds = "string string date string date boolean boolean double double double date date double double double double".split()
    events = spark.createDataFrame(rows, ", ".join(map(" ".join, zip(names, kinds, strict=True))))
    grid = specification.Grid(signals=("one", "two"))
    want, left = {}, [dict(zip(names, r, strict=True)) for r in rows]
    left = [r for r in left if r["tradable"] and not r["abstain"] and r["research_split"] != "holdout"]
    spec = -1
    for s in grid.signals:
        for a in grid.aggregations:
            for c in grid.confidence:
                for q in grid.relevance:
                    for m in grid.materiality:
                        spec += 1
                        met, days = [r for r in left if r["confidence"] >= c and r["relevance"] >= q and r["materiality"] >= m], {}
                        for r in met:
                            days.setdefault((r["research_split"], r["ticker"], r["entry_date"]), []).append(r)
                        if a == "event_level":
                            made = [(r, r[s]) for r in met]
                        elif a == "strongest_company_day":
                            made = [(r, r[s]) for g in days.values() for r in [min(g, key=lambda r: (r[s] is None, -abs(r[s] or 0), r["article_id"]))]]
                        else:
                            made = [(min(g, key=lambda r: r["article_id"]), pd.Series([r[s] for r in g], dtype=float).mean()) for g in days.values()]
                        for split in ("development", "validation"):
                            for h in (5, 21):
                                pairs = pd.DataFrame([(x, r[f"future_return_{h}d"]) for r, x in made if r["research_split"] == split and (r["next_split_entry_date"] is None or r[f"exit_date_{h}d"] < r["next_split_entry_date"])], columns=["x", "y"], dtype=float).dropna().round({"x": 12})
                                if len(pairs):
                                    ic = pairs.x.rank().corr(pairs.y.rank()) if len(pairs) >= 3 and pairs.x.nunique() > 1 and pairs.y.nunique() > 1 else None
                                    want[spec, split, h] = (len(pairs), ic)
    for held in (specification.HELD, 0):
        got = {(r.spec_id, r.research_split, r.horizon): (r.n, r.ic) for r in specification.associations(events, grid, held).collect()}
        assert got.keys() == want.keys()
        for k, (n, ic) in want.items():
            assert got[k][0] == n and (got[k][1] is None if ic is None else abs(got[k][1] - ic) < 5e-3), (k, got[k], want[k])
    made = specification.items(events, grid, specification._cells(grid))
    assert made.where("event <> 0").count() == len(left) and made.count() < 3 * len(left)
