"""Hand-computed cases of the event-study operators."""

import datetime as dt
import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from signalloom.functions import text as tx
from signalloom.operators import align, cascade, contracts, costs, metrics, portfolio, screen, sequential, signals, splits
from signalloom.plans import catalog_text, decisions, governance, views
from signalloom.sources import landing, rest, sinks

D = dt.date
PRICES = "ticker string, date date, open double, high double, low double, close double, adjusted_close double, volume long"


def prices_of(spark, days, adjusted=None, ticker="A"):
    rows = [(ticker, d, c, c, c, c, a, 1000) for d, c, a in zip(days, (100.0, 102.0, 105.0, 110.0, 112.0, 115.0), adjusted or (100.0, 102.0, 105.0, 110.0, 112.0, 115.0))]
    return spark.createDataFrame(rows, PRICES)


def articles_of(spark, rows):
    out = spark.createDataFrame(rows, "article_id string, ticker string, ts timestamp_ntz")
    return out.withColumn("pub_date", align.local_date(F.col("ts")))


def test_entry_is_the_first_session_strictly_after_the_local_date(spark):
    days = [D(2026, 5, 1), D(2026, 5, 4), D(2026, 5, 5), D(2026, 5, 6)]
    line = align.sessions(prices_of(spark, days), [1, 3])
    rows = [("friday evening", "A", dt.datetime(2026, 5, 1, 21, 0)), ("utc saturday, local friday", "A", dt.datetime(2026, 5, 2, 2, 0)), ("before all", "A", dt.datetime(2020, 1, 1)), ("after all", "A", dt.datetime(2026, 5, 6, 15, 0)), ("other", "B", dt.datetime(2026, 5, 1))]
    got = {r.article_id: r for r in align.forward_returns(align.next_session(articles_of(spark, rows), line), [1, 3]).withColumn("at", align.open_utc(F.col("entry_date"))).collect()}
    assert len(got) == 5
    r = got["friday evening"]
    assert (r.entry_date, r.at, r.exit_date_3d) == (D(2026, 5, 4), dt.datetime(2026, 5, 4, 13, 30), D(2026, 5, 6))
    assert math.isclose(r.future_return_1d, 0.0) and math.isclose(r.future_return_3d, 110 / 102 - 1)
    assert got["utc saturday, local friday"].entry_date == D(2026, 5, 4) and got["before all"].entry_date == D(2026, 5, 1)
    assert got["after all"].entry_date is None and got["other"].entry_date is None


def test_adjusted_open_and_missing_horizon(spark):
    df = spark.createDataFrame([("A", D(2026, 5, 4), 200.0, 200.0, 200.0, 200.0, 100.0, 1)], PRICES)
    r = align.sessions(df, [5]).first()
    assert r.adj_open == 100.0 and r.exit_date_5d is None


def test_holding_paths_are_whole_or_absent(spark):
    days = [D(2026, 5, d) for d in (1, 4, 5, 6)]
    line = align.sessions(prices_of(spark, days), [1])
    held = spark.createDataFrame([("x", "A", days[1]), ("y", "A", days[2]), ("z", "A", D(2026, 5, 2))], "article_id string, ticker string, entry_date date")
    got = align.position_returns(align.holding_days(held, line, 3)).orderBy("pos").collect()
    assert [(r.article_id, r.date) for r in got] == [("x", d) for d in days[1:]]
    assert [round(r.day_return, 6) for r in got] == [0.0, round(105 / 102 - 1, 6), round(110 / 105 - 1, 6)]


def test_splits_purge_and_folds(spark):
    rows = [(str(i), "A", dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * i), D(2024, 1, 2) + dt.timedelta(days=i // 4), D(2024, 1, 5) + dt.timedelta(days=i // 4)) for i in range(20)]
    df = spark.createDataFrame(rows, "article_id string, ticker string, ts timestamp_ntz, entry_date date, exit_date_5d date")
    got = splits.next_boundary(splits.assign_splits(df, "ts", "ticker", "article_id"))
    assert {r.research_split: r["count"] for r in got.groupBy("research_split").count().collect()} == {"development": 12, "validation": 4, "holdout": 4}
    assert [int(r.article_id) for r in got.orderBy("chronological_index").collect()] == list(range(20))
    kept = {int(r.article_id) for r in got.where(splits.unpurged(5)).collect()}
    assert kept == {i for i in range(20) if i >= 16 or (i < 12 and rows[i][4] < rows[12][3]) or (12 <= i < 16 and rows[i][4] < rows[16][3])}
    ends = df.withColumn("end", F.col("ts") + F.expr("interval 2 days"))
    folds = splits.walk_forward(ends, "ts", "end", "article_id", folds=3, embargo_days=1).orderBy("fold").collect()
    assert [(f.fold, f.n_validation, f.n_train) for f in folds] == [(1, 6, sum(rows[i][2] + dt.timedelta(days=2) < rows[6][2] for i in range(6))), (2, 8, sum(rows[i][2] + dt.timedelta(days=2) < rows[12][2] for i in range(12)))]


def test_signals(spark):
    df = spark.createDataFrame([("a", "t", 0.3, 0.5, 0.5, 0.5, "development"), ("b", "t", -0.8, 0.5, 0.5, 0.5, "development"), ("c", "t", 0.8, 0.5, 0.5, 0.5, "holdout")], "article_id string, ticker string, score double, confidence double, materiality double, novelty double, research_split string")
    assert [r.article_id for r in signals.strongest(df, "score", "ticker").collect()] == ["b"]
    assert [round(r.signal_novel, 4) for r in signals.with_ladder(df).orderBy("article_id").collect()] == [0.0375, -0.1, 0.1]
    z = {r.article_id: r.z for r in signals.standardise(df, "score", "z").collect()}
    assert math.isclose(z["a"], -z["b"]) and math.isclose(z["a"], 1 / math.sqrt(2))
    assert [r[0] for r in df.select(signals.half_open(F.col("score"), [0.3, 0.8])).collect()] == ["0.30-0.80", "<0.30", ">=0.80"]
    with pytest.raises(ValueError):
        signals.signal("unknown")


def test_association_needs_spread(spark):
    rows = [("a", 1.0, 1.0), ("a", 2.0, 4.0), ("a", 2.0, 4.0), ("a", 3.0, 9.0), ("b", 1.0, 1.0), ("b", 1.0, 2.0), ("b", 1.0, 3.0), ("c", 1.0, 2.0)]
    got = {r.k: r for r in metrics.association(spark.createDataFrame(rows, "k string, x double, y double"), "x", "y", "k").collect()}
    assert math.isclose(got["a"].spearman, 1.0) and got["a"].pearson < 1 and got["b"].pearson is None and got["c"].spearman is None


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None)], "spec_id long, p double")
    q = {r.spec_id: r.q_value for r in metrics.benjamini_hochberg(df, "p").collect()}
    assert math.isclose(q[1], 0.03) and math.isclose(q[2], 0.04) and math.isclose(q[3], 0.04) and q[4] is None


def test_drawdown_starts_at_the_first_equity(spark):
    df = spark.createDataFrame([(D(2024, 1, i + 1), r) for i, r in enumerate((-0.5, 0.0, 0.5, -0.2))], "date date, r double")
    got = metrics.equity(df, "r").orderBy("date").collect()
    assert [round(r.drawdown, 6) for r in got] == [0.0, 0.0, 0.0, -0.2]
    p = metrics.performance(df, "r").first()
    assert p.sessions == 4 and math.isclose(p.total_return, 0.5 * 1.5 * 0.8 - 1)


def test_overlaps_weights_and_book(spark):
    days = [D(2026, 5, d) for d in (1, 4, 5, 6, 7, 8)]
    line = align.sessions(prices_of(spark, days), [1])
    events = spark.createDataFrame([("1", "A", days[0], 1.0), ("2", "A", days[1], 1.0), ("3", "A", days[2], 1.0), ("4", "A", days[4], 1.0)], "article_id string, ticker string, entry_date date, direction double")
    assert sorted(r.article_id for r in portfolio.suppress_overlaps(events, line, 2).collect()) == ["1", "3", "4"]
    held = spark.createDataFrame([(days[0], "A", 1.0, 0.1), (days[0], "B", 1.0, 0.2), (days[1], "A", 1.0, 0.1)], "date date, ticker string, direction double, day_return double")
    assert {r.weight for r in portfolio.weights(held, mode="market_neutral", cap=1.0).collect()} == {0.0}
    book = portfolio.daily_book(portfolio.weights(held, mode="long_only", cap=1.0), spark.createDataFrame([(d,) for d in days[:3]], "date date")).orderBy("date").collect()
    assert [(round(r.gross_return, 6), round(r.turnover, 6), r.positions) for r in book] == [(0.15, 1.0, 2), (0.1, 1.0, 1), (0.0, 1.0, 0)]


def test_costs(spark):
    row = spark.range(1).select(F.lit(100.0).alias("q"), F.lit(10.0).alias("p"), F.lit(1000.0).alias("v"))
    parts = row.select(*(c.alias(k) for k, c in costs.one_way(F.col("q"), F.col("p"), F.col("v"), costs.BASE).items())).first()
    assert (parts.commissions, round(parts.half_spread, 6), round(parts.slippage, 6), round(parts.volume_impact, 6)) == (1.0, 0.2, 0.3, round(1000 * 0.1 * 0.0001, 6))


def test_capacity_book_reasons(spark):
    base = {"research_split": "d", "exit_date": D(2024, 1, 5), "reason": None, "open": 10.0, "volume": 1e6}
    rows = [dict(base, ticker="A", article_id="1", entry_date=D(2024, 1, 1), signal=0.5), dict(base, ticker="A", article_id="2", entry_date=D(2024, 1, 5), signal=0.5), dict(base, ticker="B", article_id="3", entry_date=D(2024, 1, 1), signal=0.4), dict(base, ticker="C", article_id="4", entry_date=D(2024, 1, 1), signal=0.3), dict(base, ticker="D", article_id="5", entry_date=D(2024, 1, 8), signal=1e-6), dict(base, ticker="E", article_id="6", entry_date=D(2024, 1, 9), signal=0.3, reason="split_boundary")]
    df = spark.createDataFrame([tuple(r[k] for k in ("research_split", "ticker", "article_id", "entry_date", "exit_date", "signal", "reason", "open", "volume")) for r in rows], "research_split string, ticker string, article_id string, entry_date date, exit_date date, signal double, reason string, open double, volume double")
    got = {r.article_id: (r.accepted, r.rejection_reason) for r in sequential.capacity_book(df, capital=100.0, weight=0.5, side_limit=1.0, gross_limit=1.0, participation=1.0, multiple=1.0, slope=1.0, scenario=costs.Scenario(0, 0, 1, 0, 0, 0, 1, 0), holding=5).collect()}
    assert got == {"1": (True, None), "2": (False, "same_ticker_overlap"), "3": (True, None), "4": (False, "portfolio_capacity"), "5": (False, "insufficient_cost_buffer"), "6": (False, "split_boundary")}


def test_rebalance(spark):
    rows = [("LONG", D(2024, 1, 1), 10.0, 100.0, 100.0, True, 1e9), ("LONG", D(2024, 1, 2), 10.0, 100.0, 50.0, True, 1e9), ("SHORT", D(2024, 1, 1), 10.0, 100.0, -5.0, False, 1e9)]
    df = spark.createDataFrame(rows, "ticker string, date date, price double, volume double, target double, located boolean, edge double")
    got = [(r.ticker, r.filled, r.reason) for r in sequential.rebalance(df, participation=0.5, multiple=1.0, scenario=costs.BASE).orderBy("ticker", "date").collect()]
    assert got == [("LONG", 50.0, "volume_limit"), ("LONG", 0.0, None), ("SHORT", 0.0, "locate_unavailable")]


def test_balanced_pick_and_leader_clusters(spark):
    df = spark.createDataFrame([("t", "1", "a", "m1", "0"), ("t", "2", "a", "m1", "1"), ("t", "3", "b", "m1", "9"), ("t", "4", "b", "m2", "8")], "ticker string, article_id string, bucket string, month string, hash string")
    assert [r.article_id for r in sequential.balanced_pick(df, "ticker", 3).orderBy("pick").collect()] == ["1", "4", "2"]
    articles = spark.createDataFrame([("1", dt.datetime(2024, 1, 1)), ("2", dt.datetime(2024, 1, 2)), ("3", dt.datetime(2024, 1, 3)), ("4", dt.datetime(2024, 1, 4))], "article_id string, ts timestamp_ntz")
    edges = spark.createDataFrame([("1", "2"), ("2", "3")], "article_id string, other string")
    got = {r.article_id: (r.story_cluster_id, r.representative) for r in sequential.leader_clusters(articles, edges).collect()}
    assert got["1"][0] == got["2"][0] and got["3"][1] and got["4"][1] and got["3"][0] != got["1"][0]


def test_text(spark):
    row = spark.createDataFrame([("Acme beats; profit up despite a loss", "Q3 results rose")], "title string, body string")
    r = row.select(tx.keyword_sentiment(F.col("title")).alias("s"), tx.contradictory(F.lit("strong but weak")).alias("c"), tx.event_candidates(F.lit("Acme cuts its dividend"), F.lit("")).alias("e"), tx.event_candidates(F.lit("x"), F.lit("y")).alias("o"), tx.nfkc(F.lit("Straße ﬁ")).alias("n"), tx.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))).alias("j"), tx.hamming(F.lit(5), F.lit(6)).alias("h")).first()
    assert (round(r.s, 6), r.c, r.e, r.o, r.n, r.j, r.h) == (round(1 / 3, 6), True, ["dividend"], ["other"], "strasse fi", 0.5, 2)
    prints = spark.createDataFrame([(1, ["a", "b", "c", "d", "e", "f"]), (2, ["a", "b", "c", "d", "e", "f"]), (3, ["x"])], "id long, w array<string>").select("id", F.explode(F.array(tx.shingle_hashes(F.col("w")))).alias("h")).select("id", tx.simhash(F.col("h")).alias("f"))
    f = {x.id: x.f for x in prints.collect()}
    assert f[1] == f[2] != f[3]


def test_stories_match_by_the_64_bit_rule(spark, sf):
    stories = views.stories(spark, sf).select("article_id", "ts", tx.tokens(F.col("title")).alias("t"), tx.tokens(F.col("body")).alias("w")).collect()

    def simhash(words):
        hashes = [int.from_bytes(hashlib.md5(" ".join(words[i : i + 5]).encode()).digest()[:8], "big") for i in range(max(1, len(words) - 4))]
        return sum(1 << b for b in range(64) if sum(1 if h >> b & 1 else -1 for h in hashes) >= 0)

    def alike(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    f = {r.article_id: simhash(r.w) for r in stories}
    assert {r.article_id: r.fingerprint % 2**64 for r in catalog_text._fingerprints(spark, sf).collect()} == f
    title, body = ({r.article_id: set(x(r)) for r in stories} for x in (lambda r: r.t, lambda r: r.w[:250]))
    pairs = set()
    for i, x in enumerate(stories):
        for y in stories[:i]:
            a, b = sorted((x.article_id, y.article_id))
            d = f[a] ^ f[b]
            met = x.t[:3] == y.t[:3] or any(not d >> 16 * k & 0xFFFF for k in range(4))
            if met and abs(x.ts - y.ts) <= dt.timedelta(days=14) and (d.bit_count() <= 5 or (alike(title[a], title[b]) >= 0.7 and alike(body[a], body[b]) >= 0.8)):
                pairs.add((a, b))
    assert pairs and {(r.a, r.b) for r in catalog_text.near_duplicate_stories(spark, sf).collect()} == pairs
    founded, clusters = {}, {}
    for r in sorted(stories, key=lambda r: (r.ts, r.article_id)):
        mine = sorted(c for o, c in founded.items() if tuple(sorted((o, r.article_id))) in pairs)
        clusters[r.article_id] = mine[0] if mine else founded.setdefault(r.article_id, hashlib.sha256(r.article_id.encode()).hexdigest()[:20])
    assert {r.article_id: r.story_cluster_id for r in catalog_text.story_clusters(spark, sf).collect()} == clusters


def test_screening(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "z"), ("m", 1, "c")], "key string, ts long, id string")
    assert sorted((r.key, r.id) for r in screen.first_seen(df, "key", "ts", "id").collect()) == [("k", "z"), ("m", "c")]


def test_contracts(spark):
    df = spark.createDataFrame([(0.5, "bearish", 0.5, 0.5, 0.5, 2.0, True, True)], "score double, label string, confidence double, relevance double, materiality double, novelty double, tradable boolean, abstain boolean")
    assert df.select(contracts.violations(contracts.assessment_rules())).first()[0] == ["novelty_range", "label_sign", "tradable_abstain"]
    two = spark.createDataFrame([(1, "a"), (1, "b")], "k long, v string")
    with pytest.raises(Exception, match="repeated key"):
        contracts.one_to_one(two, two.limit(1), "k").collect()
    with pytest.raises(ValueError):
        contracts.require_columns(two, "k", "missing")


def test_cascade(spark):
    rows = spark.createDataFrame([(str(i), 0.1 * i, 0.1 * i, "guidance" if i == 9 else "other", "bullish", False, 0.9, False) for i in range(10)], "article_id string, confidence double, materiality double, event_type string, label string, abstain boolean, relevance double, contradictory boolean")
    got = cascade.cascade(rows, lambda d: d, lambda d: d.withColumn("label", F.lit("neutral")), 3)
    assert {r.article_id for r in got.where("stage = 'escalation'").collect()} == {"9", "0", "1"} and got.count() == 10


def test_decisions(spark):
    df = spark.createDataFrame([(1.0, None)], "a double, b double")
    r = decisions.gates(df, {"x": F.col("a") > 0, "y": F.col("b") > 0}).first()
    assert (r.x, r.y, r.passed, r.failed) == (True, False, False, ["y"])


def test_landing(spark, tmp_path):
    body = json.dumps([{"date": "2026-05-01T21:00:00", "title": " T ", "content": "c", "link": "l", "symbols": ["b.us", "A.US", "b.us"], "tags": ["y", "x"], "sentiment": {"polarity": 0.1}}, {"date": "2026-05-01T21:00:00", "title": "T", "content": "c", "link": "l"}])
    (tmp_path / "a.json").write_text(body)
    import hashlib

    known = spark.createDataFrame([("a.json", hashlib.sha256(body.encode()).hexdigest())], "file string, sha256 string")
    got = landing.news_articles(landing.checked_bodies(spark, str(tmp_path), known)).collect()
    assert len(got) == 1 and (got[0].title, got[0].symbols, got[0].tags) == ("T", ["A.US", "B.US"], ["x", "y"])
    with pytest.raises(Exception, match="corrupt or missing"):
        landing.checked_bodies(spark, str(tmp_path), spark.createDataFrame([("a.json", "0")], "file string, sha256 string")).collect()
    prices = spark.createDataFrame([("A", D(2026, 1, 1), 1.0, 1), ("A", D(2026, 1, 1), 2.0, 2)], "ticker string, date date, close double, pos long")
    assert landing.last_price_wins(prices, "pos").first().close == 2.0
    (tmp_path / "c.jsonl").write_text('{"id": "1", "v": 1}\n\n{"id": "1", "v": 2}\n{"id": "2", "v": -1}\n')
    rows = landing.checkpoint_lines(spark, str(tmp_path / "c.jsonl"), "id string, v int", "id", F.col("v") > 0).collect()
    assert [(r.id, r.v) for r in rows] == [("1", 2)]


def test_rest_paging_and_retries():
    data = [{"i": i} for i in range(7)]
    fetch = lambda offset, limit: json.dumps(data[offset : offset + limit]).encode()
    assert list(rest.pages(fetch, 3, 100)) == data and list(rest.pages(fetch, 3, 4)) == data[:4]
    with pytest.raises(ValueError):
        list(rest.pages(lambda o, n: json.dumps(data[:n]).encode(), 3, 100))
    waits, tries = [], iter([rest.HttpError(429, "7"), OSError(), b"ok"])

    def once():
        x = next(tries)
        if isinstance(x, Exception):
            raise x
        return x

    assert rest.with_retries(once, sleep=waits.append) == b"ok" and waits[0] == 7 and len(waits) == 2
    with pytest.raises(rest.HttpError):
        rest.with_retries(lambda: (_ for _ in ()).throw(rest.HttpError(404)), sleep=waits.append)


def test_sinks_and_governance(spark, tmp_path):
    df = spark.createDataFrame([("1", "x")], "k string, h string")
    path = str(tmp_path / "t")
    sinks.write_table(df, path)
    with pytest.raises(Exception, match="already exists"):
        sinks.write_table(df, path)
    assert sinks.register_view(spark, "some_view", path).count() == 1
    with pytest.raises(ValueError):
        sinks.register_view(spark, "a; drop", path)
    with pytest.raises(ValueError):
        sinks.write_rows(spark, [], "k string", path)
    with pytest.raises(ValueError):
        sinks.stable_json({"x": float("nan")})
    assert sinks.store(df, spark.createDataFrame([("1", "x"), ("2", "y")], "k string, h string"), "k", "h").collect() == [("2", "y")]
    with pytest.raises(Exception, match="conflicting"):
        sinks.store(df, spark.createDataFrame([("1", "y")], "k string, h string"), "k", "h").collect()
    with pytest.raises(ValueError):
        sinks.write_final(df, spark.createDataFrame([("9",)], "k string"), "k", str(tmp_path / "f"))
    run = sinks.write_run({"a": 1}, str(tmp_path / "runs"), {"t": df}, {"t": "k string, h string", "empty": "v long"}, {"m": 1})
    assert spark.read.parquet(f"{run}/empty").count() == 0
    assert sinks.completed_run({"a": 1}, str(tmp_path / "runs"), "k", "t") == run and sinks.completed_run({"a": 2}, str(tmp_path / "runs")) is None
    with pytest.raises(FileExistsError):
        sinks.write_run({"a": 1}, str(tmp_path / "runs"), {}, {}, {})
    assert "—" in sinks.html_report("r", {"t": spark.createDataFrame([(None,)], "v long")}) and "| k | h |" in sinks.markdown_report("r", {"t": df})
    sinks.write_json({"b": 1}, str(tmp_path / "x.json"))
    with pytest.raises(FileExistsError):
        sinks.write_json({"b": 2}, str(tmp_path / "x.json"))
    one = governance.register_sources({"t": path}, {})
    with pytest.raises(ValueError):
        governance.register_sources({"t": str(tmp_path / "x.json")}, one)
    governance.verify_inputs({path: governance.path_sha256(path)})
    with pytest.raises(ValueError):
        governance.verify_inputs({path: "0"})
    with pytest.raises(ValueError):
        governance.protect_holdout({"holdout"}, None)
    governance.refuse_change({"a": 1, "git": "x"}, {"a": 1, "git": "y"})
    with pytest.raises(ValueError):
        governance.refuse_change({"a": 1}, {"a": 2})
    with pytest.raises(ValueError):
        governance.check_budget(1.0, 0.5, 1.2)


def test_t_distribution():
    from signalloom.functions.stats import incomplete_beta, t_two_sided

    assert math.isclose(incomplete_beta(2, 3, 0.5), 0.6875, rel_tol=1e-12) and math.isclose(incomplete_beta(1, 1, 0.3), 0.3, rel_tol=1e-12)
    assert math.isclose(t_two_sided(1.0, 1), 0.5, rel_tol=1e-10) and math.isclose(t_two_sided(2.0, 2), 1 - 2 / math.sqrt(6), rel_tol=1e-10)


@pytest.mark.parametrize("crowd", [1, 256])
def test_near_duplicates_of_crowds(spark, crowd):
    """Copies, edits and near fingerprints under few titles, against all pairs; copies meet as one cell, and no pair twice."""
    import random

    rng, rows = random.Random(7), []
    for i in range(300):
        if i % 4 and rows:
            _, ts, f, head, body = rows[rng.randrange(len(rows))]
            change = rng.randrange(4)
            head = list(head) + ["x"] * (change == 1)
            body = [w if change != 2 or rng.random() < 0.95 else f"n{rng.randrange(99)}" for w in body]
            for b in rng.sample(range(64), rng.randrange(7)) if change == 3 else ():
                f ^= 1 << b
        else:
            f, head, body = rng.getrandbits(64), [rng.choice(["a", "b"]), "c", "d", "e"][: rng.choice([0, 4, 4])], [f"w{rng.randrange(60)}" for _ in range(rng.choice([0, 3, 40]))]
        rows.append((f"{i}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(24 * 50)), f, head, body))
    df = spark.createDataFrame([(i, ts, f - (1 << 64) * (f >> 63), head, body) for i, ts, f, head, body in rows], "article_id string, ts timestamp_ntz, fingerprint long, title_words array<string>, body_words array<string>")

    def alike(a, b):
        return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0

    want = set()
    for k, (i, ti, fi, hi, bi) in enumerate(rows):
        for j, tj, fj, hj, bj in rows[:k]:
            x = fi ^ fj
            if abs(ti - tj) <= dt.timedelta(days=14) and (hi[:3] == hj[:3] or any(not x >> 16 * k & 0xFFFF for k in range(4))) and (x.bit_count() <= 5 or alike(hi, hj) >= 0.7 and alike(bi, bj) >= 0.8):
                want.add(tuple(sorted((i, j))))
    members, links = screen.near_duplicate_cells(df, crowd=crowd)
    cell, linked = {r.article_id: r.cell for r in members.collect()}, {(r.a, r.b) for r in links.collect()}
    ts = {r[0]: r[1] for r in rows}
    made = {(a, b) for a in cell for b in cell if a < b and abs(ts[a] - ts[b]) <= dt.timedelta(days=14) and (cell[a] == cell[b] or (cell[a], cell[b]) in linked or (cell[b], cell[a]) in linked)}
    assert made == want and len(cell) == 300 and len(set(cell.values())) < 300
    if crowd > 1:
        got = [(r.a, r.b) for r in screen.near_duplicate_pairs(df).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_leader_clusters_of_cells(spark):
    """Copies stand in cells whose matches stand once; the walk equals one over all matches between articles in time."""
    import random

    rng, day = random.Random(5), dt.datetime(2024, 1, 1)
    cell = {f"{i}": f"{rng.randrange(i // 3 * 3, i + 1)}" if i % 5 else f"{i}" for i in range(60)}
    cell = {i: c if cell[c] == c else i for i, c in cell.items()}
    ts = {i: day + dt.timedelta(days=rng.randrange(60)) for i in cell}
    heads = sorted(set(cell.values()))
    links = {tuple(sorted(rng.sample(heads, 2))) for _ in range(30)}
    size = {c: sum(x == c for x in cell.values()) for c in heads}
    members = spark.createDataFrame([(i, ts[i], c, size[c]) for i, c in cell.items()], "article_id string, ts timestamp_ntz, cell string, n long")
    edges = spark.createDataFrame(sorted(links), "article_id string, other string")
    founded, want = {}, {}
    for i in sorted(cell, key=lambda i: (ts[i], i)):
        mine = [k for o, k in founded.items() if ts[i] - ts[o] <= dt.timedelta(days=14) and (cell[o] == cell[i] or tuple(sorted((cell[o], cell[i]))) in links)]
        want[i] = min(mine) if mine else founded.setdefault(i, hashlib.sha256(i.encode()).hexdigest()[:20])
    got = sequential.leader_clusters(members, edges, days=14).collect()
    assert {r.article_id: r.story_cluster_id for r in got} == want and {r.article_id for r in got if r.representative} == set(founded) and len(got) == 60
