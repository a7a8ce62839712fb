"""Canonical tables derived from the star-schema tables.

The engine's inputs are prices a (ticker, date), articles and assessments.
Over a directory of ``lineitem``, ``orders`` and so on they are views: a
supplier is a ticker, an order an article, a line item a trade. Integer
arithmetic on keys gives scores that any engine reproduces exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import align, signals, splits
from ..staging import stage

HORIZONS = (1, 5, 21)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticker(key) -> F.Column:
    return F.concat(F.lit("S"), F.lpad(key.cast("string"), 5, "0"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, date, open, high, low, close, adjusted_close, volume: one partial aggregation, one shuffle."""
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 0")
    out = lines.groupBy(ticker(F.col("l_suppkey")).alias("ticker"), F.to_date("l_shipdate").alias("date")).agg(
        F.min(unit).alias("open"), F.max(unit).alias("high"), F.min(unit).alias("low"), F.max(unit).alias("close"),
        F.max(unit * (1 - F.col("l_discount") / 10)).alias("adjusted_close"), F.sum(F.col("l_quantity").cast("long")).alias("volume"),
    )
    return out


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """article_id, k, ticker, sector, event_type, ts, pub_date and the assessment."""
    suppliers = table(spark, sf_dir, "supplier")
    n = suppliers.agg(F.count("*").alias("_n"))
    region = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("sector"))
    sector = suppliers.join(F.broadcast(region), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "sector")
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").crossJoin(F.broadcast(n)).withColumn("_supp", k % F.col("_n"))
    ts = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), ((k * 7919) % 86400).cast("decimal(18,6)"))
    scaled = lambda m: ((k * m) % 101) / F.lit(100.0)
    out = rows.join(sector, F.col("_supp") == F.col("s_suppkey"), "left").select(
        k.cast("string").alias("article_id"), k.alias("k"), ticker(F.col("_supp")).alias("ticker"), "sector", F.col("o_orderpriority").alias("event_type"), ts.alias("ts"),
        (((k * 37) % 201 - 100) / F.lit(100.0)).alias("score"), scaled(17).alias("confidence"), scaled(29).alias("relevance"), scaled(41).alias("materiality"), scaled(53).alias("novelty"), (k % 5 == 0).alias("abstain"),
    )
    return out.withColumns({"pub_date": align.local_date(F.col("ts")), "tradable": ~F.col("abstain"), "label": signals.label_of(F.col("score"))})


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each ticker, written once: the as-of join and the holding paths all read it."""
    return stage(align.sessions(prices(spark, sf_dir), HORIZONS), "timeline")


def aligned(spark: SparkSession, sf_dir: str, line: DataFrame | None = None) -> DataFrame:
    """Articles with their entry session and forward returns."""
    keep = ["ticker", "date", "prev_date", "adj_open", "session", *(f"{c}_{h}d" for h in HORIZONS for c in ("exit_date", "exit_close"))]
    line = align.sessions(prices(spark, sf_dir), HORIZONS) if line is None else line
    return align.forward_returns(align.next_session(articles(spark, sf_dir), line.select(*keep)), HORIZONS)


def events(spark: SparkSession, sf_dir: str, line: DataFrame | None = None) -> DataFrame:
    """Aligned articles with chronological split and next boundary; those without an entry are left out.

    The as-of join and the ranks are each written once: what follows reads them many times.
    """
    rows = stage(aligned(spark, sf_dir, line).where("entry_date is not null"), "aligned")
    return splits.next_boundary(stage(splits.assign_splits(rows, "ts", "ticker", "article_id"), "events"))


def second_rater(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another rater's label, score, event type and flags for the same articles."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.cast("string").alias("article_id"), (((k * 43) % 201 - 100) / F.lit(100.0)).alias("score2"), (k % 7 == 0).alias("abstain2"), F.when(k % 3 == 0, "5-LOW").otherwise(F.col("o_orderpriority")).alias("event_type2"))
    return rows.withColumns({"tradable2": ~F.col("abstain2"), "label2": signals.label_of(F.col("score2"))})


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: article_id, title (first line), body, ts, source, lang."""
    d = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    ts = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval((F.col("doc_id") % 60).cast("int"), F.lit(0), F.lit(0), ((F.col("doc_id") * 7919) % 86400).cast("decimal(18,6)"))
    return d.select("doc_id", F.col("doc_id").cast("string").alias("article_id"), F.substring_index(text, "\n", 1).alias("title"), text.alias("body"), ts.alias("ts"), "source", "lang")


#: Companies that the news view writes about: ticker, name, other names.
UNIVERSE = (("ORT.US", "Orreth Holdings Inc.", ("Orreth",)), ("TST.US", "Thonst Corporation", ()), ("NDL.US", "Nordal Group plc", ("Nordal", "NDL")), ("EA.US", "Eanes Company", ("Eanes Labs",)), ("STR.US", "Straße Limited", ()), ("VOL.US", "Voltic Energy Corp.", ("Voltic",)), ("QRX.US", "Quorax", ("Quorax Bio",)), ("HLM.US", "Helmont & Sons Ltd", ()))
#: Headlines of the news view, one or more a kind of event; {c} stands for a company.
HEADLINES = (
    "{c} reports quarterly results, revenue beat", "{c} raises its full-year guidance", "Broker upgrades {c}, new price target", "{c} to be acquired in takeover", "Regulator opens antitrust probe of {c}", "{c} sued in class action", "{c} hit by ransomware", "Whistleblower alleges fraud at {c}",
    "{c} declares quarterly dividend", "{c} board backs share repurchase", "CEO of {c} resigns", "{c} plans convertible note", "{c} announces layoffs", "{c} recall halts shipments", "{c} unveils new platform", "{c} sets capex budget", "Tariff and inflation weigh on {c}", "Top 10 stocks to watch: {c}", "Five reasons to like {c}", "{c} in brief",
)


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as news: id, ticker, title (a headline on a company, then the text's first words), body (the text, some with mentions), symbols, ts, source, lang."""
    rows = stories(spark, sf_dir).withColumnRenamed("doc_id", "id")
    k = F.col("id")
    member = F.element_at(F.array(*(F.struct(F.lit(t).alias("ticker"), F.lit(n).alias("name")) for t, n, _ in UNIVERSE)), (k % len(UNIVERSE) + 1).cast("int"))
    rows = rows.withColumns({"ticker": member["ticker"], "company": member["name"]})
    shown = F.when(k % 5 == 0, F.concat(F.lit("$"), F.split_part("ticker", F.lit("."), F.lit(1)))).when(k % 5 == 1, "Somebody").otherwise(F.col("company"))
    headline = F.element_at(F.array(*map(F.lit, HEADLINES)), (F.floor(k / 8) % len(HEADLINES) + 1).cast("int"))
    title = F.concat(F.replace(headline, F.lit("{c}"), shown), F.lit(" - "), F.substring("title", 1, 40))
    body = F.when(k % 3 == 0, F.concat(F.col("company"), F.lit(" said so. "), "body")).when(k % 3 == 1, F.concat("body", F.lit(" Both "), "company", F.lit(" and again "), "company", F.lit(" were named."))).otherwise(F.col("body"))
    symbols = F.concat(F.when(k % 9 == 0, F.array().cast("array<string>")).otherwise(F.array("ticker")), F.transform(F.sequence(F.lit(1), (k % 7 + 1).cast("int")), lambda i: F.concat(F.lit("X"), i.cast("string"))))
    return rows.select("id", "ticker", title.alias("title"), body.alias("body"), symbols.alias("symbols"), "ts", "source", "lang")


def universe(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, n, list(x)) for t, n, x in UNIVERSE], "ticker string, company_name string, names array<string>")
