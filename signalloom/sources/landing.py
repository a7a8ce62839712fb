"""Landing zone: raw provider responses on disk, checked, parsed and normalised by one plan."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import key_of
from . import files
from .sinks import stable_json

NEWS = T.StructType([T.StructField(n, T.StringType()) for n in ("date", "title", "content", "link")] + [T.StructField("symbols", T.ArrayType(T.StringType())), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("sentiment", T.StructType([T.StructField("polarity", T.DoubleType())]))])
PRICE_ROWS = T.StructType([T.StructField("ticker", T.StringType()), T.StructField("date", T.DateType())] + [T.StructField(n, T.DoubleType()) for n in ("open", "high", "low", "close", "adjusted_close")] + [T.StructField("volume", T.LongType())])


#: Parameters that never enter a request's key.
SECRET = ("api_token", "api_key", "token")


def request_key(endpoint: str, params: dict) -> str:
    """Key of a request: SHA-256 of its endpoint and parameters in sorted order, without secrets."""
    return hashlib.sha256(stable_json({"endpoint": endpoint, "params": {k: v for k, v in params.items() if k not in SECRET}}).encode()).hexdigest()


def land(root: str, endpoint: str, params: dict, body: str) -> dict[str, str]:
    """Store a raw response: the body under its own digest, once, and a record (key, file, sha256) under the request's key."""
    key, digest = request_key(endpoint, params), hashlib.sha256(body.encode()).hexdigest()
    record = {"key": key, "file": f"{digest}.json", "sha256": digest}
    if not files.exists(f"{root}/bodies/{record['file']}"):
        files.write_text(f"{root}/bodies/{record['file']}", body)
    files.write_text(f"{root}/requests/{key}.json", stable_json(record), overwrite=True)
    return record


def landed(spark: SparkSession, root: str) -> DataFrame:
    """Checked bodies (file, sha256, body) of all recorded requests."""
    records = spark.read.schema("key string, file string, sha256 string").json(f"{root}/requests")
    return checked_bodies(spark, f"{root}/bodies", records.select("file", "sha256").distinct())


def paged_articles(rows: DataFrame) -> DataFrame:
    """Articles of a paged source's rows (ticker, body): parsed, the first of equal ids, by time and id."""
    bodies = rows.select(F.sha2("body", 256).alias("sha256"), F.concat(F.lit("["), "body", F.lit("]")).alias("body"))
    return news_articles(bodies).orderBy("provider_timestamp", "article_id")


def checked_bodies(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Bodies whose SHA-256 is the one recorded for their file; a mismatch or a missing body fails the read.

    ``expected``: (file, sha256).
    """
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    joined = expected.join(files, "file", "left")
    wrong = F.col("content").isNull() | (F.sha2("content", 256) != F.col("sha256"))
    return joined.withColumn("body", F.when(wrong, F.raise_error(F.concat(F.lit("corrupt or missing body: "), F.col("file")))).otherwise(F.col("content").cast("string"))).select("file", "sha256", "body")


def _sorted_set(values: Column, upper: bool) -> Column:
    clean = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.trim(F.upper(x) if upper else x))
    return F.array_sort(F.array_distinct(F.filter(clean, lambda x: x != "")))


def news_articles(bodies: DataFrame) -> DataFrame:
    """Articles of JSON array bodies: text stripped, UTC times, upper-case sorted symbols, id by content, first of equal ids."""
    rows = bodies.select("sha256", F.posexplode(F.from_json("body", T.ArrayType(NEWS))).alias("pos", "r"))
    parsed = rows.select(
        F.to_timestamp_ntz("r.date").alias("provider_timestamp"), F.trim("r.title").alias("title"), F.trim("r.content").alias("content"), F.trim("r.link").alias("link"),
        _sorted_set(F.col("r.symbols"), True).alias("symbols"), _sorted_set(F.col("r.tags"), False).alias("tags"), F.col("r.sentiment.polarity").alias("provider_sentiment_polarity"), F.col("sha256").alias("raw_response_hash"), "pos",
    )
    named = parsed.withColumn("article_id", key_of(F.col("provider_timestamp").cast("string"), F.col("title"), F.col("link")))
    columns = [c for c in named.columns if c not in ("article_id", "pos")]
    return named.groupBy("article_id").agg(F.min_by(F.struct(*columns), F.struct("raw_response_hash", "pos")).alias("r")).select("article_id", "r.*")


def last_price_wins(rows: DataFrame, position: str) -> DataFrame:
    """One row a (ticker, date): the one that came last."""
    columns = [c for c in rows.columns if c not in ("ticker", "date", position)]
    return rows.groupBy("ticker", "date").agg(F.max_by(F.struct(*columns), position).alias("r")).select("ticker", "date", "r.*")


def checkpoint_lines(spark: SparkSession, path: str, schema: T.StructType, key: str, valid: Column) -> DataFrame:
    """Rows of a JSONL checkpoint: invalid ones dropped, the last of each key wins (by file, then line)."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("_f"), F.monotonically_increasing_id().alias("_i")).where("trim(value) <> ''")
    rows = lines.select(F.from_json("value", schema).alias("r"), "_f", "_i").select("r.*", "_f", "_i").where(valid)
    w = Window.partitionBy(key).orderBy(F.desc("_f"), F.desc("_i"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_f", "_i")


def batch_results(requests: DataFrame, outputs: DataFrame, schema: T.StructType, valid: Column) -> DataFrame:
    """Requests with their parsed result or a typed failure: missing, status, refusal, schema or contract."""
    got = outputs.select("custom_id", "status", "refusal", "body", F.from_json("body", schema).alias("result"))
    joined = requests.join(got, "custom_id", "left")
    failure = F.when(F.col("status").isNull(), "missing").when(F.col("status") != 200, F.concat(F.lit("status_"), F.col("status").cast("string"))).when(F.col("refusal").isNotNull(), "refusal").when(F.col("result").isNull(), "schema").when(~F.coalesce(valid, F.lit(False)), "contract")
    return joined.withColumn("failure", failure)
