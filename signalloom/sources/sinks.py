"""Sinks: immutable tables, views, documents, run folders, keyed stores, reports."""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files


def write_table(df: DataFrame, path: str) -> None:
    """Parquet, zstd; an existing table is never overwritten."""
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)


def write_rows(spark: SparkSession, rows: Sequence, schema, path: str) -> None:
    """Rows as a table; none is an error."""
    if not rows:
        raise ValueError("no rows to write")
    write_table(spark.createDataFrame(rows, schema), path)


def stable_json(value: Any) -> str:
    """Sorted keys, compact; NaN is an error."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), default=str, allow_nan=False)


def write_json(value: Any, path: str, *, overwrite: bool = False) -> None:
    """A document, there at once or not at all; an existing one is never overwritten unless told. Needs a running session."""
    files.write_text(path, stable_json(value), overwrite=overwrite)


def register_view(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Temporary view over a table; the name must be a plain identifier."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"not an identifier: {name}")
    df = spark.read.parquet(path)
    df.createOrReplaceTempView(name)
    return df


def append_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_run(config: dict, root: str, frames: dict[str, DataFrame], required: dict[str, str], metrics: dict) -> str:
    """Folder named by the config's hash: every required frame (empty where not given), then metrics, then the manifest.

    On any file system that Spark writes; a run that exists is an error.
    """
    spark = SparkSession.active()
    digest = hashlib.sha256(stable_json(config).encode()).hexdigest()
    path = f"{root.rstrip('/')}/{digest[:16]}"
    files.make_folder(path)
    rows = {}
    for name, schema in required.items():
        write_table(frames.get(name, spark.createDataFrame([], schema)), f"{path}/{name}")
        rows[name] = spark.read.parquet(f"{path}/{name}").count()
    write_json(metrics, f"{path}/metrics.json")
    write_json({"config_hash": digest, "frames": rows, "status": "completed"}, f"{path}/manifest.json")
    return path


def completed_run(config: dict, root: str, key: str | None = None, frame: str | None = None) -> str | None:
    """The folder of a run that this configuration has completed, or None where there is none.

    A run without manifest, of another configuration, with other row counts than
    told, or with a repeated ``key`` in ``frame`` is an error: it is neither done nor to be redone.
    """
    digest = hashlib.sha256(stable_json(config).encode()).hexdigest()
    path = f"{root.rstrip('/')}/{digest[:16]}"
    if not files.exists(path):
        return None
    if not files.exists(f"{path}/manifest.json"):
        raise ValueError(f"unfinished run: {path}")
    manifest = json.loads(files.read_text(f"{path}/manifest.json"))
    if manifest.get("status") != "completed" or manifest.get("config_hash") != digest:
        raise ValueError(f"manifest of another run: {path}")
    spark = SparkSession.active()
    for name, n in manifest["frames"].items():
        df = spark.read.parquet(f"{path}/{name}")
        if df.count() != n or (name == frame and key and df.select(key).distinct().count() != n):
            raise ValueError(f"rows of {name} have changed: {path}")
    return path


def store(existing: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows of ``new`` to append: unknown keys. A known key with another digest fails when it runs."""
    known = existing.select(key, F.col(digest).alias("_had"))
    joined = new.join(known, key, "left")
    clash = F.col("_had").isNotNull() & (F.col("_had") != F.col(digest))
    checked = joined.withColumn("_ok", F.when(clash, F.raise_error(F.concat(F.lit("conflicting value for key "), F.col(key)))).otherwise(F.col("_had").isNull()))
    return checked.where("_ok").drop("_ok", "_had")


def rebuild(wanted: DataFrame, cache: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """``wanted`` with cached columns, in total order; a key that the cache lacks fails."""
    found = wanted.join(cache.withColumn("_hit", F.lit(True)), key, "left")
    return found.withColumn("_ok", F.when(F.col("_hit").isNull(), F.raise_error(F.concat(F.lit("not in the cache: "), F.col(key)))).otherwise(True)).where("_ok").drop("_ok", "_hit").orderBy(*order)


def write_final(rows: DataFrame, expected: DataFrame, key: str, path: str) -> None:
    """Refused while any expected key is unresolved or any key occurs twice."""
    missing = expected.join(rows, key, "left_anti").count()
    twice = rows.groupBy(key).count().where("count > 1").count()
    if missing or twice:
        raise ValueError(f"{missing} unresolved and {twice} repeated keys")
    write_table(rows, path)


def _cell(value: Any) -> str:
    if value is None:
        return "—"
    return f"{value:.4f}" if isinstance(value, float) else str(value)[:800]


def html_report(title: str, tables: dict[str, DataFrame], limit: int = 200) -> str:
    """Small results as an HTML page; nulls as a dash, texts cut to 800 characters."""
    out = [f"<!DOCTYPE html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, df in tables.items():
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape(_cell(v))}</td>" for v in row) + "</tr>" for row in df.limit(limit).collect())
        out.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{body}</table>")
    return "\n".join(out)


def markdown_report(title: str, tables: dict[str, DataFrame], limit: int = 200) -> str:
    out = [f"# {title}"]
    for name, df in tables.items():
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join(_cell(v).replace("|", "\\|") for v in row) + " |" for row in df.limit(limit).collect()]
    return "\n".join(out) + "\n"
