"""Line dedup with levelled sorted runs of line hashes.

``LineRuns`` keeps, for each line key seen so far, in how many documents it
stands. A run is a table of keys and counts, dealt into a fixed number of
buckets by hash and sorted within them. A new batch is counted, which deals it
into the same buckets, and then merge-joined with every run, bucket with
bucket: nothing of a run is shuffled or sorted again. Keys that the runs
already settle (they have reached the limit, so more counts change nothing) are
anti-joined away, the rest is written as the batch's own run. As soon as a
level holds ``fanout`` runs they are merged, in order, into one run of the next
level, so a key lies in less than fanout runs a level.

Keys are 128-bit hashes; texts are never shuffled to be counted. Counting
combines on the map side, so a line that stands in a third of all documents
costs one row a task.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..staging import drop_path, fresh, new_path, stage

#: Batches that the one-shot form deals documents into, and runs of a level that are merged.
BATCHES, FANOUT = 4, 2
#: Lets a scan of sorted buckets say that it is sorted.
_SORTED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


class LineRuns:
    """Counts of line keys (h1, h2, n) in sorted runs on the shared folder; ``close`` removes them."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    @contextmanager
    def sorted_scans(self):
        before = self.spark.conf.get(_SORTED, None)
        self.spark.conf.set(_SORTED, "true")
        try:
            yield
        finally:
            if before is None:
                self.spark.conf.unset(_SORTED)
            else:
                self.spark.conf.set(_SORTED, before)

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(r) for level in self.levels for r in level]

    def counts(self) -> DataFrame:
        """All runs together: each run's keys that no run before holds, with their counts in all; merge joins of buckets, no shuffle."""
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], "h1 long, h2 long, n long")
        parts = []
        for i, run in enumerate(runs):
            rows, total, before = run, F.col("n"), F.lit(True)
            for j, other in enumerate(runs):
                if j != i:
                    rows = rows.join(other.withColumnRenamed("n", f"n{j}").hint("merge"), ["h1", "h2"], "left")
                    total = total + F.coalesce(f"n{j}", F.lit(0))
                    before = before & F.col(f"n{j}").isNull() if j < i else before
            parts.append(rows.where(before).select("h1", "h2", total.alias("n")))
        return reduce(DataFrame.unionByName, parts)

    def settled(self) -> DataFrame:
        """Keys that have reached the limit."""
        return self.counts().where(F.col("n") >= self.min_docs).select("h1", "h2")

    def open_keys(self, batch: DataFrame) -> DataFrame:
        """A batch's keys (one row for each key and document, or rows with a count n), counted, without those that the runs settle."""
        if "n" not in batch.columns:
            batch = batch.withColumn("n", F.lit(1).cast("long"))
        rows = batch.groupBy("h1", "h2").agg(F.sum("n").alias("n"))
        seen = F.lit(0).cast("long")
        for i, run in enumerate(self.runs()):
            rows = rows.join(run.withColumnRenamed("n", f"n{i}").hint("merge"), ["h1", "h2"], "left")
            seen = seen + F.coalesce(f"n{i}", F.lit(0))
        return rows.where(seen < self.min_docs).select("h1", "h2", "n")

    def add(self, batch: DataFrame) -> None:
        """Count a batch and add it as a run of its own."""
        with self.sorted_scans():
            self._place(self.open_keys(batch), 0)

    def merged(self, runs: list[DataFrame]) -> DataFrame:
        """Runs of a level as one, by full joins of sorted buckets (more than two runs are dealt out anew after the first)."""

        def both(a: DataFrame, b: DataFrame) -> DataFrame:
            joined = a.join(b.withColumnRenamed("n", "m").hint("merge"), ["h1", "h2"], "full")
            return joined.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))

        return reduce(both, runs)

    def _place(self, run: DataFrame, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = new_path(self.spark, f"line-run-{level}")
        run.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("compression", "zstd").option("path", self.paths[name]).saveAsTable(name)
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            merged = self.merged([self.spark.table(r) for r in old])
            self.levels[level] = []
            self._place(merged, level + 1)
            for r in old:
                self._drop(r)

    def _drop(self, name: str) -> None:
        self.spark.sql(f"drop table if exists {name}")
        drop_path(self.spark, self.paths.pop(name))

    def close(self) -> None:
        for name in list(self.paths):
            self._drop(name)
        self.levels = []


def _lines(text: str | None) -> list[bytes]:
    return (text or "").encode().split(b"\n")


def _keys(lines: list[bytes]) -> list[bytes]:
    """128-bit hashes of the stripped, lower-cased lines; empty bytes for an empty key."""
    return [xxhash.xxh3_128_digest(k) if (k := x.strip(b" \t\n\v\f\r").lower()) else b"" for x in lines]


def _halves(keys: list[bytes]) -> tuple[pa.Array, pa.Array]:
    both = np.frombuffer(b"".join(keys), dtype="<i8").reshape(-1, 2)
    return pa.array(both[:, 0]), pa.array(both[:, 1])


def line_keys(docs: DataFrame) -> DataFrame:
    """(h1, h2): each key once a document."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for a in range(0, part.num_rows, 1024):
                keys = [k for text in part.column(0).slice(a, 1024).to_pylist() for k in {k for k in _keys(_lines(text)) if k}]
                if keys:
                    yield pa.RecordBatch.from_arrays([*_halves(keys)], ["h1", "h2"])

    return docs.select("text").mapInArrow(run, "h1 long, h2 long")


def _places(docs: DataFrame) -> DataFrame:
    """(doc_id, th, i, h1, h2): every line with a key."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for a in range(0, part.num_rows, 1024):
                cut = part.slice(a, 1024)
                keys, at, doc = [], [], []
                for d, text in enumerate(cut.column(2).to_pylist()):
                    for i, k in enumerate(_keys(_lines(text))):
                        if k:
                            keys.append(k)
                            at.append(i)
                            doc.append(d)
                if keys:
                    take = pa.array(doc)
                    yield pa.RecordBatch.from_arrays([cut.column(0).take(take), cut.column(1).take(take), pa.array(at, pa.int32()), *_halves(keys)], ["doc_id", "th", "i", "h1", "h2"])

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, "doc_id long, th long, i int, h1 long, h2 long")


def drop_repeated_lines(docs: DataFrame, *, min_docs: int = 10, batches: int = BATCHES) -> DataFrame:
    """The documents without the lines whose key stands in at least ``min_docs`` of them, with n_lines and n_dropped.

    A line's key is the line stripped of ASCII white space and lower-cased
    (A-Z); empty keys are never dropped. A null text counts as one empty line
    and becomes empty. Each row is a document: equal rows count as often as
    they occur. A null doc_id stays null. An empty table gives no rows. Other
    columns are kept; an own n_lines or n_dropped is replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped")
    runs = LineRuns(spark, min_docs)
    try:
        for b in range(batches):
            # A batch is a share of the documents; each is read, counted and merged before the next.
            runs.add(line_keys(docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)) == b)))
        with runs.sorted_scans():
            repeated = stage(runs.settled(), "line-settled")
    finally:
        runs.close()
    hits = _places(docs).join(repeated, ["h1", "h2"]).groupBy("doc_id", "th").agg(F.collect_set("i").alias("lines"))
    key, th, lines = fresh(docs, "doc", "th", "lines")
    hits = stage(hits, "line-hits").select(F.col("doc_id").alias(key), F.col("th").alias(th), F.col("lines").alias(lines))
    # Merged, never broadcast: the plan, and so the share of input that is shuffled, is the same at every size.
    joined = docs.join(hits.hint("merge"), docs.doc_id.eqNullSafe(hits[key]) & (F.xxhash64(docs.text) == hits[th]), "left").drop(key, th)
    names = docs.columns
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in docs.schema), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    where = names.index("text")

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts, total, gone = [], [], []
            for text, lines in zip(part.column(where).to_pylist(), part.column(len(names)).to_pylist(), strict=True):
                split = (text or "").split("\n")
                total.append(len(split))
                gone.append(len(lines or ()))
                if lines:
                    bad = set(lines)
                    text = "\n".join(x for i, x in enumerate(split) if i not in bad)
                texts.append(text or "")
            columns = [pa.array(texts, part.column(i).type) if i == where else part.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], [*names, "n_lines", "n_dropped"])

    return joined.mapInArrow(cut, schema)


def line_digest(docs: DataFrame) -> DataFrame:
    """n_lines, n_dropped and a checksum of what is kept, of each row: null and empty texts have one line and keep it, equal rows give equal rows, an empty table none."""
    kept = drop_repeated_lines(docs.select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
