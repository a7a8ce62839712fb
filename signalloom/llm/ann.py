"""Approximate nearest neighbours by largest inner product: multiprobe p-stable hashing.

Vectors are extended by one component so that the largest inner product is the
nearest in Euclidean distance (vectors to the common largest norm, queries to
unit norm with a zero). Each table hashes by some Gaussian projections, cut in
cells of a width. A query visits the buckets of a table whose perturbation
is likeliest to hold near vectors: those with the least sum of squared
distances to the cell borders that are crossed. Candidates of all tables are
ranked by the exact inner product in double precision.

Tables, projections, width and probes are fitted: FIT_QUERIES queries find
their true neighbours among all vectors by brute force, and of a grid of
indexes the one is taken that finds RECALL of them by scoring the least share of
a sample of FIT_SAMPLE vectors. Where neighbours hardly stand out (isotropic
vectors), that share is large, and ``Fit`` says so.

Equal vectors are one entry with their least ids, as many as a query can
return, so a vector that a third of all rows share costs one entry. Buckets are
dealt in blocks of vectors and of queries; every pair of blocks is one product
of two small matrices, so no bucket is ever gathered and no pair is a row.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage

SEED = 11
#: Vectors on whose buckets an index is judged, queries that are searched by brute force for it, and the share of their neighbours it must find.
FIT_SAMPLE, FIT_QUERIES, RECALL = 4000, 192, 0.96
#: What is tried: projections a table, their cell widths, tables, and probes of a table.
GRID_DIMS, GRID_WIDTHS, GRID_TABLES, GRID_PROBES = (4, 8, 12), (0.7, 1.5, 3.0, 4.0), (1, 2), (1, 4, 16, 32, 64, 96, 144)
#: Vectors and queries of one block.
BLOCK, QUERY_BLOCK = 2048, 1024


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def perturbations(cell_distance: np.ndarray, probes: int) -> list[list[tuple[int, int]]]:
    """The ``probes`` likeliest sets of (projection, step), the empty one first; ``cell_distance``: place in the cell, 0 to 1."""
    m = len(cell_distance)
    moves = sorted([(x * x, j, -1) for j, x in enumerate(cell_distance)] + [((1 - x) ** 2, j, 1) for j, x in enumerate(cell_distance)])
    out, heap = [[]], [(moves[0][0], (0,))] if m else []
    while heap and len(out) < probes:
        cost, chosen = heapq.heappop(heap)
        if len({moves[k][1] for k in chosen}) == len(chosen):
            out.append([moves[k][1:] for k in chosen])
        last = chosen[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (cost + moves[last + 1][0], (*chosen, last + 1)))
            heapq.heappush(heap, (cost - moves[last][0] + moves[last + 1][0], (*chosen[:-1], last + 1)))
    return out


def _hash(x: np.ndarray, top: float, query: bool, table: int, dims: int, width: float) -> np.ndarray:
    """Real-valued cells (n, dims) of extended vectors."""
    rng = np.random.default_rng((SEED, table, x.shape[1]))
    a, shift = rng.normal(size=(x.shape[1] + 1, dims)), rng.uniform(0, 1, size=dims)
    norm = np.linalg.norm(x, axis=1)
    if query:
        x, rest = x / norm[:, None], np.zeros(len(x))
    else:
        x, rest = x / top, np.sqrt(np.maximum(0, 1 - (norm / top) ** 2))
    return (np.column_stack([x, rest]) @ a) / width + shift


def _cells(cells: np.ndarray) -> np.ndarray:
    """One key a row of integer cells."""
    key = np.zeros(len(cells), dtype=np.uint64)
    for j in range(cells.shape[1]):
        key = key * np.uint64(0x9E3779B97F4A7C15) + (cells[:, j] + 4096).astype(np.uint64)
    return key.view(np.int64)


@dataclass(frozen=True)
class Fit:
    """An index: its parameters, the share of true neighbours that the fitting queries found, and the share of vectors they scored (a vector counts once a table)."""

    tables: int
    dims: int
    width: float
    probes: int
    recall: float = 1.0
    share: float = 1.0


def _ranks(cells: np.ndarray, keys: list[np.ndarray]) -> list[np.ndarray]:
    """For each query, the probe (from 0) at which each of its vectors' buckets is visited; a large number where it isn't."""
    base = np.floor(cells).astype(np.int64)
    out = []
    for i, own in enumerate(keys):
        moves = perturbations(cells[i] - base[i], max(GRID_PROBES))
        visited = np.repeat(base[i : i + 1], len(moves), axis=0)
        for row, steps in enumerate(moves):
            for j, step in steps:
                visited[row, j] += step
        order = np.argsort(found := _cells(visited), kind="stable")
        at = np.minimum(np.searchsorted(found[order], own), len(order) - 1)
        out.append(np.where(found[order][at] == own, order[at], 1 << 30))
    return out


def choose(queries: np.ndarray, neighbours: list[np.ndarray], sample: np.ndarray, top: float, recall: float = RECALL) -> Fit:
    """The index of the grid that scores the least share of ``sample`` and still finds ``recall`` of each query's ``neighbours``; else the one that finds most."""
    total = max(1, sum(len(n) for n in neighbours))
    best: list[tuple[bool, float, Fit]] = []
    for dims in GRID_DIMS:
        for width in GRID_WIDTHS:
            hits, costs = [], []
            for t in range(max(GRID_TABLES)):
                cells = _hash(queries, top, True, t, dims, width)
                key = lambda x: _cells(np.floor(_hash(x, top, False, t, dims, width)).astype(np.int64))  # noqa: B023, E731
                shared = key(sample)
                both = _ranks(cells, [np.concatenate([key(n), shared]) for n in neighbours])
                hits.append([x[: len(n)] for x, n in zip(both, neighbours, strict=True)])
                costs.append(np.concatenate([x[len(n) :] for x, n in zip(both, neighbours, strict=True)]))
            for tables in GRID_TABLES:
                least = [np.minimum.reduce([hits[t][i] for t in range(tables)]) for i in range(len(queries))]
                for probes in GRID_PROBES:
                    found = sum(int((x < probes).sum()) for x in least) / total
                    share = float(sum(np.mean(costs[t] < probes) for t in range(tables)))
                    best.append((found < recall, share if found >= recall else -found, Fit(tables, dims, width, probes, found, share)))
    return min(best, key=lambda x: x[:2])[2]


def _brute(queries: np.ndarray, ids: np.ndarray, k: int):
    """Each task's ``k`` best vectors of every query, its own left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0), np.zeros(0, np.int64), np.zeros((0, queries.shape[1])))] * len(queries)
        for batch in batches:
            rows = np.flatnonzero(np.diff(batch.column(1).offsets.to_numpy()) == queries.shape[1])
            if not len(rows):
                continue
            part = batch.take(pa.array(rows))
            x, own = _vectors(part.column(1)), part.column(0).to_numpy()
            s = queries @ x.T
            for i in range(len(queries)):
                score, name, vectors = (np.concatenate([a, b]) for a, b in zip(held[i], (s[i], own, x), strict=True))
                keep = np.flatnonzero(name != ids[i])
                keep = keep[np.lexsort((name[keep], -score[keep]))[:k]]
                held[i] = score[keep], name[keep], vectors[keep]
        for i, (score, name, vectors) in enumerate(held):
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), i)), pa.array(name), pa.array(score), pa.array(vectors.tolist(), pa.list_(pa.float64()))], ["query", "id", "score", "vector"])

    return run


def fit(entries: DataFrame, top: float, k: int, recall: float = RECALL) -> Fit:
    """Parameters for the vectors (id, vector) of the commonest length; what the driver holds is bounded by the sample and the fitting queries."""
    lengths = entries.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not lengths:
        return Fit(1, 4, 4.0, 1)
    some = entries.where(F.size("vector") == lengths[0].d).orderBy(F.xxhash64("id"), "id").limit(FIT_SAMPLE).collect()
    sample, ids = np.array([r.vector for r in some], dtype=np.float64), np.array([r.id for r in some])
    asked = sample[:FIT_QUERIES]
    best = entries.mapInArrow(_brute(asked, ids[:FIT_QUERIES], k), "query long, id long, score double, vector array<double>")
    best = best.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("nth") <= k).collect()
    near: list[list] = [[] for _ in asked]
    for r in best:
        near[r["query"]].append(r.vector)
    return choose(asked, [np.array(n, dtype=np.float64).reshape(-1, sample.shape[1]) for n in near], sample, top, recall)


def _vectors(column: pa.Array) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()].astype(np.float64).reshape(len(column), -1)


def _buckets(top: float, query: bool, index: Fit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(batch.column(1).offsets.to_numpy())
            for d in np.unique(lengths):
                part = batch.take(pa.array(np.flatnonzero(lengths == d)))
                x = _vectors(part.column(1))
                for t in range(index.tables):
                    cells = _hash(x, top, query, t, index.dims, index.width)
                    base = np.floor(cells).astype(np.int64)
                    if query:
                        at, found = [], []
                        for i in range(len(x)):
                            for moves in perturbations(cells[i] - base[i], index.probes):
                                c = base[i].copy()
                                for j, step in moves:
                                    c[j] += step
                                at.append(i)
                                found.append(c)
                        at, key = np.array(at), _cells(np.array(found))
                    else:
                        at, key = np.arange(len(x)), _cells(base)
                    for a in range(0, len(at), 8192):
                        take = pa.array(at[a : a + 8192])
                        n = len(take)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, int(d) * 64 + t, np.int32)), pa.array(key[a : a + n]), part.column(0).take(take)], ["lane", "bucket", "id"])

    return run


def _score(k: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("entry", pa.int64()), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        q, v = (_vectors(t.column("vector").combine_chunks()) for t in (left, right))
        qid, vid = (t.column("id").to_numpy() for t in (left, right))
        order = np.argsort(vid, kind="stable")
        s = q @ v[order].T
        n = min(k + 1, s.shape[1])
        best = np.argsort(-s, axis=1, kind="stable")[:, :n]
        row = np.repeat(np.arange(len(q)), n)
        return pa.Table.from_arrays([pa.array(qid[row]), pa.array(vid[order][best.ravel()]), pa.array(s[row, best.ravel()])], schema=schema)

    return run


def nearest(vectors: DataFrame, *, k: int = 20, query_every: int = 20, index: Fit | None = None) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found of every query (rows whose vec_id is divisible by ``query_every``).

    Null ids take no part, nor vectors that are null, zero or hold null or
    non-finite components. Rows that share a vec_id and vector count once; a
    query's own id is never its neighbour. Vectors are compared with those of
    the same length only, as they are, in double precision where they are doubles.
    Ties go to the smaller vec_id. An empty table gives no rows. Other columns
    are ignored. Without ``index``, its parameters are fitted.
    """
    element = "double" if vectors.schema["embedding"].dataType.elementType.simpleString() == "double" else "float"
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.select("vec_id", F.col("embedding").cast(f"array<{element}>").alias("embedding")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = rows.select("vec_id", F.transform("embedding", lambda x: x + F.lit(0.0).cast(element)).alias("embedding"))
    # Least ids of each distinct vector: the limit is applied before the shuffle too.
    few = rows.dropDuplicates(["vec_id", "embedding"]).withColumn("nth", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    entries = few.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = stage(entries.select("id", F.col("embedding").alias("vector"), "ids"), "ann-entries")
    top = entries.select(F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))).first()[0] or 1.0
    index = index or fit(entries.select("id", "vector"), top, k)
    shape = "lane int, bucket long, id long"
    own = entries.select("id", "vector")
    data = stage(own.mapInArrow(_buckets(top, False, index), shape), "ann-buckets")
    queries = stage(rows.where(F.col("vec_id") % query_every == 0).dropDuplicates(["vec_id", "embedding"]).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")).repartition(parts, "id"), "ann-queries")
    # Probes are ids and buckets; vectors join them once it is known where they go.
    asked = stage(queries.repartition(parts, "id").mapInArrow(_buckets(top, True, index), shape), "ann-probes")
    sizes = data.groupBy("lane", "bucket").agg(F.count("*").alias("n")).join(asked.groupBy("lane", "bucket").agg(F.count("*").alias("m")), ["lane", "bucket"])
    sizes = stage(sizes.select("lane", "bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("vb"), F.ceil(F.col("m") / QUERY_BLOCK).cast("int").alias("qb")), "ann-blocks")
    block = lambda n: F.expr(f"cast(pmod(xxhash64(id), {n}) as int)")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["lane", "bucket", "v", "q"]
    right = data.join(sizes, ["lane", "bucket"]).select("lane", "bucket", block("vb").alias("v"), every("qb").alias("q"), "id").join(own, "id").select(*keys, "id", "vector")
    left = asked.join(sizes, ["lane", "bucket"]).select("lane", "bucket", every("vb").alias("v"), block("qb").alias("q"), "id").join(queries, "id").select(*keys, "id", "vector")
    scored = left.groupBy(keys).cogroup(right.groupBy(keys)).applyInArrow(_score(k), "query_id long, entry long, score double")
    best = scored.dropDuplicates(["query_id", "entry"]).withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "entry"))).where(F.col("nth") <= k + 1)
    members = best.join(entries.select(F.col("id").alias("entry"), "ids"), "entry").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    ranked = members.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
