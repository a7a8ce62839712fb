"""Packing: best-fit decreasing over bounded groups of documents.

A task reads documents in the order of its input split, cuts each into full
windows of ``width`` tokens and a tail, and gathers tails until a group is
full. A group is packed longest tail first; a segment tree over remaining
capacity finds the tightest open window that still holds the tail. Nothing is
shuffled, a group's size bounds the memory of a task, and no key decides where
a document goes, so skew cannot arise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import MEMO_PIECES, encoder

#: Tails that are packed together, and tokens that a group holds at most.
GROUP_TAILS, GROUP_TOKENS = 32_768, 16_000_000
_SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class CapacityTree:
    """Open windows by remaining capacity 0..width; finds the least capacity of at least some size."""

    def __init__(self, width: int):
        self.leaves = 1 << width.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(width + 1)]

    def _change(self, capacity: int, by: int) -> None:
        i = capacity + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def add(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        self._change(capacity, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """(capacity, window) of the tightest open window for ``size``, which is taken out, or None."""
        i = size + self.leaves
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        self._change(capacity, -1)
        return capacity, self.windows[capacity].pop()


def best_fit(sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(window, offset) of each size, and the number of windows. Sizes lie in 1..width; ties keep their order."""
    tree, windows, n = CapacityTree(width), np.zeros(len(sizes), np.int64), 0
    offsets = np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        found = tree.take(size)
        if found is None:
            found, n = (width, n), n + 1
        capacity, windows[i] = found
        offsets[i] = width - capacity
        if capacity > size:
            tree.add(capacity - size, int(windows[i]))
    return windows, offsets, n


def pack_documents(docs: DataFrame, tokenizer: str, *, width: int = 1024, end_id: int = 0, spaced: bool = True, memo_pieces: int = MEMO_PIECES) -> DataFrame:
    """Pieces of every document: where its ids lie and in which sequence, with the ids (little-endian uint32 bytes).

    A null or empty text is one piece, ``end_id`` alone. Rows that share a
    doc_id are documents of their own; a null doc_id stays null. An empty table
    gives no rows. Columns besides doc_id and text are ignored. sequence_id is
    unique, not dense: the task's number in the upper bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer, spaced, memo_pieces), np.array([end_id], dtype="<u4").tobytes()
        base = TaskContext.get().partitionId() << 40
        used, tails, held = 0, [], 0

        def rows(pieces: list[tuple]) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(pieces), 2048):
                columns = list(zip(*pieces[a : a + 2048], strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns[:-1]), pa.array(columns[-1], pa.binary())], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal used, tails, held
            window, offset, n = best_fit(np.array([t[2] for t in tails], dtype=np.int64), width)
            yield from rows([(*t[:4], base + used + w, o, t[4]) for t, w, o in zip(tails, window.tolist(), offset.tolist(), strict=True)])
            used, tails, held = used + n, [], 0

        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part, full = batch.slice(a, 256), []
                for doc, got in zip(part.column(0).to_pylist(), enc.ids(part.column(1).to_pylist()), strict=True):
                    got += end
                    n = len(got) // 4
                    whole = n // width * width
                    for s in range(0, whole, width):
                        full.append((doc, s, width, n, base + used, 0, got[4 * s : 4 * (s + width)]))
                        used += 1
                    if n > whole:
                        tails.append((doc, whole, n - whole, n, got[4 * whole :]))
                        held += n - whole
                yield from rows(full)
                if len(tails) >= GROUP_TAILS or held >= GROUP_TOKENS:
                    yield from flush()
        if tails:
            yield from flush()

    return docs.select("doc_id", "text").mapInArrow(run, _SCHEMA)


def sequences(pieces: DataFrame, *, width: int = 1024, pad_id: int = 0) -> DataFrame:
    """The packed sequences themselves: sequence_id and ``width`` ids, padded at the end."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(ordered, F.lit("").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    pad = F.unhex(F.lit(int(pad_id).to_bytes(4, "little").hex()))
    short = F.expr(f"{width} - cast(octet_length(ids) / 4 as int)")
    padding = F.aggregate(F.array_repeat(pad, short), F.lit("").cast("binary"), lambda a, x: F.concat(a, x))
    return pieces.groupBy("sequence_id").agg(joined.alias("ids")).withColumn("ids", F.concat("ids", F.when(short > 0, padding).otherwise(F.lit("").cast("binary"))))


def packing_digest(docs: DataFrame, tokenizer: str, **options: int) -> DataFrame:
    """The packed pieces with a checksum in place of their ids."""
    return pack_documents(docs, tokenizer, **options).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
