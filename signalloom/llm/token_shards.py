"""Token-ID output: patched frame-of-reference blocks in shard files.

Format of a shard file, a run of records ``[uint32 length][kind][body]\\n``:

* ``T`` token blocks, one after the other, of BLOCK ids each (the last of a
  record may hold less). A block is ``[uint32 minimum][uint8 width][uint16
  exceptions][uint16 ids]``, where the width in bits holds PERCENTILE of the ids'
  distances from the minimum, then the exceptions (uint16 positions, uint32
  bits above the width) of the ids that don't fit, then all distances packed at
  that width into 64-bit words.
* ``D`` documents that end in the record before: their ids and token counts.
* ``I`` the index: for each block its byte offset in the file and the number of
  tokens before it, so that any token is reached by one seek.
* ``F`` the foot, last and of fixed size: where the index begins, and how many
  tokens the file holds.

Shards hold ascending ranges of doc_id and their names sort the same way. As
many are written as keep each near SHARD_BYTES of text at most, so that one
fits a task however large the table. They are written through Spark's own
committer, so a lost executor or a repeated task leaves no partial file, on any
file system that Spark can write.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import files
from ..staging import new_path, stage
from .bpe import encoder

BLOCK, PERCENTILE = 1024, 0.95
_GROUP = 64
#: Tokens that a task gathers before it writes them as one record.
RECORD_TOKENS = 1 << 19
#: Bytes of text that a shard holds, about; a longer document is a shard of its own.
SHARD_BYTES = 1 << 27
_HEAD, _FOOT = "<IBHH", "<QQ"


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 64 values of ``width`` bits each, as rows of ``width`` words."""
    words = np.zeros((len(values), width), dtype=np.uint64)
    v = values.astype(np.uint64)
    for i in range(_GROUP if width else 0):
        w, at = divmod(i * width, 64)
        words[:, w] |= v[:, i] << np.uint64(at)
        if at + width > 64:
            words[:, w + 1] |= v[:, i] >> np.uint64(64 - at)
    return words


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    """The inverse of ``pack``."""
    out = np.zeros((len(words), _GROUP), dtype=np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(_GROUP if width else 0):
        w, at = divmod(i * width, 64)
        out[:, i] = words[:, w] >> np.uint64(at)
        if at + width > 64:
            out[:, i] |= words[:, w + 1] << np.uint64(64 - at)
    return out & mask


def encode_blocks(ids: np.ndarray) -> tuple[bytes, list[int]]:
    """(token ids, unsigned 32-bit, as blocks; the byte at which each block starts)."""
    n = len(ids)
    nb = -(-n // BLOCK)
    full = np.zeros(nb * BLOCK, dtype=np.uint32)
    full[:n] = ids
    if n % BLOCK:
        full[n:] = ids[n - n % BLOCK :].min()
    grid = full.reshape(nb, BLOCK)
    low = grid.min(axis=1, initial=2**32 - 1)
    dist = grid - low[:, None]
    at = int(np.ceil(PERCENTILE * BLOCK)) - 1
    top = np.partition(dist.astype(np.uint16) if dist.max(initial=0) < 1 << 16 else dist, at, axis=1)[:, at]
    width = np.ceil(np.log2(top.astype(np.float64) + 1)).astype(np.uint8)
    limit = (np.uint64(1) << width.astype(np.uint64))[:, None]
    row, col = np.nonzero(dist >= limit)
    high = (dist[row, col].astype(np.uint64) >> width[row].astype(np.uint64)).astype("<u4")
    first = np.searchsorted(row, np.arange(nb + 1))
    dist &= (limit - np.uint64(1)).astype(np.uint32)
    packed: list[bytes] = [b""] * nb
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        words = pack(dist[rows].reshape(-1, _GROUP), int(w)).astype("<u8").reshape(len(rows), -1)
        for i, x in zip(rows.tolist(), words, strict=True):
            packed[i] = x.tobytes()
    col = col.astype("<u2")
    out, starts, size = [], [], 0
    for i in range(nb):
        a, b = int(first[i]), int(first[i + 1])
        block = struct.pack(_HEAD, int(low[i]), int(width[i]), b - a, min(BLOCK, n - i * BLOCK)) + col[a:b].tobytes() + high[a:b].tobytes() + packed[i]
        out.append(block)
        starts.append(size)
        size += len(block)
    return b"".join(out), starts


def decode_blocks(body: bytes) -> np.ndarray:
    """The inverse of ``encode_blocks``, of any run of whole blocks."""
    lows, widths, counts, sizes, words, exceptions, at = [], [], [], [], [], [], 0
    while at < len(body):
        low, width, count, size = struct.unpack_from(_HEAD, body, at)
        at += struct.calcsize(_HEAD)
        exceptions.append(body[at : at + 6 * count])
        at += 6 * count
        k = 8 * width * (BLOCK // _GROUP)
        words.append(body[at : at + k])
        at += k
        lows.append(low)
        widths.append(width)
        counts.append(count)
        sizes.append(size)
    nb, width = len(lows), np.array(widths, dtype=np.int64)
    grid = np.zeros((nb, BLOCK), dtype=np.uint64)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        some = np.frombuffer(b"".join(words[i] for i in rows.tolist()), "<u8").reshape(-1, int(w)) if w else np.zeros((len(rows) * BLOCK // _GROUP, 0), "<u8")
        grid[rows] = unpack(some, int(w)).reshape(-1, BLOCK)
    col = np.frombuffer(b"".join(x[: 2 * c] for x, c in zip(exceptions, counts, strict=True)), "<u2")
    high = np.frombuffer(b"".join(x[2 * c :] for x, c in zip(exceptions, counts, strict=True)), "<u4")
    row = np.repeat(np.arange(nb), counts)
    grid[row, col] |= high.astype(np.uint64) << width[row].astype(np.uint64)
    flat = (grid + np.array(lows, dtype=np.uint64)[:, None]).astype(np.uint32).reshape(-1)
    # Only the last block of a record is short.
    short = [i for i, size in enumerate(sizes) if size < BLOCK]
    if not short:
        return flat
    keep = np.ones((nb, BLOCK), dtype=bool)
    for i in short:
        keep[i, sizes[i] :] = False
    return flat[keep.reshape(-1)]


def _record(kind: bytes, body: bytes) -> bytes:
    return struct.pack("<I", len(body)) + kind + body


def records(content: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, body) of each record of a file."""
    at = 0
    while at < len(content):
        (n,) = struct.unpack_from("<I", content, at)
        yield content[at + 4 : at + 5], content[at + 5 : at + 5 + n]
        at += n + 6  # the line feed that the text sink adds


def _documents(ids: list, lengths: list[int]) -> bytes:
    null = np.array([x is None for x in ids], dtype=np.uint8)
    return struct.pack("<I", len(ids)) + np.packbits(null).tobytes() + np.array([x or 0 for x in ids], dtype="<i8").tobytes() + np.array(lengths, dtype="<u8").tobytes()


def read_documents(body: bytes) -> tuple[list, np.ndarray]:
    """(doc ids, token counts) of a ``D`` record."""
    (n,) = struct.unpack_from("<I", body)
    at = 4 + -(-n // 8)
    null = np.unpackbits(np.frombuffer(body, np.uint8, at - 4, 4))[:n]
    ids = np.frombuffer(body, "<i8", n, at).tolist()
    return [None if z else x for x, z in zip(ids, null, strict=True)], np.frombuffer(body, "<u8", n, at + 8 * n)


def write_shards(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 2, spaced: bool = False, shards: int | None = None) -> None:
    """Encode every whole text and write the shard files to ``path``.

    A null text is an empty one: only ``end_id``. A null doc_id sorts first.
    Rows that share a doc_id are documents of their own, ordered by text. An
    empty table gives no tokens. Columns besides doc_id and text are ignored.
    Ranges of doc_id are drawn so that shards hold about as many documents each;
    without ``shards`` their number follows from the bytes of all texts.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer, spaced), np.array([end_id], dtype="<u4").tobytes()
        held, ids, lengths, size = [], [], [], 0
        offsets, starts, at, before = [], [], 0, 0

        def flush():
            nonlocal held, ids, lengths, size, at, before
            tokens = np.frombuffer(b"".join(held), dtype="<u4")
            out = []
            if len(tokens):
                body, blocks = encode_blocks(tokens)
                offsets.extend(at + 5 + x for x in blocks)
                starts.extend(range(before, before + len(tokens), BLOCK))
                out.append(_record(b"T", body))
            out.append(_record(b"D", _documents(ids, lengths)))
            at += sum(len(x) + 1 for x in out)
            before += len(tokens)
            held, ids, lengths, size = [], [], [], 0
            return out

        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                for doc, got in zip(part.column(0).to_pylist(), enc.ids(part.column(1).to_pylist()), strict=True):
                    held += [got, end]
                    ids.append(doc)
                    lengths.append(len(got) // 4 + 1)
                    size += lengths[-1]
                if size >= RECORD_TOKENS:
                    yield pa.RecordBatch.from_arrays([pa.array(flush(), pa.binary())], ["record"])
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(flush(), pa.binary())], ["record"])
        if at:
            index = struct.pack("<I", len(offsets)) + np.array(offsets, "<u8").tobytes() + np.array(starts, "<u8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([_record(b"I", index), _record(b"F", struct.pack(_FOOT, at, before))], pa.binary())], ["record"])

    if not shards:
        text_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes // SHARD_BYTES))
    # The beginning of the text parts rows that share a doc_id, null ones above all, over several shards.
    dealt = docs.select("doc_id", "text").repartitionByRange(shards, F.col("doc_id"), F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(encode, "record binary").select(F.col("record").cast("string").alias("value")).write.text(path)


def shard_files(spark: SparkSession, path: str) -> DataFrame:
    """(shard, content) of the files, in any order; ``shard`` ascends with doc_id."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("long").alias("shard"), "content").where("length(content) > 0")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Decode the files: one row a document with doc_id, start, n_tokens and its ids as little-endian uint32 bytes."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                start, raw = 0, b""
                for kind, body in records(content.as_py()):
                    if kind == b"T":
                        raw = decode_blocks(body).astype("<u4").tobytes()
                    elif kind == b"D":
                        ids, n = read_documents(body)
                        ends = np.cumsum(n).astype(np.int64)
                        begins = ends - n.astype(np.int64)
                        for a in range(0, len(ids), 512):
                            cut = slice(a, a + 512)
                            k = len(ids[cut])
                            pieces = [raw[4 * p : 4 * q] for p, q in zip(begins[cut].tolist(), ends[cut].tolist(), strict=True)]
                            yield pa.RecordBatch.from_arrays([pa.array([shard] * k, pa.int64()), pa.array(ids[cut], pa.int64()), pa.array(start + begins[cut]), pa.array(n[cut].astype(np.int64)), pa.array(pieces, pa.binary())], ["shard", "doc_id", "at", "n_tokens", "ids"])
                        start, raw = start + int(ends[-1]), b""

    return shard_files(spark, path).mapInArrow(decode, "shard long, doc_id long, at long, n_tokens long, ids binary")


class TokenReader:
    """Any run of ids of the whole corpus, by the indexes of its shards: only the blocks that hold it are read."""

    def __init__(self, spark: SparkSession, path: str):
        found = [p for p in files.listed(path) if p.rsplit("/", 1)[-1].startswith("part-") and files.length(p)]
        self.shards, self.before, total = found, [], 0
        self.feet = []
        size = 5 + struct.calcsize(_FOOT) + 1
        for p in found:
            index_at, tokens = struct.unpack_from(_FOOT, b"".join(files.chunks(p, files.length(p) - size, size)), 5)
            self.feet.append((index_at, files.length(p) - size - index_at))
            self.before.append(total)
            total += tokens
        self.total = total

    def index(self, shard: int) -> tuple[np.ndarray, np.ndarray]:
        """(byte offset of each block, tokens before it) of a shard."""
        at, size = self.feet[shard]
        body = b"".join(files.chunks(self.shards[shard], at + 5, size - 6))
        (n,) = struct.unpack_from("<I", body)
        return np.frombuffer(body, "<u8", n, 4).astype(np.int64), np.frombuffer(body, "<u8", n, 4 + 8 * n).astype(np.int64)

    def read(self, start: int, n: int) -> np.ndarray:
        """Up to ``n`` ids from ``start``, counted over all shards."""
        out, end = [], min(start + n, self.total)
        for k, before in enumerate(self.before):
            after = self.before[k + 1] if k + 1 < len(self.before) else self.total
            if before >= end or after <= start:
                continue
            offsets, starts = self.index(k)
            a, b = max(start - before, 0), min(end, after) - before
            i, j = int(np.searchsorted(starts, a, "right")) - 1, int(np.searchsorted(starts, b, "left"))
            ids = [decode_blocks(self._block(k, x)) for x in offsets[i:j].tolist()]
            out.append(np.concatenate(ids)[a - int(starts[i]) : b - int(starts[i])])
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def _block(self, shard: int, at: int) -> bytes:
        head = b"".join(files.chunks(self.shards[shard], at, struct.calcsize(_HEAD)))
        _, width, count, _ = struct.unpack(_HEAD, head)
        return head + b"".join(files.chunks(self.shards[shard], at + struct.calcsize(_HEAD), 6 * count + 8 * width * (BLOCK // _GROUP)))


def with_starts(rows: DataFrame) -> DataFrame:
    """Add ``start``, the number of ids before each document in all shards: one sum a shard, no sort of documents."""
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("before"))
    return rows.join(before, "shard").withColumn("start", F.col("before") + F.col("at")).drop("shard", "before", "at")


def token_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the shards, read them back and give each row's start, length and checksum.

    A null or empty text is the end id alone; a null doc_id comes first; rows that
    share a doc_id, equal ones too, are documents each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    path = new_path(spark, "token-shards")
    write_shards(docs, path, tokenizer)
    rows = read_shards(spark, path).select("shard", "doc_id", "at", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return with_starts(stage(rows, "token-digest")).select("doc_id", "start", "n_tokens", "ids_crc32")


