"""Repeated byte strings by depth-limited radix sort of suffixes.

Suffixes are ordered by their first ``threshold`` bytes only, digit by digit,
and a group that has shrunk to one suffix leaves the sort.

* Of all suffixes only those take part that hold the least DIGIT-byte hash of
  some window of ``threshold`` bytes (every window holds one, and equal windows
  hold it at the same place): one in forty. A suffix stands for the windows in
  which its hash is the least, a range of start offsets.
* A pass has two digits: the bytes that all windows of the range share, and the
  bytes that any of them covers. Suffixes alone with their first digit end
  there. Where the second digit is equal too, the windows are equal: all but
  the earliest suffix's are repeats, as one interval. The earliest of each
  second digit goes on to the next pass, its range cut in parts (WIDTHS).
* In the last pass a part is one window, the digits are the window itself, and
  equal groups are exactly the repeated windows.

Groups are never gathered: their least place is an aggregate that combines on
the map side, and places are joined with it. Within a pass a bitmap of fixed
size says which first digits are shared and spares the others the shuffle; a
full bitmap only costs speed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import drop, stage
from .textkit import BASE, buffers, mix, powers, rounds

DIGIT = 24
#: Start offsets in a part of each pass after the first.
WIDTHS = (20, 5, 1)
#: Bits of the bitmap that says which first digits go on (16 MB, however much data).
BITMAP_BITS = 27
_U = np.uint64
_OTHER = _U(0xC2B2AE3D27D4EB4F)
_OTHER_INVERSE = _U(pow(int(_OTHER), -1, 1 << 64))
_cache: dict[str, np.ndarray] = {}


def _other_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _cache or len(_cache["p"]) < n:
        for key, base in (("p", _OTHER), ("i", _OTHER_INVERSE)):
            steps = np.full(max(n, 1 << 20), base, dtype=_U)
            steps[0] = 1
            _cache[key] = np.multiply.accumulate(steps)
    return _cache["p"][:n], _cache["i"][:n]


class Bytes:
    """Hashes of any byte ranges of a buffer, by two independent polynomials."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        wide = raw.astype(_U) + _U(1)
        (p, self.i1), (q, self.i2) = powers(n + 1), _other_powers(n + 1)
        self.s1, self.s2 = np.zeros(n + 1, _U), np.zeros(n + 1, _U)
        np.cumsum(wide * p[:n], out=self.s1[1:])
        np.cumsum(wide * q[:n], out=self.s2[1:])

    def first(self, a, b) -> np.ndarray:
        return mix((self.s1[b] - self.s1[a]) * self.i1[a])

    def second(self, a, b) -> np.ndarray:
        return mix((self.s2[b] - self.s2[a]) * self.i2[a] + BASE)


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best(x[i : i + width]) for each i that has so many."""
    n = len(x) - width + 1
    have, size = x, 1
    while 2 * size <= width:
        have = best(have[:-size], have[size:])
        size *= 2
    return best(have[:n], have[width - size : width - size + n])


def anchors(raw: np.ndarray, off: np.ndarray, threshold: int, digit: int = DIGIT):
    """Suffixes that take part: (hashes, first digit, place, least and most start offset before it, document)."""
    none = np.zeros(0, dtype=np.int64)
    span = threshold - digit + 1
    if len(raw) < threshold:
        return None, none.astype(_U), none, none, none, none
    hashes = Bytes(raw)
    ends = len(raw) - digit + 1
    g = mix((hashes.s1[digit:] - hashes.s1[:ends]) * hashes.i1[:ends])
    least = _sliding(g, span, np.minimum)
    valid = np.zeros(len(raw) + 1, dtype=np.int32)
    long = np.flatnonzero(np.diff(off) >= threshold)
    np.add.at(valid, off[long], 1)
    np.add.at(valid, off[long + 1] - threshold + 1, -1)
    valid = np.cumsum(valid)[: len(least)] > 0
    least = np.where(valid, least, _U(0))
    padded = np.concatenate([np.zeros(span - 1, _U), least, np.zeros(span - 1, _U)])
    place = np.flatnonzero(_sliding(padded, span, np.maximum)[: len(g)] == g)
    doc = np.searchsorted(off, place, side="right") - 1
    # The least place moves on with the window: runs of equal least hashes and places come in the same order.
    new = valid.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    new[off[long]] = True
    run = np.flatnonzero(new)
    home = np.searchsorted(off, run, side="right") - 1
    last = np.empty(len(run), dtype=np.int64)
    last[:-1] = run[1:] - 1
    last[-1:] = len(raw)
    last = np.minimum(last, off[home + 1] - threshold)
    per_doc = np.bincount(doc, minlength=len(off)) - np.bincount(home, minlength=len(off))
    single, first = per_doc[doc] == 0, per_doc[home] == 0
    lo, hi = np.zeros(len(place), dtype=np.int64), np.full(len(place), span - 1)
    lo[single], hi[single] = place[single] - last[first], place[single] - run[first]
    if not single.all():
        # Equal hashes within a window: each place's range is up to the next lesser hash on either side.
        some = place[~single]
        own, low, high = g[some], np.zeros(len(some), dtype=np.int64), np.full(len(some), span - 1)
        for d in range(span - 1, 0, -1):
            high[g[np.maximum(some - d, 0)] < own] = d - 1
            low[g[np.minimum(some + d, len(g) - 1)] < own] = span - d
        hi[~single] = np.minimum(high, some - off[doc[~single]])
        lo[~single] = np.maximum(low, some + threshold - off[doc[~single] + 1])
    keep = lo <= hi
    return hashes, g[place][keep], place[keep], lo[keep], hi[keep], doc[keep]


def parts(batch: pa.RecordBatch, threshold: int, width: int):
    """As ``anchors``, of suffixes given by their bytes: their ranges cut at multiples of ``width``; rows in place of documents."""
    raws = batch.column("bytes").to_pylist()
    raw = np.frombuffer(b"".join(raws), np.uint8)
    size = np.array([len(x) for x in raws], dtype=np.int64)
    begin = np.cumsum(size) - size
    least, most = batch.column("lo").to_numpy(), batch.column("hi").to_numpy()
    hashes = Bytes(raw)
    found = []
    for cut in range(0, threshold - DIGIT + 1, width):
        end = min(cut + width, threshold - DIGIT + 1) - 1
        row = np.flatnonzero((least <= end) & (most >= cut))
        at = begin[row] + most[row]
        found.append((hashes.first(at - cut, at - end + threshold) ^ mix(np.full(len(row), cut + 1, dtype=_U)), at, np.maximum(least[row], cut), np.minimum(most[row], end), row))
    return (hashes, *(np.concatenate(x) for x in zip(*found, strict=True)))


def _second(hashes: Bytes, place, lo, hi, threshold: int) -> np.ndarray:
    return hashes.second(place - hi, place - lo + threshold) ^ mix(hi.astype(_U) << _U(32) | lo.astype(_U))


def _sources(batches: Iterator[pa.RecordBatch], threshold: int, width: int | None):
    """(batch, kernel result, raw bytes, origin of each suffix's document) of documents (width None) or of suffixes."""
    for batch in batches:
        if width is None:
            raw_all, off_all = buffers(batch.column("text"))
            for a, b in rounds(off_all):
                raw, off = raw_all[off_all[a] : off_all[b]], off_all[a : b + 1] - off_all[a]
                hashes, d1, place, lo, hi, doc = anchors(raw, off, threshold)
                if len(place):
                    yield batch.slice(a, b - a), hashes, d1, place, lo, hi, doc, place - off[doc], raw
        else:
            for a in range(0, batch.num_rows, 4096):
                cut = batch.slice(a, 4096)
                hashes, d1, place, lo, hi, row = parts(cut, threshold, width)
                if len(place):
                    raw = np.frombuffer(b"".join(cut.column("bytes").to_pylist()), np.uint8)
                    yield cut, hashes, d1, place, lo, hi, row, cut.column("place").to_numpy()[row], raw


def _digits(threshold: int, width: int | None):
    """(d1, d2) of every suffix that takes part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, hashes, d1, place, lo, hi, _, _, _ in _sources(batches, threshold, width):
            yield pa.RecordBatch.from_arrays([pa.array(d1.view(np.int64)), pa.array(_second(hashes, place, lo, hi, threshold).view(np.int64))], ["d1", "d2"])

    return run


def _slot(d1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = d1.view(_U) >> _U(64 - BITMAP_BITS)
    return (s >> _U(6)).astype(np.int64), s & _U(63)


def _bitmap(keys: DataFrame) -> np.ndarray:
    """Bits of the keys' slots: one word a row, at most 2**(BITMAP_BITS - 6) rows."""
    slot = F.shiftrightunsigned("d1", 64 - BITMAP_BITS)
    bit = F.expr(f"shiftleft(1L, cast(pmod(shiftrightunsigned(d1, {64 - BITMAP_BITS}), 64) as int))")
    words = keys.groupBy(F.shiftrightunsigned(slot, 6).alias("w")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << (BITMAP_BITS - 6), dtype=np.int64)
    out[words["w"].to_numpy()] = words["bits"].to_numpy()
    return out.view(_U)


def _candidates(threshold: int, width: int | None, shared, differ, with_bytes: bool):
    """Suffixes whose first digit may be shared; on demand with their bytes where second digits may differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, other = shared.value, differ.value
        for batch, hashes, d1, place, lo, hi, doc, at, raw in _sources(batches, threshold, width):
            word, bit = _slot(d1)
            keep = np.flatnonzero((some[word] >> bit) & _U(1))
            if not len(keep):
                continue
            d1, place, lo, hi, doc, at, word, bit = (x[keep] for x in (d1, place, lo, hi, doc, at, word, bit))
            take = pa.array(doc)
            columns = [pa.array(d1.view(np.int64)), pa.array(_second(hashes, place, lo, hi, threshold).view(np.int64)), batch.column("doc_id").take(take), batch.column("th").take(take), pa.array(at << 16 | hi << 8 | lo)]
            names = ["d1", "d2", "doc_id", "th", "at"]
            if with_bytes:
                data, shown = raw.tobytes(), ((other[word] >> bit) & _U(1)) != 0
                payload = [data[a:b] if s else None for a, b, s in zip((place - hi).tolist(), (place - lo + threshold).tolist(), shown.tolist(), strict=True)]
                columns, names = [*columns, pa.array(payload, pa.binary())], [*names, "bytes"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


#: ``at``: place, most and least start offset before it, in one number that sorts as the place does.
_SUFFIX = "d1 long, d2 long, doc_id long, th long, at long"


def _order() -> Column:
    """Order of places: doc_id (nulls first), text hash among rows that share it, byte."""
    return F.struct(F.col("doc_id").isNotNull().alias("id"), "doc_id", "th", "at")


def _pass(source: DataFrame, threshold: int, width: int | None) -> tuple[DataFrame, DataFrame]:
    """(intervals that are repeats, suffixes that go on) of one pass."""
    context = source.sparkSession.sparkContext
    name = f"suffix-{width or 'all'}"
    digits = source.mapInArrow(_digits(threshold, width), "d1 long, d2 long")
    counts = digits.groupBy("d1").agg(F.count("*").alias("n"), F.min("d2").alias("least"), F.max("d2").alias("most")).where("n > 1")
    known = stage(counts.select("d1", (F.col("least") != F.col("most")).alias("differ")), f"{name}-digits")
    shared, differ = context.broadcast(_bitmap(known)), context.broadcast(_bitmap(known.where("differ")))
    drop(known)
    whole = source.mapInArrow(_candidates(threshold, width, shared, differ, True), f"{_SUFFIX}, bytes binary")
    first = whole.groupBy("d1", "d2").agg(F.min(F.struct(_order().alias("order"), "bytes")).alias("x"))
    first = stage(first.select("d1", "d2", "x.order.doc_id", "x.order.th", "x.order.at", "x.bytes"), f"{name}-first")
    places = source.mapInArrow(_candidates(threshold, width, shared, differ, False), _SUFFIX)
    earliest = first.select("d1", "d2", _order().alias("first")).hint("merge")
    later = places.join(earliest, ["d1", "d2"]).where(_order() != F.col("first"))
    place, most, least = F.shiftright("at", 16), F.shiftright("at", 8).bitwiseAND(F.lit(255)), F.col("at").bitwiseAND(F.lit(255))
    spans = stage(later.select("doc_id", "th", (place - most).alias("lo"), (place - least + threshold).alias("hi")), f"{name}-spans")
    return spans, first.where("bytes is not null").select("doc_id", "th", place.alias("place"), least.alias("lo"), most.alias("hi"), "bytes")


def repeated_spans(docs: DataFrame, threshold: int = 100) -> DataFrame:
    """(doc_id, th, lo, hi): byte intervals that together are all repeats; ``th`` tells apart rows that share a doc_id."""
    if not DIGIT < threshold <= DIGIT + 255:
        raise ValueError("threshold out of range")
    spans, rest = _pass(docs.select("doc_id", F.xxhash64("text").alias("th"), "text"), threshold, None)
    for width in WIDTHS:
        more, rest = _pass(rest, threshold, width)
        spans = spans.unionByName(more)
    return spans


def remove_repeats(docs: DataFrame, *, threshold: int = 100) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes).

    Removed is every byte that a string of ``threshold`` bytes covers which also
    starts earlier: in a smaller doc_id or earlier in the same document. A null
    text has no bytes. Rows that share a doc_id are ordered by a hash of their
    text; equal rows count as one, so neither is removed for the other. A null
    doc_id comes first. An empty table gives no rows. Other columns are ignored.
    """
    spans = repeated_spans(docs, threshold).groupBy("doc_id", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    spans = stage(spans, "suffix-spans").select(F.col("doc_id").alias("k"), F.col("th").alias("h"), "spans")
    on = F.col("doc_id").eqNullSafe(F.col("k")) & (F.xxhash64("text") == F.col("h"))
    joined = docs.select("doc_id", "text").join(spans.hint("merge"), on, "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = buffers(batch.column(1))
            removed, runs, kept = [], [], []
            lists = batch.column(2)
            for i in range(batch.num_rows):
                data = raw[off[i] : off[i + 1]]
                if not lists[i].is_valid:
                    removed.append(0)
                    runs.append(0)
                    kept.append(data.tobytes())
                    continue
                cells = lists[i].values
                lo, hi = cells.field("lo").to_numpy(), cells.field("hi").to_numpy()
                cover = np.zeros(len(data) + 1, dtype=np.int64)
                np.add.at(cover, lo, 1)
                np.add.at(cover, hi, -1)
                gone = np.cumsum(cover)[:-1] > 0
                removed.append(int(gone.sum()))
                runs.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                kept.append(data[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def suffix_digest(docs: DataFrame) -> DataFrame:
    """Counts and a checksum of what is left, of each document."""
    return remove_repeats(docs).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
