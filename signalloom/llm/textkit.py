"""Vectorised text kernels on Arrow string buffers: words, word hashes, shingles.

All of them work on the UTF-8 bytes of many documents at once, so that a
document costs a few NumPy passes over its bytes and no Python object a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_U = np.uint64
BASE = _U(0x9E3779B97F4A7C15)
INVERSE = _U(pow(int(BASE), -1, 1 << 64))
#: Bytes of text that one round of the kernels takes at most (a longer document is a round of its own).
ROUND_BYTES = 1 << 17

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """True for bytes that belong to a word: all but the given ranges."""
    member = np.ones(256, dtype=bool)
    for a, b in ranges:
        member[a : b + 1] = False
    return member


#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text.
ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: Words [^\x20\x09-\x0D]+.
NONSPACE = byte_class((0x20, 0x20), (0x09, 0x0D))

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i < n, modulo 2**64."""
    if "p" not in _powers or len(_powers["p"]) < n:
        size = max(n, ROUND_BYTES + 1)
        for key, base in (("p", BASE), ("i", INVERSE)):
            steps = np.full(size, base, dtype=_U)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["p"][:n], _powers["i"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise a 64-bit hash so that every bit depends on every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, at, data = column.buffers()
    off = np.frombuffer(at, dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def rounds(off: np.ndarray, limit: int = ROUND_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of documents of at most ``limit`` bytes together."""
    a, n = 0, len(off) - 1
    while a < n:
        b = int(np.searchsorted(off, off[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def split_words(raw: np.ndarray, off: np.ndarray, member: np.ndarray, lower: bool = True):
    """Words of the documents in ``raw``: (lower-cased bytes, starts, ends, first word of each document).

    ``off`` starts at 0. The last array has one more entry than there are documents.
    """
    low = ASCII_LOWER[raw] if lower else raw
    inside = member[low]
    starts, ends = inside.copy(), inside.copy()
    if len(inside):
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        full = np.flatnonzero(off[1:] > off[:-1])
        starts[off[full]] = inside[off[full]]
        ends[off[full + 1] - 1] = inside[off[full + 1] - 1]
    ws, we = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return low, ws, we, np.searchsorted(ws, off, side="left")


#: Bytes up to which a word is hashed eight at a time together with others; a longer one is hashed by itself.
LONG_WORD = 256


def word_hashes(low: np.ndarray, ws: np.ndarray, we: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: eight bytes at a time, mixed in after each step, so no sum of terms can cancel."""
    size = we - ws
    if not len(size):
        return np.zeros(0, dtype=_U)
    at = np.lib.stride_tricks.sliding_window_view(np.concatenate([low, np.zeros(8, np.uint8)]), 8)
    out = mix(size.astype(_U) + BASE)
    rows, step = np.flatnonzero(size <= LONG_WORD), 0
    while len(rows):
        part = at[ws[rows] + step].view(_U)[:, 0]
        rest = size[rows] - step
        part &= np.where(rest < 8, (_U(1) << (_U(8) * np.minimum(rest, 7).astype(_U))) - _U(1), ~_U(0))
        out[rows] = mix(out[rows] ^ part) * BASE
        step += 8
        rows = rows[rest > 8]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(low[ws[i] : we[i]].tobytes())
    return out


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k consecutive word hashes (windows may cross documents)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    out = np.zeros(n, dtype=_U)
    for i in range(k):
        out = out * _U(0xD1342543DE82EF95) + words[i : i + n]
    return mix(out)


def windows_within(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(start word, document) of each window of k words that stays within its document."""
    n = np.maximum(np.diff(first) - k + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[:-1], n)
    return at, doc


def phrase_words(text: str, member: np.ndarray = ALNUM) -> tuple[list[bytes], np.ndarray]:
    """(words, their hashes) of one text."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    low, ws, we, _ = split_words(raw, np.array([0, len(raw)]), member)
    return words_of(low, ws, we), word_hashes(low, ws, we)


def words_of(low: np.ndarray, ws: np.ndarray, we: np.ndarray) -> list[bytes]:
    """The words themselves."""
    data = low.tobytes()
    return [data[a:b] for a, b in zip(ws.tolist(), we.tolist(), strict=True)]
