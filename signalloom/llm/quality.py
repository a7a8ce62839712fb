"""Quality classifier: gated-attention multiple-instance learning.

A document is a bag of passages of PASSAGE_WORDS words. Each passage is encoded
by its byte classes and the shape of its words; a small network maps it to a
hidden vector, gated attention weighs the passages, and the weighted sum is
scored. Only document labels are needed to learn which passages matter.

The model is fitted on the driver on at most SAMPLE labelled documents of each
class (those with the smallest hash of doc_id, so any input size gives the same
kind of sample) and TAUGHT passages of each; scoring is a narrow pass over all whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import NONSPACE, buffers, rounds, split_words, word_hashes

PASSAGE_WORDS = 64
#: Labelled documents of each class that the model is fitted on at most.
SAMPLE = 2000
#: Passages of a labelled document that the model is fitted on at most, evenly spaced; scoring takes all.
TAUGHT = 256
HIDDEN, GATE, STEPS, BAGS, RATE, SEED = 24, 12, 500, 128, 0.01, 20240607
ACCEPT = 0.7

_MARKS = b"!#$%&*|,.?'\"()-:;/@_+=<>[]{}\\^~`"
_CLASSES = 10 + len(_MARKS)
_LUT = np.full(256, 0, dtype=np.int64)
_LUT[97:123], _LUT[65:91], _LUT[48:58] = 1, 2, 3
_LUT[32], _LUT[9:14], _LUT[0x80:0xC0], _LUT[0xC0:0xE0], _LUT[0xE0:0xF0], _LUT[0xF0:] = 4, 5, 6, 7, 8, 9
for _i, _c in enumerate(_MARKS):
    _LUT[_c] = 10 + _i
FEATURES = _CLASSES + 8


def passages(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, document) of each passage of the documents in ``raw``; a document without words has none."""
    _, ws, we, first = split_words(raw, off, NONSPACE, lower=False)
    n = np.diff(first)
    per = -(-n // PASSAGE_WORDS)
    doc = np.repeat(np.arange(len(n)), per)
    total = len(doc)
    if not total:
        return np.zeros((0, FEATURES), np.float32), doc
    nth = np.arange(total) - np.repeat(np.cumsum(per) - per, per)
    begin = np.repeat(first[:-1], per) + nth * PASSAGE_WORDS
    end = np.minimum(begin + PASSAGE_WORDS, np.repeat(first[1:], per))
    words = end - begin
    mine = np.repeat(np.arange(total), words)
    lo, hi = ws[begin], we[end - 1]
    size = hi - lo
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
    counts = np.bincount(np.repeat(np.arange(total), size) * _CLASSES + _LUT[raw[at]], minlength=total * _CLASSES).reshape(total, _CLASSES)
    h = word_hashes(raw, ws, we)
    same = np.zeros(len(h))
    same[1:] = h[1:] == h[:-1]
    same[begin] = 0
    width = (we - ws).astype(np.float64)
    upper = (raw[ws] >= 65) & (raw[ws] <= 90)
    tail = raw[np.minimum(ws + 1, we - 1)]
    shout = upper & (tail >= 65) & (tail <= 90) & (width > 1)
    order = np.lexsort((h, mine))
    new = np.ones(len(h))
    new[1:] = (h[order][1:] != h[order][:-1]) | (mine[order][1:] != mine[order][:-1])
    add = lambda x: np.bincount(mine, weights=x, minlength=total)
    shape = [add(width) / words, np.sqrt(np.maximum(add(width * width) / words - (add(width) / words) ** 2, 0)), add(same) / words, add(upper) / words, add(shout) / words, np.bincount(mine[order], weights=new, minlength=total) / words, np.log1p(words), (hi - lo) / 400.0]
    return np.concatenate([np.sqrt(counts / size[:, None]), np.stack(shape, axis=1)], axis=1).astype(np.float32), doc


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Weights of the network; ``score`` takes passages grouped by bag."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.w = {"W": draw(FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "a": draw(GATE), "c": draw(HIDDEN), "c0": np.zeros(1)}

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict:
        w, n = self.w, np.diff(np.append(starts, len(x)))
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.maximum(x @ w["W"] + w["b"], 0)
        t, s = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        e = (t * s) @ w["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), n))
        att = e / np.repeat(np.add.reduceat(e, starts), n)
        z = np.add.reduceat(att[:, None] * h, starts)
        return {"x": x, "h": h, "t": t, "s": s, "att": att, "z": z, "n": n, "p": _sigmoid(z @ w["c"] + w["c0"])}

    def score(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return self.forward(x, starts)["p"]

    def gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        w, f = self.w, self.forward(x, starts)
        do = (f["p"] - y) * weight / weight.sum()
        dz = np.repeat(np.outer(do, w["c"]), f["n"], axis=0)
        da = (dz * f["h"]).sum(axis=1)
        de = f["att"] * (da - np.repeat(np.add.reduceat(f["att"] * da, starts), f["n"]))
        dg = np.outer(de, w["a"])
        dt, ds = dg * f["s"] * (1 - f["t"] ** 2), dg * f["t"] * f["s"] * (1 - f["s"])
        dh = (f["att"][:, None] * dz + dt @ w["V"].T + ds @ w["U"].T) * (f["h"] > 0)
        return {"W": f["x"].T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "a": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ do, "c0": do.sum(keepdims=True)}


def fit(bags: list[np.ndarray], y: np.ndarray, seed: int = SEED) -> Model:
    """Adam on cross-entropy with both classes of equal weight."""
    every = np.concatenate(bags)
    model = Model(every.mean(axis=0), every.std(axis=0) + 0.02, seed)
    rng = np.random.default_rng(seed + 1)
    m = {k: np.zeros_like(v) for k, v in model.w.items()}
    v = {k: np.zeros_like(x) for k, x in model.w.items()}
    share = np.array([max((y == 0).mean(), 1e-9), max((y == 1).mean(), 1e-9)])
    for step in range(1, STEPS + 1):
        pick = rng.integers(0, len(bags), BAGS)
        x, n = np.concatenate([bags[i] for i in pick]), np.array([len(bags[i]) for i in pick])
        got = model.gradients(x, np.cumsum(n) - n, y[pick], 0.5 / share[y[pick].astype(int)])
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for k, g in got.items():
            g = g + 1e-4 * model.w[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            model.w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(doc_id) -> F.Column:
    """Rows that never teach: crc32 of the id as text, modulo 4, is 2. A null id teaches nothing, but isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, seed: int = SEED) -> Model | None:
    """Fit on the bounded sample; None where a class has no document to learn from.

    Null labels, labels outside 0 and 1, and ids whose labels disagree are left out.
    """
    clean = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("most")).where("q = most")
    clean = clean.where(~held_out("doc_id")).select("doc_id", F.col("q").cast("int").alias("q"))
    taught = [r for q in (0, 1) for r in clean.where(F.col("q") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).collect()]
    if len({r.q for r in taught}) < 2:
        return None
    sample = docs.sparkSession.createDataFrame(taught, "doc_id long, q int")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = buffers(batch.column(2))
            for a, b in rounds(off):
                x, doc = passages(raw[off[a] : off[b]], off[a : b + 1] - off[a])
                cut = np.searchsorted(doc, np.arange(b - a + 1))
                pick = [np.unique(np.linspace(cut[i], cut[i + 1] - 1, min(TAUGHT, cut[i + 1] - cut[i])).astype(np.int64)) for i in range(b - a)]
                bags = [x[i].tobytes() for i in pick]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(bags, pa.binary())], ["doc_id", "q", "bag"])

    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "q", "text").mapInArrow(encode, "doc_id long, q int, bag binary").collect()
    rows = sorted((r for r in rows if len(r.bag)), key=lambda r: (r.doc_id, bytes(r.bag)))
    y = np.array([r.q for r in rows], dtype=np.float64)
    if len(set(y.tolist())) < 2:
        return None
    return fit([np.frombuffer(bytes(r.bag), np.float32).reshape(-1, FEATURES).astype(np.float64) for r in rows], y, seed)


def score_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if score >= ACCEPT).

    A text without words (null and empty ones too) scores 0. Without a model
    (nothing to learn from) every text with words scores 1, so that nothing is
    lost. Rows that share a doc_id are scored each by its own text. An own
    score or predicted column is replaced; other columns are kept.
    """
    docs = docs.drop("score", "predicted")
    names = docs.columns
    where = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = buffers(batch.column(where))
            for a, b in rounds(off):
                x, doc = passages(raw[off[a] : off[b]], off[a : b + 1] - off[a])
                p = np.zeros(b - a)
                full, starts = np.unique(doc, return_index=True)
                if len(full):
                    p[full] = model.score(x.astype(np.float64), starts) if model else 1.0
                cut = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*cut.columns, pa.array(p), pa.array((p >= ACCEPT).astype(np.int32))], [*names, "score", "predicted"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "score double, predicted int"])
    return docs.mapInArrow(run, schema)


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = score_documents(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
