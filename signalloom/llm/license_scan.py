"""License scan by diagonal voting.

Every rolling word k-gram of every document is hashed and joined by Spark to
the positions of the same k-grams in the license templates. A match at word p
of a document and word o of a template votes for the diagonal p - o. Diagonals
of one template that lie next to each other (words were inserted or left out)
are merged into spans, and a span counts once its words have been compared
with the template's words themselves.

The template table is a parameter of fixed size, so it is broadcast; nothing
of the corpus is. What is shuffled are votes, not k-grams.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import sifted, stage
from .textkit import ALNUM, buffers, phrase_words, rounds, split_words, window_hashes, windows_within, word_hashes, words_of

K = 3
#: Phrases that count wherever their words stand consecutively, and their labels.
BASE_PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Wordings that need only be close, and labels of our own. Openings and notices of licenses, and whole bodies below.
WORDINGS = (
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is licensed under the gnu general public license version 2", "gpl-2"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("subject to the terms of the mozilla public license version 2 0", "mpl-2"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit-grant"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("licensed under the creative commons attribution sharealike license", "cc-by-sa"),
    ("dedicated to the public domain", "public-domain"),
    ("all rights reserved", "all-rights-reserved"),
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "mit-text",
    ),
    (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        "isc-text",
    ),
    (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "bsd-2-text",
    ),
    (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "apache-2-notice",
    ),
    (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program. If not, see",
        "gpl-3-notice",
    ),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", "mpl-2-notice"),
)
#: Share of a wording's 3-grams that must have matched anywhere in a document before the words are compared.
GRAMS = 0.3
#: Share of a wording's words that a span must hold, in order.
LEAST = 0.8
#: Diagonals of one template at most so far apart are neighbours.
NEAR = 3


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw_all, off_all = buffers(batch.column(2))
        for a, b in rounds(off_all):
            raw, off = raw_all[off_all[a] : off_all[b]], off_all[a : b + 1] - off_all[a]
            low, ws, we, first = split_words(raw, off, ALNUM)
            at, doc = windows_within(first, K)
            gram = window_hashes(word_hashes(low, ws, we), K)[at].view(np.int64)
            n = np.diff(first)
            take = pa.array(np.concatenate([np.arange(b - a), doc]) + a)
            pos = np.concatenate([np.full(b - a, -1), at - first[doc]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(pos), pa.array(np.concatenate([n, gram]))], ["doc_id", "th", "pos", "gram"])


def _merge(diagonals: list[dict]) -> Iterator[tuple[int, int, int]]:
    """(template, first word, last word + 1) of the spans of merged neighbouring diagonals.

    A diagonal joins the span with most votes that ends where it begins, or
    later, and whose last diagonal lies near; chance votes elsewhere don't part them.
    """
    spans: dict[int, list[dict]] = {}
    for d in sorted(diagonals, key=lambda d: (d["t"], d["lo"], d["diag"])):
        near = [s for s in spans.get(d["t"], ()) if d["lo"] <= s["hi"] + NEAR and abs(d["diag"] - s["diag"]) <= NEAR]
        if near:
            best = max(near, key=lambda s: s["votes"])
            if d["hi"] + K > best["hi"]:
                best["hi"], best["diag"] = d["hi"] + K, d["diag"]
            best["votes"] += d["votes"]
        else:
            spans.setdefault(d["t"], []).append({"lo": d["lo"], "hi": d["hi"] + K, "diag": d["diag"], "votes": d["votes"]})
    for t, found in spans.items():
        for s in found:
            yield t, s["lo"], s["hi"]


def scan_licenses(docs: DataFrame, base: Sequence[tuple[str, str]] = BASE_PHRASES, wordings: Sequence[tuple[str, str]] = WORDINGS) -> DataFrame:
    """One row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans.

    Null and empty texts have no words, no labels and score 0. Rows that share
    a doc_id are judged each by its own text; equal rows give equal rows. A
    null doc_id stays null. An empty table gives no rows. Other columns are
    ignored. ``spans``: label, first word and number of words of each verified
    place, by place; of wordings whose places overlap the one with most words found counts. ``score``: the largest share of a template that was found,
    of wordings of which a share of GRAMS matched.
    """
    spark = docs.sparkSession
    phrases = [(p, label, True) for p, label in base] + [(p, label, False) for p, label in wordings]
    parsed = [phrase_words(p) for p, _, _ in phrases]
    words = [w for w, _ in parsed]
    table = [(int(g), t, o) for t, (_, h) in enumerate(parsed) for o, g in enumerate(window_hashes(h, K).view(np.int64).tolist())]
    templates = spark.createDataFrame(table, "t_gram long, t int, o int")

    keyed = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    grams = keyed.mapInArrow(_grams, "doc_id long, th long, pos int, gram long")
    votes = grams.join(F.broadcast(templates), (F.col("gram") == F.col("t_gram")) & (F.col("pos") >= 0), "left").where("pos < 0 or t is not null")
    by_diagonal = votes.groupBy("doc_id", "th", "t", (F.col("pos") - F.col("o")).alias("diag")).agg(
        F.count("*").alias("votes"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.max(F.when(F.col("pos") < 0, F.col("gram"))).alias("n_words")
    )
    # A wording of which too little stands in a document isn't one: its votes go no further.
    least = F.element_at(F.array(*(F.lit(1 if own else math.ceil(GRAMS * max(1, len(w) - K + 1))) for w, (_, _, own) in zip(words, phrases, strict=True))), F.col("t") + 1)
    total = F.sum("votes").over(Window.partitionBy("doc_id", "th", "t"))
    rows_of = F.max(F.when(F.col("t").isNull(), F.col("votes"))).over(Window.partitionBy("doc_id", "th"))
    enough = by_diagonal.withColumns({"total": total, "copies": rows_of}).where(F.col("t").isNull() | (F.col("total") >= least * F.col("copies")))
    found = enough.groupBy("doc_id", "th").agg(
        F.max("n_words").alias("n_words"),
        F.max(F.when(F.col("t").isNull(), F.col("votes"))).alias("rows"),
        F.collect_list(F.when(F.col("t").isNotNull(), F.struct("t", "diag", "votes", "lo", "hi"))).alias("diagonals"),
    )
    found = stage(found, "license-votes")
    candidates = found.where("size(diagonals) > 0")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        for batch in batches:
            out = []
            raw_all, off_all = buffers(batch.column("text"))
            for i, (doc, n_words, rows, diagonals) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_words", "rows", "diagonals")), strict=True)):
                raw = raw_all[off_all[i] : off_all[i + 1]]
                low, ws, we, _ = split_words(raw, np.array([0, len(raw)]), ALNUM)
                told = lambda lo, hi: words_of(low, ws[lo:hi], we[lo:hi])
                spans, close, best = [], [], 0.0
                for d in diagonals:
                    w = words[d["t"]]
                    lo = d["diag"]
                    if phrases[d["t"]][2] and d["votes"] >= rows * (len(w) - K + 1) and 0 <= lo and lo + len(w) <= len(ws) and told(lo, lo + len(w)) == w:
                        spans.append((lo, len(w), phrases[d["t"]][1], True))
                        best = 1.0
                for t, lo, hi in _merge([d for d in diagonals if not phrases[d["t"]][2]]):
                    a, b = max(0, lo - NEAR), min(len(ws), hi + NEAR)
                    match = [m for m in SequenceMatcher(None, told(a, b), words[t], autojunk=False).get_matching_blocks() if m.size]
                    share = sum(m.size for m in match) / len(words[t])
                    if share >= LEAST:
                        first = a + match[0].a
                        close.append((share, sum(m.size for m in match), first, a + match[-1].a + match[-1].size, phrases[t][1]))
                    best = max(best, min(1.0, share))
                taken: list[tuple[int, int]] = []
                for _, _, lo, hi, label in sorted(close, key=lambda c: (-c[1], -c[0], c[2:])):
                    if all(hi <= x or lo >= y for x, y in taken):
                        taken.append((lo, hi))
                        spans.append((lo, hi - lo, label, False))
                spans.sort()
                own = [s for s in spans if s[3]]
                out.append((doc, n_words, len(own), own[0][0] if own else None, own[-1][0] if own else None, ",".join(sorted({s[2] for s in own})), ",".join(sorted({s[2] for s in spans})), best, [{"label": s[2], "first": s[0], "words": s[1]} for s in spans]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("words", pa.int64())]))]
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    texts = sifted(keyed, F.col("th"), candidates, F.col("th")).select(F.col("doc_id").alias("k"), F.col("th").alias("h"), "text")
    joined = candidates.join(texts, F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("th") == F.col("h"))).select("doc_id", "n_words", "rows", "diagonals", "text")
    checked = joined.mapInArrow(verify, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,words:long>>")
    plain = found.where("size(diagonals) = 0").select("doc_id", "n_words", "rows")
    empty = {"n_base": F.lit(0).cast("long"), "first_word": F.lit(None).cast("long"), "last_word": F.lit(None).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0), "spans": F.array().cast("array<struct<label:string,first:long,words:long>>")}
    names = ["doc_id", "n_words", *empty]
    repeated = F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))
    quiet = plain.withColumn("again", repeated).withColumns(empty).select(*names)
    return quiet.unionByName(checked)

