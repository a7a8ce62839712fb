"""Each operator against brute force on small tables, and on awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalloom.llm import ann, bpe, decontaminate, license_scan, line_dedup, near_dedup, packing, quality, suffix_dedup, token_shards, url_filter

public_tokenizers = pytest.importorskip("public_tokenizers")

CLASHES = "doc_id long, text string, n_lines long, n_dropped long, score double, predicted int, th long, node long, component_id long, kept string, lines string, spans string, rows long, k string, h string, _k string, bytes binary"


def docs_of(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, 1, 2, 0.5, 7, 3, 4, 5, "x", "y", "z", 6, "k", "h", "_k", b"b") for d, t in rows], CLASHES)


AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (4, "one two"), (4, "other text of the same id"), (None, "a text without an id, under the MIT License"), (6, "word " * 20000), (7, "ä" * 30000), (8, "\n" * 500), (9, "x\u0001y\x1c\u2028z <|endoftext|> \ud7ff")]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@pytest.fixture(scope="module")
def awkward(spark):
    return docs_of(spark, AWKWARD).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, [])


# --- op1 -------------------------------------------------------------------


def scan_by_hand(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for i in range(len(words)) for phrase, label in license_scan.BASE_PHRASES if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def test_license_scan(spark, docs, texts, awkward, empty):
    extra = [(10_001, "Under the MIT license! under THE mit LICENSE; cc-by-nc cc by nc; Apache License, Version 2.0"), (10_002, "under the the mit license and cc by-nc"), (10_003, "This work is licensed under the GNU General Public License, version 3."), (10_004, "this work is now licensed under the gnu general license version 3")]
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs.union(spark.createDataFrame(extra, "doc_id long, text string"))).collect()}
    for d, t in [*texts.items(), *extra]:
        r = got[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == scan_by_hand(t)
        assert 0 <= r.score <= 1 and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
    assert got[10_003].labels == "gpl-3" and got[10_004].labels == "gpl-3"
    rows = license_scan.scan_licenses(awkward).collect()
    assert len(rows) == len(AWKWARD)
    assert sorted((r.n_words, r.n_base) for r in rows) == sorted(scan_by_hand(t)[:2] for _, t in AWKWARD)
    assert license_scan.scan_licenses(empty).count() == 0


def test_whole_license_bodies_with_changes_are_found(spark):
    body = {label: text for text, label in license_scan.WORDINGS}

    def edited(label, every, put_in):
        words = body[label].split()
        return " ".join(w for i, x in enumerate(words) for w in ([x, *put_in] if i % every == every - 1 else [x]))

    cut = body["bsd-2-text"].split()
    rows = [(1, "Copyright Me. " + body["mit-text"] + " End."), (2, edited("mit-text", 25, ["ACME", "Inc"])), (3, " ".join(cut[: int(len(cut) * 0.9)])), (4, " ".join(cut[: len(cut) // 2])), (5, body["mit-text"] + " And. " + body["apache-2-notice"] + " " + body["isc-text"]), (6, body["mit-grant"]), (6, body["mit-grant"]), (7, "all rights reserved by the software and to the copyright holders of the software")]
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs_of(spark, rows)).collect()}
    assert {d: r.labels for d, r in got.items()} == {1: "mit-text", 2: "mit-text", 3: "bsd-2-text", 4: "bsd", 5: "apache-2,apache-2-notice,isc-text,mit-text", 6: "mit-grant", 7: "all-rights-reserved"}
    assert got[1].score == 1 and got[1].spans[0].first == 2 and got[1].spans[0].words == len(license_scan.phrase_words(body["mit-text"])[0])
    assert got[2].spans[0].words > got[1].spans[0].words  # neighbouring diagonals are one span


# --- op2 -------------------------------------------------------------------


def test_nearest(spark, sf):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000 + i, x[3].tolist()) for i in range(300)] + [(9000, None), (9020, [0.0] * 16), (9040, [float("nan")] * 16), (9060, [None] * 16), (9080, [1.0, 2.0]), (None, x[5].tolist()), (0, x[0].tolist())]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).toPandas()
    ids = np.array([*range(1500), *range(5000, 5300)])
    e = np.vstack([x, np.repeat(x[3:4], 300, 0)]).astype(np.float64)
    found = total = 0
    for q, part in got.groupby("query_id"):
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(1, 21)) and q not in part.vec_id.tolist()
        s = e @ e[np.flatnonzero(ids == q)[0]]
        assert np.allclose(part.score, [s[np.flatnonzero(ids == v)[0]] for v in part.vec_id], rtol=0, atol=1e-12)
        assert list(zip(-part.score, part.vec_id)) == sorted(zip(-part.score, part.vec_id))
        s[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        found, total = found + len(set(best) & set(part.vec_id)), total + 20
    assert set(got.query_id) == {i for i in ids if i % 20 == 0}
    assert found / total >= 0.9
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    two = ann.nearest(spark.createDataFrame([(20, [1.0, 0.0]), (21, [0.5, 0.5])], "vec_id long, embedding array<float>")).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in two] == [(20, 1, 21, 0.5)]


def test_an_index_is_fitted_to_the_vectors(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(60, 24))
    x = np.repeat(centres, 40, axis=0) + 0.1 * rng.normal(size=(2400, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    top = float(np.linalg.norm(x, axis=1).max())
    index = ann.fit(df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), top, 10)
    assert index.recall >= ann.RECALL and index.share < 0.5  # vectors in groups: less than half are looked at
    got = ann.nearest(df, k=10, query_every=40, index=index).toPandas()
    found = 0
    for q, part in got.groupby("query_id"):
        s = x @ x[q]
        assert np.abs(part.score - s[part.vec_id]).max() < 1e-12  # doubles stay doubles
        s[q] = -np.inf
        found += len(set(np.argsort(-s)[:10]) & set(part.vec_id))
    assert found / (10 * 60) >= 0.9
    assert ann.fit(df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")).limit(0), 1.0, 10).probes == 1


def test_perturbations_come_in_order_of_cost():
    x = np.array([0.1, 0.45, 0.8])
    sets = ann.perturbations(x, 27)
    cost = [sum((x[j] ** 2 if step < 0 else (1 - x[j]) ** 2) for j, step in s) for s in sets]
    assert cost == sorted(cost) and len({tuple(sorted(s)) for s in sets}) == 27


# --- op3, op6 --------------------------------------------------------------


@pytest.mark.parametrize(("name", "spaced"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_pieces_give_the_ids_of_whole_texts(name, spaced):
    e = bpe.PieceEncoder(public_tokenizers.path(name), spaced)
    random.seed(4)
    parts = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "a", "B", "'s", "'ll", "é", "e\u0301", "\u3000", "\x1c", "\x85", "\u200b", "1", "23", "!", "...", "<|endoftext|>", "<|", "ñ", "İ", "Σ", "日本", "\xa0", "🙂", "don't", "ß", "Æ"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 14))) for _ in range(4000)]
    assert e.ids(texts) == e.whole(texts)
    assert e.ids([None, ""]) == [b"", b""]


def test_token_blocks_round_trip():
    rng = np.random.default_rng(1)
    for ids in (rng.integers(0, 49408, 5000), np.array([7]), np.zeros(1024), np.array([0, 2**32 - 1] * 700), np.r_[np.zeros(1000), 2**31, np.ones(30)], rng.integers(40000, 40010, 3000)):
        ids = ids.astype(np.uint32)
        body, starts = token_shards.encode_blocks(ids)
        assert (token_shards.decode_blocks(body) == ids).all() and len(starts) == -(-len(ids) // token_shards.BLOCK)
        for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(body)], strict=True)):
            assert (token_shards.decode_blocks(body[a:b]) == ids[i * 1024 : i * 1024 + 1024]).all()


def whole_ids(name, text, end):
    from tokenizers import Tokenizer

    return np.array([*Tokenizer.from_file(public_tokenizers.path(name)).encode(text or "", add_special_tokens=False).ids, end], dtype="<u4").tobytes()


def test_token_shards(spark, docs, texts, awkward, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    got, start = {r.doc_id: r for r in token_shards.token_digest(docs, path).collect()}, 0
    for d in sorted(texts):
        ids = whole_ids("word_bpe_49k.json", texts[d], 2)
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4
    rows = sorted(token_shards.token_digest(awkward, path).collect(), key=lambda r: r.start)
    assert rows[0].doc_id is None and [r.doc_id for r in rows[1:]] == sorted(d for d, _ in AWKWARD if d is not None)
    assert sorted(r.ids_crc32 for r in rows) == sorted(zlib.crc32(whole_ids("word_bpe_49k.json", t, 2)) for _, t in AWKWARD)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    assert token_shards.token_digest(empty, path).count() == 0


def test_any_run_of_tokens_is_read_by_the_index(spark, docs, texts, tmp_path, monkeypatch):
    path, name = f"file://{tmp_path}/shards", "word_bpe_49k.json"
    monkeypatch.setattr(token_shards, "RECORD_TOKENS", 5000)
    token_shards.write_shards(docs, path, public_tokenizers.path(name), shards=3)
    everything = np.frombuffer(b"".join(whole_ids(name, texts[d], 2) for d in sorted(texts)), "<u4")
    reader = token_shards.TokenReader(spark, path)
    assert reader.total == len(everything) and len(reader.shards) == 3
    sought = []
    chunks = token_shards.files.chunks
    monkeypatch.setattr(token_shards.files, "chunks", lambda p, start=0, size=None, **k: sought.append(size) or chunks(p, start, size, **k))
    random.seed(6)
    for start in [0, 1023, 1024, reader.before[1] - 5, reader.before[2], len(everything) - 3, len(everything), *random.sample(range(len(everything)), 12)]:
        for n in (1, 7, 1500):
            assert (reader.read(start, n) == everything[start : start + n]).all()
    sought.clear()
    reader.read(reader.before[2] - 100, 50)
    index = 16 * len(reader.index(1)[0])
    assert sum(sought[:-1]) < index + 3 * 4500  # the index and two blocks, never the whole shard


def check_packing(pieces, expected):
    by_doc, by_seq = {}, {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at and r.length == len(r.ids) // 4 > 0
            at += r.length
        assert at <= 1024
    joined = sorted(bytes(b"".join(bytes(r.ids) for r in sorted(rows, key=lambda r: r.start))) for rows in by_doc.values())
    assert joined == sorted(expected) if expected else not joined
    return sum(r.length for r in pieces) / (1024 * max(1, len(by_seq)))


def test_packing(docs, texts, awkward, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    packed = packing.pack_documents(docs, path)
    fill = check_packing(packed.collect(), [whole_ids("byte_bpe_50k.json", t, 0) for t in texts.values()])
    assert fill > 0.97
    assert {r.n for r in packing.sequences(packed).select(F.octet_length("ids").alias("n")).collect()} == {4096}
    rows = packing.pack_documents(awkward, path).collect()
    assert sum(r.length for r in rows) == sum(len(whole_ids("byte_bpe_50k.json", t, 0)) // 4 for _, t in AWKWARD)
    assert packing.pack_documents(empty, path).count() == 0


def test_best_fit_takes_the_tightest_window():
    window, offset, n = packing.best_fit(np.array([600, 500, 400, 424, 100, 24]), 1024)
    assert n == 2 and window.tolist() == [0, 1, 1, 0, 1, 1] and offset.tolist() == [0, 0, 500, 600, 900, 1000]
    random.seed(2)
    sizes = np.array([random.randint(1, 50) for _ in range(500)])
    window, offset, n = packing.best_fit(sizes, 50)
    room = []
    for i in np.argsort(-sizes, kind="stable"):
        fit = [j for j, r in enumerate(room) if r >= sizes[i]]
        if fit:
            room[min(fit, key=room.__getitem__)] -= sizes[i]
        else:
            room.append(50 - sizes[i])
    assert n == len(room) and sorted(np.bincount(window, weights=sizes)) == sorted(50.0 - np.array(room))


# --- op4 -------------------------------------------------------------------


def lines_by_hand(rows, least):
    key = lambda x: x.strip(" \t\n\v\f\r").translate({i: i + 32 for i in range(65, 91)})
    seen = {}
    for _, t in rows:
        for k in {key(x) for x in (t or "").split("\n")} - {""}:
            seen[k] = seen.get(k, 0) + 1
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if seen.get(key(x), 0) < least]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def test_line_dedup(spark, docs, texts, awkward, empty):
    got = [tuple(r) for r in line_dedup.line_digest(docs).collect()]
    assert sorted(got) == sorted(lines_by_hand(list(texts.items()), 10))
    rows = [(i, f"Shared \n own {i}\n\n") for i in range(9)] + [(9, "\t SHARED\x0b\nshared\nother"), (10, None), (11, "own 3"), (11, "own 3")]
    for least, batches in ((10, 3), (2, 1), (3, 5)):
        out = line_dedup.drop_repeated_lines(docs_of(spark, rows), min_docs=least, batches=batches)
        assert out.columns == [c for c in docs_of(spark, []).columns if c not in ("n_lines", "n_dropped")] + ["n_lines", "n_dropped"]
        assert sorted((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in out.collect()) == sorted(lines_by_hand(rows, least))
    assert sorted(r[1:] for r in map(tuple, line_dedup.line_digest(awkward).collect())) == sorted(r[1:] for r in lines_by_hand(AWKWARD, 10))
    assert line_dedup.line_digest(empty).count() == 0


def test_runs_are_levelled_and_merged_without_shuffles(spark):
    runs = line_dedup.LineRuns(spark, 3, fanout=2, buckets=4)
    keys = lambda *pairs: spark.createDataFrame(list(pairs), "h1 long, h2 long")
    for _ in range(5):
        runs.add(keys((1, 1), (2, 2), (4, 4)))
    runs.add(keys((2, 2), (3, 3)))
    runs.add(keys((1, 1), (5, 5)))
    assert [len(level) for level in runs.levels] == [1, 1, 1]
    assert sorted(tuple(r) for r in runs.settled().collect()) == [(1, 1), (2, 2), (4, 4)]
    assert sorted(tuple(r)[:2] for r in runs.open_keys(keys((1, 1), (3, 3), (6, 6))).collect()) == [(3, 3), (6, 6)]
    with runs.sorted_scans():
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        merge, fresh, settled = plan(runs.merged(runs.runs()[:2])), plan(runs.open_keys(keys((1, 1)))), plan(runs.settled())
        assert "FullOuter" in merge and "Exchange" not in merge and "Sort " not in merge
        # The batch alone is dealt out and sorted; the runs are read in their buckets and order.
        assert fresh.count("SortMergeJoin") == 3 and fresh.count("Exchange hashpartitioning") == 1 and fresh.count("Sort [") == 1
        assert "Exchange" not in settled and "Sort " not in settled and settled.count("SortMergeJoin") == 6
    for table in runs.runs():
        for part in table.select("h1", "h2").rdd.glom().collect():
            assert [tuple(r) for r in part] == sorted(tuple(r) for r in part)
    paths = list(runs.paths.values())
    runs.close()
    assert paths and not any(__import__("os").path.exists(p.removeprefix("file://")) for p in paths)


# --- op5 -------------------------------------------------------------------


def test_decontamination(spark, sf, docs, texts, awkward, empty):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    word = re.compile(r"[^\W\d_]+")
    items = {r.item_id: word.findall(r.text.lower()) for r in bench.collect()}
    held = {d: {i for i, w in items.items() if " " + " ".join(w) + " " in " " + " ".join(word.findall(t.lower())) + " "} for d, t in texts.items()}
    got = {r.doc_id: r for r in decontaminate.contamination(docs, bench).collect()}
    assert {d: set(map(int, filter(None, got[d].items.split(",")))) for d in texts} == held
    own = spark.createDataFrame([(1, "A train leaves with 12 wagons and Tom counts 12 wagons again before he drives 30 km to Paris today"), (2, "too short"), (3, None)], "item_id long, text string")
    rows = [(1, "First. A train leaves with 99 wagons and Jim counts 99 wagons again before he drives 7 km to Rome today. More."), (2, "A train leaves with 99 wagons and Jim counts 98 wagons again before he drives 7 km to Rome today"), (3, "A train leaves, too short"), (4, "a train leaves with 12 wagons and")]
    assert {r.doc_id for r in decontaminate.contamination(docs_of(spark, rows), own).where("contaminated").collect()} == {1}
    assert {r.doc_id for r in decontaminate.clean_documents(docs_of(spark, rows), own).collect()} == {2, 3, 4}
    assert decontaminate.contamination(awkward, own).count() == len(AWKWARD) and decontaminate.contamination(empty, own).count() == 0
    assert not decontaminate.contamination(awkward, own.limit(0)).where("contaminated").count()


def test_words_put_in_or_left_out_do_not_hide_an_item(spark):
    words = "a train leaves the old station with 12 wagons full of coal and each wagon weighs 30 tons so that the whole load is far heavier than what the small bridge near the river can bear".split()
    text = lambda w: "Before. " + " ".join(w) + " . After."
    item = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    more, less = words[:17] + ["usually"] + words[17:], words[:17] + words[18:]
    split = [99 if w == "12" else w for w in words[:17]] + ["usually"] + words[17:]
    rows = [(1, text(more)), (2, text(less)), (3, text(map(str, split))), (4, text(words)), (5, text(words[:12])), (6, text([*words[:17], *(f"x{c}x" for c in "abcdefghijklmnopqrstuvwxyz"), *words[30:]]))]
    assert {r.doc_id for r in decontaminate.contamination(docs_of(spark, rows), item).where("contaminated").collect()} == {1, 2, 3, 4}


def test_names_that_begin_a_sentence_or_line_are_exchanged(spark):
    text = "Tom has 3 apples in a basket. Tom gives 2 apples to his friend. Anna eats 1 apple every day. How many apples are left for both of them?"
    item = spark.createDataFrame([(1, text)], "item_id long, text string")
    swap = lambda t, a, b: t.replace("Tom", a).replace("Anna", b)
    rows = [(1, swap(text, "Bob", "Eve")), (2, swap(text, "Mary Ann", "Eve")), (3, "Intro.\n" + swap(text, "Bob", "Eve").replace(". ", ".\n")), (4, text), (5, swap(text, "Bob", "Bob")), (6, swap(text.replace("Tom gives", "Jim gives"), "Bob", "Eve"))]
    assert {r.doc_id for r in decontaminate.contamination(docs_of(spark, rows), item).where("contaminated").collect()} == {1, 2, 3, 4, 5}


def test_copies_in_other_capitals_short_items_and_values_that_coincide(spark):
    text = "A train leaves with 12 wagons and Tom counts 30 boxes before he drives 7 km along the river to Paris today"
    item = spark.createDataFrame([(1, text), (2, "what is the capital city of France"), (3, "Yes it is"), (4, "")], "item_id long, text string")
    rows = [(1, text.replace("12", "7").replace("30", "7")), (2, text.upper()), (3, text.replace("Tom", "Anna Maria")), (4, text.lower()), (5, "He asked: WHAT IS THE CAPITAL CITY OF FRANCE? Nobody knew."), (6, "what is the capital city of Spain"), (7, "Yes it is"), (8, text.replace("Tom", "he")[:60]), (9, "A train leaves with some wagons and Tom counts them all before he walks home")]
    got = {r.doc_id: r.items for r in decontaminate.contamination(docs_of(spark, rows), item).where("contaminated").collect()}
    assert got == {1: "1", 2: "1", 3: "1", 4: "1", 5: "2"}


def leaks_by_hand(text, item):
    """The rule itself, passage by passage, without hashes or joins: for texts with one diagonal an item."""
    kind = {"\1": "name", "\2": "number", "\3": "unit"}

    def read(t):
        out = []
        for m in re.finditer(r"[A-Z][a-z]+(?:[ \t]+[A-Z][a-z]+)*|[0-9]+(?:[.,][0-9]+)*|[A-Za-z]+|%", t):
            x = m.group()
            if x[0].isdigit():
                out.append(("\2", x))
            elif out and out[-1][0] == "\2" and re.fullmatch(r"[ \t]?", t[end : m.start()]) and x.lower() in (*decontaminate.UNITS, "%"):
                out.append(("\3", x.lower()))
            elif re.match(r"[A-Z][a-z]", x):
                out.append(("\1", x.lower()))
            elif x != "%":
                out.append((x.lower(), x.lower()))
            end = m.end()
        return out

    best = 0.0
    for reader, slotted in ((read, True), (lambda t: [(w, w) for w in re.findall(r"[a-z0-9]+", t.lower())], False)):
        a, b = reader(text), reader(item)
        width = decontaminate.K if len(b) >= decontaminate.K else len(b)
        if len(b) < decontaminate.K and (slotted or len(b) < decontaminate.SHORTEST):
            continue
        windows = [o for o in range(len(b) - width + 1) if sum(w[0] not in kind for w in b[o : o + width]) >= decontaminate.LITERAL]
        for diag in range(-len(b), len(a)):
            hit = [o for o in windows if 0 <= o + diag and [w[0] for w in a[o + diag : o + diag + width]] == [w[0] for w in b[o : o + width]]]
            if hit and len(hit) >= len(windows) * decontaminate.COVER:
                pairs = {(y, x) for (k, y), (_, x) in zip(b[min(hit) : max(hit) + width], a[min(hit) + diag : max(hit) + width + diag]) if k in kind}
                if not slotted or len({y for y, _ in pairs}) == len(pairs):
                    best = max(best, len(hit) / len(windows))
    return best


def test_decontamination_against_the_rule(spark):
    random.seed(12)
    plain = "the a of train box river moves counts finds small old then again before under near each whole".split()

    def made(n):
        return " ".join(random.choice([random.choice(plain)] * 4 + [random.choice(["Tom", "Anna", "Rome"]), str(random.randint(2, 5)), f"{random.randint(2, 5)} km"]) for _ in range(n))

    items = [(i, made(random.randint(3, 24))) for i in range(25)]

    def changed(t):
        for old in ("Tom", "Anna", "2", "3"):
            if random.random() < 0.5:
                t = t.replace(old, random.choice(["Bob", "Eve Ann", "Rome"]) if old[0].isupper() else random.choice("46"), random.choice([1, -1]))
        return random.choice([t, t, t.upper(), t[: len(t) * 2 // 3]])

    rows = [(j, made(random.randint(0, 12)) + " . " + changed(random.choice(items)[1]) + " ; " + made(random.randint(0, 12))) for j in range(150)]
    found = decontaminate.find_leaks(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    by_hand = {(d, i) for d, t in rows for i, x in items if leaks_by_hand(t, x)}
    assert by_hand <= got and len(by_hand) > 60
    assert len(got - by_hand) <= 3  # passages over several diagonals, which the rule by hand leaves out


# --- op7 -------------------------------------------------------------------


def rule_by_hand(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fit = [(len(h) + len(p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else None


def test_url_filter(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    urls = ["HTTP://A.Example.ORG/es/1?x", "http://example.org/en/12#a", "http://org/x", "http://xorg/x", "ftp://h.com", "no scheme", None, "", "a://b://c/d", "http://n.example.net/a\nb?c", "http://shop.com/fr/", "http://shop.com/de/"]
    own = spark.createDataFrame([(100_000 + i, u, '<a href="https://Spam.example.com/x">' if i % 2 else None, i) for i, u in enumerate(urls)], "page_id long, url string, html string, host long")
    rows = url_filter.judge_urls(pages.select("page_id", "url", "html").unionByName(own.select("page_id", "url", "html"))).collect()
    url = {r.page_id: r.url for r in pages.unionByName(own.drop("host")).collect()}
    assert len(rows) == len(url)
    for r in rows:
        host, path, rule, verdict = rule_by_hand(url[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.distrust > r.trust else "allow"))
    assert url_filter.judge_urls(own).count() == len(urls) and url_filter.judge_urls(own.limit(0)).count() == 0


def test_propagation_against_matrices(spark):
    edges = [("a", "b", 2.0), ("b", "c", 1.0), ("a", "c", 1.0), ("d", "a", 1.0)]
    seeds = [("a", "trust", 1.0), ("c", "distrust", 1.0)]
    got = {r.host: (r.trust, r.distrust) for r in url_filter.propagate(spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame(seeds, "host string, walk string, seed double"), rounds=4).collect()}
    names, m = "abcd", np.zeros((4, 4))
    for s, t, w in edges:
        m[names.index(s), names.index(t)] = w
    for walk, (way, seed) in enumerate(((m, 0), (m.T, 2))):
        out = np.divide(way, way.sum(axis=1, keepdims=True), out=np.zeros((4, 4)), where=way.sum(axis=1, keepdims=True) > 0)
        e = np.eye(4)[seed]
        x = e
        for _ in range(4):
            x = url_filter.DAMPING * out.T @ x + (1 - url_filter.DAMPING) * e
        assert np.allclose([got.get(n, (0, 0))[walk] for n in names], x)


def test_trust_reaches_hosts_many_steps_away(spark):
    """Verdicts end to end: links walked by hand until nothing moves, on a chain longer than any fixed number of rounds."""
    far = 14
    rows = [(0, "http://seed.org/x", '<a href="http://h0.net/">')] + [(i + 1, f"http://h{i}.net/", f'<a href="http://h{i + 1}.net/">' if i + 1 < far else None) for i in range(far)]
    rows += [(50, "http://bad.com/de/", None), (51, "http://bad.com/de/", None), (52, "http://linker.net/", '<A HREF=//bad.com/de/>' + "x" * 200_000), (53, "http://quiet.net/", None), (54, None, None), (55, "http://one.net/", '<a href="http://bad.com/">'), (56, "http://two.net/", '<a href="http://one.net/">')]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in url_filter.judge_urls(pages).collect()}
    host = lambda u: re.match(r"(?:[^:]*://([^/?#]*))?", u or "")[1] or ""
    links = {}
    for _, u, html in rows:
        for to in {x.lower() for x in re.findall(r"""(?i)href\s*=\s*["']?(?:http:)?//([^/?#"'\s<>]+)""", html or "")} - {host(u)}:
            links[host(u), to] = links.get((host(u), to), 0) + 1.0
    for child in {host(u) for _, u, _ in rows} - {""}:
        while child.count(".") > 1:
            parent = child.split(".", 1)[1]
            links.setdefault((child, parent), 1.0)
            links.setdefault((parent, child), 1.0)
            child = parent
    names = sorted({x for e in links for x in e} | {host(u) for _, u, _ in rows})
    way = np.zeros((len(names), len(names)))
    for (a, b), n in links.items():
        way[names.index(a), names.index(b)] = n
    score = {}
    for walk, m, seeds in (("trust", way, {"seed.org": 1.0}), ("distrust", way.T, {"bad.com": 1.0})):
        p = np.divide(m, m.sum(axis=1, keepdims=True), out=np.zeros_like(m), where=m.sum(axis=1, keepdims=True) > 0)
        e = np.array([seeds.get(n, 0.0) for n in names])
        x = e
        for _ in range(400):
            x = url_filter.DAMPING * p.T @ x + (1 - url_filter.DAMPING) * e
        score[walk] = dict(zip(names, x))
    for i, u, _ in rows:
        h = host(u)
        t, d = score["trust"].get(h, 0), score["distrust"].get(h, 0)
        assert abs(got[i].trust - t) < 0.02 and abs(got[i].distrust - d) < 0.02
        assert got[i].verdict == (rule_by_hand(u)[3] or ("block" if d > t else "allow"))
    assert got[far].trust > 0 and got[52].verdict == got[55].verdict == got[56].verdict == "block" and got[53].verdict == "allow"


# --- op8 -------------------------------------------------------------------


def repeats_by_hand(rows, threshold=100):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - threshold + 1):
            if b[i : i + threshold] in seen:
                gone[i : i + threshold] = b"\1" * threshold
            seen.add(b[i : i + threshold])
        out[d] = (len(b), sum(gone), sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1])), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def test_suffix_dedup(spark, docs, texts, awkward, empty):
    random.seed(3)
    pieces = ["alpha", "be", "gamma ", "ñandú", "x", "delta\n"]
    base = "".join(random.choices(pieces, k=400))
    rows = [(i, "".join(random.choices(pieces, k=random.randint(0, 60))) + base[(p := random.randint(0, 1500)) : p + random.randint(0, 300)] + "".join(random.choices(pieces, k=random.randint(0, 40)))) for i in range(100)]
    rows += [(200, "a" * 350), (201, "b" + "a" * 120 + "c"), (202, ""), (203, None), (204, "ab" * 200), (205, base), (206, base), (207, "a" * 99), (208, "a" * 100)]
    for table, expected in ((docs_of(spark, rows).repartition(5), repeats_by_hand(rows)), (docs, repeats_by_hand(list(texts.items())))):
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_digest(table).collect()} == expected
    assert suffix_dedup.remove_repeats(awkward).count() == len(AWKWARD) and suffix_dedup.remove_repeats(empty).count() == 0


# --- op9 -------------------------------------------------------------------


def near_by_hand(rows, k, percent=80):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
        sets[d] = {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({" ".join(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def test_near_duplicates(spark, docs, texts, awkward, empty):
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(500)]
    hub = random.choices(vocabulary, k=120)
    edited = lambda n: " ".join(random.choice(vocabulary) if i in set(random.sample(range(120), n)) else w for i, w in enumerate(hub))
    rows = [(i, edited(random.choice([0, 1, 2, 3, 6]))) for i in range(40)] + [(100 + i, " ".join(hub[: 4 + i])) for i in range(6)] + [(200, "One two"), (201, "one  TWO"), (202, "one"), (203, ""), (204, None), (205, "a b c d e"), (206, "a b c d e f g h")]
    for table, own, k in ((docs_of(spark, rows).repartition(3), rows, 4), (docs, list(texts.items()), 4), (docs, list(texts.items()), 5)):
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(table, k=k).collect()} == near_by_hand(own, k)
    out = near_dedup.near_duplicates(awkward).collect()
    assert len(out) == len(AWKWARD) and sum(r.doc_id is None and r.kept for r in out) == 1
    assert near_dedup.near_duplicates(empty).count() == 0 and near_dedup.keep_first(empty).count() == 0


def test_pairs_far_from_all_hubs_are_linked(spark):
    random.seed(9)
    form = [f"w{i}" for i in range(2000)]

    def fill(words, places, tag):
        return [f"{tag}x{i}" if i in places else w for i, w in enumerate(words)]

    slots = range(2, 1998, 4)
    rows = []
    for p in range(150):
        letter = fill(form, set(random.sample(slots, 7)), f"p{p}")
        rows += [(2 * p + i, " ".join(fill(letter, set(random.sample(slots, 26)), f"d{p}n{i}"))) for i in range(2)]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs_of(spark, rows).repartition(3), k=4).collect()}
    assert got == {d: c for d, (_, c, _) in near_by_hand(rows, 4).items()}
    assert len(set(got.values())) > 100


def test_estimates_follow_jaccard():
    rng = np.random.default_rng(6)
    errors = []
    for j in (0.2, 0.5, 0.8, 0.95):
        n = 4000
        shared = int(2 * n * j / (1 + j))
        for _ in range(20):
            pool = rng.integers(0, 2**64, 2 * n - shared, dtype=np.uint64)
            a, b = np.sort(pool[:n]), np.sort(pool[n - shared :])
            sig = near_dedup.registers(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            errors.append(near_dedup.estimate(sig[:1], sig[1:])[0][0] - j)
    assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < 0.2


# --- op10 ------------------------------------------------------------------


def test_quality(spark, docs, awkward, empty):
    sf = "/root/testdata/sf0.01"
    big, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in quality.quality_digest(big, labels).collect()}
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    test = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(a == b for a, b in test) / len(test) >= 0.95
    spoiled = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r.doc_id: r.score for r in quality.quality_digest(big, spoiled).collect()} == {d: r.score for d, r in got.items()}
    odd = spark.createDataFrame([(None, 1), (1, None), (2, 5), (3, 0), (3, 1)], "doc_id long, quality int")
    rows = quality.score_documents(awkward, quality.train(awkward, odd)).collect()
    assert len(rows) == len(AWKWARD) and {r.score for r in rows} == {0.0, 1.0}
    assert quality.score_documents(empty, None).count() == 0


def test_gradients():
    rng = np.random.default_rng(2)
    model = quality.Model(np.zeros(quality.FEATURES), np.ones(quality.FEATURES))
    x, starts, y, w = rng.normal(size=(9, quality.FEATURES)), np.array([0, 4, 5]), np.array([1.0, 0.0, 1.0]), np.ones(3)
    loss = lambda: -np.mean(y * np.log(model.score(x, starts)) + (1 - y) * np.log(1 - model.score(x, starts)))
    for name, g in model.gradients(x, starts, y, w).items():
        at = tuple(rng.integers(0, n) for n in g.shape)
        old = model.w[name][at]
        model.w[name][at] = old + 1e-6
        up = loss()
        model.w[name][at] = old - 1e-6
        down = loss()
        model.w[name][at] = old
        assert abs((up - down) / 2e-6 - g[at]) < 1e-5


def test_words_that_sum_alike_hash_apart():
    from signalloom.llm import textkit

    a, b = "a", "b"
    for _ in range(12):
        a, b = a + b, b + a
    words = [a, b, a[:300], b[:300], "x", "x\0", "ab", "ba", "abcdefgh", "abcdefgh\0", "abcdefghi", *(f"w{i}" for i in range(3000))]
    raw = " ".join(words).encode()
    member = textkit.byte_class((0x20, 0x20))
    low, ws, we, _ = textkit.split_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), member)
    got = textkit.word_hashes(low, ws, we)
    assert len(set(got.tolist())) == len(words) == len(got)
    assert (textkit.word_hashes(low[: we[3]], ws[:4], we[:4]) == got[:4]).all()


def test_long_words_are_told_apart(spark):
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    rows = [(1, f"one two three {a}"), (2, f"one two three {b}"), (3, f"one two three {a}")]
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs_of(spark, rows)).collect()} == {1: 1, 2: 2, 3: 1}


def test_one_row_of_a_component_stays(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (1, text), (1, text + " more"), (1, "of its own"), (2, text), (None, text), (None, "no id"), (None, "no id"), (3, None), (3, None), (4, ""), (5, " ")]
    out = near_dedup.keep_first(docs_of(spark, rows).repartition(4))
    assert out.columns == docs_of(spark, []).columns
    kept = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    assert len([r for r in kept if r[0] == 1]) == 2 and (1, "of its own") in kept
    assert [r for r in kept if r[0] != 1] == sorted([(None, "no id"), (3, None), (4, ""), (5, " ")], key=repr)


def test_rows_are_sifted_by_key(spark):
    from signalloom.staging import sifted

    rows = spark.range(2000).select("id", F.col("id").alias("word"), F.xxhash64("id").alias("x"))
    keys = rows.where("id % 100 = 7")
    out = sifted(rows, F.col("x"), keys, F.col("x"))
    assert out.columns == rows.columns and out.join(keys, "id", "left_semi").count() == 20 and out.count() < 40
    assert sifted(rows, F.col("x"), keys.limit(0), F.col("x")).count() == 0
