"""The pipeline: each stage on its own input, and what the whole leaves."""

import re

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")

from .test_operators import lines_by_hand, near_by_hand  # noqa: E402


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    sf = "/root/testdata/sf0.001"
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for i, (name, step) in enumerate(pipeline.STAGES):
        path = f"{tmp_path_factory.mktemp('stages')}/{i}"
        step(spark, docs, sf).write.parquet(path)
        out.append((name, docs, docs := spark.read.parquet(path)))
    return out


def test_stages_keep_the_columns_of_documents(outputs):
    for name, before, after in outputs[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes, name
        assert 0 < after.count() <= before.count()


def test_lines_stage(outputs):
    _, before, after = outputs[1]
    import hashlib

    expected = {d: h for d, _, _, h in lines_by_hand([(r.doc_id, r.text) for r in before.collect()], 10)}
    for r in after.collect():
        assert hashlib.sha256(r.text.encode()).hexdigest() == expected[r.doc_id] and r.n_chars == len(r.text)


def test_near_stage(outputs):
    _, before, after = outputs[2]
    expected = {d for d, (_, _, kept) in near_by_hand([(r.doc_id, r.text) for r in before.collect()], 5).items() if kept}
    assert {r.doc_id for r in after.collect()} == expected


def test_leaks_stage(spark, outputs):
    _, before, after = outputs[3]
    word = re.compile(r"[^\W\d_]+")
    items = [" " + " ".join(word.findall(r.text.lower())) + " " for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    clean = {r.doc_id for r in before.collect() if not any(i in " " + " ".join(word.findall(r.text.lower())) + " " for i in items)}
    assert {r.doc_id for r in after.collect()} == clean


def test_pack_stage(outputs):
    _, before, after = outputs[4]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
    assert after.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t")).where("n <> t").count() == 0


AWKWARD = "doc_id long, text string, lang string, source string, n_chars int, th long, k string, kept string, lines string, predicted string"


def through(spark, tmp_path, rows, bench):
    """Each stage's output over awkward documents; nothing to learn from, so every text with words is accepted."""
    sf = str(tmp_path)
    spark.createDataFrame([(d, t, "en", "s", len(t or ""), 1, "k", "x", "y", "z") for d, t in rows], AWKWARD).repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, step in pipeline.STAGES:
        step(spark, docs, sf).write.parquet(f"{sf}/{name}")
        docs = out[name] = spark.read.parquet(f"{sf}/{name}")
    return out, pipeline.run(spark, sf)


def test_all_stages_on_awkward_rows(spark, tmp_path):
    item = "a train leaves the old station with twelve wagons full of coal and nobody knows where it goes"
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"Shared line\nown text number {i} " + " ".join(f"u{i}x{j}" for j in range(12))) for i in range(12)]
    rows += [(20, None), (21, ""), (22, " \n\t"), (23, base), (23, base), (24, base + " end"), (None, base + " more words"), (None, "alone without an id but with words"), (25, "see: " + item.upper() + " ."), (26, "word " * 30_000), (27, "z" * 50_000)]
    out, final = through(spark, tmp_path, rows, [(1, item), (2, None)])
    names = [c.split()[0] for c in AWKWARD.split(", ")]
    for name in ("quality", "lines", "near", "leaks"):
        assert out[name].columns == names
    texts = lambda name: sorted(((r.doc_id, r.text) for r in out[name].collect()), key=repr)
    assert texts("quality") == sorted([(d, t) for d, t in rows if (t or "").strip()], key=repr)
    cut = sorted([(d, t.removeprefix("Shared line\n")) for d, t in rows if (t or "").strip()], key=repr)
    assert texts("lines") == cut and all(r.n_chars == len(r.text) for r in out["lines"].collect())
    kept = sorted([(d, t) for d, t in {*cut} if (d, t) not in ((24, base + " end"), (None, base + " more words"))], key=repr)
    assert texts("near") == kept
    assert texts("leaks") == [x for x in kept if x[0] != 25]
    pieces = out["pack"].collect()
    assert {r.doc_id for r in pieces} == {d for d, _ in kept if d != 25}
    key = lambda r: repr((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens))
    assert sorted(map(key, final.collect())) == sorted(map(key, pieces))


def test_an_empty_table_passes_all_stages(spark, tmp_path):
    out, final = through(spark, tmp_path, [], [])
    assert all(df.count() == 0 for df in out.values()) and final.count() == 0
