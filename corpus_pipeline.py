"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``. Between stages the table is written
to the shared folder and read again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.llm import decontaminate, line_dedup, near_dedup, packing, quality
from signalloom.staging import small_batches, stage

#: Workers of the last stage have run the others before it, so their memo of pieces is smaller.
MEMO_PIECES = 60_000


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Each row is judged by its own text, so equal rows stay or go together. A null
    or empty text, or one without words, scores 0 and goes. A null doc_id isn't a
    label's. An empty table gives no rows; labels that teach nothing
    leave every text with words. Columns besides doc_id and text pass as they are.
    """
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.score_documents(docs, quality.train(docs, labels)).where("predicted = 1").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand in ten or more of them; n_chars, where there is one, follows the text.

    A null text becomes empty. No document goes, though it may lose all its
    lines; each row counts as a document, equal ones too. Other columns pass as they are.
    """
    small_batches(spark)
    kept = line_dedup.drop_repeated_lines(docs).select(*docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, a similarity of 0.8): that of the least doc_id.

    Texts without words are copies of nothing, but of rows with equal doc_id and
    text one stays. A null doc_id gives way to any other. An empty table gives no rows.
    """
    small_batches(spark)
    return near_dedup.keep_first(docs, k=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay; rows that share a doc_id are judged
    each by its own text; an empty benchmark keeps all.
    """
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed in sequences of 1024 tokens.

    A null or empty text is its end id alone; rows that share a doc_id, equal
    ones too, are documents each; an empty table gives no pieces.
    """
    small_batches(spark)
    return packing.packing_digest(docs, public_tokenizers.path("byte_bpe_50k.json"), memo_pieces=MEMO_PIECES)


STAGES = [("quality", keep_quality), ("lines", drop_lines), ("near", keep_one_of_near), ("leaks", drop_leaks), ("pack", pack)]

#: The classifier and the packing can't be expressed in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
