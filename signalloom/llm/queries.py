"""Queries over the driver's tables, one an operator, with production parameters; and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann, decontaminate, license_scan, line_dedup, near_dedup, packing, quality, suffix_dedup, token_shards, url_filter
from ..staging import small_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents")).drop("spans")


def op2_multiprobe_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), k=20, query_every=20)


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.token_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digest(_table(spark, sf_dir, "documents"))


def op5_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_digest(_table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), k=4, percent=80)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_multiprobe_ann, op3_token_shards, op4_line_dedup, op5_template_decontamination, op6_packing, op7_url_filter, op8_suffix_dedup, op9_near_dedup, op10_quality)}

ORACLE_SQL = {
    "op4_line_dedup": r"""
with lines as (
  select doc_id, rn, unnest(l) as line, unnest(range(len(l))) as i
  from (select doc_id, row_number() over () as rn, string_split(coalesce(text, ''), chr(10)) as l from documents)
), keyed as (
  select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines
), bad as (
  select k from keyed where k <> '' group by k having count(distinct rn) >= 10
)
select doc_id, count(*) as n_lines, count(bad.k) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where bad.k is null), '')) as kept_sha256
from keyed left join bad on keyed.k = bad.k
group by doc_id, rn
""",
    "op9_near_dedup": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), sh as (
  select distinct doc_id, unnest(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from w
), n as (
  select doc_id, count(*) as n from sh group by doc_id
), p as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2
), l as (
  select a, b from p join n x on a = x.doc_id join n y on b = y.doc_id where 100 * c >= 80 * (x.n + y.n - c)
), e as (
  select a, b from l union all select b, a from l
), reach(doc_id, r) as (
  select doc_id, doc_id from documents union select e.b, reach.r from reach join e on e.a = reach.doc_id
), c as (
  select doc_id, min(r) as component_id from reach group by doc_id
)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id, d.doc_id = c.component_id as kept
from documents d left join n on n.doc_id = d.doc_id join c on c.doc_id = d.doc_id
""",
}
