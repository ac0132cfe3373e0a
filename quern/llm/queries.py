"""The queries `opN_<name>` and the SQL that DuckDB checks them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import decontamination, exact_dedup, language_id, minhash, packing, quality, secret_scan, suffix_dedup, token_files, tokens, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(divisor: int):
    """crc32 of the id as text, modulo the divisor."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(spark, _table(spark, sf_dir, "documents"), _remainder(3) != 1)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(spark, _table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark, _table(spark, sf_dir, "documents"), words=2)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = token_files.token_files(spark, _table(spark, sf_dir, "documents"), tokens.public("byte_bpe_50k.json"), kind="byte", end_id=2)
    return read.select("doc_id", "start", F.octet_length("ids").cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")).withColumn("n_tokens", F.expr("n_tokens div 4"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(spark, _table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), held_out=_remainder(5) == 0)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), tokens.public("word_bpe_49k.json"), kind="word", end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), training=_remainder(5) != 0)
    return scored.select("doc_id", (_remainder(5) == 0).alias("held_out"), "text_score", "metadata_score", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(spark, _table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_language_id": op1_language_id,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_minhash": op3_minhash,
    "op4_token_files": op4_token_files,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_packing": op7_packing,
    "op8_decontamination": op8_decontamination,
    "op9_quality": op9_quality,
    "op10_secret_scan": op10_secret_scan,
    "pipeline": corpus_pipeline.run,
}

ORACLE: dict[str, str] = {
    "op3_minhash": r"""
        with recursive w as (
            select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[\x20\x09-\x0D]+'), lambda w: w <> '') as words from documents),
        s as (
            select distinct doc_id, shingle from (
                select doc_id, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) as shingle
                from w where len(words) > 1
                union all select doc_id, words[1] from w where len(words) = 1)),
        n as (select doc_id, count(*) as n from s group by 1),
        meet as (
            select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
        link as (
            select a, b from meet join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 80 * (x.n + y.n - shared)),
        edge as (select a, b from link union all select b, a from link),
        reach(doc_id, other) as (
            select doc_id, doc_id from documents
            union select r.doc_id, e.b from reach r join edge e on e.a = r.other)
        select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id, c.component_id = d.doc_id as kept
        from documents d left join n using (doc_id) join (select doc_id, min(other) as component_id from reach group by 1) c using (doc_id)""",
    "op5_exact_dedup": r"""
        with t as (
            select doc_id, length(coalesce(text, '')) as points,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as norm
            from documents)
        select doc_id,
               first_value(doc_id) over (partition by norm order by points desc, doc_id) as keep_id,
               count(*) over (partition by norm) as group_size,
               doc_id = first_value(doc_id) over (partition by norm order by points desc, doc_id) as kept,
               sha256(norm) as text_sha256
        from t""",
    "op8_decontamination": r"""
        with d as (
            select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as words from documents),
        b as (
            select item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as words from benchmark),
        bi as (select item_id, words, unnest(range(greatest(len(words) - 9, 1))) as i from b where len(words) > 0),
        win as (
            select array_to_string(words[i + 1 : i + 10], ' ') as phrase, least(len(words), 10) as size,
                   list(distinct item_id) as items
            from bi group by 1, 2),
        sizes as (select distinct size from win),
        di as (
            select doc_id, s.size, unnest(range(len(words) - s.size + 1)) as i, words
            from d, sizes s where len(words) >= s.size),
        occ as (
            select di.doc_id, di.i, di.size, win.items from di
            join win on win.size = di.size and win.phrase = array_to_string(di.words[di.i + 1 : di.i + di.size], ' ')),
        hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + size)) as p from occ) group by 1),
        it as (
            select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names
            from (select distinct doc_id, cast(unnest(items) as varchar) as item from occ) group by 1)
        select d.doc_id, cast(len(d.words) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
               cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(names, '')) as items_sha256,
               coalesce(n_hit, 0) > 0 as contaminated
        from d left join hit using (doc_id) left join it using (doc_id)""",
}
