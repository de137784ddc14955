"""The registered queries of this subpackage, one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, fingerprint, language, mixing, packing, simhash_dedup, suffix_dedup, token_file, toxicity, url_filter
from .common import materialize, new_path, table, vocabulary


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_dedup.simhash_groups(table(spark, sf_dir, "documents"), budget=3, width=3)
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=[1, 2, 3], cap=3)
    return mixed.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = materialize(fingerprint.edited_fingerprints(table(spark, sf_dir, "documents")), "edited")
    near = fingerprint.near_counts(out.select("id", "fingerprint"), radius=3)
    return out.join(near, ["id", "fingerprint"], "left").withColumnRenamed("id", "doc_id")


def op5_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    token_file.write(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"), end_id=0)
    return token_file.read(spark, path, with_ids=False)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.rules_frame(spark, url_filter.RULES))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (op1_simhash_dedup, op2_mixing, op3_suffix_dedup, op4_fingerprints, op5_token_file, op6_language, op7_packing, op8_embedding_dedup, op9_url_filter, op10_toxicity)}

ORACLES = {"op3_suffix_dedup": suffix_dedup.ORACLE_SQL, "op8_embedding_dedup": embedding_dedup.ORACLE_SQL, "op9_url_filter": url_filter.ORACLE_SQL}
