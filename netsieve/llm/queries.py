"""Registered queries of the text operators, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from netsieve.llm import ann, bpe, codes, fingerprints, langid, packing, secrets, sharding, simhash, substrings, toxicity, warc, whitening
from netsieve.plans.registry import query

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


@query("op1_paragraph_dedup")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return substrings.duplicate_spans(documents(spark, sf))


@query("op2_best_fit_packing")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf), BYTE_BPE, with_ids=False)


@query("op3_secret_automaton")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(documents(spark, sf)))


@query("op4_compression_toxicity")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    return toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet")))


@query("op5_speculative_bpe")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.id_digests(documents(spark, sf), BYTE_BPE)


@query("op6_subword_language")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return langid.identify(documents(spark, sf))


@query("op7_simhash_bk_trees")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op8_collision_counting")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


@query("op9_consistent_sampling")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.fingerprint_with_edit(documents(spark, sf))


@query("op10_warc_transactions")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return warc.page_rows(warc.archive(spark.read.parquet(f"{sf}/pages.parquet"), with_payload=False))


@query("op11_gnat_codes", codes.ORACLE_SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return codes.code_rows(spark.read.parquet(f"{sf}/embeddings.parquet"))


@query("op12_weighted_hash_tree", sharding.ORACLE_SQL)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.document_rows(documents(spark, sf))


@query("op13_qd_whitening")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whitened_rows(spark.read.parquet(f"{sf}/embeddings.parquet"))
