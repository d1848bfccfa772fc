"""The corpus pipeline: documents in, packed token sequences out. Every stage is written as Parquet and read again.

Stages: toxic documents go; of near-duplicates one stays; repeated passages go; secrets are masked; what is left is
tokenised and packed. All but the last return the columns of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from netsieve.llm import packing, secrets, simhash, substrings, toxicity
from netsieve.llm.queries import BYTE_BPE
from netsieve.plans.registry import query
from netsieve.session import bound_batches, broadcast_smaller, materialize


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression distance does not call toxic."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_ordinary(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component; documents without an id are kept."""
    found = materialize(simhash.near_duplicates(docs), "components")
    extra = found.where("doc_id <> component_id").select("doc_id").distinct()
    docs, extra = broadcast_smaller(docs, extra)
    return docs.join(extra, "doc_id", "left_anti").select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; documents of which nothing is left go."""
    return _measured(substrings.remove_spans(docs, substrings.duplicate_spans(docs)))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a mark in the place of every secret."""
    return _measured(secrets.redact(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents with their sequences and offsets."""
    return packing.pack_documents(docs, BYTE_BPE, with_ids=False)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _in_small_batches(stage: Stage) -> Stage:
    """One set of workers runs all stages, and what a batch took in one of them is still held in the next."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", _in_small_batches(drop_toxic)),
    ("simhash", _in_small_batches(drop_near_duplicates)),
    ("substrings", _in_small_batches(cut_repeats)),
    ("secrets", _in_small_batches(mask_secrets)),
    ("packing", _in_small_batches(pack_sequences)),
]
#: Compression lengths, hashes and BPE are beyond SQL; tests compare every stage with a brute-force version.
ORACLE_SQL: str | None = None


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"corpus-{name}")
    return docs
