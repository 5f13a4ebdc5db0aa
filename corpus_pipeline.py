"""From raw documents to piece ids: five stages, each one of the pipeline operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact_dedup, mixing, quality_rules, simhash, spm
from tessera.llm.registry import tokenizer_file
from tessera.llm.store import materialise, scratch_path, scratch_scope
from tessera.session import shipped


@shipped
def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or diverge from every language go."""
    return quality_rules.filter_documents(docs)


@shipped
def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each distinct normalised text stays, the one with the smallest id."""
    return exact_dedup.exact_dedup(docs)


@shipped
def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts of Jaccard similarity 0.8 or more over five-word shingles stays, the one with the smallest id."""
    return simhash.near_dedup(docs, similarity=0.8)


@shipped
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mix_documents(docs)


@shipped
def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every whole text, and the text that they decode to."""
    return spm.transcribe(docs, tokenizer_file("piece_bpe_32k.model"), cache_parts=80_000)


STAGES = [
    ("quality rules", quality_rules_stage),
    ("exact dedup", exact_dedup_stage),
    ("near dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: SQL can't express the divergence rules, the fingerprints or the pieces; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder and read again, and what it wrote on the way is dropped."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, "pipeline-" + name.replace(" ", "-"))
        with scratch_scope(spark, path):
            docs = materialise(stage(spark, docs, sf_dir), name, path)
    return STAGES[-1][1](spark, docs, sf_dir)
