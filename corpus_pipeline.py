"""Corpus pipeline: quality, line dedup, near-dedup, decontamination, tokens; each stage written and read again.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratalane.llm import bpe, decontaminate, line_dedup, quality, simhash
from stratalane.llm._common import stash


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages of lines."""
    return line_dedup.clean(docs, passages=True)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more; texts without words are one group."""
    return simhash.near_dedup(docs, shingle=5, similarity=0.8, wordless=True)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by benchmark items."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to."""
    import public_tokenizers as P

    ranks = P.path("byte_bpe_50k.tiktoken")
    return bpe.encode(docs, bpe.RankEncoder(ranks, P.PATTERN), then=bpe.digester(ranks), schema=bpe.DIGESTS)


STAGES = [
    ("quality classifier", classify),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", dedup_near),
    ("benchmark decontamination", decontaminated),
    ("byte-level BPE encoding and decoding", tokenise),
]
#: The classifier and the fingerprints have no SQL form; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
