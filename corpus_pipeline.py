"""Corpus pipeline: documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again as the next stage's docs. All but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import contamination, jaccard_join, packing, quality, suffix_dedup
from lodestone.llm.runtime import materialize


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group linked by n-gram Jaccard similarity."""
    return jaccard_join.keep_one(docs)


#: Bytes of a repeat that is cut. Passages of over 50 words must go, shorter ones stay: 51 repeated words of check_s take 322 bytes in the middle and 254 at the shortest hundredth.
REPEAT = suffix_dedup.PASSAGE


def cut(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings that are also elsewhere."""
    return suffix_dedup.cut_repeats(docs, REPEAT)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return contamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their text and their places in sequences."""
    return packing.with_text(docs, packing.pack(docs))


STAGES = [
    ("quality classifier", good),
    ("n-gram jaccard join", distinct),
    ("suffix-array dedup", cut),
    ("benchmark decontamination", clean),
    ("best-fit packing", packed),
]

#: No stage can be expressed in SQL whole; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, in order, over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
