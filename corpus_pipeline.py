"""The corpus pipeline: quality classifier, exact dedup, SimHash near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame, which the
caller writes as Parquet and reads again as the next one's docs. All stages but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridlab.llm import exact_dedup, kneser_ney, packing, simhash, substring_dedup
from gridlab.llm.common import Scratch, table, tune
from gridlab.llm.queries import vocabulary


#: Differing fingerprint bits of near copies; wider than the 2 of the query, which its contract fixes.
NEAR_RADIUS = 4


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return kneser_ney.quality_filter(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return exact_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return simhash.near_dedup(docs, radius=NEAR_RADIUS)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return substring_dedup.substring_dedup(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("substring_dedup", substring),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express the tokeniser, the language model's sharded counts or the packing.
ORACLE_SQL = None
