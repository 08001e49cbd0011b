"""From documents to packed training sequences: the stages and the whole run.

Each stage is one operator of ``essenta.llm`` over all rows its predecessor kept; its result is
written as Parquet and read again as the next stage's documents. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from essenta.llm.common import Folder
from essenta.llm.exact_dedup import drop_exact_duplicates
from essenta.llm.mixing import mixture
from essenta.llm.packing import pack_documents
from essenta.llm.quality_classifier import drop_poor
from essenta.llm.simhash import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return drop_poor(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest id."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of close fingerprints, the one with the smallest id."""
    return drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for."""
    return mixture(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their sequence and place in it."""
    return pack_documents(docs)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("near dedup", near), ("mix sources", mix), ("pack", pack)]

# Models, fingerprints and the search for a packing are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    folder = Folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = folder.write(stage(spark, docs, sf_dir), f"stage{number}")
        if number:
            folder.drop(f"stage{number - 1}")
    return docs
