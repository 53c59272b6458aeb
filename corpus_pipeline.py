"""The corpus pipeline: quality rules, exact and near deduplication, surrogates for personal data, packing.

Each stage is written as Parquet and read again as the next one's documents. Null texts count as empty, so the quality rules
reject them; rows without doc_id are rows like any other up to the end; of repeated rows one stays; a very long text passes
each stage whole and is cut only into the windows it is packed in; of equal texts the longest original stays, then the least
doc_id, and of near ones the least doc_id; an empty table gives an empty result; further columns, whatever their names, pass
through all stages but the last, which returns pieces with their token ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cursus.llm import exact_dedup, jaccard, packing, pii, quality
from cursus.llm.common import documents, owned_tables, remove, shared_dir


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Links of five words' SimHash fingerprints, checked: similarity 0.8. MinHash adds those beyond the bits that the trees can search.
    return jaccard.near_dedup(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.replace_pii(docs, pii.key_of(spark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.pack(docs)  # with the ids to train on
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("quality rules", rules), ("exact dedup", exact), ("near dedup", near), ("pii", private), ("packing", pack)]
#: Shingle sets and tokenizers are beyond SQL; tests/llm holds the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another. What a run has written, and nothing else, goes when it isn't needed any more: a stage's
    own tables and its input when its result stands, and everything if a stage fails."""
    docs, before = documents(spark, sf_dir), None
    place = f"{shared_dir(spark).rstrip('/')}/cursus-pipeline-{uuid.uuid4().hex}"
    try:
        for name, stage in STAGES:
            path = f"{place}/{name.replace(' ', '-')}"
            with owned_tables(spark):
                stage(spark, docs, sf_dir).write.parquet(path)
            if before:
                remove(spark, before)
            docs, before = spark.read.parquet(path), path
    except BaseException:
        remove(spark, place)
        raise
    return docs
