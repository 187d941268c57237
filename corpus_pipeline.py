"""A corpus pipeline over the documents table.

Five stages, each a corpus operator whose decisions take effect: documents
scored toxic go, one document of each near-duplicate component stays,
documents that hold benchmark items go, sources are mixed to target weights
(a document may be taken twice), and what is left is placed in shards.

Toxicity and decontamination judge each row by itself and mixing decides by
a row's hash, so that none of them joins or shuffles texts; rows with null or
repeated ids or texts are judged like all others.  Near-duplicates go by id and
text.  Columns beside those of documents are kept, whatever their names;
tables without rows give tables without rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpuslab.llm import mixing, neardup, sharding, tiling, toxicity
from corpuslab.llm.common import discard, read, scratch, shared_folder, stored

#: The shards that the last stage fills.
N_SHARDS = 24
#: Similarity in hundredths from which documents are near-duplicates here; the 85 of ``op9_near_duplicates`` is that query's own.
NEAR_PERCENT = 80


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_duplicates(docs, percent=NEAR_PERCENT)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tiling.drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture_rows(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(docs, N_SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: SQL can express neither the trained classifier nor the drawn mixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's rows are written as Parquet and read again.

    What a stage checkpoints, and its predecessor's rows, are deleted once its own rows are written.
    """
    docs, before = read(spark, sf_dir, "documents"), None
    home = shared_folder(spark)
    for name, stage in STAGES:
        with scratch(spark):
            docs, path = stored(stage(spark, docs, sf_dir), name, home)
        if before:
            discard(spark, before)
        before = path
    return docs
