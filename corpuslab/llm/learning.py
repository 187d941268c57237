"""Bounded samples of labelled documents, for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, limit: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, _y, _rank, text`` of at most ``limit`` labelled training documents.

    The rows are those whose ids come first by a hash, so the choice depends on
    nothing else.  Rows with a null label or id don't take part; of conflicting
    labels the greater counts.  The bound makes the ids fit for broadcast.
    """
    known = labels.filter(train & F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("_y"))
    chosen = known.withColumn("_rank", F.xxhash64("_id")).orderBy("_rank", "_id").limit(limit)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(chosen), "_id").select("_id", "_y", "_rank", "text")
